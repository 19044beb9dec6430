from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from hourgrid.llm import langid, license_index, queries, toxicity

SF = "/root/testdata/sf0.01"


def remainder(doc_id, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def test_toxicity_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    assert len(rows) == queries.table(spark, SF, "documents").count()
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows.values())
    assert all(r.predicted == (r.score >= 0.3) for r in rows.values())
    known = [(l.toxic, rows[l.doc_id]) for l in queries.table(spark, SF, "labels").collect() if rows[l.doc_id].held_out]
    caught = [r.predicted for toxic, r in known if toxic]
    spared = [1 - r.predicted for toxic, r in known if not toxic]
    assert np.mean(caught) > 0.6 and np.mean(spared) > 0.95


def test_toxicity_stands_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)] * 2, "doc_id long, toxic int")
    rows = toxicity.judged(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.judged(no_docs, labels).count() == 0
    empty = toxicity.judged(odd_docs, labels.where("false")).collect()
    assert len(empty) == odd_docs.count() and {r.score for r in empty} == {0.0}


def test_toxicity_on_few_labels(spark):
    """Two toxic rows are enough for scores; a small table does not call clean documents toxic."""
    small = "/root/testdata/sf0.001"
    docs = queries.table(spark, small, "documents")
    labels = {l.doc_id: l.toxic for l in queries.table(spark, small, "labels").collect()}
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, small).collect()}
    known = [(labels[d], r.predicted) for d, r in rows.items() if d in labels]
    assert np.mean([p for t, p in known if not t]) < 0.1
    few = spark.createDataFrame([*[(d, 1) for d, t in labels.items() if t and remainder(d, 4) != 2][:2],
                                 *[(d, 0) for d, t in labels.items() if not t][:38], (987654, 1)], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.scored(docs, few).collect()]
    assert len(scores) == docs.count() and max(scores) > 0
    assert toxicity.without_toxic(docs, few).count() > 0.9 * docs.count()


def test_features_see_hidden_words():
    lexicon = toxicity.Lexicon({"=grumble": 3.0, "lowe": 2.0})
    f = dict(zip(toxicity.NAMES, toxicity.features(lexicon, "You GRUMBLE, id1ot! s t u p i d loweish")))
    assert f["hit_count"] == pytest.approx(np.log1p(2)) and f["heaviest"] == 3.0
    assert f["hidden"] > 0 and f["near_you"] > 0 and f["upper_words"] > 0
    assert not any(toxicity.features(lexicon, ""))


def test_language_of_held_out_rows(spark):
    docs = {d.doc_id: d for d in queries.table(spark, SF, "documents").collect()}
    rows = queries.op3_langid(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.93


def test_language_of_odd_documents(spark, odd_docs, no_docs):
    rows = langid.identified(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r.lang_pred for r in rows}
    assert [by[i] for i in (0, 1, 2, 3, 4, 7)] == ["und"] * 6 and by[6] == "en" and by[8] == "en"
    assert langid.identified(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identified(odd_docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "some words of a longer text " * 20
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.array_equal(langid.counts(text), whole)


def test_licences_against_brute_force(spark):
    texts = {d.doc_id: d.text for d in queries.table(spark, SF, "documents").collect()}
    rows = queries.op6_licenses(spark, SF).collect()
    assert len(rows) == len(texts)
    seen = set()
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(i, label) for label, phrase in license_index.BASE.items() for p in [phrase.split()]
                 for i in range(len(words)) if words[i:i + len(p)] == p]
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        base = {label for _, label in found}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | set()
        flat = " " + " ".join(words) + " "
        for label, passage, must in license_index.TEMPLATES:
            if f" {passage} " in flat:
                assert label in r.labels.split(",")
            if label in r.labels.split(",") and label != "mit":
                assert f" {must} " in flat
        seen |= set(r.labels.split(","))
    assert {"gpl", "gpl-3.0", "apache-2.0", "mit", "reserved", "cc-by", "cc-by-nc"} <= seen


def test_licences_in_odd_documents(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(100, "CC BY cc,by. GNU general  public license", 1)], "doc_id long, text string, labels int")
    row = license_index.scanned(more).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (3, 0, 5, "cc-by,gpl")
    rows = license_index.scanned(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.labels == "" and r.score == 0 for r in rows)
    assert license_index.scanned(no_docs).count() == 0
