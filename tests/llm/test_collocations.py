"""Collocations against SQL over all n-grams, a plain twin at low thresholds, and the guarantee of the summaries."""
from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import differences
from hypothesis import given, settings
from hypothesis import strategies as st

from hourgrid.llm import collocations as C
from hourgrid.llm import queries

SF = "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows: list[tuple], threshold: int, top: int, longest: int = 5) -> set[tuple]:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if a >= threshold and len(p) > 2}
    found = []
    for (lang, *words), a in often.items():
        if any(q[0] == lang and f_q >= a and len(q) - 1 > len(words) and
               any(list(q[i:i + len(words)]) == words for i in range(1, len(q) - len(words) + 1)) for q, f_q in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found.append((lang, " ".join(words), a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score))
    out = set()
    for lang in n:
        best = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out |= {(lang, rank, *x[1:]) for rank, x in enumerate(best, 1)}
    return out


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert differences(queries.op13_collocations(spark, SF), con, C.SQL) == []


def some_docs(spark, odd_docs):
    rng = random.Random(3)
    words = ["The", "the", "of", "a-b", "été", "漢字", "x\x1cy", "new", "york", "city", "\xa0"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "fr", None, "und"])) for i in range(150)]
    rows += [(1000 + i, "new york city hall is the same passage", "en") for i in range(60)]
    rows += [(2000, "big " * 30000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(odd_docs.select("doc_id", "text", "lang"))
    return docs.selectExpr("*", "1 as f", "2 as n", "'z' as phrase", "3 as key")


@pytest.mark.parametrize("capacity, held, rows_held", [(C.CAPACITY, C.HELD, C.PHRASES), (40, 64, 16)])
def test_small_summaries_lose_nothing(spark, odd_docs, monkeypatch, capacity, held, rows_held):
    docs = some_docs(spark, odd_docs).repartition(5)
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(C, "PHRASES", rows_held)
    got = C.collocations(docs, threshold=7, top=25, capacity=capacity)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain([(r.lang, r.text) for r in docs.collect()], 7, 25)


def test_nothing_to_count(spark, no_docs):
    assert C.collocations(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " .\n", "en")], "doc_id long, text string, lang string")
    assert C.collocations(blank, threshold=1).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=80), min_size=1, max_size=12), st.integers(2, 12))
def test_summaries_keep_every_frequent_key(parts, threshold):
    true = Counter(k for p in parts for k in p)
    summary = C.MisraGries(max(1, sum(map(len, parts)) // threshold), threshold)
    for p in parts:
        key, count = np.unique(np.array(p, np.uint64), return_counts=True)
        summary.merge([key], [count])
    assert summary.error < threshold
    assert all(c <= true[k] <= c + summary.error for k, c in zip(summary.key.tolist(), summary.count.tolist()))
    assert {k for k, c in true.items() if c >= threshold} <= set(summary.frequent().tolist())


def test_chunks_cut_between_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(C, "CHUNK", 40)
    texts = [b"one two three. four five\nsix " * 9, b"", b"no end " * 30, b"x"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", "b", "b"]), pa.array(texts)], names=["lang", "text"])
    got = {lang: Counter() for lang in "ab"}
    for lang, data in C.chunks(batch):
        got[lang].update(tuple(p.split()) for p in data.split(C.EDGE) if p.split())
    want = {lang: Counter(tuple(p.split()) for k in ks for p in re.split(rb"[.\n]", texts[k]) if p.split())
            for lang, ks in {"a": (0, 1), "b": (2, 3)}.items()}
    assert got == want
