from __future__ import annotations

import corpus_pipeline
import pytest

from hourgrid.llm import decontaminate, queries, simhash_trie, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0.5 * counts[0]


def test_decisions_take_effect(spark, stages):
    texts = [{r.doc_id: r.text for r in s.collect()} for s in stages[:-1]]
    labels = {l.doc_id: l.toxic for l in queries.table(spark, SF, "labels").collect()}
    gone = set(texts[0]) - set(texts[1])
    known = [labels[d] for d in gone if d in labels]
    assert known and sum(known) >= 0.9 * len(known)
    assert all(texts[0][d] == texts[1][d] for d in texts[1])
    lines = [x.strip(" ") for t in texts[2].values() for x in t.split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
    for d, t in texts[2].items():  # only whole lines go, in order
        rest = iter(texts[1][d].split("\n"))
        assert all(x in rest for x in t.split("\n"))
    found = {r.doc_id: r.component_id for r in simhash_trie.near_duplicates(stages[2]).collect()}
    assert set(texts[3]) == {d for d, c in found.items() if d == c}
    assert len(set(found.values())) == len(texts[3])
    leaked = {r.doc_id for r in decontaminate.leaks(stages[3], queries.table(spark, SF, "benchmark")).collect()}
    assert set(texts[4]) == set(texts[3]) - leaked
    assert {r.doc_id for r in stages[5].collect()} == set(texts[4])


def test_run_gives_the_last_stage(spark, stages):
    want = {tuple(r) for r in stages[-1].collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_odd_documents_pass(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)], "doc_id long, toxic int")
    assert toxicity.without_toxic(odd_docs, labels).columns == odd_docs.columns
    assert simhash_trie.first_of_each(odd_docs).columns == odd_docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 5
