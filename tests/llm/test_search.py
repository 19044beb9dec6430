from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from hourgrid.llm import decontaminate as dc
from hourgrid.llm import mtree, queries

NAN, INF = float("nan"), float("inf")


def brute(rows, k=20, every=20) -> set:
    """Rows: (vec_id, list or None)."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in good if i % every == 0}:
        found = set()
        for j, q in good:
            if j == i:
                found |= {(-sum(a * b for a, b in zip(q, v)), o, n) for n, (o, v) in enumerate(good) if o != i and len(v) == len(q)}
        out |= {(i, r + 1, o, -s) for r, (s, o, _) in enumerate(sorted(found)[:k])}
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect()]
    got = queries.op10_mtree(spark, sf).collect()
    x = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    want = set()
    for i in ids[ids % 20 == 0]:
        s = m @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        want |= {(int(i), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("subtree", [5, 50])
def test_small_trees_ties_and_copies(spark, subtree):
    rng = np.random.default_rng(subtree)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + (i % 4 == 0) * rng.normal(size=8) * 0.1).tolist()) for i in range(300)]
    rows += [(400 + i, base[0].tolist()) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mtree.top_k(frame, 20, 20, pivots=8, subtree=subtree).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [NAN, 1.0]), (4, [INF, 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]),
            (6, []), (20, [-1.0, 0.25]), (40, [1.0, 2.0, 3.0]), (60, []), (7, [0.0, 0.0]), (80, [0.0, 0.0]), (8, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, dim string, score int")
    got = mtree.top_k(frame, 3, 20).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 3)
    assert mtree.top_k(frame.where("false")).count() == 0
    wide = spark.createDataFrame([(0, [1e9] * 4), (1, [1e9] * 4), (2, [-1e300] * 4), (3, [2e9, -3.0, 1e-300, 5.0])],
                                 "vec_id long, embedding array<double>")
    best = mtree.top_k(wide, 3, 20).collect()
    assert [r.vec_id for r in sorted(best, key=lambda r: r["rank"])] == [1, 3, 2]
    assert {r.vec_id: r.score for r in best}[3] == (1 << 63) - 1


def test_subsequence():
    assert dc.common_subsequence(list("abcbdab"), list("bdcaba")) == 4
    assert dc.common_subsequence(list("abc"), []) == 0


@pytest.mark.parametrize("rank", [0, 64])
def test_windows_are_compared_by_the_terms_they_hold(rank, monkeypatch):
    """Cosines and held shares as of whole rows of terms, which are not made for the windows of documents."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    block = dc.Benchmark([(i, " ".join(rng.choice(words, 64))) for i in range(12)])
    space = block.telling(rng.integers(0, 40, len(block.number)), 1000)
    own = space.of_parts()
    space.fit(own.T @ (own @ space.noise(dc.SKETCH)), rank)
    texts = [" ".join(rng.choice(words, 150)) for _ in range(10)] + [" ".join(w.decode() for w in block.parts[3][1])]
    dims, at, n, where = next(dc._stacked(texts, space.dim, dc.STRIDE))
    rows = space.vectors(dims, at, n)
    want = rows @ own.T
    if rank:
        latent, parts = rows @ space.basis, own @ space.basis
        want[:, space.spanned] = (latent / np.linalg.norm(latent, axis=1, keepdims=True)
                                  @ (parts / np.linalg.norm(parts, axis=1, keepdims=True)).T)[:, space.spanned]
    weight = space.idf.astype(float) ** 2
    share = (rows > 0) * weight @ (own > 0).T / ((own > 0) @ weight)
    cosine, held = space.compared(dims, at, n)
    assert bool(rank) == bool(len(space.spanned)) and np.allclose(cosine, want, atol=1e-5) and np.allclose(held, share, atol=1e-5)

    def none(*args):
        raise AssertionError("a row of all terms for each window")
    monkeypatch.setattr(dc.Space, "vectors", none)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts),
                             "of": pa.array(range(len(texts)), pa.int64())})
    found = [r for b in dc._matched(space)([batch]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["share"]) for r in found] == [(10, 3, 1.0)]


def test_copies_among_repeated_telling_words_are_found(spark):
    """Exact copies whose surroundings repeat telling terms of another item, at every offset to the windows."""
    rng = np.random.default_rng(3)
    common = [f"common{i}" for i in range(40)]
    items = {k: " ".join([*rng.choice(common, 12), *(f"own{k}x{i}" for i in range(8))]) for k in range(1, 9)}
    items[9] = " ".join(f"long{i}" for i in range(64))
    items[10] = " ".join(f"longer{i}" for i in range(90))
    rows = [(1000 + i, " ".join(rng.choice(common, 300))) for i in range(300)]
    planted = set()
    for k, item in items.items():
        noise = f"own{k % 8 + 1}x0"
        for at in range(0, 64, 5):
            doc = 100 * k + at
            rows.append((doc, " ".join([noise] * (64 + at)) + f" {item} " + " ".join([noise] * 100)))
            planted.add((doc, k))
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()} == planted


def test_leaked_rows_do_not_take_others_of_their_id(spark):
    item = " ".join(f"telling{i}" for i in range(20))
    rows = [(None, f"before it {item} after it"), (None, "a clean text without an id"),
            (7, f"once more {item}"), (7, "another clean text")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = dc.clean(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, rows[1][1]), (7, rows[3][1])]


def test_leaks_on_real_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents").collect()
    items = queries.table(spark, sf, "benchmark").collect()
    flat = [(d.doc_id, b" " + b" ".join(dc.words_of(d.text)) + b" ") for d in docs]
    want = {(d, i.item_id) for i in items for d, t in flat if b" " + b" ".join(dc.words_of(i.text)) + b" " in t}
    got = {(r.doc_id, r.item_id): r.share for r in queries.op4_decontamination(spark, sf).collect()}
    assert want and want <= set(got)
    assert len(set(got) - want) <= 0.02 * len(want) + 1


def test_paraphrases_and_odd_documents(spark, odd_docs, no_docs):
    rng = np.random.default_rng(5)
    common = "the of and to in is that it was for".split()
    word = lambda: "".join(rng.choice(list("bcdfglmnprst")) + rng.choice(list("aeiou")) for _ in range(4))
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(12)] + [(20, ""), (21, None), (22, " ".join(text(300))), (0, "extra words here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(300):
        words = text(200)
        if i < 12:
            own = items[i][1].split()
            if i % 3 == 1:  # every ninth word replaced
                own = [w if k % 9 else word() for k, w in enumerate(own)]
            if i % 3 == 2:  # words put in
                own = [x for k, w in enumerate(own) for x in ([w, "indeed"] if k % 6 == 0 else [w])]
            words[i * 9:i * 9] = own
        if i == 50:
            words[100:100] = items[14][1].split()[100:220]
        rows.append((i, " ".join(words), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    found = {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()}
    assert found == {(i, i) for i in range(12)} | {(50, 22)}
    assert dc.clean(docs, benchmark).count() == 300 - 13
    assert dc.clean(docs, benchmark).columns == docs.columns
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark, items=5).collect()} == found
    assert dc.leaks(odd_docs, benchmark).count() == 0 and dc.leaks(no_docs, benchmark).count() == 0
    assert dc.leaks(docs, benchmark.where("false")).count() == 0
    assert dc.clean(odd_docs, benchmark).count() == odd_docs.count()


def test_query_equals_sql(spark):
    import duckdb
    from compare import differences
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert differences(queries.op10_mtree(spark, "/root/testdata/sf0.01"), con, queries.SQL["op10_mtree"]) == []
