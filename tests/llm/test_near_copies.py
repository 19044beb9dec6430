from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from hourgrid.llm import components, queries, shards, simhash_trie


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    runs = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if runs else 0


def plain_sets(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash_trie, "CHUNK", 5)
    random.seed(1)
    for n in (0, 1, 3, 4, 5, 9, 40):
        text = " \n".join(random.choices(["a", "Bé", "ccc", "d1"], k=n))
        assert simhash_trie.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("page", [2, 8])
def test_trie_sets_equal_brute_force(page):
    rng = np.random.default_rng(page)
    for shape in range(6):
        base = rng.integers(0, 1 << 63, 12, dtype=np.uint64) if shape % 2 else np.zeros(1, np.uint64)
        flips = np.array([sum(1 << int(b) for b in rng.integers(0, 10 if shape < 3 else 64, rng.integers(0, 9)))
                          & (2**64 - 1) for _ in range(150)], np.uint64)
        x = np.unique(rng.choice(base, 150) ^ flips)
        near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
        assert simhash_trie.linked(x, 4, page).tolist() == plain_sets(len(x), near.tolist())


@pytest.mark.parametrize("crowd", [10, 100_000])
def test_edges_lose_no_link(spark, crowd):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    x = np.unique(np.array([int(rng.choice(base)) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 5).tolist()))
                            for _ in range(400)], np.uint64))
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = components.components(simhash_trie.trie_edges(frame, 4, crowd)).collect()
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1)).tolist()
    sets = plain_sets(len(x), near)
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    size = Counter(sets)
    assert {at[r.node] for r in found} == {i for i, s in enumerate(sets) if size[s] > 1}
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(sets[at[r.node]])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == sum(1 for n in size.values() if n > 1)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    rows = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(rows[i] == 0 for i in range(41))
    assert all(rows[200 + i] == 100 for i in range(30)) and rows[100] == 100
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    fps = np.array([plain_fingerprint(d.text) for d in docs], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1)).tolist()
    sets = plain_sets(len(docs), near)
    rows = {r.doc_id: r for r in queries.op9_simhash(spark, sf_dir).collect()}
    for i, d in enumerate(docs):
        assert rows[d.doc_id].fingerprint == f"{int(fps[i]):016x}"
        assert rows[d.doc_id].component_id == docs[sets[i]].doc_id


def test_odd_documents(spark, odd_docs, no_docs):
    rows = simhash_trie.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = {r.doc_id: r for r in rows}
    assert all(blank[i].fingerprint == "0" * 16 and blank[i].component_id == 0 for i in range(5))
    assert simhash_trie.near_duplicates(no_docs).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(3, a), (5, a), (5, b), (None, a), (None, c)]
    out = simhash_trie.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, c), (3, a), (5, b)]


def test_sharding(spark, sf_dir, odd_docs, no_docs):
    docs = {d.doc_id: d.text for d in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op7_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    total = Counter()
    places = {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        total[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    mean, largest = sum(total.values()) / 16, max(r.size for r in rows)
    assert set(total) <= set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(total.values()) <= mean + largest and min(total.values()) >= mean - largest
    odd = shards.sharded(odd_docs, 3, 8).collect()
    assert len(odd) == odd_docs.count() and {r.shard for r in odd} <= {0, 1, 2}
    assert shards.sharded(no_docs).count() == 0


def test_stored_map_keeps_versions_and_moves_whole_slots(spark, odd_docs, tmp_path):
    path = str(tmp_path / "map")
    first = shards.sharded(odd_docs, 4, 16, path).collect()
    versions = spark.read.parquet(path).groupBy("version").count().collect()
    assert {r.version: r["count"] for r in versions} == {1: 16, 2: 16}
    assert len({(r.virtual_slot, r.shard) for r in first}) == len({r.virtual_slot for r in first})


def test_repeated_rows_spread_over_shards(spark):
    """A third of all rows are one row: shards stay near equal, and no slot holds a whole group."""
    rows = [(1, "the same text of this group")] * 3000 + [(i, f"text number {i} of its own") for i in range(10, 6010)]
    rows += [(None, "no id")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = shards.sharded(docs, 16).collect()
    assert len(placed) == len(rows)
    total, places = {}, {}
    for r in placed:
        total[r.shard] = total.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.position)
    mean = sum(total.values()) / 16
    assert len(total) == 16 and max(total.values()) < 1.02 * mean and min(total.values()) > 0.98 * mean
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    slots = {r.virtual_slot for r in placed if r.doc_id == 1}
    assert len(slots) > 1500
    again = {(r.doc_id, r.text_crc32): r.virtual_slot for r in shards.with_slots(docs.where("doc_id > 1")).collect()}
    assert all(again[r.doc_id, r.text_crc32] == r.virtual_slot for r in placed if (r.doc_id or 0) > 1)  # slots do not move


def test_chunks_of_copies(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 7)
    docs = spark.createDataFrame([(i % 3, "t" * (i % 3)) for i in range(50)], "doc_id long, text string")
    got = shards.with_slots(docs, 64)
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {0: 17, 1: 17, 2: 16}
