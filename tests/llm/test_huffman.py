from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hourgrid.llm import huffman_ids as hf
from hourgrid.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_huffman_cost(counts: list[int]) -> int:
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 300, 5000])
def test_lengths_are_a_code_and_optimal(n):
    rng = np.random.default_rng(n)
    counts = np.concatenate([rng.integers(1, 1000, n), np.zeros(5, np.int64)]).astype(np.int64)
    lengths = hf.code_lengths(counts, 32)
    used = lengths[lengths > 0].astype(int)
    assert len(used) == n
    if n > 1:
        assert sum(2.0 ** -l for l in used) == 1.0
        assert int((counts * lengths).sum()) == plain_huffman_cost(counts.tolist())
        steep = hf.code_lengths(np.array([2**min(i, 50) for i in range(n)] if n < 300 else counts.tolist()), 16)
        assert steep.max() <= 16 and sum(2.0 ** -int(l) for l in steep if l) <= 1.0


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
@pytest.mark.parametrize("symbols", [1, 3, 3000])
def test_bits_round_trip(n, symbols):
    rng = np.random.default_rng(n + symbols)
    ids = np.minimum(rng.geometric(0.01, n) - 1, symbols - 1)
    lengths = hf.code_lengths(np.bincount(ids, minlength=symbols))
    offsets, payload = hf.packed(ids, hf.canonical(lengths), lengths)
    assert hf.unpacked(offsets, payload, n, hf.decoding_table(lengths)).tolist() == ids.tolist()


def test_encoder_equals_library():
    own, library = hf.Encoder(PATH), Tokenizer.from_file(PATH)
    random.seed(3)
    pieces = ["a", "'", "ll", "'re", " ", "  ", "\n", "\t", "\r\n", " ", "\x1c", "12", "é", "漢字", "!?", "the", "<|endoftext|>", "<|"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 40))) for _ in range(500)]
    got = [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts, 2)]
    assert got == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def expected(docs) -> dict:
    library = Tokenizer.from_file(PATH)
    out, start = {}, 0
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        out[d.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_query_against_library(spark, sf_dir):
    want = expected(queries.table(spark, sf_dir, "documents").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_huffman(spark, sf_dir).collect()}
    assert got == want


def test_many_buckets_and_blocks(spark, sf_dir, tmp_path, monkeypatch):
    docs = queries.table(spark, sf_dir, "documents").repartition(7)
    monkeypatch.setattr(hf, "BLOCK_IDS", 3000)
    hf.write_ids(docs, PATH, str(tmp_path / "f"), bucket_bytes=20_000)
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in hf.id_table(spark, str(tmp_path / "f")).collect()}
    assert got == expected(docs.collect())


def test_odd_documents(spark, odd_docs, no_docs):
    rows = hf.written_and_read(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count()
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(rows, key=lambda r: r.start)]
    assert keys == sorted(keys)
    assert hf.written_and_read(no_docs, PATH).count() == 0
    same = odd_docs.selectExpr("cast(7 as long) doc_id", "text")
    assert sum(r.n_tokens for r in hf.written_and_read(same, PATH).collect()) == sum(n for _, n in spans)


def test_a_text_is_merged_in_one_call():
    """Words that are met once only are not looked up and merged one by one."""
    own, library = hf.Encoder(PATH), Tokenizer.from_file(PATH)
    merge, calls = own.merge, []
    own.merge = lambda text: calls.append(text) or merge(text)
    random.seed(5)
    texts = [" ".join("".join(random.choices("abcdefghij\n", k=random.randint(1, 15))) for _ in range(200)) for _ in range(10)]
    got = [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts, 2)]
    assert got == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert calls == texts
