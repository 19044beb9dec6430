from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from hourgrid.llm import bpe_tree, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return bpe_tree.codec(PATH, PATTERN)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 50])
def test_tree_equals_whole_text(library, leaf):
    encoder, table = library
    random.seed(leaf)
    pieces = ["a", "'", "ll", "'re", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "12", "é", "漢字", "!?", "\U0001f600",
              "the", "Word", "́", "s"]
    for _ in range(400):
        text = "".join(random.choices(pieces, k=random.randint(0, 60)))
        ids = bpe_tree.encode_tree(encoder.encode_ordinary, text, leaf)
        assert ids == encoder.encode_ordinary(text), text
        assert bpe_tree.decode_tree(table, ids, 3) == text.encode()


def test_query_against_library(spark, sf_dir, library):
    encoder, _ = library
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_documents(spark, odd_docs, no_docs):
    tokens = bpe_tree.decoded(bpe_tree.encoded(odd_docs, PATH, PATTERN, 100), PATH, PATTERN)
    want = sorted((r.doc_id is None, r.doc_id, (r.text or "").encode()) for r in odd_docs.collect() if r.doc_id is not None)
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.decoded)) for r in tokens.collect() if r.doc_id is not None)
    assert got == want
    assert tokens.count() == odd_docs.count()
    assert bpe_tree.encoded(no_docs, PATH, PATTERN).count() == 0


def test_one_map_gives_the_same_digests(spark, odd_docs):
    import public_tokenizers

    from hourgrid.llm import bpe_tree
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    steps = bpe_tree.digests(bpe_tree.decoded(bpe_tree.encoded(odd_docs, path, pattern), path, pattern))
    for leaf in (16, bpe_tree.LEAF_CHARS):
        both = bpe_tree.round_trip(odd_docs, path, pattern, leaf)
        assert both.columns == steps.columns
        assert sorted(map(str, both.collect())) == sorted(map(str, steps.collect()))


def test_the_tree_joins_most_texts(spark):
    """Most characters lie in texts longer than a leaf, so the joins decide their ids."""
    from hourgrid.llm import bpe_tree
    from hourgrid.llm import queries
    sizes = [len(r.text or "") for r in queries.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    assert sum(s for s in sizes if s > bpe_tree.LEAF_CHARS) > 0.9 * sum(sizes)
