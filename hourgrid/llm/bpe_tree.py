"""Byte-level BPE as a monoid: a text's halves are encoded on their own and joined by encoding a window at their border.

An element is a stretch of text with its ids. Two neighbours are joined by encoding anew only the characters between a
*settled border* left of the cut and one right of it. A settled border is a space or line feed after a character that
is not white space: no match of the split pattern holds white space behind other characters, so a match ends there
whatever stands before or after it, and as matches are encoded one by one, the ids outside the window cannot change.
The window grows by doubling until it holds such borders; without any it takes in the whole element.
"""
from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import rows_mapped, smaller_batches, texts_of

LEAF_CHARS = 512
LEAF_IDS = 256
FIRST_WINDOW = 64
# Python's white space holds that of the split pattern, so what precedes is not white space for either.
BORDER = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str):
    """The leaf encoder and the table from id to bytes; made once in each worker."""
    import tiktoken
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


def last_border(text: str, lo: int, hi: int) -> int:
    """The last settled border in ``text[lo:hi]``, after ``lo``; ``lo`` if there is none."""
    width = FIRST_WINDOW
    while True:
        at = max(lo + 1, hi - width)
        found = [m.start() for m in BORDER.finditer(text, at, hi)]
        if found:
            return found[-1]
        if at == lo + 1:
            return lo
        width *= 2


def first_border(text: str, lo: int, hi: int) -> int:
    """The first settled border in ``text[lo:hi]``, after ``lo``; ``hi`` if there is none."""
    found = BORDER.search(text, lo + 1, hi)
    return found.start() if found else hi


def joined(encode, text: str, lo: int, cut: int, hi: int, left: list[int], right: list[int]) -> list[int]:
    """The ids of ``text[lo:hi]`` from those of the stretches before and after ``cut``."""
    a, b = last_border(text, lo, cut), first_border(text, cut, hi)
    keep = len(left) - len(encode(text[a:cut]))
    skip = len(encode(text[cut:b]))
    return left[:keep] + encode(text[a:b]) + right[skip:]


def encode_tree(encode, text: str, leaf: int = LEAF_CHARS, lo: int = 0, hi: int | None = None) -> list[int]:
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return encode(text[lo:hi])
    cut = (lo + hi) // 2
    return joined(encode, text, lo, cut, hi, encode_tree(encode, text, leaf, lo, cut),
                  encode_tree(encode, text, leaf, cut, hi))


def decode_tree(table: list[bytes], ids, leaf: int = LEAF_IDS) -> bytes:
    if len(ids) <= leaf:
        return b"".join([table[i] for i in ids])
    half = len(ids) // 2
    return decode_tree(table, ids[:half], leaf) + decode_tree(table, ids[half:], leaf)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_tokens`` and ``ids``, little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. Repeated rows stay repeated, a null ``doc_id`` stays null, further columns are
    not read. The ids are those of encoding the whole text at once. A map without a shuffle: a document is one row, and
    its halves are encoded in the task that holds it.
    """
    def one(state, doc_id, text):
        ids = encode_tree(state[0].encode_ordinary, text, leaf)
        return doc_id, len(ids), np.asarray(ids, dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    run = rows_mapped(schema, one, ["doc_id", "text"], lambda: codec(ranks_path, pattern))
    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``: the bytes of their ids, concatenated up the tree. No ids: no bytes."""
    def one(state, doc_id, n_tokens, ids):
        return doc_id, n_tokens, ids, decode_tree(state[1], np.frombuffer(ids, dtype="<u4").tolist())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                        ("decoded", pa.binary())])
    run = rows_mapped(schema, one, ["doc_id", "n_tokens", "ids"], lambda: codec(ranks_path, pattern))
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(tokens: DataFrame) -> DataFrame:
    """Lowercase hex SHA-256 of ids and decoded bytes."""
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """``digests`` of every document in one map: texts are encoded, the ids decoded again, and only digests leave the task.

    Null ids, null and empty texts and repeated rows as in ``encoded``.
    """
    smaller_batches(docs.sparkSession)

    def one(state, doc_id, text):
        ids = encode_tree(state[0].encode_ordinary, text, leaf)
        coded = np.asarray(ids, dtype="<u4").tobytes()
        back = decode_tree(state[1], np.frombuffer(coded, dtype="<u4").tolist())
        return doc_id, len(ids), hashlib.sha256(coded).hexdigest(), hashlib.sha256(back).hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    run = rows_mapped(schema, one, ["doc_id", "text"], lambda: codec(ranks_path, pattern))
    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
