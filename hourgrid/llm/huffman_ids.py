"""Token ids in canonical, length-limited Huffman code: written in independent blocks, read back through one table.

Format. A *code table* has the length of each id's code; codes follow from the lengths (canonical: by length, then id).
*Blocks* are rows of a Parquet table in the shared folder: the documents in a block in ascending doc_id order with
their numbers of ids, the ids of all of them as one string of bits, and the bit offset of every ``STEP``-th id, from
which decoding can start. A block needs nothing but the code table to be read.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import new_path, stored, texts_of, to_batch

LONGEST = 16
STEP = 256
BLOCK_IDS = 1 << 18
BUCKET_BYTES = 64 << 20
END_ID = 2
BATCH = 64
# Fixed value: the split pattern of byte-level tokenizers.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
BLOCK_SCHEMA = ("bucket int, block int, doc_ids array<long>, sizes array<long>, n_ids long, offsets binary, payload binary")


class Encoder:
    """The ids that the tokenizers library gives with the tokenizer file at ``path``.

    A whole text is split by the byte-level pattern and its pieces are merged by rank, in one call of the tiktoken library:
    in a byte-level BPE file whose merges make ids in their own order, which is checked, that is what the tokenizers
    library does. Texts with other white space or a special token, and all texts of other files, are handed to that
    library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"].get("merges") or []
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        made = [vocabulary.get(a + b, -1) for a, b in pairs]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.path, self.special, self.library = path, list(added), None
        self.size = max([*vocabulary.values(), *added.values()]) + 1
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.code = self.kind[1:].replace("u2", "H").replace("u4", "I")
        byte = {c: b for b, c in byte_letters().items()}
        plain = {t: i for t, i in vocabulary.items() if t not in added}
        first = spec.get("pre_tokenizer") or {}
        by_rank = (spec["model"]["type"] == "BPE" and first.get("type") == "ByteLevel" and not first.get("add_prefix_space")
                   and not spec.get("normalizer") and all(a < b for a, b in zip(made, made[1:]))
                   and set(byte) <= set(plain) and (not made or made[0] > max(plain[c] for c in byte)) and made[:1] != [-1])
        ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()} if by_rank else {}
        self.merge = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if by_rank else None

    def _whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str], end: int | None) -> list[bytes]:
        tail = b"" if end is None else np.array([end], self.kind).tobytes()
        out = []
        for text in texts:
            if self.merge is None or any(s in text for s in self.special) or any(c in text for c in OTHER_SPACES):
                out.append(self._whole(text) + tail)
            else:
                out.append(array(self.code, self.merge(text)).tobytes() + tail)
        return out


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others
    numbered on from 256 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 where the count is 0."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate([weight, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        merged = merged[at]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * n - 2
    for plain in reversed(levels):
        symbols = int(plain[:take].sum())
        lengths[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, as a number of its length's bits."""
    codes = np.zeros(len(lengths), np.int64)
    code, last = 0, 0
    for i in sorted(np.nonzero(lengths)[0].tolist(), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits to look at, id, length) for every value of so many bits."""
    bits = max(1, int(lengths.max(initial=1)))
    ids, used = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    codes = canonical(lengths)
    for i in np.nonzero(lengths)[0].tolist():
        free = bits - int(lengths[i])
        at = int(codes[i]) << free
        ids[at:at + (1 << free)] = i
        used[at:at + (1 << free)] = lengths[i]
    return bits, ids, used


def packed(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """(offset of every ``step``-th id, bits) of the coded ids, first bit first."""
    if not len(ids):
        return b"", b""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    offsets = (ends - size)[::step].astype("<u8").tobytes()
    # Two neighbours make one code of up to 32 bits, which reaches into two 64-bit words at most.
    value = codes[ids].astype(np.uint64)
    if len(ids) % 2:
        value, size, ends = np.append(value, np.uint64(0)), np.append(size, 0), np.append(ends, ends[-1])
    value = (value[::2] << size[1::2].astype(np.uint64)) | value[1::2]
    size, ends = size[::2] + size[1::2], ends[1::2]
    at = ends - size
    word, over = at >> 6, (at & 63) + size - 64
    inside = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
    out = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
    first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
    out[word[first]] = np.bitwise_or.reduceat(inside, first)
    cut = np.nonzero(over > 0)[0]  # one code at most reaches over the end of a word
    out[word[cut] + 1] |= value[cut] << (64 - over[cut]).astype(np.uint64)
    return offsets, out.astype(">u8").tobytes()[:(int(ends[-1]) + 7) // 8]


def unpacked(offsets: bytes, payload: bytes, n_ids: int, table, step: int = STEP) -> np.ndarray:
    """The ids of a block; all its checkpoints are decoded side by side, one id of each at a time."""
    bits, symbol, used = table
    at = np.frombuffer(offsets, "<u8").astype(np.int64)
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(5, np.uint8)]).astype(np.uint32)
    word = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    out = np.zeros((len(at), step), np.uint32)
    last, mask, limit = n_ids - step * (len(at) - 1), (1 << bits) - 1, len(word) - 1
    for k in range(step):
        if k == last:  # only the last checkpoint's stretch can be shorter
            at = at[:-1]
        if not len(at):
            break
        seen = (word[np.minimum(at >> 3, limit)] >> (32 - bits - (at & 7)).astype(np.uint32)) & mask
        out[:len(at), k] = symbol[seen]
        at = at + used[seen]
    return out.reshape(-1)[:n_ids]


def _raw(path: str, end: int | None):
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        width = np.dtype(own.kind).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids = own.encode(part.column(2).to_pylist(), end)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), part.column(1),
                                                  pa.array([len(x) // width for x in ids], pa.int64()),
                                                  pa.array([pack.compress(x) for x in ids], pa.binary())], schema=schema)
    return run


def _blocks(kind: str, most: int):
    """For ``mapInArrow`` over rows sorted by bucket and doc_id: raw blocks of about ``most`` ids."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("ids", pa.binary())])
    width = np.dtype(kind).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        bucket, block, docs, sizes, ids = None, 0, [], [], []

        def out() -> pa.RecordBatch:
            return to_batch([(bucket, block, docs, sizes, sum(sizes), pack.compress(b"".join(ids)))], schema)
        for batch in batches:
            for b, d, n, x in zip(*(batch.column(k) for k in range(4))):
                if docs and (b.as_py() != bucket or sum(sizes) >= most):
                    yield out()
                    docs, sizes, ids, block = [], [], [], block + 1
                if b.as_py() != bucket:
                    bucket, block = b.as_py(), 0
                docs.append(d.as_py())
                sizes.append(n.as_py())
                ids.append(unpack.decompress(x.as_py(), max_output_size=max(1, n.as_py() * width)))
        if docs:
            yield out()
    return run


def _counted(kind: str, width: int):
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, seen = zstandard.ZstdDecompressor(), np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen += np.bincount(np.frombuffer(unpack.decompress(x.as_py()), kind), minlength=width)
        at = np.nonzero(seen)[0]
        yield to_batch(list(zip(at.tolist(), seen[at].tolist())), schema)
    return run


def _coded(kind: str, lengths: np.ndarray):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("offsets", pa.binary()),
                        ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, codes = zstandard.ZstdDecompressor(), canonical(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(unpack.decompress(batch.column(5)[i].as_py()), kind)
                offsets, payload = packed(ids, codes, lengths)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(5)),
                                                  pa.array([offsets], pa.binary()), pa.array([payload], pa.binary())],
                                                 schema=schema)
    return run


def in_buckets(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """``bucket, doc_id, text``: buckets follow ascending doc_id (null first) and hold about ``bucket_bytes`` of text.

    Bounds are quantiles of all ids, taken by a sketch. An id that is a bound more than once, as it holds many rows, is
    spread over the buckets between its bounds.
    """
    plain = texts_of(docs)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    size = plain.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = min(10_000, size // bucket_bytes + 1)
    cuts = [j / buckets for j in range(1, buckets)]
    bounds = plain.agg(F.percentile_approx(key, cuts, 100 * buckets).alias("b")).first()["b"] if cuts else []
    edges = F.array(*[F.lit(b) for b in bounds or []]).cast("array<long>")
    below = F.size(F.filter(edges, lambda b: b < key))
    upto = F.size(F.filter(edges, lambda b: b <= key))
    return plain.select((below + F.pmod(F.xxhash64("text"), upto - below + 1)).cast("int").alias("bucket"), "doc_id", "text")


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int | None = END_ID, longest: int = LONGEST,
              bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Encode every text, write code table and blocks below ``path``; returns the blocks read back.

    Null and empty texts have the end id only. Rows with the same id stay apart, in no fixed order among themselves; a
    null id comes first. An empty table writes an empty code table and no block. Ids are counted over all documents; the
    driver sees one count for each id of the vocabulary.
    """
    spark = docs.sparkSession
    own = encoder(tokenizer)
    kind, width = own.kind, max(own.size, (end or 0) + 1)
    raw = (in_buckets(docs, bucket_bytes).mapInArrow(_raw(tokenizer, end), "bucket int, doc_id long, n long, ids binary")
           .repartition("bucket").sortWithinPartitions("bucket", "doc_id"))
    blocks = stored(raw.mapInArrow(_blocks(kind, BLOCK_IDS), "bucket int, block int, doc_ids array<long>, sizes array<long>, "
                                                             "n_ids long, ids binary"), "raw-blocks")
    counts = np.zeros(width, np.int64)
    for r in (blocks.select("ids").mapInArrow(_counted(kind, width), "id int, n long").groupBy("id")
              .agg(F.sum("n").alias("n")).collect()):
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, longest)
    table = [(i, int(lengths[i])) for i in np.nonzero(lengths)[0].tolist()]
    spark.createDataFrame(table, "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    (blocks.mapInArrow(_coded(kind, lengths), BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks"))
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """From files that ``write_ids`` wrote: the documents of each block (ids: little-endian unsigned 32-bit integers,
    with ``digest`` their unsigned crc32 as ids_crc32 instead; before: ids ahead of them in the block), and how many ids
    come before each block."""
    code = spark.read.schema("id int, length int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r["id"] for r in code), default=0) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())])
    told = crc32 if digest else bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = unpacked(r["offsets"], r["payload"], r["n_ids"], table).astype("<u4")
                ends = np.cumsum(r["sizes"]).tolist()
                yield to_batch([(r["bucket"], r["block"], d, e - n, n, told(ids[e - n:e].data))
                                for d, n, e in zip(r["doc_ids"], r["sizes"], ends)], schema)
    found = blocks.mapInArrow(run, "bucket int, block int, doc_id long, before long, n_tokens long, "
                                   + ("ids_crc32 long" if digest else "ids binary"))
    in_bucket = Window.partitionBy("bucket").orderBy("block")
    sums = blocks.select("bucket", "block", "n_ids")
    # One row for each bucket, of which there are ten thousand at most.
    totals = (sums.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
              .select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("bucket_start")))
    starts = (sums.select("bucket", "block", (F.sum("n_ids").over(in_bucket) - F.col("n_ids")).alias("block_start"))
              .join(totals, "bucket"))
    return found, starts


def id_table(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in the files below ``path``."""
    found, starts = read_ids(spark, path)
    return (found.join(starts, ["bucket", "block"])
            .select("doc_id", (F.col("bucket_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids"))


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files; the ids are summed up where they are decoded."""
    found, starts = read_ids(spark, path, digest=True)
    return (found.join(starts, ["bucket", "block"])
            .select("doc_id", (F.col("bucket_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens",
                    "ids_crc32"))


def written_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "huffman")
    write_ids(docs, tokenizer, path)
    return id_digests(docs.sparkSession, path)
