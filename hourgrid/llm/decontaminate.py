"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages. A passage is a TF-IDF vector over the telling terms of the
benchmark: those found in few passages of the corpus. A randomised SVD of the matrix of all corpus and benchmark
passages gives a latent space; passages whose cosine to a benchmark passage is high there are candidates, and so are
those that have much of a benchmark passage's telling weight, whatever else is in them. A candidate
counts if the longest common subsequence of words covers enough of the benchmark passage; between that and a lower
bound it counts if the passage's answer, its last telling terms, is there too, as in a paraphrase.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import stored, text_hash, texts_of, to_batch

PASSAGE = 64  # words
STRIDE = 32
RARE = 1 / 200  # a telling term is in at most this share of passages
LEAST_TERMS = 4  # a benchmark passage keeps so many of its rarest terms, whatever their share
RANK = 64
SKETCH = 80
COSINE = 0.4
HELD = 1 / 2
SURE, MAYBE = 0.6, 0.45
ANSWER = 3
ITEMS = 2000
ROWS = 64
PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters above 127."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit by bit (Hyyrö)."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Benchmark:
    """A block of benchmark items as passages (item_id, words)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.parts: list[tuple[int, list[bytes]]] = []
        for item, text in items:
            words = words_of(text)
            for at in range(0, len(words), PASSAGE):
                part = words[at:at + PASSAGE]
                if at and len(part) < PASSAGE // 2:  # a short rest joins the passage before
                    self.parts[-1][1].extend(part)
                else:
                    self.parts.append((item, part))
        self.number = {w: i for i, w in enumerate(sorted({w for _, p in self.parts for w in p}))}

    def telling(self, files: np.ndarray, passages: int) -> "Space":
        return Space(self, files, passages)


class Space:
    """Telling terms with their idf; after ``fit`` the latent vectors of the benchmark's passages."""

    def __init__(self, benchmark: Benchmark, files: np.ndarray, passages: int):
        keep = set(np.nonzero(files <= RARE * passages)[0].tolist())
        for _, part in benchmark.parts:
            own = sorted({benchmark.number[w] for w in part}, key=lambda t: (files[t], t))
            if sum(t in keep for t in own) < LEAST_TERMS:
                keep.update(own[:LEAST_TERMS])
        terms = sorted(keep)
        names = {i: w for w, i in benchmark.number.items()}
        self.parts = benchmark.parts
        self.dim = {names[t]: d for d, t in enumerate(terms)}
        self.idf = np.log((passages + 1) / (files[terms] + 0.5)).astype(np.float32) if terms else np.zeros(0, np.float32)
        self.basis = None

    def vectors(self, dims: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Unit TF-IDF rows of ``n`` passages from (term, passage) occurrences."""
        width = len(self.idf)
        a = np.bincount(at * width + dims, minlength=n * width).reshape(n, width).astype(np.float32) * self.idf
        length = np.linalg.norm(a, axis=1, keepdims=True)
        return a / np.where(length > 0, length, 1)

    def of_parts(self) -> np.ndarray:
        found = [(self.dim[w], k) for k, (_, p) in enumerate(self.parts) for w in p if w in self.dim]
        dims, at = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return self.vectors(dims, at, len(self.parts))

    def noise(self, sketch: int) -> np.ndarray:
        return np.random.default_rng(0).standard_normal((len(self.idf), min(sketch, max(1, len(self.idf))))).astype(np.float32)

    def fit(self, sketch: np.ndarray, rank: int) -> None:
        """``sketch``: (A'A) times the noise, for all corpus passages A."""
        own = self.of_parts()
        u, s, _ = np.linalg.svd(sketch + own.T @ (own @ self.noise(sketch.shape[1])), full_matrices=False)
        self.basis = np.ascontiguousarray(u[:, :rank][:, s[:rank] > 0]).astype(np.float32)
        latent = own @ self.basis
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        # A passage the latent space holds next to nothing of is compared in the space of terms.
        self.direct = np.nonzero((length[:, 0] < 0.3) & (np.linalg.norm(own, axis=1) > 0))[0]
        self.spanned = np.nonzero(length[:, 0] >= 0.3)[0]
        self.latent = (latent / np.maximum(length, 1e-9))[self.spanned]
        self.answers = []
        for _, part in self.parts:
            seen = list(dict.fromkeys(w for w in reversed(part) if w in self.dim))
            self.answers.append(set(seen[:ANSWER]))
        # For each term the passages that have it, with its place in their vectors and its share of their telling weight,
        # each term counted once.
        rows = [(self.dim[w], k) for k, (_, p) in enumerate(self.parts) for w in set(p) if w in self.dim]
        term, part = (np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 2
        weight = self.idf[term].astype(np.float64) ** 2
        whole = np.bincount(part, weight, minlength=len(self.parts))
        self.holders, self.parts_weight = part, weight / np.maximum(whole[part], 1e-12)
        self.parts_own = own[part, term].astype(np.float64) * np.isin(part, self.direct)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.idf)))])
        # Two windows hold all of a passage of PASSAGE words, three all of a longer one: one of them has this much.
        self.enough = np.array([HELD if len(p) <= PASSAGE else HELD * 2 / 3 for _, p in self.parts]) - 1e-6

    def compared(self, dims: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For ``n`` windows and all benchmark passages: the cosine, over the terms for those the latent space does not
        hold, and the share of a passage's telling weight that a window has."""
        width, parts = len(self.idf), len(self.parts)
        both = np.sort(at * width + dims)
        first = np.nonzero(np.concatenate([[True], both[1:] != both[:-1]]))[0]
        window, term = both[first] // width, both[first] % width
        value = np.diff(first, append=len(both)) * self.idf[term].astype(np.float64)
        length = np.sqrt(np.bincount(window, value * value, minlength=n))
        value /= np.where(length > 0, length, 1)[window]
        many = self.first[term + 1] - self.first[term]
        place = np.repeat(self.first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cells = np.repeat(window, many) * parts + self.holders[place]
        cosine = np.bincount(cells, np.repeat(value, many) * self.parts_own[place], minlength=n * parts).reshape(n, parts)
        held = np.bincount(cells, self.parts_weight[place], minlength=n * parts).reshape(n, parts)
        if len(self.spanned):
            weight = self.idf[dims]
            latent = _row_sums(weight[:, None] * self.basis[dims], at, n)
            norm = np.linalg.norm(latent, axis=1, keepdims=True)
            cosine[:, self.spanned] = latent / np.maximum(norm, 1e-9) @ self.latent.T
        return cosine, held


def hits(words: list[bytes], dim: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and terms of the words that are telling."""
    terms = np.fromiter(map(dim.get, words, repeat(-1)), np.int64, len(words))
    at = np.nonzero(terms >= 0)[0]
    return at, terms[at]


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _counted(number: dict[bytes, int]):
    """Passages (without overlap) that hold each word of the benchmark; the row -1 counts all passages."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, passages = np.zeros(len(number), np.int64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                found = []
                for text in batch.column(0).slice(lo, ROWS):
                    words = words_of(text.as_py())
                    at, terms = hits(words, number)
                    found.append((passages + at // PASSAGE) * len(number) + terms)
                    passages += -(-len(words) // PASSAGE)
                both = _distinct(np.concatenate(found))
                seen += np.bincount(both % max(1, len(number)), minlength=len(number))
        at = np.nonzero(seen)[0]
        yield to_batch([(-1, passages), *zip(at.tolist(), seen[at].tolist())], schema)
    return run


def _row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that go to the same one of ``n`` rows."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.concatenate([[0], np.nonzero(np.diff(rows))[0] + 1])
    out = np.zeros((n, values.shape[1]), values.dtype)
    out[rows[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _stacked(texts: Iterable[str], dim: dict[bytes, int], stride: int) -> Iterator[tuple]:
    """For some documents at a time: (term, window) occurrences, number of windows, and where each window is."""
    dims, at, where, n = [], [], [], 0
    for k, text in enumerate(texts):
        words = words_of(text)
        pos, terms = hits(words, dim)
        if not len(pos):
            continue
        windows = max(1, -(-(len(words) - PASSAGE) // stride) + 1)
        overlaps = PASSAGE // stride
        w = np.concatenate([pos // stride - back for back in range(overlaps)])
        ok = (w >= 0) & (w < windows)
        w = w[ok]
        there = np.bincount(w, minlength=windows) > 0
        used = np.nonzero(there)[0]
        dims.append(np.concatenate([terms] * overlaps)[ok])
        at.append((n - 1 + np.cumsum(there))[w])
        where += [(k, x * stride, words) for x in used.tolist()]
        n += len(used)
        if n >= 1024:
            yield np.concatenate(dims), np.concatenate(at), n, where
            dims, at, where, n = [], [], [], 0
    if n:
        yield np.concatenate(dims), np.concatenate(at), n, where


def _sketched(space: Space, sketch: int):
    """Each task's share of A'A times the noise, a row for each term it has met."""
    schema = pa.schema([("task", pa.int32()), ("term", pa.int32()), ("row", pa.list_(pa.float32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        noise = space.noise(sketch)
        total = np.zeros(noise.shape, np.float64)
        for batch in batches:
            for dims, at, n, _ in _stacked((t.as_py() for t in batch.column(0)), space.dim, PASSAGE):
                weight = space.idf[dims]
                length = np.sqrt(np.bincount(at, weight * weight, minlength=n))  # repeats are rare; they only scale a row
                weight = weight / length[at]
                image = _row_sums(weight[:, None] * noise[dims], at, n)
                total += _row_sums(weight[:, None] * image[at], dims, len(total))
        task = TaskContext.get().partitionId()
        for lo in range(0, len(total), 1024):
            rows = np.nonzero(total[lo:lo + 1024].any(axis=1))[0] + lo
            if len(rows):
                yield to_batch([(task % 64, int(r), total[r].astype(np.float32)) for r in rows], schema)
    return run


def _summed(width: int):
    schema = pa.schema([("task", pa.int32()), ("term", pa.int32()), ("row", pa.list_(pa.float32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, total, task = None, np.zeros(width), 0
        out = []
        for batch in batches:
            for t, k, row in zip(*(batch.column(i) for i in range(3))):
                if k.as_py() != term or t.as_py() != task:
                    if term is not None:
                        out.append((task, term, total.astype(np.float32)))
                    task, term, total = t.as_py(), k.as_py(), np.zeros(width)
                total += row.values.to_numpy(zero_copy_only=False)
            if len(out) > 1000:
                yield to_batch(out, schema)
                out = []
        if term is not None:
            out.append((task, term, total.astype(np.float32)))
        yield to_batch(out, schema)
    return run


def verified(space: Space, k: int, region: list[bytes]) -> float:
    """The share of benchmark passage ``k`` that a region holds in order; 0 if too little of it."""
    part = space.parts[k][1]
    share = common_subsequence(part, region) / len(part)
    if share >= SURE or share >= MAYBE and space.answers[k] and space.answers[k] <= set(region):
        return share
    return 0.0


def _matched(space: Space):
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()),
                        ("cosine", pa.float64()), ("first_word", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids, of = part.column(0), part.column(2)
                best: dict[tuple[int, int], tuple] = {}
                for dims, at, n, where in _stacked((t.as_py() for t in part.column(1)), space.dim, STRIDE):
                    cosine, held = space.compared(dims, at, n)
                    candidate = (cosine >= COSINE) | (held >= space.enough)
                    for w, k in zip(*(x.tolist() for x in np.nonzero(candidate))):
                        doc, start, words = where[w]
                        item, own = space.parts[k]
                        lo_word = max(0, start - len(own))
                        region = words[lo_word:start + PASSAGE + len(own)]
                        if not _shared(space.answers[k], own, region, space.dim):
                            continue
                        share = verified(space, k, region)
                        if share and share > best.get((doc, item), (0.0,))[0]:
                            best[doc, item] = (share, float(cosine[w, k]), lo_word)
                if best:
                    yield to_batch([(ids[d].as_py(), of[d].as_py(), i, *v) for (d, i), v in best.items()], schema)
    return run


def _shared(answer: set, own: list[bytes], region: list[bytes], dim: dict[bytes, int]) -> bool:
    """Whether enough words are shared at all for the subsequence to be long enough: a bound that costs less."""
    there = set(region)
    return sum(w in there for w in own) >= MAYBE * len(own)


def leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """``doc_id, item_id, share, cosine, first_word``: a row for each document (row of ``docs``) and benchmark item found
    in it; share is the part of the best benchmark passage that the document holds in order, first_word where the
    compared region begins.

    Null, empty and word-less texts hold nothing; items without a word are in no document. Rows repeated in ``docs``
    are reported each, repeated items once. An empty table on either side gives no rows. Term frequencies and the SVD
    cover all passages of all documents. The benchmark is taken in blocks of ``items`` items, so what is sent to the
    tasks has a bounded size; each block passes over the documents three times, without shuffling texts.
    """
    return _leaking(docs, benchmark, items).drop("of")


def _leaking(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows of ``leaks`` with the hash of the document's text as ``of``."""
    spark = docs.sparkSession
    texts = texts_of(docs)
    out = "doc_id long, of long, item_id long, share double, cosine double, first_word long"
    known = (benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("t"))
             .where("item_id is not null and t is not null").distinct())
    numbers = known.groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    blocks = max(1, -(-numbers // items))
    found = spark.createDataFrame([], out)
    for b in range(blocks):
        block = Benchmark([(r["item_id"], r["t"]) for r in known.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
                           .orderBy("item_id", "t").collect()])
        if not block.number:
            continue
        seen = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(_counted(block.number), "term int, n long")
                .groupBy("term").agg(F.sum("n").alias("n")).collect()}
        files = np.array([seen.get(i, 0) for i in range(len(block.number))], np.int64)
        space = block.telling(files, max(1, seen.get(-1, 0)))
        width = space.noise(SKETCH).shape[1]
        parts = "task int, term int, row array<float>"
        shares = texts.select("text").mapInArrow(_sketched(space, SKETCH), parts)
        summed = shares.repartition("task", "term").sortWithinPartitions("task", "term").mapInArrow(_summed(width), parts)
        total = summed.withColumn("task", F.lit(0)).repartition("term").sortWithinPartitions("term").mapInArrow(_summed(width), parts)
        sketch = np.zeros((len(space.idf), width), np.float32)
        for r in total.collect():  # a row for each telling term of the block
            sketch[r["term"]] += np.array(r["row"], np.float32)
        space.fit(sketch, RANK)
        found = found.union(texts.withColumn("of", F.xxhash64("text")).mapInArrow(_matched(space), out))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows that share a doc_id are judged each by its own text."""
    bad = stored(_leaking(docs, benchmark).select(F.col("doc_id").alias("_leaked"), F.col("of").alias("_of")).distinct(),
                 "leaked-documents")
    own = docs["doc_id"].cast("long").eqNullSafe(bad["_leaked"]) & (text_hash(docs) == bad["_of"])
    return docs.join(bad, own, "left_anti")
