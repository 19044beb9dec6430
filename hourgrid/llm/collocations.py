"""Phrase collocations: Misra-Gries summaries per hash partition name the n-grams that may be frequent, a second pass counts.

Passes over the texts: (1) words are counted exactly; (2) hashes of pairs of frequent words go to hash partitions, where
their counts are merged into Misra-Gries summaries; (3) the same for phrases of 3 to 5 words all of whose pairs survived;
(4) phrases whose hash survived are counted exactly, as words and not as hashes. What a task looks hashes up in is a
bitmap of bounded size: where it says yes wrongly, a phrase is counted in vain, and no frequent one is ever lost.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import Bitmap, stored, to_batch

THRESHOLD = 100
LONGEST = 5
TOP = 2000
CAPACITY = 1 << 18  # counters of a summary
CHUNK = 4 << 20  # bytes of text taken at once, cut between pieces
HELD = 1 << 22  # hashes a task holds before it hands its counts on
PHRASES = 1 << 20  # phrases a task holds
VOCABULARY = 1 << 21  # words a task knows before it starts anew
ROW = 1024  # hashes in one row of a summary
EDGE = b"\xff"  # a byte no text holds; between pieces
# Bytes to bytes: A-Z to a-z, what separates pieces to EDGE, the tab to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * B
    return h ^ (h >> np.uint64(29))


class Vocabulary(dict):
    """Word to id in the order met; ``hashes[id]`` is the word's hash. Id 0 stands between pieces."""

    def __init__(self):
        super().__init__({EDGE: 0})
        self.words, self._hashes = [EDGE], np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        if found == len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.zeros_like(self._hashes)])
        self._hashes[found] = xxhash.xxh64_intdigest(word)
        return found

    def ids(self, data: bytes) -> np.ndarray:
        words = data.replace(EDGE, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashed(self, ids: np.ndarray, lang: str) -> np.ndarray:
        return mixed(self._hashes[ids] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of a batch by language, folded, cut between pieces into parts of about CHUNK bytes."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = text.as_py().translate(TABLE)
        at = 0
        while at < len(data):
            cut = len(data) if len(data) - at <= CHUNK else data.find(EDGE, at + CHUNK) + 1 or len(data)
            held.setdefault(lang, []).append(data[at:cut])
            size[lang] = size.get(lang, 0) + cut - at
            at = cut
            if size[lang] >= CHUNK:
                yield lang, EDGE.join(held.pop(lang))
                size[lang] = 0
    for lang, parts in held.items():
        yield lang, EDGE.join(parts)


def phrase_hashes(h: np.ndarray, ids: np.ndarray, longest: int, maps: dict[int, Bitmap]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 1: the starts of phrases that may be frequent, as a mask, and the hashes at all starts.

    A start passes if its phrase lies inside a piece and the map of each length, where there is one, has all parts of it.
    """
    ok, key = ids > 0, h
    for n in range(1, longest + 1):
        if n > 1:
            if len(key) < 2:
                return
            key = mixed(key[:-1] * A + h[n - 1:])
            ok = ok[:-1] & ok[1:]
        if n in maps:
            ok = ok.copy()
            at = np.nonzero(ok)[0]
            ok[at[~maps[n].has(key[at])]] = False
        yield n, ok, key


def _grown(total: np.ndarray | None, ids: np.ndarray, size: int) -> np.ndarray:
    new = np.bincount(ids, minlength=size)
    if total is not None:
        new[:len(total)] += total
    return new


WORDS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
WORDS_SQL = "lang string, phrase string, f long"


def _counted_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, totals = Vocabulary(), {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            at = np.nonzero(total)[0]
            at = at[at > 0]
            for k in range(0, len(at), 1 << 16):
                part = at[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([known.words[i] for i in part], pa.string()),
                     pa.array(total[part], pa.int64())], schema=WORDS)
    for batch in batches:
        for lang, data in chunks(batch):
            ids = known.ids(data)
            totals[lang] = _grown(totals.get(lang), ids, len(known.words))
            if len(known.words) > VOCABULARY:
                yield from out()
                known, totals = Vocabulary(), {}
    yield from out()


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(count, start) if len(start) else count


class MisraGries:
    """Counters of one hash partition. A counter is short of the true count by ``error`` at most.

    Summaries are merged by adding counters; beyond ``capacity`` all are lowered by the largest that has to go. The mass
    of a partition is chosen below capacity times threshold, so ``error`` stays under the threshold; should a step take it
    there all the same, the counters are kept instead.
    """

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.error = capacity, threshold, 0
        self.key, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.key, self.count = summed([self.key, *keys], [self.count, *counts])
        if len(self.key) > self.capacity:
            lower = int(np.partition(self.count, len(self.count) - self.capacity - 1)[len(self.count) - self.capacity - 1])
            if self.error + lower < self.threshold:
                left = self.count > lower
                self.key, self.count, self.error = self.key[left], self.count[left] - lower, self.error + lower

    def frequent(self) -> np.ndarray:
        return self.key[self.count + self.error >= self.threshold]


HASHES = pa.schema([("n", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
HASHES_SQL = "n int, part long, keys binary, counts binary"


def _hashed_phrases(lengths: tuple[int, ...], maps, part_bits: int):
    """Counts of phrase hashes by hash partition, complete for what a task held at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, use = Vocabulary(), maps.value
        held: dict[int, list] = {n: [] for n in lengths}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for n in lengths:
                if not held[n]:
                    continue
                key, count = summed(*map(list, zip(*held[n])))
                part = key >> np.uint64(64 - part_bits) if part_bits else np.zeros(len(key), np.uint64)
                cuts = np.unique(np.concatenate([np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0],
                                                 np.arange(0, len(key), ROW)]))
                rows = [(n, int(part[a]), key[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes())
                        for a, b in zip(cuts, [*cuts[1:], len(key)])]
                for k in range(0, len(rows), 500):
                    yield to_batch(rows[k:k + 500], HASHES)
        for batch in batches:
            for lang, data in chunks(batch):
                ids = known.ids(data)
                for n, ok, key in phrase_hashes(known.hashed(ids, lang), ids, max(lengths), use):
                    if n in held and ok.any():
                        held[n].append(np.unique(key[ok], return_counts=True))
                        size += len(held[n][-1][0])
                if size > HELD:
                    held = {n: [summed(*map(list, zip(*p)))] if p else [] for n, p in held.items()}
                    size = sum(len(p[0][0]) for p in held.values() if p)
                    if size > HELD // 2:
                        yield from out()
                        held, size = {n: [] for n in lengths}, 0
                if len(known.words) > VOCABULARY:
                    known = Vocabulary()
        yield from out()
    return run


def _merged(capacity: int, threshold: int):
    """Misra-Gries summaries of rows that come sorted by (n, part); gives the hashes that may be frequent."""
    schema = pa.schema([("n", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, summary, keys, counts, waiting = None, None, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                summary.merge(keys, counts)
                found = summary.frequent().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(found), pa.int32()), pa.array(found)], schema=schema)
        for batch in batches:
            for n, part, k, c in zip(*(batch.column(i) for i in range(4))):
                here = n.as_py(), part.as_py()
                if here != at:
                    yield from out()
                    at, summary, keys, counts, waiting = here, MisraGries(capacity, threshold), [], [], 0
                keys.append(np.frombuffer(k.as_buffer(), np.uint64))
                counts.append(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
                waiting += len(keys[-1])
                if waiting > capacity:
                    summary.merge(keys, counts)
                    keys, counts, waiting = [], [], 0
        yield from out()
    return run


def _counted_phrases(longest: int, maps):
    """Exact counts of the phrases whose hash is in the map of their length."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, use, totals = Vocabulary(), maps.value, {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, of in totals.items():
                words, numbers = list(of), list(of.values())
                for k in range(0, len(words), 1 << 15):
                    part = words[k:k + (1 << 15)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                         pa.array(numbers[k:k + (1 << 15)], pa.int64())], schema=WORDS)
        for batch in batches:
            for lang, data in chunks(batch):
                ids = known.ids(data)
                of, base = totals.setdefault(lang, {}), np.int64(len(known.words))
                for n, ok, _ in phrase_hashes(known.hashed(ids, lang), ids, longest, use):
                    start = np.nonzero(ok)[0] if n > 1 else ()
                    if not len(start):
                        continue
                    group = ids[start]
                    for step in range(1, n):  # words are added one by one, so equal numbers mean equal words
                        _, first, group, times = np.unique(group * base + ids[start + step], return_index=True,
                                                           return_inverse=True, return_counts=True)
                    for i, f in zip(start[first].tolist(), times.tolist()):
                        phrase = b" ".join([known.words[j] for j in ids[i:i + n]])
                        of[phrase] = of.get(phrase, 0) + f
                if sum(map(len, totals.values())) > PHRASES:
                    yield from out()
                    totals = {}
                if len(known.words) > VOCABULARY:
                    known = Vocabulary()
        yield from out()
    return run


def _word_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = Vocabulary()
        keys = [known.hashed(np.array([known[word.as_py().encode()]]), lang.as_py()).view(np.int64)[0]
                for lang, word in zip(batch.column(0), batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])


def may_be_frequent(texts: DataFrame, lengths: tuple[int, ...], maps: dict[int, Bitmap], mass: int,
                    threshold: int, capacity: int) -> DataFrame:
    """``n, key``: hashes of all phrases of these lengths that occur ``threshold`` times, and of few others; stored."""
    context = texts.sparkSession.sparkContext
    part_bits = max(0, (2 * mass // (threshold * capacity))).bit_length()
    rows = texts.mapInArrow(_hashed_phrases(lengths, context.broadcast(maps), part_bits), HASHES_SQL)
    dealt = rows.repartition(len(lengths) << part_bits, "n", "part").sortWithinPartitions("n", "part")
    return stored(dealt.mapInArrow(_merged(capacity, threshold), "n int, key long"), "frequent")


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST,
                  capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """Exact counts of what occurs ``threshold`` times in its language, (lang, phrase, f) of one to ``longest`` words, and
    the number of all word occurrences, (lang, n). Text null is empty, lang null is ``und``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))
    # The words of each task, with their counts, go through the shuffle once for both results.
    words = stored(texts.mapInArrow(_counted_words, WORDS_SQL).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    mass = words.agg(F.sum("f")).first()[0] or 0
    often = words.where(F.col("f") >= threshold)
    maps = {1: Bitmap(often.mapInArrow(_word_keys, "key long"))}
    found = may_be_frequent(texts, (2,), maps, mass, threshold, capacity)
    maps[2] = Bitmap(found.select("key"))
    longer = tuple(range(3, longest + 1))
    if longer:
        found = may_be_frequent(texts, longer, maps, mass, threshold, capacity)
        maps |= {n: Bitmap(found.where(F.col("n") == n).select("key")) for n in longer}
    phrases = (texts.mapInArrow(_counted_phrases(longest, spark.sparkContext.broadcast(maps)), WORDS_SQL)
               .groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold))
    return stored(often.union(phrases), "phrases"), total


def _joined(first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP,
                 capacity: int = CAPACITY) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of 2 to ``longest`` words inside a piece that occurs ``threshold`` times or more is scored by its weakest
    cut, ``floor(1000 a n / (l r))``, equal scores by the earliest; it goes if a longer candidate around it occurs as
    often. Rank by score, then a, then the phrase's bytes. A null text is empty, a null lang is ``und``; repeated rows
    count as often as they stand there; blank texts and empty tables give nothing.
    """
    counted, total = phrase_counts(docs, threshold, longest, capacity)
    counted = counted.withColumn("words", F.split("phrase", " "))
    candidates = counted.where(F.size("words") > 1).withColumnRenamed("f", "a")
    size = F.size("words")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.lit(1), F.col("k")).alias("head"),
                       _joined(F.col("k") + 1, size - F.col("k")).alias("tail"))
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(18,0)) div "
                   "(cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    cut = (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
           .withColumn("score", score).groupBy("lang", "phrase", "a", "n")
           .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # Every part of at least two words of a longer candidate, with the largest count around it.
    inside = (candidates.where(size > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("length"))
              .select("lang", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
              .select("lang", "a", _joined(F.col("at"), F.col("length")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    kept = cut.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") < F.col("a")))
    told = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


# The same in SQL, over all n-grams.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, list_slice(words, pos, pos + size - 1) AS words
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM worded, (SELECT unnest(range(1, 6)) AS size))),
counted AS (SELECT lang, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS f
            FROM grams GROUP BY 1, 2 HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY 1),
candidates AS (SELECT * FROM counted WHERE len(words) > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, h.f AS l, t.f AS r, n,
         (1000::HUGEINT * c.f * n // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM candidates) c
  JOIN counted h ON h.lang = c.lang AND h.phrase = array_to_string(list_slice(c.words, 1, k), ' ')
  JOIN counted t ON t.lang = c.lang AND t.phrase = array_to_string(list_slice(c.words, k + 1, len(c.words)), ' ')
  JOIN total ON total.lang = c.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS phrase, max(f) AS around
  FROM (SELECT lang, words, f, size, unnest(range(1, len(words) - size + 2)) AS pos
        FROM candidates, (SELECT unnest(range(2, 5)) AS size) WHERE size < len(words)) GROUP BY 1, 2)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, score
FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
WHERE i.around IS NULL OR 100 * i.around < 100 * a
QUALIFY rank <= 2000
"""
