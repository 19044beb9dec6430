"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

Features are densities and never raw words: hits of a lexicon learned from labels (words and word beginnings whose share
of toxic documents is far above their share of others), hits of a short general list, hits near a second-person word,
capitals, punctuation and obfuscated spellings. All is fitted on a bounded sample of the labelled rows, in parts: the
features a document trains with come from a lexicon learned without its part, so trees do not trust the lexicon more
than new documents allow, and the calibration is fitted on the margins all parts get from trees that have not seen them.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hourgrid.llm.common import fold, rows_mapped, smaller_batches, stored, texts_of, to_batch

TOXIC_SAMPLE = 6000  # labelled rows drawn of each class, at most about
CLEAN_SAMPLE = 12000
LEXICON = 2000
LEAST_FILES = 3
LEAST_ODDS = 2.0
BEGINNINGS = (4, 5, 6)
NEAR = 5
TREES, DEPTH, LEAST_ROWS = 20, 3, 10
THRESHOLD = 0.3
PARTS = 3
ROWS = 256
FEATURES, SCORE = "_tox_features", "_tox_score"
MEMO = 200_000

# General insults and second-person words of several languages.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool imbecile "
                    "vermin idiota estúpido basura imbécil idiote crétin connard dummkopf arschloch abschaum".split())
YOU = frozenset("you your yours yourself ya u tu te ti tus tú usted ustedes vos vous toi votre vos ton ta tes du dich dir "
                "dein deine ihr euch euer".split())
# Characters that stand in for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<!\w)\w*[^\W\d_][0134570@$!|*]+[^\W\d_]\w*")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-]){3,}[^\W\d_](?!\w)")
# Classes of characters below 65536; others count as other characters.
OTHER, LETTER, CAPITAL, DIGIT, SPACE, MARK = range(6)
LEET_MARKS = "@$!|*"
NAMES = ["weight", "hits", "heaviest", "hit_count", "insults", "hidden", "near_you", "you", "capitals", "upper_words",
         "marks", "mark_runs", "mixed", "length"]


def terms(word: str) -> list[str]:
    """A word as ``=word`` and its beginnings as they are."""
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) > k)]


class Lexicon:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.memo = Known(self)

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def of(self, word: str) -> float:
        """The largest weight among a word's terms, 0 if it has none."""
        return max((self.weights.get(t, 0.0) for t in terms(word)), default=0.0)


class Known(dict):
    """Word -> None for most words, else (weight, in the general list, second person)."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        found = (self.lexicon.of(word), word in INSULTS, word in YOU)
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = found if any(found) else None
        return found


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.full(1 << 16, OTHER, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isupper():
            table[code] = CAPITAL
        elif c.isalpha():
            table[code] = LETTER
        elif c.isdecimal():
            table[code] = DIGIT
        elif c.isspace():
            table[code] = SPACE
        elif c.isprintable() and not c.isalnum() and c != "_":
            table[code] = MARK
    return table


def shapes(text: str) -> tuple[list[float], bool, bool]:
    """Shares of capitals and marks; starts of runs of capitals and of marks; whether a disguised or a spelled-out word
    could be there at all."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[np.minimum(codes, 0xFFFF)]
    count = np.bincount(kind, minlength=6)
    letter, mark, capital = (kind == LETTER) | (kind == CAPITAL), kind == MARK, kind == CAPITAL
    n = max(1, len(codes))

    def starts(one: np.ndarray, before: np.ndarray) -> int:
        """Places where two of a kind follow, with none of ``before`` ahead of them."""
        two = one[:-1] & one[1:]
        return int(two[:1].sum() + (two[1:] & ~before[:-2]).sum())
    leet = kind == DIGIT
    for c in LEET_MARKS:
        leet |= codes == ord(c)
    disguised = bool((leet[1:-1] & letter[2:] & (letter[:-2] | leet[:-2])).any())
    apart = ~letter
    spelled = len(codes) > 4 and bool((letter[:-4] & apart[1:-3] & letter[2:-2] & apart[3:-1] & letter[4:]).any())
    return [count[CAPITAL] / n, count[MARK] / n, starts(capital, letter), starts(mark, mark)], disguised, spelled


def features(lexicon: Lexicon, text: str) -> list[float]:
    """The dense features of one whole text, in the order of ``NAMES``; an empty text has zeros."""
    low = text.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    known = [(i, k) for i, k in enumerate(map(lexicon.memo.__getitem__, words)) if k]
    weights = [k[0] for _, k in known if k[0]]
    yous = [i for i, k in known if k[2]]
    bad = [i for i, k in known if k[0] or k[1]]
    near, j = 0, 0
    for i in bad:
        while j < len(yous) and yous[j] < i - NEAR:
            j += 1
        near += j < len(yous) and yous[j] <= i + NEAR
    (capitals, marks, upper, runs), disguised, spelled = shapes(text)
    mixed = MIXED.findall(low) if disguised else []
    plain = [w for m in mixed for w in WORD.findall(m.translate(LEET).replace("*", ""))]
    plain += [re.sub(r"[ .\-]", "", m) for m in SPACED.findall(low)] if spelled else []
    hidden = sum(1 for w in plain if w in INSULTS or lexicon.of(w))
    return [sum(weights) / n, len(weights) / n, max(weights, default=0.0), math.log1p(len(weights)),
            sum(k[1] for _, k in known) / n, hidden / n, near / n, len(yous) / n, capitals, upper / n, marks, runs / n,
            len(mixed) / n, math.log1p(len(words))]


def _counted():
    schema = pa.schema([("term", pa.string()), ("part", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return to_batch([(t, part, n if label else 0, 0 if label else n) for (t, part, label), n in seen.items()], schema)
        for batch in batches:
            for text, label, part in zip(*(batch.column(k) for k in range(3))):
                label, part = label.as_py(), part.as_py()
                seen.update((t, part, label) for t in {t for w in set(WORD.findall(text.as_py().lower())) for t in terms(w)})
                if len(seen) > 300_000:
                    yield out()
                    seen = Counter()
        yield out()
    return run


def learned_lexicons(sample: DataFrame, most: int = LEXICON) -> list[Lexicon]:
    """A lexicon without each of the parts of ``sample`` (text, label, part), and one of all parts.

    A lexicon has the terms whose smoothed log odds of being in a toxic document exceed ``LEAST_ODDS``; the ``most`` with
    the highest odds times evidence are kept, and the driver receives no others.
    """
    sizes = {(r["part"], r["label"]): r["count"] for r in sample.groupBy("part", "label").count().collect()}
    counted = (sample.select("text", "label", "part").mapInArrow(_counted(), "term string, part long, toxic long, clean long")
               .groupBy("term").agg(*[F.sum(F.when(F.col("part") == p, F.col(c)).otherwise(0)).alias(f"{c}{p}")
                                      for p in range(PARTS) for c in ("toxic", "clean")]))
    often = stored(counted.where(sum(F.col(f"toxic{p}") for p in range(PARTS)) >= LEAST_FILES), "toxic-terms")
    found = []
    for left_out in [*range(PARTS), None]:
        parts = [p for p in range(PARTS) if p != left_out]
        t, c = (sum(F.col(f"{name}{p}") for p in parts) for name in ("toxic", "clean"))
        n_t, n_c = (sum(sizes.get((p, label), 0) for p in parts) for label in (1, 0))
        odds = F.log((t + 0.5) / (n_t + 1.0)) - F.log((c + 0.5) / (n_c + 1.0))
        kept = (often.select("term", odds.alias("odds"), t.alias("t")).where((F.col("odds") > LEAST_ODDS) & (F.col("t") >= LEAST_FILES))
                .orderBy((F.col("odds") * F.sqrt("t")).desc(), "term").limit(most).collect())
        found.append(Lexicon({r["term"]: float(r["odds"]) for r in kept}))
    return found


def labelled(docs: DataFrame, labels: DataFrame, parts: int, held: int, toxic: int, clean: int) -> DataFrame:
    """A bounded sample (doc_id, text, label, part) of the rows to learn from; part: which fit they serve.

    Rows are drawn by a hash of their id at a rate that gives about ``toxic`` and ``clean`` rows, so the drawn labels
    have a bounded size and are broadcast; the texts are never shuffled.
    """
    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), parts) != held))
             .dropDuplicates(["doc_id"]))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, toxic / max(1, sizes.get(1, 0))).otherwise(clean / max(1, sizes.get(0, 0)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    # About ``toxic + clean`` rows at most, whatever the size of the tables. Parts are dealt out in turn within a class.
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1
    drawn = known.where(draw < rate).withColumn("part", F.pmod(turn, F.lit(PARTS)).cast("long"))
    return texts_of(docs).join(F.broadcast(drawn), "doc_id")


def _measured(lexicon: Lexicon, at_text: int):
    """For ``mapInArrow``: the columns as they are and the features of the text in column ``at_text``, a null one as empty."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [features(lexicon, text.as_py() or "") for text in part.column(at_text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float64()))],
                                                 names=[*part.schema.names, FEATURES])
    return run


def _trees() -> GBTClassifier:
    trees = GBTClassifier(featuresCol="_tox_vector", labelCol="label", predictionCol="_tox_class", maxIter=TREES,
                          maxDepth=DEPTH, maxBins=64, stepSize=0.2, minInstancesPerNode=LEAST_ROWS, seed=1)
    return trees.setProbabilityCol("_tox_share").setRawPredictionCol("_tox_raw")


def with_scores(docs: DataFrame, labels: DataFrame, parts: int, held: int, toxic: int, clean: int) -> DataFrame:
    """``docs`` with its columns and the columns ``FEATURES`` and ``SCORE``; rows never leave their partition."""
    smaller_batches(docs.sparkSession)
    sample = stored(labelled(docs, labels, parts, held, toxic, clean), "toxicity-sample")
    seen = {r["label"]: r["parts"] for r in sample.groupBy("label").agg(F.count_distinct("part").alias("parts")).collect()}
    *without, lexicon = learned_lexicons(sample)
    names = docs.columns
    every = docs.withColumn("text", docs["text"].cast("string")).mapInArrow(
        _measured(lexicon, names.index("text")), StructType([*docs.schema.fields, StructField(FEATURES, ArrayType(DoubleType()))]))
    if not seen.get(0) or not seen.get(1):
        return every.withColumn(SCORE, F.lit(0.0))

    def measure(_, doc_id, text, label, part):
        return features(without[part], text), float(label), part
    schema = pa.schema([(FEATURES, pa.list_(pa.float64())), ("label", pa.float64()), ("part", pa.int64())])
    train = sample.mapInArrow(rows_mapped(schema, measure, ["doc_id", "text", "label", "part"]),
                              f"{FEATURES} array<double>, label double, part long")
    train = stored(train.coalesce(4), "toxicity-features").withColumn("_tox_vector", array_to_vector(FEATURES))
    margin = vector_to_array("_tox_share")[1].alias("_tox_margin")
    final = _trees().fit(train)
    if min(seen.values()) < 2:  # too few rows of a class to leave a part out
        margins = final.transform(train).select(margin, "label")
    else:
        margins = reduce(DataFrame.union, [_trees().fit(train.where(F.col("part") != p)).transform(
            train.where(F.col("part") == p)).select(margin, "label") for p in range(PARTS)])
    level = IsotonicRegression(featuresCol="_tox_margin", labelCol="label", predictionCol="_tox_level").fit(margins)
    guessed = final.transform(every.withColumn("_tox_vector", array_to_vector(FEATURES))).withColumn("_tox_margin", margin)
    # A hundredth of the margin keeps the order inside the steps of the calibration.
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("_tox_level") + 0.01 * F.col("_tox_margin")))
    return level.transform(guessed).select(*docs.columns, FEATURES, score.alias(SCORE))


def scored(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, toxic: int = TOXIC_SAMPLE,
           clean: int = CLEAN_SAMPLE) -> DataFrame:
    """``doc_id, score, features`` for each row of ``docs`` (doc_id, text); score is a calibrated probability.

    Learns from ``labels`` (doc_id, toxic 0/1) of rows whose ``crc32(doc_id) mod parts`` is not ``held``, on a sample of
    about ``toxic`` and ``clean`` rows. Null and empty texts are scored like a text without hits. Repeated rows and null
    ids stay. With no toxic or no clean row to learn from, every score is 0.
    """
    return (with_scores(texts_of(docs), labels, parts, held, toxic, clean)
            .select("doc_id", F.col(SCORE).alias("score"), F.col(FEATURES).alias("features")))


def judged(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``: predicted is 1 where the score reaches ``threshold``."""
    return scored(docs, labels, parts, held).select(
        "doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns; no text is shuffled."""
    judged_rows = with_scores(docs, labels, parts, held, TOXIC_SAMPLE, CLEAN_SAMPLE)
    return judged_rows.where(F.col(SCORE) < threshold).select(*docs.columns)
