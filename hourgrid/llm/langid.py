"""Language identification by nearest centroid: cosine of TF-IDF byte n-grams to several clustered centroids a language."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import fold, texts_of, to_batch

DIMS = 4096
CLUSTERS = 4
SAMPLE = 1500  # labelled rows of each language the centroids are fitted on, at most about
ROUNDS = 8
REJECT_QUANTILE = 0.995
CHUNK = 1 << 20
ROWS = 256
# Bytes that are not letters count as spaces; bytes above 127 are parts of characters and are kept.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
MIX = np.uint32(2654435761)


def counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Hashed counts of byte bigrams and trigrams of the whole lower-cased text, with a space at either end."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" "
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    total = np.zeros(dims, np.float32)
    for at in range(0, len(data), CHUNK):
        b = np.frombuffer(data[at:at + CHUNK + 2], np.uint8).astype(np.uint32)
        pair = b[:-1] | (b[1:] << np.uint32(8))
        triple = pair[:-1] | (b[2:] << np.uint32(16))
        pairs = pair[:min(len(pair), CHUNK)]
        for grams, salt in ((pairs | np.uint32(1 << 24), 0), (triple[:CHUNK], 1)):
            total += np.bincount((grams * MIX) >> shift, minlength=dims)[:dims]
    return total


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log counts times idf, scaled to length 1 (a row of zeros stays so)."""
    v = np.log1p(tf) * idf
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return (v / np.where(length > 0, length, 1)).astype(np.float32)


def _frequencies(dims: int):
    schema = pa.schema([("dim", pa.int32()), ("files", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(dims + 1, np.int64)  # the last cell counts the rows
        for batch in batches:
            for text in batch.column(0):
                seen[:dims] += counts(text.as_py(), dims) > 0
                seen[dims] += 1
        at = np.nonzero(seen)[0]
        yield to_batch(list(zip(at.tolist(), seen[at].tolist())), schema)
    return run


def clustered(vectors: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, seeded with the row nearest the mean and then the row farthest from all seeds."""
    mean = vectors.mean(axis=0)
    seeds = [int(np.argmax(vectors @ mean))]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin((vectors @ vectors[seeds].T).max(axis=1))))
    centers = vectors[seeds]
    for _ in range(rounds):
        of = np.argmax(vectors @ centers.T, axis=1)
        sums = np.stack([vectors[of == j].sum(axis=0) if (of == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32), np.argmax(vectors @ centers.T, axis=1)


class Centroids:
    def __init__(self, langs: list[str], centers: np.ndarray, radius: np.ndarray, idf: np.ndarray):
        self.langs, self.centers, self.radius, self.idf = langs, centers, radius, idf


def fitted(train: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Centroids | None:
    """Centroids from ``train`` (text, lang; neither null). None if it is empty.

    Document frequencies are counted over all its rows. The centroids and radii are fitted on about ``sample`` rows of
    each language, chosen by a hash of the text, with one group per language; the driver receives the centroids only.
    """
    seen = {r["dim"]: r["files"] for r in train.select("text").mapInArrow(_frequencies(dims), "dim int, files long")
            .groupBy("dim").agg(F.sum("files").alias("files")).collect()}
    n = seen.get(dims, 0)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array([seen.get(j, 0) for j in range(dims)]))).astype(np.float32) + 1
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, sample / size))])
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = train.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        v = unit(np.stack([counts(t, dims) for t in rows["text"]]), idf)
        centers, of = clustered(v, clusters, ROUNDS)
        apart = 1 - (v * centers[of]).sum(axis=1)
        radius = [float(np.quantile(apart[of == j], REJECT_QUANTILE)) if (of == j).any() else 0.0
                  for j in range(len(centers))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "cluster": range(len(centers)), "radius": radius,
                             "center": [c.tolist() for c in centers]})
    rows = (picked.groupBy("lang").applyInPandas(fit, "lang string, cluster int, radius double, center array<float>")
            .orderBy("lang", "cluster").collect())
    if not rows:
        return None
    return Centroids([r["lang"] for r in rows], np.array([r["center"] for r in rows], np.float32),
                     np.array([r["radius"] for r in rows]), idf)


def _predicted(model: Centroids | None, dims: int):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("distance", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t.as_py() for t in part.column(1)]
                lettered = [any(map(str.isalpha, t)) for t in texts]
                rows = [(i.as_py(), "und", 0.0, None, True) for i in part.column(0)]
                if model is not None and any(lettered):
                    at_rows = [k for k, ok in enumerate(lettered) if ok]
                    cosine = unit(np.stack([counts(texts[k], dims) for k in at_rows]), model.idf) @ model.centers.T
                    best = cosine.argmax(axis=1)
                    for j, k in enumerate(at_rows):
                        c = min(1.0, max(0.0, float(cosine[j, best[j]])))
                        rows[k] = (rows[k][0], model.langs[best[j]], c, 1 - c, bool(1 - c > model.radius[best[j]]))
                yield to_batch(rows, schema)
    return run


def identified(docs: DataFrame, parts: int = 3, held: int = 1, dims: int = DIMS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, distance, rejected`` for each row of ``docs`` (doc_id, text, lang).

    Learns from rows whose ``crc32(doc_id) mod parts`` is not ``held`` and whose text and lang are not null. lang_pred
    is ``und`` where the text is null, empty or has no letter, or nothing could be learned; score is the cosine to the
    nearest centroid, distance 1 - score, and rejected says that the distance is beyond what nearly all learned rows of
    that cluster keep to (true for ``und``). Ties go to the language first in order. Repeated rows and null ids stay.
    """
    train = docs.where(docs["text"].isNotNull() & docs["lang"].isNotNull() & (fold(docs["doc_id"], parts) != held))
    model = fitted(train.select(docs["doc_id"], docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")), dims)
    found = texts_of(docs).mapInArrow(_predicted(model, dims), "doc_id long, lang_pred string, score double, "
                                                               "distance double, rejected boolean")
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "lang_pred", "score",
                        "distance", "rejected")
