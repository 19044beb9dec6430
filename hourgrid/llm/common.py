"""What the operators share: written tables in the cluster's shared folder, and record batches row by row."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 28  # a bitmap takes 32 MB at most


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``; a folder of our own only where none is set in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hourgrid-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def smaller_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Rows go to Python functions in batches of at most ``size`` bytes, so rows of long texts take little memory at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(str(spark.conf.get(key)).rstrip("b"))
    if held <= 0 or held > size:
        spark.conf.set(key, f"{size}b")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, and safe when executors are lost."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as a string, a null text becoming an empty one. Other columns are not read."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def text_hash(docs: DataFrame):
    """The hash of a row's text as ``texts_of`` gives it: with doc_id it names a row, also where rows share an id."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def fold(column, parts: int):
    """The remainder of crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def rows_mapped(schema: pa.Schema, per_row: Callable[..., tuple], names: list[str],
                setup: Callable[[], object] | None = None, out_rows: int = 2000, out_bytes: int = 16 << 20):
    """A function for ``mapInArrow`` that calls ``per_row(state, *values)`` and puts its tuples into bounded batches.

    ``setup`` runs once in each task. Batches go out when they hold ``out_rows`` rows or about ``out_bytes`` bytes of
    binary or text values, so memory does not depend on the number of rows in a task.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for i in range(batch.num_rows):
                row = per_row(state, *(c[i].as_py() for c in columns))
                held.append(row)
                size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
                if len(held) >= out_rows or size >= out_bytes:
                    yield to_batch(held, schema)
                    held, size = [], 0
        if held:
            yield to_batch(held, schema)
    return run


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)],
                                      schema=schema)


class Bitmap:
    """One bit for each hash value modulo the number of bits; the number of bits follows the number of hashes."""

    def __init__(self, keys: DataFrame):
        """``keys``: (key long). The driver receives 64-bit words of the map, never keys."""
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
        words = (keys.groupBy(F.shiftright(place, 6).alias("word"))
                 .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & 63L as int))")).alias("bits")).toArrow())
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.int64).view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
