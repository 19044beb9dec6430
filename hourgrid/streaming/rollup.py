"""The hourly roll-up as a stream over files that keep arriving.

Sums per (keys, hour) are kept in Spark's state store with a watermark on the row's own time. Every micro-batch writes the hours it
changed under its own number, so a batch that is run again replaces what it wrote; ``current`` gives each hour's latest
value. Rows behind the watermark are late: they change nothing. A stopped stream goes on from its checkpoint folder.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def hourly_sums(rows: DataFrame, keys: Sequence[str] = ("zone",), ts: str = "time_utc", value: str = "value",
                late_after: str = "1 day") -> DataFrame:
    """Streaming or static rows to (keys, ``ts`` at the full hour, ``value`` summed).

    Equal to ``etl.roll_up_hourly`` on the rows that are not late: an hour whose values are all null is null, rows without a time
    do not count. ``ts`` is a time stamp with or without time zone; hours are those of UTC.
    """
    stamped = rows.filter(F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        stamped = stamped.withWatermark("_at", late_after)
    sums = stamped.groupBy(*keys, F.window("_at", "1 hour").alias("_w")).agg(F.sum(value).alias(value))
    return sums.select(*keys, F.col("_w.start").cast(rows.schema[ts].dataType).alias(ts), value)


def read_files(spark: SparkSession, path: str, schema: str, files_each: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, at most ``files_each`` in a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.parquet(path)


def write_changes(sums: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes what is there now and stops (``availableNow``); state and progress are in ``checkpoint``,
    a folder all executors reach."""
    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
    return (sums.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current(spark: SparkSession, path: str, keys: Sequence[str] = ("zone",), ts: str = "time_utc", value: str = "value") -> DataFrame:
    """Each hour's latest value."""
    changes = spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*")
    latest = F.max(F.struct(BATCH, value)).alias("_last")
    return changes.groupBy(*keys, ts).agg(latest).select(*keys, ts, F.col(f"_last.{value}").alias(value))
