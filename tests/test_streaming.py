"""The streamed roll-up against the batch one: any cut into files, restarts, late rows."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourgrid.operators import etl
from hourgrid.streaming import rollup

SCHEMA = "zone string, time_utc timestamp_ntz, value double"
SF = "/root/testdata/sf0.001"


def run(spark, source, out, checkpoint, late_after="400 days", files_each=2):
    stream = rollup.hourly_sums(rollup.read_files(spark, source, SCHEMA, files_each), late_after=late_after)
    query = rollup.write_changes(stream, out, checkpoint)
    assert query.awaitTermination(240) and query.exception() is None
    return {tuple(r) for r in rollup.current(spark, out).collect()}


def rounded(rows):
    return {(z, t, None if v is None else round(v, 6)) for z, t, v in rows}


def test_stream_equals_batch_for_any_cut(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_type").alias("zone"), F.col("ts").cast("timestamp_ntz").alias("time_utc"), "value")
    want = rounded(tuple(r) for r in etl.roll_up_hourly(events, ["zone", "time_utc"], ["value"]).collect())
    for files, each in ((1, None), (7, 3)):
        source = str(tmp_path / f"in{files}")
        events.repartition(files).write.parquet(source)
        got = run(spark, source, str(tmp_path / f"out{files}"), str(tmp_path / f"state{files}"), files_each=each)
        assert rounded(got) == want


def test_restart_late_rows_and_nulls(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = dt.datetime(2024, 3, 31)

    def arrive(*rows):
        spark.createDataFrame([(z, None if h is None else day + dt.timedelta(hours=h), v) for z, h, v in rows], SCHEMA
                              ).coalesce(1).write.mode("append").parquet(source)
    arrive(("a", 0.1, 1.0), ("a", 0.9, 2.0), ("a", 2.5, 4.0), (None, 1.0, 8.0), ("b", 1.2, None), ("b", None, 9.0))
    first = run(spark, source, out, state, "2 hours")
    at = [day + dt.timedelta(hours=h) for h in range(40)]
    assert first == {("a", at[0], 3.0), ("a", at[2], 4.0), (None, at[1], 8.0), ("b", at[1], None)}
    arrive(("a", 1.5, 16.0), ("a", 2.7, 32.0), ("b", 1.3, 5.0))  # behind other rows, not behind the watermark
    second = run(spark, source, out, state, "2 hours")
    assert second == {("a", at[0], 3.0), ("a", at[1], 16.0), ("a", at[2], 36.0), (None, at[1], 8.0), ("b", at[1], 5.0)}
    arrive(("a", 30.0, 1.0))
    run(spark, source, out, state, "2 hours")
    arrive(("a", 2.9, 99.0), ("a", 30.5, 2.0))  # late: the watermark stands at hour 28
    third = run(spark, source, out, state, "2 hours")
    assert third == second | {("a", at[30], 3.0)}
    assert run(spark, source, out, state, "2 hours") == third  # nothing new: nothing changes


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], SCHEMA)
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{out}/batch=0")
    rows.withColumn("value", F.lit(5.0)).write.mode("overwrite").parquet(f"{out}/batch=10")
    rows.withColumn("value", F.lit(3.0)).write.mode("overwrite").parquet(f"{out}/batch=9")
    assert [r["value"] for r in rollup.current(spark, out).collect()] == [5.0]


EXPERTS = ["m1", "m2", "m3"]
CELLS = "zone string, local_date date, hour int, y_true double, m1 double, m2 double, m3 double"


@pytest.mark.parametrize("cuts", [[40], [1, 2, 9, 30, 40], [7, 14, 21, 28, 35, 40]])
def test_streamed_weights_equal_the_batch_walk(spark, tmp_path, cuts):
    import numpy as np

    from hourgrid.operators import combine
    from hourgrid.streaming import weights
    rng = np.random.default_rng(4)
    rows = [(z, dt.date(2024, 1, 1) + dt.timedelta(days=d), h, *map(float, 10 * rng.normal(size=4)))
            for z in ("a", "b") for h in (0, 7) for d in range(40)]
    table = spark.createDataFrame(rows, CELLS)
    etas = spark.createDataFrame([(z, h, 0.5 ** (h + 1 + (z == "b"))) for z in ("a", "b") for h in (0, 7)], "zone string, hour int, eta double")
    long = table.unpivot(["zone", "local_date", "hour", "y_true"], EXPERTS, "model", "y_pred")
    want = {tuple(r)[:3]: r for r in combine.ewa_with_reset(long, etas, EXPERTS).collect()}
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    done = 0
    for upto in cuts:
        days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(done, upto)]
        part = [r for r in rows if r[1] in days]
        again = [(*r[:3], 99.0, 1.0, 2.0, 3.0) for r in rows if done and r[1] == dt.date(2024, 1, 1)]  # sent twice: late
        odd = [("a", None, 0, 1.0, 1.0, 1.0, 1.0), ("a", dt.date(2025, 1, 1), 0, None, 1.0, 1.0, 1.0)]
        spark.createDataFrame([*part, *again, *odd], CELLS).write.mode("append").parquet(source)
        stream = weights.combined(spark.readStream.schema(CELLS).parquet(source), EXPERTS, etas)
        query = weights.write_combined(stream, out, state)
        assert query.awaitTermination(240) and query.exception() is None
        done = upto
    got = {tuple(r)[:3]: r for r in spark.read.parquet(out).collect()}
    assert set(got) == set(want) and spark.read.parquet(out).count() == len(want)
    for key, r in got.items():
        assert r["y_pred"] == pytest.approx(want[key]["y_pred"]) and r["squared_loss"] == pytest.approx(want[key]["squared_loss"])
        assert np.allclose(r["next_weights"], want[key]["next_weights"])
