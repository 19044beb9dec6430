"""Blocked windows give the rows of unblocked ones, whatever the block length, partitions or session time zone."""
from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hourgrid.operators import blocks, features, timegrid, windows
from hourgrid.operators.features import HourlySpec


@pytest.fixture(scope="module")
def grid(spark):
    rnd = random.Random(3)
    rows = [(z, dt.date(2023, 12, 20) + dt.timedelta(days=i), h,
             None if rnd.random() < .1 else round(rnd.uniform(-20, 90), 2), round(rnd.uniform(1, 9), 2))
            for z, days in (("hot", 40), ("cold", 9)) for i in range(days) for h in range(24)]
    return spark.createDataFrame(rows, "zone string, local_date date, hour int, Price double, Load_DA double").cache()


def rows(df):
    return sorted((tuple(None if v is None else round(v, 8) if isinstance(v, float) else v for v in r)
                   for r in df.collect()), key=str)


def ordered():
    return Window.partitionBy("zone").orderBy("local_date", "hour")


@pytest.mark.parametrize("block_days", [1, 2, 7, 1000])
def test_lags_and_rolling(grid, block_days):
    out = blocks.windowed(grid, 9, lambda w: {"lag": F.lag("Price", 7 * 24).over(w)},
                          lambda w: {"std": windows.rolling_std("lag", 24, w)}, block_days=block_days)
    plain = grid.withColumn("lag", F.lag("Price", 7 * 24).over(ordered())).withColumn("std", windows.rolling_std("lag", 24, ordered()))
    assert rows(out) == rows(plain)


@pytest.mark.parametrize("block_days", [1, 3, 1000])
def test_carried(grid, block_days):
    at = grid.withColumn("at", features.F.make_timestamp_ntz(
        F.year("local_date"), F.month("local_date"), F.dayofmonth("local_date"), "hour", F.lit(0), F.lit(0)))
    filled = blocks.forward_fill(at, ["Price"], ["zone"], "at", block_days)
    assert rows(filled) == rows(at.withColumn("Price", F.last("Price", True).over(ordered())))
    placed = blocks.position(grid, block_days=block_days).drop("position_count")
    assert rows(placed) == rows(grid.withColumn("position", F.row_number().over(ordered())))


def test_null_key_is_a_series(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 500, None), ("a", 1, 1.0)], "zone string, d int, v double")
    df = df.withColumn("at", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).cast("timestamp_ntz"))
    got = blocks.forward_fill(df, ["v"], ["zone"], "at", 30).filter("zone is null").collect()
    assert [r["v"] for r in got] == [5.0, 5.0]


def test_rolling_regression_in_blocks(grid):
    daily = grid.filter("hour = 0")
    x = daily.withColumn("x", F.lag("Price", 1).over(Window.partitionBy("zone").orderBy("local_date")))
    got = windows.rolling_regression(x, "Price", "x", [5, 12]).filter("window = 12").select("zone", "local_date", "slope", "intercept")
    w = Window.partitionBy("zone").orderBy("local_date").rowsBetween(-12, -1)
    plain = x.select("zone", "local_date", F.regr_slope("Price", "x").over(w).alias("slope"),
                     F.regr_intercept("Price", "x").over(w).alias("intercept"))
    for a, b in zip(rows(got), rows(plain)):
        assert a[:2] == b[:2]
        for u, v in zip(a[2:], b[2:]):
            assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, rel=1e-6, abs=1e-6))


SPEC = HourlySpec(forecasts=(), fuels=(), last_price=True, extras=True)


def test_no_feature_knows_the_future(grid):
    """Changing the last day leaves all features of earlier days as they are."""
    last = dt.date(2023, 12, 20) + dt.timedelta(days=39)
    changed = grid.withColumn("Price", F.when(F.col("local_date") == F.lit(last), 1e6).otherwise(F.col("Price")))
    before = F.col("local_date") < F.lit(last)
    assert rows(features.hourly_features(changed, SPEC).filter(before)) == rows(
        features.hourly_features(grid, SPEC).filter(before))


def test_lagged_mean_does_not_know_its_day(grid):
    options = dict(forecasts=(), fuels=(), demean="lagged")
    day = dt.date(2023, 12, 30)
    changed = grid.withColumn("Price", F.when(F.col("local_date") == F.lit(day), 1e6).otherwise(F.col("Price")))
    pick = lambda g: rows(features.daily_matrix(g, **options).filter(F.col("local_date") == F.lit(day)).select(
        "zone", "hour", "P_daily_mean", "Price_lag_1"))
    assert pick(changed) == pick(grid)


def test_same_rows_for_other_partitions_and_time_zones(spark, grid):
    def run():
        return rows(features.hourly_features(grid, SPEC))
    want = run()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert run() == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_local_grid_in_a_summer_time_session(spark):
    df = spark.createDataFrame([("a", "2024-03-31 00:00", 1.0), ("a", "2024-03-31 01:00", 3.0),
                                ("a", "2024-04-02 02:00", 4.0)], "zone string, t string, Price double")
    df = df.select("zone", F.col("t").cast("timestamp_ntz").alias("time_utc"), "Price")
    want = rows(timegrid.local_grid(df, ["Price"]))
    assert len(want) == 72 and len(timegrid.utc_grid(df, 3600).collect()) == 51
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert rows(timegrid.local_grid(df, ["Price"])) == want
        assert len(timegrid.utc_grid(df, 3600).collect()) == 51
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("limit", [0, 100])
def test_beside_matches_null_keys_with_and_without_sending(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "SMALL_ROWS", limit)
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "zone string, x int")
    small = spark.createDataFrame([("a", 10), (None, 20)], "zone string, m int")
    assert sorted(map(str, blocks.beside(df, small, ["zone"]).collect())) == sorted(map(str, [
        *spark.createDataFrame([("a", 1, 10), (None, 2, 20), ("b", 3, None)], "zone string, x int, m int").collect()]))
