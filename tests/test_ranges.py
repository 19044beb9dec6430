"""Time-range joins on series without a grid, and exact quantiles by counting."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import etl, features

T0 = dt.datetime(2024, 3, 30, 22)


def test_each_pair_once_on_an_irregular_series(spark):
    rng = np.random.default_rng(0)

    def times(n):
        return [T0 + dt.timedelta(microseconds=int(v)) for v in rng.integers(0, 5 * 86400 * 10**6, n)]
    rows = [(z, t, float(i)) for z in ("a", "b") for i, t in enumerate([*times(150), *[T0] * 3])]  # repeated stamps and gaps
    starts = [(z, t) for z in ("a", "b", "c") for t in [*times(20), T0, T0 + dt.timedelta(hours=7)]]
    starts += [(r[0], r[1]) for r in rows[:10]] + [(None, T0), ("a", None)]
    history = spark.createDataFrame([*rows, ("a", None, 1.0)], "zone string, time_utc timestamp_ntz, value double")
    origins = spark.createDataFrame(starts, "zone string, origin timestamp_ntz")
    for seconds in (3600, 25201, 400 * 3600):
        got = sorted((r["zone"], r["origin"], r["time_utc"], r["value"])
                     for r in features.range_history(origins, history, seconds).collect())
        want = sorted((z, o, t, v) for z, o in starts if z and o for k, t, v in rows
                      if k == z and o - dt.timedelta(seconds=seconds) <= t < o)
        assert got == want and got
        told = features.range_summary(origins, history, seconds, "value")
        assert told.count() == len(starts) and told.agg(F.sum("history_rows")).first()[0] == len(want)
    with pytest.raises(ValueError):
        features.range_history(origins.withColumn("value", F.lit(1)), history, 60)


@pytest.mark.parametrize("small, bins", [(5, 8), (50, 1024), (10_000, 16)])
def test_quantiles_by_counting(spark, small, bins):
    rng = np.random.default_rng(1)
    groups = {"even": rng.normal(size=500), "one": np.array([3.0]), "same": np.full(300, -2.5),
              "wide": np.concatenate([rng.normal(size=400), [1e300, -1e300, 1e12]]), "steps": rng.integers(0, 4, 777).astype(float),
              None: rng.exponential(size=101)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    df = spark.createDataFrame(rows, "zone string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["zone"], r["share"]): r["quantile"] for r in etl.exact_quantiles(df, "v", shares, ["zone"], bins, small).collect()}
    assert len(got) == len(groups) * len(shares)
    for k, vs in groups.items():
        for q in shares:
            assert got[k, q] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=1e-300), (k, q)


def test_hour_profile_of_a_long_hour(spark):
    """Ten million different values in one hour: only a few thousand of them are gathered."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("a").alias("zone"), F.lit(0).alias("hour"),
                               ((F.col("id") * 7919) % n).cast("double").alias("v"))
    df = df.union(spark.createDataFrame([("b", 1, None), ("b", 0, 4.0)], "zone string, hour int, v double"))
    got = {(r["zone"], r["hour"]): (r["q25"], r["median"], r["q75"]) for r in etl.hour_profile(df, "v").collect()}
    assert got == {("a", 0): ((n - 1) * .25, (n - 1) * .5, (n - 1) * .75), ("b", 0): (4.0, 4.0, 4.0), ("b", 1): (None, None, None)}
