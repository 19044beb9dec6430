"""Hand-worked values."""
from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hourgrid.functions.clock import to_local
from hourgrid.operators import blocks, combine, etl, features, scoring, timegrid, windows


def hours(spark, rows, zone="NO1"):
    """(UTC text, price) pairs."""
    return spark.createDataFrame([(zone, t, p) for t, p in rows], "zone string, t string, Price double").select(
        "zone", F.col("t").cast("timestamp_ntz").alias("time_utc"), "Price")


def series(spark, values, zone="NO1", start=dt.date(2024, 1, 1)):
    rows = [(zone, start + dt.timedelta(days=i // 24), i % 24, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "zone string, local_date date, hour int, Price double")


def cells(df, day):
    return {r["hour"]: r["Price"] for r in df.filter(F.col("local_date") == F.lit(day).cast("date")).collect()}


def test_spring_hour_is_interpolated(spark):
    df = hours(spark, [("2024-03-30 23:00", 10.0), ("2024-03-31 00:00", 20.0), ("2024-03-31 01:00", 40.0),
                       ("2024-03-31 21:00", 1.0)])
    day = cells(timegrid.local_grid(df, ["Price"]), "2024-03-31")
    assert len(day) == 24
    assert (day[0], day[1], day[2], day[3]) == (10.0, 20.0, 30.0, 40.0)
    assert day[4] is None


def test_spring_other_gaps_stay_null(spark):
    df = hours(spark, [("2024-03-30 23:00", 10.0), ("2024-03-31 01:00", 40.0), ("2024-03-31 21:00", 1.0)])
    day = cells(timegrid.local_grid(df, ["Price"]), "2024-03-31")
    assert day[1] is None and day[2] is None and day[3] == 40.0


@pytest.mark.parametrize("second, expected", [(12.0, 10.0), (None, None)])
def test_fall_hour_is_averaged(spark, second, expected):
    df = hours(spark, [("2024-10-26 22:00", 5.0), ("2024-10-27 00:00", 8.0), ("2024-10-27 01:00", second),
                       ("2024-10-27 02:00", 7.0), ("2024-10-27 22:00", 1.0)])
    day = cells(timegrid.local_grid(df, ["Price"]), "2024-10-27")
    assert len(day) == 24 and day[2] == expected and day[3] == 7.0


def test_fall_missing_row_is_a_missing_value(spark):
    df = hours(spark, [("2024-10-26 22:00", 5.0), ("2024-10-27 00:00", 8.0), ("2024-10-27 02:00", 7.0)])
    assert cells(timegrid.local_grid(df, ["Price"]), "2024-10-27")[2] is None


def test_spring_half_hours(spark):
    df = hours(spark, [("2024-03-31 00:30", 3.0), ("2024-03-31 01:00", 9.0), ("2024-03-31 01:30", 1.0)])
    day = cells(timegrid.local_grid(df, ["Price"], slots=48), "2024-03-31")
    assert len(day) == 48
    assert [day[s] for s in (3, 4, 5, 6)] == [3.0, 5.0, 7.0, 9.0]


def test_other_sundays_are_left_alone(spark):
    df = hours(spark, [("2024-04-07 00:00", 1.0), ("2024-04-07 01:00", 3.0)])
    day = cells(timegrid.local_grid(df, ["Price"]), "2024-04-07")
    assert (day[2], day[3]) == (1.0, 3.0)


@pytest.mark.parametrize("utc, local", [("2024-10-27 00:00:00", "2024-10-27 02:00:00"),
                                        ("2024-10-27 01:00:00", "2024-10-27 02:00:00"),
                                        ("2024-03-31 00:00:00", "2024-03-31 01:00:00"),
                                        ("2024-03-31 01:00:00", "2024-03-31 03:00:00")])
def test_utc_to_local(spark, utc, local):
    row = spark.range(1).select(to_local(F.lit(utc).cast("timestamp_ntz"), "CET").cast("string").alias("l")).first()
    assert row["l"] == local


def test_lower_and_averaged_median(spark):
    out = blocks.windowed(series(spark, [1.0, 4.0, 9.0]), 1, lambda w: {
        "low": windows.rolling_median_low("Price", 2, w), "avg": windows.rolling_median_avg("Price", 2, w)})
    row = out.filter("hour = 2").first()
    assert (row["low"], row["avg"]) == (1.0, 2.5)


def test_percent_change(spark):
    out = blocks.windowed(series(spark, [0.0, 5.0]), 1, lambda w: {
        "eps": windows.pct(F.col("Price"), F.lag("Price", 1).over(w), 1.0),
        "plain": windows.pct(F.col("Price"), F.lag("Price", 1).over(w))}).filter("hour = 1").first()
    assert out["eps"] == 500.0 and out["plain"] is None


def test_rolling_std_excludes_the_current_row(spark):
    out = blocks.windowed(series(spark, [1.0, 3.0, 8.0]), 1, lambda w: {"s": windows.rolling_std("Price", 2, w)})
    got = [r["s"] for r in out.orderBy("hour").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(math.sqrt(2))


def test_holiday_window(spark):
    days = [("NO1", dt.date(2024, 5, 14) + dt.timedelta(days=i), h) for i in range(8) for h in range(24)]
    grid = spark.createDataFrame(days, "zone string, local_date date, hour int")
    holidays = spark.createDataFrame([(dt.date(2024, 5, 17), "NO"), (dt.date(2024, 5, 15), "SE"),
                                      (dt.date(2024, 5, 17), "NO")], "Date date, CountryCode string")
    out = features.holiday_dummy(grid, holidays)
    assert out.count() == len(days)
    hit = sorted((r["local_date"], r["hour"]) for r in out.filter("is_holiday = 1").collect())
    assert hit[0] == (dt.date(2024, 5, 16), 12) and hit[-1] == (dt.date(2024, 5, 19), 11) and len(hit) == 72


def forecasts(spark, truth, preds, hour=0):
    rows = [("Z", dt.date(2024, 1, 1) + dt.timedelta(days=i), hour, f"m{k}", float(truth[i]), float(p))
            for i, row in enumerate(preds) for k, p in enumerate(row)]
    return spark.createDataFrame(
        rows, "zone string, local_date date, hour int, model string, y_true double, y_pred double")


def test_ewa_walk(spark):
    df = forecasts(spark, [11, 10, 13], [(10, 12), (11, 9), (10, 14)])
    rows = combine.ewa_with_reset(df, 0.25, ["m0", "m1"]).orderBy("local_date").collect()
    assert [list(r["weights"]) for r in rows] == [[.5, .5]] * 3
    assert [r["y_pred"] for r in rows] == [11.0, 10.0, 12.0]
    assert [r["squared_loss"] for r in rows] == [0.0, 0.0, 1.0]
    assert list(rows[-1]["next_weights"]) == pytest.approx([0.11920292, 0.88079708])


def test_ewa_reset(spark):
    df = forecasts(spark, [110], [(10, 12)])
    row = combine.ewa_with_reset(df, 0.25, ["m0", "m1"], [.9, .1]).first()
    assert list(row["next_weights"]) == [.5, .5]


def test_ewa_closed_form_equals_the_walk(spark):
    df = forecasts(spark, [1, 2, 3, 2], [(1.1, .5), (2.2, 1.5), (2.5, 3.1), (2.0, 2.4)])
    walk = {r["local_date"]: list(r["weights"]) for r in combine.ewa_with_reset(df, 0.5, ["m0", "m1"]).collect()}
    for r in combine.ewa_weights(df, 0.5).collect():
        assert r["weight"] == pytest.approx(walk[r["local_date"]][int(r["model"][1])])


def test_ewa_tune_prefers_the_earlier_of_equal_rates(spark):
    df = forecasts(spark, [1, 1], [(2, 0), (2, 0)])
    assert combine.ewa_tune(df, [0.5, 0.25]).first()["eta"] == 0.5


def test_tuning_with_and_without_reset_agree_for_small_errors(spark):
    df = forecasts(spark, [1, 2, 3, 2], [(1.1, .5), (2.2, 1.5), (2.5, 3.1), (2.0, 2.4)])
    etas = [0.1, 2.0, 0.5]
    a, b = combine.ewa_tune(df, etas).first(), combine.ewa_tune_with_reset(df, ["m0", "m1"], etas).first()
    assert a["eta"] == b["eta"] and a["loss"] == pytest.approx(b["loss"])
    table = spark.createDataFrame([("Z", 0, 0.5)], "zone string, hour int, eta double")
    one = [r["y_pred"] for r in combine.ewa_with_reset(df, 0.5, ["m0", "m1"]).orderBy("local_date").collect()]
    two = [r["y_pred"] for r in combine.ewa_with_reset(df, table, ["m0", "m1"]).orderBy("local_date").collect()]
    assert one == two


def test_weights_sum_to_one(spark):
    df = forecasts(spark, range(30), [(i + .5, i - 2, i + 40) for i in range(30)])
    sums = combine.ewa_weights(df, 2.0).groupBy("local_date").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == 30 and all(r["s"] == pytest.approx(1.0) for r in sums)


def test_burn_in_keeps_the_last_days(spark):
    n = 821
    df = forecasts(spark, [0] * n, [(0, 1)] * n)
    etas = spark.createDataFrame([("Z", 0, 0.1)], "zone string, hour int, eta double")
    out = combine.ewa_apply(df, etas)
    assert out.count() == 729
    assert out.agg(F.max("local_date")).first()[0] == dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def test_diebold_mariano(spark):
    a, b = [(1, -2), (.5, 1), (2, -1), (0, 1)], [(2, -2), (1.5, 1), (1, -1), (1, 1)]
    rows = [("Z", dt.date(2024, 1, 1 + i), h, m, 0.0, float(e)) for m, errs in (("a", a), ("b", b))
            for i, day in enumerate(errs) for h, e in enumerate(day)]
    df = spark.createDataFrame(rows, "zone string, local_date date, hour int, model string, y_true double, y_pred double")
    out = scoring.dm_test(df, "a", "b", slots=2).first()
    assert out["statistic"] == pytest.approx(-1.0 * math.sqrt(4 / 3) * math.sqrt(3 / 4))
    assert out["p_value"] == pytest.approx(0.195501109)


@pytest.mark.parametrize("t, df, p", [(0.0, 5, .5), (1.0, 1, .75), (-1.0, 1, .25), (2.0, 2, 0.908248290),
                                      (1.959963985, 1e7, .975)])
def test_t_distribution(t, df, p):
    assert scoring.t_cdf(t, df) == pytest.approx(p, abs=1e-6)


def test_hill(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 5, 8, 13, -4, 0)], "v double")
    got = {r["k"]: r["alpha"] for r in scoring.hill_index(df, "v", start=0).collect()}
    assert [got[k] for k in range(2, 7)] == pytest.approx([4.119398, 2.104502, 1.352269, 1.091738, .74575], abs=1e-6)


def test_hill_with_ties_and_few_buckets(spark):
    values = [float(v) for v in [3] * 50 + [7] * 5 + list(range(1, 40))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    top = sorted(values, reverse=True)
    got = {r["k"]: r["alpha"] for r in scoring.hill_index(df, "v", start=0, buckets=3).collect()}
    assert len(got) == len(values) - 1
    for k in (2, 10, 45, 60, 94):
        xi = sum(math.log(v) for v in top[:k]) / k - math.log(top[k - 1])
        assert got[k] == pytest.approx(1 / xi)


def test_partial_correlation(spark):
    rows = list(zip(("Z",) * 5, (1., 2., 4., 3., 6.), (2., 1., 3., 5., 4.), (1., 2., 3., 4., 5.)))
    df = spark.createDataFrame(rows, "zone string, y double, x double, z double")
    assert scoring.partial_corr(df, "y", "x", ["z"]).first()["partial_corr"] == pytest.approx(-0.57735027)


def test_inverse_loss_mix(spark):
    df = forecasts(spark, [0], [(10, 20)])
    losses = spark.createDataFrame([("Z", "m0", 1.0), ("Z", "m1", 3.0)], "zone string, model string, loss double")
    assert combine.inverse_loss_mix(df, losses).first()["y_pred"] == pytest.approx(12.5)


def test_strict_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1.0), (dt.date(2024, 1, 1), "a", 2.0)],
                               "Date date, name string, Value double")
    with pytest.raises(Exception, match="duplicate entry"):
        etl.pivot_strict(df, "Date", ["a"]).collect()


def test_all_null_group_stays_null(spark):
    df = hours(spark, [("2024-01-01 00:10", None), ("2024-01-01 00:40", None), ("2024-01-01 01:10", 2.0)])
    got = [r["Price"] for r in etl.roll_up_hourly(df, ["zone", "time_utc"], ["Price"]).orderBy("time_utc").collect()]
    assert got == [None, 2.0]


def test_empty_id_list(spark):
    values = spark.createDataFrame([(1, 2.0)], "TimeSeriesID long, Value double")
    assert etl.with_ids(values, values.filter("TimeSeriesID = 99")).count() == 0


def test_modal_step_takes_the_smaller_of_equals(spark):
    df = hours(spark, [(f"2024-01-01 {h:02d}:00", 1.0) for h in (0, 1, 2, 4, 6)])
    assert etl.modal_step(df).first()["step_seconds"] == 3600


@pytest.mark.parametrize("text", ["1996-03-01", "1996-3-1", "1996-03-01 00:00:00", "1996-03-01T00:00:00", " 1996-03-01 ",
                                  "1996-03-01 23:59:59.123"])
def test_dates_of_many_texts(spark, text):
    assert spark.range(1).select(etl.coerce_date(F.lit(text)).alias("d")).first()["d"] == dt.date(1996, 3, 1)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_dates_of_typed_columns(spark, kind):
    value = F.lit("1996-03-01").cast(kind)
    assert spark.range(1).select(etl.coerce_date(value).alias("d")).first()["d"] == dt.date(1996, 3, 1)


@pytest.mark.parametrize("text", ["rubbish", "1996", "1996-13-01", "n/a 1996-03-01", "", "1996-03-01 soon", None])
def test_what_is_no_date_is_null(spark, text):
    assert spark.range(1).select(etl.coerce_date(F.lit(text)).alias("d")).first()["d"] is None


def test_utc_grid_keeps_single_and_off_grid_rows(spark):
    df = hours(spark, [("2024-01-01 00:00", 1.0), ("2024-01-01 01:00", 2.0), ("2024-01-01 01:30", 9.0), ("2024-01-01 03:00", 3.0)])
    one = hours(spark, [("2024-01-01 05:00", 7.0)], "NO2")
    out = timegrid.utc_grid(df.union(one), steps=etl.modal_step(df.filter("minute(time_utc) = 0").union(one)))
    got = {(r["zone"], str(r["time_utc"])[11:16]): r["Price"] for r in out.collect()}
    assert got == {("NO1", "00:00"): 1.0, ("NO1", "01:00"): 2.0, ("NO1", "01:30"): 9.0, ("NO1", "02:00"): None,
                   ("NO1", "03:00"): 3.0, ("NO2", "05:00"): 7.0}


@pytest.mark.parametrize("tz", ["CET", "UTC"])
def test_two_rows_for_a_step_are_an_error(spark, tz):
    finer = hours(spark, [("2024-01-01 00:00", 1.0), ("2024-01-01 00:30", 2.0)])
    with pytest.raises(Exception, match="more than one row"):
        timegrid.local_grid(finer, ["Price"], tz).collect()


@pytest.mark.parametrize(("tz", "missing"), [("Europe/London", 1), ("Europe/Helsinki", 3), ("CET", 2)])
def test_missing_hour_of_other_zones(spark, tz, missing):
    df = hours(spark, [(f"2024-03-{30 + h // 24:02d} {h % 24:02d}:00", float(h)) for h in range(20, 44)])
    day = cells(timegrid.local_grid(df, ["Price"], tz), "2024-03-31")
    first = 24 - {"Europe/London": 0, "Europe/Helsinki": 2, "CET": 1}[tz]
    known = {h: first + h - (h > missing) for h in range(12) if h != missing}
    assert {h: day[h] for h in known} == known
    assert day[missing] == (day[missing - 1] + day[missing + 1]) / 2


@pytest.mark.parametrize(("tz", "twice"), [("Europe/London", 1), ("Europe/Helsinki", 3)])
def test_doubled_hour_of_other_zones(spark, tz, twice):
    df = hours(spark, [(f"2024-10-{26 + h // 24:02d} {h % 24:02d}:00", float(h)) for h in range(18, 44)])
    day = cells(timegrid.local_grid(df, ["Price"], tz), "2024-10-27")
    assert day[twice] == (day[twice - 1] + day[twice + 1]) / 2 and day[twice] % 1 == 0.5


def test_change_at_midnight(spark):
    """Beirut's clocks go from 0 to 1 o'clock: the missing hour belongs to the next day."""
    df = hours(spark, [(f"2024-03-{30 + h // 24:02d} {h % 24:02d}:00", float(h)) for h in range(18, 30)])
    grid = timegrid.local_grid(df, ["Price"], "Asia/Beirut")
    day = cells(grid, "2024-03-31")
    assert (day[0], day[1], day[2]) == (21.5, 22.0, 23.0)


def test_hill_with_a_value_repeated_very_often(spark):
    df = spark.range(1_000_000).select(F.lit(5.0).alias("v")).union(spark.createDataFrame([(9.0,), (7.0,)], "v double"))
    out = scoring.hill_index(df, "v", start=0, end=1000)
    got = {r["k"]: r["alpha"] for r in out.collect()}
    assert sorted(got) == list(range(2, 1002))
    for k in (2, 3, 500, 1001):
        top = ([9.0, 7.0] + [5.0] * 1000)[:k]
        assert got[k] == pytest.approx(1 / (sum(map(math.log, top)) / k - math.log(top[-1])))
    assert scoring.hill_index(df, "v", start=0).count() == 1_000_001


def test_holidays_of_any_year(spark):
    day = dt.date(2031, 5, 17)
    grid = spark.createDataFrame([("Z", day, h) for h in range(24)], "zone string, local_date date, hour int")
    holidays = spark.createDataFrame([(day, "NO")], "Date date, CountryCode string")
    assert features.holiday_dummy(grid, holidays).filter("is_holiday = 1").count() == 24
    assert features.holiday_dummy(grid, holidays, years=(2019, 2024)).filter("is_holiday = 1").count() == 0
