"""Lags, differences, rolling measures, fills and calendar columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions.clock import daily_cycles, hourly_cycles, rush_hour, weekday_dummies
from hourgrid.functions.numeric import pct_change
from hourgrid.operators import blocks, etl, features, windows
from hourgrid.plans import standin as st
from hourgrid.plans.registry import Query

CELLS = "zone, local_date, hour"
W = "WINDOW w AS (PARTITION BY zone ORDER BY local_date, hour)"


def price(spark, d):
    return st.grid(spark, d, ["Price"])


def on_price(days, *stages):
    return lambda spark, d: blocks.windowed(price(spark, d), days, *stages).drop("_old", "_pct")


def frame(fn: str, n: int, skip: int = 0, col: str = "Price") -> str:
    over = f"OVER (PARTITION BY zone ORDER BY local_date, hour ROWS BETWEEN {n + skip} PRECEDING AND {1 + skip} PRECEDING)"
    return f"CASE WHEN count({col}) {over} = {n} THEN {fn.format(col)} {over} END"


def cyclic_hourly(spark, d):
    g = price(spark, d).drop("Price")
    first = g.groupBy("zone").agg(F.min("local_date").alias("first"))
    running = F.datediff("local_date", "first") * 24 + F.col("hour")
    return g.join(first, "zone").withColumns(hourly_cycles("hour", running)).drop("first")


def cyclic_daily(spark, d):
    parts = daily_cycles(F.col("local_date").cast("timestamp_ntz"))
    return st.daily(spark, d).select("zone", "local_date", *[c.alias(n) for n, c in parts.items()])


def base_index(spark, d):
    """Order values and shipped values side by side, relative to January 1996."""
    orders = st.daily(spark, d).select("zone", F.col("local_date").cast("timestamp_ntz").alias("time_utc"), "value")
    shipped = st.table(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("time_utc")).agg(
        F.avg("l_extendedprice").alias("shipped"))
    return windows.base_index(etl.join_series(orders, shipped), ["value", "shipped"], "time_utc", "1996-01-01",
                              "1996-02-01").select("zone", "time_utc", "value", "shipped", "value_index", "shipped_index")


def regression(spark, d, lengths):
    lagged = blocks.windowed(st.daily(spark, d).select("zone", "local_date", "value"), 1,
                             lambda w: {"x": F.lag("value", 1).over(w)}, order=("local_date",))
    return windows.rolling_regression(lagged, "value", "x", lengths)


def regression_sql(window):
    return f"""WITH {st.DAILY_SQL}, x AS (SELECT zone, local_date, value, lag(value, 1) OVER (PARTITION BY zone
  ORDER BY local_date) AS x FROM daily),
f AS (SELECT *, nullif(regr_intercept(value, x) OVER r, 'nan') AS intercept,
             nullif(regr_slope(value, x) OVER r, 'nan') AS slope FROM x
      WINDOW r AS (PARTITION BY zone ORDER BY local_date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING))
SELECT zone, local_date, value, x, intercept, slope, intercept + slope * x AS y_pred FROM f"""



WINDOW_QUERIES = [
    Query("lag_hours", on_price(2, lambda w: {f"lag_{k}": windows.lagged("Price", k, w) for k in (0, 1, 2, 7, 25)}),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, Price AS lag_0, lag(Price, 1) OVER w AS lag_1,
lag(Price, 2) OVER w AS lag_2, lag(Price, 7) OVER w AS lag_7, lag(Price, 25) OVER w AS lag_25 FROM grid {W}""",
          "Price lag_0 lag_1 lag_2 lag_7 lag_25", "local_date"),
    Query("lag_days", lambda s, d: windows.lag_block(price(s, d), {"Price": [1, 2, 7]}, "day"),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, lag(Price, 1) OVER h AS Price_lag_1, lag(Price, 2) OVER h AS Price_lag_2,
lag(Price, 7) OVER h AS Price_lag_7 FROM grid WINDOW h AS (PARTITION BY zone, hour ORDER BY local_date)""",
          "Price Price_lag_1 Price_lag_2 Price_lag_7", "local_date"),
    Query("lag_block", lambda s, d: windows.lag_block(st.grid(s, d, ["Price", "Load_DA", "Coal"]), {
        "Price": [1, 2, 3], "Load_DA": [0, 24], "Coal": [48]}, "hour").drop("Price", "Load_DA", "Coal"),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, lag(Price, 1) OVER w AS Price_lag_1, lag(Price, 2) OVER w AS Price_lag_2,
lag(Price, 3) OVER w AS Price_lag_3, Load_DA AS Load_DA_lag_0, lag(Load_DA, 24) OVER w AS Load_DA_lag_24,
lag(Coal, 48) OVER w AS Coal_lag_48 FROM grid {W}""",
          "Price_lag_1 Price_lag_2 Price_lag_3 Load_DA_lag_0 Load_DA_lag_24 Coal_lag_48", "local_date"),
    Query("prev_day_last", lambda s, d: windows.previous_day_last(price(s, d), "Price"),
          f"""WITH {st.GRID_SQL} SELECT g.zone, g.local_date, g.hour, g.Price, p.Price AS price_last FROM grid g
LEFT JOIN grid p ON p.zone = g.zone AND p.local_date = g.local_date - 1 AND p.hour = 23""", "Price price_last", "local_date"),
    Query("hour0_value", lambda s, d: windows.hour_zero(st.grid(s, d, ["Coal", "NGas"]), ["Coal", "NGas"]),
          f"""WITH {st.GRID_SQL} SELECT g.zone, g.local_date, g.hour, g.Coal, g.NGas, p.Coal AS Coal_h0, p.NGas AS NGas_h0
FROM grid g JOIN grid p ON p.zone = g.zone AND p.local_date = g.local_date AND p.hour = 0""",
          "Coal NGas Coal_h0 NGas_h0", "local_date"),
    Query("diff_target", on_price(1, lambda w: {"diff_hour": F.col("Price") - F.lag("Price", 1).over(w),
                                                "diff_day": F.col("Price") - F.lag("Price", 24).over(w)}),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, Price - lag(Price, 1) OVER w AS diff_hour,
Price - lag(Price, 24) OVER w AS diff_day FROM grid {W}""", "Price diff_hour diff_day", "local_date"),
    Query("diff_lags", lambda s, d: windows.difference_lags(price(s, d), "Price", (1, "hour"), [1, 2], "day"),
          f"""WITH {st.GRID_SQL}, x AS (SELECT *, Price - lag(Price, 1) OVER w AS delta FROM grid {W})
SELECT {CELLS}, Price, delta, lag(delta, 24) OVER w AS delta_lag1d, lag(delta, 48) OVER w AS delta_lag2d FROM x {W}""",
          "Price delta delta_lag1d delta_lag2d", "local_date"),
    Query("second_diff", on_price(2, lambda w: {"second": windows.second_difference("Price", w),
                                                "second_lag24": windows.second_difference("Price", w, 24)}),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, Price - 2 * lag(Price, 1) OVER w + lag(Price, 2) OVER w AS second,
lag(Price, 24) OVER w - 2 * lag(Price, 25) OVER w + lag(Price, 26) OVER w AS second_lag24 FROM grid {W}""",
          "Price second second_lag24", "local_date"),
    Query("pct_change", lambda s, d: blocks.windowed(
        st.grid(s, d, ["Price", "Oil"]), 1,
        lambda w: {"plain": pct_change(F.col("Oil"), F.lag("Oil", 1).over(w)),
                   "adjusted": pct_change(F.col("Oil"), F.lag("Oil", 1).over(w), 1.0),
                   "price_pct": pct_change(F.col("Price"), F.lag("Price", 1).over(w))}).drop("Price", "Oil"),
          f"""WITH {st.GRID_SQL}, x AS (SELECT *, lag(Oil, 1) OVER w AS p1, lag(Price, 1) OVER w AS q1 FROM grid {W})
SELECT {CELLS}, 100 * ((Oil - p1) / nullif(p1, 0)) AS plain,
100 * ((Oil - p1) / CASE WHEN p1 = 0 THEN 1.0 ELSE p1 END) AS adjusted, 100 * ((Price - q1) / nullif(q1, 0)) AS price_pct FROM x""",
          "plain adjusted price_pct", "local_date"),
    Query("rolling_std", on_price(2, lambda w: {"std_24": windows.rolling_std("Price", 24, w),
                                                "std_3": windows.rolling_std("Price", 3, w)}),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, {frame('stddev_samp({})', 24)} AS std_24,
{frame('stddev_samp({})', 3)} AS std_3 FROM grid""", "Price std_24 std_3", "local_date"),
    Query("volatility_24h", lambda s, d: windows.volatility(price(s, d), "Price"),
          f"""WITH {st.GRID_SQL},
x AS (SELECT *, lag(Price, 24) OVER w AS o, lag(Price, 25) OVER w AS o1 FROM grid {W}),
y AS (SELECT *, 100 * (o - o1) / CASE WHEN o1 = 0 THEN 1.0 ELSE o1 END AS pct FROM x)
SELECT {CELLS}, Price, {frame('stddev_samp({})', 24, 0, 'o')} AS volatility_24h,
{frame('stddev_samp({})', 24, 0, 'pct')} AS volatility_pct_24h FROM y""",
          "Price volatility_24h volatility_pct_24h", "local_date"),
    Query("vol_daily", lambda s, d: windows.daily_volatility(price(s, d), "Price"),
          f"""WITH {st.GRID_SQL},
x AS (SELECT *, (Price - lag(Price, 1) OVER w) / nullif(lag(Price, 1) OVER w, 0) AS pct FROM grid {W}),
y AS (SELECT {CELLS}, {frame('stddev_samp({})', 24)} AS vol_24h_lag1,
      {frame('stddev_samp({})', 24, 0, 'pct')} AS volpct_24h_lag1 FROM x)
SELECT zone, local_date, vol_24h_lag1, volpct_24h_lag1 FROM y WHERE hour = 0""",
          "vol_24h_lag1 volpct_24h_lag1", "local_date"),
    Query("base_index", base_index, f"""WITH {st.DAILY_SQL},
s AS (SELECT CAST(l_shipdate AS DATE) AS local_date, avg(l_extendedprice) AS shipped FROM lineitem GROUP BY 1),
k AS (SELECT d.zone, d.local_date, d.value, s.shipped FROM daily d LEFT JOIN s ON s.local_date = d.local_date),
b AS (SELECT zone, arg_min(value, local_date) FILTER (value IS NOT NULL) AS bv,
             arg_min(shipped, local_date) FILTER (shipped IS NOT NULL) AS bs FROM k
      WHERE local_date >= DATE '1996-01-01' AND local_date < DATE '1996-02-01' GROUP BY 1)
SELECT k.zone, CAST(k.local_date AS TIMESTAMP) AS time_utc, k.value, k.shipped, k.value / nullif(b.bv, 0) AS value_index,
k.shipped / nullif(b.bs, 0) AS shipped_index FROM k LEFT JOIN b ON b.zone = k.zone""",
          "value shipped value_index shipped_index", "time_utc"),
    Query("rolling_median_low", on_price(1, lambda w: {"median": windows.rolling_median_low("Price", 4, w)}),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, {frame('quantile_disc({}, 0.5)', 4)} AS median FROM grid""",
          "Price median", "local_date"),
    Query("rolling_median_avg", on_price(1, lambda w: {"median": windows.rolling_median_avg("Price", 2, w)}),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, {frame('median({})', 2)} AS median FROM grid""",
          "Price median", "local_date"),
    Query("decay_weight", lambda s, d: windows.decay_weights(price(s, d), 0.004),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, exp(-0.004 * (row_number() OVER (PARTITION BY zone
ORDER BY local_date DESC, hour DESC) - 1)) AS weight FROM grid""", "Price weight", "local_date"),
    Query("tail_rows", lambda s, d: windows.tail_rows(price(s, d), 48), f"""WITH {st.GRID_SQL}
SELECT * FROM (SELECT {CELLS}, Price, CAST(row_number() OVER (PARTITION BY zone ORDER BY local_date DESC, hour DESC)
  AS INTEGER) AS from_end FROM grid) WHERE from_end <= 48""", "Price", "local_date"),
    Query("series_position", lambda s, d: blocks.position(st.hourly(s, d).select("zone", "time_utc", "Price"), ["zone"],
                                                          ["time_utc"]), f"""WITH {st.hourly_sql()}
SELECT zone, time_utc, Price, row_number() OVER (PARTITION BY zone ORDER BY time_utc) AS position,
count(*) OVER (PARTITION BY zone) AS position_count FROM hourly""", "Price", "time_utc"),
    Query("cyclic_hourly", cyclic_hourly, f"""WITH {st.GRID_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY zone
ORDER BY local_date, hour) - 1 AS i FROM grid)
SELECT {CELLS}, sin(2 * pi() * hour / 24) AS sin_hour, cos(2 * pi() * hour / 24) AS cos_hour,
sin(2 * pi() * i / 168) AS sin_week, cos(2 * pi() * i / 168) AS cos_week,
sin(2 * pi() * i / 8760) AS sin_year, cos(2 * pi() * i / 8760) AS cos_year FROM x""",
          "sin_hour cos_hour sin_week cos_week sin_year cos_year", "local_date"),
    Query("cyclic_daily", cyclic_daily, f"""WITH {st.DAILY_SQL}, x AS (SELECT zone, local_date,
  CAST((isodow(local_date) - 1) * 24 AS INTEGER) AS W_t, CAST((dayofyear(local_date) - 1) * 24 AS INTEGER) AS A_t FROM daily)
SELECT zone, local_date, CAST(0 AS INTEGER) AS D_t, W_t, A_t, sin(2 * pi() * W_t / 168) AS W_t_sin,
cos(2 * pi() * W_t / 168) AS W_t_cos, sin(2 * pi() * A_t / 8760) AS A_t_sin, cos(2 * pi() * A_t / 8760) AS A_t_cos FROM x""",
          "W_t_sin W_t_cos A_t_sin A_t_cos", "local_date"),
    Query("weekday_dummies", lambda s, d: st.daily(s, d).select("zone", "local_date", *[
        c.alias(n) for n, c in weekday_dummies("local_date", [1, 6, 7]).items()]),
          f"""WITH {st.DAILY_SQL} SELECT zone, local_date, CAST(isodow(local_date) = 1 AS INTEGER) AS WD_1,
CAST(isodow(local_date) = 6 AS INTEGER) AS WD_6, CAST(isodow(local_date) = 7 AS INTEGER) AS WD_7 FROM daily""",
          "", "local_date"),
    Query("rush_hour", lambda s, d: price(s, d).select("zone", "local_date", "hour", rush_hour("hour").alias("rush")),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 AS INTEGER) AS rush
FROM grid""", "", "local_date"),
    Query("daily_demean", lambda s, d: features.daily_mean_parts(price(s, d)),
          f"""WITH {st.GRID_SQL}, x AS (SELECT *, CASE WHEN count(Price) OVER p = 24 THEN avg(Price) OVER p END AS m FROM grid
WINDOW p AS (PARTITION BY zone, local_date))
SELECT {CELLS}, Price, m AS P_daily_mean, Price - m AS P_center FROM x""", "Price P_daily_mean P_center", "local_date"),
    Query("rolling_regression", lambda s, d: regression(s, d, [365]).drop("window"), regression_sql(365),
          "value x intercept slope y_pred", "local_date", 3),
]
