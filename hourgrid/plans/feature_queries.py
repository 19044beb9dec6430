"""Feature tables, training windows and spline bases."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import blocks, features
from hourgrid.operators.features import HourlySpec
from hourgrid.plans import standin as st
from hourgrid.plans.registry import Query

CELLS = "zone, local_date, hour"
W = "w AS (PARTITION BY zone ORDER BY local_date, hour)"
WEATHER = ["Temp", "WindS"]
SPEC = HourlySpec(price_lags=(1, 2, 7), load_lags=(0, 7), forecast_lags=(0, 1), fuel_lags=(2,), weather=WEATHER,
                  weather_lags=(0, 1))
SPEC_DIFF = HourlySpec(price_lags=(1, 2), forecasts=("WindOn_DA",), fuels=("Coal",), difference=True)
WD_SQL = ", ".join(f"CAST(isodow(local_date) = {k} AS INTEGER) AS WD_{k}" for k in (1, 6, 7))


def with_weather(spark, d):
    return features.join_weather(st.grid(spark, d), st.weather(spark, d), WEATHER)


JOINED_SQL = f"""{st.GRID_SQL},\n{st.WEATHER_SQL},
joined AS (SELECT g.*, {', '.join('w.' + c for c in WEATHER)} FROM grid g LEFT JOIN weather w
           ON w.zone = g.zone AND w.local_date = g.local_date AND w.hour = g.hour)"""


def lag_sql(column: str, k: int, name: str | None = None, step: int = 24) -> str:
    value = column if k == 0 else f"lag({column}, {step * k}) OVER w"
    return f"{value} AS {name or f'{column}_lag_{k}'}"


def design_sql(spec: HourlySpec, source: str = "joined") -> str:
    target = spec.target()
    lags = [lag_sql(target, k) for k in spec.price_lags]
    lags += [lag_sql(c, k) for c, ks in spec.lag_plan().items() for k in ks]
    return f"SELECT {CELLS}, {target}, {', '.join(lags)}, {WD_SQL} FROM {source} WINDOW {W}"


def feature_names(spec: HourlySpec) -> str:
    dummies = {"WD_1", "WD_6", "WD_7"}
    return " ".join([spec.target(), *[c for c in spec.regressors() if c not in dummies]])


EXTRA = HourlySpec(price_lags=(1,), forecasts=(), fuels=(), extras=True)
EXTRA_NAMES = ["pct_chg_Load_DA", "lag168_Load_DA", "lag1_price_2nd_diff", "volatility_24h", "volatility_pct_24h",
               "sin_hour", "cos_hour", "sin_week", "cos_week", "sin_year", "cos_year"]


def hourly_extras(spark, d):
    return features.holiday_dummy(features.hourly_features(st.grid(spark, d), EXTRA), st.holidays(spark), years=(2019, 2024))


def _gated(fn: str, col: str, n: int) -> str:
    over = f"OVER (PARTITION BY zone ORDER BY local_date, hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({col}) {over} = {n} THEN {fn}({col}) {over} END"


EXTRAS_SQL = f"""WITH {st.HOLIDAYS_SQL},\n{st.GRID_SQL},
x AS (SELECT *, lag(Price, 24) OVER w AS o, lag(Price, 25) OVER w AS o1, row_number() OVER w - 1 AS i FROM grid WINDOW {W}),
y AS (SELECT *, 100 * ((o - o1) / CASE WHEN o1 = 0 THEN 1.0 ELSE o1 END) AS pct FROM x)
SELECT {CELLS}, Price, o AS Price_lag_1, Load_DA AS Load_DA_lag_0, {WD_SQL},
  100 * ((Load_DA - lag(Load_DA, 1) OVER w) / nullif(lag(Load_DA, 1) OVER w, 0)) AS pct_chg_Load_DA,
  lag(Load_DA, 168) OVER w AS lag168_Load_DA, o - 2 * o1 + lag(Price, 26) OVER w AS lag1_price_2nd_diff,
  {_gated('stddev_samp', 'o', 24)} AS volatility_24h, {_gated('stddev_samp', 'pct', 24)} AS volatility_pct_24h,
  sin(2 * pi() * hour / 24) AS sin_hour, cos(2 * pi() * hour / 24) AS cos_hour, sin(2 * pi() * i / 168) AS sin_week,
  cos(2 * pi() * i / 168) AS cos_week, sin(2 * pi() * i / 8760) AS sin_year, cos(2 * pi() * i / 8760) AS cos_year,
  CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 AS INTEGER) AS rush_hour,
  CAST(EXISTS (SELECT 1 FROM holidays h WHERE h.CountryCode = 'NO' AND year(h.Date) BETWEEN 2019 AND 2024
    AND y.local_date + to_hours(y.hour) >= h.Date - INTERVAL 12 HOUR
    AND y.local_date + to_hours(y.hour) <= h.Date + INTERVAL 1 DAY - INTERVAL 1 SECOND + INTERVAL 36 HOUR) AS INTEGER)
  AS is_holiday
FROM y WINDOW {W}"""


# ---- daily matrices -------------------------------------------------------------------------------------------------

DAY0 = """x AS (SELECT *, first_value(Coal) OVER z AS Coal0, first_value(NGas) OVER z AS NGas0,
  CASE WHEN count(Price) OVER q = 24 THEN avg(Price) OVER q END AS m FROM grid
  WINDOW z AS (PARTITION BY zone, local_date ORDER BY hour), q AS (PARTITION BY zone, local_date))"""
MATRIX = dict(price_lags=(1, 2, 7), forecasts=("Load_DA", "WindOn_DA"), forecast_lags=(0, 1), fuels=("Coal", "NGas"),
              fuel_lags=(2,))
MATRIX_LAGS = ", ".join([*[lag_sql("Price", k) for k in (1, 2, 7)],
                         *[lag_sql(c, k) for c in ("Load_DA", "WindOn_DA") for k in (0, 1)],
                         *[lag_sql(f"{c}0", 2, f"{c}_lag_2") for c in ("Coal", "NGas")], WD_SQL])
MATRIX_NAMES = ("Price Price_lag_1 Price_lag_2 Price_lag_7 Load_DA_lag_0 Load_DA_lag_1 WindOn_DA_lag_0 WindOn_DA_lag_1 "
                "Coal_lag_2 NGas_lag_2")


def matrix(**options):
    return lambda spark, d: features.daily_matrix(
        st.grid(spark, d, ["Price", "Load_DA", "WindOn_DA", "Coal", "NGas"]), **MATRIX, **options)


def matrix_diff(spark, d):
    return features.daily_matrix_diff(st.grid(spark, d, ["Price", "Load_DA", "Coal"]))


DIFF_NAMES = ["del_price", "Price_lag_1", "del_price_lag1d", "del_price_lag2d", "Load_DA_lag_0", "sin_hour", "cos_hour",
              "pct_chg_Load_DA", "lag168_Load_DA", "lag1_price_2nd_diff", "Coal_lag_2", "W_t_sin", "W_t_cos", "A_t_sin",
              "A_t_cos", "vol_24h_lag1", "volpct_24h_lag1"]
DIFF_SQL = f"""WITH {st.GRID_SQL},
x AS (SELECT *, Price - lag(Price, 1) OVER w AS del_price, first_value(Coal) OVER z AS Coal0,
      (Price - lag(Price, 1) OVER w) / nullif(lag(Price, 1) OVER w, 0) AS pct FROM grid
      WINDOW {W}, z AS (PARTITION BY zone, local_date ORDER BY hour)),
y AS (SELECT *, {_gated('stddev_samp', 'Price', 24)} AS v, {_gated('stddev_samp', 'pct', 24)} AS vp,
      CAST((isodow(local_date) - 1) * 24 AS INTEGER) AS W_t, CAST((dayofyear(local_date) - 1) * 24 AS INTEGER) AS A_t FROM x)
SELECT {CELLS}, del_price, {lag_sql('Price', 1)}, {lag_sql('del_price', 1, 'del_price_lag1d')},
  {lag_sql('del_price', 2, 'del_price_lag2d')}, Load_DA AS Load_DA_lag_0, sin(2 * pi() * hour / 24) AS sin_hour,
  cos(2 * pi() * hour / 24) AS cos_hour, CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 AS INTEGER) AS rush_hour,
  100 * ((Load_DA - lag(Load_DA, 1) OVER w) / nullif(lag(Load_DA, 1) OVER w, 0)) AS pct_chg_Load_DA,
  lag(Load_DA, 168) OVER w AS lag168_Load_DA,
  lag(Price, 1) OVER w - 2 * lag(Price, 2) OVER w + lag(Price, 3) OVER w AS lag1_price_2nd_diff, {WD_SQL},
  {lag_sql('Coal0', 2, 'Coal_lag_2')}, CAST(0 AS INTEGER) AS D_t, W_t, A_t, sin(2 * pi() * W_t / 168) AS W_t_sin,
  cos(2 * pi() * W_t / 168) AS W_t_cos, sin(2 * pi() * A_t / 8760) AS A_t_sin, cos(2 * pi() * A_t / 8760) AS A_t_cos,
  first_value(v) OVER z AS vol_24h_lag1, first_value(vp) OVER z AS volpct_24h_lag1
FROM y WINDOW {W}, z AS (PARTITION BY zone, local_date ORDER BY hour)"""


def matrix_wide(spark, d):
    return features.widen_by_hour(matrix()(spark, d), ["Price", "Price_lag_1"], ["WD_6", "Coal_lag_2"])


# ---- windows --------------------------------------------------------------------------------------------------------

TRAIN_DAYS = 365


def zscore(spark, d):
    cut = st.table(spark, d, "orders").agg(F.max(F.col("o_orderdate").cast("date"))).scalar()
    return features.zscore(st.daily(spark, d), ["value", "n"], training=F.col("local_date") < F.date_sub(cut, 365))


def train_test(spark, d):
    series = blocks.windowed(st.daily(spark, d), 1, lambda w: {"x1": F.lag("value", 1).over(w)}, order=("local_date",))
    return features.train_test_slice(series, ["x1", "n"], ["value"], 300, 320)


def schedule(kind):
    return lambda spark, d: features.origin_schedule(
        st.table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone"),
                                            F.col("o_orderdate").cast("date").alias("local_date")), TRAIN_DAYS, kind)


def schedule_sql(shift: str) -> str:
    return f"""SELECT zone, CAST(s AS INTEGER) AS step, lo + CAST(s AS INTEGER) + {TRAIN_DAYS} AS origin,
lo + CAST({shift} AS INTEGER) AS train_first, lo + CAST(s AS INTEGER) + {TRAIN_DAYS - 1} AS train_last
FROM (SELECT o_orderpriority AS zone, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi
      FROM orders GROUP BY 1) b, unnest(range(0, CAST(hi - lo AS BIGINT) - {TRAIN_DAYS} + 1)) AS r(s)"""


def split_labels(spark, d):
    last = st.table(spark, d, "orders").agg(F.max(F.col("o_orderdate").cast("date"))).scalar()
    return features.split_labels(st.daily(spark, d).withColumn("origin", F.date_sub(last, 3)), "origin").drop("origin")


# ---- bases ----------------------------------------------------------------------------------------------------------

def periodic_basis(spark, d):
    rows = st.daily(spark, d).select("zone", "local_date", F.posexplode(features.periodic_basis(
        F.unix_date("local_date"))).alias("j", "basis"))
    return rows


def spline_basis(spark, d):
    g = st.grid(spark, d, ["Price"]).filter("Price is not null")
    ranges = g.groupBy("zone").agg(F.min("Price").alias("lo"), F.max("Price").alias("hi"))
    return blocks.beside(g, ranges, ["zone"]).select("zone", "local_date", "hour", F.posexplode(features.spline_basis(
        "Price", "lo", "hi", 5)).alias("j", "basis"))


def cyclic_basis(spark, d):
    g = st.grid(spark, d, ["Price"])
    b = features.spline_basis(F.col("hour").cast("double"), F.lit(0.0), F.lit(24.0), 6, cyclic=True)
    return g.select("zone", "local_date", "hour", F.posexplode(b).alias("j", "basis"))


def tensor_basis(spark, d):
    g = st.grid(spark, d, ["Price"])
    hours = features.spline_basis(F.col("hour").cast("double"), F.lit(0.0), F.lit(24.0), 4, cyclic=True)
    days = features.spline_basis(F.weekday("local_date").cast("double"), F.lit(0.0), F.lit(7.0), 4, cyclic=True)
    return g.select("zone", "local_date", "hour", F.posexplode(features.tensor_basis(hours, days)).alias("j", "basis"))


def pieces_sql(distance: str, t: str) -> str:
    return (f"CASE {distance} WHEN 0 THEN (1 - {t}) ** 3 / 6 WHEN 1 THEN (3 * {t} ** 3 - 6 * {t} ** 2 + 4) / 6 "
            f"WHEN 2 THEN (-3 * {t} ** 3 + 3 * {t} ** 2 + 3 * {t} + 1) / 6 WHEN 3 THEN {t} ** 3 / 6 ELSE 0.0 END")


REACH = 36 * 3600


def origin_range_history(spark, d):
    """Origins at the first event of each day, wherever it falls, and the raw events of the 36 hours before."""
    events = st.table(spark, d, "events").select(F.col("event_type").alias("zone"), F.col("ts").alias("time_utc"), "value")
    origins = events.groupBy("zone", F.col("time_utc").cast("date").alias("day")).agg(F.min("time_utc").alias("origin")).drop("day")
    return features.range_summary(origins, events, REACH, "value")


FEATURE_QUERIES = [
    Query("origin_range_history", origin_range_history, f"""WITH e AS (SELECT event_type AS zone, ts, value FROM events),
o AS (SELECT zone, min(ts) AS origin FROM e GROUP BY zone, CAST(ts AS DATE))
SELECT o.zone, origin, count(e.value) AS history_rows, avg(e.value) AS history_mean, min(e.ts) AS history_first,
       max(e.ts) AS history_last
FROM o LEFT JOIN e ON e.zone = o.zone AND e.ts < o.origin AND e.ts >= o.origin - INTERVAL {REACH} SECOND GROUP BY 1, 2""",
          "history_mean", "origin history_first history_last"),
    Query("hourly_features", lambda s, d: features.hourly_features(with_weather(s, d), SPEC),
          f"WITH {JOINED_SQL}\n{design_sql(SPEC)}", feature_names(SPEC), "local_date"),
    Query("hourly_features_diff", lambda s, d: features.hourly_features(st.grid(s, d), SPEC_DIFF),
          f"""WITH {st.GRID_SQL}, x AS (SELECT *, Price - lag(Price, 24) OVER w AS deltaPrice FROM grid WINDOW {W})
{design_sql(SPEC_DIFF, 'x')}""", feature_names(SPEC_DIFF), "local_date"),
    Query("hourly_extras", hourly_extras, EXTRAS_SQL, " ".join(["Price", "Price_lag_1", "Load_DA_lag_0", *EXTRA_NAMES]),
          "local_date"),
    Query("daily_matrix", matrix(), f"WITH {st.GRID_SQL},\n{DAY0} SELECT {CELLS}, Price, {MATRIX_LAGS} FROM x WINDOW {W}",
          MATRIX_NAMES, "local_date"),
    Query("daily_matrix_demeaned", matrix(demean="same_day"), f"""WITH {st.GRID_SQL},\n{DAY0}
SELECT {CELLS}, Price, Price - m AS P_center, m AS P_daily_mean, {MATRIX_LAGS} FROM x WINDOW {W}""",
          MATRIX_NAMES + " P_center P_daily_mean", "local_date"),
    Query("daily_matrix_noleak", matrix(demean="lagged"), f"""WITH {st.GRID_SQL},\n{DAY0}
SELECT {CELLS}, Price, Price - m AS P_center, lag(m, 24) OVER w AS P_daily_mean, {MATRIX_LAGS} FROM x WINDOW {W}""",
          MATRIX_NAMES + " P_center P_daily_mean", "local_date"),
    Query("daily_matrix_diff", matrix_diff, DIFF_SQL, " ".join(DIFF_NAMES), "local_date"),
    Query("daily_matrix_wide", matrix_wide, f"""WITH {st.GRID_SQL},\n{DAY0},
r AS (SELECT {CELLS}, Price, {MATRIX_LAGS} FROM x WINDOW {W})
SELECT zone, local_date, {', '.join(f'max(CASE WHEN hour = {h} THEN {c} END) AS {c}_s{h}' for h in range(24)
                                    for c in ('Price', 'Price_lag_1'))},
max(WD_6) AS WD_6, max(Coal_lag_2) AS Coal_lag_2 FROM r GROUP BY 1, 2""",
          " ".join([*[f"{c}_s{h}" for h in range(24) for c in ("Price", "Price_lag_1")], "Coal_lag_2"]), "local_date"),
    Query("zscore", zscore, f"""WITH {st.DAILY_SQL},
s AS (SELECT zone, avg(value) AS mv, stddev_samp(value) AS sv, avg(n) AS mn, stddev_samp(n) AS sn FROM daily
      WHERE local_date < (SELECT CAST(max(o_orderdate) AS DATE) - 365 FROM orders) GROUP BY 1)
SELECT d.*, (value - mv) / coalesce(nullif(sv, 0), 1) AS value_z, (n - mn) / coalesce(nullif(sn, 0), 1) AS n_z
FROM daily d JOIN s ON s.zone = d.zone""", "value n value_z n_z", "local_date"),
    Query("zscore_window", lambda s, d: features.rolling_zscore(st.grid(s, d, ["Price"]), "Price", 5),
          f"""WITH {st.GRID_SQL} SELECT {CELLS}, Price, CASE WHEN count(Price) OVER f = 5 THEN
(Price - avg(Price) OVER f) / coalesce(nullif(stddev_samp(Price) OVER f, 0), 1) END AS z FROM grid
WINDOW f AS (PARTITION BY zone, hour ORDER BY local_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
          "Price z", "local_date"),
    Query("train_test_slice", train_test, f"""WITH {st.DAILY_SQL},
x AS (SELECT *, lag(value) OVER (PARTITION BY zone ORDER BY local_date) AS x1 FROM daily),
p AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY local_date) - 1 AS i FROM x
      WHERE value IS NOT NULL AND x1 IS NOT NULL AND n IS NOT NULL),
c AS (SELECT * FROM p WHERE i BETWEEN 20 AND 320),
s AS (SELECT zone, {', '.join(f'avg({c}) AS m_{c}, coalesce(nullif(stddev_samp({c}), 0), 1) AS s_{c}'
                              for c in ('x1', 'n', 'value'))} FROM c WHERE i < 320 GROUP BY 1)
SELECT c.zone, c.local_date, CASE WHEN i < 320 THEN 'train' ELSE 'test' END AS part,
{', '.join(f'(c.{v} - s.m_{v}) / s.s_{v} AS {v}_z' for v in ('x1', 'n', 'value'))} FROM c JOIN s ON s.zone = c.zone""",
          "x1_z n_z value_z", "local_date"),
    Query("origin_schedule", schedule("rolling"), schedule_sql("s"), "", "origin train_first train_last"),
    Query("origin_schedule_expanding", schedule("expanding"), schedule_sql("0"), "", "origin train_first train_last"),
    Query("origin_schedule_trimmed", schedule("trimmed"), schedule_sql(
        "s + CASE WHEN s = 0 THEN 0 ELSE 60 * ((s - 1) // 100 + 1) END"), "", "origin train_first train_last"),
    Query("origin_history", lambda s, d: features.origin_history(st.daily(s, d).select("zone", "local_date", "value"),
                                                                 "value", TRAIN_DAYS),
          f"""WITH {st.DAILY_SQL} SELECT zone, local_date, value, count(value) OVER f AS history_rows,
avg(value) OVER f AS history_mean FROM daily
WINDOW f AS (PARTITION BY zone ORDER BY local_date ROWS BETWEEN {TRAIN_DAYS} PRECEDING AND 1 PRECEDING)""",
          "value history_mean", "local_date", 4),
    Query("split_labels", split_labels, f"""WITH {st.DAILY_SQL}, o AS (SELECT *, (SELECT CAST(max(o_orderdate) AS DATE) - 3
  FROM orders) - local_date AS ahead FROM daily)
SELECT zone, local_date, value, n, CASE WHEN ahead < 0 THEN NULL WHEN ahead = 0 THEN 'forecast'
WHEN ahead <= 2 THEN 'validation' WHEN ahead <= 14 THEN 'short' ELSE 'long' END AS split FROM o""", "value n", "local_date"),
    Query("periodic_basis", periodic_basis, f"""WITH {st.DAILY_SQL},
u AS (SELECT zone, local_date, ((local_date - DATE '1970-01-01') % 365) / (365.24 / 6) AS u FROM daily)
SELECT zone, local_date, CAST(j AS INTEGER) AS j,
{pieces_sql('(((j + 3) % 6 - CAST(floor(u) AS BIGINT)) % 6 + 6) % 6', '(u - floor(u))')} AS basis FROM u, range(6) r(j)""",
          "basis", "local_date"),
    Query("spline_basis", spline_basis, f"""WITH {st.GRID_SQL},
r AS (SELECT zone, min(Price) AS lo, max(Price) AS hi FROM grid GROUP BY 1),
u AS (SELECT g.*, coalesce((Price - lo) / nullif(hi - lo, 0), 0) * 5 AS u FROM grid g JOIN r ON r.zone = g.zone
      WHERE Price IS NOT NULL),
v AS (SELECT *, least(CAST(floor(u) AS BIGINT), 4) AS i FROM u)
SELECT {CELLS}, CAST(j AS INTEGER) AS j, {pieces_sql('(j - i)', '(u - i)')} AS basis FROM v, range(8) r(j)""",
          "basis", "local_date"),
    Query("cyclic_basis", cyclic_basis, f"""WITH {st.GRID_SQL},
v AS (SELECT *, hour / 4.0 AS u, CAST(floor(hour / 4.0) AS BIGINT) AS i FROM grid)
SELECT {CELLS}, CAST(j AS INTEGER) AS j, {pieces_sql('((j - i) % 6 + 6) % 6', '(u - i)')} AS basis FROM v, range(6) r(j)""",
          "basis", "local_date"),
    Query("tensor_basis", tensor_basis, f"""WITH {st.GRID_SQL},
v AS (SELECT *, hour / 6.0 AS u, CAST(floor(hour / 6.0) AS BIGINT) AS i, (isodow(local_date) - 1) * 4 / 7.0 AS s,
      CAST(floor((isodow(local_date) - 1) * 4 / 7.0) AS BIGINT) AS k FROM grid)
SELECT {CELLS}, CAST(a * 4 + b AS INTEGER) AS j, ({pieces_sql('((a - i) % 4 + 4) % 4', '(u - i)')})
* ({pieces_sql('((b - k) % 4 + 4) % 4', '(s - k)')}) AS basis FROM v, range(4) r(a), range(4) q(b)""",
          "basis", "local_date"),
]
