"""Complete UTC grid and the local grid without clock changes."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.functions.clock import to_local
from hourgrid.operators import etl, timegrid
from hourgrid.plans import standin as st
from hourgrid.plans.registry import Query

SPRING, FALL = 80, 290  # shifts that move the hourly series over 2024-03-31 and 2024-10-27
VARS = ["Price", "Load_A"]


def _shifted(spark, d, days):
    return st.hourly(spark, d, days).select("zone", "time_utc", *VARS)


def utc_grid(spark, d):
    hourly = st.hourly(spark, d).select("zone", "time_utc", "Price")
    return timegrid.utc_grid(hourly, steps=etl.modal_step(hourly))


def _bounds(spark, d, days):
    shift = F.make_dt_interval(F.lit(days))
    return st.table(spark, d, "events").groupBy(F.col("event_type").alias("zone")).agg(
        (F.min("ts") + shift).alias("first"), (F.max("ts") + shift).alias("last"))


def local_grid(days, tz="CET"):
    return lambda spark, d: timegrid.local_grid(_shifted(spark, d, days), VARS, tz, bounds=_bounds(spark, d, days))


def dst_edges(spark, d):
    """The first and last local day are partial; the result is cut to the days between them."""
    ends = st.table(spark, d, "events").agg(F.date_add(to_local(F.min("ts"), "CET").cast("date"), 1).cast("string"),
                                            F.date_sub(to_local(F.max("ts"), "CET").cast("date"), 1).cast("string")).first()
    return timegrid.local_grid(_shifted(spark, d, 0), VARS, first_day=ends[0], last_day=ends[1])


def dst_days(spark, d):
    dates = st.hourly(spark, d, FALL).select(F.col("time_utc").cast("date").alias("local_date")).unionAll(
        st.hourly(spark, d, SPRING).select(F.col("time_utc").cast("date"))).distinct()
    return timegrid.change_days(dates)


def half_hourly(spark, d):
    """Half-hour series that covers the spring change."""
    events = st.table(spark, d, "events")
    ts = F.col("ts") + F.make_dt_interval(F.lit(SPRING))
    half = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                (F.floor(F.minute(ts) / 30) * 30).cast("int"), F.lit(0))
    rows = events.groupBy(F.col("event_type").alias("zone"), half.alias("time_utc")).agg(F.avg("value").alias("Price"))
    return timegrid.local_grid(rows, ["Price"], slots=48)


def local_sql(days: int, slots: int = 24, tz: str = "CET", missing: int = 2) -> str:
    """Complete UTC grid first, then the rules of the two change days cell by cell; ``missing``: the hour that March lacks."""
    per = slots // 24
    step, shift = f"INTERVAL {60 // per} MINUTE", f"INTERVAL {days} DAY"
    values = ["Price"] if slots > 24 else VARS
    if slots > 24:
        series = f"""hourly AS (SELECT event_type AS zone, time_bucket({step}, ts + {shift}) AS time_utc,
  avg(value) AS Price FROM events GROUP BY 1, 2)"""
    else:
        series = st.hourly_sql(days)
    means = ", ".join(f"CASE WHEN count({v}) = count(*) THEN avg({v}) END AS {v}" for v in values)
    picked = ", ".join("g." + v for v in values)
    spring = "month(c.local_date) = 3 AND isodow(c.local_date) = 7 AND day(c.local_date) >= 25"

    def value(v: str) -> str:
        return (f"CASE WHEN {spring} AND c.hour // {per} = {missing} THEN a.{v} + (c.hour - {missing * per - 1}) "
                f"* (b.{v} - a.{v}) / {per + 1} ELSE x.{v} END AS {v}")
    return f"""WITH {series},
utc AS (SELECT z.zone, t.t AS time_utc FROM (SELECT zone, min(time_utc) AS lo, max(time_utc) AS hi FROM hourly GROUP BY 1) z,
        unnest(generate_series(z.lo, z.hi, {step})) AS t(t)),
loc AS (SELECT u.zone, timezone('{tz}', timezone('UTC', u.time_utc)) AS lt, {picked}
        FROM utc u LEFT JOIN hourly g ON g.zone = u.zone AND g.time_utc = u.time_utc),
cell AS (SELECT zone, CAST(lt AS DATE) AS local_date,
                CAST(hour(lt) * {per} + minute(lt) * {per} // 60 AS INTEGER) AS hour, {means} FROM loc GROUP BY 1, 2, 3),
full_days AS (SELECT z.zone, CAST(z.lo + to_days(CAST(n.n AS INTEGER)) AS DATE) AS local_date, CAST(h.h AS INTEGER) AS hour
  FROM (SELECT zone, min(local_date) AS lo, max(local_date) AS hi FROM cell GROUP BY 1) z,
       unnest(range(0, CAST(z.hi - z.lo AS BIGINT) + 1)) AS n(n), range({slots}) AS h(h))
SELECT c.zone, c.local_date, c.hour, {', '.join(value(v) for v in values)}
FROM full_days c LEFT JOIN cell x ON x.zone = c.zone AND x.local_date = c.local_date AND x.hour = c.hour
LEFT JOIN cell a ON a.zone = c.zone AND a.local_date = c.local_date AND a.hour = {missing * per - 1}
LEFT JOIN cell b ON b.zone = c.zone AND b.local_date = c.local_date AND b.hour = {(missing + 1) * per}"""


GRID_QUERIES = [
    Query("local_grid", local_grid(SPRING), local_sql(SPRING), "Price Load_A", "local_date"),
    Query("dst_spring", local_grid(SPRING + 5), local_sql(SPRING + 5), "Price Load_A", "local_date"),
    Query("dst_fall", local_grid(FALL), local_sql(FALL), "Price Load_A", "local_date"),
    Query("dst_subhourly", half_hourly, local_sql(SPRING, 48), "Price", "local_date"),
    Query("dst_london", local_grid(SPRING, "Europe/London"), local_sql(SPRING, 24, "Europe/London", 1), "Price Load_A", "local_date"),
    Query("dst_helsinki", local_grid(FALL, "Europe/Helsinki"), local_sql(FALL, 24, "Europe/Helsinki", 3), "Price Load_A", "local_date"),
    Query("dst_edges", dst_edges, f"""WITH g AS ({local_sql(0)}) SELECT * FROM g
WHERE local_date > (SELECT CAST(timezone('CET', timezone('UTC', min(ts))) AS DATE) FROM events)
  AND local_date < (SELECT CAST(timezone('CET', timezone('UTC', max(ts))) AS DATE) FROM events)""", "Price Load_A", "local_date"),
    Query("utc_grid", utc_grid, f"""WITH {st.hourly_sql()}
SELECT z.zone, t.t AS time_utc, h.Price
FROM (SELECT zone, min(time_utc) AS lo, max(time_utc) AS hi FROM hourly GROUP BY 1) z,
     unnest(generate_series(z.lo, z.hi, INTERVAL 1 HOUR)) AS t(t)
LEFT JOIN hourly h ON h.zone = z.zone AND h.time_utc = t.t""", "Price", "time_utc"),
    Query("local_hour", lambda s, d: timegrid.with_local_time(st.table(s, d, "events").select(
        "event_id", (F.col("ts") + F.make_dt_interval(F.lit(FALL))).alias("time_utc"))),
          f"""SELECT event_id, ts + INTERVAL {FALL} DAY AS time_utc,
CAST(timezone('CET', timezone('UTC', ts + INTERVAL {FALL} DAY)) AS DATE) AS local_date,
CAST(hour(timezone('CET', timezone('UTC', ts + INTERVAL {FALL} DAY))) AS INTEGER) AS hour FROM events""",
          "", "time_utc local_date"),
    Query("dst_days", dst_days, f"""SELECT DISTINCT local_date,
month(local_date) = 3 AND isodow(local_date) = 7 AND day(local_date) >= 25 AS spring,
month(local_date) = 10 AND isodow(local_date) = 7 AND day(local_date) >= 25 AS fall
FROM (SELECT CAST(ts + INTERVAL {FALL} DAY AS DATE) AS local_date FROM events
      UNION ALL SELECT CAST(ts + INTERVAL {SPRING} DAY AS DATE) FROM events)""", "", "local_date"),
    Query("test_split", lambda s, d: timegrid.split_last_days(st.grid(s, d, ["Price"]), 7),
          f"""WITH {st.GRID_SQL} SELECT zone, local_date, hour, Price,
local_date > (SELECT max(local_date) FROM grid) - 7 AS is_test FROM grid""", "Price", "local_date"),
]
