"""Market-shaped views of the generic test tables, as DataFrames and as SQL with the same meaning.

* ``events``   -> hourly zone series (zone = event_type); gaps are real.
* ``orders``   -> daily zone series (zone = o_orderpriority) and daily quotes.
* ``lineitem`` -> long market facts, with ``supplier`` expanded to the series catalogue.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.clock import day_hour
from hourgrid.operators import blocks, etl, timegrid
from hourgrid.sources.tables import read_parquet

REGRESSORS = ["Price", "Load_A", "Load_DA", "WindOn_DA", "WindOff_DA", "Solar_DA", "Coal", "NGas", "Oil", "EUA"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


# ---- hourly series --------------------------------------------------------------------------------------------------

def hourly(spark: SparkSession, sf_dir: str, shift_days: int = 0) -> DataFrame:
    """One row per zone and hour that has events, all modelling columns."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "zone")
    ts = F.col("ts") + F.make_dt_interval(F.lit(shift_days)) if shift_days else F.col("ts")
    k = F.get_json_object("props", "$.k").cast("double")
    user = F.col("user_id").cast("double")
    return etl.by_hour(events.withColumn("time_utc", ts), ["zone"], "time_utc", {
        "Price": F.avg("value"), "Load_A": F.sum("value"), "Load_DA": F.count(F.lit(1)).cast("double"),
        "WindOn_DA": F.avg(k), "WindOff_DA": F.max("value"), "Solar_DA": F.min("value"), "Coal": F.avg(user),
        "NGas": F.max(user), "Oil": F.min(user), "EUA": F.sum(user)})


def hourly_sql(shift_days: int = 0) -> str:
    ts = f"(ts + INTERVAL {shift_days} DAY)" if shift_days else "ts"
    return f"""hourly AS (
  SELECT event_type AS zone, date_trunc('hour', {ts}) AS time_utc, avg(value) AS Price, sum(value) AS Load_A,
         CAST(count(*) AS DOUBLE) AS Load_DA, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS WindOn_DA,
         max(value) AS WindOff_DA, min(value) AS Solar_DA, avg(CAST(user_id AS DOUBLE)) AS Coal,
         max(CAST(user_id AS DOUBLE)) AS NGas, min(CAST(user_id AS DOUBLE)) AS Oil,
         sum(CAST(user_id AS DOUBLE)) AS EUA
  FROM events GROUP BY 1, 2)"""


def hourly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly rows keyed by (zone, local_date, hour) on the UTC clock."""
    return hourly(spark, sf_dir).withColumns({"local_date": F.col("time_utc").cast("date"),
                                              "hour": F.hour("time_utc")})


def grid(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Complete (zone, local_date, hour) grid of the hourly series; hours without events are null."""
    cells = hourly_cells(spark, sf_dir).select("zone", "local_date", "hour", *(columns or REGRESSORS))
    bounds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("zone")).agg(
        F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last"))
    return timegrid.complete_days(cells, bounds=bounds)


GRID_SQL = hourly_sql() + f""",
cells AS (
  SELECT b.zone, CAST(b.lo + to_days(CAST(d.d AS INTEGER)) AS DATE) AS local_date, CAST(h.h AS INTEGER) AS hour
  FROM (SELECT event_type AS zone, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events GROUP BY 1) b,
       unnest(range(0, CAST(b.hi - b.lo AS BIGINT) + 1)) AS d(d), range(24) AS h(h)),
grid AS (
  SELECT c.zone, c.local_date, c.hour, {', '.join('h.' + c for c in REGRESSORS)}
  FROM cells c LEFT JOIN hourly h ON h.zone = c.zone AND h.time_utc = c.local_date + to_hours(c.hour))"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("zone"), F.col("ts").cast("date").alias("local_date"), F.hour("ts").alias("hour"))
    return rows.agg(F.avg(k).alias("Temp"), F.max(k).alias("Solar"), F.min(k).alias("WindS"))


WEATHER_SQL = """weather AS (
  SELECT event_type AS zone, CAST(ts AS DATE) AS local_date, CAST(hour(ts) AS INTEGER) AS hour,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS Temp,
         max(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS Solar,
         min(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS WindS
  FROM events GROUP BY 1, 2, 3)"""


# ---- daily series ---------------------------------------------------------------------------------------------------

def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete daily series per zone: mean and number of orders; days without orders are null."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy(F.col("o_orderpriority").alias("zone"), F.col("o_orderdate").cast("date").alias("local_date"))
    cells = rows.agg(F.avg("o_totalprice").alias("value"), F.count(F.lit(1)).cast("double").alias("n"))
    bounds = orders.groupBy(F.col("o_orderpriority").alias("zone")).agg(
        F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    return timegrid.complete_days(cells.withColumn("hour", F.lit(0)), slots=1, bounds=bounds).drop("hour")


DAILY_SQL = """daily AS (
  SELECT c.zone, c.local_date, o.value, o.n
  FROM (SELECT b.zone, CAST(b.lo + to_days(CAST(d.d AS INTEGER)) AS DATE) AS local_date
        FROM (SELECT o_orderpriority AS zone, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi
              FROM orders GROUP BY 1) b,
             unnest(range(0, CAST(b.hi - b.lo AS BIGINT) + 1)) AS d(d)) c
  LEFT JOIN (SELECT o_orderpriority AS zone, CAST(o_orderdate AS DATE) AS local_date, avg(o_totalprice) AS value,
                    CAST(count(*) AS DOUBLE) AS n
             FROM orders GROUP BY 1, 2) o
  ON o.zone = c.zone AND o.local_date = c.local_date)"""


# ---- several years of slots -----------------------------------------------------------------------------------------

SLOTS = 3


def slot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two zones with three slots a day over all shipping days, all modelling columns, gaps filled by the last value."""
    lines = table(spark, sf_dir, "lineitem")
    zone = F.concat(F.lit("Z"), F.pmod("l_suppkey", F.lit(2)).cast("string"))
    day, slot = F.col("l_shipdate").cast("date"), F.pmod("l_partkey", F.lit(SLOTS)).cast("int")
    rows = lines.groupBy(zone.alias("zone"), day.alias("local_date"), slot.alias("hour")).agg(
        (F.avg("l_extendedprice") / 1000).alias("Price"), F.sum("l_quantity").cast("double").alias("Load_DA"),
        (100 * F.avg("l_discount")).alias("Solar_DA"), (100 * F.avg("l_tax")).alias("WindOn_DA"),
        F.max("l_quantity").cast("double").alias("WindOff_DA"), (F.min("l_extendedprice") / 1000).alias("Coal"),
        (F.max("l_extendedprice") / 1000).alias("NGas"), F.avg("l_quantity").cast("double").alias("Oil"),
        F.count(F.lit(1)).cast("double").alias("EUA"))
    bounds = lines.groupBy(zone.alias("zone")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    cells = timegrid.complete_days(rows, slots=SLOTS, bounds=bounds).withColumn("at", day_hour("local_date", "hour"))
    return blocks.forward_fill(cells, [c for c in REGRESSORS if c != "Load_A"], ["zone"], "at").drop("at")


SLOT_SQL = f"""slot_rows AS (
  SELECT 'Z' || CAST(l_suppkey % 2 AS VARCHAR) AS zone, CAST(l_shipdate AS DATE) AS local_date,
         CAST(l_partkey % {SLOTS} AS INTEGER) AS hour, avg(l_extendedprice) / 1000 AS Price
  FROM lineitem GROUP BY 1, 2, 3),
slot_cells AS (
  SELECT b.zone, CAST(b.lo + to_days(CAST(d.d AS INTEGER)) AS DATE) AS local_date, CAST(h.h AS INTEGER) AS hour
  FROM (SELECT 'Z' || CAST(l_suppkey % 2 AS VARCHAR) AS zone, CAST(min(l_shipdate) AS DATE) AS lo,
               CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem GROUP BY 1) b,
       unnest(range(0, CAST(b.hi - b.lo AS BIGINT) + 1)) AS d(d), range({SLOTS}) AS h(h)),
slot_series AS (
  SELECT c.zone, c.local_date, c.hour, last_value(r.Price IGNORE NULLS) OVER (PARTITION BY c.zone
    ORDER BY c.local_date, c.hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
  FROM slot_cells c LEFT JOIN slot_rows r ON r.zone = c.zone AND r.local_date = c.local_date AND r.hour = c.hour)"""


# ---- forecasts ------------------------------------------------------------------------------------------------------

NAIVE_DAYS = [1, 2, 7]


def filled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price grid with gaps filled by the last known price, so that days are whole."""
    cells = grid(spark, sf_dir, ["Price"]).withColumn("at", day_hour("local_date", "hour"))
    return blocks.forward_fill(cells, ["Price"], ["zone"], "at").drop("at")


def _wide_forecasts(spark: SparkSession, sf_dir: str, filled: bool) -> DataFrame:
    prices = filled_grid(spark, sf_dir) if filled else grid(spark, sf_dir, ["Price"])
    return blocks.windowed(prices, max(NAIVE_DAYS),
                           lambda w: {f"naive_{k}": F.lag("Price", 24 * k).over(w) for k in NAIVE_DAYS})


def _long_forecasts(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["zone", "local_date", "hour", "Price"], [f"naive_{k}" for k in NAIVE_DAYS], "model",
                        "y_pred").withColumnRenamed("Price", "y_true")


def forecasts(spark: SparkSession, sf_dir: str, filled: bool = False) -> DataFrame:
    """Naive experts: the price of the same hour 1, 2 and 7 days ago."""
    return _long_forecasts(_wide_forecasts(spark, sf_dir, filled))


def whole_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in which the truth and all experts are known."""
    return _long_forecasts(etl.complete_rows(_wide_forecasts(spark, sf_dir, False)))


FILLED_SQL = GRID_SQL + """,
filled AS (SELECT zone, local_date, hour, last_value(Price IGNORE NULLS) OVER (PARTITION BY zone
  ORDER BY local_date, hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Price FROM grid)"""


def forecast_sql(source: str) -> str:
    return f""",
lagged AS (
  SELECT zone, local_date, hour, Price,
         lag(Price, 24) OVER w AS naive_1, lag(Price, 48) OVER w AS naive_2, lag(Price, 168) OVER w AS naive_7
  FROM {source} WINDOW w AS (PARTITION BY zone ORDER BY local_date, hour)),
forecasts AS (
  SELECT zone, local_date, hour, 'naive_1' AS model, Price AS y_true, naive_1 AS y_pred FROM lagged
  UNION ALL SELECT zone, local_date, hour, 'naive_2', Price, naive_2 FROM lagged
  UNION ALL SELECT zone, local_date, hour, 'naive_7', Price, naive_7 FROM lagged)"""


FORECAST_SQL = GRID_SQL + forecast_sql("grid")
FILLED_FORECAST_SQL = FILLED_SQL + forecast_sql("filled")
WHOLE_SQL = FORECAST_SQL + """,
whole AS (
  SELECT f.* FROM forecasts f JOIN lagged g USING (zone, local_date, hour)
  WHERE g.Price + g.naive_1 + g.naive_2 + g.naive_7 IS NOT NULL)"""


# ---- long market facts ----------------------------------------------------------------------------------------------

# What the line number, status and flag of a fact stand for.
NAMES = ["Generation", "Load", "Price", "PhysicalFlow", "FillingRateHydro", "InstalledCapacity", "Unavailability"]
KINDS = ["Actual", "DayAhead"]
PRODUCTS = ["Solar", "Wind Onshore", "Wind Offshore"]
OUTAGES = ["Consumption", "Generation", "Production", "Transmission"]
PER_SUPPLIER = 6 * len(NAMES)


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series catalogue: 42 series per supplier."""
    k = F.col("k")

    def pick(values: list[str], at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    series = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(PER_SUPPLIER - 1))).alias("k"))
    name, code = F.floor(k / 6), F.pmod(k, F.lit(6))
    return series.select(
        (F.col("s_suppkey") * PER_SUPPLIER + k).alias("TimeSeriesID"), pick(NAMES, name).alias("Name"),
        F.when(name == 6, pick(OUTAGES, F.pmod(code, F.lit(4)))).otherwise(pick(KINDS, F.floor(code / 3))).alias("Type"),
        pick(PRODUCTS, F.pmod(code, F.lit(3))).alias("ProductionType"),
        F.when(F.pmod("s_nationkey", F.lit(6)) < 5, F.concat(
            F.lit("NO"), (F.pmod("s_nationkey", F.lit(6)) + 1).cast("string"))).alias("MapCode"),
        F.when(F.pmod("s_suppkey", F.lit(10)) == 9, "CTA").otherwise("BZN").alias("MapTypeCode"),
        F.when(code < 3, "PT60M").otherwise("PT15M").alias("ResolutionCode"))


def vals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-hourly facts with duplicates."""
    li = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_linestatus") == "O", 3).otherwise(0) + F.when(
        F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    minutes = F.pmod("l_partkey", F.lit(3)) * 60 + F.pmod("l_orderkey", F.lit(4)) * 15
    return li.select(
        (F.col("l_suppkey") * PER_SUPPLIER + (F.col("l_linenumber") - 1) * 6 + code).alias("TimeSeriesID"),
        (F.col("l_shipdate") + F.make_dt_interval(mins=minutes.cast("int"))).alias("DateTime"),
        F.col("l_extendedprice").alias("Value"))


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


SPEC_SQL = f"""spec AS (
  SELECT s_suppkey * {PER_SUPPLIER} + k AS TimeSeriesID, {_case('k // 6', NAMES)} AS Name,
         CASE WHEN k // 6 = 6 THEN {_case('(k % 6) % 4', OUTAGES)} ELSE {_case('(k % 6) // 3', KINDS)} END AS Type,
         {_case('(k % 6) % 3', PRODUCTS)} AS ProductionType,
         CASE WHEN s_nationkey % 6 < 5 THEN 'NO' || CAST(s_nationkey % 6 + 1 AS VARCHAR) END AS MapCode,
         CASE WHEN s_suppkey % 10 = 9 THEN 'CTA' ELSE 'BZN' END AS MapTypeCode,
         CASE WHEN k % 6 < 3 THEN 'PT60M' ELSE 'PT15M' END AS ResolutionCode
  FROM supplier, range({PER_SUPPLIER}) r(k))"""
VALS_SQL = f"""vals AS (
  SELECT l_suppkey * {PER_SUPPLIER} + (l_linenumber - 1) * 6 + CASE WHEN l_linestatus = 'O' THEN 3 ELSE 0 END
           + CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS TimeSeriesID,
         l_shipdate + to_minutes((l_partkey % 3) * 60 + (l_orderkey % 4) * 15) AS DateTime, l_extendedprice AS Value
  FROM lineitem)"""
FACTS_SQL = SPEC_SQL + ",\n" + VALS_SQL + """,
facts AS (SELECT v.DateTime, v.Value, s.* FROM vals v JOIN spec s ON s.TimeSeriesID = v.TimeSeriesID
          WHERE s.MapTypeCode = 'BZN')"""

# Quote name for each order priority.
QUOTE_OF = {"1-URGENT": "coal_fM_01", "2-HIGH": "gas_fM_01", "3-MEDIUM": "oil_fM_01", "4-NOT SPECIFIED": "EUA_fM_01",
            "5-LOW": "USD_EUR"}


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quotes on weekdays: Date as text, name, Value, RIC."""
    orders = table(spark, sf_dir, "orders")
    name = F.create_map(*[F.lit(x) for pair in QUOTE_OF.items() for x in pair])[F.col("o_orderpriority")]
    day = F.col("o_orderdate").cast("date")
    return orders.filter(F.weekday("o_orderdate") < 5).groupBy(
        day.cast("string").alias("Date"), name.alias("name")).agg(
        F.avg("o_totalprice").alias("Value"), F.max("o_orderstatus").alias("RIC"))


QUOTES_SQL = f"""quotes AS (
  SELECT CAST(o_orderdate AS DATE) AS Date, CASE o_orderpriority """ + " ".join(
    f"WHEN '{p}' THEN '{n}'" for p, n in QUOTE_OF.items()) + """ END AS name, avg(o_totalprice) AS Value
  FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1, 2),
wide_quotes AS (
  SELECT *, oil_fM_01 / nullif(USD_EUR, 0) AS oil_fM_01_EUR, coal_fM_01 / nullif(USD_EUR, 0) AS coal_fM_01_EUR
  FROM (SELECT Date, """ + ", ".join(f"max(CASE WHEN name = '{n}' THEN Value END) AS {n}" for n in etl.QUOTES) + """
        FROM quotes GROUP BY 1))"""


def wide_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.prepare_quotes(quotes(spark, sf_dir))


# Holidays inside the span of the hourly series, one of another country and one outside the years.
HOLIDAYS = [("2024-01-01", "NO"), ("2024-01-06", "SE"), ("2024-01-13", "NO"), ("2024-01-14", "NO"),
            ("2024-01-27", "NO"), ("2018-01-20", "NO")]


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLIDAYS, "d string, CountryCode string").select(
        F.col("d").cast("date").alias("Date"), "CountryCode")


HOLIDAYS_SQL = "holidays(Date, CountryCode) AS (VALUES " + ", ".join(
    f"(DATE '{d}', '{c}')" for d, c in HOLIDAYS) + ")"
