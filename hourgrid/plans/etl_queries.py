"""Scans, projections, filters, joins, pivots and hourly roll-ups."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hourgrid.functions.clock import calendar_parts, day_hour, hour_floor
from hourgrid.functions.numeric import null_safe_total
from hourgrid.operators import blocks, etl, features, scoring
from hourgrid.plans import standin as st
from hourgrid.plans.registry import Query
from hourgrid.session import use_checkpoint_folder
from hourgrid.sources.tables import hourly_arrays_to_rows
from hourgrid.streaming import rollup

Y0 = Y1 = None  # the years of the data, whatever they are


def _facts(spark, d):
    """All BZN facts with their catalogue columns."""
    targets = st.spec(spark, d).filter(F.col("MapTypeCode") == "BZN")
    return etl.fetch_values(st.vals(spark, d), targets, Y0, Y1)


def _merged(spark, d, how="left"):
    """Price, load and generation of every zone and hour from one scan of the facts, with the quotes of the day."""
    market = etl.prepare_market(st.spec(spark, d), st.vals(spark, d), Y0, Y1, None, st.PRODUCTS, how=how)
    return etl.join_quotes(market, st.wide_quotes(spark, d), how)


def _chained(spark, d):
    """The same by a chain of inner joins."""
    spec, vals = st.spec(spark, d), st.vals(spark, d)
    return etl.merge_datasets(etl.prepare_price(spec, vals, Y0, Y1), etl.prepare_load(spec, vals, Y0, Y1),
                              etl.prepare_generation(spec, vals, Y0, Y1, products=st.PRODUCTS),
                              st.wide_quotes(spark, d), "inner")


def _market(spark, d):
    """The merged table of the zones that have a code."""
    spec = st.spec(spark, d).filter(F.col("MapCode").isNotNull())
    market = etl.prepare_market(spec, st.vals(spark, d), Y0, Y1, None, st.PRODUCTS)
    return etl.join_quotes(market, st.wide_quotes(spark, d))


GEN = {f"{p.replace(' ', '_')}_{s}": (k, p) for k, s in (("Actual", "A"), ("DayAhead", "DA")) for p in st.PRODUCTS}
GEN_SQL = f"""generation AS (
  SELECT MapCode, date_trunc('hour', DateTime) AS time_utc, {', '.join(f'sum({c}) AS {c}' for c in GEN)}
  FROM (SELECT MapCode, DateTime, {', '.join(
    f"avg(CASE WHEN Type = '{k}' AND ProductionType = '{p}' THEN Value END) AS {c}" for c, (k, p) in GEN.items())}
        FROM facts WHERE Name = 'Generation' GROUP BY 1, 2) GROUP BY 1, 2)"""
LOAD_SQL = """load AS (
  SELECT MapCode, date_trunc('hour', DateTime) AS time_utc, sum(Load_A) AS Load_A, sum(Load_DA) AS Load_DA
  FROM (SELECT MapCode, DateTime, avg(CASE WHEN Type = 'Actual' THEN Value END) AS Load_A,
               avg(CASE WHEN Type = 'DayAhead' THEN Value END) AS Load_DA
        FROM facts WHERE Name = 'Load' GROUP BY 1, 2) GROUP BY 1, 2)"""
PRICE_SQL = """price AS (
  SELECT MapCode, date_trunc('hour', DateTime) AS time_utc, avg(Price) AS Price
  FROM (SELECT MapCode, DateTime, avg(Value) AS Price FROM facts WHERE Name = 'Price' AND Type = 'DayAhead'
        GROUP BY 1, 2) GROUP BY 1, 2)"""
QUOTE_COLUMNS = [*etl.QUOTES, "oil_fM_01_EUR", "coal_fM_01_EUR"]
MERGE_SQL = f"""WITH {st.FACTS_SQL},\n{PRICE_SQL},\n{LOAD_SQL},\n{GEN_SQL},\n{st.QUOTES_SQL},
merged AS (
  SELECT p.MapCode, p.time_utc, p.Price, l.Load_A, l.Load_DA, {', '.join('g.' + c for c in GEN)},
         {', '.join('q.' + c for c in QUOTE_COLUMNS)}
  FROM price p LEFT JOIN load l ON l.MapCode = p.MapCode AND l.time_utc = p.time_utc
  LEFT JOIN generation g ON g.MapCode = p.MapCode AND g.time_utc = p.time_utc
  LEFT JOIN wide_quotes q ON q.Date = CAST(p.time_utc AS DATE))"""
MERGED_COLUMNS = " ".join(["Price", "Load_A", "Load_DA", *GEN, *QUOTE_COLUMNS])


def keyed_range_scan(spark, d):
    targets = etl.select_series(st.spec(spark, d), "Load", etl.TYPE_SUFFIX.keys())
    return etl.fetch_values(st.vals(spark, d), targets, 1996, 1999).select(
        "TimeSeriesID", "DateTime", "Value", "Type", "MapCode")


def soa_to_rows(spark, d):
    """Weather payloads are built from the events (one per zone and day), written as JSON text and taken apart."""
    fields = dict(zip(("temperature_2m", "shortwave_radiation", "windspeed_10m"), ("Temp", "Solar", "WindS")))
    rows = st.weather(spark, d).withColumn("time", F.concat(
        F.col("local_date").cast("string"), F.lit("T"), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")))
    hours = F.array_sort(F.collect_list(F.struct("time", *[F.col(c).alias(f) for f, c in fields.items()])))
    payload = rows.groupBy(F.col("zone").alias("MapCode"), "local_date").agg(hours.alias("h")).select(
        "MapCode", F.to_json(F.struct(F.struct(F.col("h.time").alias("time"), *[
            F.col(f"h.{f}").alias(f) for f in fields]).alias("hourly"))).alias("body"))
    schema = "hourly STRUCT<time: ARRAY<STRING>, " + ", ".join(f"{f}: ARRAY<DOUBLE>" for f in fields) + ">"
    parsed = payload.select("MapCode", F.from_json("body", schema).alias("p")).select("MapCode", "p.hourly")
    return hourly_arrays_to_rows(parsed, names=fields)


def zone_union(spark, d):
    """All zones in one scan, each row tagged with the zone its own key names."""
    zone = F.concat(F.lit("NO"), F.substring_index("o_orderpriority", "-", 1))
    return st.table(spark, d, "orders").select(zone.alias("MapCode"), F.col("o_orderdate").alias("time_utc"),
                                               F.col("o_totalprice").alias("Price"))


def fx_convert(spark, d):
    return st.wide_quotes(spark, d)


def row_total(spark, d):
    wide = st.grid(spark, d, ["Load_A", "Load_DA", "WindOn_DA"])
    return wide.select("zone", "local_date", "hour", null_safe_total(["Load_A", "Load_DA", "WindOn_DA"]).alias("total"))


def coerce_dates(spark, d):
    """Every seventh order number carries a malformed date text, which must drop out of the range; others have the texts
    of dates and time stamps."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.pmod("o_orderkey", F.lit(7))
    text = (F.when(kind == 0, F.concat(F.lit("n/a "), day)).when(kind == 1, F.concat(day, F.lit(" 00:00:00")))
            .when(kind == 2, F.concat(day, F.lit("T13:30:00.5"))).when(kind == 3, F.date_format("o_orderdate", "yyyy-M-d"))
            .otherwise(day))
    rows = st.table(spark, d, "orders").select("o_orderkey", text.alias("Date"))
    return etl.in_dates(rows.withColumn("Date", etl.coerce_date("Date")), "1996-01-01", "1999-01-01")


def merge_time_only(spark, d):
    prices = st.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("MapCode"), hour_floor(
        "l_shipdate").alias("time_utc")).agg(F.avg("l_extendedprice").alias("Price"))
    return etl.join_quotes(prices, st.wide_quotes(spark, d))


def holiday_query(spark, d):
    return features.holiday_dummy(st.grid(spark, d, ["Price"]).drop("Price"), st.holidays(spark), years=(2019, 2024))


def weather_join(spark, d):
    return features.join_weather(st.grid(spark, d, ["Price"]), st.weather(spark, d), ["Temp", "Solar", "WindS"])


def pivot_strict(spark, d):
    rows = st.quotes(spark, d).withColumn("Date", F.col("Date").cast("date"))
    return etl.pivot_strict(rows, "Date", etl.QUOTES)


def flow_hourly(spark, d):
    return etl.prepare_physical_flow(st.spec(spark, d), st.vals(spark, d), Y0, Y1)


def unavailability(spark, d):
    return etl.prepare_unavailability(st.spec(spark, d), st.vals(spark, d), Y0, Y1)


def modal_step(spark, d):
    return etl.modal_step(st.hourly(spark, d).select("zone", "time_utc"))


def ffill_zone(spark, d):
    cells = st.grid(spark, d, ["Price", "Load_A"]).withColumn("at", day_hour("local_date", "hour"))
    return blocks.forward_fill(cells, ["Price", "Load_A"], ["zone"], "at").drop("at")


def upsample_daily(spark, d):
    return etl.upsample_daily(st.daily(spark, d).select("zone", "local_date", "value"), "local_date")


def string_ops(spark, d):
    p = st.table(spark, d, "part")
    return p.select("p_partkey", F.replace("p_type", F.lit("A"), F.lit("_")).alias("replaced"),
                    F.startswith("p_name", F.lit("red")).alias("starts"), F.coalesce("p_brand", F.lit("")).alias("filled"),
                    F.lower("p_type").alias("lowered"), F.concat_ws("_", "p_name", "p_type").alias("joined"),
                    F.contains("p_name", F.lit("ring")).alias("has"))


def error_band(spark, d):
    errors = scoring.with_error(st.whole_forecasts(spark, d).filter(F.col("model") == "naive_1"))
    return scoring.errors_in_band(errors).select("zone", "local_date", "hour", "error")


def complete_days(spark, d):
    return etl.complete_groups(st.grid(spark, d, ["Price"]), ["zone", "local_date"], "Price")


def hourly_sum_stream(spark, d):
    """The roll-up as a stream over the events' files; state, progress and results lie in the checkpoint folder."""
    use_checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/hourly-sum-{uuid.uuid4().hex}"
    schema = st.table(spark, d, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    rows = files.select(F.col("event_type").alias("zone"), F.col("ts").alias("time_utc"), "value")
    query = rollup.write_changes(rollup.hourly_sums(rows, late_after="36500 days"), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return rollup.current(spark, f"{folder}/out")


TABLE_QUERIES = [
    Query("keyed_range_scan", keyed_range_scan, f"""WITH {st.SPEC_SQL},\n{st.VALS_SQL}
SELECT v.TimeSeriesID, v.DateTime, v.Value, s.Type, s.MapCode FROM vals v JOIN spec s ON s.TimeSeriesID = v.TimeSeriesID
WHERE s.Name = 'Load' AND s.Type IN ('Actual', 'DayAhead') AND s.MapTypeCode = 'BZN'
  AND year(v.DateTime) >= 1996 AND year(v.DateTime) < 1999""", "Value", "DateTime"),
    Query("soa_to_rows", soa_to_rows, f"""WITH {st.WEATHER_SQL}
SELECT zone AS MapCode, local_date + to_hours(hour) AS time_local, Temp, Solar, WindS FROM weather""",
          "Temp Solar WindS", "time_local"),
    Query("zone_union", zone_union, """SELECT 'NO' || split_part(o_orderpriority, '-', 1) AS MapCode,
  o_orderdate AS time_utc, o_totalprice AS Price FROM orders""", "Price", "time_utc"),
    Query("model_columns", lambda s, d: etl.build_training_table(_merged(s, d), fill=False), MERGE_SQL + """
SELECT MapCode AS zone, time_utc, Price, Load_A, Load_DA, Wind_Onshore_DA AS WindOn_DA, Wind_Offshore_DA AS WindOff_DA,
       Solar_DA, coal_fM_01_EUR AS Coal, gas_fM_01 AS NGas, oil_fM_01_EUR AS Oil, EUA_fM_01 AS EUA FROM merged""",
          "Price Load_A Load_DA WindOn_DA WindOff_DA Solar_DA Coal NGas Oil EUA", "time_utc"),
    Query("training_table", lambda s, d: etl.build_training_table(_market(s, d)), MERGE_SQL + """
SELECT MapCode AS zone, time_utc, Price, Load_A, Load_DA, Wind_Onshore_DA AS WindOn_DA, Wind_Offshore_DA AS WindOff_DA,
       Solar_DA, last_value(coal_fM_01_EUR IGNORE NULLS) OVER w AS Coal, last_value(gas_fM_01 IGNORE NULLS) OVER w AS NGas,
       last_value(oil_fM_01_EUR IGNORE NULLS) OVER w AS Oil, last_value(EUA_fM_01 IGNORE NULLS) OVER w AS EUA
FROM merged WHERE MapCode IS NOT NULL
WINDOW w AS (PARTITION BY MapCode ORDER BY time_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
          "Price Load_A Load_DA WindOn_DA WindOff_DA Solar_DA Coal NGas Oil EUA", "time_utc"),
    Query("fx_convert", fx_convert, f"WITH {st.QUOTES_SQL}\nSELECT * FROM wide_quotes", " ".join(QUOTE_COLUMNS), "Date"),
    Query("row_total", row_total, f"""WITH {st.GRID_SQL}
SELECT zone, local_date, hour, CAST(round(CAST(coalesce(Load_A, 0) + coalesce(Load_DA, 0)
  + coalesce(WindOn_DA, 0) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS total FROM grid""", "total", "local_date"),
    Query("complete_rows", lambda s, d: etl.complete_rows(st.grid(s, d)), f"""WITH {st.GRID_SQL}
SELECT * FROM grid WHERE {' AND '.join(c + ' IS NOT NULL' for c in st.REGRESSORS)}""",
          " ".join(st.REGRESSORS), "local_date"),
    Query("first_per_key", lambda s, d: etl.first_per_key(
        st.table(s, d, "events").select(F.col("event_type").alias("zone"), hour_floor("ts").alias("time_utc"), "ts",
                                        "event_id", "value"), ["zone", "time_utc"], ["ts", "event_id"]),
          """SELECT event_type AS zone, date_trunc('hour', ts) AS time_utc, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) = 1""",
          "value", "time_utc ts"),
    Query("unpivot_vars", lambda s, d: etl.unpivot(st.grid(s, d, ["Price", "Load_A", "Load_DA"]),
                                                   ["zone", "local_date", "hour"], ["Price", "Load_A", "Load_DA"]),
          f"""WITH {st.GRID_SQL} SELECT zone, local_date, hour, 'Price' AS variable, Price AS value FROM grid
UNION ALL SELECT zone, local_date, hour, 'Load_A', Load_A FROM grid
UNION ALL SELECT zone, local_date, hour, 'Load_DA', Load_DA FROM grid""", "value", "local_date"),
    # filters
    Query("catalog_filter", lambda s, d: etl.select_series(
        st.spec(s, d), "Generation", ["DayAhead", "Actual"], ["Solar", "Wind Onshore"], ["NO1", "NO2", "NO3"]),
          f"""WITH {st.SPEC_SQL} SELECT * FROM spec WHERE Name = 'Generation' AND Type IN ('DayAhead', 'Actual')
AND ProductionType IN ('Solar', 'Wind Onshore') AND MapCode IN ('NO1', 'NO2', 'NO3') AND MapTypeCode = 'BZN'"""),
    Query("prefix_codes", lambda s, d: etl.codes_with_prefix(st.spec(s, d), "NO"),
          f"WITH {st.SPEC_SQL} SELECT DISTINCT MapCode FROM spec WHERE starts_with(coalesce(MapCode, ''), 'NO')"),
    Query("distinct_codes", lambda s, d: etl.distinct_values(st.spec(s, d), "ResolutionCode"),
          f"WITH {st.SPEC_SQL} SELECT DISTINCT ResolutionCode FROM spec"),
    Query("date_range", lambda s, d: etl.in_dates(
        st.table(s, d, "orders"), "1996-03-01", "1999-01-01", "o_orderdate").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("Date"), "o_totalprice"),
          """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS Date, o_totalprice FROM orders
WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1999-01-01'""", "o_totalprice", "Date"),
    Query("coerce_dates", coerce_dates, """SELECT o_orderkey, Date FROM (
  SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' || CAST(o_orderdate AS VARCHAR)
                              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS Date FROM orders)
WHERE Date >= DATE '1996-01-01' AND Date < DATE '1999-01-01'""", "", "Date"),
    Query("complete_days", complete_days, f"""WITH {st.GRID_SQL} SELECT zone, local_date, hour, Price FROM grid
QUALIFY count(*) FILTER (Price IS NULL) OVER (PARTITION BY zone, local_date) = 0""", "Price", "local_date"),
    Query("error_band", error_band, f"""WITH {st.WHOLE_SQL} SELECT zone, local_date, hour, y_pred - y_true AS error
FROM whole WHERE model = 'naive_1' AND y_pred - y_true BETWEEN -30 AND 30""", "error", "local_date"),
    Query("distinct_gate", lambda s, d: etl.distinct_gate(
        st.grid(s, d, ["Price", "Load_DA"]).withColumn("weekday", F.weekday("local_date").cast("double") % 3),
        ["Price", "Load_DA", "weekday"]), f"""WITH {st.GRID_SQL}, c AS (
  SELECT zone, count(DISTINCT Price) AS p, count(DISTINCT Load_DA) AS l,
         count(DISTINCT (isodow(local_date) - 1) % 3) AS w FROM grid GROUP BY 1)
SELECT zone, 'Price' AS feature, p AS distinct_values, p >= 5 AS smooth FROM c
UNION ALL SELECT zone, 'Load_DA', l, l >= 5 FROM c UNION ALL SELECT zone, 'weekday', w, w >= 5 FROM c"""),
    # joins
    Query("fact_dim_join", _facts, f"""WITH {st.FACTS_SQL} SELECT TimeSeriesID, DateTime, Value, Name, Type,
ProductionType, MapCode, MapTypeCode, ResolutionCode FROM facts""", "Value", "DateTime"),
    Query("merge_zone_hour", _merged, MERGE_SQL + " SELECT * FROM merged", MERGED_COLUMNS, "time_utc"),
    Query("merge_zone_hour_inner", lambda s, d: _merged(s, d, "inner"), MERGE_SQL.replace("LEFT JOIN", "JOIN")
          + " SELECT * FROM merged", MERGED_COLUMNS, "time_utc"),
    Query("merge_chain_inner", _chained, MERGE_SQL.replace("LEFT JOIN", "JOIN") + " SELECT * FROM merged", MERGED_COLUMNS,
          "time_utc"),
    Query("merge_time_only", merge_time_only, f"""WITH {st.QUOTES_SQL}
SELECT l.MapCode, l.time_utc, l.Price, {', '.join('q.' + c for c in QUOTE_COLUMNS)}
FROM (SELECT l_returnflag AS MapCode, date_trunc('hour', l_shipdate) AS time_utc, avg(l_extendedprice) AS Price
      FROM lineitem GROUP BY 1, 2) l LEFT JOIN wide_quotes q ON q.Date = CAST(l.time_utc AS DATE)""",
          " ".join(["Price", *QUOTE_COLUMNS]), "time_utc"),
    Query("holiday_dummy", holiday_query, f"""WITH {st.HOLIDAYS_SQL},\n{st.GRID_SQL}
SELECT zone, local_date, hour, CAST(EXISTS (SELECT 1 FROM holidays h WHERE h.CountryCode = 'NO'
    AND year(h.Date) BETWEEN 2019 AND 2024
    AND g.local_date + to_hours(g.hour) >= h.Date - INTERVAL 12 HOUR
    AND g.local_date + to_hours(g.hour) <= h.Date + INTERVAL 1 DAY - INTERVAL 1 SECOND + INTERVAL 36 HOUR) AS INTEGER)
  AS is_holiday FROM grid g""", "", "local_date"),
    Query("weather_join", weather_join, f"""WITH {st.GRID_SQL},\n{st.WEATHER_SQL}
SELECT g.zone, g.local_date, g.hour, g.Price, w.Temp, w.Solar, w.WindS FROM grid g
LEFT JOIN weather w ON w.zone = g.zone AND w.local_date = g.local_date AND w.hour = g.hour""",
          "Price Temp Solar WindS", "local_date"),
    Query("semi_ids", lambda s, d: etl.with_ids(st.vals(s, d), etl.select_series(st.spec(s, d), "Price", ["DayAhead"])),
          f"""WITH {st.SPEC_SQL},\n{st.VALS_SQL} SELECT * FROM vals WHERE TimeSeriesID IN (
SELECT TimeSeriesID FROM spec WHERE Name = 'Price' AND Type = 'DayAhead' AND MapTypeCode = 'BZN')""",
          "Value", "DateTime"),
    # roll-ups and pivots
    Query("hourly_sum", lambda s, d: etl.roll_up_hourly(st.table(s, d, "events").select(
        F.col("event_type").alias("zone"), F.col("ts").alias("time_utc"), "value"), ["zone", "time_utc"], ["value"]),
          "SELECT event_type AS zone, date_trunc('hour', ts) AS time_utc, sum(value) AS value FROM events GROUP BY 1, 2",
          "value", "time_utc"),
    Query("hourly_sum_stream", hourly_sum_stream,
          "SELECT event_type AS zone, date_trunc('hour', ts) AS time_utc, sum(value) AS value FROM events GROUP BY 1, 2",
          "value", "time_utc"),
    Query("hourly_mean", lambda s, d: etl.roll_up_hourly(st.table(s, d, "events").select(
        F.col("event_type").alias("zone"), F.col("ts").alias("time_utc"), "value"), ["zone", "time_utc"], ["value"],
        "mean"),
          "SELECT event_type AS zone, date_trunc('hour', ts) AS time_utc, avg(value) AS value FROM events GROUP BY 1, 2",
          "value", "time_utc"),
    Query("pivot_two_level", lambda s, d: etl.prepare_generation(st.spec(s, d), st.vals(s, d), Y0, Y1,
                                                                 products=st.PRODUCTS),
          f"WITH {st.FACTS_SQL},\n{GEN_SQL} SELECT * FROM generation", " ".join(GEN), "time_utc"),
    Query("pivot_load", lambda s, d: etl.prepare_load(st.spec(s, d), st.vals(s, d), Y0, Y1),
          f"WITH {st.FACTS_SQL},\n{LOAD_SQL} SELECT * FROM load", "Load_A Load_DA", "time_utc"),
    Query("pivot_price", lambda s, d: etl.prepare_price(st.spec(s, d), st.vals(s, d), Y0, Y1),
          f"WITH {st.FACTS_SQL},\n{PRICE_SQL} SELECT * FROM price", "Price", "time_utc"),
    Query("pivot_strict", pivot_strict, f"WITH {st.QUOTES_SQL}\nSELECT Date, " + ", ".join(
        f"max(CASE WHEN name = '{n}' THEN Value END) AS {n}" for n in etl.QUOTES) + " FROM quotes GROUP BY 1",
          " ".join(etl.QUOTES), "Date"),
    Query("pivot_capacity", lambda s, d: etl.prepare_installed_capacity(st.spec(s, d), st.vals(s, d), Y0, Y1,
                                                                        st.PRODUCTS),
          f"WITH {st.FACTS_SQL} SELECT DateTime AS time_utc, " + ", ".join(
              f"avg(CASE WHEN ProductionType = '{p}' THEN Value END) AS {p.replace(' ', '_')}_InstCapac"
              for p in st.PRODUCTS) + " FROM facts WHERE Name = 'InstalledCapacity' GROUP BY 1",
          " ".join(f"{p.replace(' ', '_')}_InstCapac" for p in st.PRODUCTS), "time_utc"),
    Query("flow_hourly", flow_hourly, f"""WITH {st.FACTS_SQL} SELECT MapCode, date_trunc('hour', DateTime) AS time_utc,
sum(Value) AS PhysicalFlow FROM facts WHERE Name = 'PhysicalFlow' GROUP BY 1, 2""", "PhysicalFlow", "time_utc"),
    Query("unavailability", unavailability, f"""WITH {st.FACTS_SQL}, w AS (SELECT MapCode, DateTime, """ + ", ".join(
        f"avg(CASE WHEN Type = '{k}' THEN Value END) AS {n}" for k, n in etl.UNAVAILABILITY.items()) + """
FROM facts WHERE Name = 'Unavailability' GROUP BY 1, 2)
SELECT MapCode, date_trunc('hour', DateTime) AS time_utc, """ + ", ".join(
        f"sum({n}) AS {n}" for n in etl.UNAVAILABILITY.values()) + ", sum(CAST(round(CAST(" + " + ".join(
        f"coalesce({n}, 0)" for n in etl.UNAVAILABILITY.values()) + """ AS DECIMAL(18, 6)), 2) AS DOUBLE)) AS Total_Unavailability
FROM w GROUP BY 1, 2""", " ".join([*etl.UNAVAILABILITY.values(), "Total_Unavailability"]), "time_utc"),
    Query("level_series", lambda s, d: etl.prepare_filling_rate(st.spec(s, d), st.vals(s, d), Y0, Y1),
          f"""WITH {st.FACTS_SQL} SELECT DateTime AS time_utc, Value AS FillingRateHydro, MapCode FROM facts
WHERE Name = 'FillingRateHydro'""", "FillingRateHydro", "time_utc"),
    # reports
    Query("modal_step", modal_step, f"""WITH {st.hourly_sql()},
d AS (SELECT zone, CAST(epoch(time_utc) - epoch(lag(time_utc) OVER (PARTITION BY zone ORDER BY time_utc)) AS BIGINT)
        AS step FROM hourly),
c AS (SELECT zone, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY 1, 2)
SELECT zone, step AS step_seconds FROM c QUALIFY row_number() OVER (PARTITION BY zone ORDER BY n DESC, step) = 1"""),
    Query("hour_profile", lambda s, d: etl.hour_profile(st.grid(s, d, ["Price"]), "Price"),
          f"""WITH {st.GRID_SQL} SELECT zone, hour, quantile_cont(Price, 0.25) AS q25, quantile_cont(Price, 0.5) AS median,
quantile_cont(Price, 0.75) AS q75 FROM grid GROUP BY 1, 2""", "q25 median q75"),
    Query("coverage", lambda s, d: etl.coverage(st.hourly(s, d)), f"""WITH {st.hourly_sql()}
SELECT zone, count(*) AS rows, min(time_utc) AS first, max(time_utc) AS last FROM hourly GROUP BY 1""", "",
          "first last"),
    Query("null_report", lambda s, d: etl.missing_by_hour(st.grid(s, d, ["Price"]), "Price"), f"""WITH {st.GRID_SQL}
SELECT zone, hour, count(*) FILTER (Price IS NULL) AS missing,
coalesce(string_agg(CAST(local_date AS VARCHAR), ',' ORDER BY local_date) FILTER (Price IS NULL), '') AS missing_dates
FROM grid GROUP BY 1, 2"""),
    Query("ffill_zone", ffill_zone,
          f"""WITH {st.GRID_SQL} SELECT zone, local_date, hour, last_value(Price IGNORE NULLS) OVER w AS Price,
last_value(Load_A IGNORE NULLS) OVER w AS Load_A FROM grid
WINDOW w AS (PARTITION BY zone ORDER BY local_date, hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
          "Price Load_A", "local_date"),
    Query("upsample_daily", upsample_daily, f"""WITH {st.DAILY_SQL}
SELECT local_date + to_hours(h) AS time_utc, zone, value FROM daily, range(24) r(h)""", "value", "time_utc"),
    Query("calendar_parts", lambda s, d: st.table(s, d, "events").select(
        "event_id", *[c.cast("int").alias(n) if n != "day_name" else c.alias(n)
                      for n, c in calendar_parts("ts").items()]),
          """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) AS INTEGER) AS weekday,
dayname(ts) AS day_name, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(year(ts) AS INTEGER) AS year,
CAST(month(ts) * 10 + dayofweek(ts) AS INTEGER) AS month_weekday FROM events"""),
    Query("string_ops", string_ops, """SELECT p_partkey, replace(p_type, 'A', '_') AS replaced,
starts_with(p_name, 'red') AS starts, coalesce(p_brand, '') AS filled, lower(p_type) AS lowered,
concat_ws('_', p_name, p_type) AS joined, contains(p_name, 'ring') AS has FROM part"""),
    Query("json_field", lambda s, d: st.table(s, d, "events").select(
        "event_id", F.from_json("props", "k LONG")["k"].alias("k")),
          "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
]
