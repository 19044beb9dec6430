"""Readers, writers and the training table."""
from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hourgrid.operators import etl
from hourgrid.sources import tables

HEADER = "time_utc,Price,Load_A,Load_DA,WindOn_DA,WindOff_DA,Solar_DA,Coal,NGas,Oil,EUA\n"


@pytest.fixture
def zone_files(tmp_path):
    for zone, price in (("NO1", "10.5"), ("NO2", "NaN")):
        (tmp_path / f"data_{zone}.csv").write_text(
            HEADER + f"2024-03-31 02:00:00,{price},1,2,3,4,5,6,7,8,\n2024-03-31 03:00:00,1,1,2,3,4,5,6,7,8,9\n")
    return tmp_path


def test_csv_scan(spark, zone_files):
    rows = tables.read_csv(spark, str(zone_files / "data_NO1.csv")).orderBy("time_utc").collect()
    assert rows[0]["time_utc"] == dt.datetime(2024, 3, 31, 2) and rows[0]["Price"] == 10.5 and rows[0]["EUA"] is None


def test_zone_scan_tags_rows_and_clears_nan(spark, zone_files):
    df = tables.read_zones(spark, str(zone_files / "data_*.csv"))
    rows = {(r["zone"], r["time_utc"].hour): r["Price"] for r in df.collect()}
    assert rows == {("NO1", 2): 10.5, ("NO1", 3): 1.0, ("NO2", 2): None, ("NO2", 3): 1.0}


def test_zone_names_with_any_characters(spark, zone_files):
    (zone_files / "data_NO1.csv").rename(zone_files / "data_SE_3.csv")
    df = tables.read_zones(spark, str(zone_files / "data_*.csv"))
    assert {r["zone"] for r in df.collect()} == {"SE_3", "NO2"}
    (zone_files / "other.csv").write_text(HEADER + "2024-03-31 02:00:00,1,1,2,3,4,5,6,7,8,9\n")
    with pytest.raises(Exception, match="no zone in file name"):
        tables.read_zones(spark, str(zone_files / "*.csv")).collect()


def test_weather_payload(spark, tmp_path):
    hourly = {"time": ["2024-01-01T00:00", "2024-01-01T01:00"]}
    hourly.update({f: [float(i), None] for i, f in enumerate(tables.WEATHER_NAMES)})
    (tmp_path / "NO3.json").write_text(json.dumps({"latitude": 1, "hourly": hourly}, indent=1))
    rows = tables.read_weather(spark, str(tmp_path / "*.json")).orderBy("time_local").collect()
    assert [r["MapCode"] for r in rows] == ["NO3", "NO3"]
    assert rows[0]["time_local"] == dt.datetime(2024, 1, 1) and rows[0]["WindS"] == 2.0 and rows[1]["Humid"] is None
    assert tables.read_weather(spark, str(tmp_path / "NO3.json"), "X").first()["MapCode"] == "X"


def test_forecast_sink(spark, tmp_path):
    df = spark.createDataFrame([("NO1", dt.date(2024, 1, 1), 3, "m", 1.0, 2.0), ("NO2", dt.date(2024, 1, 1), 3, "m", 1.0, None)],
                               "zone string, local_date date, hour int, model string, y_true double, y_pred double")
    tables.write_forecasts(df, str(tmp_path / "f"))
    back = tables.read_parquet(spark, str(tmp_path / "f"))
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert (tmp_path / "f" / "zone=NO1").is_dir()


def test_csv_sink_round_trip(spark, zone_files, tmp_path):
    df = tables.read_csv(spark, str(zone_files / "data_NO1.csv"))
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), timestamp_format="yyyy-MM-dd'T'HH:mm:ss.SSS")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_list_tables(spark):
    spark.range(1).createOrReplaceTempView("some_table")
    assert "some_table" in [r["table_name"] for r in tables.list_tables(spark).collect()]


def quotes(spark, extra=()):
    rows = [("2024-01-05", n, v, "r") for n, v in zip(etl.QUOTES, (100., 30., 80., 70., 2.))] + list(extra)
    return spark.createDataFrame(rows, "Date string, name string, Value double, RIC string")


def test_quotes_are_cleaned_and_converted(spark):
    out = etl.prepare_quotes(quotes(spark, [("rubbish", "gas_fM_01", 1., "r"), ("2025-01-01", "gas_fM_01", 1., "r")]),
                             "2024-01-01", "2025-01-01")
    assert out.count() == 1 and "RIC" not in out.columns
    row = out.first()
    assert (row["oil_fM_01_EUR"], row["coal_fM_01_EUR"], row["gas_fM_01"]) == (40.0, 50.0, 30.0)
    assert "oil_fM_01_EUR" not in etl.convert_currency(out.drop("USD_EUR", "oil_fM_01_EUR")).columns
    assert etl.convert_currency(out, divide=False).first()["oil_fM_01_EUR"] == 160.0


def test_upsampled_join_equals_daily_join(spark):
    day = etl.prepare_quotes(quotes(spark), "2024-01-01", "2025-01-01")
    hours = spark.createDataFrame([("NO1", f"2024-01-0{d} {h:02d}:00") for d in (5, 6) for h in (0, 7, 23)],
                                  "MapCode string, t string").select("MapCode", F.col("t").cast("timestamp_ntz").alias("time_utc"))
    a = hours.join(etl.upsample_daily(day), "time_utc", "left")
    b = etl.join_quotes(hours, day)
    assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_training_table_fills_weekends_in_each_zone(spark):
    hours = [(z, f"2024-01-0{d} 00:00", 1.0) for d in (5, 6, 7) for z in ("NO1", "NO2")]
    price = spark.createDataFrame(hours, "MapCode string, t string, Price double").select(
        "MapCode", F.col("t").cast("timestamp_ntz").alias("time_utc"), "Price")
    load = price.select("MapCode", "time_utc", F.lit(1.0).alias("Load_A"), F.lit(2.0).alias("Load_DA"))
    gen = price.select("MapCode", "time_utc", *[F.lit(3.0).alias(c) for c in ("Wind_Onshore_DA", "Wind_Offshore_DA",
                                                                              "Solar_DA")])
    merged = etl.merge_datasets(price, load, gen, etl.prepare_quotes(quotes(spark), "2024-01-01", "2025-01-01"))
    out = etl.build_training_table(merged)
    assert out.columns == etl.MODEL_COLUMNS
    assert [r["Coal"] for r in out.collect()] == [50.0] * 6
    assert etl.build_training_table(merged, "NO2").select("zone").distinct().collect()[0][0] == "NO2"
    assert etl.build_training_table(merged, fill=False).filter("Coal is null").count() == 4


def test_one_zone_is_replaced_and_the_others_stay(spark, tmp_path):
    fields = "zone string, local_date date, hour int, model string, y_true double, y_pred double"

    def rows(*values):
        return spark.createDataFrame([(z, dt.date(2024, 1, 1), h, "m", 1.0, y) for z, h, y in values], fields)
    path = str(tmp_path / "f")
    tables.write_forecasts(rows(("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("c d/e", 1, 9.0), (None, 1, 4.0)), path)
    tables.write_forecasts(rows(("a", 5, 7.0)), path)
    tables.write_forecasts(rows(("f", 1, 8.0)).repartition(3), path)
    tables.write_forecasts(rows(("a", 5, 7.0)).filter("hour > 9"), path)
    got = {(r["zone"], r["hour"], r["y_pred"]) for r in tables.read_parquet(spark, path).collect()}
    assert got == {("a", 5, 7.0), ("b", 1, 3.0), ("c d/e", 1, 9.0), (None, 1, 4.0), ("f", 1, 8.0)}


def test_open_year_and_date_ranges(spark):
    values = spark.createDataFrame([(y, dt.datetime(y, 6, 1)) for y in (1800, 1995, 2002, 2100)], "k int, DateTime timestamp_ntz")

    def years(*ends):
        return sorted(r["k"] for r in etl.in_years(values, *ends).collect())
    assert years(None, None) == [1800, 1995, 2002, 2100] and years(1995, None) == [1995, 2002, 2100]
    assert years(None, 2002) == [1800, 1995] and years(1995, 2002) == [1995]
    dates = values.withColumn("Date", F.col("DateTime").cast("date"))
    assert etl.in_dates(dates, None, None).count() == 4 and etl.in_dates(dates, "1995-06-01", None).count() == 3
