"""Readers and writers. Every reader turns NaN into NULL so that the operators only deal with nulls."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.numeric import nan_to_null

VALUES_SCHEMA = "TimeSeriesID LONG, DateTime TIMESTAMP_NTZ, Value DOUBLE"
MODELLING_SCHEMA = ("time_utc TIMESTAMP_NTZ, Price DOUBLE, Load_A DOUBLE, Load_DA DOUBLE, WindOn_DA DOUBLE, "
                    "WindOff_DA DOUBLE, Solar_DA DOUBLE, Coal DOUBLE, NGas DOUBLE, Oil DOUBLE, EUA DOUBLE")
# Payload field -> column name.
WEATHER_NAMES = {
    "temperature_2m": "Temp",
    "shortwave_radiation": "Solar",
    "windspeed_10m": "WindS",
    "winddirection_10m": "WindDir",
    "pressure_msl": "Press",
    "relative_humidity_2m": "Humid",
}
WEATHER_SCHEMA = ("hourly STRUCT<time: ARRAY<STRING>, "
                  + ", ".join(f"{f}: ARRAY<DOUBLE>" for f in WEATHER_NAMES) + ">")


def clean_nan(df: DataFrame) -> DataFrame:
    floats = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_nan(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: str = MODELLING_SCHEMA,
             timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """CSV with a declared schema and one timestamp format."""
    return clean_nan(spark.read.schema(schema).option("header", True)
                     .option("timestampNTZFormat", timestamp_format).csv(path))


def zone_of_file(pattern: str) -> Column:
    """What the pattern's group finds in the name of a row's file; a file it does not fit is an error."""
    zone = F.regexp_extract("_metadata.file_name", pattern, 1)
    return F.when(zone != "", zone).otherwise(F.raise_error(F.concat(F.lit("no zone in file name "), "_metadata.file_name")))


def read_zones(spark: SparkSession, glob: str, schema: str = MODELLING_SCHEMA,
               zone_pattern: str = r"data_(.+)\.csv$",
               timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """One file per zone, read by a single scan; the zone comes from the file name."""
    raw = (spark.read.schema(schema).option("header", True)
           .option("timestampNTZFormat", timestamp_format).csv(glob))
    return clean_nan(raw.withColumn("zone", zone_of_file(zone_pattern)))


def read_jdbc(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Database table; credentials and ``partitionColumn``/``lowerBound``/... come from the caller."""
    return clean_nan(spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load())


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of the tables the catalogue knows."""
    in_database = f" IN {database}" if database else ""
    return spark.sql(f"SHOW TABLES{in_database}").select(F.col("tableName").alias("table_name"))


def hourly_arrays_to_rows(payload: DataFrame, hourly: str | Column = "hourly",
                          names: Mapping[str, str] = WEATHER_NAMES, keep: tuple[str, ...] = ("MapCode",),
                          time_name: str = "time_local") -> DataFrame:
    """Struct of parallel hourly arrays -> one row per hour, renamed; the tag columns are kept."""
    if isinstance(hourly, str):
        hourly = F.col(hourly)
    zipped = F.arrays_zip(hourly["time"].alias("time"), *[hourly[f].alias(f) for f in names])
    rows = payload.select(*keep, F.inline(zipped))
    return rows.select(*keep, F.to_timestamp_ntz("time").alias(time_name),
                       *[nan_to_null(f).alias(name) for f, name in names.items()])


def read_weather(spark: SparkSession, path: str, zone: str | None = None,
                 zone_pattern: str = r"(.+)\.json$") -> DataFrame:
    """Landed weather payloads; the zone is given, or taken from the file name."""
    raw = spark.read.schema(WEATHER_SCHEMA).option("multiLine", True).json(path)
    tag = F.lit(zone) if zone else zone_of_file(zone_pattern)
    return hourly_arrays_to_rows(raw.withColumn("MapCode", tag))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_zone(df: DataFrame, path: str, zone: str = "zone") -> None:
    """Parquet partitioned by zone; a zone may be written by many tasks.

    Only the zones that ``df`` holds are replaced, each as a whole; all others stay. An empty ``df`` changes nothing. Zones
    change when the job commits, so a failed write leaves the old ones.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(zone).parquet(path)


def write_forecasts(forecasts: DataFrame, path: str) -> None:
    """Long forecast table (zone, local_date, hour, model, y_true, y_pred); the zones given replace what they had."""
    write_by_zone(forecasts.select("zone", "local_date", "hour", "model", "y_true", "y_pred"), path)
