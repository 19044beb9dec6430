"""Hourly energy-market time series on Spark: ETL, local-time grid, features, rolling forecasts, scoring."""
