"""Every registered query with SQL against DuckDB; the others must run, give rows, and forecast better than a naive expert."""
from __future__ import annotations

import pytest

from compare import differences, oracle_connection
from hourgrid.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
FULLER = "/root/testdata/sf0.01"  # the fits need more whole hours than the smallest tables have

WITH_SQL = [n for n, q in QUERIES.items() if q.sql is not None]
ROWS_ONLY = [n for n, q in QUERIES.items() if q.sql is None]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, con, name):
    query = QUERIES[name]
    assert differences(query.spark(spark, SF_DIR), con, query.oracle()) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert QUERIES[name].spark(spark, FULLER).count() > 0


def errors(fits):
    known = fits.filter("y_true is not null and y_pred is not null")
    row = known.selectExpr("sqrt(avg((y_pred - y_true) * (y_pred - y_true))) as rmse", "stddev_pop(y_true) as spread").first()
    return row["rmse"], row["spread"]


def naive_rmse(rows, lag):
    return rows.filter(f"y is not null and {lag} is not null").selectExpr(f"sqrt(avg((y - {lag}) * (y - {lag}))) as r").first()["r"]


@pytest.mark.parametrize("name", ["expert_ols", "weighted_ols", "additive_model", "long_short_pair"])
def test_forecasts_of_the_daily_series(spark, name):
    """Full windows, residuals, and a smaller error than yesterday's value."""
    from hourgrid.plans import model_queries as mq
    fits = QUERIES[name].spark(spark, FULLER).cache()
    rmse, spread = errors(fits)
    assert rmse < naive_rmse(mq.daily_table(spark, FULLER), "lag_1") and rmse < 1.2 * spread
    issued = fits.filter("y_pred is not null")
    low = issued.selectExpr("min(n_train) as n", "min(rmse_train) as r").first()
    assert low["n"] > 30 and low["r"] > 0.1 * spread
    first = fits.selectExpr("min(local_date) as d").first()["d"]
    if name.endswith("ols"):  # no forecast before the first full window
        assert issued.selectExpr("min(datediff(local_date, cast('" + str(first) + "' as date))) as d").first()["d"] >= 365 - 7


def test_complete_series_have_full_windows(spark):
    from hourgrid.operators import models
    days = spark.range(800).selectExpr("'a' as zone", "date_add(date '2020-01-01', cast(id as int)) as local_date", "0 as hour",
                                       "cast(sin(id) as double) as y", "cast(cos(id * id) as double) as x1")
    fits = models.walk_forward_ols(days, "y", ["x1"], [186, 365, 730]).filter("y_pred is not null")
    got = {(r["window"], r["n_train"]) for r in fits.select("window", "n_train").distinct().collect()}
    assert got == {(186, 179), (365, 358), (730, 723)}


def test_boosted_trees_beat_yesterday(spark):
    from hourgrid.plans import standin as st
    out = QUERIES["gbt_forecast"].spark(spark, FULLER)
    assert out.select("origin").distinct().count() == 2
    grid = st.forecasts(spark, FULLER).filter("model = 'naive_1'")
    cells = out.select("zone", "local_date", "hour").join(grid, ["zone", "local_date", "hour"])
    assert errors(out)[0] < errors(cells)[0]


def test_a_sixth_zone_and_later_dates_are_kept(spark, tmp_path):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    sixth = orders.limit(50).selectExpr("o_orderkey + 1000000 as o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                        "o_orderdate + interval 4000 days as o_orderdate", "'6-EXTRA' as o_orderpriority")
    orders.unionByName(sixth).write.parquet(str(tmp_path / "orders.parquet"))
    out = QUERIES["zone_union"].run(spark, str(tmp_path))
    assert out.filter("MapCode = 'NO6'").count() == 50 and out.count() == orders.count() + 50


def test_workers_need_no_repository(tmp_path):
    """A process that starts elsewhere, without the package on its path, runs queries with Python functions."""
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parents[1]
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {str(root / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("expert_ols", "dm_test"):
    print(name, entry.queries()[name](spark, {SF_DIR!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "expert_ols" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "corpus_pipeline"])
def test_core_queries_without_the_optional_part(missing):
    import subprocess
    import sys
    from pathlib import Path
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
print(len(names), "pipeline" in names, any(n.startswith("op") and n[2].isdigit() for n in names), len(entry.oracle_sql()))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True,
                          timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), "False", "False", str(len(WITH_SQL))], done.stderr[-2000:]
