"""Walk-forward fits, additive models and boosted trees."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from hourgrid.operators import blocks, boosting, combine, etl, features, models, scoring, trees
from hourgrid.operators.features import HourlySpec
from hourgrid.plans import standin as st
from hourgrid.plans.registry import Query
from hourgrid.session import computed_once

SPEC = HourlySpec(last_price=True)
DAYS = 21            # history length of the one-regressor fits on the 30 hourly days
WINDOWS = [186, 365, 730]
SINGLE = HourlySpec(price_lags=(1,), load="", forecasts=(), fuels=(), weekdays=[0])
LINEAR = ["Price_lag_1", "Price_lag_7", "WD_1", "WD_6", "WD_7"]
SMOOTH, CYCLIC = {"Load_DA_lag_0": 5}, {"hour_d": (6, 24.0)}
# Columns of the design vector in order: (number, smooth); pairs of terms are products of their columns.
SIZES = [(1 + len(LINEAR), False), (8, True), (6, True), ((8, 6), True)]


def design_table(spark, d):
    return features.hourly_features(st.grid(spark, d), SPEC)


def expert_single(spark, d):
    table = features.hourly_features(st.grid(spark, d), SINGLE)
    fits = models.walk_forward_ols(table, "Price", ["Price_lag_1"], [DAYS], lag_days=7)
    return fits.select("zone", "local_date", "hour", "y_true", "y_pred", "n_train")


# ---- experts on the daily series of several years -------------------------------------------------------------------

LAGS = ["lag_1", "lag_7"]


def daily_table(spark, d):
    """Daily value in thousands and its lags of a day and a week."""
    series = st.daily(spark, d).select("zone", "local_date", (F.col("value") / 1000).alias("y"))
    lagged = blocks.windowed(series, 7, lambda w: {"lag_1": F.lag("y", 1).over(w), "lag_7": F.lag("y", 7).over(w)},
                             order=("local_date",))
    return lagged.withColumn("hour", F.lit(0))


def first_day(spark, d):
    return st.table(spark, d, "orders").agg(F.min(F.col("o_orderdate").cast("date"))).first()[0]


def expert(windows, regressors=LAGS, alpha=None, since=None):
    def run(spark, d):
        start = None if since is None else str(first_day(spark, d) + timedelta(days=since))
        return models.walk_forward_ols(daily_table(spark, d), "y", regressors, windows, alpha=alpha, first_origin=start)
    return run


def shown(fits):
    """Forecast columns only."""
    return fits.select("zone", "local_date", "hour", "window", "y_true", "y_pred", "n_train", "rmse_train")


def expert_coefs(spark, d):
    return models.coefficient_table(expert([365])(spark, d), LAGS)


def whole_experts(spark, d):
    """Cells in which the truth and the forecasts of all history lengths are known."""
    fits = expert(WINDOWS)(spark, d).withColumn("_e", F.col("y_pred") - F.col("y_true"))
    return models.as_experts(etl.complete_groups(fits, ["zone", "local_date", "hour"], "_e"))


def combined_experts(spark, d):
    """Experts of several history lengths, rates tuned on the first year, combined on the later days, all scored."""
    experts = computed_once(whole_experts(spark, d))
    cut = experts.agg(F.date_add(F.min("local_date"), 365)).scalar()
    names = [f"D{w}" for w in WINDOWS]
    etas = combine.ewa_tune_with_reset(experts.filter(F.col("local_date") < cut), names)
    late = experts.filter(F.col("local_date") >= cut)
    combined = combine.keep_last_days(combine.ewa_with_reset(late, etas, names), 1 / 9).select(
        "zone", "local_date", "hour", F.lit("ewa").alias("model"), "y_true", "y_pred")
    shared = late.join(combined.select("zone", "local_date", "hour"), ["zone", "local_date", "hour"], "left_semi")
    return scoring.error_table(combine.stack_models(shared, combined), ["zone", "model"])


DAILY_X = f"""{st.DAILY_SQL},
x AS (SELECT zone, local_date, y, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b, row_number() OVER w AS pos
      FROM (SELECT zone, local_date, value / 1000 AS y FROM daily) WINDOW w AS (PARTITION BY zone ORDER BY local_date))"""


def frame_sql(d: int, name: str = "fits", two: bool = True, source: str = "x", cell: str = "zone",
              hour: str = "CAST(0 AS INTEGER)") -> str:
    """Least squares over the frame before each day, from its variances and covariances: one or two regressors."""
    ok = "y + a + b IS NOT NULL" if two else "y + a IS NOT NULL"
    columns = ["y", "a", "b"] if two else ["y", "a"]
    parts = [f"count(*) FILTER ({ok}) OVER f AS n"]
    parts += [f"avg({c}) FILTER ({ok}) OVER f AS m{c}" for c in columns]
    parts += [f"covar_pop({c}, {e}) FILTER ({ok}) OVER f AS {c}{e}" for i, c in enumerate(columns) for e in columns[i:]]
    first = "(ya * bb - yb * ab) / (aa * bb - ab * ab)" if two else "ya / aa"
    second = "(yb * aa - ya * ab) / (aa * bb - ab * ab)" if two else "0.0"
    fit = f"pos > {d - 7} AND n >= {len(columns) + 1} AND {'a + b' if two else 'a'} IS NOT NULL"
    line = "my + s1 * (a - ma)" + (" + s2 * (b - mb)" if two else "")
    rest = "yy - s1 * ya" + (" - s2 * yb" if two else "")
    return f"""{name}_m AS (SELECT {source}.*, {', '.join(parts)} FROM {source} WINDOW f AS (PARTITION BY {cell} ORDER BY local_date
  ROWS BETWEEN {d - 7} PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT zone, local_date, {hour} AS hour, CAST({d} AS INTEGER) AS "window", y AS y_true,
  CASE WHEN {fit} THEN {line} END AS y_pred, CAST(n AS INTEGER) AS n_train,
  CASE WHEN {fit} THEN sqrt(greatest({rest}, 0)) END AS rmse_train,
  CASE WHEN {fit} THEN s1 * sqrt(aa / yy) END AS c1{f", CASE WHEN {fit} THEN s2 * sqrt(bb / yy) END AS c2" if two else ""}
  FROM (SELECT *, {first} AS s1, {second} AS s2 FROM {name}_m))"""


FIT_COLUMNS = "zone, local_date, hour, \"window\", y_true, y_pred, n_train, rmse_train"
ALPHA = 0.002
WEIGHTED_SQL = f"""WITH {DAILY_X},
u AS (SELECT *, exp({ALPHA} * (local_date - DATE '1998-01-01')) AS w FROM x),
m AS (SELECT u.*, {', '.join(f"{fn}({arg}) FILTER (y + a IS NOT NULL) OVER f AS {name}" for name, fn, arg in [
    ('n', 'count', '*'), ('my', 'avg', 'y'), ('ma', 'avg', 'a'), ('yy', 'var_pop', 'y'), ('aa', 'var_pop', 'a'),
    ('sw', 'sum', 'w'), ('sy', 'sum', 'w * y'), ('sa', 'sum', 'w * a'), ('say', 'sum', 'w * a * y'), ('saa', 'sum', 'w * a * a')])},
  covar_pop(y, a) FILTER (y + a IS NOT NULL) OVER f AS ya
  FROM u WINDOW f AS (PARTITION BY zone ORDER BY local_date ROWS BETWEEN 358 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, (say - ma * sy - my * sa + ma * my * sw) / (saa - 2 * ma * sa + ma * ma * sw) AS b1,
             pos > 358 AND n >= 3 AND a IS NOT NULL AS fit FROM m)
SELECT zone, local_date, CAST(0 AS INTEGER) AS hour, CAST(365 AS INTEGER) AS "window", y AS y_true,
  CASE WHEN fit THEN my + b1 * (a - ma) END AS y_pred, CAST(n AS INTEGER) AS n_train,
  CASE WHEN fit THEN sqrt(greatest(yy - 2 * b1 * ya + b1 * b1 * aa, 0)) END AS rmse_train FROM s"""

TUNE_SQL = f"""WITH {DAILY_X}, {', '.join(frame_sql(w, f'f{w}') for w in WINDOWS)},
every AS ({' UNION ALL '.join(f'SELECT {FIT_COLUMNS} FROM f{w}' for w in WINDOWS)}),
r AS (SELECT zone, "window", sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM every
      WHERE local_date >= (SELECT CAST(min(o_orderdate) AS DATE) + {max(WINDOWS)} FROM orders) GROUP BY 1, 2)
SELECT zone, "window", rmse FROM r WHERE rmse IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY zone ORDER BY rmse, "window") = 1"""


def walk_sql(cells: str, name: str, experts: int = 3) -> str:
    """Weights before each step t of ``cells`` (zone, hour, i, eta, t, y, p1..), by the update with the return to 1/K."""
    ks = range(1, experts + 1)
    return f"""{name}(zone, hour, i, eta, t, {', '.join(f'w{k}' for k in ks)}) AS (
  SELECT zone, hour, i, eta, t, {', '.join(f'1e0 / {experts}' for _ in ks)} FROM {cells} WHERE t = 1
  UNION ALL
  SELECT zone, hour, i, eta, t + 1, {', '.join(f'CASE WHEN s > 1e-15 THEN u{k} / s ELSE 1e0 / {experts} END' for k in ks)}
  FROM (SELECT *, {' + '.join(f'u{k}' for k in ks)} AS s FROM (
    SELECT w.zone, w.hour, w.i, w.eta, w.t, {', '.join(f'w.w{k} * exp(greatest(-700.0, -w.eta * (c.p{k} - c.y) ** 2)) AS u{k}' for k in ks)}
    FROM {name} w JOIN {cells} c ON c.zone = w.zone AND c.hour = w.hour AND c.i = w.i AND c.t = w.t)))"""


def mixed_sql(cells: str, walk: str, experts: int = 3) -> str:
    """Combined forecast of every step."""
    mix = " + ".join(f"w.w{k} * c.p{k}" for k in range(1, experts + 1))
    return f"""SELECT c.zone, c.local_date, c.hour, c.i, c.eta, c.t, c.y AS y_true, {mix} AS y_pred
  FROM {cells} c JOIN {walk} w ON c.zone = w.zone AND c.hour = w.hour AND c.i = w.i AND c.t = w.t"""


ETA_SQL = "etas AS (SELECT i, power(2.0, i - 10) AS eta FROM range(12) r(i))"
COMBINED_SQL = f"""WITH RECURSIVE {DAILY_X}, {', '.join(frame_sql(w, f'f{w}') for w in WINDOWS)},
whole AS (SELECT zone, local_date, f186.hour, f186.y_true AS y, f186.y_pred AS p1, f365.y_pred AS p2, f730.y_pred AS p3
          FROM f186 JOIN f365 USING (zone, local_date) JOIN f730 USING (zone, local_date)
          WHERE f186.y_true + f186.y_pred + f365.y_pred + f730.y_pred IS NOT NULL),
cut AS (SELECT min(local_date) + 365 AS day FROM whole), {ETA_SQL},
early AS (SELECT *, row_number() OVER (PARTITION BY zone, i ORDER BY local_date) AS t FROM whole, etas
          WHERE local_date < (SELECT day FROM cut)),
{walk_sql('early', 'ew')},
tuned AS (SELECT zone, hour, eta FROM (SELECT zone, hour, i, eta, sum((y_pred - y_true) ** 2) AS loss
          FROM ({mixed_sql('early', 'ew')}) GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY zone ORDER BY loss, i) = 1),
late AS (SELECT w.*, 0 AS i, u.eta, row_number() OVER (PARTITION BY w.zone ORDER BY local_date) AS t,
                count(*) OVER (PARTITION BY w.zone) AS n
         FROM whole w JOIN tuned u ON u.zone = w.zone WHERE local_date >= (SELECT day FROM cut)),
{walk_sql('late', 'lw')},
kept AS (SELECT m.zone, m.y_true, m.y_pred, l.p1, l.p2, l.p3 FROM ({mixed_sql('late', 'lw')}) m
         JOIN late l ON l.zone = m.zone AND l.t = m.t WHERE l.t > l.n - floor(l.n - l.n * (1.0 / 9))),
rows_ AS (SELECT zone, 'ewa' AS model, y_true, y_pred FROM kept UNION ALL SELECT zone, 'D186', y_true, p1 FROM kept
          UNION ALL SELECT zone, 'D365', y_true, p2 FROM kept UNION ALL SELECT zone, 'D730', y_true, p3 FROM kept)
SELECT zone, model, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae FROM rows_ GROUP BY 1, 2"""


# ---- experts by hour on several years of slots ----------------------------------------------------------------------

FULL = HourlySpec(last_price=True, slots=st.SLOTS)
LEAN = HourlySpec(price_lags=(1,), load="", forecasts=(), fuels=(), weekdays=[], last_price=True, slots=st.SLOTS)
LAST = st.SLOTS - 1


def hourly_expert(spec, windows, alpha=None, last_price="price_last"):
    """Fits of every (zone, hour, day); the price of the last hour of the day before is no regressor of the last hour."""
    def run(spark, d):
        table = features.hourly_features(st.slot_series(spark, d), spec)
        return models.walk_forward_ols(table, spec.price, spec.regressors(), windows, last_price=last_price, last_hour=LAST,
                                       alpha=alpha)
    return run


def hourly_coefs(spark, d):
    return models.coefficient_table(hourly_expert(LEAN, [365])(spark, d), [*LEAN.regressors(), "price_last"])


SLOT_X = f"""{st.SLOT_SQL},
x AS (SELECT zone, local_date, hour, y, lag(y, 1) OVER c AS a, max(y) FILTER (hour = {LAST}) OVER p AS b,
             row_number() OVER c AS pos
      FROM slot_series WINDOW c AS (PARTITION BY zone, hour ORDER BY local_date),
      p AS (PARTITION BY zone ORDER BY local_date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
early AS (SELECT * FROM x WHERE hour < {LAST}), late AS (SELECT * FROM x WHERE hour = {LAST})"""


def hourly_sql(*windows: int) -> str:
    """Fits of two regressors, of one at the last hour."""
    fits = [frame_sql(w, f"e{w}", True, "early", "zone, hour", "hour") + ",\n" + frame_sql(w, f"l{w}", False, "late", "zone, hour", "hour")
            for w in windows]
    both = " UNION ALL ".join(f"SELECT *, c1 AS c FROM e{w} UNION ALL BY NAME SELECT *, c1 AS c FROM l{w}" for w in windows)
    return f"WITH {SLOT_X},\n" + ",\n".join(fits) + f",\nfits AS ({both})"


# ---- additive models ------------------------------------------------------------------------------------------------

TERMS = models.AdditiveTerms(["lag_1", "lag_7"], {"orders": 5}, {"day_of_year": (6, 366.0), "weekday": (4, 7.0)})
BY_HOUR = models.AdditiveTerms(["Price_lag_1"], {"Load_DA_lag_0": 2})
TRAIN_DAYS = 365


def additive_rows(spark, d):
    """Daily value with lags, yesterday's number of orders and the calendar."""
    counts = st.daily(spark, d).select("zone", F.date_add("local_date", 1).alias("local_date"), F.col("n").alias("orders"))
    return daily_table(spark, d).join(counts, ["zone", "local_date"], "left").withColumns({
        "day_of_year": F.dayofyear("local_date").cast("double"), "weekday": F.weekday("local_date").cast("double")})


def additive(spark, d):
    return models.additive_forecast(additive_rows(spark, d), TERMS, TRAIN_DAYS)


TENSOR = models.AdditiveTerms(["lag_1", "lag_7"], {"orders": 4}, {"day_of_year": (6, 366.0), "weekday": (4, 7.0)},
                              [("orders", "day_of_year")])
SLOTTED = models.AdditiveTerms(["Price_lag_1", "Price_lag_7", "WD_1", "WD_6", "WD_7"],
                               {"Load_DA_lag_0": 6, "Solar_DA_lag_0": 6, "Coal_lag_2": 6}, {"day_of_year": (8, 366.0)})


def additive_tensor(spark, d):
    """A product of two splines beside its parts, penalties chosen in every window."""
    return models.additive_forecast(additive_rows(spark, d), TENSOR, TRAIN_DAYS, 28, smoothing=None)


def additive_hourly(spark, d):
    """One model for each hour on a year of days, penalties chosen in every window."""
    table = features.hourly_features(st.slot_series(spark, d), FULL)
    rows = table.withColumnRenamed("Price", "y").withColumn("day_of_year", F.dayofyear("local_date").cast("double"))
    return models.additive_forecast(rows, SLOTTED, TRAIN_DAYS, 28, keys=["zone", "hour"], smoothing=None)


def additive_by_hour(spark, d):
    rows = design_table(spark, d).withColumnRenamed("Price", "y")
    return models.additive_forecast(rows, BY_HOUR, 20, 1, keys=["zone", "hour"])


def additive_difference(spark, d):
    """The model of the daily change, its forecasts put back on the level, and the level's error by zone."""
    rows = additive_rows(spark, d).withColumn("change", F.col("y") - F.col("lag_1"))
    fits = models.additive_forecast(rows, TERMS, TRAIN_DAYS, target="change")
    base = rows.select("zone", "local_date", "y", "lag_1")
    level = fits.join(base, ["zone", "local_date"]).select(
        "zone", F.lit("difference").alias("model"), F.col("y").alias("y_true"), (F.col("y_pred") + F.col("lag_1")).alias("y_pred"))
    return scoring.error_table(level, ["zone", "model"])


def rmse_in_sample(spark, d):
    fits = additive(spark, d)
    return fits.groupBy("zone", "local_date").agg(F.max("rmse_train").alias("rmse_train"), F.max("n_train").alias("n_train"))


def long_short(spark, d):
    return models.long_short_walk(additive_rows(spark, d), TERMS, TRAIN_DAYS, 90, 28, 7)


def long_short_origin(spark, d):
    """One origin over the whole history, from cross products alone: the last hourly day."""
    table = design_table(spark, d).withColumn("hour_d", F.col("hour").cast("double"))
    last = st.table(spark, d, "events").agg(F.max(F.col("ts").cast("date"))).first()[0]
    rows = features.smooth_design(table, SMOOTH, CYCLIC, LINEAR, [("Load_DA_lag_0", "hour_d")],
                                  F.col("local_date") < F.lit(last)).withColumnRenamed("Price", "y")
    rows = features.split_labels(rows.select("zone", "local_date", "hour", "y", "x").withColumn("origin", F.lit(last)), "origin")
    return models.long_short_forecast(rows.drop("origin"), SIZES)


# One spline and one linear term, small enough to be fitted in SQL as well.
SMALL = models.AdditiveTerms(["lag_7"], {"lag_1": 3}, gate=0)
LONG, SHORT, CHECK = 364, 91, 28


def additive_small(spark, d):
    return models.additive_forecast(daily_table(spark, d), SMALL, LONG)


def rmse_small(spark, d):
    """In-sample error of every fit, on the scale of the series."""
    fits = additive_small(spark, d).withColumn("period", F.floor(F.unix_date("local_date") / 7) * 7)
    return fits.groupBy("zone", F.date_from_unix_date(F.col("period").cast("int")).alias("period")).agg(
        F.max("rmse_train").alias("rmse_train"), F.max("n_train").alias("n_train"))


def long_short_small(spark, d):
    return models.long_short_walk(daily_table(spark, d), SMALL, LONG, SHORT, CHECK, 7)


def spline_sql(kinds: list[tuple[str, int, int]]) -> str:
    """Penalised fits by normal equations and elimination for each refit period and kind (name, age above, age up to)."""
    q = 8
    value = [f"v[{j}]" for j in range(1, q + 1)]
    penalty = models.difference_penalty([(2, False), (6, True)])
    grams = [f"sum({value[i]} * {value[j]}) + {float(penalty[i, j]) + (1e-3 if i == j else 0.0)!r}" for i in range(q) for j in range(q)]
    cells = ", ".join(", ".join([*grams[i * q:(i + 1) * q], f"sum({value[i]} * y)"]) for i in range(q))
    plain = ", ".join(f"sum({value[i]} * {value[j]})" for i in range(q) for j in range(q))
    pieces = ["(1 - t) ** 3 / 6", "(3 * t ** 3 - 6 * t ** 2 + 4) / 6", "(-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6", "t ** 3 / 6"]
    cases = " ".join(f"WHEN {k} THEN {piece}" for k, piece in enumerate(pieces))
    w = q + 1

    def design(rows: str, columns: str) -> str:
        return f"""SELECT {columns}, list_concat([1.0, CASE WHEN sb > 0 THEN (b - mb) / sb ELSE b - mb END], list_transform(range(6),
  lambda c: CASE c - i {cases} ELSE 0.0 END)) AS v FROM (SELECT *, u - i AS t FROM (SELECT *, least(floor(u), 2) AS i FROM (
  SELECT *, CASE WHEN hi > lo THEN least(greatest((a - lo) / (hi - lo) * 3, 0), 3) ELSE 0 END AS u FROM {rows})))"""
    return f"""{DAILY_X},
d AS (SELECT zone, local_date, y, a, b, local_date - DATE '1970-01-01' AS day FROM x),
p AS (SELECT DISTINCT zone, day // 7 * 7 AS first FROM d JOIN (SELECT zone, min(day) AS start FROM d GROUP BY 1) USING (zone)
      WHERE day // 7 * 7 - {LONG} >= start),
k(kind, above, upto) AS (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in kinds)}),
w AS (SELECT p.zone, first, kind, y, a, b FROM p, k JOIN d ON d.zone = p.zone AND first - day > above AND first - day <= upto
      WHERE y + a + b IS NOT NULL),
s AS (SELECT zone, first, kind, count(*) AS n, min(a) AS lo, max(a) AS hi, avg(b) AS mb, stddev_samp(b) AS sb, sum(y * y) AS yy
      FROM w GROUP BY ALL HAVING count(*) >= {q}),
g AS (SELECT zone, first, kind, [{cells}] AS m, [{plain}] AS xx, [{', '.join(f'sum({c} * y)' for c in value)}] AS xy
      FROM ({design('(SELECT * FROM w JOIN s USING (zone, first, kind))', 'zone, first, kind, y')}) GROUP BY ALL),
e(zone, first, kind, step, m) AS (
  SELECT zone, first, kind, 0, m FROM g UNION ALL
  SELECT zone, first, kind, step + 1, list_transform(range({q * w}), lambda c: CASE WHEN c // {w} = step THEN m[c + 1] / m[step * {w} + step + 1]
    ELSE m[c + 1] - m[c // {w} * {w} + step + 1] * m[step * {w} + c % {w} + 1] / m[step * {w} + step + 1] END)
  FROM e WHERE step < {q}),
beta AS (SELECT zone, first, kind, list_transform(range({q}), lambda c: m[c * {w} + {w}]) AS beta FROM e WHERE step = {q}),
fit AS (SELECT s.*, beta, sqrt(greatest(yy - 2 * list_inner_product(beta, xy) + list_sum(list_transform(range({q * q}),
          lambda c: xx[c + 1] * beta[c // {q} + 1] * beta[c % {q} + 1])), 0) / n) AS rmse
        FROM s JOIN g USING (zone, first, kind) JOIN beta USING (zone, first, kind)),
ahead AS (SELECT zone, first, kind, local_date, y, n, rmse, list_inner_product(v, beta) AS y_pred FROM ({design(
      f'(SELECT * FROM fit JOIN (SELECT * FROM d WHERE a + b IS NOT NULL) USING (zone) WHERE first = day // 7 * 7)',
      'zone, first, kind, local_date, y, n, rmse, beta')})),
held AS (SELECT zone, first, kind, avg((list_inner_product(v, beta) - y) ** 2) AS loss FROM ({design(
      f'(SELECT * FROM fit JOIN (SELECT * FROM d WHERE y + a + b IS NOT NULL) USING (zone) WHERE first - day BETWEEN 1 AND {CHECK})',
      'zone, first, kind, y, beta')}) GROUP BY ALL)"""


SMALL_SQL = f"WITH RECURSIVE {spline_sql([('long', 0, LONG)])}"
PAIR_SQL = f"""WITH RECURSIVE {spline_sql([('long', 0, LONG), ('short', 0, SHORT), ('long?', CHECK, LONG), ('short?', CHECK, SHORT)])}
SELECT a.zone, local_date, CAST(0 AS INTEGER) AS hour, any_value(y) AS y_true, sum(y_pred / loss) / sum(1 / loss) AS y_pred,
  max(c.n) AS n_train, sum(rmse / loss) / sum(1 / loss) AS rmse_train
FROM ahead a JOIN held h ON h.zone = a.zone AND h.first = a.first AND h.kind = a.kind || '?'
JOIN (SELECT zone, first, n FROM s WHERE kind = 'long') c ON c.zone = a.zone AND c.first = a.first
WHERE a.kind IN ('long', 'short') GROUP BY a.zone, local_date"""


# ---- boosted trees --------------------------------------------------------------------------------------------------

TREE_FEATURES = [*SPEC.regressors(), "hour_d", "zone_code"]
GRID = [{"maxIter": 20, "maxDepth": 3}, {"maxIter": 20, "maxDepth": 5}]


def tree_table(spark, d):
    code = F.crc32(F.col("zone").cast("binary")).cast("double")  # any zone has its own number
    return design_table(spark, d).withColumns({"hour_d": F.col("hour").cast("double"), "zone_code": code})


def span(spark, d):
    """First and last day of the hourly series."""
    day = F.col("ts").cast("date")
    return st.table(spark, d, "events").agg(F.min(day), F.max(day)).first()


def gbt_forecast(spark, d):
    first, last = span(spark, d)
    origins = [last - timedelta(days=k) for k in (8, 4)]
    return boosting.gbt_forecast(computed_once(tree_table(spark, d)), TREE_FEATURES, "Price", origins, last,
                                 (last - first).days, {"maxIter": 40}).withColumn("origin", F.col("origin").cast("string"))


def gbt_importance(spark, d):
    data = boosting.assemble(computed_once(tree_table(spark, d)), TREE_FEATURES, "Price")
    model = boosting.fit_trees(data, {"maxIter": 20})
    return boosting.importance_table(model, spark.range(1), TREE_FEATURES)


def gbt_grid(spark, d):
    _, last = span(spark, d)
    table = computed_once(tree_table(spark, d))
    rows = features.split_labels(table.withColumn("origin", F.lit(last)), "origin", validation_days=4)
    trials = boosting.gbt_grid(rows.drop("origin"), TREE_FEATURES, "Price", "split", GRID)
    return boosting.best_trial(trials)


# ---- boosted trees of all origins in one job ------------------------------------------------------------------------

WALK_INPUTS = [*FULL.regressors(), "price_last", "hour_d"]
WALK_SPEC = trees.TreeSpec(trees=120, leaves=6, validation_days=56)
STAGED = [{"leaves": 4}, {"leaves": 8}, {"leaves": 8, "rate": 0.05}]
STUMP = trees.TreeSpec(trees=1, leaves=2, rate=1.0, bins=16)
STUMP_REFIT = 28


def slot_table(spark, d):
    table = features.hourly_features(st.slot_series(spark, d), FULL)
    return table.withColumnRenamed("Price", "y").withColumn("hour_d", F.col("hour").cast("double"))


def trees_walk(spark, d):
    return trees.trees_forecast(slot_table(spark, d), WALK_INPUTS, TRAIN_DAYS, 28, spec=WALK_SPEC)


def trees_staged(spark, d):
    """Every setting and number of trees on the last year, the last 56 days for validation."""
    rows = slot_table(spark, d)
    last = st.table(spark, d, "lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]
    age = F.datediff(F.lit(last), "local_date")
    rows = rows.withColumn("split", F.when(age < 56, "validation").when(age < 365 + 56, "training"))
    return trees.tree_grid(rows, WALK_INPUTS, STAGED, spec=WALK_SPEC)


def tree_stump(spark, d):
    return trees.trees_forecast(daily_table(spark, d), LAGS, LONG, STUMP_REFIT, spec=STUMP).drop("gains")


STUMP_SQL = f"""WITH {DAILY_X},
d AS (SELECT zone, local_date, y, a, b, local_date - DATE '1970-01-01' AS day FROM x),
p AS (SELECT DISTINCT zone, day // {STUMP_REFIT} * {STUMP_REFIT} AS first FROM d
      JOIN (SELECT zone, min(day) AS start FROM d GROUP BY 1) USING (zone) WHERE day // {STUMP_REFIT} * {STUMP_REFIT} - {LONG} >= start),
w AS (SELECT p.zone, first, y, a, b FROM p JOIN d ON d.zone = p.zone AND first - day BETWEEN 1 AND {LONG} WHERE y + a + b IS NOT NULL),
s AS (SELECT zone, first, count(*) AS n, avg(y) AS base, quantile_disc(a, {[k / STUMP.bins for k in range(1, STUMP.bins)]}) AS qa,
             quantile_disc(b, {[k / STUMP.bins for k in range(1, STUMP.bins)]}) AS qb FROM w GROUP BY ALL),
f AS (SELECT zone, first, 0 AS feature, a AS v, y - base AS r, qa AS q FROM w JOIN s USING (zone, first)
      UNION ALL SELECT zone, first, 1, b, y - base, qb FROM w JOIN s USING (zone, first)),
h AS (SELECT zone, first, feature, len(list_filter(list_distinct(q), lambda e: e < v)) AS bin, sum(r) AS g, count(*) AS c, max(v) AS upto
      FROM f GROUP BY ALL),
c AS (SELECT *, sum(g) OVER o AS gl, sum(c) OVER o AS cl, sum(g) OVER t AS gt, sum(c) OVER t AS ct FROM h
      WINDOW o AS (PARTITION BY zone, first, feature ORDER BY bin), t AS (PARTITION BY zone, first, feature)),
best AS (SELECT zone, first, feature, upto, gl / cl AS low, (gt - gl) / (ct - cl) AS high
         FROM (SELECT *, gl * gl / cl + (gt - gl) ** 2 / nullif(ct - cl, 0) - gt * gt / ct AS gain FROM c)
         WHERE cl >= {STUMP.least_rows} AND ct - cl >= {STUMP.least_rows} AND gain > 1e-12
         QUALIFY row_number() OVER (PARTITION BY zone, first ORDER BY gain DESC, feature, bin) = 1),
fit AS (SELECT s.zone, s.first, n, base, feature, upto, coalesce(low, 0) AS low, coalesce(high, 0) AS high
        FROM s LEFT JOIN best USING (zone, first)),
e AS (SELECT zone, first, sqrt(avg((base + CASE WHEN feature IS NULL THEN 0 WHEN (CASE feature WHEN 0 THEN a ELSE b END) <= upto
        THEN low ELSE high END - y) ** 2)) AS rmse FROM w JOIN fit USING (zone, first) GROUP BY ALL)
SELECT d.zone, local_date, CAST(0 AS INTEGER) AS hour, y AS y_true, base + CASE WHEN feature IS NULL THEN 0
         WHEN (CASE feature WHEN 0 THEN a ELSE b END) <= upto THEN low ELSE high END AS y_pred, n AS n_train, rmse AS rmse_train,
       CAST(1 AS INTEGER) AS trees
FROM d JOIN fit ON fit.zone = d.zone AND fit.first = day // {STUMP_REFIT} * {STUMP_REFIT}
JOIN e ON e.zone = fit.zone AND e.first = fit.first WHERE a + b IS NOT NULL"""


MODEL_QUERIES = [
    Query("expert_ols", lambda s, d: shown(expert([365])(s, d)),
          f"WITH {DAILY_X}, {frame_sql(365)} SELECT {FIT_COLUMNS} FROM fits", "y_true y_pred rmse_train", "local_date"),
    Query("expert_hourly", lambda s, d: shown(hourly_expert(LEAN, [365])(s, d)), f"{hourly_sql(365)} SELECT {FIT_COLUMNS} FROM fits",
          "y_true y_pred rmse_train", "local_date"),
    Query("expert_hourly_coefs", hourly_coefs, f"""{hourly_sql(365)}
SELECT zone, local_date, hour, "window", c1 AS coefficient, 'Price_lag_1' AS regressor FROM fits WHERE c1 IS NOT NULL
UNION ALL SELECT zone, local_date, hour, "window", c2, 'price_last' FROM fits WHERE c2 IS NOT NULL""", "coefficient", "local_date"),
    Query("expert_hourly_tuned", lambda s, d: models.tune_window(hourly_expert(LEAN, WINDOWS)(s, d), ["zone", "hour"]),
          f"""{hourly_sql(*WINDOWS)},
r AS (SELECT zone, hour, "window", sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM fits GROUP BY ALL)
SELECT zone, hour, "window", rmse FROM r WHERE rmse IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY zone, hour ORDER BY rmse, "window") = 1""", "rmse"),
    Query("weighted_hourly", lambda s, d: shown(hourly_expert(LEAN, [365], ALPHA, None)(s, d)),
          WEIGHTED_SQL.replace(DAILY_X, SLOT_X).replace("PARTITION BY zone ", "PARTITION BY zone, hour ")
          .replace("CAST(0 AS INTEGER) AS hour", "hour"), "y_true y_pred rmse_train", "local_date"),
    Query("expert_full", lambda s, d: hourly_expert(FULL, [365])(s, d)),
    Query("expert_single", expert_single, f"""WITH {st.GRID_SQL},
x AS (SELECT zone, local_date, hour, Price, lag(Price, 24) OVER (PARTITION BY zone ORDER BY local_date, hour) AS p,
      row_number() OVER (PARTITION BY zone, hour ORDER BY local_date) AS pos FROM grid),
f AS (SELECT *, regr_count(Price, p) OVER r AS n, regr_intercept(Price, p) OVER r AS a, regr_slope(Price, p) OVER r AS b
      FROM x WINDOW r AS (PARTITION BY zone, hour ORDER BY local_date ROWS BETWEEN {DAYS - 7} PRECEDING AND 1 PRECEDING))
SELECT zone, local_date, hour, Price AS y_true, CASE WHEN n > 2 AND pos > {DAYS - 7} THEN a + b * p END AS y_pred,
CAST(n AS INTEGER) AS n_train FROM f""", "y_true y_pred", "local_date"),
    Query("expert_coefs", expert_coefs, f"""WITH {DAILY_X}, {frame_sql(365)}
SELECT zone, local_date, hour, "window", c1 AS coefficient, 'lag_1' AS regressor FROM fits WHERE c1 IS NOT NULL
UNION ALL SELECT zone, local_date, hour, "window", c2, 'lag_7' FROM fits WHERE c2 IS NOT NULL""", "coefficient", "local_date"),
    Query("combined_experts", combined_experts, COMBINED_SQL, "rmse mae"),
    Query("weighted_ols", lambda s, d: shown(expert([365], ["lag_1"], ALPHA)(s, d)), WEIGHTED_SQL, "y_true y_pred rmse_train",
          "local_date"),
    Query("tune_window", lambda s, d: models.tune_window(expert(WINDOWS, since=max(WINDOWS))(s, d), ["zone"]), TUNE_SQL, "rmse"),
    Query("additive_model", additive),
    Query("additive_small", additive_small, SMALL_SQL + """
SELECT zone, local_date, CAST(0 AS INTEGER) AS hour, y AS y_true, y_pred, n AS n_train, rmse AS rmse_train FROM ahead""",
          "y_true y_pred rmse_train", "local_date", 5),
    Query("rmse_in_sample_small", rmse_small, SMALL_SQL + """
SELECT DISTINCT zone, DATE '1970-01-01' + CAST(first AS INTEGER) AS period, rmse AS rmse_train, n AS n_train FROM ahead""",
          "rmse_train", "period", 5),
    Query("long_short_small", long_short_small, PAIR_SQL, "y_true y_pred rmse_train", "local_date", 5),
    Query("additive_tensor", additive_tensor),
    Query("additive_hourly", additive_hourly),
    Query("additive_by_hour", additive_by_hour),
    Query("additive_difference", additive_difference),
    Query("rmse_in_sample", rmse_in_sample),
    Query("long_short_pair", long_short),
    Query("long_short_origin", long_short_origin),
    Query("tree_stump", tree_stump, STUMP_SQL, "y_true y_pred rmse_train", "local_date"),
    Query("trees_walk", trees_walk),
    Query("trees_importance", lambda s, d: trees.importances(trees_walk(s, d), WALK_INPUTS)),
    Query("trees_staged", trees_staged),
    Query("gbt_forecast", gbt_forecast),
    Query("gbt_importance", gbt_importance),
    Query("gbt_grid", gbt_grid),
]
