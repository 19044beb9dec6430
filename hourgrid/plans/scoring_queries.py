"""Combination of forecasts, errors and diagnostics."""
from __future__ import annotations

from pyspark.sql import functions as F

from hourgrid.operators import blocks, combine, scoring, windows
from hourgrid.plans import standin as st
from hourgrid.plans.model_queries import ETA_SQL, mixed_sql, walk_sql
from hourgrid.plans.registry import Query
from hourgrid.plans.window_queries import regression, regression_sql
from hourgrid.session import computed_once

ETA = 0.0005
ETAS = [2.0 ** -i for i in range(14, 6, -1)]  # small enough for the size of the errors
WINDOWS = (186, 365, 730)
EXPERTS = [f"naive_{k}" for k in st.NAIVE_DAYS]


def one_model(spark, d, model="naive_1"):
    return st.forecasts(spark, d).filter(F.col("model") == model)


def errors(spark, d):
    """Hourly errors of one model; cells without error are null."""
    return scoring.with_error(one_model(spark, d)).select("zone", "local_date", "hour", "error")


ERRORS_SQL = st.FORECAST_SQL + """,
errors AS (SELECT zone, local_date, hour, y_pred - y_true AS error FROM forecasts WHERE model = 'naive_1')"""


def stack_models(spark, d):
    experts = st.whole_forecasts(spark, d)
    mean = experts.groupBy("zone", "local_date", "hour").agg(F.lit("mean").alias("model"), F.max("y_true").alias("y_true"),
                                                             F.avg("y_pred").alias("y_pred"))
    return combine.stack_models(experts, mean)


def inverse_loss_mix(spark, d):
    experts = st.whole_forecasts(spark, d)
    return combine.inverse_loss_mix(experts, combine.model_losses(experts))


def pick_best(spark, d):
    cells = combine.choice_cells(st.forecasts(spark, d), "naive_1", "naive_7")
    return combine.pick_best(cells, combine.validation_choice_losses(cells))


def ewa_apply(spark, d):
    experts = computed_once(st.whole_forecasts(spark, d))
    return combine.ewa_apply(experts, combine.ewa_tune(experts, ETAS))


def ewa_with_reset(spark, d):
    out = combine.ewa_with_reset(st.whole_forecasts(spark, d), RESET_ETA, EXPERTS)
    shown = {f"{short}{i + 1}": F.col(c)[i] for c, short in (("weights", "w"), ("next_weights", "next")) for i in range(3)}
    return out.withColumns(shown).drop("weights", "next_weights")


def ewa_tune_reset(spark, d):
    return combine.ewa_tune_with_reset(st.whole_forecasts(spark, d), EXPERTS)


def ewa_apply_reset(spark, d):
    experts = computed_once(st.whole_forecasts(spark, d))
    out = combine.ewa_with_reset(experts, combine.ewa_tune_with_reset(experts, EXPERTS), EXPERTS)
    return combine.keep_last_days(out, 1 / 9).select("zone", "local_date", "hour", "y_true", "y_pred")


RESET_ETA = 0.002  # squared errors are some hundreds, so weights vanish now and then
RESET_CELLS = f"""{st.WHOLE_SQL},
wide AS (SELECT zone, local_date, hour, max(y_true) AS y, {', '.join(f"max(y_pred) FILTER (model = 'naive_{k}') AS p{i + 1}" for i, k in enumerate(st.NAIVE_DAYS))}
         FROM whole GROUP BY 1, 2, 3)"""
STEPS = "row_number() OVER (PARTITION BY zone, hour, i ORDER BY local_date) AS t"
RESET_SQL = f"""WITH RECURSIVE {RESET_CELLS},
c AS (SELECT *, {STEPS} FROM (SELECT *, 0 AS i, {RESET_ETA} AS eta FROM wide)),
{walk_sql('c', 'w')}
SELECT m.zone, m.local_date, m.hour, m.y_true, m.y_pred, (m.y_pred - m.y_true) ** 2 AS squared_loss,
       a.w1, a.w2, a.w3, b.w1 AS next1, b.w2 AS next2, b.w3 AS next3
FROM ({mixed_sql('c', 'w')}) m JOIN w a ON a.zone = m.zone AND a.hour = m.hour AND a.t = m.t
JOIN w b ON b.zone = m.zone AND b.hour = m.hour AND b.t = m.t + 1"""
RESET_TUNED = f"""{RESET_CELLS}, {ETA_SQL},
c AS (SELECT *, {STEPS} FROM wide, etas),
{walk_sql('c', 'w')},
mixed AS ({mixed_sql('c', 'w')}),
tuned AS (SELECT zone, hour, i, eta, loss FROM (SELECT zone, hour, i, eta, sum((y_pred - y_true) ** 2) AS loss FROM mixed GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY zone, hour ORDER BY loss, i) = 1)"""
RESET_APPLY_SQL = f"""WITH RECURSIVE {RESET_TUNED},
days AS (SELECT zone, local_date, row_number() OVER (PARTITION BY zone ORDER BY local_date) AS k,
                count(*) OVER (PARTITION BY zone) AS n FROM (SELECT DISTINCT zone, local_date FROM whole)),
kept AS (SELECT zone, local_date FROM days WHERE k > n - floor(n - n * (1.0 / 9)))
SELECT m.zone, m.local_date, m.hour, m.y_true, m.y_pred FROM mixed m
JOIN tuned u ON u.zone = m.zone AND u.hour = m.hour AND u.i = m.i
JOIN kept k ON k.zone = m.zone AND k.local_date = m.local_date"""


def ewa_cells_sql() -> str:
    """Loss of each expert before the day."""
    return f"""{st.WHOLE_SQL},
so_far AS (SELECT *, coalesce(sum((y_pred - y_true) ** 2) OVER (PARTITION BY zone, hour, model ORDER BY local_date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM whole)"""


EWA_TUNE_SQL = f"""{ewa_cells_sql()},
shifted AS (SELECT *, c - min(c) OVER (PARTITION BY zone, local_date, hour) AS g FROM so_far),
etas AS (SELECT i, power(2.0, i - 14) AS eta FROM range({len(ETAS)}) r(i)),
tried AS (SELECT zone, local_date, hour, i, eta, max(y_true) AS y_true,
                 sum(exp(-eta * g) * y_pred) / sum(exp(-eta * g)) AS y_pred
          FROM shifted, etas GROUP BY ALL),
totals AS (SELECT zone, hour, i, eta, sum((y_pred - y_true) ** 2) AS loss FROM tried GROUP BY ALL),
tuned AS (SELECT zone, hour, eta, loss FROM totals
          QUALIFY row_number() OVER (PARTITION BY zone, hour ORDER BY loss, i) = 1)"""


def level_from_diff(spark, d):
    """Forecast difference = yesterday's difference of the same hour."""
    diff = windows.difference(st.grid(spark, d, ["Price"]), "Price", 1, "day", "delta")
    diff = blocks.windowed(diff, 1, lambda w: {"y_pred": F.lag("delta", 24).over(w)}).select(
        "zone", "local_date", "hour", "y_pred")
    return combine.level_from_difference(diff, st.grid(spark, d, ["Price"]), "Price", 24)


def multiwindow_experts(spark, d):
    return regression(spark, d, WINDOWS).select(
        "zone", "local_date", F.concat(F.lit("D"), F.col("window").cast("string")).alias("model"),
        F.col("value").alias("y_true"), "y_pred")


def expert_sql_part(w: int) -> str:
    return f"SELECT zone, local_date, 'D{w}' AS model, value AS y_true, y_pred FROM ({regression_sql(w)})"


def series_for_acf(spark, d):
    return scoring.error_acf(errors(spark, d), 50)


def partial(given):
    def run(spark, d):
        cells = blocks.windowed(st.grid(spark, d, ["Price", "Load_A", "WindOn_DA", "Coal"]), 1,
                                lambda w: {"lagged": F.lag("Price", 24).over(w)})
        return scoring.partial_corr(cells, "Price", "Load_A", given)
    return run


def corr_sql(names: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a, b in pairs)


def cross_corr(spark, d):
    return scoring.cross_period_corr(st.grid(spark, d, ["Price"]), "Price", 1)


def hill(spark, d):
    return scoring.hill_index(st.table(spark, d, "orders"), "o_totalprice", start=14)


DM_SQL = f"""WITH {st.FILLED_FORECAST_SQL},
days AS (SELECT zone, local_date, sum(abs(y_pred - y_true)) FILTER (model = 'naive_1') AS a,
                sum(abs(y_pred - y_true)) FILTER (model = 'naive_7') AS b,
                count(y_pred - y_true) FILTER (model = 'naive_1') AS na,
                count(y_pred - y_true) FILTER (model = 'naive_7') AS nb
         FROM forecasts GROUP BY 1, 2),
s AS (SELECT zone, count(*) AS days, avg(a - b) AS m, var_pop(a - b) AS v FROM days WHERE na = 24 AND nb = 24 GROUP BY 1)
SELECT zone, days, m / nullif(sqrt(v / days), 0) * sqrt((days - 1) / days) AS statistic FROM s"""

ACF_SQL = f"""{ERRORS_SQL},
e AS (SELECT zone, local_date + to_hours(hour) AS t, error - avg(error) OVER (PARTITION BY zone) AS e FROM errors),
v AS (SELECT zone, sum(e * e) AS v FROM e GROUP BY 1),
c AS (SELECT a.zone, k.k AS lag, sum(a.e * b.e) AS c FROM range(1, 51) k(k), e a JOIN e b
      ON b.zone = a.zone AND b.t = a.t - to_hours(CAST(k.k AS INTEGER)) GROUP BY 1, 2),
acf AS (SELECT c.zone, CAST(c.lag AS INTEGER) AS lag, c.c / nullif(v.v, 0) AS acf FROM c JOIN v ON v.zone = c.zone)"""
PACF_SQL = f"""WITH RECURSIVE {ACF_SQL},
r AS (SELECT zone, list(coalesce(acf, 'nan'::DOUBLE) ORDER BY lag) AS r FROM acf GROUP BY 1),
levinson(zone, k, phi, last) AS (
  SELECT zone, 1, [r[1]], r[1] FROM r
  UNION ALL
  SELECT zone, k + 1, list_concat([phi[j] - next * phi[k + 1 - j] FOR j IN range(1, k + 1)], [next]), next
  FROM (SELECT l.zone, l.k, l.phi, (r.r[l.k + 1] - list_inner_product(l.phi, list_reverse(r.r[1:l.k])))
                                   / (1 - list_inner_product(l.phi, r.r[1:l.k])) AS next
        FROM levinson l JOIN r ON r.zone = l.zone WHERE l.k < len(r.r)))
SELECT zone, CAST(k AS INTEGER) AS lag, CASE WHEN NOT isnan(last) THEN last END AS pacf FROM levinson"""

# Student's t for whole degrees of freedom v = days - 1: a finite sum of powers of cos(theta), tan(theta) = t / sqrt(v).
DM_TEST_SQL = f"""WITH RECURSIVE stat AS ({DM_SQL}),
a AS (SELECT *, days - 1 AS v, atan(statistic / sqrt(days - 1)) AS th FROM stat),
term(zone, j, c) AS (
  SELECT zone, 0, CASE WHEN v % 2 = 0 THEN 1.0 ELSE cos(th) END FROM a
  UNION ALL
  SELECT term.zone, j + 1, c * cos(th) ** 2 * CASE WHEN v % 2 = 0 THEN (2 * j + 1) / (2 * j + 2.0) ELSE (2 * j + 2) / (2 * j + 3.0) END
  FROM term JOIN a ON a.zone = term.zone WHERE 2 * (j + 1) <= CASE WHEN v % 2 = 0 THEN v - 2 ELSE v - 3 END),
area AS (SELECT a.zone, sum(c) * sin(any_value(th)) AS s FROM term JOIN a ON a.zone = term.zone GROUP BY 1)
SELECT a.zone, days, statistic,
  (1 + CASE WHEN v % 2 = 0 THEN s WHEN v = 1 THEN 2 * th / pi() ELSE 2 / pi() * (th + s) END) / 2 AS p_value
FROM a JOIN area ON area.zone = a.zone"""


def unit_root_sql(lags: int) -> str:
    """Covariances of the regression, with the lagged changes swept out one by one."""
    names = ["y", "x", *[f"d{k}" for k in range(1, lags + 1)]]
    lagged = ", ".join(f"lag(y, {k}) OVER w AS d{k}" for k in range(1, lags + 1))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    steps = [f"""m0 AS (SELECT zone, count(*) AS n, {', '.join(f'covar_pop({a}, {b}) * count(*) AS {a}_{b}' for a, b in pairs)}
  FROM c WHERE {' + '.join(names)} IS NOT NULL GROUP BY 1)"""]
    for i in range(lags):
        z, left = names.pop(), names
        at = lambda a: f"{a}_{z}"
        kept = [(a, b) for j, a in enumerate(left) for b in left[j:]]
        steps.append(f"m{i + 1} AS (SELECT zone, n, {', '.join(f'{a}_{b} - {at(a)} * {at(b)} / {z}_{z} AS {a}_{b}' for a, b in kept)} FROM m{i})")
    return f"""WITH {st.GRID_SQL},
p AS (SELECT zone, local_date, hour, Price - lag(Price) OVER w AS y, lag(Price) OVER w AS x FROM grid
      WINDOW w AS (PARTITION BY zone ORDER BY local_date, hour)),
c AS (SELECT *, {lagged} FROM p WINDOW w AS (PARTITION BY zone ORDER BY local_date, hour)),
{', '.join(steps)}
SELECT zone, n, CASE WHEN n > {lags + 2} THEN y_x / x_x / sqrt((y_y - y_x * y_x / x_x) / (n - {lags + 2}) / x_x) END AS statistic
FROM m{lags}"""


SCORING_QUERIES = [
    Query("stack_models", stack_models, f"""WITH {st.WHOLE_SQL} SELECT * FROM whole
UNION ALL SELECT zone, local_date, hour, 'mean', max(y_true), avg(y_pred) FROM whole GROUP BY zone, local_date, hour""",
          "y_true y_pred", "local_date"),
    Query("error_table", lambda s, d: scoring.error_table(st.forecasts(s, d)), f"""WITH {st.FORECAST_SQL}
SELECT model, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae FROM forecasts GROUP BY 1""",
          "rmse mae"),
    Query("hourly_rmse", lambda s, d: scoring.error_table(st.forecasts(s, d), ["model", "hour"]).select(
        "model", "hour", "rmse"), f"""WITH {st.FORECAST_SQL}
SELECT model, hour, sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM forecasts GROUP BY 1, 2""", "rmse"),
    Query("rmse_two_ways", lambda s, d: scoring.rmse_two_ways(st.forecasts(s, d)), f"""WITH {st.FORECAST_SQL},
d AS (SELECT zone, model, local_date, sqrt(avg((y_pred - y_true) ** 2)) AS r FROM forecasts GROUP BY 1, 2, 3)
SELECT a.zone, a.model, a.rmse_pooled, b.rmse_mean_of_days
FROM (SELECT zone, model, sqrt(avg((y_pred - y_true) ** 2)) AS rmse_pooled FROM forecasts GROUP BY 1, 2) a
JOIN (SELECT zone, model, avg(r) AS rmse_mean_of_days FROM d GROUP BY 1, 2) b ON b.zone = a.zone AND b.model = a.model""",
          "rmse_pooled rmse_mean_of_days"),
    Query("worst_hours", lambda s, d: scoring.worst_cells(errors(s, d), 20), f"""WITH {ERRORS_SQL}
SELECT zone, local_date, hour, error, abs(error) AS abs_error, dayname(local_date) AS day_name FROM errors
WHERE error IS NOT NULL ORDER BY abs_error DESC, zone, local_date, hour LIMIT 20""", "error abs_error", "local_date"),
    Query("error_hotspots", lambda s, d: scoring.error_hotspots(errors(s, d), 100), f"""WITH {ERRORS_SQL},
t AS (SELECT * FROM errors WHERE error IS NOT NULL ORDER BY abs(error) DESC, zone, local_date, hour LIMIT 100)
SELECT dayname(local_date) AS day_name, hour, count(*) AS hits FROM t GROUP BY 1, 2"""),
    Query("dm_statistic", lambda s, d: scoring.dm_statistic(st.forecasts(s, d, True), "naive_1", "naive_7"), DM_SQL,
          "statistic"),
    Query("dm_test", lambda s, d: scoring.dm_test(st.forecasts(s, d, True), "naive_1", "naive_7"), DM_TEST_SQL,
          "statistic p_value"),
    Query("cross_period_corr", cross_corr, f"""WITH {st.GRID_SQL}
SELECT a.zone, a.hour AS s, b.hour AS l, nullif(corr(a.Price, b.Price), 'nan') AS corr FROM grid a
JOIN grid b ON b.zone = a.zone AND b.local_date = a.local_date - 1 GROUP BY 1, 2, 3""", "corr"),
    Query("partial_corr", partial(["lagged"]), f"""WITH {st.GRID_SQL},
x AS (SELECT zone, Price AS y, Load_A AS x, lag(Price, 24) OVER (PARTITION BY zone ORDER BY local_date, hour) AS z FROM grid),
r AS (SELECT zone, {corr_sql(['y', 'x', 'z'])} FROM x WHERE y + x + z IS NOT NULL GROUP BY 1)
SELECT zone, (y_x - y_z * x_z) / sqrt((1 - y_z ** 2) * (1 - x_z ** 2)) AS partial_corr FROM r""", "partial_corr"),
    Query("partial_corr_two", partial(["lagged", "WindOn_DA"]), f"""WITH {st.GRID_SQL},
x AS (SELECT zone, Price AS y, Load_A AS x, lag(Price, 24) OVER (PARTITION BY zone ORDER BY local_date, hour) AS a,
      WindOn_DA AS b FROM grid),
r AS (SELECT zone, {corr_sql(['y', 'x', 'a', 'b'])} FROM x WHERE y + x + a + b IS NOT NULL GROUP BY 1),
p AS (SELECT zone, (y_x - y_a * x_a) / sqrt((1 - y_a ** 2) * (1 - x_a ** 2)) AS yx,
      (y_b - y_a * a_b) / sqrt((1 - y_a ** 2) * (1 - a_b ** 2)) AS yb,
      (x_b - x_a * a_b) / sqrt((1 - x_a ** 2) * (1 - a_b ** 2)) AS xb FROM r)
SELECT zone, (yx - yb * xb) / sqrt((1 - yb ** 2) * (1 - xb ** 2)) AS partial_corr FROM p""", "partial_corr"),
    Query("error_acf", series_for_acf, f"WITH {ACF_SQL} SELECT * FROM acf", "acf"),
    Query("error_pacf", lambda s, d: scoring.error_pacf(errors(s, d), 50), PACF_SQL, "pacf"),
    Query("unit_root_stat", lambda s, d: scoring.unit_root_stat(st.grid(s, d, ["Price"]), "Price"),
          f"""WITH {st.GRID_SQL}, x AS (SELECT zone, Price - p AS dy, p FROM (SELECT zone, Price,
  lag(Price, 1) OVER (PARTITION BY zone ORDER BY local_date, hour) AS p FROM grid) WHERE Price + p IS NOT NULL),
r AS (SELECT zone, count(*) AS n, regr_slope(dy, p) AS b, regr_syy(dy, p) AS syy, regr_sxx(dy, p) AS sxx FROM x GROUP BY 1)
SELECT zone, n, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS statistic FROM r""", "statistic", "", 4),
    Query("unit_root_lags", lambda s, d: scoring.unit_root_stat(st.grid(s, d, ["Price"]), "Price", 3), unit_root_sql(3),
          "statistic"),
    Query("hill_top", lambda s, d: scoring.hill_index(st.table(s, d, "lineitem"), "l_quantity", 14, 4000), """WITH o AS (
  SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity DESC) AS k FROM lineitem WHERE l_quantity > 0),
x AS (SELECT k, avg(ln(v)) OVER (ORDER BY k) - ln(v) AS xi FROM o)
SELECT k, a AS alpha, a * (1 - 1.959963984540054 / sqrt(k)) AS low, a * (1 + 1.959963984540054 / sqrt(k)) AS high
FROM (SELECT k, CASE WHEN abs(xi) > 1e-12 THEN 1 / xi END AS a FROM x) WHERE k > 15 AND k <= 4001""",
          "alpha low high"),
    Query("hill_index", hill, """WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) AS k
  FROM orders WHERE o_totalprice > 0),
x AS (SELECT k, avg(ln(v)) OVER (ORDER BY k) - ln(v) AS xi FROM o)
SELECT k, 1 / nullif(xi, 0) AS alpha, 1 / nullif(xi, 0) * (1 - 1.959963984540054 / sqrt(k)) AS low,
       1 / nullif(xi, 0) * (1 + 1.959963984540054 / sqrt(k)) AS high FROM x WHERE k > 15""", "alpha low high"),
    # combination
    Query("inverse_loss_mix", inverse_loss_mix, f"""WITH {st.WHOLE_SQL},
l AS (SELECT zone, model, avg((y_pred - y_true) ** 2) AS loss FROM whole GROUP BY 1, 2)
SELECT w.zone, w.local_date, w.hour, max(w.y_true) AS y_true, sum(w.y_pred / l.loss) / sum(1 / l.loss) AS y_pred
FROM whole w JOIN l ON l.zone = w.zone AND l.model = w.model GROUP BY 1, 2, 3""", "y_true y_pred", "local_date"),
    Query("pick_best", pick_best, f"""WITH {st.FORECAST_SQL},
b AS (SELECT c.zone, c.local_date, c.hour, c.y_true, c.y_pred AS c, p.y_pred AS p FROM forecasts c JOIN forecasts p
      ON p.zone = c.zone AND p.local_date = c.local_date AND p.hour = c.hour AND p.model = 'naive_7'
      WHERE c.model = 'naive_1'),
d AS (SELECT zone, local_date, count(y_true + c + p) AS n, sum((c - y_true) ** 2) AS sc, sum((p - y_true) ** 2) AS sp,
             sum(((c + p) / 2 - y_true) ** 2) AS sm FROM b GROUP BY 1, 2),
v AS (SELECT zone, local_date, sum(sc) OVER w / nullif(sum(n) OVER w, 0) AS lc,
             sum(sp) OVER w / nullif(sum(n) OVER w, 0) AS lp, sum(sm) OVER w / nullif(sum(n) OVER w, 0) AS lm FROM d
      WINDOW w AS (PARTITION BY zone ORDER BY local_date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
k AS (SELECT zone, local_date, coalesce(lc, 'inf') AS lc, coalesce(lp, 'inf') AS lp, coalesce(lm, 'inf') AS lm FROM v),
q AS (SELECT zone, local_date, CASE WHEN lc <= lp AND lc <= lm THEN 'current' WHEN lp <= lm THEN 'previous' ELSE 'mean'
      END AS choice FROM k)
SELECT b.zone, b.local_date, b.hour, b.y_true, CASE q.choice WHEN 'current' THEN c WHEN 'previous' THEN p
ELSE (c + p) / 2 END AS y_pred, q.choice FROM b JOIN q ON q.zone = b.zone AND q.local_date = b.local_date""",
          "y_true y_pred", "local_date"),
    Query("ewa_weights", lambda s, d: combine.ewa_weights(st.whole_forecasts(s, d), ETA), f"""WITH {ewa_cells_sql()},
shifted AS (SELECT *, exp(-{ETA} * (c - min(c) OVER (PARTITION BY zone, local_date, hour))) AS u FROM so_far)
SELECT zone, local_date, hour, model, u / sum(u) OVER (PARTITION BY zone, local_date, hour) AS weight FROM shifted""",
          "weight", "local_date"),
    Query("ewa_tune", lambda s, d: combine.ewa_tune(st.whole_forecasts(s, d), ETAS),
          f"WITH {EWA_TUNE_SQL} SELECT zone, hour, eta, loss FROM tuned", "eta loss"),
    Query("ewa_apply", ewa_apply, f"""WITH {EWA_TUNE_SQL},
days AS (SELECT zone, local_date, row_number() OVER (PARTITION BY zone ORDER BY local_date) AS i,
                count(*) OVER (PARTITION BY zone) AS n FROM (SELECT DISTINCT zone, local_date FROM whole)),
kept AS (SELECT zone, local_date FROM days WHERE i > n - floor(n - n * (1.0 / 9)))
SELECT t.zone, t.local_date, t.hour, t.y_true, t.y_pred FROM tried t
JOIN tuned u ON u.zone = t.zone AND u.hour = t.hour AND u.eta = t.eta
JOIN kept k ON k.zone = t.zone AND k.local_date = t.local_date""", "y_true y_pred", "local_date"),
    Query("ewa_reset", ewa_with_reset, RESET_SQL, "y_true y_pred squared_loss w1 w2 w3 next1 next2 next3", "local_date"),
    Query("ewa_tune_reset", ewa_tune_reset, f"WITH RECURSIVE {RESET_TUNED} SELECT zone, hour, eta, loss FROM tuned", "eta loss"),
    Query("ewa_apply_reset", ewa_apply_reset, RESET_APPLY_SQL, "y_true y_pred", "local_date"),
    Query("level_from_diff", level_from_diff, f"""WITH {st.GRID_SQL},
x AS (SELECT zone, local_date, hour, Price, lag(Price, 24) OVER w AS p, lag(Price, 48) OVER w AS pp FROM grid
      WINDOW w AS (PARTITION BY zone ORDER BY local_date, hour))
SELECT zone, local_date, hour, p - pp AS y_pred, p - pp + p AS y_level FROM x""", "y_pred y_level", "local_date"),
    Query("multiwindow_experts", multiwindow_experts, " UNION ALL ".join(expert_sql_part(w) for w in WINDOWS),
          "y_true y_pred", "local_date", 3),
]
