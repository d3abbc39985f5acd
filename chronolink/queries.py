"""Queries over the star-schema tables, each with its DuckDB counterpart where SQL can say it.

Doubles are rounded to six places on both sides, since engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import adequacy, chartdata, consensus, correlation, diagnostics, discovery, evaluation, fdr, memory, quality, reports, robustness, stability, surrogates, transforms
from .plans import router
from .schema import IDX, TS, UNIT, normalise_edges
from .sources import io, views
from .sources.views import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
EV, PL, SH = views.EVENT_TYPES, ["X", "Y", "Z"], views.SHIP
PAIRS = [(a, b) for a in PL for b in PL if a != b]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{n}`"), digits)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def R(x: str) -> str:
    """A rounded SQL expression, without negative zeros."""
    return f"round({x}, 6) + 0.0"


def cols(names: list[str], make: Callable[[str], str] = lambda c: c) -> str:
    return ", ".join(f'{R(make(chr(34) + c + chr(34)))} AS "{c}"' for c in names)


def CORR(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)"


def pair_sql(view: str, pairs: list[tuple[str, str]], lags: list[int]) -> str:
    """CTE pr(unit_id, source, target, lag, t_idx, x, y)."""
    parts = [f"""SELECT unit_id, '{s}' AS source, '{t}' AS target, {k} AS lag, t_idx, lag("{s}", {k}) OVER (PARTITION BY unit_id ORDER BY t_idx) AS x, "{t}" AS y FROM {view}""" if k else f"""SELECT unit_id, '{s}' AS source, '{t}' AS target, 0 AS lag, t_idx, "{s}" AS x, "{t}" AS y FROM {view}""" for s, t in pairs for k in lags]
    return "pr AS (" + "\nUNION ALL ".join(parts) + ")"


def beta_sql(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function by its series, reflected where that converges faster."""
    def series(x: str, a: str, b: str) -> str:
        return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - ({x}))) / {a} * list_sum(list_transform(range(0, 1500), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) + lgamma({a} + 1) - lgamma({a} + 1 + k) + k * ln({x}))))"

    return f"CASE WHEN ({x}) <= 0 THEN 0.0 WHEN ({x}) >= 1 THEN 1.0 WHEN ({x}) > 0.9 THEN 1 - {series(f'(1 - ({x}))', b, a)} ELSE {series(f'({x})', a, b)} END"


def t_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: I_{1-r^2}(df/2, 1/2)."""
    return beta_sql(f"1 - {r} * {r}", f"(({n} - 2) / 2.0::DOUBLE)", "0.5::DOUBLE")


# ---- series ----------------------------------------------------------------------------------------------------------


@query("series_pivot_mean", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, """ + ", ".join(f"{R(f'avg(value) FILTER (event_type = {chr(39)}{e}{chr(39)})')} AS \"{e}\"" for e in EV) + " FROM events GROUP BY 1")
def _(spark, sf):
    e = views.event_long(spark, sf).withColumn(TS, F.date_trunc("day", TS).cast("timestamp_ntz"))
    return io.pivot_series(e, None, "variable", "value", EV).select(F.date_format(TS, "yyyy-MM-dd").alias("day"), *EV)


@query("series_sampling_interval", sql("order_daily") + " SELECT CAST(d AS DOUBLE) AS sampling_days FROM (SELECT date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS d FROM order_daily) WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1")
def _(spark, sf):
    return io.sampling_interval(views.order_daily(spark, sf))


@query("series_sampling_days", sql("order_daily") + " SELECT CAST(median(d) AS DOUBLE) AS sampling_days FROM (SELECT date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS d FROM order_daily)")
def _(spark, sf):
    return io.sampling_days(views.order_daily(spark, sf), ["total"])


def interp_sql(view: str, c: str) -> str:
    v = f'"{c}"'
    w0, w1 = "OVER (PARTITION BY unit_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY unit_id ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {v} IS NOT NULL THEN t_idx END"
    v0, t0, v1, t1 = f"last_value({v} IGNORE NULLS) {w0}", f"last_value({at} IGNORE NULLS) {w0}", f"first_value({v} IGNORE NULLS) {w1}", f"first_value({at} IGNORE NULLS) {w1}"
    return f"coalesce({v}, {v0} + ({v1} - {v0}) * (t_idx - {t0}) / nullif({t1} - {t0}, 0), {v0}, {v1})"


@query("series_grid_interpolate", sql("order_daily") + f""", g AS (SELECT CAST(unnest(generate_series((SELECT min(ts) FROM order_daily), (SELECT max(ts) FROM order_daily), INTERVAL 1 DAY)) AS DATE) AS ts),
j AS (SELECT 'all' AS unit_id, g.ts, total, n, row_number() OVER (ORDER BY g.ts) - 1 AS t_idx FROM g LEFT JOIN order_daily o ON o.ts = g.ts)
SELECT unit_id, strftime(ts, '%Y-%m-%d') AS day, t_idx, {R(interp_sql('j', 'total'))} AS total, {R(interp_sql('j', 'n'))} AS n FROM j""")
def _(spark, sf):
    return io.harmonize(views.order_daily(spark, sf), ["total", "n"], 1).select(UNIT, F.date_format(TS, "yyyy-MM-dd").alias("day"), IDX, "total", "n")


@query("series_interpolate_events", sql("event_wide") + f" SELECT unit_id, t_idx, {', '.join(R(interp_sql('event_wide', c)) + f' AS {chr(34)}{c}{chr(34)}' for c in EV)} FROM event_wide")
def _(spark, sf):
    return transforms.interpolate(views.event_wide(spark, sf), EV).select(UNIT, IDX, *EV)


def fence_sql(c: str) -> str:
    q = lambda p: f"(SELECT quantile_cont({c}, {p}) FROM ship_daily)"
    bad = f"{c} < {q(0.25)} - 1.5 * ({q(0.75)} - {q(0.25)}) OR {c} > {q(0.75)} + 1.5 * ({q(0.75)} - {q(0.25)})"
    return f"CASE WHEN {bad} THEN greatest(least({c}, {q(0.99)}), {q(0.01)}) ELSE {c} END"


@query("series_iqr_clip", sql("ship_daily") + f" SELECT unit_id, t_idx, {', '.join(R(fence_sql(c)) + f' AS {c}' for c in SH)} FROM ship_daily")
def _(spark, sf):
    return quality.outliers(views.ship_daily(spark, sf), SH).select(UNIT, IDX, *SH)


@query("series_outlier_flag", sql("ship_daily") + f" SELECT unit_id, t_idx, {' OR '.join(f'abs({c} - (SELECT avg({c}) FROM ship_daily)) > 2.5 * (SELECT stddev_samp({c}) FROM ship_daily)' for c in SH)} AS flagged FROM ship_daily")
def _(spark, sf):
    return quality.outliers(views.ship_daily(spark, sf), SH, "zscore", z=2.5, mode="flag").select(UNIT, IDX, F.col("__outlier_flag__").alias("flagged"))


@query("series_zscore", sql("ship_daily") + f" SELECT unit_id, t_idx, {cols(SH, lambda c: f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} FROM ship_daily")
def _(spark, sf):
    return transforms.zscore(views.ship_daily(spark, sf), SH).select(UNIT, IDX, *SH)


@query("series_difference", sql("ship_panel") + """ SELECT unit_id, t_idx, round(a, 6) + 0.0 AS qty, round(b, 6) + 0.0 AS price FROM (SELECT unit_id, t_idx, qty - lag(qty) OVER w AS a, price - lag(price) OVER w AS b FROM ship_panel WINDOW w AS (PARTITION BY unit_id ORDER BY t_idx)) WHERE a IS NOT NULL""")
def _(spark, sf):
    return transforms.difference(views.ship_panel(spark, sf), ["qty", "price"]).select(UNIT, IDX, "qty", "price")


@query("series_rolling_anomaly", sql("ship_daily") + f" SELECT unit_id, t_idx, {R('qty - avg(qty) OVER (ORDER BY t_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)')} AS qty FROM ship_daily")
def _(spark, sf):
    return transforms.rolling_anomaly(views.ship_daily(spark, sf), "qty", 31).select(UNIT, IDX, "qty")


@query("series_seasonal_terms", sql("ship_daily") + " SELECT unit_id, t_idx, " + ", ".join(f"{R(f'{f}({2 * math.pi * k / 365} * dayofyear(ts))')} AS {f}_{k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM ship_daily")
def _(spark, sf):
    return transforms.seasonal_terms(views.ship_daily(spark, sf)).select(UNIT, IDX, "sin_1", "cos_1", "sin_2", "cos_2")


@query("series_resample_6h", f"""SELECT 'all' AS unit_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS ts, {R('avg(value)')} AS value FROM events GROUP BY 2""")
def _(spark, sf):
    return transforms.resample(views.event_long(spark, sf).withColumn(UNIT, F.lit("all")), ["value"])


@query("series_restrict_year", sql("ship_daily") + f" SELECT unit_id, t_idx, {cols(SH)} FROM ship_daily WHERE year(ts) = 1998")
def _(spark, sf):
    return views.ship_daily(spark, sf).where(F.year(TS) == 1998).select(UNIT, IDX, *SH)


@query("series_seasonal_detrend", sql("ship_daily") + f""", m AS (SELECT unit_id, t_idx, qty - avg(qty) OVER w AS d, count(qty) OVER w AS k FROM ship_daily WINDOW w AS (ORDER BY t_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT unit_id, t_idx, {R('d - avg(d) OVER (PARTITION BY t_idx % 7)')} AS qty FROM m WHERE k >= 7""")
def _(spark, sf):
    return transforms.seasonal_detrend(views.ship_daily(spark, sf), "qty", 7).select(UNIT, IDX, "qty")


@query("series_lag_embed", sql("planted") + f""" SELECT unit_id, t_idx, {R('"Y"')} AS "Y", {', '.join(R(f'lag("{c}", {k}) OVER (ORDER BY t_idx)') + f' AS "{c}_lag_{k}"' for c in PL for k in (1, 2, 3))} FROM planted QUALIFY lag("X", 3) OVER (ORDER BY t_idx) IS NOT NULL""")
def _(spark, sf):
    return transforms.lag_embed(views.planted(spark, sf), {c: [1, 2, 3] for c in PL}, ["Y"]).na.drop()


def bin_sql(c: str, view: str = "planted") -> str:
    return f"greatest(len(list_filter(list_distinct((SELECT quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM {view})), lambda e: e < {c})) - 1, 0)"


@query("series_discretize", sql("planted") + f""" SELECT unit_id, t_idx, {', '.join(f'CAST({bin_sql(chr(34) + c + chr(34))} AS INTEGER) AS "{c}"' for c in PL)} FROM planted""")
def _(spark, sf):
    return transforms.discretize(views.planted(spark, sf).select(UNIT, IDX, *PL), PL)


@query("series_long", sql("ship_panel") + " SELECT unit_id, t_idx, variable, round(value, 6) + 0.0 AS value FROM (UNPIVOT (SELECT unit_id, t_idx, qty, price FROM ship_panel) ON qty, price INTO NAME variable VALUE value)")
def _(spark, sf):
    from .schema import to_long

    return to_long(views.ship_panel(spark, sf).select(UNIT, IDX, "qty", "price"))


@query("series_sample_exact", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 500")
def _(spark, sf):
    return io.sample_exact(views.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 500, ["l_orderkey", "l_linenumber"])


@query("panel_median_series", sql("ship_panel") + f" SELECT ts, {R('median(qty)')} AS qty, {R('median(price)')} AS price FROM ship_panel GROUP BY ts")
def _(spark, sf):
    return views.ship_panel(spark, sf).groupBy(TS).agg(F.median("qty").alias("qty"), F.median("price").alias("price"))


# ---- data quality ------------------------------------------------------------------------------------------------------

_LONG = "(SELECT {k} {c} FROM {v}) UNPIVOT INCLUDE NULLS (value FOR variable IN ({c}))"
_COVER = f"count(value) AS n_valid, count(*) - count(value) AS n_missing, {R('100.0 * count(value) / count(*)')} AS coverage_pct, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std"
_EVC = ", ".join(f'"{c}"' for c in EV)


@query("qc_coverage", sql("event_wide") + f" SELECT variable, {_COVER} FROM {_LONG.format(k='', c=_EVC, v='event_wide')} GROUP BY variable")
def _(spark, sf):
    return quality.coverage(views.event_wide(spark, sf), EV)


@query("qc_coverage_by_unit", sql("ship_panel") + f" SELECT unit_id, variable, {_COVER} FROM {_LONG.format(k='unit_id,', c='qty, price', v='ship_panel')} GROUP BY ALL")
def _(spark, sf):
    return quality.coverage(views.ship_panel(spark, sf), ["qty", "price"], UNIT)


def _user_day(spark, sf):
    """Per user, the days with a value, on the grid of all days."""
    e = views.event_long(spark, sf).groupBy(UNIT, F.to_date(TS).alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    grid = e.select(UNIT).distinct().crossJoin(F.broadcast(e.select("day").distinct()))  # days are few and fixed
    return grid.join(e, [UNIT, "day"], "left")


_USER_DAY = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS unit_id, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
g AS (SELECT u.unit_id, d.day, e.value FROM (SELECT DISTINCT unit_id FROM e) u CROSS JOIN (SELECT DISTINCT day FROM e) d LEFT JOIN e USING (unit_id, day))"""


@query("qc_low_coverage_flag", _USER_DAY + " SELECT unit_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN 100.0 * count(value) OVER (PARTITION BY unit_id) / count(*) OVER (PARTITION BY unit_id) < 85 THEN 'low_coverage' ELSE 'pass' END AS flag FROM g")
def _(spark, sf):
    return quality.flag_low_coverage(_user_day(spark, sf), ["value"], 85, UNIT).select(UNIT, F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("__qc_flag__").alias("flag"))


@query("qc_na_policy", sql("event_wide") + f""", f AS (SELECT unit_id, t_idx, {', '.join(f'''CASE WHEN last_value("{c}" IGNORE NULLS) OVER (ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL THEN {interp_sql('event_wide', c)} END AS "{c}"''' for c in EV)} FROM event_wide)
SELECT unit_id, t_idx, {', '.join(R(f'greatest(least("{c}", (SELECT quantile_cont("{c}", 0.95) FROM f)), (SELECT quantile_cont("{c}", 0.05) FROM f))') + f' AS "{c}"' for c in EV)} FROM f WHERE {' AND '.join(f'"{c}" IS NOT NULL' for c in EV)}""")
def _(spark, sf):
    return quality.na_policy(views.event_wide(spark, sf), EV).select(UNIT, IDX, *EV)


@query("qc_effective_n", sql("event_wide") + f" SELECT greatest(0, count(*) FILTER ({' AND '.join(f'{chr(34)}{c}{chr(34)} IS NOT NULL' for c in EV)}) - 12) AS effective_n FROM event_wide")
def _(spark, sf):
    return quality.effective_n(views.event_wide(spark, sf), EV, 12)


@query("qc_mask_flags", "SELECT 'l_returnflag' AS \"column\", count(l_returnflag) AS n_valid, count(*) AS n, " + R("100.0 * count(l_returnflag) / count(*)") + " AS coverage_pct FROM lineitem")
def _(spark, sf):
    return quality.mask_coverage(views.read(spark, sf, "lineitem"))


@query("adequacy_report", """WITH m(method, required) AS (VALUES ('parcorr', 50), ('robust_parcorr', 60), ('cmiknn', 200), ('gpdc', 500), ('granger', 85), ('varlingam', 120), ('transfer_entropy', 200), ('lpcmci', 75))
SELECT method, CAST(4 AS INTEGER) AS n_vars, CAST(6 AS INTEGER) AS tau_max, CAST(150 AS INTEGER) AS t_eff, CAST(greatest(required, CASE method WHEN 'varlingam' THEN 5 * 4 * 7 WHEN 'cmiknn' THEN 10 * ceil(2 ** 4.0) WHEN 'transfer_entropy' THEN 10 * ceil(2 ** 4.0) ELSE 0 END) AS BIGINT) AS required,
round(CASE WHEN 150 >= greatest(required, CASE method WHEN 'varlingam' THEN 140 ELSE 0 END) THEN 1.0 ELSE 150.0 / required END, 6) AS score, CASE WHEN 150 >= greatest(required, CASE method WHEN 'varlingam' THEN 140 ELSE 0 END) THEN true ELSE 150.0 / required >= 0.7 END AS adequate FROM m""")
def _(spark, sf):
    return adequacy.report(spark, 4, 6, 150)


@query("power_cmiknn", "SELECT CAST(k AS INTEGER) AS t_eff, " + R("2 * sqrt((0.1 + 1.0 / k) * (1 + 8 / 4.0))") + " AS effect, CASE WHEN 2 * sqrt((0.1 + 1.0 / k) * 3) < 0.4 THEN 'low' ELSE 'insufficient' END AS band FROM (VALUES (50), (200), (1000)) t(k)")
def _(spark, sf):
    d = spark.createDataFrame([(50,), (200,), (1000,)], "t_eff int")
    d = d.withColumn("effect", adequacy.detectable_cmiknn(F.col("t_eff"), F.lit(4), F.lit(3)))
    return d.withColumn("band", adequacy.power_band(F.col("effect")))


# ---- association -------------------------------------------------------------------------------------------------------

_UP = [(a, b) for i, a in enumerate(SH) for b in SH[i + 1 :]]
_C = CORR("x", "y")


@query("corr_pearson_pairs", sql("ship_daily") + ", " + pair_sql("ship_daily", _UP, [0]) + f", c AS (SELECT unit_id, source, target, count(x + y) AS n, {_C} AS r FROM pr GROUP BY ALL) SELECT unit_id, source, target, n, {R('r')} AS r, {R(t_sql('r', 'n'))} AS p_value FROM c")
def _(spark, sf):
    return correlation.with_test(correlation.pearson(views.ship_daily(spark, sf), _UP)).select(UNIT, "source", "target", "n", "r", "p_value")


_RANK = "rank() OVER (PARTITION BY source, target, lag ORDER BY {c}) + (count(*) OVER (PARTITION BY source, target, lag, {c}) - 1) / 2.0"


@query("corr_spearman_pairs", sql("ship_daily") + ", " + pair_sql("ship_daily", _UP, [0]) + f", k AS (SELECT unit_id, source, target, {_RANK.format(c='x')} AS x, {_RANK.format(c='y')} AS y FROM pr) SELECT unit_id, source, target, count(*) AS n, {R(_C)} AS r FROM k GROUP BY ALL")
def _(spark, sf):
    return correlation.spearman(views.ship_daily(spark, sf), _UP).drop("lag")


_ALL = ", s AS (SELECT * FROM planted)"


@query("corr_kendall", sql("planted") + _ALL + f""", p AS (SELECT sign(a."X" - b."X") AS x, sign(a."Y" - b."Y") AS y FROM s a JOIN s b ON a.t_idx < b.t_idx)
SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, (SELECT count(*) FROM s) AS n, {R('sum(x * y) / sqrt(sum(x * x) * sum(y * y))')} AS r FROM p""")
def _(spark, sf):
    return correlation.kendall(views.planted(spark, sf), [("X", "Y")]).drop("lag")


@query("corr_distance", sql("planted") + _ALL + f""", d AS (SELECT a.t_idx AS i, abs(a."X" - b."X") AS x, abs(a."Y" - b."Y") AS y FROM s a CROSS JOIN s b), m AS (SELECT i, avg(x) AS x, avg(y) AS y FROM d GROUP BY i),
g AS (SELECT avg(x * y) AS xy, avg(x * x) AS xx, avg(y * y) AS yy, avg(x) AS gx, avg(y) AS gy FROM d), h AS (SELECT avg(x * y) AS xy, avg(x * x) AS xx, avg(y * y) AS yy FROM m),
v AS (SELECT g.xy - 2 * h.xy + gx * gy AS xy, g.xx - 2 * h.xx + gx * gx AS xx, g.yy - 2 * h.yy + gy * gy AS yy FROM g, h)
SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, (SELECT count(*) FROM s) AS n, {R('sqrt(xy) / sqrt(sqrt(xx * yy))')} AS r, {R('sqrt(xy)')} AS dcov FROM v""")
def _(spark, sf):
    return correlation.distance(views.planted(spark, sf), [("X", "Y")]).drop("lag")


@query("corr_partial_k1", sql("planted") + f""", c AS (SELECT count(*) AS n, corr("X", "Y") AS a, corr("X", "Z") AS b, corr("Y", "Z") AS c FROM planted) SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, 'Z' AS given, n, {R('(a - b * c) / sqrt((1 - b * b) * (1 - c * c))')} AS r FROM c""")
def _(spark, sf):
    return correlation.partial_one(views.planted(spark, sf), "X", "Y", "Z")


@query("corr_partial_matrix", sql("planted") + f""", c AS (SELECT count(*) AS n, corr("X", "Y") AS a, corr("X", "Z") AS b, corr("Y", "Z") AS c FROM planted) SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, 'Z' AS given, n, {R('(a - b * c) / sqrt((1 - b * b) * (1 - c * c))')} AS r FROM c""")
def _(spark, sf):
    return correlation.partial(views.planted(spark, sf), "X", "Y", ["Z"])


@query("corr_sparse", sql("ship_daily") + ", " + pair_sql("ship_daily", _UP, [0]) + f", c AS (SELECT unit_id, source, target, count(x + y) AS n, {_C} AS r FROM pr GROUP BY ALL) SELECT unit_id, source, target, n, {R('r')} AS r FROM c WHERE {t_sql('r', 'n')} < 0.05")
def _(spark, sf):
    return correlation.sparse(views.ship_daily(spark, sf), SH).select(UNIT, "source", "target", "n", "r")


@query("corr_fisher_ci", sql("ship_daily") + ", " + pair_sql("ship_daily", _UP, [0]) + f""", c AS (SELECT unit_id, source, target, count(x + y) AS n, {_C} AS r FROM pr GROUP BY ALL)
SELECT unit_id, source, target, {R('tanh(atanh(r) - 1.96 / sqrt(n - 3))')} AS ci_low, {R('tanh(atanh(r) + 1.96 / sqrt(n - 3))')} AS ci_high, (CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very strong' END) || ' ' || (CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END) || ' linear' AS label FROM c""")
def _(spark, sf):
    return correlation.with_test(correlation.pearson(views.ship_daily(spark, sf), _UP)).select(UNIT, "source", "target", "ci_low", "ci_high", "label")


@query("corr_matrix", sql("event_wide") + ", " + pair_sql("event_wide", [(a, b) for a in EV for b in EV], [0]) + f" SELECT unit_id, source AS var1, target AS var2, {R(_C)} AS r FROM pr GROUP BY ALL")
def _(spark, sf):
    return correlation.matrix(views.event_wide(spark, sf), EV)


_LAGS = list(range(1, 11))


@query("lag_corr", sql("ship_daily") + ", " + pair_sql("ship_daily", [(a, b) for a in SH for b in SH if a != b], _LAGS) + f", c AS (SELECT unit_id, source, target, lag, count(x + y) AS n, {_C} AS r FROM pr GROUP BY ALL) SELECT unit_id, source, target, lag AS lag_steps, n AS n_obs, {R('r')} AS statistic, row_number() OVER (PARTITION BY unit_id, source, target ORDER BY abs(r) DESC, lag) = 1 AS is_best_lag FROM c WHERE n >= 10")
def _(spark, sf):
    return correlation.lagged_edges(views.ship_daily(spark, sf), [(a, b) for a in SH for b in SH if a != b]).select(UNIT, "source", "target", "lag_steps", "n_obs", "statistic", "is_best_lag")


_EDGE_CTE = pair_sql("planted", PAIRS, [1, 2, 3, 4]) + f", c AS (SELECT unit_id, source, target, lag, count(x + y) AS n, {_C} AS r FROM pr GROUP BY ALL), e AS (SELECT *, {t_sql('r', 'n')} AS p FROM c)"


def _edges(spark, sf):
    return correlation.lagged_edges(views.planted(spark, sf), PAIRS, 4)


@query("lagged_corr_p", sql("planted") + ", " + _EDGE_CTE + f" SELECT source, target, lag AS lag_steps, {R('r')} AS statistic, {R('p')} AS p_value FROM e")
def _(spark, sf):
    return _edges(spark, sf).select("source", "target", "lag_steps", "statistic", "p_value")


_BH = "SELECT *, count(p) OVER ({g}) AS m, row_number() OVER ({g} ORDER BY p) AS rk FROM e"


def bh_sql(by: str = "") -> str:
    g = f"PARTITION BY {by}" if by else ""
    return f", b AS ({_BH.format(g=g)}) SELECT source, target, lag AS lag_steps, {R('p')} AS p_value, {R(f'greatest(p, least(1.0, min(p * m / rk) OVER ({g} ORDER BY p DESC, rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))')} AS q_value FROM b"


@query("fdr_bh_global", sql("planted") + ", " + _EDGE_CTE + bh_sql())
def _(spark, sf):
    return fdr.benjamini_hochberg(_edges(spark, sf).drop("q_value", "is_significant")).select("source", "target", "lag_steps", "p_value", "q_value")


@query("fdr_bh_by_pair", sql("planted") + ", " + _EDGE_CTE + bh_sql("source, target"))
def _(spark, sf):
    return fdr.benjamini_hochberg(_edges(spark, sf).drop("q_value", "is_significant"), by=["source", "target"]).select("source", "target", "lag_steps", "p_value", "q_value")


_PV = "WITH v(i, p) AS (VALUES (1, 0.2), (2, 0.001), (3, 0.03), (4, 0.5), (5, 0.04)), e AS (SELECT i, CAST(p AS DOUBLE) AS p FROM v)"


@query("fdr_positional_compat", _PV + ", s AS (SELECT *, p * 5 / i AS s, row_number() OVER (ORDER BY p, i) AS rk FROM e) SELECT CAST(i AS INTEGER) AS i, " + R("p") + " AS p_value, " + R("greatest(p, least(1.0, min(s) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))") + " AS q_value FROM s")
def _(spark, sf):
    return fdr.positional_q(spark.createDataFrame([(1, 0.2), (2, 0.001), (3, 0.03), (4, 0.5), (5, 0.04)], "i int, p_value double"), "i")


@query("mc_pvalue", f"SELECT l_returnflag, {R('(1.0 + count(*) FILTER (l_quantity >= 45)) / (1.0 + count(l_quantity))')} AS p_value FROM lineitem GROUP BY 1")
def _(spark, sf):
    return views.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(fdr.monte_carlo_p(F.lit(45.0), F.col("l_quantity")).alias("p_value"))


_BOTH = f", q AS (SELECT * FROM pr WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT source, target, lag, {_RANK.format(c='x')} AS x, {_RANK.format(c='y')} AS y FROM q), s AS (SELECT source, target, lag, {_C} AS sr FROM k GROUP BY ALL), c AS (SELECT source, target, lag, count(*) AS n, {_C} AS r FROM q GROUP BY ALL), j AS (SELECT c.*, sr FROM c JOIN s USING (source, target, lag))"


@query("lagged_corr_best", sql("planted") + ", " + pair_sql("planted", PAIRS, [1, 2, 3, 4]) + _BOTH + f""", b AS (SELECT *, CASE WHEN abs(sr) > abs(r) THEN 'spearman' ELSE 'pearson' END AS m, CASE WHEN abs(sr) > abs(r) THEN sr ELSE r END AS br FROM j)
SELECT 'all' AS unit_id, source, target, lag, n, {R('r')} AS pearson_r, {R('sr')} AS spearman_r, m AS best_method, {R('br')} AS best_r, {R(t_sql('br', 'n'))} AS best_p, {t_sql('br', 'n')} < 0.05 AS is_significant, true AS is_best_lag, CAST(lag AS DOUBLE) AS lag_days FROM b QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY abs(br) DESC, lag) = 1""")
def _(spark, sf):
    return correlation.lagged(views.planted(spark, sf), PAIRS, 4).where("is_best_lag")


def _q_sql(p: str) -> str:
    return f"greatest({p}, least(1.0, min({p} * m / {p}_rk) OVER (ORDER BY {p} DESC, {p}_rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"


@query("corr_batch_fdr", sql("ship_daily") + ", " + pair_sql("ship_daily", _UP, [0]) + _BOTH + f""", p AS (SELECT *, {t_sql('r', 'n')} AS pp, {t_sql('sr', 'n')} AS sp FROM j), b AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY pp) AS pp_rk, row_number() OVER (ORDER BY sp) AS sp_rk FROM p)
SELECT 'all' AS unit_id, source, target, n, {R('r')} AS pearson_r, {R('pp')} AS pearson_p, {R('sr')} AS spearman_r, {R('sp')} AS spearman_p, {R(_q_sql('pp'))} AS pearson_q, {_q_sql('pp')} <= 0.05 AS pearson_significant_fdr, {R(_q_sql('sp'))} AS spearman_q, {_q_sql('sp')} <= 0.05 AS spearman_significant_fdr FROM b""")
def _(spark, sf):
    return correlation.batch(views.ship_daily(spark, sf), _UP)


@query("panel_lagged_corr", sql("ship_panel") + ", " + pair_sql("ship_panel", [("qty", "price"), ("price", "qty")], [1, 2, 3]) + f" SELECT unit_id, source, target, lag, count(x + y) AS n, {R(_C)} AS r FROM pr GROUP BY ALL")
def _(spark, sf):
    return correlation.pearson(views.ship_panel(spark, sf), [("qty", "price"), ("price", "qty")], [1, 2, 3])


# ---- memory and assumptions --------------------------------------------------------------------------------------------


def acf_sql(view: str, names: list[str], most: int) -> str:
    parts = [f"SELECT '{c}' AS variable, t_idx, {c} - avg({c}) OVER () AS v FROM {view}" for c in names]
    return f"z AS ({' UNION ALL '.join(parts)}), l AS (SELECT a.variable, k AS lag, sum(a.v * b.v) AS s FROM z a JOIN (SELECT unnest(range(0, {most + 1})) AS k) ON true JOIN z b ON a.variable = b.variable AND b.t_idx = a.t_idx - k GROUP BY ALL), acf AS (SELECT l.variable, l.lag, l.s / o.s AS acf, (SELECT count(*) FROM {view}) AS n FROM l JOIN l o ON o.variable = l.variable AND o.lag = 0 WHERE l.lag > 0)"


@query("acf_table", sql("ship_daily") + ", " + acf_sql("ship_daily", ["qty", "price"], 20) + f" SELECT 'all' AS unit_id, variable, CAST(lag AS INTEGER) AS lag, n, {R('acf')} AS acf FROM acf")
def _(spark, sf):
    return memory.acf(views.ship_daily(spark, sf), ["qty", "price"], 20)


_Z = 1.959963984540054


@query("acf_zero_crossing", sql("ship_daily") + ", " + acf_sql("ship_daily", ["qty", "price"], 100) + f" SELECT 'all' AS unit_id, variable, n, CAST(coalesce(min(lag) FILTER (abs(acf) <= {_Z} / sqrt(n)), max(lag)) AS INTEGER) AS tau_max FROM acf WHERE lag <= n // 4 GROUP BY variable, n")
def _(spark, sf):
    return memory.acf_zero_crossing(views.ship_daily(spark, sf), ["qty", "price"])


@query("tau_max_scientific", sql("ship_daily") + ", " + acf_sql("ship_daily", ["qty", "price"], 100) + f", t AS (SELECT variable, n, coalesce(min(lag) FILTER (abs(acf) <= {_Z} / sqrt(n)), max(lag)) AS a FROM acf WHERE lag <= n // 4 GROUP BY variable, n) SELECT 'all' AS unit_id, variable, CAST(greatest(1, least(a, 18, n // 3)) AS INTEGER) AS tau_max, CASE WHEN a <= least(18, n // 3) THEN 'acf' WHEN 18 <= n // 3 THEN 'domain' ELSE 'nyquist' END AS binding FROM t")
def _(spark, sf):
    return memory.tau_scientific(views.ship_daily(spark, sf), ["qty", "price"])


_MI = """, pz AS (SELECT source, target, lag, least(floor((x - min(x) OVER w) * 10 / (max(x) OVER w - min(x) OVER w)), 9) AS x, least(floor((y - min(y) OVER w) * 10 / (max(y) OVER w - min(y) OVER w)), 9) AS y FROM pr WHERE x IS NOT NULL WINDOW w AS (PARTITION BY source, target, lag)),
ct AS (SELECT source, target, lag, x, y, count(*) AS c FROM pz GROUP BY ALL), mi AS (SELECT source, target, lag, sum(c / n * ln(c * n / (cx * cy))) AS mi FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY source, target, lag) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY source, target, lag, x) AS DOUBLE) AS cx, CAST(sum(c) OVER (PARTITION BY source, target, lag, y) AS DOUBLE) AS cy FROM ct) GROUP BY ALL)"""


@query("mi_table", sql("planted") + ", " + pair_sql("planted", [("X", "Y")], list(range(1, 13))) + _MI + f" SELECT 'all' AS unit_id, source, target, lag, {R('mi')} AS mi FROM mi")
def _(spark, sf):
    return memory.binned_information(views.planted(spark, sf), [("X", "Y")], list(range(1, 13)))


@query("mi_decay", sql("planted") + ", " + pair_sql("planted", [("X", "Y")], list(range(1, 13))) + _MI + " SELECT 'all' AS unit_id, CAST(coalesce(min(lag) FILTER (mi < 0.1 * (SELECT max(mi) FROM mi)), max(lag)) AS INTEGER) AS tau_max FROM mi")
def _(spark, sf):
    return memory.mi_decay(views.planted(spark, sf), "X", "Y", max_search=12)


@query("mi_first_minimum", sql("planted") + ", " + pair_sql("planted", [("Y", "Y")], list(range(1, 13))) + _MI + ", w AS (SELECT lag, mi < lag(mi) OVER (ORDER BY lag) AND mi < lead(mi) OVER (ORDER BY lag) AS low FROM mi) SELECT 'all' AS unit_id, CAST(coalesce(2 * min(lag) FILTER (low), max(lag)) AS INTEGER) AS tau_max FROM w")
def _(spark, sf):
    return memory.mi_first_minimum(views.planted(spark, sf), "Y", 12)


@query("jarque_bera", sql("ship_daily") + ", z AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} - avg({c}) OVER () AS d FROM ship_daily" for c in SH) + f"), m AS (SELECT variable, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM z GROUP BY 1), s AS (SELECT variable, n, m3 / m2 ** 1.5 AS s, m4 / (m2 * m2) - 3 AS k FROM m) SELECT 'all' AS unit_id, variable, n, {R('s')} AS skewness, {R('k')} AS excess_kurtosis, {R('n / 6.0 * (s * s + k * k / 4)')} AS jb, {R('exp(-n / 12.0 * (s * s + k * k / 4))')} AS p_value FROM s")
def _(spark, sf):
    return memory.jarque_bera(views.ship_daily(spark, sf), SH)


@query("durbin_watson", sql("ship_daily") + ", z AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS v, {c} - lag({c}) OVER (ORDER BY t_idx) AS d FROM ship_daily" for c in SH) + f"), s AS (SELECT variable, sum(d * d) / sum(v * v) AS dw FROM z GROUP BY 1) SELECT 'all' AS unit_id, variable, {R('dw')} AS dw, NOT (dw > 1.5 AND dw < 2.5) AS autocorrelated FROM s")
def _(spark, sf):
    return memory.durbin_watson(views.ship_daily(spark, sf), SH)


@query("ljung_box_ar1", sql("ship_daily") + f""", r AS (SELECT t_idx, qty AS y, lag(qty) OVER (ORDER BY t_idx) AS x FROM ship_daily), k AS (SELECT t_idx, y - avg(y) OVER () - (covar_pop(y, x) OVER () / var_pop(x) OVER ()) * (x - avg(x) OVER ()) AS e FROM r WHERE x IS NOT NULL),
c AS (SELECT g.k AS lag, (SELECT count(*) FROM k) AS n, (SELECT sum(a.e * b.e) FROM k a JOIN k b ON b.t_idx = a.t_idx - g.k) / (SELECT sum(e * e) FROM k) AS r FROM (SELECT unnest(range(1, 11)) AS k) g)
SELECT 'all' AS unit_id, 'qty' AS variable, CAST(lag AS INTEGER) AS lag, n, {R('r')} AS r, {R('n * (n + 2) * sum(r * r / (n - lag)) OVER (ORDER BY lag)')} AS q FROM c""")
def _(spark, sf):
    return memory.ljung_box(views.ship_daily(spark, sf), ["qty"]).drop("p_value")


@query("linearity", sql("planted") + f""" SELECT 'all' AS unit_id, {R('corr("X", "Y") ** 2')} AS r2, corr("X", "Y") ** 2 >= 0.8 AS is_linear FROM planted""")
def _(spark, sf):
    return memory.linearity(views.planted(spark, sf), "X", "Y")


@query("suggest_max_lag", sql("ship_daily") + ", " + acf_sql("ship_daily", ["qty", "price"], 40) + " SELECT 'all' AS unit_id, variable, CAST(CASE WHEN n >= 49 THEN least(18, coalesce(min(lag) FILTER (abs(acf) < 0.1), 18)) ELSE 18 END AS INTEGER) AS max_lag FROM acf GROUP BY variable, n")
def _(spark, sf):
    return memory.suggest_max_lag(views.ship_daily(spark, sf), ["qty", "price"])


for _name, _f in {
    "reset_f": lambda s, d: memory.reset(views.planted(s, d), [("X", "Y"), ("Z", "Y")], [0, 2]),
    "adf_kpss": lambda s, d: memory.stationarity(views.ship_daily(s, d), SH),
    "pacf_cutoff": lambda s, d: memory.pacf_cutoff(views.ship_daily(s, d), ["qty", "price"]),
    "tau_ensemble": lambda s, d: memory.tau_ensemble(views.ship_daily(s, d), ["qty"]),
    "distribution_tests": lambda s, d: memory.distribution_tests(views.ship_daily(s, d), SH),
    "stl_deseason": lambda s, d: transforms.deseasonalise(views.ship_panel(s, d), ["qty"], 26),
    "hp_filter": lambda s, d: transforms.hp_filter(views.ship_panel(s, d), ["qty"]),
    "fill_spline": lambda s, d: transforms.fill(views.event_wide(s, d), EV, "spline"),
    "fill_gp": lambda s, d: transforms.fill(views.event_wide(s, d), ["click"], "gp"),
    "season_label_swap": lambda s, d: transforms.season_label_swap(views.ship_daily(s, d)).select(UNIT, IDX, "month_shuffled", "doy_shuffled"),
}.items():
    query(_name)(_f)


# ---- Granger and transfer entropy --------------------------------------------------------------------------------------

_G1 = pair_sql("planted", PAIRS, [1]) + f""", w AS (SELECT *, lag(y) OVER (PARTITION BY source, target ORDER BY t_idx) AS own FROM pr), g AS (SELECT source, target, count(*) AS n, corr(y, x) AS a, corr(y, own) AS b, corr(x, own) AS c FROM w WHERE x IS NOT NULL AND own IS NOT NULL GROUP BY ALL),
h AS (SELECT source, target, n, ((a - b * c) / sqrt((1 - b * b) * (1 - c * c))) ** 2 AS r2 FROM g)"""


@query("granger_f_l1", sql("planted") + ", " + _G1 + f" SELECT 'all' AS unit_id, source, target, n, {R('r2')} AS partial_r2, {R('(n - 3) * r2 / (1 - r2)')} AS f_stat, {R(beta_sql('1 - r2', '((n - 3) / 2.0::DOUBLE)', '0.5::DOUBLE'))} AS p_value FROM h")
def _(spark, sf):
    return discovery.granger_l1(views.planted(spark, sf), PAIRS)


_LIT = [("Granger", "X", "Y", 2, 0.001, 0.004, 0.5, True), ("TransferEntropy", "X", "Y", 3, 0.002, 0.006, 0.4, True), ("PCMCI+", "X", "Y", 2, 0.0, 0.0, 0.9, True), ("Granger", "Z", "Y", 1, 0.01, 0.03, 0.2, True), ("PCMCI+", "Z", "Y", 0, 0.001, 0.002, 0.3, False), ("Granger", "Y", "X", 2, 0.03, 0.045, 0.1, True), ("TransferEntropy", "Y", "X", 2, 0.2, 0.3, 0.1, True), ("Granger", "A", "B", 5, 0.2, 0.4, 0.1, True), ("TransferEntropy", "B", "C", 4, 0.01, 0.02, 0.2, True), ("PCMCI+", "B", "C", 5, 0.02, 0.03, 0.2, True), ("TransferEntropy", "C", "B", 4, 0.001, 0.002, 0.6, True), ("PCMCI+", "C", "B", 4, 0.001, 0.002, 0.6, True), ("Granger", "X", "Z", 1, None, None, 0.1, True), ("TransferEntropy", "A", "C", 12, 0.004, None, 0.3, True), ("PCMCI+", "A", "C", 10, 0.03, 0.04, 0.3, True)]
_LIT_SQL = "e(method, source, target, lag_steps, p_value, q_value, effect_size, is_directed, is_significant) AS (SELECT c0, c1, c2, CAST(c3 AS INTEGER), CAST(c4 AS DOUBLE), CAST(c5 AS DOUBLE), CAST(c6 AS DOUBLE), c7, coalesce(coalesce(c5, c4) < 0.05, false) FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in _LIT) + ") t(c0, c1, c2, c3, c4, c5, c6, c7))"
_TRUTH = [("X", "Y"), ("Z", "Y"), ("B", "C"), ("C", "D")]
_TRUTH_SQL = "truth(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TRUTH) + ")"


def literal(spark: SparkSession) -> DataFrame:
    rows = [(*r, i) for i, r in enumerate(_LIT)]
    e = spark.createDataFrame(rows, "method string, source string, target string, lag_steps int, p_value double, q_value double, effect_size double, is_directed boolean, ord int")
    return e.withColumn("is_significant", F.coalesce(F.coalesce("q_value", "p_value") < 0.05, F.lit(False))).withColumn("lag_days", F.col("lag_steps") * 5.0)


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TRUTH, "source string, target string")


@query("granger_transitive_reduction", f"WITH {_LIT_SQL}, s AS (SELECT DISTINCT source, target FROM e WHERE is_significant), two AS (SELECT DISTINCT a.source, b.target FROM s a JOIN s b ON a.target = b.source WHERE a.source <> b.target) SELECT method, e.source, e.target, lag_steps FROM e ANTI JOIN two USING (source, target)")
def _(spark, sf):
    return discovery.transitive_reduction(literal(spark)).select("method", "source", "target", "lag_steps")


@query("granger_mediators", f"WITH {_LIT_SQL}, s AS (SELECT DISTINCT source, target FROM e WHERE is_significant) SELECT x.source, x.target, y.target AS mediator FROM s x JOIN s y ON x.source = y.source JOIN s z ON z.source = y.target AND z.target = x.target WHERE y.target <> x.target AND y.target <> x.source")
def _(spark, sf):
    return discovery.mediators(literal(spark))


_TE = f""", z AS (SELECT t_idx, {', '.join(f'{bin_sql(chr(34) + c + chr(34))} AS "{c}"' for c in PL)} FROM planted)"""


def te_sql(pairs: list[tuple[str, str]], delays: list[int]) -> str:
    parts = [f"""SELECT '{s}' AS source, '{t}' AS target, {d} AS delay, lag("{s}", {d}) OVER (ORDER BY t_idx) AS x, "{t}" AS y, lag("{t}") OVER (ORDER BY t_idx) AS h FROM z""" for s, t in pairs for d in delays]
    h = lambda *c: f"(SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT count(*) AS c FROM k WHERE k.source = o.source AND k.target = o.target AND k.delay = o.delay GROUP BY {', '.join(c)}))"
    return f", k AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE x IS NOT NULL AND h IS NOT NULL), o AS (SELECT source, target, delay, count(*) AS n FROM k GROUP BY ALL) SELECT 'all' AS unit_id, source, target, CAST(delay AS INTEGER) AS delay, {R(f'greatest(0, {h(chr(121), chr(104))} + {h(chr(120), chr(104))} - {h(chr(104))} - {h(chr(121), chr(120), chr(104))}) / ln(2)')} AS te_bits, n FROM o"


@query("te_discrete", sql("planted") + _TE + te_sql(PAIRS, [1, 2, 3]))
def _(spark, sf):
    return discovery.te_discrete(views.planted(spark, sf), PAIRS)


@query("te_mi_proxy", sql("planted") + _TE + f""", k AS (SELECT * FROM (SELECT lag("X", 2) OVER (ORDER BY t_idx) AS x, "Y" AS y FROM z) WHERE x IS NOT NULL), v AS (SELECT (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT count(*) AS c FROM k GROUP BY x)) + (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT count(*) AS c FROM k GROUP BY y)) - (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT count(*) AS c FROM k GROUP BY x, y)) AS mi)
SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, CAST(2 AS INTEGER) AS delay, {R('greatest(0, mi)')} AS mi, {R('least(1, greatest(0, mi) / ln(5))')} AS proxy FROM v""")
def _(spark, sf):
    return discovery.mutual_information(views.planted(spark, sf), [("X", "Y")], [2])


_BLK = """, s AS (SELECT t_idx, "X" AS x, "Y" AS y, lag("Y") OVER (ORDER BY t_idx) AS h FROM z),
c AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY md5('42|' || b || '|' || (t_idx // 5)), t_idx) - 1 AS t_idx, x FROM s, (SELECT unnest(range(1, 21)) AS b) UNION ALL SELECT 0, t_idx, x FROM s),
k AS (SELECT b, c.x, s.y, s.h FROM c JOIN s ON s.t_idx = c.t_idx + 2 WHERE h IS NOT NULL),
t AS (SELECT b, {h1} + {h2} - {h3} - {h4} AS te FROM (SELECT DISTINCT b FROM k) o)"""
_H = lambda *c: f"(SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT count(*) AS c FROM k WHERE k.b = o.b GROUP BY {', '.join(c)}))"


@query("te_surrogate_p", sql("planted") + _TE + _BLK.format(h1=_H("y", "h"), h2=_H("x", "h"), h3=_H("h"), h4=_H("y", "x", "h")) + f""", u AS (SELECT greatest(0, te) / ln(2) AS te, b FROM t)
SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, CAST(2 AS INTEGER) AS delay, {R('(SELECT te FROM u WHERE b = 0)')} AS te_bits, {R('avg(te) FILTER (b > 0)')} AS surrogate_mean, {R('stddev_pop(te) FILTER (b > 0)')} AS surrogate_std, {R('(1.0 + count(*) FILTER (b > 0 AND te >= (SELECT te FROM u WHERE b = 0))) / 21.0')} AS p_value FROM u""")
def _(spark, sf):
    return discovery.te_surrogates(views.planted(spark, sf), "X", "Y", 2, 20)


for _name, _f in {
    "te_batch_best": lambda s, d: discovery.te_batch(discovery.te_knn(views.planted(s, d), [("X", "Y"), ("Y", "X")], [1, 2], b=19)),
    "granger_var": lambda s, d: discovery.granger(views.planted(s, d), PL, maxlag=5),
    "granger_panel": lambda s, d: discovery.granger(views.ship_panel(s, d), ["qty", "price"], maxlag=4),
    "granger_bidirectional": lambda s, d: discovery.bidirectional(discovery.granger(views.planted(s, d), PL, maxlag=3)),
    "granger_mediator_pruning": lambda s, d: discovery.mediator_pruning(views.planted(s, d), discovery.granger(views.planted(s, d), PL, maxlag=3), PL),
    "fit_var": lambda s, d: discovery.fit_var(views.planted(s, d), PL, 4),
    "pcmci_parcorr": lambda s, d: discovery.pcmci(views.planted(s, d), PL, 3, contemporaneous=False),
    "pcmci_plus": lambda s, d: discovery.pcmci(views.planted(s, d), PL, 3),
    "robust_parcorr": lambda s, d: discovery.pcmci(views.planted(s, d), PL, 3, test="robust_parcorr"),
    "pcmci_best_links": lambda s, d: discovery.best_links(discovery.pcmci(views.planted(s, d), PL, 3), PAIRS),
    "ci_test_select": lambda s, d: s.createDataFrame([(discovery.choose_test(views.planted(s, d), PL),)], "ci_test string"),
    "ci_sensitivity": lambda s, d: discovery.ci_sensitivity(views.planted(s, d), PL),
    "lpcmci": lambda s, d: discovery.lpcmci(views.planted(s, d), PL, 2),
    "var_lingam": lambda s, d: discovery.var_lingam(views.planted(s, d), PL, 2),
    "rf_baseline": lambda s, d: discovery.predictive_baseline(views.planted(s, d), PL, "Y", 2, trees=10, permutations=5),
    "iaaft_falsification": lambda s, d: surrogates.falsify(views.planted(s, d), [("X", "Y", 2)], b=50),
    "surrogate_series": lambda s, d: surrogates.surrogate_series(views.ship_panel(s, d), ["qty"], "iaaft", 2),
    "surrogate_test": lambda s, d: surrogates.surrogate_test(views.planted(s, d), "X", "Y", 2, 50),
    "negative_control": lambda s, d: surrogates.negative_control(views.planted(s, d), [("X", "Y")], 40),
    "bootstrap_link_frequency": lambda s, d: surrogates.bootstrap_links(views.planted(s, d), PL, 8, 2),
    "temporal_cv": lambda s, d: stability.fold_votes(discovery.granger(stability.expanding_folds(views.planted(s, d)), PL, maxlag=3, keys=("fold",))),
    "split_half_jaccard": lambda s, d: (lambda g: evaluation.set_jaccard(g.where("half = 0 and is_significant"), g.where("half = 1 and is_significant"), ["source", "target"]))(discovery.granger(stability.halves(views.planted(s, d)), PL, maxlag=3, keys=("half",))),
}.items():
    query(_name)(_f)


_DRAW = "CAST('0x' || substr(md5('42|' || b || '|' || i), 1, 8) AS BIGINT)"


@query("block_bootstrap_ci", sql("planted") + f""", l AS (SELECT t_idx, lag("X", 2) OVER (ORDER BY t_idx) AS x, "Y" AS y FROM planted), r AS (SELECT x, y, (row_number() OVER (ORDER BY t_idx) - 1) // 50 AS block FROM l WHERE l.x IS NOT NULL AND l.y IS NOT NULL),
s AS (SELECT block, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM r GROUP BY 1), d AS (SELECT b, {_DRAW} % (SELECT count(*) FROM s) AS block FROM (SELECT unnest(range(1, 51)) AS b), (SELECT unnest(range(0, (SELECT count(*) FROM s))) AS i)),
g AS (SELECT b, sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM d JOIN s USING (block) GROUP BY 1), z AS (SELECT (xy - x * y / n) / (xx - x * x / n) AS s FROM g)
SELECT 'all' AS unit_id, count(s) AS n_ok, {R('avg(s)')} AS mean, {R('quantile_cont(s, 0.025)')} AS ci_low, {R('quantile_cont(s, 0.975)')} AS ci_high FROM z""")
def _(spark, sf):
    return surrogates.block_bootstrap(views.planted(spark, sf), "X", "Y", 2, 50)


@query("mean_bootstrap_ci", sql("ship_panel") + f""", v AS (SELECT unit_id, qty AS v, row_number() OVER (PARTITION BY unit_id ORDER BY t_idx) - 1 AS k FROM ship_panel WHERE qty IS NOT NULL), n AS (SELECT unit_id, count(*) AS n, avg(v) AS mean FROM v GROUP BY 1),
i AS (SELECT unit_id, n, unnest(range(0, n)) AS i FROM n), d AS (SELECT unit_id, b, {_DRAW} % n AS k FROM i, (SELECT unnest(range(1, 41)) AS b)), m AS (SELECT unit_id, b, avg(v) AS m FROM d JOIN v USING (unit_id, k) GROUP BY ALL)
SELECT unit_id, n, {R('mean')} AS mean, {R('quantile_cont(m, 0.025)')} AS ci_low, {R('quantile_cont(m, 0.975)')} AS ci_high FROM m JOIN n USING (unit_id) GROUP BY ALL""")
def _(spark, sf):
    return robustness.bootstrap_mean(views.ship_panel(spark, sf), "qty", 40)


# ---- robustness --------------------------------------------------------------------------------------------------------


@query("series_prewhiten", sql("ship_daily") + f""", r AS (SELECT t_idx, qty AS y, lag(qty) OVER (ORDER BY t_idx) AS x FROM ship_daily), k AS (SELECT t_idx, y - avg(y) OVER () - (covar_pop(y, x) OVER () / var_pop(x) OVER ()) * (x - avg(x) OVER ()) AS e FROM r WHERE x IS NOT NULL)
SELECT 'all' AS unit_id, t_idx, round(e, 4) + 0.0 AS qty FROM k""")
def _(spark, sf):
    return robustness.prewhiten(views.ship_daily(spark, sf), "qty", 1).withColumn("qty", F.round("qty", 4))


@query("strength_by_lag", sql("planted") + ", " + pair_sql("planted", [("X", "Y")], list(range(1, 13))) + f", c AS (SELECT source, target, lag, count(x + y) AS n, {_C} AS r FROM pr GROUP BY ALL) SELECT 'all' AS unit_id, source, target, lag, n, {R('r')} AS r, {R(t_sql('r', 'n'))} AS p_value FROM c")
def _(spark, sf):
    return robustness.lag_sensitivity(views.planted(spark, sf), "X", "Y", list(range(1, 13)))


_REVERSED = _G1.replace(pair_sql("planted", PAIRS, [1]), pair_sql("planted", [("Y", "X"), ("Y", "Z")], [1]))


@query("reverse_direction", sql("planted") + ", " + _REVERSED + f", p AS (SELECT {beta_sql('1 - r2', '((n - 3) / 2.0::DOUBLE)', '0.5::DOUBLE')} AS p FROM h) SELECT count(*) AS n_tested, {R('avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END)')} AS rate, 0.05::DOUBLE AS alpha, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) <= 0.08 AS ok FROM p")
def _(spark, sf):
    return robustness.reverse_directions(views.planted(spark, sf), [("X", "Y"), ("Z", "Y")])


@query("drivers_ranked", sql("planted") + ", " + _EDGE_CTE + f" SELECT source, target, lag AS lag_steps, {R('abs(r)')} AS effect_size, CAST(row_number() OVER (ORDER BY abs(r) DESC, source, lag) AS INTEGER) AS rank FROM e WHERE target = 'Y'")
def _(spark, sf):
    return robustness.drivers(_edges(spark, sf), "Y").select("source", "target", "lag_steps", "effect_size", "rank")


for _name, _f in {
    "granger_seasonal_sensitivity": lambda s, d: robustness.seasonal_sensitivity(views.ship_daily(s, d), "qty", "price", 3),
    "lag_bootstrap_ci": lambda s, d: robustness.lag_interval(views.planted(s, d), "X", "Y", 6, 40),
    "surrogate_fpr": lambda s, d: robustness.false_positive_rate(views.planted(s, d), PL, b=6),
    "strength_compare": lambda s, d: robustness.compare_strength(views.planted(s, d), "X", "Y", 2),
    "effects_table": lambda s, d: robustness.effects(discovery.pcmci(views.planted(s, d), PL, 2), surrogates.bootstrap_links(views.planted(s, d), PL, 6, 2)),
}.items():
    query(_name)(_f)


# ---- edges to edges ----------------------------------------------------------------------------------------------------


@query("edge_normalise", "SELECT 'X' AS source, 'Y' AS target, CAST(3 AS INTEGER) AS lag_steps, CAST(0.01 AS DOUBLE) AS p_value, true AS is_significant")
def _(spark, sf):
    return normalise_edges(spark.createDataFrame([("X", "Y", 3, 0.01, True)], "cause string, effect string, best_lag int, best_p_value double, significant boolean"))


@query("lag_bands", f"WITH {_LIT_SQL} SELECT method, source, target, lag_steps, CASE WHEN lag_steps <= 3 THEN 'fast' WHEN lag_steps <= 9 THEN 'mid' ELSE 'long' END AS lag_band FROM e")
def _(spark, sf):
    return literal(spark).select("method", "source", "target", "lag_steps", consensus.lag_band(F.col("lag_steps")).alias("lag_band"))


@query("band_consensus", f"WITH {_LIT_SQL}, b AS (SELECT *, CASE WHEN lag_steps <= 3 THEN 'fast' WHEN lag_steps <= 9 THEN 'mid' ELSE 'long' END AS lag_band FROM e WHERE p_value < 0.05) SELECT source, target, lag_band, count(DISTINCT method) AS vote_count, string_agg(DISTINCT method, ',' ORDER BY method) AS agreeing_methods, CAST(trunc(quantile_cont(lag_steps, 0.5)) AS INTEGER) AS median_lag, min(lag_steps) AS min_lag, max(lag_steps) AS max_lag, {R('min(p_value)')} AS best_p, {R('avg(p_value)')} AS mean_p, count(*) AS n_rows FROM b GROUP BY 1, 2, 3 HAVING count(DISTINCT method) >= 2")
def _(spark, sf):
    return consensus.band_consensus(literal(spark))


_CONS = """WITH r(source, target, lag_steps, vote_count, agreeing_methods, best_p_value) AS (VALUES ('X', 'Y', 2, 3, 'Granger,PCMCI+,TransferEntropy', 0.0), ('Z', 'Y', 1, 1, 'Granger', 0.01), ('C', 'B', 4, 2, 'PCMCI+,TransferEntropy', 0.001))"""


@query("consensus_tolerance", _CONS + " SELECT source, target, CAST(lag_steps AS INTEGER) AS lag_steps, CAST(vote_count AS INTEGER) AS vote_count, agreeing_methods, CAST(best_p_value AS DOUBLE) AS best_p_value FROM r")
def _(spark, sf):
    return consensus.consensus(literal(spark)).select("source", "target", "lag_steps", "vote_count", "agreeing_methods", "best_p_value")


@query("consensus_full", None)
def _(spark, sf):
    return consensus.consensus(literal(spark), sampling_days=5.0)


@query("voting_matrix", _CONS + " SELECT agreeing_methods, CAST(vote_count AS INTEGER) AS vote_count, count(*) AS n_edges FROM r GROUP BY ALL")
def _(spark, sf):
    return consensus.voting_matrix(consensus.consensus(literal(spark)))


@query("lag_strata", f"WITH {_LIT_SQL} SELECT method, count(*) AS n_edges, count(*) FILTER (lag_steps <= 3) AS n_short, count(*) FILTER (lag_steps >= 10) AS n_long, {R('100.0 * count(*) FILTER (lag_steps <= 3) / count(*)')} AS short_pct, {R('100.0 * count(*) FILTER (lag_steps >= 10) / count(*)')} AS long_pct FROM e WHERE is_significant GROUP BY 1")
def _(spark, sf):
    return consensus.stratify(literal(spark))


@query("lag_agreement", f"WITH {_LIT_SQL} SELECT CASE WHEN lag_steps <= 3 THEN 'short' ELSE 'long' END AS stratum, source, target, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM e WHERE is_significant AND (lag_steps <= 3 OR lag_steps >= 10) GROUP BY 1, 2, 3 HAVING count(DISTINCT method) >= 2")
def _(spark, sf):
    return consensus.lag_agreement(literal(spark))


@query("ensemble_scores", f"WITH {_LIT_SQL}, w(method, w) AS (VALUES ('Granger', 0.9 / 2.3::DOUBLE), ('PCMCI+', 1.0 / 2.3::DOUBLE), ('TransferEntropy', 0.4 / 2.3::DOUBLE)), d AS (SELECT DISTINCT method, source, target FROM e WHERE is_significant) SELECT source, target, {R('least(1.0, sum(w))')} AS confidence, count(*) AS n_methods_found, string_agg(method, ',' ORDER BY method) AS methods, CAST(3 AS INTEGER) AS n_methods_total, sum(w) >= 0.5 AS is_significant FROM d JOIN w USING (method) GROUP BY 1, 2")
def _(spark, sf):
    w = consensus.method_weights("linear_gaussian", ["pcmci", "granger", "transfer_entropy"])
    return consensus.ensemble(literal(spark), {"Granger": w["granger"], "PCMCI+": w["pcmci"], "TransferEntropy": w["transfer_entropy"]})


_TIERS = [(3, 0, True, False), (2, 1, False, False), (2, 0, False, True), (3, 2, True, False), (1, 2, True, True), (3, 2, None, False)]
_TIERS_SQL = "WITH t(vote_count, falsification_passed, icp_stable, oos_significant, tier) AS (VALUES (3, 0, true, false, 3), (2, 1, false, false, 2), (2, 0, false, true, 2), (3, 2, true, false, 1), (1, 2, true, true, 3), (3, 2, NULL, false, 2))"


def _tiered(spark):
    return consensus.add_tiers(spark.createDataFrame(_TIERS, "vote_count int, falsification_passed int, icp_stable boolean, oos_significant boolean"))


@query("tier_classify", _TIERS_SQL + " SELECT CAST(vote_count AS INTEGER) AS vote_count, CAST(falsification_passed AS INTEGER) AS falsification_passed, icp_stable, oos_significant, CAST(tier AS INTEGER) AS tier FROM t")
def _(spark, sf):
    return _tiered(spark)


@query("tier_summary", _TIERS_SQL + f" SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n_edges, {R('100.0 * count(*) / 6')} AS pct FROM t GROUP BY tier")
def _(spark, sf):
    return consensus.tier_summary(_tiered(spark)).drop("description")


@query("tier_report", _TIERS_SQL + f" SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n_edges, {R('100.0 * count(*) / 6')} AS pct, format('Tier {{}}: {{}} of 6 edges ({{:.1f}} %)', tier, count(*), 100.0::DOUBLE * count(*) / 6) AS text FROM t GROUP BY tier")
def _(spark, sf):
    return reports.tier_report(_tiered(spark))


@query("vote_thresholds", _CONS + ", k(threshold) AS (VALUES (2), (3)) SELECT CAST(threshold AS INTEGER) AS threshold, count(*) AS n_edges FROM r JOIN k ON vote_count >= threshold GROUP BY threshold")
def _(spark, sf):
    return consensus.supported_by(consensus.consensus(literal(spark)), [2, 3])


_STATS = lambda c: f"count({c}) AS n, {R(f'avg({c})')} AS mean, {R(f'median({c})')} AS median, {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS \"min\", {R(f'max({c})')} AS \"max\""


@query("edge_diagnostics_pvalues", f"WITH {_LIT_SQL} SELECT method, {_STATS('p_value')}, {R('quantile_cont(p_value, 0.25)')} AS q25, {R('quantile_cont(p_value, 0.75)')} AS q75, count(*) FILTER (p_value < 0.05) AS n_below, {R('100.0 * count(*) FILTER (p_value < 0.05) / count(p_value)')} AS pct_below FROM e GROUP BY 1")
def _(spark, sf):
    return diagnostics.p_values(literal(spark))


@query("edge_diagnostics_lags", f"WITH {_LIT_SQL}, d AS (SELECT method, lag_steps * 5.0::DOUBLE AS d FROM e), m AS (SELECT method, d, row_number() OVER (PARTITION BY method ORDER BY count(*) DESC, d) AS k FROM d GROUP BY 1, 2) SELECT d.method, {_STATS('d.d')}, {R('any_value(m.d)')} AS mode, {R('100.0 * count(*) FILTER (d.d >= 5 AND d.d <= 15) / count(*)')} AS pct_5_15 FROM d JOIN m ON m.method = d.method AND m.k = 1 GROUP BY 1")
def _(spark, sf):
    return diagnostics.lags(literal(spark))


_W = "(p + {s} / (2.0 * n)) / (1 + {s} / n)".replace("{s}", str(_Z * _Z))
_WH = f"{_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n)) / (1 + {_Z * _Z} / n)"


@query("wilson_ci", f"WITH {_LIT_SQL}, d AS (SELECT method, count(*) AS n, count(*) FILTER (is_significant) AS k, count(*) FILTER (is_significant) / count(*) AS p FROM e GROUP BY 1) SELECT method, n, k, {R('p')} AS rate, {R(f'greatest(0, {_W} - {_WH})')} AS ci_low, {R(f'least(1, {_W} + {_WH})')} AS ci_high FROM d")
def _(spark, sf):
    return diagnostics.detection(literal(spark))


@query("method_divergence", f"WITH {_LIT_SQL}, d AS (SELECT method, avg(CASE WHEN coalesce(q_value < 0.05, is_significant) THEN 1.0 ELSE 0.0 END) AS rate FROM e GROUP BY 1), m AS (SELECT *, avg(rate) OVER () AS mean_rate FROM d) SELECT method, {R('rate')} AS rate, {R('mean_rate')} AS mean_rate, {R('abs(rate - mean_rate) / mean_rate')} AS deviation, max(abs(rate - mean_rate) / mean_rate) OVER () > 0.2 AS alert FROM m")
def _(spark, sf):
    return diagnostics.divergence(literal(spark))


@query("pair_row_histogram", f"WITH {_LIT_SQL} SELECT rows, count(*) AS n_pairs FROM (SELECT count(*) AS rows FROM e GROUP BY source, target) GROUP BY 1")
def _(spark, sf):
    return diagnostics.agreement(literal(spark))


@query("edge_overview", f"WITH {_LIT_SQL} SELECT count(*) AS n_edges, count(DISTINCT (source, target)) AS n_pairs, {R('avg(p_value)')} AS mean_p, {R('avg(lag_steps * 5.0)')} AS mean_lag, (SELECT count(DISTINCT v) FROM (SELECT source AS v FROM e UNION ALL SELECT target FROM e)) AS n_variables, {R('count(DISTINCT (source, target)) / (6 * 5.0)')} AS coverage FROM e")
def _(spark, sf):
    return diagnostics.overview(literal(spark))


@query("detection_statistics", f"WITH {_LIT_SQL} SELECT method, count(*) AS n_total, count(*) FILTER (is_significant) AS n_significant, {R('avg(lag_steps) FILTER (is_significant)')} AS mean_lag, {R('median(lag_steps) FILTER (is_significant)')} AS median_lag, {R('stddev_samp(lag_steps) FILTER (is_significant)')} AS std_lag, count(*) FILTER (is_significant AND lag_steps BETWEEN 1 AND 12) AS n_in_range, {R('100.0 * count(*) FILTER (is_significant) / count(*)')} AS rate_pct FROM e GROUP BY 1")
def _(spark, sf):
    return diagnostics.detection_statistics(literal(spark))


@query("top_edges", f"WITH {_LIT_SQL} SELECT method, source, target, lag_steps, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY p_value, source, target, lag_steps) AS rank FROM e WHERE is_significant) WHERE rank <= 2")
def _(spark, sf):
    return diagnostics.top_edges(literal(spark), 2).select("method", "source", "target", "lag_steps", "rank")


@query("report_statements", None)
def _(spark, sf):
    return diagnostics.statements(consensus.consensus(literal(spark), sampling_days=5.0))


@query("strength_labels", f"WITH {_LIT_SQL} SELECT method, source, target, lag_steps, CASE WHEN effect_size < 0.3 THEN 'weak' WHEN effect_size < 0.5 THEN 'moderate' WHEN effect_size < 0.7 THEN 'strong' ELSE 'very strong' END AS label FROM e")
def _(spark, sf):
    return literal(spark).select("method", "source", "target", "lag_steps", diagnostics.strength_label(F.col("effect_size")).alias("label"))


@query("guard_checks", f"WITH {_LIT_SQL} SELECT method, source, target, count(*) AS n, count(*) FILTER (q_value < p_value) AS n_bad FROM e GROUP BY 1, 2, 3")
def _(spark, sf):
    return literal(spark).withColumn("edge_hash", diagnostics.edge_hash("demo")).groupBy("edge_hash", "method", "source", "target").agg(F.count("*").alias("n"), F.count_if(F.col("q_value") < F.col("p_value")).alias("n_bad")).drop("edge_hash")


@query("graphml_attributes", None)
def _(spark, sf):
    return io.graphml_edges(consensus.consensus(literal(spark), sampling_days=5.0))


@query("run_compare_full_outer", "WITH a(name, v) AS (VALUES ('alpha', '0.05'), ('tau', '12')), b(name, v) AS (VALUES ('alpha', '0.05'), ('tau', '10'), ('seed', '1')) SELECT coalesce(a.name, b.name) AS name, coalesce(a.v, 'N/A') AS value_1, coalesce(b.v, 'N/A') AS value_2, a.v IS NOT DISTINCT FROM b.v AS equal FROM a FULL JOIN b ON a.name = b.name")
def _(spark, sf):
    s = "name string, value string"
    return io.compare_runs(spark.createDataFrame([("alpha", "0.05"), ("tau", "12")], s), spark.createDataFrame([("alpha", "0.05"), ("tau", "10"), ("seed", "1")], s))


# ---- recovery ----------------------------------------------------------------------------------------------------------

_FOUND = "f AS (SELECT DISTINCT method, source, target FROM e WHERE is_significant), ms AS (SELECT DISTINCT method FROM f)"


def _found(spark):
    return literal(spark).where("is_significant")


def recovery_sql(directed: bool) -> str:
    key = "source, target" if directed else "least(source, target) AS source, greatest(source, target) AS target"
    rev = f", count(DISTINCT CASE WHEN t IS NULL AND b IS NOT NULL THEN least(source, target) || '|' || greatest(source, target) END) AS n_reversals" if directed else ""
    shd = "fp + fn - n_reversals" if directed else "fp + fn"
    return f"""WITH {_LIT_SQL}, {_TRUTH_SQL}, {_FOUND}, ff AS (SELECT DISTINCT method, {key} FROM f), tt AS (SELECT DISTINCT method, {key} FROM ms, truth),
j AS (SELECT coalesce(ff.method, tt.method) AS method, coalesce(ff.source, tt.source) AS source, coalesce(ff.target, tt.target) AS target, ff.method AS f, tt.method AS t FROM ff FULL JOIN tt ON ff.method = tt.method AND ff.source = tt.source AND ff.target = tt.target),
k AS (SELECT j.*, (SELECT 1 FROM j b WHERE b.method = j.method AND b.f IS NULL AND b.source = j.target AND b.target = j.source) AS b FROM j),
g AS (SELECT method, count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn{rev} FROM k GROUP BY 1),
h AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM g)
SELECT method, tp, fp, fn{', n_reversals' if directed else ''}, {R('p')} AS "precision", {R('r')} AS recall, {R('coalesce(2 * p * r / nullif(p + r, 0), 0)')} AS f1, {R('coalesce(fp / nullif(tp + fp, 0), 0)')} AS fdr, {shd} AS shd FROM h"""


@query("recovery_binary", recovery_sql(True))
def _(spark, sf):
    return evaluation.binary(_found(spark), truth(spark))


@query("recovery_undirected", recovery_sql(False))
def _(spark, sf):
    return evaluation.binary(_found(spark), truth(spark), directed=False)


@query("recovery_silent_method", recovery_sql(True).replace("ms AS (SELECT DISTINCT method FROM f)", "ms AS (SELECT DISTINCT method FROM f UNION SELECT 'LPCMCI')"))
def _(spark, sf):
    return evaluation.binary(_found(spark), truth(spark), methods=["Granger", "LPCMCI"])


_NAMES = ["A", "B", "C", "X", "Y", "Z"]
_RANKED = f"""WITH {_LIT_SQL}, {_TRUTH_SQL}, nm(v) AS (VALUES {', '.join(f"('{n}')" for n in _NAMES)}), pp AS (SELECT m.method, a.v AS source, b.v AS target FROM (SELECT DISTINCT method FROM e) m, nm a, nm b WHERE a.v <> b.v),
s AS (SELECT pp.method, coalesce((SELECT max(1 - p_value) FROM e WHERE e.method = pp.method AND e.source = pp.source AND e.target = pp.target), 0) AS s, CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE t.source = pp.source AND t.target = pp.target) THEN 1 ELSE 0 END AS t FROM pp)"""


@query("recovery_auroc_auprc", _RANKED + f""", rk AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY s) + (count(*) OVER (PARTITION BY method, s) - 1) / 2.0 AS rk FROM s), u AS (SELECT method, (sum(CASE WHEN t = 1 THEN rk ELSE 0 END) - sum(t) * (sum(t) + 1) / 2.0) / (sum(t) * (count(*) - sum(t))) AS auroc FROM rk GROUP BY 1),
st AS (SELECT method, s, sum(t) AS tp, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(tp) OVER (PARTITION BY method ORDER BY s DESC) AS ct, sum(n) OVER (PARTITION BY method ORDER BY s DESC) AS cn, sum(tp) OVER (PARTITION BY method) AS p FROM st), a AS (SELECT method, sum(tp / p * ct / cn) AS auprc FROM c GROUP BY 1)
SELECT method, {R('auroc')} AS auroc, {R('auprc')} AS auprc FROM u JOIN a USING (method)""")
def _(spark, sf):
    return evaluation.ranking(literal(spark).withColumn("score", 1 - F.col("p_value")), truth(spark), _NAMES)


@query("chance_baseline", "SELECT CAST(6 AS INTEGER) AS n_vars, CAST(4 AS BIGINT) AS m_true, CAST(15 AS INTEGER) AS m_max, " + R("4 / 15.0") + " AS chance_precision")
def _(spark, sf):
    return evaluation.chance(truth(spark), _NAMES)


@query("chance_recall", f"WITH {_LIT_SQL}, {_FOUND} SELECT method, {R('count(*) / 15.0')} AS expected_recall FROM (SELECT DISTINCT method, least(source, target), greatest(source, target) FROM f) GROUP BY 1")
def _(spark, sf):
    return evaluation.chance_recall(_found(spark), _NAMES)


@query("method_jaccard", f"WITH {_LIT_SQL}, {_FOUND}, u AS (SELECT DISTINCT method, least(source, target) || '|' || greatest(source, target) AS k FROM f) SELECT a.method AS a, b.method AS b, (SELECT count(*) FROM u x JOIN u y ON x.k = y.k WHERE x.method = a.method AND y.method = b.method) AS common, {R('(SELECT count(*) FROM u x JOIN u y ON x.k = y.k WHERE x.method = a.method AND y.method = b.method) / (SELECT count(DISTINCT k) FROM u WHERE method IN (a.method, b.method))')} AS jaccard FROM ms a JOIN ms b ON a.method < b.method")
def _(spark, sf):
    return evaluation.jaccard(_found(spark))


@query("is_dag", "SELECT false AS is_dag")
def _(spark, sf):
    return evaluation.is_dag(_found(spark))


@query("two_cycles", f"WITH {_LIT_SQL}, s AS (SELECT DISTINCT source, target FROM e WHERE is_significant) SELECT a.source, a.target FROM s a JOIN s b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target")
def _(spark, sf):
    return evaluation.two_cycles(_found(spark))


@query("grouping_sets_summary", f"SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag, {R('avg(l_quantity)')} AS mean, {R('stddev_samp(l_quantity)')} AS std, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def _(spark, sf):
    return evaluation.summary(views.read(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("reference_edges_semi", f"WITH {_TRUTH_SQL} SELECT source, target FROM truth WHERE source IN ('X', 'Y', 'B', 'C') AND target IN ('X', 'Y', 'B', 'C')")
def _(spark, sf):
    s = spark.createDataFrame([(v,) for v in ("X", "Y", "B", "C")], "v string")
    t = truth(spark)
    return t.join(F.broadcast(s), t.source == s.v, "left_semi").join(F.broadcast(s), t.target == s.v, "left_semi")


# ---- stability ---------------------------------------------------------------------------------------------------------

_ENV = """, b AS (SELECT *, CAST(least(t_idx // ((SELECT count(*) FROM planted) // 3), 2) AS VARCHAR) AS env FROM planted), l AS (SELECT env, lag("X", 2) OVER (PARTITION BY env ORDER BY t_idx) AS x, "Y" AS y FROM b),
f AS (SELECT env, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM l WHERE x IS NOT NULL GROUP BY 1), s AS (SELECT env, n, sxy / sxx AS slope, sqrt((syy - sxy / sxx * sxy) / (n - 2) / sxx) AS se FROM f)"""
_E = [("X", "Y", 2)]


@query("icp_blocks", sql("planted") + _ENV + f" SELECT 'X' AS source, 'Y' AS target, CAST(2 AS INTEGER) AS lag_steps, count(*) AS icp_n_environments, {R('stddev_samp(slope) / abs(avg(slope))')} AS icp_test_statistic, stddev_samp(slope) / abs(avg(slope)) < 0.5 AND min(sign(slope)) = max(sign(slope)) AS icp_stable FROM s")
def _(spark, sf):
    return stability.edge_stability(views.planted(spark, sf), _E).drop("icp_p_value", UNIT)


@query("icp_slopes", sql("planted") + _ENV + f" SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, CAST(2 AS INTEGER) AS lag_steps, env, n, {R('slope')} AS slope, {R('se')} AS se FROM s")
def _(spark, sf):
    return stability.edge_slopes(stability.temporal_environments(views.planted(spark, sf)), _E)


@query("icp_cochran_q", sql("planted") + _ENV + f" SELECT 'X' AS source, 'Y' AS target, CAST(2 AS INTEGER) AS lag_steps, count(*) AS icp_n_environments, {R('sum(slope * slope / (se * se)) - sum(slope / (se * se)) ** 2 / sum(1 / (se * se))')} AS icp_test_statistic, {R('exp(-(sum(slope * slope / (se * se)) - sum(slope / (se * se)) ** 2 / sum(1 / (se * se))) / 2)')} AS icp_p_value FROM s")
def _(spark, sf):
    return stability.edge_stability(views.planted(spark, sf), _E, method="cochran").drop("icp_stable", UNIT)


@query("icp_panel", sql("ship_panel") + f", l AS (SELECT unit_id, lag(qty, 1) OVER (PARTITION BY unit_id ORDER BY t_idx) AS x, price AS y FROM ship_panel), s AS (SELECT unit_id, regr_slope(y, x) AS slope FROM l WHERE x IS NOT NULL GROUP BY 1) SELECT 'qty' AS source, 'price' AS target, CAST(1 AS INTEGER) AS lag_steps, count(*) AS icp_n_environments, {R('stddev_samp(slope) / abs(avg(slope))')} AS icp_test_statistic FROM s")
def _(spark, sf):
    return stability.edge_stability(views.ship_panel(spark, sf).withColumn("env", F.col(UNIT)), [("qty", "price", 1)], env="env").drop("icp_p_value", "icp_stable")


_ROLL = """, l AS (SELECT t_idx, lag("X", 2) OVER (ORDER BY t_idx) AS x, "Y" AS y FROM planted), g AS (SELECT unnest(range(0, ((SELECT count(*) FROM planted) - 100) // 20 + 1)) AS "window"),
r AS (SELECT "window", count(*) AS n, regr_slope(y, x) AS slope, corr(x, y) AS r FROM g JOIN l ON t_idx >= "window" * 20 AND t_idx < "window" * 20 + 100 WHERE x IS NOT NULL GROUP BY 1)"""


@query("rolling_strength", sql("planted") + _ROLL + f" SELECT 'all' AS unit_id, \"window\", n, {R('slope')} AS slope, {R('r')} AS r FROM r")
def _(spark, sf):
    return stability.rolling(views.planted(spark, sf), "X", "Y", 2)


@query("cusum_stability", sql("planted") + _ROLL + f" SELECT 'all' AS unit_id, \"window\", n, {R('slope')} AS slope, {R('r')} AS r, round(sum(slope - m) OVER (ORDER BY \"window\"), 4) + 0.0 AS cusum FROM (SELECT *, avg(slope) OVER () AS m FROM r)")
def _(spark, sf):
    return stability.cusum(stability.rolling(views.planted(spark, sf), "X", "Y", 2)).drop("is_change").withColumn("cusum", F.round("cusum", 4))


_LINKS = ", " + pair_sql("ship_panel", [("qty", "price"), ("price", "qty"), ("qty", "qty"), ("price", "price")], [1, 2, 3]) + f", c AS (SELECT unit_id, source, target, lag, {_C} AS r FROM pr GROUP BY ALL), k AS (SELECT unit_id, source, target, lag FROM c WHERE abs(r) > 0.08)"


def _links(spark, sf):
    return correlation.pearson(views.ship_panel(spark, sf), [("qty", "price"), ("price", "qty"), ("qty", "qty"), ("price", "price")], [1, 2, 3]).where(F.abs("r") > 0.08)


@query("cross_unit_jaccard", sql("ship_panel") + _LINKS + f", u AS (SELECT unit_id, source || '|' || target || '|' || lag AS e FROM k) SELECT a.unit_id AS a, b.unit_id AS b, {R('(SELECT count(*) FROM u x JOIN u y ON x.e = y.e WHERE x.unit_id = a.unit_id AND y.unit_id = b.unit_id) / (SELECT count(DISTINCT e) FROM u WHERE unit_id IN (a.unit_id, b.unit_id))')} AS jaccard FROM (SELECT DISTINCT unit_id FROM k) a JOIN (SELECT DISTINCT unit_id FROM k) b ON a.unit_id < b.unit_id")
def _(spark, sf):
    return stability.unit_jaccard(_links(spark, sf), ["source", "target", "lag"])


@query("cross_unit_consensus", sql("ship_panel") + _LINKS + f" SELECT source, target, lag, {R('count(*) / (SELECT count(DISTINCT unit_id) FROM k)')} AS share FROM k GROUP BY 1, 2, 3 HAVING count(*) / (SELECT count(DISTINCT unit_id) FROM k) >= 0.5")
def _(spark, sf):
    return stability.unit_consensus(_links(spark, sf), ["source", "target", "lag"])


@query("variant_stability", f"WITH {_LIT_SQL} SELECT source, target, lag_steps, {R('avg(CASE WHEN is_significant THEN 1.0 ELSE 0.0 END)')} AS stability, CASE WHEN avg(CASE WHEN is_significant THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'robust' WHEN avg(CASE WHEN is_significant THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'moderate' ELSE 'fragile' END AS robustness FROM e GROUP BY 1, 2, 3")
def _(spark, sf):
    return stability.variant_stability(literal(spark).withColumnRenamed("is_significant", "detected"))


@query("short_lag_validation", f"WITH {_LIT_SQL} SELECT a.source, a.target, a.lag_steps AS lag_short, b.lag_steps AS lag_long, a.is_significant AND b.is_significant AND (b.lag_steps <= 3 OR abs(b.lag_steps - a.lag_steps) <= 1) AS preserved FROM e a JOIN e b ON a.source = b.source AND a.target = b.target WHERE a.method = 'Granger' AND b.method = 'TransferEntropy'")
def _(spark, sf):
    e = literal(spark)
    return stability.preserved(e.where("method = 'Granger'"), e.where("method = 'TransferEntropy'"))


# ---- chart data --------------------------------------------------------------------------------------------------------


@query("chart_ccf", sql("planted") + f""", g AS (SELECT unnest(range(-5, 6)) AS k), z AS (SELECT t_idx, ("X" - avg("X") OVER ()) / stddev_pop("X") OVER () AS x, ("Y" - avg("Y") OVER ()) / stddev_pop("Y") OVER () AS y FROM planted)
SELECT 'all' AS unit_id, CAST(k AS INTEGER) AS lag, {R('sum(a.x * b.y) / (SELECT count(*) FROM z)')} AS ccf FROM g JOIN z a ON true JOIN z b ON b.t_idx = a.t_idx + k GROUP BY k""")
def _(spark, sf):
    return chartdata.cross_correlation(views.planted(spark, sf), "X", "Y", 5)


@query("chart_p_histogram", "SELECT l_returnflag, CAST(greatest(0, least(9, floor(l_discount / 0.011))) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return chartdata.histogram(views.read(spark, sf, "lineitem"), "l_discount", 10, ["l_returnflag"], 0.0, 0.11).drop("left")


@query("chart_degrees", f"WITH {_LIT_SQL}, s AS (SELECT DISTINCT source, target FROM e WHERE p_value < 0.05), v AS (SELECT source AS v, 1 AS o, 0 AS i FROM s UNION ALL SELECT target, 0, 1 FROM s) SELECT v AS variable, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CASE WHEN sum(i) = 0 THEN 'source' WHEN sum(o) = 0 THEN 'sink' ELSE 'intermediate' END AS role FROM v GROUP BY 1")
def _(spark, sf):
    return chartdata.degrees(literal(spark))


@query("chart_lag_distribution", f"WITH {_LIT_SQL}, g AS (SELECT method, lag_steps, count(*) AS n FROM e WHERE is_significant GROUP BY 1, 2) SELECT method, lag_steps, n, {R('sum(n) OVER (PARTITION BY method ORDER BY lag_steps) / sum(n) OVER (PARTITION BY method)')} AS ecdf, lag_steps - lag(lag_steps) OVER (PARTITION BY method ORDER BY lag_steps) AS gap FROM g")
def _(spark, sf):
    return chartdata.lag_distribution(literal(spark))


@query("chart_fdr_curve", f"WITH {_LIT_SQL} SELECT method, CAST(row_number() OVER w AS INTEGER) AS rank, {R('p_value')} AS p_value, {R('q_value')} AS q_value, {R('row_number() OVER w / (count(*) OVER (PARTITION BY method) + 1)')} AS uniform, {R('row_number() OVER w / count(*) OVER (PARTITION BY method) * 0.05::DOUBLE')} AS line FROM e WHERE p_value IS NOT NULL WINDOW w AS (PARTITION BY method ORDER BY p_value, source, target, lag_steps)")
def _(spark, sf):
    return chartdata.fdr_curve(literal(spark))


@query("chart_flow", f"WITH {_LIT_SQL} SELECT source, target, lag_steps, {R('effect_size')} AS effect_size, {R('(effect_size - min(effect_size) OVER ()) / (max(effect_size) OVER () - min(effect_size) OVER ())')} AS width, count(*) OVER (PARTITION BY target) AS in_degree FROM e")
def _(spark, sf):
    return chartdata.flow(literal(spark), "effect_size")


@query("chart_independence_matrix", f"WITH {_LIT_SQL} SELECT source, " + ", ".join(f"{R(f'max(-log10(p_value + 1e-10)) FILTER (target = {chr(39)}{n}{chr(39)})')} AS \"{n}\"" for n in ["A", "B", "C", "X", "Y", "Z"]) + " FROM e GROUP BY 1")
def _(spark, sf):
    return chartdata.independence_matrix(literal(spark), ["A", "B", "C", "X", "Y", "Z"])


@query("chart_method_comparison", f"WITH {_LIT_SQL} SELECT method, count(*) AS n_edges, count(*) FILTER (is_significant) AS n_significant, {R('avg(p_value)')} AS mean_p, {R('median(p_value)')} AS median_p FROM e GROUP BY 1")
def _(spark, sf):
    return chartdata.method_comparison(literal(spark))


@query("chart_agreement_matrix", _CONS + " SELECT source, target, CAST(lag_steps AS INTEGER) AS lag_steps, CAST(contains(agreeing_methods, 'Granger') AS INTEGER) AS \"Granger\", CAST(contains(agreeing_methods, 'TransferEntropy') AS INTEGER) AS \"TransferEntropy\", CAST(contains(agreeing_methods, 'PCMCI+') AS INTEGER) AS \"PCMCI+\" FROM r")
def _(spark, sf):
    return chartdata.agreement_matrix(consensus.consensus(literal(spark)), ["Granger", "TransferEntropy", "PCMCI+"])


@query("chart_scatter_line", sql("planted") + f""", l AS (SELECT lag("X", 2) OVER (ORDER BY t_idx) AS x, "Y" AS y FROM planted), k AS (SELECT * FROM l WHERE l.x IS NOT NULL) SELECT 'all' AS unit_id, 'X' AS source, 'Y' AS target, {R('regr_slope(y, x)')} AS slope, {R('regr_intercept(y, x)')} AS intercept, {R('corr(x, y)')} AS r FROM k""")
def _(spark, sf):
    return chartdata.scatter_line(views.planted(spark, sf), [("X", "Y")], 2)


@query("chart_spectrum")
def _(spark, sf):
    return chartdata.spectrum(views.planted(spark, sf), "X", "Y")


@query("chart_partial_network")
def _(spark, sf):
    return chartdata.network(views.planted(spark, sf), PL, 0.1)


@query("router_decisions")
def _(spark, sf):
    return router.decide(views.planted(spark, sf), PAIRS)


@query("router_run")
def _(spark, sf):
    return router.decide_and_run(views.planted(spark, sf), PL, PAIRS)


@query("content_hash", "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(" + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("n_nationkey", "n_name", "n_regionkey")) + "), 1, 15) AS BIGINT)) AS VARCHAR) AS hash FROM nation")
def _(spark, sf):
    return io.content_hash(views.read(spark, sf, "nation"))
