"""Queries on edges that are computed from the whole tables, each with its DuckDB counterpart.

The edges of ``measured`` are Granger tests and Pearson and Spearman correlations
at lags 1 to 4 between all variables of the planted and the shipping series, with
q-values per method. What the operators do with a short literal list is in ``queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as q
from .functions.tails import r_to_p
from .operators import adequacy, chartdata, consensus, correlation, diagnostics, discovery, evaluation, fdr, memory, stability
from .queries import PAIRS, PL, SH, R, pair_sql, query, t_sql
from .sources import io, views
from .sources.views import sql

LAGS, DAYS = [1, 2, 3, 4], 5.0
SHIP_PAIRS = [(a, b) for a in SH for b in SH if a != b]
TRUTH = [("X", "Y"), ("Z", "Y")]
METHODS = ["Granger", "Pearson", "Spearman"]


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """method, source, target, lag_steps, lag_days, p_value, q_value, effect_size, is_directed, is_significant."""
    parts = []
    for df, pairs in ((views.planted(spark, sf), PAIRS), (views.ship_daily(spark, sf), SHIP_PAIRS)):
        parts.append(discovery.granger_l1(df, pairs).select(F.lit("Granger").alias("method"), "source", "target", F.lit(1).alias("lag_steps"), "p_value", F.col("partial_r2").alias("effect_size")))
        for name, f in (("Pearson", correlation.pearson), ("Spearman", correlation.spearman)):
            parts.append(f(df, pairs, LAGS).select(F.lit(name).alias("method"), "source", "target", F.col("lag").alias("lag_steps"), r_to_p(F.col("r"), F.col("n")).alias("p_value"), F.abs("r").alias("effect_size")))
    e = parts[0]
    for other in parts[1:]:
        e = e.unionByName(other)
    e = e.withColumn("p_value", F.round("p_value", 8)).withColumn("effect_size", F.round("effect_size", 8))
    return fdr.benjamini_hochberg(e, by=["method"]).withColumn("is_directed", F.lit(True)).withColumn("lag_days", F.col("lag_steps") * DAYS)


def _body(view: str, pairs: list[tuple[str, str]]) -> str:
    return pair_sql(view, pairs, LAGS).removeprefix("pr AS (").removesuffix(")")


_P = q.beta_sql("1 - r2", "((n - 3) / 2.0::DOUBLE)", "0.5::DOUBLE")
#: The same edges as a CTE named e.
MEASURED = f"""e AS MATERIALIZED ({sql("planted")}, pr AS ({_body("planted", PAIRS)} UNION ALL {_body("ship_daily", SHIP_PAIRS)}){q._BOTH},
own AS (SELECT *, lag(y) OVER (PARTITION BY source, target ORDER BY t_idx) AS h FROM pr WHERE lag = 1),
three AS (SELECT source, target, count(*) AS n, corr(y, x) AS a, corr(y, h) AS b, corr(x, h) AS c FROM own WHERE x IS NOT NULL AND h IS NOT NULL GROUP BY ALL),
part AS (SELECT source, target, n, ((a - b * c) / sqrt((1 - b * b) * (1 - c * c))) ** 2 AS r2 FROM three),
m AS MATERIALIZED (SELECT 'Granger' AS method, source, target, 1 AS lag, {_P} AS p, r2 AS v FROM part UNION ALL SELECT 'Pearson', source, target, lag, {t_sql('r', 'n')}, abs(r) FROM j UNION ALL SELECT 'Spearman', source, target, lag, {t_sql('sr', 'n')}, abs(sr) FROM j),
o AS (SELECT method, source, target, CAST(lag AS INTEGER) AS lag_steps, round(p, 8) + 0.0 AS p_value, round(v, 8) + 0.0 AS effect_size FROM m),
rk AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY p_value, source, target, lag_steps) AS i, count(*) OVER (PARTITION BY method) AS n FROM o),
qs AS (SELECT *, greatest(p_value, least(1.0::DOUBLE, min(p_value * n / i) OVER (PARTITION BY method ORDER BY i DESC))) AS q_value FROM rk)
SELECT method, source, target, lag_steps, p_value, q_value, effect_size, true AS is_directed, q_value <= 0.05 AS is_significant FROM qs)"""
TRUTH_SQL = "truth(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TRUTH) + ")"


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRUTH, "source string, target string")


#: Operators whose SQL is that of the literal list over other edges.
SAME: dict[str, Callable[[DataFrame], DataFrame]] = {
    "granger_transitive_reduction": lambda e: discovery.transitive_reduction(e).select("method", "source", "target", "lag_steps"),
    "granger_mediators": discovery.mediators,
    "lag_bands": lambda e: e.select("method", "source", "target", "lag_steps", consensus.lag_band(F.col("lag_steps")).alias("lag_band")),
    "band_consensus": consensus.band_consensus,
    "lag_strata": consensus.stratify,
    "lag_agreement": consensus.lag_agreement,
    "edge_diagnostics_pvalues": diagnostics.p_values,
    "edge_diagnostics_lags": diagnostics.lags,
    "wilson_ci": diagnostics.detection,
    "method_divergence": diagnostics.divergence,
    "pair_row_histogram": diagnostics.agreement,
    "edge_overview": diagnostics.overview,
    "detection_statistics": diagnostics.detection_statistics,
    "top_edges": lambda e: diagnostics.top_edges(e, 2).select("method", "source", "target", "lag_steps", "rank"),
    "strength_labels": lambda e: e.select("method", "source", "target", "lag_steps", diagnostics.strength_label(F.col("effect_size")).alias("label")),
    "variant_stability": lambda e: stability.variant_stability(e.withColumnRenamed("is_significant", "detected")),
    "chart_degrees": chartdata.degrees,
    "chart_lag_distribution": chartdata.lag_distribution,
    "chart_fdr_curve": chartdata.fdr_curve,
    "chart_flow": lambda e: chartdata.flow(e, "effect_size"),
    "chart_method_comparison": chartdata.method_comparison,
    "two_cycles": lambda e: evaluation.two_cycles(e.where("is_significant")),
    "method_jaccard": lambda e: evaluation.jaccard(e.where("is_significant")),
    "recovery_binary": lambda e: evaluation.binary(e.where("is_significant"), truth(e.sparkSession)),
    "recovery_undirected": lambda e: evaluation.binary(e.where("is_significant"), truth(e.sparkSession), directed=False),
}


def _over_tables(f: Callable[[DataFrame], DataFrame]) -> q.Query:
    return lambda spark, sf: f(measured(spark, sf))


for _name, _f in SAME.items():
    _names = len(PL) + len(SH)
    _sql = q.ORACLE[_name].replace(q._LIT_SQL, MEASURED).replace(q._TRUTH_SQL, TRUTH_SQL).replace("(6 * 5.0)", f"({_names} * {_names - 1}.0)")
    query(f"{_name}_measured", _sql)(_over_tables(_f))


@query("edges_measured", f"WITH {MEASURED} SELECT method, source, target, lag_steps, {R('p_value')} AS p_value, {R('q_value')} AS q_value, {R('effect_size')} AS effect_size, is_significant FROM e")
def _(spark, sf):
    return measured(spark, sf).select("method", "source", "target", "lag_steps", "p_value", "q_value", "effect_size", "is_significant")


@query("edge_summary", f"WITH {MEASURED} SELECT count(*) AS n_edges, count(*) FILTER (is_significant) AS n_significant, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, {R('avg(p_value)')} AS mean_p, min(lag_steps) AS lag_min, max(lag_steps) AS lag_max FROM e")
def _(spark, sf):
    return io.edge_summary(measured(spark, sf))


_HASH = "sha1(concat_ws('|', 'demo', method, source, target))"


@query("edge_hashes", f"WITH {MEASURED} SELECT method, source, target, lag_steps, {_HASH} AS edge_hash FROM e")
def _(spark, sf):
    return measured(spark, sf).select("method", "source", "target", "lag_steps", diagnostics.edge_hash("demo").alias("edge_hash"))


@query("edge_hash_collisions", f"WITH {MEASURED} SELECT {_HASH} AS edge_hash, count(*) AS count FROM e GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return diagnostics.collisions(measured(spark, sf), "demo")


@query("p_value_correlation", f"WITH {MEASURED}, w AS (SELECT min(p_value) FILTER (method = 'Pearson') AS a, min(p_value) FILTER (method = 'Spearman') AS b FROM e GROUP BY source, target), k AS (SELECT count(*) AS n, corr(a, b) AS r FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT n, {R('r')} AS r, coalesce(n >= 3 AND r > 0.8, false) AS alert FROM k")
def _(spark, sf):
    return diagnostics.p_correlation(measured(spark, sf), "Pearson", "Spearman")


_VOTES = "v AS (SELECT source, target, lag_steps, CAST(count(DISTINCT method) AS INTEGER) AS vote_count FROM e WHERE is_significant GROUP BY 1, 2, 3)"


def _votes(e: DataFrame) -> DataFrame:
    return e.where("is_significant").groupBy("source", "target", "lag_steps").agg(F.countDistinct("method").cast("int").alias("vote_count"))


_TIER = "t AS (SELECT *, CAST(CASE WHEN vote_count >= 2 AND lag_steps <= 2 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM v)"


def _tiers(e: DataFrame) -> DataFrame:
    return consensus.add_tiers(_votes(e).withColumn("oos_significant", F.col("lag_steps") <= 2))


@query("tier_filter", f"WITH {MEASURED}, {_VOTES}, {_TIER} SELECT source, target, lag_steps, vote_count, tier FROM t WHERE tier <= 2")
def _(spark, sf):
    return consensus.filter_by_tier(_tiers(measured(spark, sf))).drop("oos_significant")


_KNOWN = f"WITH {MEASURED}, {TRUTH_SQL}, {_VOTES}, {_TIER}, tt AS (SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target FROM truth)"


@query("tier_precision", _KNOWN + f", u AS (SELECT DISTINCT tier, least(source, target) AS source, greatest(source, target) AS target FROM t) SELECT tier, count(*) AS n_edges, count(tt.source) AS n_true, {R('count(tt.source) / count(*)')} AS \"precision\" FROM u LEFT JOIN tt USING (source, target) GROUP BY tier")
def _(spark, sf):
    return evaluation.tier_precision(_tiers(measured(spark, sf)), truth(spark))


@query("vote_precision", _KNOWN + f", u AS (SELECT least(source, target) AS source, greatest(source, target) AS target, max(vote_count) AS v FROM v GROUP BY ALL), k(threshold) AS (VALUES (1), (2), (3)) SELECT CAST(threshold AS INTEGER) AS threshold, count(*) AS n_edges, {R('count(tt.source) / count(*)')} AS \"precision\" FROM u JOIN k ON u.v >= threshold LEFT JOIN tt ON tt.source = u.source AND tt.target = u.target GROUP BY 1")
def _(spark, sf):
    return evaluation.vote_precision(_votes(measured(spark, sf)), truth(spark), [1, 2, 3])


@query("band_texts", f"WITH {MEASURED} SELECT method, source, target, lag_steps, CASE WHEN lag_steps <= 2 THEN 'fast: up to 10 days' WHEN lag_steps <= 3 THEN 'mid: 15 to 15 days' ELSE 'long: 20 days or more' END AS band FROM e")
def _(spark, sf):
    return measured(spark, sf).select("method", "source", "target", "lag_steps", consensus.band_text(consensus.lag_band(F.col("lag_steps"), 2, 3), DAYS, 2, 3).alias("band"))


@query("consensus_exact_against_bands", f"""WITH {MEASURED}, {_VOTES}, a AS (SELECT DISTINCT source, target, 1 AS x FROM v WHERE vote_count >= 2),
b AS (SELECT source, target, 1 AS y FROM e WHERE p_value < 0.05 GROUP BY source, target, lag_steps <= 3 HAVING count(DISTINCT method) >= 2), d AS (SELECT DISTINCT * FROM b)
SELECT count(x) AS n_exact, count(y) AS n_band, count(*) FILTER (x IS NULL) AS gained, count(*) FILTER (y IS NULL) AS lost, count(*) FILTER (x IS NULL) - count(*) FILTER (y IS NULL) AS net FROM a FULL JOIN d USING (source, target)""")
def _(spark, sf):
    e = measured(spark, sf)
    return consensus.compare_consensus(_votes(e).where("vote_count >= 2"), consensus.band_consensus(e))


# chi-square with one degree of freedom: 1 - P(1/2, x/2), by the series of the incomplete gamma function
_CHI = "1 - exp(-z + 0.5 * ln(z) - lgamma(1.5)) * list_sum(list_transform(range(0, 400), lambda k: exp(k * ln(z) + lgamma(1.5) - lgamma(1.5 + k))))"
_RATE = "g AS (SELECT method, count(*) AS n_total, count(*) FILTER (is_significant) AS n_significant FROM e GROUP BY 1)"


@query("baseline_chi_square", f"WITH {MEASURED}, {_RATE}, c AS (SELECT *, (n_significant - n_total * 0.61::DOUBLE) ** 2 / (n_total * 0.61::DOUBLE) AS chi2, chi2 / 2 AS z FROM g) SELECT method, n_total, n_significant, {R('100.0 * n_significant / n_total - 61')} AS difference_pct, {R('chi2')} AS chi2, {R(f'greatest(0.0, {_CHI})')} AS chi2_p FROM c")
def _(spark, sf):
    return diagnostics.against_baseline(measured(spark, sf)).select("method", "n_total", "n_significant", "difference_pct", "chi2", "chi2_p")


_PMF = "exp(lgamma(n_total + 1) - lgamma({i} + 1) - lgamma(n_total - {i} + 1) + {i} * ln(0.61::DOUBLE) + (n_total - {i}) * ln(0.39::DOUBLE))"


@query("baseline_binomial", f"WITH {MEASURED}, {_RATE}, c AS (SELECT *, {_PMF.format(i='n_significant')} * (1 + 1e-7) AS top FROM g), s AS (SELECT method, n_total, n_significant, top, unnest(range(0, n_total + 1)) AS i FROM c) SELECT method, {R('least(1.0, sum(pm))')} AS p_value FROM (SELECT method, top, {_PMF.format(i='i')} AS pm FROM s) WHERE pm <= top GROUP BY 1")
def _(spark, sf):
    d = diagnostics.detection(measured(spark, sf)).select("method", "k", "n").collect()  # one row a method
    return spark.createDataFrame([(r.method, diagnostics.binomial_two_sided(r.k, r.n, diagnostics.BASELINE["rate_pct"] / 100)) for r in d], "method string, p_value double")


# ---- horizons, power, strength -----------------------------------------------------------------------------------------


@query("tau_horizons", sql("ship_daily") + ", c AS (SELECT count(*) AS n FROM ship_daily) SELECT n, CAST(greatest(1, least(90, n // 3)) AS INTEGER) AS horizon, CASE WHEN 90 <= n // 3 THEN 'domain' ELSE 'nyquist' END AS binding, CAST(greatest(1, least(30, n // 8, 12)) AS INTEGER) AS tau_auto FROM c")
def _(spark, sf):
    n = views.ship_daily(spark, sf).count()
    return spark.createDataFrame([(n, *memory.nyquist_domain(n, 90, 1), memory.auto_tau(n, 1.0))], "n long, horizon int, binding string, tau_auto int")


@query("tau_recommended", f"SELECT unit_id, variable, tau_max FROM ({q.ORACLE['acf_zero_crossing']})")
def _(spark, sf):
    return memory.recommend_tau(views.ship_daily(spark, sf), ["qty", "price"], "acf_zero")


_TQ = "z + (z ** 3 + z) / 4 / df + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96 / df ** 2 + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384 / df ** 3"


@query("power_parcorr", sql("ship_daily", "order_daily") + f", c(series, n) AS (SELECT 'ship_daily', count(*) FROM ship_daily UNION ALL SELECT 'order_daily', count(*) FROM order_daily), z AS (SELECT *, {diagnostics.Z95}::DOUBLE AS z, greatest(1, n - 3 * 3 - 2) AS df FROM c), p AS (SELECT *, {_TQ} + 0.8416212335729143::DOUBLE AS d FROM z), x AS (SELECT *, least(1.0, d / sqrt(d * d + df)) AS v FROM p) SELECT series, {R('v')} AS detectable_effect, CASE WHEN v < 0.10 THEN 'high' WHEN v < 0.20 THEN 'moderate' WHEN v < 0.40 THEN 'low' ELSE 'insufficient' END AS power, v < 0.20 AS sufficient, CASE WHEN n >= 1.2 * greatest(50, 37) THEN 'robust_parcorr' ELSE 'parcorr' END AS suggested FROM x")
def _(spark, sf):
    rows = []
    for name, view in (("ship_daily", views.ship_daily), ("order_daily", views.order_daily)):
        n = view(spark, sf).count()
        found = adequacy.analyze_power("parcorr", n, 3, 4)
        rows.append((name, found["detectable_effect"], found["power"], found["sufficient"], adequacy.suggest_test(n, 3, 4)))
    return spark.createDataFrame(rows, "series string, detectable_effect double, power string, sufficient boolean, suggested string")


@query("target_entropy", sql("planted") + f""", b AS (SELECT "Y" AS y, min("Y") OVER () AS lo, max("Y") OVER () AS hi, greatest(2, least(50, count(*) OVER () // 10)) AS k FROM planted), c AS (SELECT least(floor((y - lo) * k / (hi - lo)), k - 1) AS cell, count(*) AS c FROM b GROUP BY 1) SELECT 'all' AS unit_id, {R('(ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2)')} AS entropy_bits FROM c""")
def _(spark, sf):
    return discovery.target_entropy(views.planted(spark, sf), "Y")


@query("corr_all_measures", sql("ship_panel") + f""", r AS (SELECT unit_id, qty AS x, price AS y, t_idx, rank() OVER (PARTITION BY unit_id ORDER BY qty) + (count(*) OVER (PARTITION BY unit_id, qty) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY unit_id ORDER BY price) + (count(*) OVER (PARTITION BY unit_id, price) - 1) / 2.0 AS ry FROM ship_panel),
d AS (SELECT a.unit_id, a.t_idx AS i, b.t_idx AS j, a.x - b.x AS x, a.y - b.y AS y FROM r a JOIN r b ON a.unit_id = b.unit_id),
k AS (SELECT unit_id, sum(sign(x) * sign(y)) / sqrt(sum(sign(x) ** 2) * sum(sign(y) ** 2)) AS kendall, avg(abs(x) * abs(y)) AS xy, avg(x * x) AS xx, avg(y * y) AS yy, avg(abs(x)) AS gx, avg(abs(y)) AS gy FROM d GROUP BY 1),
m AS (SELECT unit_id, i, avg(abs(x)) AS x, avg(abs(y)) AS y FROM d GROUP BY 1, 2), h AS (SELECT unit_id, avg(x * y) AS xy, avg(x * x) AS xx, avg(y * y) AS yy FROM m GROUP BY 1),
v AS (SELECT unit_id, kendall, k.xy - 2 * h.xy + gx * gy AS xy, k.xx - 2 * h.xx + gx * gx AS xx, k.yy - 2 * h.yy + gy * gy AS yy FROM k JOIN h USING (unit_id)),
p AS (SELECT unit_id, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM r GROUP BY 1)
SELECT unit_id, 'qty' AS source, 'price' AS target, n, {R('pearson')} AS pearson, {R('spearman')} AS spearman, {R('kendall')} AS kendall, {R('sqrt(xy) / sqrt(sqrt(xx * yy))')} AS distance FROM p JOIN v USING (unit_id)""")
def _(spark, sf):
    return correlation.all_measures(views.ship_panel(spark, sf), [("qty", "price")]).drop("lag")
