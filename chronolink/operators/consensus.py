"""Edges to edges: voting across methods, lag bands and strata, ensemble scores, evidence tiers.

Edge tables are large only through units and datasets; every operator groups by the edge's own key, so hot methods or
variables meet partial aggregates, never one list of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PARADIGM

# How reliable methods are by data regime, before they are scaled to sum to 1.
WEIGHTS = {
    "linear_gaussian": {"pcmci": 1.0, "lpcmci": 0.8, "granger": 0.9, "varlingam": 0.7, "transfer_entropy": 0.4, "predictive_baseline": 0.2, "correlation": 0.1},
    "linear_nongaussian": {"pcmci": 0.8, "lpcmci": 0.7, "granger": 0.7, "varlingam": 1.0, "transfer_entropy": 0.5, "predictive_baseline": 0.2, "correlation": 0.1},
    "nonlinear": {"pcmci": 0.6, "lpcmci": 0.5, "granger": 0.2, "varlingam": 0.7, "transfer_entropy": 0.9, "predictive_baseline": 0.4, "correlation": 0.1},
    "linear_confounded": {"pcmci": 0.5, "lpcmci": 1.0, "granger": 0.4, "varlingam": 0.3, "transfer_entropy": 0.5, "predictive_baseline": 0.2, "correlation": 0.1},
}
# Order in which methods' rows arrive, and their weight in the score of a direction.
ORDER, SCORE_WEIGHT = ["Granger", "TransferEntropy", "PCMCI+"], {"Granger": 1.0, "PCMCI+": 0.8, "TransferEntropy": 0.6}


def _map(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def paradigm(method: Column) -> Column:
    return _map(PARADIGM, method, "unknown")


def diversity(methods: Column) -> Column:
    """Distinct families in an array of methods."""
    return F.size(F.array_distinct(F.transform(methods, paradigm)))


def lag_band(lag: Column, fast: int = 3, mid: int = 9) -> Column:
    return F.when(lag.isNull(), None).when(lag <= fast, "fast").when(lag <= mid, "mid").otherwise("long")


def band_text(band: Column, sampling_days: float = 1, fast: int = 3, mid: int = 9) -> Column:
    d = lambda k: f"{k * sampling_days:g}"
    return F.when(band == "fast", f"fast: up to {d(fast)} days").when(band == "mid", f"mid: {d(fast + 1)} to {d(mid)} days").when(band == "long", f"long: {d(mid + 1)} days or more")


def significant(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows that vote: q, or else p, is in [0, alpha); rows marked not causal or undirected don't; flags count only where no
    number is known at all."""
    value = F.coalesce(F.col("q_value"), F.col("p_value"))
    has = F.max((F.col("q_value").isNotNull() | F.col("p_value").isNotNull()).cast("int")).over(Window.partitionBy("method")) == 1
    vote = F.when(has, (value >= 0) & (value < alpha)).otherwise(F.col("is_significant"))
    directed = F.coalesce(F.col("is_directed"), F.lit(True)) if "is_directed" in df.columns else F.lit(True)
    return df.withColumn("_v", F.coalesce(vote, F.lit(False)) & directed).where("_v").drop("_v")


def consensus(edges: DataFrame, tolerance: int = 1, min_votes: int = 2, alpha: float = 0.05, sampling_days: float = 1.0, bands: bool = False, order: str = "ord") -> DataFrame:
    """Vote across methods. Within a pair, rows join the first group in order of arrival that has a lag of the same kind
    (0 or over 0) within the tolerance (or of the same band); a group stays with enough methods, or as a single Granger
    edge with p < .02. Of two opposite edges the one that Granger supports stays, else the higher score.

    edges: method, source, target, lag_steps, p_value, q_value, effect_size, is_significant[, is_directed, ord]."""
    e = significant(edges, alpha).where("lag_steps is not null")
    if order not in e.columns:
        e = e.withColumn(order, F.lit(0))
    rank = _map({m: i for i, m in enumerate(ORDER)}, F.col("method"), len(ORDER))
    key = [c for c in ("unit_id",) if c in e.columns] + ["source", "target"]
    item = F.struct(rank.alias("rank"), F.col(order).cast("long").alias("ord"), F.col("method"), F.col("lag_steps").cast("int").alias("lag"), F.col("p_value").alias("p"), F.col("q_value").alias("q"), F.col("effect_size").alias("effect"))
    rows = e.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("rows"))  # a pair's rows: methods x lags

    def fits(group: Column, row: Column) -> Column:
        def near(g: Column) -> Column:
            same_kind = (g["lag"] == 0) == (row["lag"] == 0)
            return same_kind & ((lag_band(g["lag"]) == lag_band(row["lag"])) if bands else (F.abs(g["lag"] - row["lag"]) <= tolerance))

        return F.exists(group, near)

    def put(groups: Column, row: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: fits(g, row)), True)
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.array_append(g, row)).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.array_append(groups, F.array(row)))

    empty = F.lit(None).cast(f"array<{rows.schema['rows'].dataType.simpleString()}>")
    groups = rows.select(*key, F.explode(F.aggregate("rows", F.coalesce(empty, F.array().cast(f"array<{rows.schema['rows'].dataType.simpleString()}>")), put)).alias("g"))
    methods = F.array_sort(F.array_distinct(F.transform("g", lambda r: r["method"])))
    lags = F.array_sort(F.transform("g", lambda r: r["lag"].cast("double")))
    n = F.size("g")
    median = F.when(n % 2 == 1, F.get(lags, F.floor(n / 2).cast("int"))).otherwise((F.get(lags, F.floor(n / 2).cast("int") - 1) + F.get(lags, F.floor(n / 2).cast("int"))) / 2)
    total = F.aggregate(lags, F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    spread = F.when(n > 1, F.sqrt(F.aggregate(lags, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))).otherwise(0.0)
    power = lambda r: F.when(F.coalesce(r["p"], F.lit(1.0)) > 0, -F.log10(F.coalesce(r["p"], F.lit(1.0)))).otherwise(0.0)
    score = F.aggregate("g", F.lit(0.0), lambda a, r: a + _map(SCORE_WEIGHT, r["method"], 0.5) * (power(r) + 5 * F.coalesce(r["effect"], F.lit(0.0))))
    g = groups.select(
        *key, F.bround(median).cast("int").alias("lag_steps"), F.size(methods).alias("vote_count"), diversity(methods).alias("paradigm_diversity"), F.array_join(methods, ",").alias("agreeing_methods"),
        F.array_min(F.transform("g", lambda r: r["q"])).alias("best_q_value"), F.array_min(F.transform("g", lambda r: r["p"])).alias("best_p_value"), n.alias("n_significant"),
        (n == F.size(methods)).alias("all_significant"), spread.alias("lag_std_steps"), score.alias("score"), F.array_contains(methods, "Granger").alias("_granger"),
    )
    g = g.where((F.col("vote_count") >= max(2, min_votes)) | ((F.col("agreeing_methods") == "Granger") & (F.col("best_p_value") < 0.02)))
    g = g.withColumn("lag_days", F.col("lag_steps") * float(sampling_days))
    # opposite directions: only the first opposite row counts
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("vote_count"), F.desc("score"), "lag_steps"))
    lead = g.withColumn("_r", first).where("_r = 1")
    unit = key[:-2]
    back = lead.select(*unit, F.col("source").alias("target"), F.col("target").alias("source"), F.col("score").alias("_bs"), F.col("_granger").alias("_bg"))
    j = g.join(back, [*unit, "source", "target"], "left")
    forward = F.col("source") < F.col("target")
    loses = F.when(F.col("_bs").isNull(), False).when(F.col("_granger") & ~F.col("_bg"), False).when(~F.col("_granger") & F.col("_bg"), True).otherwise((F.col("_bs") > F.col("score")) | ((F.col("_bs") == F.col("score")) & ~forward))
    return j.where(~loses).drop("_bs", "_bg", "_granger")


def voting_matrix(c: DataFrame) -> DataFrame:
    """How many edges each combination of methods supports."""
    return c.groupBy("agreeing_methods", "vote_count").agg(F.count("*").alias("n_edges"))


def band_consensus(edges: DataFrame, alpha: float = 0.05, min_votes: int = 2) -> DataFrame:
    """Votes of any number of methods per pair and lag band."""
    e = edges.where(F.col("p_value") < alpha).withColumn("lag_band", lag_band(F.col("lag_steps")))
    g = e.groupBy("source", "target", "lag_band").agg(
        F.countDistinct("method").alias("vote_count"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("agreeing_methods"), F.percentile("lag_steps", F.lit(0.5)).cast("int").alias("median_lag"),
        F.min("lag_steps").alias("min_lag"), F.max("lag_steps").alias("max_lag"), F.min("p_value").alias("best_p"), F.avg("p_value").alias("mean_p"), F.count("*").alias("n_rows"),
    )
    return g.where(F.col("vote_count") >= min_votes)


def compare_consensus(exact: DataFrame, band: DataFrame) -> DataFrame:
    j = exact.select("source", "target").distinct().withColumn("e", F.lit(1)).join(band.select("source", "target").distinct().withColumn("b", F.lit(1)), ["source", "target"], "full_outer")
    return j.agg(F.count("e").alias("n_exact"), F.count("b").alias("n_band"), F.count_if(F.col("e").isNull()).alias("gained"), F.count_if(F.col("b").isNull()).alias("lost")).withColumn("net", F.col("gained") - F.col("lost"))


def stratify(edges: DataFrame, short: int = 3, long: int = 10, by_source: bool = False) -> DataFrame:
    """Significant edges with short and long lags per method (and source)."""
    keys = ["method", *(["source"] if by_source else [])]
    g = edges.where("is_significant").groupBy(*keys).agg(F.count("*").alias("n_edges"), F.count_if(F.col("lag_steps") <= short).alias("n_short"), F.count_if(F.col("lag_steps") >= long).alias("n_long"))
    return g.withColumn("short_pct", 100.0 * F.col("n_short") / F.col("n_edges")).withColumn("long_pct", 100.0 * F.col("n_long") / F.col("n_edges"))


def lag_agreement(edges: DataFrame, short: int = 3, long: int = 10, min_methods: int = 2) -> DataFrame:
    """Edges that several methods find within a stratum."""
    s = edges.where("is_significant").withColumn("stratum", F.when(F.col("lag_steps") <= short, "short").when(F.col("lag_steps") >= long, "long")).where("stratum is not null")
    return s.groupBy("stratum", "source", "target").agg(F.countDistinct("method").alias("n_methods"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods")).where(F.col("n_methods") >= min_methods)


def regime(linear: bool = True, gaussian: bool = True, confounded: bool = False) -> str:
    return "nonlinear" if not linear else "linear_nongaussian" if not gaussian else "linear_confounded" if confounded else "linear_gaussian"


def method_weights(name: str, methods: list[str]) -> dict[str, float]:
    """Weights of the known methods present, summing to 1; equal weights if none is known."""
    have = {m: WEIGHTS.get(name, WEIGHTS["linear_gaussian"])[m] for m in methods if m in WEIGHTS["linear_gaussian"]}
    total = sum(have.values())
    return {m: w / total for m, w in have.items()} if have else {m: 1 / len(methods) for m in methods}


def ensemble(edges: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Sum of the weights of the methods that find an edge."""
    e = edges.where("is_significant").select("method", "source", "target").distinct().withColumn("w", _map(weights, F.col("method"), 0.0))
    g = e.groupBy("source", "target").agg(F.least(F.lit(1.0), F.sum("w")).alias("confidence"), F.count("*").alias("n_methods_found"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    return g.withColumn("n_methods_total", F.lit(len(weights))).withColumn("is_significant", F.col("confidence") >= threshold)


def tier(votes: Column, passed: Column, stable: Column, outside: Column) -> Column:
    """1: two votes, two falsification tests passed and stable; 2: two votes and one test or out-of-sample support; else 3."""
    n, p, s, o = F.coalesce(votes, F.lit(0)), F.coalesce(passed, F.lit(0)), F.coalesce(stable, F.lit(False)), F.coalesce(outside, F.lit(False))
    return F.when(n < 2, 3).when((p >= 2) & s, 1).when((p >= 1) | o, 2).otherwise(3)


def add_tiers(c: DataFrame) -> DataFrame:
    col = lambda name, default: F.col(name) if name in c.columns else F.lit(default)
    return c.withColumn("tier", tier(col("vote_count", 0), col("falsification_passed", 0), col("icp_stable", False), col("oos_significant", False)))


TIER_TEXT = {1: "agreed, falsification passed, stable", 2: "agreed, with some further evidence", 3: "exploratory"}


def tier_summary(c: DataFrame) -> DataFrame:
    """Always the three tiers, with counts and percent."""
    spark: SparkSession = c.sparkSession
    dim = spark.createDataFrame(list(TIER_TEXT.items()), "tier int, description string")
    n = c.groupBy("tier").agg(F.count("*").alias("n"))
    out = dim.join(n, "tier", "left").withColumn("n_edges", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return out.withColumn("pct", F.coalesce(100.0 * F.col("n_edges") / F.nullif(F.sum("n_edges").over(Window.partitionBy(F.lit(1))), F.lit(0)), F.lit(0.0)))


def filter_by_tier(c: DataFrame, most: int = 2) -> DataFrame:
    return c.where(F.col("tier") <= most) if "tier" in c.columns else c


def supported_by(c: DataFrame, thresholds: list[int]) -> DataFrame:
    """Edges with at least k votes, for each k."""
    k = c.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    return c.join(F.broadcast(k), F.col("vote_count") >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n_edges"))
