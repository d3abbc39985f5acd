"""Distributions of p-values and lags, detection rates, agreement, guards and report sentences over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import corr, first_by
from ..functions.tails import chi2_upper

Z95 = 1.959963984540054
#: Literature baseline that detection rates are held against: rate in percent, and weeks of lag.
BASELINE = {"rate_pct": 61.0, "min_lag": 1, "max_lag": 12}


def p_values(e: DataFrame) -> DataFrame:
    p = F.col("p_value")
    return e.groupBy("method").agg(
        F.count(p).alias("n"), F.avg(p).alias("mean"), F.median(p).alias("median"), F.stddev_samp(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"),
        F.percentile(p, F.lit(0.25)).alias("q25"), F.percentile(p, F.lit(0.75)).alias("q75"), F.count_if(p < 0.05).alias("n_below"), (100.0 * F.count_if(p < 0.05) / F.count(p)).alias("pct_below"),
    )


def lags(e: DataFrame) -> DataFrame:
    d = F.col("lag_days")
    return e.groupBy("method").agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.stddev_samp(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"),
        F.mode(d, True).alias("mode"), (100.0 * F.count_if((d >= 5) & (d <= 15)) / F.count(d)).alias("pct_5_15"),
    )


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a rate, within [0, 1]; (0, 1) of nothing."""
    p, m = k / F.nullif(n, F.lit(0)), n.cast("double")
    mid, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def detection(e: DataFrame) -> DataFrame:
    g = e.groupBy("method").agg(F.count("*").alias("n"), F.count_if("is_significant").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("method", "n", "k", (F.col("k") / F.col("n")).alias("rate"), lo.alias("ci_low"), hi.alias("ci_high"))


def agreement(e: DataFrame) -> DataFrame:
    """How many pairs have 1, 2, ... rows."""
    return e.groupBy("source", "target").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("n_pairs"))


def overview(e: DataFrame) -> DataFrame:
    names = e.select(F.explode(F.array("source", "target")).alias("v")).agg(F.countDistinct("v").alias("n_variables"))
    g = e.agg(F.count("*").alias("n_edges"), F.countDistinct("source", "target").alias("n_pairs"), F.avg("p_value").alias("mean_p"), F.avg("lag_days").alias("mean_lag"))
    return g.crossJoin(names).withColumn("coverage", F.col("n_pairs") / F.nullif(F.col("n_variables") * (F.col("n_variables") - 1), F.lit(0)))


def divergence(e: DataFrame, alpha: float = 0.05, limit: float = 0.2) -> DataFrame:
    """Detection rate per method, and whether one deviates from their mean by more than ``limit`` of it."""
    hit = F.coalesce(F.col("q_value") < alpha, F.col("is_significant"), F.col("p_value") < alpha)
    g = e.groupBy("method").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("rate"))
    w = Window.partitionBy(F.lit(1))  # one row a method
    g = g.withColumn("mean_rate", F.avg("rate").over(w)).withColumn("deviation", F.abs(F.col("rate") - F.col("mean_rate")) / F.nullif(F.col("mean_rate"), F.lit(0.0)))
    return g.withColumn("alert", F.coalesce(F.max("deviation").over(w) > limit, F.lit(False)) & (F.count("*").over(w) > 1))


def detection_statistics(e: DataFrame, min_lag: int = 1, max_lag: int = 12) -> DataFrame:
    s = F.col("is_significant")
    lag = F.when(s, F.col("lag_steps"))
    g = e.groupBy("method").agg(F.count("*").alias("n_total"), F.count_if(s).alias("n_significant"), F.avg(lag).alias("mean_lag"), F.median(lag).alias("median_lag"), F.stddev_samp(lag).alias("std_lag"), F.count_if((lag >= min_lag) & (lag <= max_lag)).alias("n_in_range"))
    return g.withColumn("rate_pct", 100.0 * F.col("n_significant") / F.col("n_total"))


def against_baseline(e: DataFrame) -> DataFrame:
    g = detection_statistics(e, BASELINE["min_lag"], BASELINE["max_lag"]).withColumn("baseline_pct", F.lit(BASELINE["rate_pct"]))
    expected = F.col("n_total") * F.col("baseline_pct") / 100
    g = g.withColumn("difference_pct", F.col("rate_pct") - F.col("baseline_pct")).withColumn("chi2", (F.col("n_significant") - expected) ** 2 / F.nullif(expected, F.lit(0.0)))
    return g.withColumn("chi2_p", chi2_upper(F.col("chi2"), 1.0))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact: the probability of all counts no likelier than k."""
    from math import exp, lgamma, log

    def pmf(i: int) -> float:
        if p in (0.0, 1.0):
            return float(i == round(n * p))
        return exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))

    limit = pmf(k) * (1 + 1e-7)
    return min(1.0, sum(q for q in map(pmf, range(n + 1)) if q <= limit))


# Bands of effect sizes by metric.
BANDS = {"correlation": (0.3, 0.5, 0.7), "granger_f": (5, 10, 20), "te_bits": (0.1, 0.5, 1.0), "pcmci_val": (0.2, 0.4, 0.6), "other": (0.3, 0.5, 0.5)}


def strength_label(value: Column, metric: str = "correlation") -> Column:
    a, b, c = BANDS.get(metric, BANDS["other"])
    v = F.abs(value)
    return F.when(value.isNull(), "unknown").when(v < a, "weak").when(v < b, "moderate").when(v < c, "strong").otherwise("very strong")


def p_text(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < 0.001, "p<0.001").when(p < 0.01, "p<0.01").when(p < alpha, f"p<{alpha:g}").when(p < 0.1, F.format_string("p=%.3f", p)).otherwise(f"p>{alpha:g}")


def statements(c: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A sentence per consensus edge with a confidence by votes."""
    level = F.when(F.col("vote_count") >= 3, "high").when(F.col("vote_count") == 2, "moderate").otherwise("low")
    text = F.format_string("%s -> %s after %s days (%s), %s confidence", "source", "target", F.format_number("lag_days", 1), p_text(F.col("best_p_value"), alpha), level)
    return c.select("source", "target", "lag_steps", level.alias("confidence"), text.alias("statement"))


def top_edges(e: DataFrame, n: int = 10) -> DataFrame:
    """The n most significant edges of each method."""
    return e.where("is_significant").withColumn("rank", first_by(["method"], ["p_value", "source", "target", "lag_steps"])).where(F.col("rank") <= n)


def check_lag_days(e: DataFrame, sampling_days: float) -> DataFrame:
    return e.where((F.col("lag_days") - F.col("lag_steps") * sampling_days != 0) & F.col("lag_days").isNotNull())


def check_q_ge_p(e: DataFrame) -> DataFrame:
    return e.where(F.col("q_value") < F.col("p_value"))


def edge_hash(experiment: str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(experiment), "method", "source", "target"))


def collisions(e: DataFrame, experiment: str) -> DataFrame:
    return e.withColumn("edge_hash", edge_hash(experiment)).groupBy("edge_hash").count().where("count > 1")


def guard(violations: DataFrame, message: str) -> None:
    """Raise if a check found rows."""
    if violations.head(1):
        raise ValueError(message)


def p_correlation(e: DataFrame, a: str = "Granger", b: str = "TransferEntropy") -> DataFrame:
    """Correlation of two methods' least p-values over the pairs that both have."""
    w = e.groupBy("source", "target").pivot("method", [a, b]).agg(F.min("p_value")).na.drop(subset=[a, b])
    return w.agg(F.count("*").alias("n"), corr(F.col(a), F.col(b)).alias("r")).withColumn("alert", F.coalesce((F.col("n") >= 3) & (F.col("r") > 0.8), F.lit(False)))
