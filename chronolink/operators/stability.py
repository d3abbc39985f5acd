"""Stability of effects over environments, windows, halves and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import by_time, corr
from ..functions.tails import chi2_upper, f_upper
from ..schema import IDX, TS, UNIT


def temporal_environments(df: DataFrame, n_blocks: int = 3, method: str = "equal") -> DataFrame:
    """env: equal blocks of rows (the rest goes to the last), or seasons of the year."""
    if method == "seasonal":
        m = F.month(TS)
        return df.withColumn("env", F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON"))
    n = F.count("*").over(Window.partitionBy(UNIT))
    k = F.greatest(F.lit(2), F.least(F.lit(n_blocks), F.floor(n / 30)))
    return df.withColumn("env", F.least(F.floor(F.col(IDX) / F.floor(n / k)), k - 1).cast("string"))


def fit(df: DataFrame, source: str, target: str, lag: int, by: list[str]) -> DataFrame:
    """OLS of target on the lagged source per group, the lag taken within it: n, slope, intercept, r2, se."""
    w = Window.partitionBy(*by).orderBy(IDX)
    rows = df.select(*by, IDX, F.lag(source, lag).over(w).alias("x"), F.col(target).alias("y")).where("x is not null and y is not null")
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy")).where("sxx > 0 and n > 2")
    slope = F.col("sxy") / F.col("sxx")
    return g.select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), (F.col("sxy") ** 2 / F.nullif(F.col("sxx") * F.col("syy"), F.lit(0.0))).alias("r2"), F.sqrt(F.greatest(F.lit(0.0), (F.col("syy") - slope * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))).alias("se"))


def homogeneity(slopes: DataFrame, by: list[str], method: str = "ci_overlap", alpha: float = 0.05) -> DataFrame:
    """icp_stable, statistic and p per edge from slopes and their errors over environments; unstable under two of them."""
    wt = 1 / F.nullif(F.col("se") ** 2, F.lit(0.0))
    b = F.col("slope")
    g = slopes.groupBy(*by).agg(
        F.count("*").alias("k"), F.avg(b).alias("m"), F.stddev_samp(b).alias("s"), F.var_samp(b).alias("v"), F.avg(F.col("se") ** 2).alias("mse"), F.min(F.signum(b)).alias("lo"), F.max(F.signum(b)).alias("hi"),
        F.sum(wt * b * b).alias("wbb"), F.sum(wt * b).alias("wb"), F.sum(wt).alias("w"),
    )
    cv = F.when(F.abs("m") > 1e-10, F.col("s") / F.abs("m"))
    same = F.col("lo") == F.col("hi")
    if method == "ci_overlap":
        out = g.withColumn("icp_test_statistic", F.coalesce(cv, F.col("s"))).withColumn("icp_p_value", F.lit(None).cast("double"))
        stable = F.when(cv.isNull(), F.col("s") < 0.1).otherwise((cv < 0.5) & same)
    elif method == "cochran":
        out = g.withColumn("icp_test_statistic", F.col("wbb") - F.col("wb") ** 2 / F.col("w"))
        out = out.withColumn("icp_p_value", chi2_upper(F.col("icp_test_statistic"), F.greatest(F.col("k") - 1, F.lit(1)).cast("double")))
        stable = F.col("icp_p_value") > alpha
    else:
        out = g.withColumn("icp_test_statistic", F.col("v") / F.nullif(F.col("mse"), F.lit(0.0)))
        out = out.withColumn("icp_p_value", f_upper(F.col("icp_test_statistic"), F.greatest(F.col("k") - 1, F.lit(1)).cast("double"), (10 * F.col("k")).cast("double")))
        stable = (F.col("k") < 3) | (F.col("icp_p_value") > alpha)
    return out.select(*by, F.col("k").alias("icp_n_environments"), "icp_test_statistic", "icp_p_value", F.coalesce(stable & (F.col("k") >= 2), F.lit(False)).alias("icp_stable"))


def edge_slopes(df: DataFrame, edges: list[tuple[str, str, int]], env: str = "env", least: int = 30) -> DataFrame:
    """Slopes of many edges in many environments, from one embedding and one aggregation."""
    w = Window.partitionBy(UNIT, env).orderBy(IDX)
    lags = {(s, k): F.lag(s, k).over(w) for s, _, k in edges}
    wide = df.select(UNIT, env, *dict.fromkeys(t for _, t, _ in edges), *[c.alias(f"_{s}_{k}") for (s, k), c in lags.items()])
    cells = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(k).alias("lag_steps"), F.col(f"_{s}_{k}").alias("x"), F.col(t).alias("y")) for s, t, k in edges])
    rows = wide.select(UNIT, env, F.inline(cells)).where("x is not null and y is not null")
    g = rows.groupBy(UNIT, "source", "target", "lag_steps", env).agg(F.count("*").alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy")).where((F.col("sxx") > 0) & (F.col("n") >= least))
    slope = F.col("sxy") / F.col("sxx")
    return g.select(UNIT, "source", "target", "lag_steps", env, "n", slope.alias("slope"), F.sqrt(F.greatest(F.lit(0.0), (F.col("syy") - slope * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))).alias("se"))


def edge_stability(df: DataFrame, edges: list[tuple[str, str, int]], env: str | None = None, n_blocks: int = 3, method: str = "ci_overlap", least: int = 30) -> DataFrame:
    """ICP-style stability of edges over the values of env, or per unit over blocks of its time."""
    d = temporal_environments(df, n_blocks) if env is None else df
    slopes, key = edge_slopes(d, edges, env or "env", least), ["source", "target", "lag_steps"]
    # blocks of time belong to a unit; a given environment may span units or be one
    return homogeneity(slopes, [UNIT, *key] if env is None else key, method)


def windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """Each row once for every window of ``size`` rows (starting every ``step``) that holds it; window: the start's number."""
    n = F.count("*").over(Window.partitionBy(UNIT))
    last = F.floor((n - size) / step)
    lo = F.greatest(F.lit(0), F.ceil((F.col(IDX) - size + 1) / step))
    hi = F.least(last, F.floor(F.col(IDX) / step))
    return df.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("window", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def rolling(df: DataFrame, source: str, target: str, lag: int, size: int = 100, step: int = 20) -> DataFrame:
    """Slope and correlation per sliding window, the lag taken on the whole series."""
    d = df.select(UNIT, IDX, F.lag(source, lag).over(by_time()).alias("x"), F.col(target).alias("y"))
    g = windows(d, size, step).where("x is not null and y is not null").groupBy(UNIT, "window")
    return g.agg(F.count("*").alias("n"), (F.regr_sxy("y", "x") / F.nullif(F.regr_sxx("y", "x"), F.lit(0.0))).alias("slope"), corr(F.col("x"), F.col("y")).alias("r"))


def cusum(effects: DataFrame, value: str = "slope", limit: float = 3.0) -> DataFrame:
    """Cumulated deviations of windows' effects; change points beyond ``limit`` population deviations; needs five windows."""
    w, run = Window.partitionBy(UNIT), Window.partitionBy(UNIT).orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    d = effects.withColumn("_m", F.avg(value).over(w)).withColumn("_s", F.stddev_pop(value).over(w)).withColumn("_n", F.count("*").over(w)).where("_n >= 5")
    d = d.withColumn("cusum", F.sum(F.col(value) - F.col("_m")).over(run))
    return d.withColumn("is_change", F.abs("cusum") > limit * F.col("_s")).drop("_m", "_s", "_n")


def expanding_folds(df: DataFrame, n_splits: int = 3) -> DataFrame:
    """Each row once for every fold whose training part holds it."""
    n = F.count("*").over(Window.partitionBy(UNIT))
    size = F.floor(n / (n_splits + 1))
    return df.withColumn("_n", n).withColumn("_s", size).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))).where(F.col(IDX) < F.col("_n") - (F.lit(n_splits) - F.col("fold") + 1) * F.col("_s")).drop("_n", "_s")


def fold_votes(edges: DataFrame, n_splits: int = 3) -> DataFrame:
    """Edges (fold, source, target, is_significant): in how many folds they are found; stable: in all but one at least."""
    g = edges.where("is_significant").groupBy(*[c for c in (UNIT,) if c in edges.columns], "source", "target").agg(F.countDistinct("fold").alias("n_folds"))
    return g.withColumn("stable", F.col("n_folds") >= max(1, n_splits - 1))


def halves(df: DataFrame) -> DataFrame:
    return df.withColumn("half", F.when(F.col(IDX) < F.floor(F.count("*").over(Window.partitionBy(UNIT)) / 2), 0).otherwise(1))


def link_frequency(links: DataFrame, n: int) -> DataFrame:
    """Links (b, source, target, lag_steps, strength) of n resamples, per unit where there are units: frequency, mean and 95 %
    interval of the strength."""
    return links.groupBy(*[c for c in (UNIT,) if c in links.columns], "source", "target", "lag_steps").agg((F.count("*") / F.lit(n)).alias("frequency"), F.avg(F.abs("strength")).alias("mean_strength"), F.percentile(F.abs("strength"), F.lit(0.025)).alias("ci_low"), F.percentile(F.abs("strength"), F.lit(0.975)).alias("ci_high"))


def robustness_class(stability: Column) -> Column:
    return F.when(stability >= 0.8, "robust").when(stability >= 0.5, "moderate").otherwise("fragile")


def variant_stability(detections: DataFrame) -> DataFrame:
    """detections (variant, source, target, lag_steps, detected): share of variants that find a link, and its class."""
    g = detections.groupBy("source", "target", "lag_steps").agg(F.avg(F.col("detected").cast("double")).alias("stability"))
    return g.withColumn("robustness", robustness_class(F.col("stability")))


def unit_jaccard(links: DataFrame, keys: list[str]) -> DataFrame:
    """Jaccard index of each two units' link sets: as many rows as pairs of units, which is what is asked for."""
    e = links.select(UNIT, *keys).distinct()
    n = e.groupBy(UNIT).agg(F.count("*").alias("n"))
    pairs = n.select(F.col(UNIT).alias("a"), F.col("n").alias("na")).join(n.select(F.col(UNIT).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    both = e.select(F.col(UNIT).alias("a"), *keys).join(e.select(F.col(UNIT).alias("b"), *keys), keys).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (F.coalesce("c", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("c", F.lit(0)))).alias("jaccard"))


def unit_consensus(links: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Links found in at least a share of the units."""
    n = links.select(UNIT).distinct().count()
    return links.select(UNIT, *keys).distinct().groupBy(*keys).agg((F.count("*") / F.lit(n)).alias("share")).where((F.col("share") >= threshold) & (F.lit(n) >= 2))


def preserved(short: DataFrame, long: DataFrame, short_max: int = 3) -> DataFrame:
    """Edges significant at a short and a long horizon, with the long lag short too or within one step."""
    j = short.select("source", "target", F.col("lag_steps").alias("s"), F.col("is_significant").alias("a")).join(long.select("source", "target", F.col("lag_steps").alias("l"), F.col("is_significant").alias("b")), ["source", "target"])
    return j.select("source", "target", F.col("s").alias("lag_short"), F.col("l").alias("lag_long"), (F.col("a") & F.col("b") & ((F.col("l") <= short_max) | (F.abs(F.col("l") - F.col("s")) <= 1))).alias("preserved"))
