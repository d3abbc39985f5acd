"""Association of pairs of variables, at one lag or over many.

Lagged pairs come from one pass: a window embeds the lags of every variable, and each (pair, lag) is a struct of one
exploded array, so that all pairs and lags of all units are one aggregation with partial sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, by_time, complete, corr, first_by
from ..functions.tails import fisher_ci, r_to_p
from ..schema import IDX, UNIT
from .fdr import benjamini_hochberg

Pairs = list[tuple[str, str]]


def strength(r: Column, kind: str = "linear") -> Column:
    """Label of |r| by the bands .1, .3, .5, .7, with sign and kind."""
    a = F.abs(r)
    band = F.when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate").when(a < 0.7, "strong").otherwise("very strong")
    return F.when(r.isNull(), "undefined").otherwise(F.concat_ws(" ", band, F.when(r >= 0, "positive").otherwise("negative"), F.lit(kind)))


def pair_rows(df: DataFrame, pairs: Pairs, lags: list[int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per (row, pair, lag): source, target, lag, x (the source lag rows before), y."""
    lags = lags or [0]
    w = by_time()
    past = {(s, k): F.lag(s, k).over(w) if k else F.col(s) for s in dict.fromkeys(s for s, _ in pairs) for k in lags}
    wide = df.select(UNIT, IDX, *(keep or []), *dict.fromkeys(t for _, t in pairs), *[c.alias(f"_{s}_{k}") for (s, k), c in past.items()])
    cells = [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(k).alias("lag"), F.col(f"_{s}_{k}").cast("double").alias("x"), F.col(t).cast("double").alias("y")) for s, t in pairs for k in lags]
    return wide.select(UNIT, IDX, *(keep or []), F.inline(F.array(*cells)))


def pearson(df: DataFrame, pairs: Pairs, lags: list[int] | None = None) -> DataFrame:
    """unit_id, source, target, lag, n, r of complete pairs of rows."""
    return pair_rows(df, pairs, lags).groupBy(UNIT, "source", "target", "lag").agg(complete(F.col("x"), F.col("y")).alias("n"), corr(F.col("x"), F.col("y")).alias("r"))


def with_test(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    lo, hi = fisher_ci(F.col(r), F.col(n))
    return df.withColumn("p_value", r_to_p(F.col(r), F.col(n))).withColumn("ci_low", lo).withColumn("ci_high", hi).withColumn("label", strength(F.col(r)))


def spearman(df: DataFrame, pairs: Pairs, lags: list[int] | None = None) -> DataFrame:
    key = [UNIT, "source", "target", "lag"]
    rows = pair_rows(df, pairs, lags).where("x is not null and y is not null")
    ranked = rows.select(*key, average_rank(F.col("x"), *key).alias("x"), average_rank(F.col("y"), *key).alias("y"))
    return ranked.groupBy(*key).agg(F.count("*").alias("n"), corr(F.col("x"), F.col("y")).alias("r"))


def _merge_count(y: np.ndarray) -> int:
    """Strict inversions of y, by merge sort over blocks."""
    n, total, width = len(y), 0, 1
    y = y.copy()
    while width < n:
        for lo in range(0, n, 2 * width):
            a, b = y[lo : lo + width], y[lo + width : lo + 2 * width]
            if len(b):
                total += int((len(a) - np.searchsorted(a, b, "right")).sum())
                y[lo : lo + len(a) + len(b)] = np.sort(np.concatenate([a, b]), kind="mergesort")
        width *= 2
    return total


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b in O(n log n)."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = lambda *cols: sum(c * (c - 1) // 2 for c in np.unique(np.stack(cols, 1), axis=0, return_counts=True)[1])
    total, tx, ty, txy = n * (n - 1) // 2, pairs(x), pairs(y), pairs(x, y)
    swaps = _merge_count(y)
    num = total - tx - ty + txy - 2 * swaps
    den = np.sqrt(float(total - tx) * float(total - ty))
    return float(num / den) if den > 0 else float("nan")


def distance_correlation(x: np.ndarray, y: np.ndarray, block: int = 1024) -> tuple[float, float]:
    """(dcor, dcov) in blocks of rows: the distance matrices are never held."""
    n = len(x)
    if n < 4:
        return float("nan"), float("nan")
    sums = {"ab": 0.0, "aa": 0.0, "bb": 0.0}
    ra, rb = np.empty(n), np.empty(n)
    for lo in range(0, n, block):
        a, b = np.abs(x[lo : lo + block, None] - x), np.abs(y[lo : lo + block, None] - y)
        sums["ab"] += (a * b).sum()
        sums["aa"] += (a * a).sum()
        sums["bb"] += (b * b).sum()
        ra[lo : lo + block], rb[lo : lo + block] = a.mean(1), b.mean(1)
    ma, mb = ra.mean(), rb.mean()
    part = lambda s, u, v, m: max(s / n**2 - 2 * (u * v).mean() + m, 0.0)
    cov, va, vb = part(sums["ab"], ra, rb, ma * mb), part(sums["aa"], ra, ra, ma * ma), part(sums["bb"], rb, rb, mb * mb)
    return (np.sqrt(cov) / (va * vb) ** 0.25 if va * vb > 0 else 0.0), np.sqrt(cov)


def _grouped(df: DataFrame, pairs: Pairs, lags: list[int] | None, function, schema: str) -> DataFrame:
    key = [UNIT, "source", "target", "lag"]
    rows = pair_rows(df, pairs, lags).where("x is not null and y is not null")

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = function(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame([[*k, len(pdf), *got]])

    return rows.groupBy(*key).applyInPandas(run, f"unit_id string, source string, target string, lag int, n long, {schema}")


def kendall(df: DataFrame, pairs: Pairs, lags: list[int] | None = None) -> DataFrame:
    return _grouped(df, pairs, lags, lambda x, y: (kendall_tau(x, y),), "r double").withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def distance(df: DataFrame, pairs: Pairs, lags: list[int] | None = None) -> DataFrame:
    return _grouped(df, pairs, lags, distance_correlation, "r double, dcov double")


def partial_one(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Partial correlation given one variable, from three correlations of complete rows."""
    d = df.na.drop(subset=[x, y, z]).groupBy(UNIT).agg(F.count("*").alias("n"), corr(F.col(x), F.col(y)).alias("a"), corr(F.col(x), F.col(z)).alias("b"), corr(F.col(y), F.col(z)).alias("c"))
    r = (F.col("a") - F.col("b") * F.col("c")) / F.sqrt(F.nullif((1 - F.col("b") ** 2) * (1 - F.col("c") ** 2), F.lit(0.0)))
    return d.select(UNIT, F.lit(x).alias("source"), F.lit(y).alias("target"), F.lit(z).alias("given"), "n", r.alias("r"))


def correlation_matrix_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairwise correlations of complete rows as arrays, one row per unit: unit_id, n, m (row-major)."""
    cells = [corr(F.col(a), F.col(b)) if a != b else F.lit(1.0) for a in cols for b in cols]
    return df.na.drop(subset=cols).groupBy(UNIT).agg(F.count("*").alias("n"), F.array(*cells).alias("m"))


def partial(df: DataFrame, x: str, y: str, given: list[str]) -> DataFrame:
    """Partial correlation given several variables, by inverting one small matrix a unit."""
    cols = [x, y, *given]

    def run(batches):
        for pdf in batches:
            out = []
            for unit, n, m in zip(pdf[UNIT], pdf["n"], pdf["m"]):
                c = np.array(m, float).reshape(len(cols), len(cols))
                ok = np.isfinite(c).all() and np.linalg.matrix_rank(c) == len(cols)
                p = np.linalg.inv(c) if ok else None
                out.append((unit, n, -p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]) if ok else None))
            yield pd.DataFrame(out, columns=[UNIT, "n", "r"])

    got = correlation_matrix_rows(df, cols).mapInPandas(run, "unit_id string, n long, r double")
    return got.select(UNIT, F.lit(x).alias("source"), F.lit(y).alias("target"), F.lit(",".join(given)).alias("given"), "n", "r")


def all_measures(df: DataFrame, pairs: Pairs, lags: list[int] | None = None) -> DataFrame:
    """Pearson, Spearman, Kendall and distance correlation of complete rows, side by side."""
    key = [UNIT, "source", "target", "lag"]
    out = pearson(df, pairs, lags).withColumnRenamed("r", "pearson")
    for name, f in (("spearman", spearman), ("kendall", kendall), ("distance", distance)):
        out = out.join(f(df, pairs, lags).select(*key, F.col("r").alias(name)), key)
    return out


def sparse(df: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """Unordered pairs with p under alpha."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return with_test(pearson(df, pairs)).where(F.col("p_value") < alpha)


def batch(df: DataFrame, pairs: Pairs, alpha: float = 0.05) -> DataFrame:
    """Pearson and Spearman per pair with FDR-adjusted q-values."""
    key = [UNIT, "source", "target"]
    a = pearson(df, pairs).select(*key, "n", F.col("r").alias("pearson_r")).withColumn("pearson_p", r_to_p(F.col("pearson_r"), F.col("n")))
    b = spearman(df, pairs).select(*key, F.col("n").alias("m"), F.col("r").alias("spearman_r")).withColumn("spearman_p", r_to_p(F.col("spearman_r"), F.col("m"))).drop("m")
    out = a.join(b, key)
    for m in ("pearson", "spearman"):
        out = benjamini_hochberg(out, f"{m}_p", [UNIT], alpha, f"{m}_q", f"{m}_significant_fdr")
    return out


def lagged(df: DataFrame, pairs: Pairs, tau_max: int = 10, alpha: float = 0.05, sampling_days: float = 1.0, least: int = 10) -> DataFrame:
    """Pearson and Spearman of every pair and lag; the larger |r| counts (Pearson on ties); is_best_lag: the largest |r| of
    a pair, the smaller lag on ties."""
    key, lags = [UNIT, "source", "target", "lag"], list(range(1, tau_max + 1))
    out = pearson(df, pairs, lags).withColumnRenamed("r", "pearson_r").join(spearman(df, pairs, lags).select(*key, F.col("r").alias("spearman_r")), key).where(F.col("n") >= least)
    out = out.withColumn("best_method", F.when(F.coalesce(F.abs("spearman_r"), F.lit(0.0)) > F.coalesce(F.abs("pearson_r"), F.lit(0.0)), "spearman").otherwise("pearson"))
    out = out.withColumn("best_r", F.when(F.col("best_method") == "spearman", F.col("spearman_r")).otherwise(F.col("pearson_r")))
    out = out.withColumn("best_p", r_to_p(F.col("best_r"), F.col("n"))).withColumn("is_significant", F.coalesce(F.col("best_p") < alpha, F.lit(False)))
    best = first_by([UNIT, "source", "target"], [F.desc_nulls_last(F.abs("best_r")), "lag"])
    return out.withColumn("is_best_lag", best == 1).withColumn("lag_days", F.col("lag") * float(sampling_days))


def matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """var1, var2, r for all ordered pairs, pairwise complete, null under three rows."""
    f = {"pearson": pearson, "spearman": spearman, "kendall": kendall, "distance": distance}[method]
    half = f(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]]).select(UNIT, F.col("source").alias("var1"), F.col("target").alias("var2"), F.when(F.col("n") >= 3, F.col("r")).alias("r"))
    return half.unionByName(half.where("var1 <> var2").select(UNIT, F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r"))


def lagged_edges(df: DataFrame, pairs: Pairs, tau_max: int = 10, alpha: float = 0.05, sampling_days: float = 1.0) -> DataFrame:
    """Lagged Pearson correlation as edges, with q-values per unit and the best lag of each pair."""
    rows = pearson(df, pairs, list(range(1, tau_max + 1))).where("n >= 10").withColumn("p_value", r_to_p(F.col("r"), F.col("n")))
    rows = benjamini_hochberg(rows, "p_value", [UNIT], alpha)
    best = F.row_number().over(Window.partitionBy(UNIT, "source", "target").orderBy(F.desc_nulls_last(F.abs("r")), "lag")) == 1
    return rows.select(UNIT, F.lit("correlation").alias("method"), "source", "target", F.col("lag").alias("lag_steps"), (F.col("lag") * float(sampling_days)).alias("lag_days"), F.col("r").alias("statistic"), F.abs("r").alias("effect_size"), "p_value", "q_value", "is_significant", best.alias("is_best_lag"), F.col("n").alias("n_obs"))
