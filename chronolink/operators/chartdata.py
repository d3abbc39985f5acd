"""The data behind each figure; drawing is left to the reader's tools."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import corr
from ..schema import IDX, UNIT
from .correlation import Pairs, correlation_matrix_rows, pair_rows


def weight(p: Column) -> Column:
    return -F.log10(p + 1e-10)


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts of equal-width bins per group, over the given range or the group's own."""
    by = by or []
    d = df.where(F.col(value).isNotNull())
    if lo is None or hi is None:
        own = d.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        d = d.join(own, by) if by else d.crossJoin(F.broadcast(own))  # without groups, own is one row
    a, b = F.lit(lo) if lo is not None else F.col("_lo"), F.lit(hi) if hi is not None else F.col("_hi")
    d = d.withColumn("_a", a).withColumn("_w", (b - a) / bins)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_a")) / F.nullif(F.col("_w"), F.lit(0.0))))).cast("int")
    return d.groupBy(*by, F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"), (F.min("_a") + F.coalesce(bin_min(bin_), F.lit(0)) * F.min("_w")).alias("left"))


def bin_min(b: Column) -> Column:
    return F.min(b)


def cross_correlation(df: DataFrame, x: str, y: str, max_lag: int = 12) -> DataFrame:
    """CCF at lags -max_lag..max_lag with the whole series' means and deviations."""
    w = Window.partitionBy(UNIT)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
    d = df.select(UNIT, IDX, z(x).alias(x), z(y).alias(y), F.count("*").over(w).alias("_n"))
    a = pair_rows(d, [(x, y)], list(range(max_lag + 1)), ["_n"])
    b = pair_rows(d, [(y, x)], list(range(1, max_lag + 1)), ["_n"]).withColumn("lag", -F.col("lag"))
    return a.unionByName(b).groupBy(UNIT, "lag").agg((F.sum(F.col("x") * F.col("y")) / F.max("_n")).alias("ccf"))


def spectrum(df: DataFrame, x: str, y: str, segment: int = 64) -> DataFrame:
    """Welch coherence and the periodogram of both series per unit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values(IDX)[[x, y]].dropna().to_numpy(float)
        n = min(segment, len(m))
        win = np.hanning(n)
        parts = [np.fft.rfft((m[a : a + n] - m[a : a + n].mean(0)) * win[:, None], axis=0) for a in range(0, len(m) - n + 1, max(1, n // 2))]
        f = np.stack(parts)
        sxx, syy, sxy = (np.abs(f[:, :, 0]) ** 2).mean(0), (np.abs(f[:, :, 1]) ** 2).mean(0), (f[:, :, 0] * f[:, :, 1].conj()).mean(0)
        return pd.DataFrame({UNIT: pdf[UNIT].iloc[0], "frequency": np.fft.rfftfreq(n), "power_x": sxx, "power_y": syy, "coherence": np.abs(sxy) ** 2 / np.maximum(sxx * syy, 1e-300)})

    return df.select(UNIT, IDX, x, y).groupBy(UNIT).applyInPandas(run, "unit_id string, frequency double, power_x double, power_y double, coherence double")


def flow(e: DataFrame, value: str = "statistic") -> DataFrame:
    """Edges with weights scaled to [0, 1], and the targets' in-degree."""
    e = e.crossJoin(F.broadcast(e.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))))  # one row
    lo, hi = F.col("_lo"), F.col("_hi")
    return e.select("source", "target", "lag_steps", value, ((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0))).alias("width"), F.count("*").over(Window.partitionBy("target")).alias("in_degree"))


def independence_matrix(e: DataFrame, names: list[str], alpha: float = 0.05) -> DataFrame:
    """-log10 p by source (rows) and target (columns), and the adjacency in long form."""
    return e.groupBy("source").pivot("target", names).agg(F.max(weight(F.col("p_value"))))


def lag_distribution(e: DataFrame) -> DataFrame:
    """Distinct lags of each method with counts, cumulative share and the gap to the next smaller."""
    g = e.where("is_significant").groupBy("method", "lag_steps").agg(F.count("*").alias("n"))
    w = Window.partitionBy("method").orderBy("lag_steps")
    return g.withColumn("ecdf", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("method"))).withColumn("gap", F.col("lag_steps") - F.lag("lag_steps").over(w))


def fdr_curve(e: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Sorted p-values with uniform quantiles, the step-up line and q-values."""
    w = Window.partitionBy("method")
    d = e.where("p_value is not null").withColumn("rank", F.row_number().over(w.orderBy("p_value", "source", "target", "lag_steps"))).withColumn("m", F.count("*").over(w))
    return d.select("method", "rank", "p_value", "q_value", (F.col("rank") / (F.col("m") + 1)).alias("uniform"), (F.col("rank") / F.col("m") * alpha).alias("line"))


def degrees(e: DataFrame, alpha: float = 0.05) -> DataFrame:
    """In- and out-degree of each variable with its role."""
    s = e.where(F.col("p_value") < alpha).select("source", "target").distinct()
    d = s.select(F.explode(F.array(F.struct(F.col("source").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    g = d.groupBy(F.col("v").alias("variable")).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return g.withColumn("role", F.when(F.col("in_degree") == 0, "source").when(F.col("out_degree") == 0, "sink").otherwise("intermediate"))


def method_comparison(e: DataFrame) -> DataFrame:
    return e.groupBy("method").agg(F.count("*").alias("n_edges"), F.count_if("is_significant").alias("n_significant"), F.avg("p_value").alias("mean_p"), F.median("p_value").alias("median_p"))


def agreement_matrix(c: DataFrame, methods: list[str]) -> DataFrame:
    """One row an edge, one 0/1 column a method."""
    have = F.split("agreeing_methods", ",")
    return c.select("source", "target", "lag_steps", *[F.array_contains(have, m).cast("int").alias(m) for m in methods])


def network(df: DataFrame, cols: list[str], least: float = 0.3) -> DataFrame:
    """Partial correlations of every pair given all other variables, at ``least`` in size: off the inverse of one matrix a unit."""
    n = len(cols)

    def run(batches):
        for pdf in batches:
            out = []
            for unit, m in zip(pdf[UNIT], pdf["m"]):
                p = np.linalg.pinv(np.nan_to_num(np.array(m, float)).reshape(n, n))
                out += [(unit, cols[i], cols[j], float(-p[i, j] / np.sqrt(max(p[i, i] * p[j, j], 1e-300)))) for i in range(n) for j in range(i + 1, n)]
            yield pd.DataFrame(out, columns=[UNIT, "var1", "var2", "r"])

    return correlation_matrix_rows(df, cols).mapInPandas(run, "unit_id string, var1 string, var2 string, r double").where(F.abs("r") >= least)


def scatter_line(df: DataFrame, pairs: Pairs, lag: int = 0) -> DataFrame:
    """Slope, intercept and correlation of the lagged scatter; a negative lag swaps the roles."""
    pairs = pairs if lag >= 0 else [(b, a) for a, b in pairs]
    rows = pair_rows(df, pairs, [abs(lag)]).where("x is not null and y is not null")
    g = rows.groupBy(UNIT, "source", "target").agg((F.regr_sxy("y", "x") / F.nullif(F.regr_sxx("y", "x"), F.lit(0.0))).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"), corr(F.col("x"), F.col("y")).alias("r"))
    return g.select(UNIT, "source", "target", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r")


def located(e: DataFrame, sites: DataFrame, site: str = "site_id") -> DataFrame:
    """Edges with both ends' coordinates."""
    s = sites.select(F.col(site).alias("source"), F.col("latitude").alias("source_lat"), F.col("longitude").alias("source_lon"))
    t = sites.select(F.col(site).alias("target"), F.col("latitude").alias("target_lat"), F.col("longitude").alias("target_lon"))
    return e.join(s, "source").join(t, "target")


def in_box(df: DataFrame, lat: tuple[float, float] = (34, 72), lon: tuple[float, float] = (-25, 45)) -> DataFrame:
    return df.where(F.col("latitude").between(*lat) & F.col("longitude").between(*lon))
