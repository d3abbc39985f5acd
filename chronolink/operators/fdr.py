"""Multiple testing and Monte-Carlo p-values."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that p-values without groups are dealt to.
RANGES = 256


def benjamini_hochberg(df: DataFrame, p: str = "p_value", by: list[str] | None = None, alpha: float = 0.05, q: str = "q_value", significant: str = "is_significant") -> DataFrame:
    """Adds q-values over the known p-values of each group, and q <= alpha. Without groups the p-values are dealt to ranges
    between approximate quantiles; each range is ranked by itself, and a table of the ranges carries counts and least
    values over, so no task holds them all."""
    by = by or []
    known = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    if not by:
        bounds = known.agg(F.percentile_approx(p, [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("b"))  # one row
        ranges = F.size(F.filter("b", lambda x: x < F.col(p)))
        d = known.groupBy(p).agg(F.count("*").alias("_c")).crossJoin(F.broadcast(bounds)).select(p, "_c", ranges.alias("_range"))
        up = Window.orderBy("_range")  # RANGES rows at most
        totals = d.groupBy("_range").agg(F.sum("_c").alias("_n")).select("_range", (F.sum("_n").over(up) - F.col("_n")).alias("_before"), F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_m"))
        g = Window.partitionBy("_range")
        d = d.join(F.broadcast(totals), "_range").withColumn("_s", F.col(p) * F.col("_m") / (F.col("_before") + F.sum("_c").over(g.orderBy(p))))
        later = d.groupBy("_range").agg(F.min("_s").alias("_s")).select("_range", F.min("_s").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
        least = F.least(F.min("_s").over(g.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
        d = d.join(F.broadcast(later), "_range").select(F.col(p).alias("_p"), F.greatest(F.col(p), F.least(least, F.col("_later"))).alias("_q"))
        out = df.join(d, F.col(p) == F.col("_p"), "left").withColumn(q, F.col("_q")).drop("_p", "_q")
    else:
        is_known = F.col(p).isNotNull() & ~F.isnan(p)
        g = Window.partitionBy(*by, is_known)
        scaled = F.col(p) * F.count("*").over(g) / F.col("_rk")
        down = g.orderBy(F.desc(p), F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn("_rk", F.row_number().over(g.orderBy(p)))
        out = out.withColumn(q, F.when(is_known, F.greatest(F.col(p), F.least(F.min(scaled).over(down), F.lit(1.0))))).drop("_rk")
    return out.withColumn(significant, F.coalesce(F.col(q) <= alpha, F.lit(False)))


def positional_q(df: DataFrame, order: str, p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Q-values as they come out when the divisor is the input position instead of the rank."""
    g = Window.partitionBy(F.lit(0))
    scaled = F.col(p) * F.count("*").over(g) / F.row_number().over(g.orderBy(order))
    out = df.withColumn("_s", scaled).withColumn("_rk", F.row_number().over(g.orderBy(p, order)))
    running = F.min("_s").over(g.orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(q, F.greatest(F.col(p), F.least(running, F.lit(1.0)))).drop("_s", "_rk")


def monte_carlo_p(observed: Column, surrogate: Column, alternative: str = "greater") -> Column:
    """Aggregate: (1 + surrogates at least as extreme) / (1 + surrogates); ties count."""
    tol = 100 * sys.float_info.epsilon * F.abs(observed)
    extreme = surrogate >= observed - tol if alternative == "greater" else surrogate <= observed + tol
    return (F.lit(1.0) + F.count_if(extreme)) / (F.lit(1.0) + F.count(surrogate))
