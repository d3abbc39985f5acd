"""Which methods suit a pair, from features of its rows, and running the chosen ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import corr
from ..operators import discovery, memory
from ..operators.correlation import Pairs, pair_rows
from ..schema import UNIT


def features(df: DataFrame, pairs: Pairs, sampling_days: float = 1.0, window_days: float = 30, cap: int = 12) -> DataFrame:
    """Rows, missing share, lag horizon, correlation and information of each pair, in one aggregation."""
    rows = pair_rows(df, pairs)
    full = F.col("x").isNotNull() & F.col("y").isNotNull()
    g = rows.groupBy(UNIT, "source", "target").agg(F.count_if(full).alias("t"), (F.count_if(~full) / F.count("*")).alias("missing"), corr(F.col("x"), F.col("y")).alias("r"))
    tau = F.greatest(F.lit(1), F.least(F.ceil(F.lit(window_days / sampling_days)), F.floor(F.col("t") / 8), F.lit(cap)))
    mi = memory.binned_information(df, pairs, [0]).select(UNIT, "source", "target", "mi")
    g = g.join(mi, [UNIT, "source", "target"], "left").withColumn("tau", tau.cast("int"))
    implied = -0.5 * F.log(F.greatest(F.lit(1e-12), 1 - F.col("r") ** 2))
    return g.withColumn("mi_ratio", F.col("mi") / F.nullif(implied, F.lit(0.0)))


def plan(least_te: int = 200, least_pcmci: int = 100) -> Column:
    """Array of methods, in order, three at most: what the rows allow; none under two horizons of rows."""
    t, tau = F.col("t"), F.col("tau")
    granger, pcmci = t >= 4 * tau, t >= F.greatest(8 * tau, F.lit(least_pcmci))
    te = pcmci & (F.col("missing") <= 0.35) & (t >= least_te)
    return F.when(t < 2 * tau, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(granger, F.lit("granger")), F.when(pcmci, F.lit("pcmci")), F.when(te, F.lit("transfer_entropy")))))


def kind() -> Column:
    return F.when(F.col("mi_ratio") < 1.03, "linear").when(F.col("mi_ratio") > 1.10, "nonlinear").otherwise("unclear")


def decide(df: DataFrame, pairs: Pairs, **options) -> DataFrame:
    return features(df, pairs, **options).withColumn("methods", plan()).withColumn("kind", kind())


def decide_and_run(df: DataFrame, cols: list[str], pairs: Pairs, alpha: float = 0.05) -> DataFrame:
    """Rows of all methods that suit at least one pair, for the pairs they suit."""
    chosen = decide(df, pairs).select(UNIT, "source", "target", F.explode("methods").alias("_m"))
    names = {r[0] for r in chosen.select("_m").distinct().collect()}
    out = None
    for name in sorted(names):
        if name == "granger":
            rows = discovery.granger(df, cols, pairs, alpha=alpha)
        elif name == "pcmci":
            rows = discovery.pcmci(df, cols, alpha=alpha).where("source <> target")
        else:
            te = discovery.te_discrete(df, pairs, list(range(1, 4)), bins=5)
            rows = te.select(UNIT, "source", "target", F.col("delay").alias("lag_steps"), F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("double").alias("q_value"), (F.col("te_bits") > 0.05).alias("is_significant"), F.col("te_bits").alias("effect_size"), F.lit("TransferEntropy").alias("method"))
        mine = chosen.where(F.col("_m") == name).drop("_m")
        rows = rows.join(mine, [UNIT, "source", "target"], "left_semi").select(UNIT, "method", "source", "target", F.col("lag_steps").cast("int").alias("lag_steps"), "p_value", "q_value", "is_significant", "effect_size")
        out = rows if out is None else out.unionByName(rows)
    return out
