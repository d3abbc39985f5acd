"""Falsification by surrogates, resampling and negative controls: resamples are group keys, so all of them run at once."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import IDX, UNIT
from . import kernels
from .correlation import Pairs
from .fdr import monte_carlo_p

KINDS = {"block_permutation": lambda x, rng: kernels.blocks(x, rng, max(10, 2 * min(20, len(x) // 10))), "iaaft": kernels.iaaft, "phase": kernels.phase, "shuffle": lambda x, rng: rng.permutation(x)}


def surrogate_series(df: DataFrame, cols: list[str], kind: str, b: int, seed: int = 42) -> DataFrame:
    """unit_id, b, variable, t_idx, value of b surrogates of every series."""
    from ..schema import to_long

    long = to_long(df.select(UNIT, IDX, *cols), cols).where("value is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        rng = np.random.default_rng(zlib.crc32(repr((seed, kind, *key)).encode()))
        return pd.DataFrame({UNIT: key[0], "b": key[2], "variable": key[1], IDX: pdf[IDX], "value": KINDS[kind](pdf["value"].to_numpy(float), rng)})

    return long.groupBy(UNIT, "variable", "b").applyInPandas(run, "unit_id string, b int, variable string, t_idx long, value double")


def falsify(df: DataFrame, edges: list[tuple[str, str, int]], kinds: tuple[str, ...] = ("block_permutation", "iaaft"), b: int = 99, alpha: float = 0.05, seed: int = 42, per_group: int = 25) -> DataFrame:
    """Per unit, edge and kind: the F test's p, the share of surrogate sources with as small a p, and whether both are under
    alpha. Surrogates are dealt to groups of ``per_group``."""
    cells = [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(lag).alias("lag_steps"), F.col(s).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for s, t, lag in edges]
    rows, parts = df.select(UNIT, IDX, F.inline(F.array(*cells))), -(-b // per_group)
    rows = rows.where("x is not null and y is not null").select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        x, y, (unit, s, t, lag, kind, part) = pdf["x"].to_numpy(), pdf["y"].to_numpy(), key
        rng = np.random.default_rng(zlib.crc32(repr((seed, *key)).encode()))
        p = kernels.granger_f(x, y, lag)[1]
        n = min(per_group, b - part * per_group)
        other = [kernels.granger_f(KINDS[kind](x, rng), y, lag)[1] for _ in range(n)]
        return pd.DataFrame([[unit, s, t, lag, kind, p, n, sum(o <= p for o in other)]])

    got = rows.groupBy(UNIT, "source", "target", "lag_steps", "kind", "part").applyInPandas(run, "unit_id string, source string, target string, lag_steps int, kind string, p double, n long, k long")
    g = got.groupBy(UNIT, "source", "target", "lag_steps", "kind").agg(F.max("p").alias("original_p"), ((1 + F.sum("k")) / (1 + F.sum("n"))).alias("empirical_p"))
    return g.withColumn("passed", (F.col("original_p") < alpha) & (F.col("empirical_p") < alpha))


def summarize(tests: DataFrame) -> DataFrame:
    return tests.groupBy(*[c for c in (UNIT,) if c in tests.columns], "source", "target", "lag_steps").agg(F.count_if("passed").cast("int").alias("falsification_passed"), F.count("*").cast("int").alias("falsification_total"))


def surrogate_test(df: DataFrame, source: str, target: str, lag: int, b: int = 99, kind: str = "phase", seed: int = 42) -> DataFrame:
    """|correlation| of the lagged pair against surrogate sources, with the Monte-Carlo p."""
    sur = surrogate_series(df, [source], kind, b, seed).select(UNIT, (F.col(IDX) + lag).alias(IDX), F.col("value").alias("x"), "b")
    real = df.select(UNIT, (F.col(IDX) + lag).alias(IDX), F.col(source).alias("x"), F.lit(0).alias("b"))
    r = sur.unionByName(real).join(df.select(UNIT, IDX, F.col(target).alias("y")), [UNIT, IDX]).groupBy(UNIT, "b").agg(F.abs(F.corr("x", "y")).alias("r"))
    obs = r.where("b = 0").select(UNIT, F.col("r").alias("effect"))
    return r.where("b > 0").join(obs, UNIT).groupBy(UNIT).agg(F.max("effect").alias("effect"), F.avg("r").alias("surrogate_mean"), monte_carlo_p(F.col("effect"), F.col("r")).alias("p_value"))


def block_bootstrap(df: DataFrame, source: str, target: str, lag: int, b: int = 100, size: int = 50, seed: int = 42) -> DataFrame:
    """Slope of the lagged pair over blocks drawn with replacement (by a hash of copy and place): mean and 95 % interval."""
    from pyspark.sql import Window

    from ..functions.stats import by_time

    rows = df.select(UNIT, IDX, F.lag(source, lag).over(by_time()).alias("x"), F.col(target).alias("y")).where("x is not null and y is not null")
    rows = rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(UNIT).orderBy(IDX)) - 1) / size))
    sums = rows.groupBy(UNIT, "block").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    n = sums.groupBy(UNIT).agg(F.count("*").alias("k"))
    draws = n.select(UNIT, "k", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b")).select(UNIT, "k", "b", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("i"))
    draws = draws.select(UNIT, "b", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "b", "i")), 1, 8), 16, 10).cast("long"), F.col("k")).alias("block"))
    g = draws.join(sums, [UNIT, "block"]).groupBy(UNIT, "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.nullif(F.col("xx") - F.col("x") ** 2 / F.col("n"), F.lit(0.0))
    return g.select(UNIT, slope.alias("s")).groupBy(UNIT).agg(F.count("s").alias("n_ok"), F.avg("s").alias("mean"), F.percentile("s", F.lit(0.025)).alias("ci_low"), F.percentile("s", F.lit(0.975)).alias("ci_high"))


def negative_control(df: DataFrame, pairs: Pairs, b: int = 50, lag: int = 1, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Detection rate of the F test with permuted sources: should lie near alpha."""
    tests = df.select(UNIT, IDX, F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.col(s).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for s, t in pairs])))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        rng = np.random.default_rng(zlib.crc32(repr((seed, *key)).encode()))
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        return pd.DataFrame([[*key, np.mean([kernels.granger_f(kernels.blocks(x, rng), y, lag)[1] < alpha for _ in range(b)])]])

    got = tests.where("x is not null and y is not null").groupBy(UNIT, "source", "target").applyInPandas(run, "unit_id string, source string, target string, rate double")
    return got.agg(F.avg("rate").alias("false_positive_rate")).withColumn("alpha", F.lit(alpha))


def bootstrap_links(df: DataFrame, cols: list[str], b: int = 20, tau_max: int = 3, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Link frequencies over moving-block resamples of each unit's rows."""
    from .stability import link_frequency

    copies = df.na.drop(subset=cols).select(UNIT, IDX, *cols, F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(IDX)[cols].to_numpy(float)
        rng = np.random.default_rng(zlib.crc32(repr((seed, *key)).encode()))
        size = max(tau_max * 10, 30)
        starts = rng.integers(0, max(1, len(x) - size), -(-len(x) // size))
        y = np.concatenate([x[a : a + size] for a in starts])[: len(x)]
        got = [(cols[i], cols[j], k, abs(v)) for i, j, k, v, p, q, d in kernels.pcmci(y, tau_max, alpha, False) if q < alpha]
        out = pd.DataFrame(got, columns=["source", "target", "lag_steps", "strength"])
        out.insert(0, "b", key[1])
        out.insert(0, UNIT, key[0])
        return out

    return link_frequency(copies.groupBy(UNIT, "b").applyInPandas(run, "unit_id string, b int, source string, target string, lag_steps int, strength double"), b)
