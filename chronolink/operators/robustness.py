"""Checks around a result: whitened series, sensitivity to lags, seasons and resampling, reversed directions, rates of false
links, variants of a configuration, and effect tables. Pairs, lags, surrogates and resamples are columns of one plan."""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import first_by
from ..schema import IDX, UNIT
from . import discovery, kernels
from .correlation import Pairs, pearson, with_test
from .surrogates import surrogate_series
from .transforms import seasonal_terms


def prewhiten(df: DataFrame, col: str, order: int = 3) -> DataFrame:
    """unit_id, t_idx and the residual of col's autoregression of at most ``order`` lags (with intercept, complete rows)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        rows = np.column_stack([pdf[col].shift(k) for k in range(order + 1)])
        ok = np.isfinite(rows).all(1)
        y, x = rows[ok, 0], np.column_stack([np.ones(ok.sum()), rows[ok, 1:]])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0] if ok.any() else y
        return pd.DataFrame({UNIT: pdf[UNIT].to_numpy()[ok], IDX: pdf[IDX].to_numpy()[ok], col: e})

    d = df.select(UNIT, IDX, F.col(col).cast("double").alias(col))
    return d.groupBy(UNIT).applyInPandas(run, f"unit_id string, t_idx long, `{col}` double")


def lag_sensitivity(df: DataFrame, source: str, target: str, lags: list[int]) -> DataFrame:
    """Correlation of the pair and its p-value at every lag."""
    return with_test(pearson(df, [(source, target)], lags)).select(UNIT, "source", "target", "lag", "n", "r", "p_value")


def compare_strength(df: DataFrame, source: str, target: str, lag: int) -> DataFrame:
    """metric, value: correlation at the lag, partial R2 of the lag-1 test, and transfer entropy (bits) at the lag."""
    pair = [(source, target)]
    parts = [
        pearson(df, pair, [lag]).select(UNIT, F.lit("correlation").alias("metric"), F.abs("r").alias("value")),
        discovery.granger_l1(df, pair).select(UNIT, F.lit("granger").alias("metric"), F.col("partial_r2").alias("value")),
        discovery.te_discrete(df, pair, [lag]).select(UNIT, F.lit("transfer_entropy").alias("metric"), F.col("te_bits").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("source", F.lit(source)).withColumn("target", F.lit(target))


def seasonal_sensitivity(df: DataFrame, source: str, target: str, maxlag: int = 12, alpha: float = 0.05) -> DataFrame:
    """The test without and with seasonal terms as controls: whether both agree, and how far the lag moves."""
    take = lambda g, name: g.select(UNIT, F.col("p_value").alias(f"p_{name}"), F.col("lag_steps").alias(f"lag_{name}"), F.col("is_significant").alias(f"found_{name}"))
    plain = take(discovery.granger(df, [source, target], [(source, target)], maxlag, alpha), "plain")
    terms = ["sin_1", "cos_1", "sin_2", "cos_2"]
    seasonal = take(discovery.granger(seasonal_terms(df), [source, target, *terms], [(source, target)], maxlag, alpha), "seasonal")
    out = plain.join(seasonal, UNIT).withColumn("agreement", F.col("found_plain") == F.col("found_seasonal")).withColumn("lag_shift", F.abs(F.col("lag_plain") - F.col("lag_seasonal")))
    return out.withColumn("robust", F.coalesce(F.col("agreement") & (F.col("lag_shift") <= 2), F.lit(False)))


def reverse_directions(df: DataFrame, edges: Pairs, alpha: float = 0.05, tolerance: float = 0.03) -> DataFrame:
    """One row: how often the lag-1 test also finds the edges turned round, and whether that is near alpha."""
    g = discovery.granger_l1(df, [(t, s) for s, t in edges])
    rate = F.avg((F.col("p_value") < alpha).cast("double"))
    return g.agg(F.count("*").alias("n_tested"), rate.alias("rate")).withColumn("alpha", F.lit(alpha)).withColumn("ok", F.col("rate") <= alpha + tolerance)


def lag_interval(df: DataFrame, source: str, target: str, tau_max: int = 12, b: int = 100, level: float = 0.95, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the best lag by |correlation| over moving-block resamples (blocks of the root of the rows);
    nothing for a pair whose best lag is not significant."""
    rows = df.select(UNIT, IDX, F.col(source).cast("double").alias("x"), F.col(target).cast("double").alias("y"))
    tested = lag_sensitivity(df, source, target, list(range(1, tau_max + 1))).withColumn("_r", first_by([UNIT], [F.desc_nulls_last(F.abs("r")), "lag"])).where((F.col("_r") == 1) & (F.col("p_value") < alpha))
    copies = rows.join(tested.select(UNIT, F.col("lag").alias("best_lag")), UNIT).select("*", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        m = pdf[["x", "y"]].to_numpy()
        rng = np.random.default_rng(zlib.crc32(repr((seed, *key)).encode()))
        size = max(tau_max + 2, int(len(m) ** 0.5))
        sums = np.zeros((tau_max, 6))
        for a in rng.integers(0, max(1, len(m) - size), -(-len(m) // size)):
            part = m[a : a + size]
            for k in range(1, tau_max + 1):  # lags are taken within a block
                x, y = part[:-k, 0], part[k:, 1]
                ok = np.isfinite(x) & np.isfinite(y)
                x, y = x[ok], y[ok]
                sums[k - 1] += len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y
        n, sx, sy, xx, yy, xy = sums.T
        with np.errstate(all="ignore"):
            r = np.nan_to_num(np.abs((xy - sx * sy / n) / np.sqrt((xx - sx * sx / n) * (yy - sy * sy / n))))
        return pd.DataFrame([[key[0], int(pdf["best_lag"].iloc[0]), int(r.argmax()) + 1]])

    lags = copies.groupBy(UNIT, "b").applyInPandas(run, "unit_id string, best_lag int, lag int")
    tail = (1 - level) / 2
    return lags.groupBy(UNIT).agg(F.max("best_lag").alias("best_lag"), F.percentile("lag", F.lit(tail)).alias("ci_low"), F.percentile("lag", F.lit(1 - tail)).alias("ci_high"), F.count("*").alias("n_ok"))


def count_links(links: DataFrame, *keys: str) -> DataFrame:
    """Significant links per key; a variable's link to itself at lag 0 is none."""
    real = F.col("is_significant") & ~((F.col("source") == F.col("target")) & (F.col("lag_steps") == 0))
    return links.groupBy(*keys).agg(F.count_if(real).alias("n_links"))


def false_positive_rate(df: DataFrame, cols: list[str], kinds: tuple[str, ...] = ("shuffle", "phase"), b: int = 20, tau_max: int = 2, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Per kind of surrogate: links found on average, and their share of all that could be."""
    possible = len(cols) ** 2 * (tau_max + 1) - len(cols)
    parts = None
    for kind in kinds:  # a few kinds, each one plan
        wide = surrogate_series(df, cols, kind, b, seed).groupBy(UNIT, "b", IDX).pivot("variable", cols).agg(F.first("value"))
        one = count_links(discovery.pcmci(wide, cols, tau_max, alpha, False, keys=("b",)), UNIT, "b").withColumn("kind", F.lit(kind))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("kind").agg(F.avg("n_links").alias("mean_links"), (F.avg("n_links") / possible).alias("false_positive_rate"), F.percentile("n_links", F.lit(0.95)).alias("p95_links"))


def bootstrap_mean(df: DataFrame, value: str, b: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Per unit: the mean of value, and the percentile interval of means of rows drawn with replacement (by a hash of draw and place)."""
    d = df.where(F.col(value).isNotNull()).select(UNIT, F.col(value).cast("double").alias("v"), (F.row_number().over(Window.partitionBy(UNIT).orderBy(IDX)) - 1).alias("i"))
    n = d.groupBy(UNIT).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    draws = n.select(UNIT, "n", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b")).select(UNIT, "n", "b", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    draws = draws.select(UNIT, "b", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "b", "k")), 1, 8), 16, 10).cast("long"), F.col("n")).cast("int").alias("i"))
    means = draws.join(d, [UNIT, "i"]).groupBy(UNIT, "b").agg(F.avg("v").alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(UNIT).agg(F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1 - tail)).alias("ci_high")).join(n, UNIT).select(UNIT, "n", "mean", "ci_low", "ci_high")


def variants(base: dict, dimensions: dict[str, list]) -> list[dict]:
    """Configurations that change one setting, then all at once, then two at a time until there are six."""
    change = lambda **new: base | new
    out = [change(**{k: v}) for k, vs in dimensions.items() for v in vs if v != base.get(k)]
    if dimensions:
        out.append(change(**{k: vs[-1] for k, vs in dimensions.items()}))
    for a, c in combinations(dimensions, 2):
        if len(out) >= 6:
            break
        out.append(change(**{a: dimensions[a][0], c: dimensions[c][-1]}))
    return [v for k, v in enumerate(out) if v not in out[:k]]


def effects(links: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """Significant links as (source, target, lag_steps, effect, link_category), with resampled intervals where given."""
    key = [c for c in (UNIT,) if c in links.columns] + ["source", "target", "lag_steps"]
    out = links.where("is_significant").select(*key, F.abs("statistic").alias("effect"), "link_category")
    return out if frequency is None else out.join(frequency.select(*[c for c in key if c in frequency.columns], "ci_low", "ci_high", "frequency"), [c for c in key if c in frequency.columns], "left")


def drivers(edges: DataFrame, target: str, effect: str = "effect_size", exclude_self: bool = True) -> DataFrame:
    """Edges into the target, the strongest first, with their rank."""
    e = edges.where(F.col("target") == target)
    e = e.where("source <> target") if exclude_self else e
    return e.withColumn("rank", first_by(["target"], [F.desc_nulls_last(effect), "source", "lag_steps"]))


def surrogate_counts_exceeded(observed: int, rates: DataFrame) -> DataFrame:
    """Whether the observed number of links lies over the 95th percentile of the surrogates'."""
    return rates.withColumn("observed", F.lit(observed)).withColumn("separated", F.lit(observed) > F.col("p95_links"))


def simulate(n: int = 300, persistence: float = 0.3, effect: float = 0.6, seed: int = 0, burn: int = 200) -> np.ndarray:
    """source and target of a two-variable autoregression with the effect at lag 1: n rows after the burn-in."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n + burn, 2))
    for t in range(1, len(x)):
        e = rng.normal(size=2)
        x[t] = persistence * x[t - 1, 0] + e[0], persistence * x[t - 1, 1] + effect * x[t - 1, 0] + e[1]
    return x[burn:]


def surrogate_pass_rate(runs: int, persistence: float, effect: float, kind: str = "iaaft", b: int = 99, alpha: float = 0.05) -> float:
    """Share of simulated series whose lag-1 test is passed by the data and by few enough surrogates (controls for tests)."""
    from .surrogates import KINDS

    passed = 0
    for seed in range(runs):
        x, y = simulate(300, persistence, effect, seed).T
        rng = np.random.default_rng(seed)
        p = kernels.granger_f(x, y, 1)[1]
        k = sum(kernels.granger_f(KINDS[kind](x, rng), y, 1)[1] <= p for _ in range(b))
        passed += p < alpha and (1 + k) / (1 + b) < alpha
    return passed / runs
