"""Series to series. Wide frames with unit_id and t_idx; every window is partitioned by unit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import by_time
from ..schema import IDX, TS, UNIT


def _each(df: DataFrame, cols: list[str], make) -> DataFrame:
    return df.select(*[make(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, cols: list[str], limit: int | None = None, edges: bool = True) -> DataFrame:
    """Linear by row position; the ends take the nearest value (leading ones stay null without ``edges``). With ``limit``
    at most so many cells in a row are filled from either side."""
    before, after = by_time().rowsBetween(Window.unboundedPreceding, 0), by_time().rowsBetween(0, Window.unboundedFollowing)

    def fill(c: str) -> Column:
        v, at = F.col(c), F.when(F.col(c).isNotNull(), F.col(IDX))
        v0, t0, v1, t1 = F.last(v, True).over(before), F.last(at, True).over(before), F.first(v, True).over(after), F.first(at, True).over(after)
        line = F.coalesce(v, v0 + (v1 - v0) * (F.col(IDX) - t0) / (t1 - t0), v0, v1 if edges else F.lit(None))
        if limit is None:
            return line
        near = (F.col(IDX) - t0 <= limit) | (t1 - F.col(IDX) <= limit)
        return F.when(v.isNotNull() | near, line)

    return _each(df, cols, fill)


def difference(df: DataFrame, cols: list[str], order: int = 1) -> DataFrame:
    """order-fold first differences; rows with a null go."""
    for _ in range(order):
        df = _each(df, cols, lambda c: F.col(c) - F.lag(c).over(by_time())).na.drop(subset=cols)
    return df


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population z-scores; a constant column becomes 0."""
    w = Window.partitionBy(UNIT)
    return _each(df, cols, lambda c: (F.col(c) - F.avg(c).over(w)) / F.coalesce(F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(1.0)))


def rolling_anomaly(df: DataFrame, col: str, window: int | None = None) -> DataFrame:
    """Values less their centred moving mean over known values; window min(365, max(7, n // 3)), odd."""
    known = df.where(F.col(col).isNotNull())
    if window is None:
        n = known.groupBy(UNIT).count().agg(F.max("count")).first()[0] or 0
        window = min(365, max(7, n // 3))
    half = (window + (window % 2 == 0)) // 2
    return known.withColumn(col, F.col(col) - F.avg(col).over(by_time().rowsBetween(-half, half)))


def seasonal_terms(df: DataFrame, period: int = 365, harmonics: int = 2) -> DataFrame:
    angle = lambda k: F.lit(2 * math.pi * k / period) * F.dayofyear(TS)
    return df.select("*", *[f(angle(k)).alias(f"{name}_{k}") for k in range(1, harmonics + 1) for name, f in (("sin", F.sin), ("cos", F.cos))])


def seasonal_detrend(df: DataFrame, col: str, period: int) -> DataFrame:
    """Classical additive decomposition: the residual after a centred moving mean and seasonal means."""
    half = period // 2
    w = by_time().rowsBetween(-half, half if period % 2 else half - 1)
    d = df.withColumn("_d", F.when(F.count(col).over(w) >= period, F.col(col) - F.avg(col).over(w))).withColumn("_s", F.pmod(IDX, F.lit(period)))
    d = d.withColumn("_m", F.avg("_d").over(Window.partitionBy(UNIT, "_s")))
    return d.withColumn(col, F.col("_d") - F.col("_m")).where("_d is not null").drop("_d", "_s", "_m")


def resample(df: DataFrame, cols: list[str], width: str = "6 hours") -> DataFrame:
    """Tumbling means; buckets without any value go."""
    out = df.groupBy(UNIT, F.window(TS, width).alias("_w")).agg(*[F.avg(c).alias(c) for c in cols])
    return out.select(UNIT, F.col("_w.start").cast("timestamp_ntz").alias(TS), *cols).na.drop("all", subset=cols)


def lag_embed(df: DataFrame, lags: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """keep columns and {variable}_lag_{k}; one window serves all of them."""
    return df.select(UNIT, IDX, *keep, *[F.lag(v, k).over(by_time()).alias(f"{v}_lag_{k}") for v, ks in lags.items() for k in ks])


def discretize(df: DataFrame, cols: list[str], bins: int = 5, method: str = "quantile") -> DataFrame:
    """Codes from 0: between quantiles (linear, repeated edges once, right-closed), or of equal width. The edges are one
    aggregation, joined back by unit."""
    qs = [k / bins for k in range(bins + 1)]
    if method == "quantile":
        edges = df.groupBy(UNIT).agg(*[F.array_distinct(F.percentile(c, F.array(*map(F.lit, qs)))).alias(f"_{c}") for c in cols])
        code = lambda c: F.greatest(F.size(F.filter(f"_{c}", lambda e: e < F.col(c))) - 1, F.lit(0))
    else:
        edges = df.groupBy(UNIT).agg(*[F.array(F.min(c), F.max(c)).alias(f"_{c}") for c in cols])
        code = lambda c: F.greatest(F.least(F.ceil((F.col(c) - F.col(f"_{c}")[0]) * bins / F.nullif(F.col(f"_{c}")[1] - F.col(f"_{c}")[0], F.lit(0.0))) - 1, F.lit(bins - 1)), F.lit(0))
    out = df.join(edges, UNIT)  # a row a unit: Spark broadcasts it where it is small
    return _each(out, cols, lambda c: F.when(F.col(c).isNotNull(), code(c)).cast("int")).drop(*[f"_{c}" for c in cols])


def season_label_swap(df: DataFrame, seed: int = 0) -> DataFrame:
    """month and doy with permuted copies: months over all rows, days within months, in order of a hash."""
    d = df.withColumn("month", F.month(TS)).withColumn("doy", F.dayofyear(TS))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(IDX).cast("string")))
    for col, by in (("month", [UNIT]), ("doy", [UNIT, "month"])):
        w = Window.partitionBy(*by)
        to = d.select(*by, F.row_number().over(w.orderBy(IDX)).alias("_r"), IDX)
        src = d.select(*by, F.row_number().over(w.orderBy(key)).alias("_r"), F.col(col).alias(f"{col}_shuffled"))
        d = d.join(to.join(src, [*by, "_r"]).drop("_r", *[b for b in by if b != UNIT]), [UNIT, IDX])
    return d


def per_series(df: DataFrame, cols: list[str], function, schema: str) -> DataFrame:
    """Run ``function`` (one series of values in time order to a frame) for every unit and variable, in one grouped plan."""
    from ..schema import to_long

    long = to_long(df.select(UNIT, IDX, *cols), cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        out = function(pdf["value"].to_numpy(float), pdf[IDX].to_numpy())
        out.insert(0, "variable", pdf["variable"].iloc[0])
        out.insert(0, UNIT, pdf[UNIT].iloc[0])
        return out

    return long.groupBy(UNIT, "variable").applyInPandas(run, f"{UNIT} string, variable string, {schema}")


def hp_cycle(y: np.ndarray, lam: float = 1600.0) -> np.ndarray:
    """What the Hodrick-Prescott trend leaves."""
    n = len(y)
    if n < 4:
        return y - y.mean() if n else y
    k = np.zeros((n - 2, n))
    i = np.arange(n - 2)
    k[i, i], k[i, i + 1], k[i, i + 2] = 1, -2, 1
    return y - np.linalg.solve(np.eye(n) + lam * k.T @ k, y)


def hp_filter(df: DataFrame, cols: list[str], lam: float = 1600.0) -> DataFrame:
    return per_series(df.na.drop(subset=cols), cols, lambda v, t: pd.DataFrame({IDX: t, "value": hp_cycle(v, lam)}), f"{IDX} long, value double")


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Local linear regression with tricube weights over the ``span`` nearest points."""
    span = min(span, len(x))
    out = np.empty(len(at))
    for k, a in enumerate(at):
        d = np.abs(x - a)
        h = max(np.partition(d, span - 1)[span - 1], 1e-12)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        sw, mx = w.sum(), (w * x).sum() / w.sum()
        sxx = (w * (x - mx) ** 2).sum()
        my = (w * y).sum() / sw
        out[k] = my + ((w * (x - mx) * y).sum() / sxx * (a - mx) if sxx > 1e-12 else 0)
    return out


def stl_deseason(y: np.ndarray, period: int, seasonal: int = 13, rounds: int = 2) -> np.ndarray:
    """Trend and remainder of a seasonal-trend decomposition by loess; series under two periods stay."""
    n = len(y)
    if n < 2 * period or period < 2:
        return y
    trend, season, x = np.zeros(n), np.zeros(n), np.arange(n, dtype=float)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    for _ in range(rounds):
        rest = y - trend
        cycle = np.empty(n)
        for p in range(period):
            i = np.arange(p, n, period)
            cycle[i] = loess(i.astype(float), rest[i], i.astype(float), seasonal)
        low = np.convolve(np.pad(cycle, period, mode="edge"), np.ones(period) / period, "same")[period:-period]
        season = cycle - low
        trend = loess(x, y - season, x, span)
    return y - season


def deseasonalise(df: DataFrame, cols: list[str], period: int, seasonal: int = 13) -> DataFrame:
    return per_series(df.na.drop(subset=cols), cols, lambda v, t: pd.DataFrame({IDX: t, "value": stl_deseason(v, period, seasonal)}), f"{IDX} long, value double")


def _spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline; constant beyond the ends."""
    n = len(t)
    if n < 3:
        return np.interp(at, t, y)
    h = np.diff(t)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(t, at) - 1, 0, n - 2)
    u, v = t[k + 1] - at, at - t[k]
    out = (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v
    return np.where(at < t[0], y[0], np.where(at > t[-1], y[-1], out))


def _gaussian_process(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Posterior mean under a squared exponential plus white kernel, its scales picked by marginal likelihood on a grid."""
    m, s = y.mean(), y.std() or 1.0
    z, best = (y - m) / s, None
    for length in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        for noise in (0.01, 0.1, 0.5):
            k = np.exp(-0.5 * ((t[:, None] - t[None, :]) / length) ** 2) + noise * np.eye(len(t))
            chol = np.linalg.cholesky(k)
            a = np.linalg.solve(chol.T, np.linalg.solve(chol, z))
            like = -0.5 * z @ a - np.log(np.diag(chol)).sum()
            if best is None or like > best[0]:
                best = (like, length, a)
    return m + s * np.exp(-0.5 * ((at[:, None] - t[None, :]) / best[1]) ** 2) @ best[2]


def fill(df: DataFrame, cols: list[str], method: str = "linear", max_missing: float = 0.2) -> DataFrame:
    """Fill nulls: linear in SQL; spline, or gp (linear beyond ``max_missing``), per series."""
    if method == "linear":
        return interpolate(df, cols)

    def one(v: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        ok = ~np.isnan(v)
        out = v.copy()
        if ok.any() and not ok.all():
            x, y, at = t[ok].astype(float), v[ok], t[~ok].astype(float)
            out[~ok] = _spline(x, y, at) if method == "spline" else _gaussian_process(x, y, at) if (~ok).mean() <= max_missing else np.interp(at, x, y)
        return pd.DataFrame({IDX: t, "value": out})

    return per_series(df, cols, one, f"{IDX} long, value double")
