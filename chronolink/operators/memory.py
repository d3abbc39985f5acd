"""Memory of series: autocorrelation, lag horizons, stationarity and assumption tests."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import by_time, corr
from ..functions.tails import chi2_upper, f_upper, normal_cdf
from ..schema import IDX, UNIT
from .correlation import pair_rows
from .transforms import per_series


def acf(df: DataFrame, cols: list[str], max_lag: int) -> DataFrame:
    """unit_id, variable, lag, n, acf (biased) for lags 1..max_lag, in one aggregation."""
    w = Window.partitionBy(UNIT)
    centred = df.select(UNIT, IDX, *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in cols])
    rows = pair_rows(centred, [(c, c) for c in cols], list(range(max_lag + 1)))
    cov = rows.groupBy(UNIT, F.col("source").alias("variable"), "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.count("y").alias("n"))
    zero = cov.where("lag = 0").select(UNIT, "variable", F.col("s").alias("s0"))
    return cov.where("lag > 0").join(zero, [UNIT, "variable"]).select(UNIT, "variable", "lag", "n", (F.col("s") / F.nullif(F.col("s0"), F.lit(0.0))).alias("acf"))


def acf_zero_crossing(df: DataFrame, cols: list[str], confidence: float = 0.95, least: int = 1, max_search: int = 100) -> DataFrame:
    """The first lag whose |acf| is within the noise band; the last lag looked at if none is; ``least`` under 50 rows."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    a = acf(df, cols, max_search).where(F.col("lag") <= F.floor(F.col("n") / 4))
    g = a.groupBy(UNIT, "variable").agg(F.max("n").alias("n"), F.min(F.when((F.abs("acf") <= z / F.sqrt("n")) & (F.col("lag") >= least), F.col("lag"))).alias("hit"), F.max("lag").alias("last"))
    return g.select(UNIT, "variable", "n", F.when(F.col("n") < 50, least).otherwise(F.coalesce("hit", "last")).alias("tau_max"))


def nyquist_domain(n: int, domain_days: float, interval_days: float, safety: float = 3.0) -> tuple[int, str]:
    a, b = math.floor(domain_days / interval_days), math.floor(n / safety)
    return max(1, min(a, b)), "domain" if a <= b else "nyquist"


def tau_scientific(df: DataFrame, cols: list[str], interval_days: float = 5, domain_days: float = 90, confidence: float = 0.95, safety: float = 3.0) -> DataFrame:
    """The least of the acf crossing, the domain's horizon and the sample's; and which of them binds."""
    a = acf_zero_crossing(df, cols, confidence)
    domain, sample = F.lit(math.floor(domain_days / interval_days)), F.floor(F.col("n") / safety).cast("int")
    tau = F.greatest(F.lit(1), F.least(F.col("tau_max"), domain, sample))
    binding = F.when(F.col("tau_max") <= F.least(domain, sample), "acf").when(domain <= sample, "domain").otherwise("nyquist")
    return a.select(UNIT, "variable", tau.cast("int").alias("tau_max"), binding.alias("binding"))


def auto_tau(t: int, sampling_days: float, window_days: float = 30, cap: int = 12) -> int:
    return max(1, min(math.ceil(window_days / sampling_days), t // 8, cap))


def suggest_max_lag(df: DataFrame, cols: list[str], interval_days: float = 5, max_days: float = 90, threshold: float = 0.1) -> DataFrame:
    """min(max_days / interval, 18), less where |acf| falls under the threshold sooner."""
    base = min(math.floor(max_days / interval_days), 18)
    a = acf(df, cols, 40).groupBy(UNIT, "variable").agg(F.max("n").alias("n"), F.min(F.when(F.abs("acf") < threshold, F.col("lag"))).alias("hit"))
    return a.select(UNIT, "variable", F.when(F.col("n") >= 49, F.least(F.lit(base), F.coalesce("hit", F.lit(base)))).otherwise(base).cast("int").alias("max_lag"))


def binned_information(df: DataFrame, pairs: list[tuple[str, str]], lags: list[int], bins: int = 10) -> DataFrame:
    """unit_id, source, target, lag, mi (nats) of equal-width bins; the marginals come from the joint counts' grouping sets."""
    key = [UNIT, "source", "target", "lag"]
    rows = pair_rows(df, pairs, lags).where("x is not null and y is not null")
    w = Window.partitionBy(*key)
    cell = lambda c: F.least(F.floor((F.col(c) - F.min(c).over(w)) * bins / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    coded = rows.select(*key, F.coalesce(cell("x"), F.lit(0)).alias("x"), F.coalesce(cell("y"), F.lit(0)).alias("y"))
    counts = coded.groupBy(*key, "x", "y").agg(F.count("*").alias("c"))
    total = lambda *by: F.sum("c").over(Window.partitionBy(*key, *by))
    parts = counts.select(*key, "c", total().alias("n"), total("x").alias("cx"), total("y").alias("cy"))
    return parts.groupBy(*key).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))


def mi_decay(df: DataFrame, x: str, y: str, fraction: float = 0.1, max_search: int = 50, bins: int = 10) -> DataFrame:
    """The first lag whose information is under a fraction of the largest."""
    m = binned_information(df, [(x, y)], list(range(1, max_search + 1)), bins)
    w = Window.partitionBy(UNIT)
    m = m.withColumn("top", F.max("mi").over(w))
    return m.groupBy(UNIT).agg(F.coalesce(F.min(F.when(F.col("mi") < fraction * F.col("top"), F.col("lag"))), F.max("lag")).alias("tau_max"))


def mi_first_minimum(df: DataFrame, y: str, max_search: int = 50, bins: int = 10) -> DataFrame:
    """Twice the first interior local minimum of y's information about itself, else the last lag."""
    m, w = binned_information(df, [(y, y)], list(range(1, max_search + 1)), bins), Window.partitionBy(UNIT).orderBy("lag")
    m = m.withColumn("low", (F.col("mi") < F.lag("mi").over(w)) & (F.col("mi") < F.lead("mi").over(w)))
    return m.groupBy(UNIT).agg(F.coalesce(2 * F.min(F.when(F.col("low"), F.col("lag"))), F.max("lag")).alias("tau_max"))


def pacf(a: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations 1.., by Durbin-Levinson."""
    phi, out = np.zeros(0), []
    for k in range(len(a)):
        den = 1 - phi @ a[:k]
        last = (a[k] - phi @ a[:k][::-1]) / den if abs(den) > 1e-12 else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.array(out)


def pacf_cutoff(df: DataFrame, cols: list[str], confidence: float = 0.95, max_search: int = 50) -> DataFrame:
    """The last lag whose partial autocorrelation leaves the noise band, 1 if none."""
    z, a = NormalDist().inv_cdf((1 + confidence) / 2), acf(df, cols, max_search)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        n = int(pdf["n"].max()) + 1
        p = pacf(pdf["acf"].to_numpy()[: max(1, min(max_search, n // 4 - 1))])
        hit = np.flatnonzero(np.abs(p) > z / np.sqrt(n))
        return pd.DataFrame({UNIT: [pdf[UNIT].iloc[0]], "variable": [pdf["variable"].iloc[0]], "tau_max": [int(hit[-1]) + 1 if len(hit) else 1]})

    return a.groupBy(UNIT, "variable").applyInPandas(run, "unit_id string, variable string, tau_max int")


def ar_order(y: np.ndarray, most: int, criterion: str = "bic") -> int:
    """Order of the autoregression with the least criterion, each order on its own rows."""
    best = (np.inf, 1)
    for p in range(1, most + 1):
        t = y[p:]
        x = np.column_stack([np.ones(len(t)), *(y[p - k : len(y) - k] for k in range(1, p + 1))])
        if len(t) <= x.shape[1]:
            break
        rss = ((t - x @ np.linalg.lstsq(x, t, rcond=None)[0]) ** 2).sum()
        ic = len(t) * np.log(max(rss, 1e-300) / len(t)) + (p + 2) * (2 if criterion == "aic" else np.log(len(t)))
        best = min(best, (ic, p))
    return best[1]


def tau_information_criterion(df: DataFrame, cols: list[str], criterion: str = "bic", max_search: int = 30) -> DataFrame:
    f = lambda v, t: pd.DataFrame({"tau_max": [1 if len(v) < 100 else ar_order(v, min(max_search, len(v) // 3), criterion)]})
    return per_series(df.na.drop(subset=cols), cols, f, "tau_max int")


def tau_ensemble(df: DataFrame, cols: list[str], interval_days: float = 5, domain_days: float = 90, aggregation: str = "median") -> DataFrame:
    """median, mean, max or min of the acf, pacf, information-criterion and domain horizons."""
    rows = acf_zero_crossing(df, cols).select(UNIT, "variable", "tau_max")
    rows = rows.unionByName(pacf_cutoff(df, cols)).unionByName(tau_information_criterion(df, cols, "aic"))
    dom = acf_zero_crossing(df, cols).select(UNIT, "variable", F.greatest(F.lit(1), F.least(F.lit(math.floor(domain_days / interval_days)), F.floor(F.col("n") / 3).cast("int"))).alias("tau_max"))
    agg = {"median": F.median, "mean": F.avg, "max": F.max, "min": F.min}[aggregation]
    return rows.unionByName(dom).groupBy(UNIT, "variable").agg(agg("tau_max").cast("int").alias("tau_max"))


def recommend_tau(df: DataFrame, cols: list[str], method: str = "auto", interval_days: float = 5, domain_days: float = 90) -> DataFrame:
    """unit_id, variable, tau_max by the named rule."""
    if method in ("auto", "scientific"):
        return tau_scientific(df, cols, interval_days, domain_days).drop("binding")
    if method == "acf_zero":
        return acf_zero_crossing(df, cols).drop("n")
    if method == "pacf_cutoff":
        return pacf_cutoff(df, cols)
    if method == "aic_bic":
        return tau_information_criterion(df, cols)
    if method == "ensemble":
        return tau_ensemble(df, cols, interval_days, domain_days)
    if method in ("mi_decay", "first_mi_min"):
        out = None
        for c in cols:
            one = (mi_first_minimum(df, c) if method == "first_mi_min" else mi_decay(df, c, c)).withColumn("variable", F.lit(c))
            out = one if out is None else out.unionByName(one)
        return out
    if method == "nyquist_domain":
        n = acf_zero_crossing(df, cols)
        return n.select(UNIT, "variable", F.greatest(F.lit(1), F.least(F.lit(math.floor(domain_days / interval_days)), F.floor(F.col("n") / 3).cast("int"))).alias("tau_max"))
    if method == "scientific_ensemble":
        both = tau_scientific(df, cols, interval_days, domain_days).drop("binding").unionByName(tau_ensemble(df, cols, interval_days, domain_days))
        return both.groupBy(UNIT, "variable").agg(F.min("tau_max").alias("tau_max"))
    raise ValueError(f"unknown method: {method}")


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, e, float(e @ e)


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags) of the augmented Dickey-Fuller test with a constant; lags by AIC on one common sample."""
    n = len(y)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3))
    d = np.diff(y)

    def design(k: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(start, len(d))
        return np.column_stack([y[t], np.ones(len(t)), *(d[t - j] for j in range(1, k + 1))]), d[t]

    best = (np.inf, 0)
    for k in range(most + 1):
        x, t = design(k, most)
        best = min(best, (len(t) * np.log(max(_ols(x, t)[2], 1e-300) / len(t)) + 2 * x.shape[1], k))
    x, t = design(best[1], best[1])
    b, _, rss = _ols(x, t)
    s2 = rss / (len(t) - x.shape[1])
    stat = b[0] / math.sqrt(s2 * np.linalg.pinv(x.T @ x)[0, 0])
    phi = NormalDist().cdf
    # The published response surface of the p-value (constant, one variable).
    low, high = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    p = 0.0 if stat <= -18.83 else 1.0 if stat >= 2.74 else phi(sum(c * stat**i for i, c in enumerate(low if stat <= -1.61 else high)))
    return float(stat), float(p), best[1]


def kpss(y: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of the level-stationarity test with an automatic bandwidth; p lies within its table's ends."""
    n = len(y)
    e = y - y.mean()
    s = np.cumsum(e)
    cov = lambda k: float(e[k:] @ e[: n - k]) / n
    m = int(n ** (2 / 9))
    s0, s1 = cov(0) + 2 * sum(cov(k) for k in range(1, m + 1)), 2 * sum(k * cov(k) for k in range(1, m + 1))
    width = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
    lrv = cov(0) + 2 * sum((1 - k / (width + 1)) * cov(k) for k in range(1, width + 1))
    stat = float((s**2).sum() / n**2 / lrv) if lrv > 0 else 0.0
    return stat, float(np.interp(stat, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))


def stationarity(df: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """ADF and KPSS of every unit and variable; stationary: both agree (series under 20 rows count as stationary)."""

    def one(v: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        v = v[~np.isnan(v)]
        if len(v) < 20 or v.std() == 0:
            return pd.DataFrame({"adf": [None], "adf_p": [None], "kpss": [None], "kpss_p": [None], "stationary": [len(v) < 20]})
        a, b = adf(v), kpss(v)
        return pd.DataFrame({"adf": [a[0]], "adf_p": [a[1]], "kpss": [b[0]], "kpss_p": [b[1]], "stationary": [a[1] < alpha and b[1] > alpha]})

    return per_series(df, cols, one, "adf double, adf_p double, kpss double, kpss_p double, stationary boolean")


def jarque_bera(df: DataFrame, cols: list[str]) -> DataFrame:
    """From central moments: statistic and p (two degrees of freedom)."""
    from ..schema import to_long

    long, w = to_long(df.select(UNIT, *cols), cols).where("value is not null"), Window.partitionBy(UNIT, "variable")
    d = long.withColumn("d", F.col("value") - F.avg("value").over(w))
    m = d.groupBy(UNIT, "variable").agg(F.count("*").alias("n"), *[F.avg(F.pow("d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    s, k = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / F.pow("m2", F.lit(2.0)) - 3
    out = m.where("m2 > 0").select(UNIT, "variable", "n", s.alias("skewness"), k.alias("excess_kurtosis"), (F.col("n") / 6 * (s * s + k * k / 4)).alias("jb"))
    return out.withColumn("p_value", F.exp(-F.col("jb") / 2))


def durbin_watson(df: DataFrame, cols: list[str]) -> DataFrame:
    from ..schema import to_long

    long = to_long(df.select(UNIT, IDX, *cols), cols).where("value is not null")
    step = long.withColumn("d", F.col("value") - F.lag("value").over(by_time("variable")))
    out = step.groupBy(UNIT, "variable").agg((F.sum(F.col("d") ** 2) / F.nullif(F.sum(F.col("value") ** 2), F.lit(0.0))).alias("dw"))
    return out.withColumn("autocorrelated", ~((F.col("dw") > 1.5) & (F.col("dw") < 2.5)))


def ar1_residuals(df: DataFrame, cols: list[str]) -> DataFrame:
    """unit_id, variable, t_idx, e: residuals of each variable on its last value."""
    rows = pair_rows(df, [(c, c) for c in cols], [1]).where("x is not null and y is not null")
    w = Window.partitionBy(UNIT, "source")
    b = F.covar_pop("x", "y").over(w) / F.nullif(F.var_pop("x").over(w), F.lit(0.0))
    return rows.select(UNIT, F.col("source").alias("variable"), IDX, (F.col("y") - F.avg("y").over(w) - b * (F.col("x") - F.avg("x").over(w))).alias("e"))


def ljung_box(df: DataFrame, cols: list[str], lags: int = 10) -> DataFrame:
    """Of the AR(1) residuals: statistic and p for each number of lags."""
    e, w = ar1_residuals(df, cols), Window.partitionBy(UNIT, "variable").orderBy(IDX)
    wide = e.select(UNIT, "variable", (F.col("e") ** 2).alias("e2"), *[(F.col("e") * F.lag("e", k).over(w)).alias(f"_{k}") for k in range(1, lags + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("c")) for k in range(1, lags + 1)])
    s = wide.select(UNIT, "variable", "e2", F.inline(cells)).groupBy(UNIT, "variable", "lag").agg(F.count("*").alias("n"), (F.sum("c") / F.nullif(F.sum("e2"), F.lit(0.0))).alias("r"))
    run = Window.partitionBy(UNIT, "variable").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumn("q", F.col("n") * (F.col("n") + 2) * F.sum(F.col("r") ** 2 / (F.col("n") - F.col("lag"))).over(run))
    return out.withColumn("p_value", chi2_upper(F.col("q"), F.col("lag").cast("double")))


def _tests(v: np.ndarray, alpha: float) -> dict:
    """White and ARCH statistics of AR(1) residuals and the Anderson-Darling and Shapiro-Francia statistics of the series."""
    n = len(v)
    x = np.column_stack([np.ones(n - 1), v[:-1]])
    e = _ols(x, v[1:])[1]
    lm = lambda d, y: len(y) * max(0.0, 1 - _ols(d, y)[2] / max(((y - y.mean()) ** 2).sum(), 1e-300))
    e2 = e**2
    arch = lm(np.column_stack([np.ones(len(e2) - 5), *(e2[5 - k : len(e2) - k] for k in range(1, 6))]), e2[5:])
    white = lm(np.column_stack([x, v[:-1] ** 2]), e2)
    z = np.sort((v - v.mean()) / (v.std(ddof=1) or 1))
    cdf = np.clip([NormalDist().cdf(a) for a in z], 1e-15, 1 - 1e-15)
    i = np.arange(1, n + 1)
    ad = -n - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))).sum() / n
    m = np.array([NormalDist().inv_cdf((k - 0.375) / (n + 0.25)) for k in i])
    return {"arch": arch, "white": white, "anderson": ad * (1 + 4 / n - 25 / n**2), "shapiro_w": float((m @ z) ** 2 / ((m @ m) * (z @ z)))}


def distribution_tests(df: DataFrame, cols: list[str], alpha: float = 0.05, least: int = 30) -> DataFrame:
    """Assumption tests of every variable; flags by majority, recommended methods; nothing but n under ``least`` rows."""

    def one(v: np.ndarray, t: np.ndarray) -> pd.DataFrame:
        v = v[~np.isnan(v)]
        got = _tests(v, alpha) if len(v) >= least and v.std() > 0 else dict.fromkeys(("arch", "white", "anderson", "shapiro_w"))
        return pd.DataFrame([{"n": len(v), **got}])

    base = per_series(df, cols, one, "n long, arch double, white double, anderson double, shapiro_w double")
    key = [UNIT, "variable"]
    lb = ljung_box(df, cols).groupBy(*key).agg(F.min("p_value").alias("ljung_box_p"))
    out = base.join(jarque_bera(df, cols).select(*key, F.col("p_value").alias("jb_p")), key, "left").join(durbin_watson(df, cols), key, "left").join(lb, key, "left")
    # Royston's transform of 1 - W for n over 11, as published for the Shapiro-Francia form
    u = F.log("n")
    v = F.log(u)
    shapiro = 1 - normal_cdf((F.log(1 - F.col("shapiro_w")) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u)))
    out = out.withColumn("shapiro_p", F.when(F.col("n") <= 5000, shapiro)).withColumn("arch_p", chi2_upper(F.col("arch"), 5.0)).withColumn("white_p", chi2_upper(F.col("white"), 2.0))
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    votes, n_votes = yes(F.col("shapiro_p") > alpha) + yes(F.col("jb_p") > alpha) + yes(F.col("anderson") < 0.752), yes(F.col("shapiro_p").isNotNull()) + yes(F.col("jb_p").isNotNull()) + yes(F.col("anderson").isNotNull())
    ok = F.col("n") >= least
    out = out.withColumn("gaussian", F.when(ok, 2 * votes > n_votes)).withColumn("linear", F.when(ok, F.col("ljung_box_p") > alpha)).withColumn("homoscedastic", F.when(ok, (F.col("arch_p") > alpha) & (F.col("white_p") > alpha)))
    methods = F.when(F.col("n") < 60, F.array(F.lit("granger"))).otherwise(
        F.array_compact(F.array(F.when(F.col("gaussian") & F.col("linear"), F.lit("granger")), F.when(~F.coalesce(F.col("gaussian") & F.col("linear"), F.lit(False)), F.lit("transfer_entropy")), F.when(F.col("n") >= 100, F.lit("pcmci"))))
    )
    return out.withColumn("recommended", F.array_join(methods, ","))


def reset(df: DataFrame, pairs: list[tuple[str, str]], lags: list[int] | None = None) -> DataFrame:
    """F test of the squared and cubed fit in y on x, from power sums: one aggregation, then a small solve per row."""
    rows = pair_rows(df, pairs, lags).where("x is not null and y is not null")
    key, w = [UNIT, "source", "target", "lag"], Window.partitionBy(UNIT, "source", "target", "lag")
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
    s = rows.select(*key, z("x").alias("x"), z("y").alias("y"))
    m = s.groupBy(*key).agg(F.count("*").alias("n"), F.array(*[F.avg(F.pow("x", F.lit(float(k)))) for k in range(7)]).alias("mx"), F.array(*[F.avg(F.col("y") * F.pow("x", F.lit(float(k)))) for k in range(4)]).alias("mxy"), F.avg(F.col("y") ** 2).alias("yy"))

    def run(batches):
        for pdf in batches:
            out = []
            for mx, mxy, yy, n in zip(pdf["mx"], pdf["mxy"], pdf["yy"], pdf["n"]):
                g, b = np.array([[mx[i + j] for j in range(4)] for i in range(4)], float), np.array(mxy, float)
                if not (np.isfinite(g).all() and np.isfinite(b).all()):
                    out.append(None)
                    continue
                rss = lambda k, g=g, b=b, yy=yy: yy - b[:k] @ np.linalg.lstsq(g[:k, :k], b[:k], rcond=None)[0]
                out.append(((rss(2) - rss(4)) / 2) / (rss(4) / (n - 4)) if n > 4 and rss(4) > 1e-12 else None)
            yield pdf[[*key, "n"]].assign(f=pd.Series(out, dtype=float))

    got = m.mapInPandas(run, "unit_id string, source string, target string, lag int, n long, f double")
    return got.withColumn("p_value", f_upper(F.col("f"), 2.0, (F.col("n") - 4).cast("double")))


def linearity(df: DataFrame, x: str, y: str, least_r2: float = 0.8) -> DataFrame:
    r = corr(F.col(x), F.col(y))
    return df.groupBy(UNIT).agg((r * r).alias("r2")).withColumn("is_linear", F.col("r2") >= least_r2)
