"""Sample-size adequacy and power: closed forms over (method, variables, lags, rows)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ["parcorr", "robust_parcorr", "cmiknn", "gpdc", "granger", "varlingam", "transfer_entropy", "lpcmci"]
ALIASES = {"pcmci": "parcorr", "pcmci+": "parcorr", "pcmciplus": "parcorr"}


def minimum(method: Column, n_vars: Column, tau: Column) -> Column:
    """Rows that a method needs; 0 for unknown methods."""
    short = F.least(tau, F.lit(3))
    parcorr = F.greatest(F.lit(50), 3 * n_vars * short + 10)
    d = F.least(n_vars, F.lit(4)) * F.least(tau, F.lit(2))
    knn = F.least(F.lit(2000), F.greatest(F.lit(200), (10 * F.ceil(F.pow(F.lit(2.0), d / 2))).cast("int")))
    forms = {
        "parcorr": parcorr, "robust_parcorr": F.floor(1.2 * parcorr), "cmiknn": knn, "gpdc": F.greatest(F.lit(500), 10 * n_vars * short),
        "granger": F.greatest(F.lit(30), 3 * (n_vars * tau + 1) + 10), "varlingam": F.greatest(F.lit(100), 5 * n_vars * (tau + 1)), "transfer_entropy": knn, "lpcmci": F.floor(1.5 * parcorr),
    }
    out = F.when(method.isin(*ALIASES), parcorr.cast("long"))
    for k, v in forms.items():
        out = out.when(method == k, v.cast("long"))
    return out.otherwise(F.lit(0).cast("long"))


def assess(df: DataFrame) -> DataFrame:
    """df (method, n_vars, tau_max, t_eff) with required rows, adequacy and score."""
    need = minimum(F.col("method"), F.col("n_vars"), F.col("tau_max"))
    out = df.withColumn("required", need)
    ratio = F.col("t_eff") / F.nullif(F.col("required"), F.lit(0))
    return out.withColumn("score", F.when((F.col("required") == 0) | (F.col("t_eff") >= F.col("required")), 1.0).otherwise(ratio)).withColumn("adequate", F.col("score") >= 0.7)


def report(spark: SparkSession, n_vars: int, tau_max: int, t_eff: int) -> DataFrame:
    return assess(spark.createDataFrame([(m, n_vars, tau_max, t_eff) for m in METHODS], "method string, n_vars int, tau_max int, t_eff int"))


def warnings(t_eff: int, tau_max: int, missing_pct: float, inadequate: list[str]) -> list[str]:
    return [text for bad, text in ((t_eff < 30, "fewer than 30 rows"), (30 <= t_eff < 50, "fewer than 50 rows"), (missing_pct > 30, "over 30 % missing"), (bool(inadequate), f"too few rows for {', '.join(inadequate)}"), (tau_max > 0.25 * t_eff, "lags over a quarter of the rows")) if bad]


def suggest_test(t_eff: int, n_vars: int, tau_max: int, nonlinear: bool = False) -> str:
    parcorr = max(50, 3 * n_vars * min(tau_max, 3) + 10)
    knn = min(2000, max(200, 10 * math.ceil(2 ** (min(n_vars, 4) * min(tau_max, 2) / 2))))
    if nonlinear and t_eff >= knn:
        return "cmiknn"
    return "robust_parcorr" if t_eff >= int(1.2 * parcorr) else "parcorr"


def _t_quantile(p: float, df: float) -> float:
    """Inverse of Student's distribution by its expansion in 1/df."""
    z = NormalDist().inv_cdf(p)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return z + sum(c / df ** (k + 1) for k, c in enumerate(g))


def detectable_parcorr(t_eff: int, n_vars: int, tau_max: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The smallest partial correlation that a test of this size finds with the given power."""
    df = max(1, t_eff - min(n_vars, 4) * min(tau_max, 3) - 2)
    ncp = _t_quantile(1 - alpha / 2, df) + NormalDist().inv_cdf(power)
    return min(1.0, ncp / math.sqrt(ncp**2 + df))


def detectable_cmiknn(t_eff: Column, n_vars: Column, tau: Column, k: int = 10) -> Column:
    d = F.least(n_vars, F.lit(4)) * F.least(tau, F.lit(2))
    return 2 * F.sqrt((F.lit(1.0 / k) + 1.0 / t_eff) * (1 + d / 4))


def power_band(effect: Column) -> Column:
    return F.when(effect < 0.10, "high").when(effect < 0.20, "moderate").when(effect < 0.40, "low").otherwise("insufficient")


def analyze_power(method: str, t_eff: int, n_vars: int, tau_max: int, n_edges: int = 0) -> dict:
    effect = detectable_parcorr(t_eff, n_vars, tau_max)
    band = "high" if effect < 0.10 else "moderate" if effect < 0.20 else "low" if effect < 0.40 else "insufficient"
    return {"method": method, "detectable_effect": effect, "power": band, "sufficient": effect < 0.20, "edges_found": n_edges}
