"""Coverage, missing data, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import IDX, TS, UNIT, numeric_columns, to_long
from .transforms import _each, interpolate


def coverage(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Per variable (and group): known and missing values, coverage in percent, mean and sample deviation."""
    keys = [by] if by else []
    return to_long(df.select(*keys, *cols), cols).groupBy(*keys, "variable").agg(
        F.count("value").alias("n_valid"), F.count_if(F.col("value").isNull()).alias("n_missing"),
        (100.0 * F.count("value") / F.count("*")).alias("coverage_pct"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )


def flag_low_coverage(df: DataFrame, cols: list[str], least_pct: float = 10, by: str | None = None) -> DataFrame:
    """__qc_flag__: a group (or everything) with any variable under the limit is low_coverage."""
    keys = [by] if by else []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    if by:
        worst = coverage(df, cols, by).groupBy(by).agg(F.min("coverage_pct").alias("_c"))
        out = df.join(worst, by)
    else:
        out = df.crossJoin(coverage(df, cols).agg(F.min("coverage_pct").alias("_c")))  # one row
    del w
    return out.withColumn("__qc_flag__", F.when(F.col("_c") < least_pct, "low_coverage").otherwise("pass")).drop("_c")


def _fences(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    return df.groupBy(UNIT).agg(*[x for c in cols for x in (F.percentile(c, F.array(*map(F.lit, qs))).alias(f"_q_{c}"), F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])


def outliers(df: DataFrame, cols: list[str], method: str = "iqr", k: float = 1.5, z: float = 3.0, mode: str = "clip") -> DataFrame:
    """Cells outside the quartile fences (and/or beyond z deviations) are clipped to the 1st and 99th percentile, made null
    and filled linearly, or flagged in __outlier_flag__."""
    d = df.join(_fences(df, cols, [0.01, 0.25, 0.75, 0.99]), UNIT)

    def bad(c: str):
        q = F.col(f"_q_{c}")
        iqr = (F.col(c) < q[1] - k * (q[2] - q[1])) | (F.col(c) > q[2] + k * (q[2] - q[1]))
        score = F.abs(F.col(c) - F.col(f"_m_{c}")) > z * F.col(f"_s_{c}")
        return {"iqr": iqr, "zscore": score, "both": iqr | score}[method]

    drop = [f"_{x}_{c}" for c in cols for x in "qms"]
    if mode == "flag":
        flag = F.lit(False)
        for c in cols:
            flag = flag | F.coalesce(bad(c), F.lit(False))
        return d.withColumn("__outlier_flag__", flag).drop(*drop)
    if mode == "clip":
        return _each(d, cols, lambda c: F.when(bad(c), F.greatest(F.least(F.col(c), F.col(f"_q_{c}")[3]), F.col(f"_q_{c}")[0])).otherwise(F.col(c))).drop(*drop)
    return interpolate(_each(d, cols, lambda c: F.when(~F.coalesce(bad(c), F.lit(False)), F.col(c))).drop(*drop), cols)


def mask_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "mask" in c.lower() or "flag" in c.lower()]


def mask_coverage(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """For mask or flag columns: rows that count as valid (0 if numeric, else known), in percent."""
    cols = mask_columns(df) if cols is None else cols
    number = set(numeric_columns(df, ()))
    counts = df.agg(F.count("*").alias("n"), *[F.count_if((F.col(c) == 0) if c in number else F.col(c).isNotNull()).alias(f"_{k}") for k, c in enumerate(cols)])
    out = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{k}").alias("n_valid"), F.col("n")) for k, c in enumerate(cols)])))
    return out.withColumn("coverage_pct", 100.0 * F.col("n_valid") / F.col("n"))


def na_policy(df: DataFrame, cols: list[str], max_missing_pct: float = 50, limits: tuple[float, float] = (0.05, 0.95), handling: str = "winsorize", z: float = 3.5) -> DataFrame:
    """Drop sparse columns, fill forward linearly (leading nulls stay), winsorize or null and refill outliers, drop rows with nulls."""
    share = df.agg(*[(100.0 * F.count_if(F.col(c).isNull()) / F.count("*")).alias(c) for c in cols]).first()
    kept = [c for c in cols if (share[c] or 0) <= max_missing_pct]
    d = interpolate(df.drop(*[c for c in cols if c not in kept]), kept, edges=False)
    f = d.join(_fences(d, kept, list(limits)), UNIT)
    if handling == "winsorize":
        d = _each(f, kept, lambda c: F.greatest(F.least(F.col(c), F.col(f"_q_{c}")[1]), F.col(f"_q_{c}")[0]))
    elif handling == "zscore":
        d = interpolate(_each(f, kept, lambda c: F.when(F.abs(F.col(c) - F.col(f"_m_{c}")) <= z * F.col(f"_s_{c}"), F.col(c))), kept, edges=False)
    return d.select(UNIT, *[x for x in (TS, IDX) if x in d.columns], *kept).na.drop(subset=kept)


def effective_n(df: DataFrame, cols: list[str], tau_max: int) -> DataFrame:
    full = F.lit(True)
    for c in cols:
        full = full & F.col(c).isNotNull()
    return df.agg(F.greatest(F.lit(0), F.count_if(full) - tau_max).alias("effective_n"))
