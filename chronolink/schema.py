"""Canonical schemas and column names of series and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT, IDX, TS = "unit_id", "t_idx", "ts"

SERIES = "unit_id string, ts timestamp_ntz, t_idx bigint, variable string, value double"
EDGE = "unit_id string, method string, source string, target string, lag_steps int, lag_days double, statistic double, effect_size double, p_value double, q_value double, is_significant boolean, is_directed boolean, link_category string, n_obs bigint"

# Names under which foreign edge tables carry each field, in order of preference.
ALIASES = {
    "source": ["source", "cause"],
    "target": ["target", "effect"],
    "lag_steps": ["lag_steps", "best_lag", "lag", "delay"],
    "p_value": ["p_value", "best_p_value", "best_p", "pvalue"],
    "q_value": ["q_value", "best_q_value"],
    "is_significant": ["is_significant", "significant", "fdr_significant", "is_causal"],
}
PLOT_P, PLOT_LAG = ["p_value", "best_p_value", "q_value", "pvalue"], ["delay", "lag", "lag_steps", "tau"]
# The families that methods belong to.
PARADIGM = {"Granger": "regression", "VARLiNGAM": "regression", "TransferEntropy": "information_theoretic", "PCMCI+": "constraint_based", "LPCMCI": "constraint_based", "RF": "predictive"}


def resolve(df: DataFrame, field: str) -> str | None:
    """The column of df that holds a logical field, or None."""
    return next((c for c in ALIASES[field] if c in df.columns), None)


def detect(df: DataFrame, names: list[str]) -> str | None:
    return next((c for c in names if c in df.columns), None)


def normalise_edges(df: DataFrame) -> DataFrame:
    """Rename known aliases to the canonical names where these are absent."""
    for field in ALIASES:
        found = resolve(df, field)
        if found and field not in df.columns:
            df = df.withColumnRenamed(found, field)
    return df


def first_lag(df: DataFrame) -> Column:
    """The first lag column that is not null, row by row."""
    have = [F.col(c) for c in ALIASES["lag_steps"] if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("int")


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = (UNIT, IDX, TS)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def to_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Wide series to (keys, variable, value); other columns stay."""
    cols = cols or numeric_columns(df)
    keys = [c for c in df.columns if c not in cols]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, "variable", "value")


def ordered_pairs(df: DataFrame, cols: list[str] | None = None, target: str | None = None) -> list[tuple[str, str]]:
    """All ordered pairs of numeric columns, or all into one target."""
    cols = cols or numeric_columns(df)
    return [(a, b) for a in cols for b in cols if a != b and target in (None, b)]
