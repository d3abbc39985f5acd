"""Building series from streams: watermarked tumbling means, and running lagged moments per unit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """unit_id, variable, start, mean, n per window; rows later than the watermark are dropped."""
    return (
        stream.withWatermark("ts", late).groupBy("unit_id", "variable", F.window("ts", width).alias("w"))
        .agg(F.avg("value").alias("mean"), F.count("value").alias("n")).select("unit_id", "variable", F.col("w.start").alias("start"), "mean", "n")
    )


def running_autocorrelation(stream: DataFrame, lag: int = 1) -> DataFrame:
    """unit_id, variable, n, r: the lagged correlation so far, from ``lag`` kept values and six sums a series."""

    def update(key: tuple, batches, state: GroupState):
        last, s = state.get if state.exists else ([], [0.0] * 6)
        last, s = list(last), list(s)
        for pdf in batches:
            for y in pdf.sort_values("ts")["value"]:
                if len(last) == lag:
                    x = last.pop(0)
                    for i, v in enumerate((1.0, x, y, x * x, y * y, x * y)):
                        s[i] += v
                last.append(float(y))
        state.update((last, s))
        n, sx, sy, sxx, syy, sxy = s
        den = ((n * sxx - sx * sx) * (n * syy - sy * sy)) ** 0.5
        yield pd.DataFrame([[*key, int(n), (n * sxy - sx * sy) / den if den > 0 else None]], columns=["unit_id", "variable", "n", "r"])

    return stream.groupBy("unit_id", "variable").applyInPandasWithState(update, "unit_id string, variable string, n long, r double", "last array<double>, sums array<double>", "update", GroupStateTimeout.NoTimeout)
