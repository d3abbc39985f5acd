"""Queries without SQL counterpart run on their whole views."""

import numpy as np

from chronolink import queries
from chronolink.operators import discovery
from chronolink.sources import views

SF = "/root/testdata/sf0.001"


def test_rank_and_distance_correlation_equal_brute_force_on_all_rows(spark):
    d = views.planted(spark, SF).select("X", "Y").toPandas().to_numpy()
    x, y = np.sign(d[:, None, 0] - d[None, :, 0]), np.sign(d[:, None, 1] - d[None, :, 1])
    got = queries.QUERIES["corr_kendall"](spark, SF).collect()[0]
    assert got.n == len(d) > 600 and abs(got.r - (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())) < 1e-5
    a, b = (np.abs(d[:, None, k] - d[None, :, k]) for k in (0, 1))
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    got = queries.QUERIES["corr_distance"](spark, SF).collect()[0]
    assert got.n == len(d) and abs(got.r - np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))) < 1e-5


def test_no_prefix_of_the_series(spark, monkeypatch):
    n = views.planted(spark, SF).count()
    assert all(r.n == n - r.delay for r in queries.QUERIES["te_batch_best"](spark, SF).collect())
    assert queries.QUERIES["fill_gp"](spark, SF).count() == views.event_wide(spark, SF).count() > 300
    seen = []
    monkeypatch.setattr(discovery, "predictive_baseline", lambda df, *a, **k: seen.append(df.count()) or df)
    queries.QUERIES["rf_baseline"](spark, SF)
    assert seen == [n] and n > 600
