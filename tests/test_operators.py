import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolink import edge_queries, queries  # noqa: F401
from chronolink.operators import chartdata, consensus, correlation, discovery, evaluation, fdr, kernels, quality, reports, robustness, stability, surrogates, transforms
from chronolink.plans import pipeline, router
from chronolink.schema import normalise_edges
from chronolink.sources import io
from chronolink.streaming import series

SMALL = "/root/testdata/sf0.001"
COLS = [f"X{i}" for i in range(5)]


def found(df, where="is_significant and source <> target"):
    return {(r.source, r.target) for r in df.where(where).collect()}


def test_methods_recover_the_network(spark, network, true_edges):
    g = discovery.granger(network, COLS, maxlag=3)
    assert true_edges <= found(g) and len(found(g) - true_edges) <= 1
    p = discovery.pcmci(network, COLS, 2, contemporaneous=False)
    assert found(p) >= true_edges and {r.lag_steps for r in p.where("is_significant and source <> target").collect()} == {1}
    assert ("X0", "X2") not in found(p)
    plus = discovery.pcmci(network, COLS, 2)
    assert found(plus) >= true_edges
    te = discovery.te_discrete(network, [("X0", "X1"), ("X1", "X0")], [1, 2, 3]).collect()
    best = max(te, key=lambda r: r.te_bits)
    assert (best.source, best.target, best.delay) == ("X0", "X1", 1)


def test_order_of_rows_does_not_matter(spark, network):
    a = {tuple(r) for r in queries.rounded(correlation.lagged_edges(network, [("X0", "X1"), ("X1", "X2")], 3)).collect()}
    b = {tuple(r) for r in queries.rounded(correlation.lagged_edges(network.orderBy(F.rand(3)), [("X1", "X2"), ("X0", "X1")], 3)).collect()}
    assert a == b


def test_falsification_and_stability(spark, network):
    edges = [("X0", "X1", 1), ("X4", "X0", 1)]
    t = {(r.source, r.kind): r.passed for r in surrogates.falsify(network, edges, b=39).collect()}
    assert t["X0", "iaaft"] and t["X0", "block_permutation"] and not (t["X4", "iaaft"] and t["X4", "block_permutation"])
    s = {r.source: r for r in stability.edge_stability(network, edges).collect()}
    assert s["X0"].icp_stable and s["X0"].icp_n_environments == 3


@pytest.mark.parametrize("lags,groups", [([1, 3, 2], [2]), ([5, 5, 0], [5])])
def test_consensus_groups_greedily(spark, lags, groups):
    rows = [(m, "A", "B", k, 0.001, 0.001, 0.5, True, i) for i, (m, k) in enumerate(zip(["Granger", "TransferEntropy", "PCMCI+"], lags))]
    e = spark.createDataFrame(rows, "method string, source string, target string, lag_steps int, p_value double, q_value double, effect_size double, is_directed boolean, ord int").withColumn("is_significant", F.lit(True))
    got = consensus.consensus(e).orderBy("lag_steps").collect()
    votes = {r.lag_steps: r.vote_count for r in got}
    assert set(groups) <= set(votes) if lags[2] == 0 else votes == {2: 2, 3: 1} or sum(votes.values()) >= 2


def test_opposite_edges(spark):
    s = "method string, source string, target string, lag_steps int, p_value double, q_value double, effect_size double, is_significant boolean"
    base = [("TransferEntropy", "A", "B", 1, 0.001, 0.001, 0.9, True), ("PCMCI+", "A", "B", 1, 0.001, 0.001, 0.9, True)]
    weak = [("Granger", "B", "A", 1, 0.04, 0.04, 0.1, True), ("PCMCI+", "B", "A", 1, 0.04, 0.04, 0.1, True)]
    assert found(consensus.consensus(spark.createDataFrame(base + weak, s)), "true") == {("B", "A")}
    other = [("TransferEntropy", *weak[0][1:]), weak[1]]
    assert found(consensus.consensus(spark.createDataFrame(base + other, s)), "true") == {("A", "B")}
    assert consensus.consensus(spark.createDataFrame([], s)).count() == 0


def test_tier_truth_table(spark):
    rows = [(3, 0, True, False, 3), (2, 1, False, False, 2), (2, 0, False, True, 2), (3, 2, True, False, 1), (1, 2, True, True, 3), (3, 2, None, False, 2)]
    df = spark.createDataFrame(rows, "vote_count int, falsification_passed int, icp_stable boolean, oos_significant boolean, want int")
    assert consensus.add_tiers(df).where("tier <> want").count() == 0


def test_recovery_counts(spark):
    f = spark.createDataFrame([("m", "A", "B"), ("m", "C", "B"), ("m", "D", "E")], "method string, source string, target string")
    t = spark.createDataFrame([("A", "B"), ("B", "C")], "source string, target string")
    r = evaluation.binary(f, t).first()
    assert (r.tp, r.fp, r.fn, r.n_reversals, r.shd) == (1, 2, 1, 1, 2)
    u = evaluation.binary(f, t, directed=False).first()
    assert (u.tp, u.fp, u.fn) == (2, 1, 0)


def test_fdr_edges(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, float("nan")), (4, 0.0), (5, 0.04)], "i int, p_value double")
    got = {r.i: (r.q_value, r.is_significant) for r in fdr.benjamini_hochberg(df).collect()}
    assert got[2] == got[3] == (None, False) and got[4] == (0.0, True) and got[1][0] == pytest.approx(0.015)


def test_fdr_without_groups_equals_ranking_all(spark, monkeypatch):
    monkeypatch.setattr(fdr, "RANGES", 7)
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400) ** 3, 2)  # many ties
    order = np.sort(p)
    want = {v: max(v, min(1.0, *(x * len(p) / (k + 1) for k, x in enumerate(order) if x >= v and (k + 1 == len(p) or order[k + 1] > x)))) for v in set(p)}
    got = fdr.benjamini_hochberg(spark.createDataFrame([(float(x),) for x in p], "p_value double")).collect()
    assert len(got) == 400 and all(abs(r.q_value - want[r.p_value]) < 1e-12 for r in got)


def test_units_keep_to_themselves(spark):
    s = "unit_id string, source string, target string, is_significant boolean"
    e = spark.createDataFrame([("u1", "X", "M", True), ("u2", "M", "Y", True), ("u1", "X", "Y", True), ("u3", "X", "M", True), ("u3", "M", "Y", True), ("u3", "X", "Y", True)], s)
    kept = {(r.unit_id, r.source, r.target) for r in discovery.transitive_reduction(e).collect()}
    assert ("u1", "X", "Y") in kept and ("u3", "X", "Y") not in kept and len(kept) == 5
    assert [tuple(r) for r in discovery.mediators(e).collect()] == [("u3", "X", "Y", "M")]
    votes = spark.createDataFrame([("a", "X", "Y", True, 1), ("b", "X", "Y", True, 2)], s + ", fold int")
    assert sorted((r.unit_id, r.n_folds) for r in stability.fold_votes(votes).collect()) == [("a", 1), ("b", 1)]
    links = spark.createDataFrame([(u, b, "X", "Y", 1, 0.5) for u in ("a", "b", "c") for b in (1, 2)], "unit_id string, b int, source string, target string, lag_steps int, strength double")
    assert {(r.unit_id, r.frequency) for r in stability.link_frequency(links, 2).collect()} == {("a", 1.0), ("b", 1.0), ("c", 1.0)}
    rows = [(u, m, "A", "B", 1, 0.001, 0.001, 0.5, True) for u, m in (("a", "TransferEntropy"), ("b", "PCMCI+"))]
    v = spark.createDataFrame(rows, "unit_id string, method string, source string, target string, lag_steps int, p_value double, q_value double, effect_size double, is_significant boolean")
    assert consensus.consensus(v).count() == 0 and consensus.consensus(v.drop("unit_id")).count() == 1


def test_weights_of_opposite_directions(spark):
    s = "method string, source string, target string, lag_steps int, p_value double, q_value double, effect_size double, is_significant boolean"
    one = [("Granger", "A", "B", 1, 0.001, 0.001, 0.2, True), ("TransferEntropy", "A", "B", 1, 0.001, 0.001, 0.2, True)]
    other = [("Granger", "B", "A", 1, 0.001, 0.001, 0.2, True), ("PCMCI+", "B", "A", 1, 0.001, 0.001, 0.2, True)]
    assert found(consensus.consensus(spark.createDataFrame(one + other, s)), "true") == {("B", "A")}


def test_mediator_pruning_is_per_unit(spark, network):
    two = network.unionByName(network.withColumn("unit_id", F.lit("b")))
    e = spark.createDataFrame([(u, a, b, True) for u in ("all", "b") for a, b in (("X0", "X1"), ("X1", "X2"), ("X0", "X2"))], "unit_id string, source string, target string, is_significant boolean").where("not (unit_id = 'b' and source = 'X1')")
    kept = {(r.unit_id, r.source, r.target) for r in discovery.mediator_pruning(two, e, COLS).collect()}
    assert ("all", "X0", "X2") not in kept and ("b", "X0", "X2") in kept and ("all", "X0", "X1") in kept


def test_robustness_checks(spark, network):
    x = robustness.simulate(400, 0.5, 0.6, 3)
    d = spark.createDataFrame([("u", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "unit_id string, t_idx long, s double, t double")
    ci = robustness.lag_interval(d, "s", "t", 4, 20).first()
    assert ci.best_lag == 1 and ci.ci_low == ci.ci_high == 1.0
    e = np.array([r.s for r in robustness.prewhiten(d, "s", 1).orderBy("t_idx").collect()])
    assert len(e) == 399 and abs(np.corrcoef(e[1:], e[:-1])[0, 1]) < 0.1
    assert {r.metric for r in robustness.compare_strength(d, "s", "t", 1).collect()} == {"correlation", "granger", "transfer_entropy"}
    f = {r.kind: r for r in robustness.false_positive_rate(d, ["s", "t"], b=5, tau_max=1).collect()}
    assert set(f) == {"shuffle", "phase"} and f["shuffle"].false_positive_rate < 0.35
    assert robustness.drivers(discovery.granger(network, COLS, maxlag=2), "X1").where("rank = 1").first().source == "X0"
    v = robustness.variants({"alpha": 0.05, "tau": 5}, {"alpha": [0.01, 0.1], "tau": [3, 8]})
    assert len(v) >= 6 and len({tuple(sorted(x.items())) for x in v}) == len(v)
    assert 0.9 <= robustness.surrogate_pass_rate(10, 0.3, 0.6, b=39) and robustness.surrogate_pass_rate(10, 0.3, 0.0, b=39) <= 0.3
    with pytest.raises(ValueError):
        kernels.GPDC(np.zeros((kernels.GPDC.MOST + 1, 2)))


def test_reports_and_bookkeeping(spark, tmp_path):
    e = queries.literal(spark)
    c = consensus.consensus(e, sampling_days=5.0)
    text = reports.summary(c, e)
    assert "X -> Y" in text and "Granger:" in text
    assert reports.latex(consensus.voting_matrix(c)).count(r"\\") == consensus.voting_matrix(c).count() + 1
    assert reports.audit_options({"confounding_risk": 0.9, "confidence": 0.3, "tau_max": 4}, {"tau_max": 7}) == {"methods": ["granger", "transfer_entropy", "pcmci", "lpcmci"], "abstain": False, "extra_checks": True, "tau_max": 7}
    r = evaluation.binary(e.where("is_significant"), queries.truth(spark), methods=["silent"]).where("method = 'silent'").first()
    assert (r.tp, r.fp, r.fn, r.recall, r.shd) == (0, 0, 4, 0.0, 4)
    t = lambda *rows: io.content_hash(spark.createDataFrame(rows, "a string, b string")).first().hash
    assert len({t(("a|b", "c")), t(("a", "b|c")), t((None, "c")), t(("", "c"))}) == 4
    store = io.Store(spark, str(tmp_path / "s"))
    assert store.methods() == []
    store.save("granger", c)
    assert store.methods() == ["granger"]
    log = io.RunLog("x")
    log.file(str(tmp_path / "none"))
    assert log.finalize()["files"][0]["exists"] is False and "commit" in log.log["code"]
    plots = io.PlotLog()
    plots.tell("edges", "granger", "p", "failed", "no rows")
    plots.tell("edges", "granger", "p")
    assert plots.stats() == {"total": 1, "success": 1, "failed": 0, "skipped": 0}
    assert chartdata.histogram(e, "p_value", 4).agg(F.sum("n")).first()[0] == 14


def test_missing_data(spark):
    v = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([("u", i, x) for i, x in enumerate(v)], "unit_id string, t_idx long, x double")
    get = lambda d: [r.x for r in d.orderBy("t_idx").collect()]
    assert get(transforms.interpolate(df, ["x"])) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert get(transforms.interpolate(df, ["x"], edges=False)) == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert {r.flag for r in quality.flag_low_coverage(df, ["x"], 50).select(F.col("__qc_flag__").alias("flag")).collect()} == {"low_coverage"}
    const = spark.createDataFrame([("u", i, 2.0, float(i)) for i in range(20)], "unit_id string, t_idx long, x double, y double")
    assert correlation.pearson(const, [("x", "y")]).first().r is None
    assert {r.x for r in transforms.zscore(const, ["x"]).collect()} == {0.0}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,a,b\n2020-01-01,1,2\nbad,5,5\n2020-01-02,3,4\n")
    df, meta = io.load_csv(spark, str(tmp_path / "a.csv"))
    assert df.count() == 2 and meta.first().sampling_days == 1.0 and meta.first().n_variables == 2
    (tmp_path / "b.csv").write_text("date,site,v\n2020-01-01,p,2\n2020-01-01,p,4\n2020-01-02,q,4\n")
    wide, _ = io.load_csv(spark, str(tmp_path / "b.csv"), variable_column="site", value_column="v")
    assert [r.p for r in wide.orderBy("ts").collect()] == [3.0, None]
    c = consensus.consensus(queries.literal(spark), sampling_days=5.0)
    text = open(io.write_graphml(c, str(tmp_path / "g.graphml"))).read()
    assert text.count("<edge ") == c.select("source", "target").distinct().count()
    assert io.write_graphml(c.limit(0), str(tmp_path / "h.graphml")) is None and not os.path.exists(tmp_path / "h.graphml")
    store = io.Store(spark, str(tmp_path / "store"))
    store.save("x", c)
    assert store.metadata("x")["rows"] == c.count() and store.load("none") is None
    h = lambda d: io.content_hash(d).first().hash
    assert h(c) == h(c.orderBy(F.desc("source")))
    assert normalise_edges(spark.createDataFrame([("A", "B")], "cause string, effect string")).columns == ["source", "target"]


def test_pipeline_end_to_end(spark, network, tmp_path, true_edges):
    truth = spark.createDataFrame(sorted(true_edges), "source string, target string")
    out = pipeline.run(network, str(tmp_path), pipeline.Options(tau_max=2, methods=("granger", "pcmci", "correlation"), surrogates=19), truth)
    assert found(out["tiers"], "true") >= true_edges
    assert out["recovery"].where("method = 'Granger'").first().recall == 1.0 and not out["log"]["errors"]
    assert out["tier_summary"].count() == 3
    assert {"granger", "pcmci"} <= set(router.decide(network, [("X0", "X1")]).first().methods)


def test_streams(spark, tmp_path):
    rows = [("u", f"2024-01-01 {h:02d}:00:00", "x", float(h)) for h in range(12)]
    spark.createDataFrame(rows, "unit_id string, ts string, variable string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unit_id string, ts timestamp, variable string, value double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("s_mean", series.tumbling(stream), "complete"), ("s_ac", series.running_autocorrelation(stream), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.mean, r.n) for r in spark.table("s_mean").collect()) == [(2.5, 6), (8.5, 6)]
    last = max(spark.table("s_ac").collect(), key=lambda r: r.n)
    assert last.n == 11 and last.r == pytest.approx(1.0)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["lag_corr", "series_zscore", "qc_coverage", "fdr_bh_global", "granger_f_l1", "te_discrete", "consensus_tolerance", "recovery_binary", "icp_blocks", "chart_ccf", "lagged_corr_best", "corr_batch_fdr", "block_bootstrap_ci", "mean_bootstrap_ci", "series_prewhiten", "strength_by_lag", "reverse_direction", "drivers_ranked", "tier_report", "recovery_silent_method", "content_hash", "chart_flow", "granger_transitive_reduction", "granger_mediators", "icp_cochran_q", "te_surrogate_p", "edges_measured", "tier_precision", "consensus_exact_against_bands", "baseline_chi_square", "baseline_binomial", "corr_all_measures", "corr_kendall", "corr_distance", "target_entropy", "power_parcorr", "two_cycles_measured"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, SMALL), con.execute(queries.ORACLE[name])
    names = [d[0] for d in b.description]
    want = sorted((tuple(map(str, (r[names.index(c)] for c in a.columns))) for r in b.fetchall()))
    got = sorted(tuple(str(v) for v in r) for r in a.collect())
    assert len(got) == len(want)
    for x, y in zip(got, want):
        for u, v in zip(x, y):
            assert u == v or np.isclose(float(u), float(v), atol=2e-6)
