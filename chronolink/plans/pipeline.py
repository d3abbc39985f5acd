"""The whole analysis of a series table: one plan a stage over all units and pairs, each written as Parquet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adequacy, consensus, correlation, diagnostics, discovery, evaluation, memory, quality, stability, surrogates, transforms
from ..schema import IDX, UNIT, numeric_columns, ordered_pairs
from ..sources.io import RunLog, Store


@dataclass(frozen=True)
class Options:
    tau_max: int | None = None
    tau_method: str = "scientific"
    alpha: float = 0.05
    sampling_days: float = 1.0
    target: str | None = None
    methods: tuple[str, ...] = ("granger", "transfer_entropy", "pcmci", "correlation")
    preprocess: bool = True
    deseasonalise: int | None = None
    surrogates: int = 99
    min_votes: int = 2
    env: str | None = None
    te_surrogates: int = 50
    extra: dict = field(default_factory=dict)


def prepare(df: DataFrame, cols: list[str], options: Options) -> DataFrame:
    """Interpolate, clip outliers, take seasons out and standardise, per unit."""
    if not options.preprocess:
        return df
    d = transforms.interpolate(df, cols)
    d = quality.outliers(d, cols, k=3.0)
    if options.deseasonalise:
        for c in cols:
            d = transforms.rolling_anomaly(d, c, options.deseasonalise)
    return transforms.zscore(d, cols)


def run(df: DataFrame, path: str, options: Options = Options(), truth: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run all enabled stages and return their tables; a method that fails is logged and left out."""
    spark: SparkSession = df.sparkSession
    store, log, out = Store(spark, path), RunLog("discovery"), {}
    cols = numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("at least two variables are needed")
    log.parameters(**options.__dict__)
    log.data(df)
    pairs = ordered_pairs(df, cols, options.target)

    def keep(name: str, table: DataFrame) -> DataFrame:
        store.save(name, table, force=True)
        out[name] = store.load(name)
        return out[name]

    d = keep("prepared", prepare(df, cols, options).select(UNIT, IDX, *[c for c in df.columns if c not in (UNIT, IDX)]))
    tau = options.tau_max or int(memory.recommend_tau(d, cols[:5], options.tau_method, options.sampling_days).agg(F.max("tau_max")).first()[0] or 12)
    n = d.count()
    keep("adequacy", adequacy.report(spark, len(cols), tau, max(0, n - tau)))
    methods = {
        "granger": lambda: discovery.granger(d, cols, pairs, tau, options.alpha, options.sampling_days),
        "transfer_entropy": lambda: discovery.te_batch(discovery.te_knn(d, pairs, [k for k in (1, 2, 3, 5, 7, 10, 14, 21, 30) if k <= tau], b=options.te_surrogates), options.alpha).withColumn("method", F.lit("TransferEntropy")).withColumn("lag_steps", F.col("delay")).withColumn("effect_size", F.col("te_bits")),
        "pcmci": lambda: discovery.pcmci(d, cols, min(tau, 5), options.alpha).where("source <> target"),
        "varlingam": lambda: discovery.var_lingam(d, cols, min(tau, 3)).where("source <> target").withColumn("p_value", F.lit(None).cast("double")).withColumn("q_value", F.lit(None).cast("double")),
        "correlation": lambda: correlation.lagged_edges(d, pairs, tau, options.alpha, options.sampling_days).where("is_best_lag"),
    }
    shared, edges = [UNIT, "method", "source", "target", "lag_steps", "p_value", "q_value", "effect_size", "is_significant"], None
    for name in options.methods:
        try:
            table = keep(f"method={name}", methods[name]())
        except Exception as e:  # noqa: BLE001  one failing method must not end the run; the log keeps it
            log.error(e)
            continue
        rows = table.select(*[F.col(c) if c in table.columns else F.lit(None).alias(c) for c in shared], (F.col("is_directed") if "is_directed" in table.columns else F.lit(True)).alias("is_directed"))
        edges = rows if edges is None else edges.unionByName(rows)
    if edges is None:
        raise RuntimeError("no method succeeded")
    edges = keep("edges", edges.withColumn("lag_days", F.col("lag_steps") * options.sampling_days))
    c = keep("consensus", consensus.consensus(edges.where("method in ('Granger', 'TransferEntropy', 'PCMCI+')"), min_votes=options.min_votes, alpha=options.alpha, sampling_days=options.sampling_days))
    found = [(r.source, r.target, max(1, r.lag_steps)) for r in c.select("source", "target", "lag_steps").distinct().collect()]  # bounded by pairs x lags
    if found:
        tests = keep("falsification", surrogates.summarize(surrogates.falsify(d, found, b=options.surrogates, alpha=options.alpha)))
        icp = keep("stability", stability.edge_stability(d, found, options.env))
        key = ["source", "target", "lag_steps"]
        c = c.join(tests, [UNIT, *key], "left").join(icp, [UNIT, *key] if options.env is None else key, "left")
    c = keep("tiers", consensus.add_tiers(c))
    keep("tier_summary", consensus.tier_summary(c))
    keep("strata", consensus.stratify(edges))
    keep("diagnostics", diagnostics.detection(edges))
    w = {"Granger": 0.9, "PCMCI+": 1.0, "TransferEntropy": 0.4, "VARLiNGAM": 0.7, "correlation": 0.1}
    have = [r[0] for r in edges.select("method").distinct().collect()]
    total = sum(w.get(m, 0.3) for m in have)
    keep("ensemble", consensus.ensemble(edges, {m: w.get(m, 0.3) / total for m in have}))
    if truth is not None:
        keep("recovery", evaluation.binary(edges.where("is_significant").select("method", "source", "target"), truth, methods=have))
    log.results(c)
    out["log"] = log.log
    return out
