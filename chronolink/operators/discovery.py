"""Discovery methods: series to edges. Every method is one grouped plan over units, pairs, lags and resamples.

A unit's rows meet in one task only for kernels that need its lag matrix; its size is rows of one series times a few
variables. What multiplies (units, pairs, delays, surrogates) are group keys.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import by_time, corr, first_by
from ..functions.tails import f_upper
from ..schema import IDX, UNIT
from . import kernels
from .correlation import Pairs, pair_rows
from .fdr import benjamini_hochberg, monte_carlo_p
from .transforms import discretize, lag_embed


def _unit(edges: DataFrame) -> list[str]:
    return [UNIT] if UNIT in edges.columns else []


# ---- Granger ---------------------------------------------------------------------------------------------------------


def granger_l1(df: DataFrame, pairs: Pairs) -> DataFrame:
    """Bivariate lag-1 test in SQL: the partial correlation of target and lagged source given the lagged target."""
    cells = pair_rows(df, pairs, [1], keep=None)
    w = Window.partitionBy(UNIT, "source", "target").orderBy(IDX)
    rows = cells.withColumn("own", F.lag("y").over(w)).where("x is not null and y is not null and own is not null")
    g = rows.groupBy(UNIT, "source", "target").agg(F.count("*").alias("n"), corr(F.col("y"), F.col("x")).alias("a"), corr(F.col("y"), F.col("own")).alias("b"), corr(F.col("x"), F.col("own")).alias("c"))
    pr = (F.col("a") - F.col("b") * F.col("c")) / F.sqrt(F.nullif((1 - F.col("b") ** 2) * (1 - F.col("c") ** 2), F.lit(0.0)))
    g = g.withColumn("partial_r2", pr * pr).withColumn("f_stat", (F.col("n") - 3) * F.col("partial_r2") / F.nullif(1 - F.col("partial_r2"), F.lit(0.0)))
    return g.select(UNIT, "source", "target", "n", "partial_r2", "f_stat").withColumn("p_value", f_upper(F.col("f_stat"), 1.0, (F.col("n") - 3).cast("double")))


def _unit_kernel(df: DataFrame, cols: list[str], function, schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run function(matrix in time order, key values) per unit (and further keys)."""
    by = [UNIT, *keys]

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf.sort_values(IDX)[cols].to_numpy(float), k)
        for name, v in reversed(list(zip(by, k))):
            out.insert(0, name, v)
        return out

    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    return df.select(*by, IDX, *cols).groupBy(*by).applyInPandas(run, f"{key_schema}, {schema}")


def _granger_unit(x: np.ndarray, pairs: list[tuple[int, int]], maxlag: int, alpha: float, controls: bool, tolerance: float) -> list[dict]:
    """All pairs of a unit: every order's lag matrix and moments are made once and shared by the pairs."""
    n_vars, x = x.shape[1], x[np.isfinite(x).all(1)]
    if len(x) < maxlag + 10:
        maxlag = max(1, len(x) // 5)
    moments = {}
    for lag in range(1, maxlag + 1):
        rows = kernels.lag_matrix(x, lag)
        if len(rows) > n_vars * lag + 5:
            d = np.column_stack([np.ones(len(rows)), rows[:, n_vars:], rows[:, :n_vars]])
            moments[lag] = (len(rows), d.T @ d)
    out = []
    for s, t in pairs:
        use = list(range(n_vars)) if controls and n_vars <= 10 else [s, t]
        tests = []
        for lag, (n, g) in moments.items():
            own = [1 + n_vars * (k - 1) + v for k in range(1, lag + 1) for v in use]
            drop = {1 + n_vars * (k - 1) + s for k in range(1, lag + 1)}
            y = 1 + n_vars * lag + t

            def rss(cols: list[int], g=g, y=y) -> float:
                c = [0, *cols]
                return max(float(g[y, y] - g[y, c] @ np.linalg.lstsq(g[np.ix_(c, c)], g[c, y], rcond=None)[0]), 0.0)

            full, restricted = rss(own), rss([c for c in own if c not in drop])
            df2 = len(use) * (n - len(use) * lag - 1)
            f = (restricted - full) / lag / max(full / max(n - len(use) * lag - 1, 1), 1e-300)
            tests.append((lag, f, kernels.f_p(f, lag, df2), max(0.0, 1 - full / restricted) if restricted > 0 else 0.0))
        if not tests:
            out.append({"source": s, "target": t, "lag_steps": None, "f_stat": None, "p_value": None, "partial_r2": None, "lag_q": None, "n_obs": len(x)})
            continue
        p = np.array([a[2] for a in tests])
        low = int(np.argmin(p))
        pick = next((i for i in range(len(p)) if p[i] <= p[low] * max(1.0, tolerance * math.sqrt((i + 1) / (low + 1)) if low else tolerance) and p[i] < alpha), low)
        lag, f, pv, r2 = tests[pick]
        out.append({"source": s, "target": t, "lag_steps": lag, "f_stat": f, "p_value": pv, "partial_r2": r2, "lag_q": float(kernels.bh(p)[pick]), "n_obs": len(x)})
    return out


def granger(df: DataFrame, cols: list[str], pairs: Pairs | None = None, maxlag: int = 12, alpha: float = 0.05, sampling_days: float = 1.0, controls: bool = True, tolerance: float = 2.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Vector-autoregressive tests of all pairs, conditional on the other variables, with q-values per unit (and key)."""
    pairs = pairs or [(a, b) for a in cols for b in cols if a != b]
    index = [(cols.index(a), cols.index(b)) for a, b in pairs]

    def one(x: np.ndarray, k: tuple) -> pd.DataFrame:
        out = pd.DataFrame(_granger_unit(x, index, maxlag, alpha, controls, tolerance))
        return out.assign(source=[cols[i] for i in out["source"]], target=[cols[i] for i in out["target"]], lag_steps=out["lag_steps"].astype("Int32"))

    rows = _unit_kernel(df, cols, one, "source string, target string, lag_steps int, f_stat double, p_value double, partial_r2 double, lag_q double, n_obs long", keys)
    return benjamini_hochberg(rows, "p_value", [UNIT, *keys], alpha).withColumn("lag_days", F.col("lag_steps") * float(sampling_days)).withColumn("method", F.lit("Granger")).withColumn("effect_size", F.col("partial_r2"))


def bidirectional(edges: DataFrame) -> DataFrame:
    """Both directions of each pair side by side, and whether they couple."""
    a, b = edges.alias("a"), edges.alias("b")
    j = a.join(b, (F.col("a.source") == F.col("b.target")) & (F.col("a.target") == F.col("b.source")) & (F.col("a.unit_id") == F.col("b.unit_id"))).where("a.source < a.target")
    return j.select("a.unit_id", F.col("a.source").alias("var1"), F.col("a.target").alias("var2"), F.col("a.p_value").alias("p_forward"), F.col("b.p_value").alias("p_backward"), (F.col("a.is_significant") & F.col("b.is_significant")).alias("bidirectional"))


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges a->c without those for which a->b and b->c are edges too."""
    unit = _unit(edges)
    e = edges.where("is_significant").select(*unit, "source", "target").distinct()
    two = e.withColumnRenamed("target", "via").join(e.select(*unit, F.col("source").alias("via"), "target"), [*unit, "via"]).where("source <> target").select(*unit, "source", "target").distinct()
    return edges.join(two, [*unit, "source", "target"], "left_anti")


def mediators(edges: DataFrame) -> DataFrame:
    """(source, target, mediator) of edges with a significant two-step path, per unit where there are units."""
    unit = _unit(edges)
    e = edges.where("is_significant").select(*unit, "source", "target").distinct()
    first, second = e.withColumnRenamed("target", "mediator"), e.withColumnRenamed("source", "mediator")
    return first.join(second, [*unit, "mediator"]).join(e, [*unit, "source", "target"], "left_semi").where("mediator <> target and mediator <> source").select(*unit, "source", "target", "mediator")


def mediator_pruning(df: DataFrame, edges: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """Edges without those that tests of up to three lags given a mediator make insignificant in their unit. All triples of
    all units are groups of one plan."""
    values = F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*[F.col(c).cast("double") for c in cols]))
    at = lambda c: F.element_at("_v", F.col(c)).alias(f"_{c}")
    rows = df.select(UNIT, IDX, values.alias("_v")).join(mediators(edges), UNIT).select(UNIT, IDX, "source", "target", "mediator", at("source"), at("target"), at("mediator"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(IDX)[["_source", "_target", "_mediator"]].to_numpy(float)
        p = _granger_unit(x, [(0, 1)], 3, alpha, True, 2.0)[0]["p_value"]
        return pd.DataFrame([[*key[:3], p]])

    tests = rows.groupBy(UNIT, "source", "target", "mediator").applyInPandas(run, "unit_id string, source string, target string, p double")
    return edges.join(tests.where(F.col("p") >= alpha).select(UNIT, "source", "target").distinct(), [UNIT, "source", "target"], "left_anti")


def fit_var(df: DataFrame, cols: list[str], maxlags: int = 12, ic: str = "aic") -> DataFrame:
    """Order by information criterion and coefficients of a vector autoregression per unit: target, source, lag, coefficient."""

    def one(x: np.ndarray, k: tuple) -> pd.DataFrame:
        n, best = x.shape[1], None
        for p in range(1, maxlags + 1):
            rows = kernels.lag_matrix(x, p)
            if len(rows) <= n * p + 2:
                break
            d = np.column_stack([np.ones(len(rows)), rows[:, n:]])
            b = np.linalg.lstsq(d, rows[:, :n], rcond=None)[0]
            e = rows[:, :n] - d @ b
            m = len(rows)
            value = math.log(max(np.linalg.det(e.T @ e / m), 1e-300)) + (2 if ic == "aic" else math.log(m)) * (p * n * n + n) / m
            if best is None or value < best[0]:
                best = (value, p, b)
        if best is None:
            return pd.DataFrame(columns=["target", "source", "lag", "coefficient"])
        _, p, b = best
        return pd.DataFrame([(cols[i], cols[j], q + 1, b[1 + q * n + j, i]) for i in range(n) for q in range(p) for j in range(n)], columns=["target", "source", "lag", "coefficient"])

    return _unit_kernel(df, cols, one, "target string, source string, lag int, coefficient double")


# ---- Transfer entropy ------------------------------------------------------------------------------------------------


def _entropy_rows(rows: DataFrame, key: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """Entropies (nats) of several column sets in one pass over grouping sets: key columns, and one column a set."""
    every = list(dict.fromkeys(c for s in sets.values() for c in s))
    got = rows.groupingSets([[F.col(c) for c in [*key, *s]] for s in sets.values()], *[F.col(c) for c in [*key, *every]]).agg(F.count("*").alias("c"), F.grouping_id().alias("gid"))
    gid = {name: sum(0 if c in s else 1 << (len(every) - 1 - i) for i, c in enumerate(every)) for name, s in sets.items()}
    h = got.groupBy(*key, "gid").agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("h"))
    return h.groupBy(*key).agg(*[F.max(F.when(F.col("gid") == g, F.col("h"))).alias(name) for name, g in gid.items()])


def _coded(df: DataFrame, pairs: Pairs, delays: list[int], bins: int, closed_up: bool = True) -> DataFrame:
    """unit_id, source, target, delay, t_idx, x (coded source ``delay`` rows before), y, h (coded target one row before)."""
    used = list(dict.fromkeys(v for p in pairs for v in p))
    d = df.na.drop(subset=used) if closed_up else df
    coded = discretize(d.select(UNIT, IDX, *used), used, bins)
    rows = pair_rows(coded, pairs, sorted(set(delays)))
    w = Window.partitionBy(UNIT, "source", "target", "lag").orderBy(IDX)
    rows = rows.withColumn("h", F.lag("y").over(w)).where("x is not null and y is not null and h is not null")
    return rows.select(UNIT, "source", "target", F.col("lag").alias("delay"), IDX, "x", "y", "h")


def te_discrete(df: DataFrame, pairs: Pairs, delays: list[int] | None = None, bins: int = 5) -> DataFrame:
    """unit_id, source, target, delay, n, te_bits: I(target; delayed source | target's last value) of quantile bins."""
    key = [UNIT, "source", "target", "delay"]
    rows = _coded(df, pairs, delays or [1, 2, 3], bins)
    e = _entropy_rows(rows, key, {"yz": ["y", "h"], "xz": ["x", "h"], "z": ["h"], "all": ["y", "x", "h"]})
    n = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return e.select(*key, (F.greatest(F.lit(0.0), F.col("yz") + F.col("xz") - F.col("z") - F.col("all")) / math.log(2)).alias("te_bits")).join(n, key)


def mutual_information(df: DataFrame, pairs: Pairs, lags: list[int] | None = None, bins: int = 5) -> DataFrame:
    """Lagged mutual information (nats) of quantile bins, and its share of ln(bins), within [0, 1]."""
    key = [UNIT, "source", "target", "delay"]
    used = list(dict.fromkeys(v for p in pairs for v in p))
    rows = pair_rows(discretize(df.na.drop(subset=used).select(UNIT, IDX, *used), used, bins), pairs, lags or [1]).where("x is not null and y is not null").withColumnRenamed("lag", "delay")
    e = _entropy_rows(rows.select(*key, "x", "y"), key, {"hx": ["x"], "hy": ["y"], "hxy": ["x", "y"]})
    mi = F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy"))
    return e.select(*key, mi.alias("mi"), F.least(F.lit(1.0), mi / math.log(bins)).alias("proxy"))


def block_permuted(df: DataFrame, cols: list[str], b: int, size: int, seed: int = 42) -> DataFrame:
    """b copies of the series whose blocks of ``size`` rows are in the order of a hash of (seed, copy, block); t_idx is new."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.floor(F.col(IDX) / size).cast("string")))
    copies = df.select(UNIT, IDX, *cols, F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))
    return copies.withColumn(IDX, (F.row_number().over(Window.partitionBy(UNIT, "b").orderBy(key, IDX)) - 1).cast("long"))


def te_surrogates(df: DataFrame, source: str, target: str, delay: int = 1, b: int = 100, bins: int = 5, seed: int = 42) -> DataFrame:
    """te_bits of the pair with its Monte-Carlo p-value over block-permuted sources: surrogates are a group key of one plan."""
    d = discretize(df.na.drop(subset=[source, target]).select(UNIT, IDX, source, target), [source, target], bins)
    d = d.withColumn(IDX, (F.row_number().over(by_time()) - 1).cast("long"))
    real = d.select(UNIT, IDX, source, F.lit(0).alias("b"))
    copies = block_permuted(d, [source], b, max(2 * delay, 5), seed).select(UNIT, IDX, source, "b").unionByName(real)
    y = d.select(UNIT, IDX, F.col(target).alias("y"), F.lag(target).over(by_time()).alias("h"))
    x = copies.select(UNIT, (F.col(IDX) + delay).alias(IDX), F.col(source).alias("x"), "b")
    key = [UNIT, "b"]
    e = _entropy_rows(x.join(y, [UNIT, IDX]).where("h is not null").select(*key, "x", "y", "h"), key, {"yz": ["y", "h"], "xz": ["x", "h"], "z": ["h"], "all": ["y", "x", "h"]})
    te = e.select(*key, (F.greatest(F.lit(0.0), F.col("yz") + F.col("xz") - F.col("z") - F.col("all")) / math.log(2)).alias("te"))
    obs = te.where("b = 0").select(UNIT, F.col("te").alias("obs"))
    g = te.where("b > 0").join(obs, UNIT).groupBy(UNIT).agg(F.max("obs").alias("te_bits"), F.avg("te").alias("surrogate_mean"), F.stddev_pop("te").alias("surrogate_std"), monte_carlo_p(F.col("obs"), F.col("te")).alias("p_value"))
    return g.select(UNIT, F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(delay).alias("delay"), "te_bits", "surrogate_mean", "surrogate_std", "p_value")


def te_knn(df: DataFrame, pairs: Pairs, delays: list[int], k: int = 5, b: int = 100, seed: int = 42) -> DataFrame:
    """Nearest-neighbour transfer entropy (bits) with surrogate p-values, one group a (unit, pair, delay)."""
    rows = pair_rows(df.na.drop(subset=list({v for p in pairs for v in p})), pairs, delays)
    w = Window.partitionBy(UNIT, "source", "target", "lag").orderBy(IDX)
    rows = rows.withColumn("h", F.lag("y").over(w)).where("x is not null and y is not null and h is not null")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        m = pdf[["x", "y", "h"]].to_numpy(float)
        rng = np.random.default_rng(zlib.crc32(repr((seed, *key)).encode()))
        test = kernels.CMIKnn(m, k=min(k, max(2, len(m) // 10)), surrogates=0)
        x, y, z = test.rows[:, 0], test.rows[:, 1], test.rows[:, 2:]
        seen = test.value(x, y, z)
        other = [test.value(kernels.blocks(x, rng, max(2 * key[3], 5)), y, z) for _ in range(b)]
        p = (1 + sum(o >= seen - 1e-12 for o in other)) / (1 + b)
        return pd.DataFrame([[*key, len(m), seen / math.log(2), p]])

    return rows.groupBy(UNIT, "source", "target", "lag").applyInPandas(run, "unit_id string, source string, target string, delay int, n long, te_bits double, p_value double")


def te_batch(te: DataFrame, alpha: float = 0.05, best_only: bool = True, antisymmetric: bool = True) -> DataFrame:
    """From (pair, delay) rows with p-values: q-values within pairs, the best delay of each pair, and of two significant
    directions the one with the lower q."""
    out = benjamini_hochberg(te, "p_value", [UNIT, "source", "target"], alpha)
    if best_only:
        value = F.when(F.col("is_significant"), F.col("q_value")).otherwise(F.col("p_value"))
        out = out.withColumn("_r", first_by([UNIT, "source", "target"], [F.desc("is_significant"), F.coalesce(value, F.lit(float("inf"))), "delay"])).where("_r = 1").drop("_r")
    if antisymmetric:
        w = Window.partitionBy(UNIT, F.least("source", "target"), F.greatest("source", "target"), "is_significant")
        out = out.withColumn("_r", F.row_number().over(w.orderBy("q_value", "source"))).withColumn("is_significant", F.col("is_significant") & (F.col("_r") == 1)).drop("_r")
    return out


# ---- Constraint-based, noise-based and predictive methods --------------------------------------------------------------


def pcmci(df: DataFrame, cols: list[str], tau_max: int = 5, alpha: float = 0.05, contemporaneous: bool = True, test: str = "parcorr", keys: tuple[str, ...] = (), **options) -> DataFrame:
    """All tested links: source, target, lag_steps, value, p_value, q_value, mark, is_significant, is_directed, link_category.

    With contemporaneous links this is the plus variant; a lag-0 link is undirected and stands once for its pair."""

    def one(x: np.ndarray, k: tuple) -> pd.DataFrame:
        got = kernels.pcmci(x, tau_max, alpha, contemporaneous, test, **options)
        return pd.DataFrame([(cols[i], cols[j], lag, v, p, q, d, int(np.isfinite(x).all(1).sum())) for i, j, lag, v, p, q, d in got], columns=["source", "target", "lag_steps", "statistic", "p_value", "q_value", "is_directed", "n_obs"])

    rows = _unit_kernel(df, cols, one, "source string, target string, lag_steps int, statistic double, p_value double, q_value double, is_directed boolean, n_obs long", keys)
    category = F.when(F.col("source") == F.col("target"), "autoregressive").when(F.col("lag_steps") == 0, "contemporaneous").otherwise("lagged_directed")
    found = F.col("q_value") < alpha
    return rows.withColumn("method", F.lit("PCMCI+" if contemporaneous else "PCMCI")).withColumn("is_significant", found).withColumn("mark", F.when(~found, "").when(F.col("is_directed"), "-->").otherwise("o-o")).withColumn("link_category", category).withColumn("effect_size", F.abs("statistic"))


def best_links(links: DataFrame, pairs: Pairs) -> DataFrame:
    """One row a requested pair: its best significant link into the target, or none."""
    want = links.sparkSession.createDataFrame(pairs, "source string, target string")
    found = links.where("is_significant and source <> target").withColumn("_r", first_by([UNIT, "source", "target"], ["p_value", "lag_steps"])).where("_r = 1")
    return want.join(found.select("source", "target", UNIT, F.col("lag_steps").alias("best_lag"), F.col("p_value").alias("best_p_value"), "is_directed"), ["source", "target"], "left").withColumn("causal", F.col("best_lag").isNotNull())


def lpcmci(df: DataFrame, cols: list[str], tau_max: int = 3, alpha: float = 0.05, test: str = "parcorr") -> DataFrame:
    """Links with marks -->, o-> and o-o, latent causes allowed; variables in alphabetical order."""
    cols = sorted(cols)

    def one(x: np.ndarray, k: tuple) -> pd.DataFrame:
        return pd.DataFrame([(cols[i], cols[j], lag, v, p, m) for i, j, lag, v, p, m in kernels.lpcmci(x, tau_max, alpha, test)], columns=["source", "target", "lag_steps", "statistic", "p_value", "mark"])

    return _unit_kernel(df, cols, one, "source string, target string, lag_steps int, statistic double, p_value double, mark string").withColumn("method", F.lit("LPCMCI"))


def var_lingam(df: DataFrame, cols: list[str], lags: int = 3, prune: bool = True) -> DataFrame:
    """source, target, lag_steps, coefficient of vector-autoregressive LiNGAM; where pruning leaves nothing, the unpruned
    coefficients of .05 or more."""

    def one(x: np.ndarray, k: tuple) -> pd.DataFrame:
        for pruned, least in ((prune, 1e-10), (False, 0.05)):
            out = [(cols[j], cols[i], lag, float(b[i, j])) for lag, b in enumerate(kernels.var_lingam(x, lags, pruned)) for i in range(len(cols)) for j in range(len(cols)) if i != j and abs(b[i, j]) > least]
            if out:
                break
        return pd.DataFrame(out, columns=["source", "target", "lag_steps", "coefficient"])

    rows = _unit_kernel(df, cols, one, "source string, target string, lag_steps int, coefficient double")
    return rows.withColumn("method", F.lit("VARLiNGAM")).withColumn("abs_coefficient", F.abs("coefficient")).withColumn("is_significant", F.lit(True)).withColumn("effect_size", F.abs("coefficient"))


def predictive_baseline(df: DataFrame, cols: list[str], target: str, lags: int = 3, method: str = "random_forest", trees: int = 50, permutations: int = 20, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Tree-ensemble importance of each source for one target, with permutation p-values of the in-sample R2."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    names = [f"{c}_lag_{k}" for c in cols for k in range(1, lags + 1)]
    emb = lag_embed(df, {c: list(range(1, lags + 1)) for c in cols}, [target]).na.drop()
    spark, schema = df.sparkSession, "source string, target string, importance double, best_lag int, p_value double, is_significant boolean"
    if emb.count() < 50:
        return spark.createDataFrame([(c, target, 0.0, None, 1.0, False) for c in cols if c != target], schema)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(emb)
    common = {"labelCol": target, "featuresCol": "features", "seed": seed}
    model = (RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", maxDepth=10, **common) if method == "random_forest" else GBTRegressor(maxDepth=4, maxIter=trees, **common)).fit(data)
    imp = model.featureImportances.toArray()
    sources = [c for c in cols if c != target]
    shuffled = emb
    for c in sources:
        shuffled = shuffled.withColumn(f"_a_{c}", F.array(*[f"{c}_lag_{k}" for k in range(1, lags + 1)]))
    perms = emb.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("b"))
    out = []
    for c in sources:
        mine = [f"{c}_lag_{k}" for k in range(1, lags + 1)]
        src = perms.withColumn("_o", F.row_number().over(Window.partitionBy(UNIT, "b").orderBy(F.when(F.col("b") == 0, F.lpad(F.col(IDX).cast("string"), 18, "0")).otherwise(F.md5(F.concat_ws("|", F.lit(str(seed)), "b", F.col(IDX).cast("string"))))))).select(UNIT, "b", "_o", *mine)
        rest = perms.drop(*mine).withColumn("_o", F.row_number().over(Window.partitionBy(UNIT, "b").orderBy(IDX)))
        fit = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rest.join(src, [UNIT, "b", "_o"])))
        r2 = {r.b: r.r2 for r in fit.groupBy("b").agg((1 - F.sum((F.col(target) - F.col("prediction")) ** 2) / F.nullif(F.var_pop(target) * F.count("*"), F.lit(0.0))).alias("r2")).collect()}
        p = sum(r2[0] - r2[b] <= 0 for b in range(1, permutations + 1)) / permutations
        own = [imp[names.index(m)] for m in mine]
        out.append((c, target, float(sum(own)), int(np.argmax(own)) + 1, float(p), p < alpha))
    return spark.createDataFrame(out, schema)


def choose_test(df: DataFrame, cols: list[str]) -> str:
    """parcorr, robust_parcorr or cmiknn: nonlinear if a RESET test says so in some pair (all ordered pairs at lags 1 to 3, the
    first 20 unordered ones at lag 0) or distance correlation stands where linear correlation does not (first 10 of those),
    and the rows suffice; robust if the first variable is not normal."""
    from .correlation import distance, pearson
    from .adequacy import suggest_test
    from .memory import jarque_bera, reset

    if len(cols) < 2:
        return "parcorr"
    pairs, same = [(a, b) for a in cols for b in cols if a != b], [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    tests = reset(df, pairs, [1, 2, 3]).select("p_value").unionByName(reset(df, same[:20], [0]).select("p_value"))
    low = tests.agg(F.min("p_value")).first()[0]
    n = df.na.drop(subset=cols).count()
    both = distance(df, same[:10]).select(UNIT, "source", "target", F.col("r").alias("d")).join(pearson(df, same[:10]).select(UNIT, "source", "target", F.abs("r").alias("r")), [UNIT, "source", "target"])
    apart = both.where("d > 0.05 and r < 0.05 and d > 3 * r").head(1)
    if apart or (low is not None and low < 0.01):
        return suggest_test(n, len(cols), min(12, max(1, n // 10)), True)
    p = jarque_bera(df, cols[:1]).agg(F.min("p_value")).first()[0]
    return "robust_parcorr" if p is not None and p < 0.01 else "parcorr"


def ci_sensitivity(df: DataFrame, cols: list[str], tests: tuple[str, ...] = ("parcorr", "robust_parcorr"), tau_max: int = 3, alpha: float = 0.05) -> DataFrame:
    """Which tests find each edge; robust: all of them."""
    runs = None
    for t in tests:
        one = pcmci(df, cols, tau_max, alpha, True, t).where("is_significant and source <> target").select("source", "target", F.lit(t).alias("test")).distinct()
        runs = one if runs is None else runs.unionByName(one)
    wide = runs.groupBy("source", "target").pivot("test", list(tests)).agg(F.lit(True))
    found = [F.coalesce(F.col(t), F.lit(False)) for t in tests]
    votes = sum((f.cast("int") for f in found), F.lit(0))
    return wide.select("source", "target", *[f.alias(t) for f, t in zip(found, tests)], votes.alias("n_votes"), (votes == len(tests)).alias("robust"))


def quantiled_strength(te_bits: Column, target_entropy: Column) -> Column:
    return F.least(F.lit(1.0), te_bits / F.nullif(target_entropy, F.lit(0.0)))


def target_entropy(df: DataFrame, col: str) -> DataFrame:
    """Entropy (bits) of min(50, n // 10) equal-width bins."""
    w = Window.partitionBy(UNIT)
    n = F.count(col).over(w)
    bins = F.greatest(F.lit(2), F.least(F.lit(50), F.floor(n / 10)))
    cell = F.least(F.floor((F.col(col) - F.min(col).over(w)) * bins / F.nullif(F.max(col).over(w) - F.min(col).over(w), F.lit(0.0))), bins - 1)
    c = df.where(F.col(col).isNotNull()).select(UNIT, cell.alias("cell")).groupBy(UNIT, "cell").agg(F.count("*").alias("c"))
    return c.groupBy(UNIT).agg(((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")) / math.log(2)).alias("entropy_bits"))
