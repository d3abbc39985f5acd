"""Graph recovery against known edges, agreement of edge sets, graph properties. Edge sets are tables (source, target)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import average_rank


def undirected(e: DataFrame, *keys: str) -> DataFrame:
    return e.where("source <> target").select(*keys, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def binary(found: DataFrame, truth: DataFrame, directed: bool = True, by: str = "method", methods: list[str] | None = None) -> DataFrame:
    """Per method: tp, fp, fn, precision, recall, f1, fdr, n_reversals, shd. A method of ``methods`` that found nothing has
    recall 0 and lacks every true edge."""
    run = found.select(by)
    methods = (run if methods is None else run.unionByName(found.sparkSession.createDataFrame([(m,) for m in methods], f"{by} string"))).distinct()
    f = (found.select(by, "source", "target").distinct() if directed else undirected(found, by)).withColumn("f", F.lit(1))
    t = truth.select("source", "target").distinct() if directed else undirected(truth)
    t = methods.crossJoin(F.broadcast(t)).withColumn("t", F.lit(1))  # a row for each method and true edge
    j = f.join(t, [by, "source", "target"], "full_outer")
    back = j.where("f is null").select(by, F.col("source").alias("target"), F.col("target").alias("source"), F.lit(1).alias("rev"))
    j = j.join(back, [by, "source", "target"], "left")
    pair = F.when(F.col("t").isNull() & F.col("rev").isNotNull(), F.struct(F.least("source", "target"), F.greatest("source", "target")))
    g = j.groupBy(by).agg(F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"), F.countDistinct(pair).alias("n_reversals"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("fdr", _ratio(F.col("fp"), F.col("tp") + F.col("fp")))
    return out.withColumn("shd", F.col("fp") + F.col("fn") - (F.col("n_reversals") if directed else 0)) if directed else out.drop("n_reversals").withColumn("shd", F.col("fp") + F.col("fn"))


def ranking(scores: DataFrame, truth: DataFrame, names: list[str], by: str = "method") -> DataFrame:
    """AUROC and average precision per method over all ordered pairs of names; score 0 where a pair has none."""
    spark = scores.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "source string, target string")
    best = scores.groupBy(by, "source", "target").agg(F.max("score").alias("score"))
    every = scores.select(by).distinct().crossJoin(F.broadcast(pairs)).join(best, [by, "source", "target"], "left").join(F.broadcast(truth.select("source", "target").distinct().withColumn("t", F.lit(1))), ["source", "target"], "left")
    every = every.select(by, F.coalesce("score", F.lit(0.0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    ranked = every.withColumn("rk", average_rank(F.col("s"), by))
    pos, neg = F.sum("t"), F.count("*") - F.sum("t")
    auroc = ranked.groupBy(by).agg(((F.sum(F.when(F.col("t") == 1, F.col("rk")).otherwise(0.0)) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auroc"))
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    steps = every.groupBy(by, "s").agg(F.sum("t").alias("tp"), F.count("*").alias("n")).withColumn("ct", F.sum("tp").over(w)).withColumn("cn", F.sum("n").over(w)).withColumn("p", F.sum("tp").over(Window.partitionBy(by)))
    ap = steps.groupBy(by).agg(F.sum(F.col("tp") / F.nullif(F.col("p"), F.lit(0)) * F.col("ct") / F.col("cn")).alias("auprc"))
    return auroc.join(ap, by)


def chance(truth: DataFrame, names: list[str]) -> DataFrame:
    """What guessing gets: precision m_true / m_max over unordered pairs."""
    d = len(names)
    return undirected(truth).agg(F.lit(d).alias("n_vars"), F.count("*").alias("m_true"), F.lit(d * (d - 1) // 2).alias("m_max")).withColumn("chance_precision", F.col("m_true") / F.nullif(F.col("m_max"), F.lit(0)))


def chance_recall(found: DataFrame, names: list[str], by: str = "method") -> DataFrame:
    d = len(names)
    return undirected(found, by).groupBy(by).agg((F.count("*") / F.lit(max(1, d * (d - 1) // 2))).alias("expected_recall"))


def jaccard(found: DataFrame, by: str = "method", skeleton: bool = True) -> DataFrame:
    """Jaccard index of each pair of methods' edge sets; 0 where both are empty."""
    e = undirected(found, by) if skeleton else found.select(by, "source", "target").distinct()
    n = e.groupBy(by).agg(F.count("*").alias("n"))
    m = found.select(by).distinct().join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pairs = m.select(F.col(by).alias("a"), F.col("n").alias("na")).join(m.select(F.col(by).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    both = e.select(F.col(by).alias("a"), "source", "target").join(e.select(F.col(by).alias("b"), "source", "target"), ["source", "target"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    out = pairs.join(both, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.withColumn("jaccard", _ratio(F.col("common"), F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "common", "jaccard")


def set_jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: Jaccard index of two link sets (1 if both are empty), and what only one of them has."""
    j = a.select(*keys).distinct().withColumn("x", F.lit(1)).join(b.select(*keys).distinct().withColumn("y", F.lit(1)), keys, "full_outer")
    return j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count_if(F.col("y").isNull()).alias("only_first"), F.count_if(F.col("x").isNull()).alias("only_second"), F.count("*").alias("n")).select("both", "only_first", "only_second", F.coalesce(F.col("both") / F.nullif(F.col("n"), F.lit(0)), F.lit(1.0)).alias("jaccard"))


def two_cycles(e: DataFrame) -> DataFrame:
    return e.select("source", "target").distinct().join(e.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct(), ["source", "target"], "left_semi").where("source < target")


def is_dag(e: DataFrame) -> DataFrame:
    """One row: whether no variable reaches itself, by the transitive closure; the path length is bounded by the variables."""
    view = f"_edges_{uuid.uuid4().hex}"
    e.select("source", "target").distinct().createOrReplaceTempView(view)
    n = e.select("source").union(e.select("target")).distinct().count()
    return e.sparkSession.sql(f"""WITH RECURSIVE r(s, t, k) AS (SELECT source, target, 1 FROM {view} UNION ALL SELECT DISTINCT r.s, d.target, r.k + 1 FROM r JOIN {view} d ON r.t = d.source WHERE r.k < {max(1, n)})
    SELECT count_if(s = t) = 0 AS is_dag FROM (SELECT DISTINCT s, t FROM r)""")


def aid_status(found: DataFrame, truth: DataFrame) -> str:
    """Whether an adjustment distance is defined: both graphs without two-cycles, the true one acyclic."""
    if not is_dag(truth).first()[0]:
        return "reference_not_dag"
    return "non_simple_graph" if two_cycles(found).head(1) else "ok"


def parent_aid(found: set[tuple[str, str]], truth: set[tuple[str, str]], names: list[str]) -> float:
    """Parent adjustment distance: the share of ordered pairs (x, y) whose effect, adjusted for x's parents in the found
    graph, is wrong in the true one (Henckel et al.)."""
    parents = lambda g, x: {a for a, b in g if b == x}

    def reach(g: set, x: str) -> set:
        out, todo = set(), [x]
        while todo:
            for a, b in g:
                if a == todo[-1] and b not in out:
                    out.add(b)
                    todo.insert(0, b)
            todo.pop()
        return out

    def separated(g: set, x: str, y: str, z: set) -> bool:
        """d-separation of x and y given z once x's outgoing edges are cut."""
        g = {(a, b) for a, b in g if a != x}
        anc = set(z)
        grown = True
        while grown:
            more = {a for a, b in g if b in anc} - anc
            anc |= more
            grown = bool(more)
        seen, todo = set(), [(x, "up")]
        while todo:
            v, way = todo.pop()
            if (v, way) in seen:
                continue
            seen.add((v, way))
            if v == y:
                return False
            if way == "up" and v not in z:
                todo += [(a, "up") for a, b in g if b == v] + [(b, "down") for a, b in g if a == v]
            elif way == "down":
                if v not in z:
                    todo += [(b, "down") for a, b in g if a == v]
                if v in anc:
                    todo += [(a, "up") for a, b in g if b == v]
        return True

    wrong = 0
    for x in names:
        z = parents(found, x)
        below = reach(truth, x)
        for y in names:
            if x != y:
                if y in z:
                    wrong += y in below
                else:
                    wrong += bool(z & below) or not separated(truth, x, y, z)
    return wrong / max(1, len(names) * (len(names) - 1))


def tier_precision(c: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision of unordered edges per tier."""
    j = undirected(c, "tier").join(F.broadcast(undirected(truth).withColumn("t", F.lit(1))), ["source", "target"], "left")
    return j.groupBy("tier").agg(F.count("*").alias("n_edges"), F.count("t").alias("n_true"), (F.count("t") / F.count("*")).alias("precision"))


def vote_precision(c: DataFrame, truth: DataFrame, thresholds: list[int]) -> DataFrame:
    k = c.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    j = undirected(c, "vote_count").groupBy("source", "target").agg(F.max("vote_count").alias("v")).join(F.broadcast(k), F.col("v") >= F.col("threshold"))
    j = j.join(F.broadcast(undirected(truth).withColumn("t", F.lit(1))), ["source", "target"], "left")
    return j.groupBy("threshold").agg(F.count("*").alias("n_edges"), (F.count("t") / F.count("*")).alias("precision"))


def summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and deviation per key, and of all rows under ALL, in one pass over grouping sets."""
    g = df.rollup(key).agg(F.grouping(key).alias("_g"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    return g.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col(key)).alias(key), "mean", "std", "n")
