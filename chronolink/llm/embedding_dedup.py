"""Embedding near-dedup over an inverted multi-index.

Unit vectors are cut in half; each half has its own codebook, fitted on a
bounded sample, and the product of the two codebooks is a grid of cells. A
vector lies in the cell of its nearest centroids. A query visits cells in
order of the sum of its squared distances to the cells' borders (the
multi-sequence order over two sorted lists): a vector of cosine c or more lies
within sqrt(2-2c), so it is in no cell whose borders are farther in that sum,
and the traversal stops there. The recall that it reaches is therefore 1 by
construction, up to rounding, for which the radius has a margin. What it finds
is verified by the cosine in double precision.

Equal vectors of a label are one entry with a multiplicity. The grid grows with
the entries, to cells of about ``BLOCK`` of them (``MOST_CENTROIDS`` a half bounds
what is broadcast; beyond it cells are split into blocks). A query goes to every
block of its own cell and of the later cells that it visits, where all queries
meet all entries in matrix products, and a link to a later cell counts for both
its ends. A block returns counts per entry and a spanning forest of its links,
never the links themselves, so what it returns grows with its rows.

Null labels, and vectors that are null, zero, or hold null or non-finite
components, link with nothing: n_links 0, component_id their own id. Vectors
of unequal length have no cosine. Repeated ids: each row is a vector, links
between rows of one id count, components are of ids. Other columns are unused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed
from .components import components

COSINE, SAMPLE, BLOCK, MOST_CENTROIDS, MARGIN = 0.98, 20_000, 2048, 1024, 1e-6


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids, from rows spread over the sample."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _squares(x, c).argmin(1)


def borders(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each x to the border that parts its nearest centroid's region from each other one; 0 for its own."""
    d = _squares(x, c)
    own = d.argmin(1)
    gap = np.sqrt(_squares(c, c))[own]
    return np.where(gap > 0, np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / np.maximum(2 * gap, 1e-12), 0) ** 2


def visit(left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence order: pairs (i, j) by left[i] + right[j], rising, up to limit."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))


def forest(linked: np.ndarray, q: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries q and entries p, both ids; linked is their boolean matrix."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        parent.setdefault(i, i)
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    rows, cols = np.nonzero(linked)
    for a, b in zip(q[rows].tolist(), p[cols].tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _units(e: pa.ChunkedArray) -> np.ndarray:
    x = np.asarray(e.combine_chunks().flatten() if isinstance(e, pa.ChunkedArray) else e.flatten(), float).reshape(len(e), -1)
    x = x / np.abs(x).max(1, keepdims=True, initial=0)  # else squares may overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    as_is = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())  # half of what doubles take to send
    e = F.col("embedding") if as_is else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    # -0.0 and 0.0 are equal as grouping keys
    same = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    entries = checkpointed(same.withColumn("dims", F.size("embedding")).withColumn("entry", F.monotonically_increasing_id()))
    n = entries.count()
    own = rows.select("vec_id")
    if not n:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    k = int(np.clip(round((n / block) ** 0.5), 1, MOST_CENTROIDS))
    share = min(1.0, sample / n)
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    picked = entries.where(F.pmod(F.xxhash64("entry", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("dims", "embedding").limit(2 * sample).toArrow()
    lengths = picked["dims"].to_numpy()
    for dims in [r[0] for r in entries.select("dims").distinct().collect()]:
        at = np.flatnonzero(lengths == dims)
        x = _units(picked["embedding"].take(at)) if len(at) else np.zeros((1, dims))
        books[dims] = (codebook(x[:, : dims // 2], k), codebook(x[:, dims // 2 :], k))
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # 2 * MOST_CENTROIDS centroids a length
    limit = 2 - 2 * cosine + MARGIN

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cells, visits = np.zeros(batch.num_rows, np.int64), [[] for _ in dims]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _units(batch.column("embedding").take(pa.array(at)))
                halves = [x[:, : d // 2], x[:, d // 2 :]]
                a, b = (nearest(h, c) for h, c in zip(halves, books[d]))
                cells[at] = a * MOST_CENTROIDS + b
                left, right = (borders(h, c) for h, c in zip(halves, books[d]))
                for r, u, v in zip(at, left, right):
                    visits[r] = [c for i, j in visit(u, v, limit) if (c := i * MOST_CENTROIDS + j) >= cells[r]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(visits, pa.list_(pa.int64()))], names=[*batch.schema.names, "cell", "visits"])

    schema = T.StructType([*entries.schema.fields, T.StructField("cell", T.LongType()), T.StructField("visits", T.ArrayType(T.LongType()))])
    placed = checkpointed(entries.mapInArrow(place, schema))
    cell = ["label", "dims", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    stored = placed.join(sizes, cell).select(*cell, F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int").alias("block"), "entry", "rep", "copies", "embedding", F.lit(False).alias("asks"), F.lit(False).alias("both"))
    asking = placed.select("label", "dims", F.col("cell").alias("_own"), F.explode("visits").alias("cell"), "entry", "rep", "copies", "embedding").join(sizes, cell)
    asking = asking.select(*cell, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "entry", "rep", "copies", "embedding", F.lit(True).alias("asks"), (F.col("cell") > F.col("_own")).alias("both"))

    def meet(t: pa.Table) -> pa.Table:
        asks = np.asarray(t["asks"])
        q, p = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        out: dict[str, list] = {"entry": [], "a": [], "b": [], "n": []}
        if q.num_rows and p.num_rows:
            y, ids, copies = _units(p["embedding"]), p["rep"].to_numpy(), p["copies"].to_numpy()
            entry_p, met_p = p["entry"].to_numpy(), np.zeros(p.num_rows, np.int64)
            for lo in range(0, q.num_rows, 1024):
                part = q.slice(lo, 1024)
                x, reps, entry = _units(part["embedding"]), part["rep"].to_numpy(), part["entry"].to_numpy()
                linked = (x @ y.T >= cosine) & (entry[:, None] != entry_p[None, :])
                count, both = linked @ copies, np.asarray(part["both"])
                met_p += (part["copies"].to_numpy() * both) @ linked
                some = np.flatnonzero(count)
                if len(some):
                    out["entry"] += entry[some].tolist()
                    out["n"] += count[some].tolist()
                    out["a"] += [None] * len(some)
                    out["b"] += [None] * len(some)
                    pairs = forest(linked, reps, ids)
                    out["entry"] += [None] * len(pairs)
                    out["n"] += [0] * len(pairs)
                    out["a"] += [a for a, _ in pairs]
                    out["b"] += [b for _, b in pairs]
            some = np.flatnonzero(met_p)
            out["entry"] += entry_p[some].tolist()
            out["n"] += met_p[some].tolist()
            out["a"] += [None] * len(some)
            out["b"] += [None] * len(some)
        return pa.table({"entry": pa.array(out["entry"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64())})

    met = checkpointed(stored.unionByName(asking).groupBy(*cell, "block").applyInArrow(meet, "entry long, n long, a long, b long"))
    counts = met.where("entry is not null").groupBy("entry").agg(F.sum("n").alias("n"))
    per_entry = entries.join(counts, "entry", "left").select("label", "embedding", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = checkpointed(good.join(per_entry, ["label", "embedding"]).select("vec_id", "rep", "n_links"))
    joined = met.where("a is not null").select("a", "b").unionByName(linked.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    classes = components(joined).withColumnRenamed("id", "vec_id")
    rest = rows.join(linked.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    poor = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine, F.lit(False))).join(linked.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    everything = linked.select("vec_id", "n_links").unionByName(rest).unionByName(poor).join(classes, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return everything.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


#: For small tables only: it compares all pairs of a label.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {COSINE}),
c(id, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.root, vec_id) AS component_id, coalesce(m.root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
