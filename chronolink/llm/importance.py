"""Quality by importance resampling.

Two generative models over hashed n-grams (words and neighbouring pairs of
them, in ``BUCKETS`` buckets): the raw model counts all documents, the target
model the sampled documents of known quality. A document's log importance
weight per n-gram is the mean log ratio of the models over its n-grams;
scaled by ``SCALE`` and with standard Gumbel noise added, its k largest keys
are a sample of k documents without replacement, in proportion to the weights.
The noise comes from a hash of the id and the text, so a rerun draws alike.
k is the documents' number times the share of the target class among labelled
rows, so the draw keeps as many as there should be good ones.

Tokens are runs of letters and digits, or runs of other characters that are no
white space, in lower case for ASCII. Null or empty text has no n-grams: its
weight is the smallest there is, log ratio ``FLOOR``. Equal keys (repeated
rows) are ordered by doc_id; rows equal in both are drawn alike as far as k
allows. A doc_id with two labels counts as good. Without target rows the raw model is the target: a uniform draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import appended, checkpointed, extend, without

BUCKETS, TARGET_ROWS, SCALE, SMOOTH, FLOOR = 1 << 16, 10_000, 20.0, 1.0, -20.0
KEY_BINS = 1 << 12

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 others
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buckets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every token and token pair."""
    data, offs = text.utf8(arr)
    kind, data = _KIND[data], _LOWER[data]
    s1, e1 = text.runs(kind == 1, offs)
    s2, e2 = text.runs(kind == 2, offs)
    s, e = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    h = text.span_hashes(data, s, e)
    first = np.searchsorted(s, offs)
    doc, ok = text.owner(first), text.inside(first, 2, len(h))
    pairs = text.grams(h, 2)[ok]
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([doc, doc[: len(ok)][ok]]), np.concatenate([h & mask, pairs & mask]).astype(np.int64)


@dataclass
class Model:
    log_ratio: np.ndarray
    share: float


def fit(docs: DataFrame, labels: DataFrame, rows: int = TARGET_ROWS) -> Model:
    """Count n-grams of all documents, and of about ``rows`` labelled good ones at most, taken by a hash of their ids."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_good")).where("_id is not null and _good in (0, 1)").groupBy("_id").agg(F.max("_good").alias("_good"))
    n = {r[0]: r[1] for r in labels.groupBy("_good").count().collect()}
    unit = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("dsir")), F.lit(1 << 20)) / float(1 << 20)
    taken = labels.where((F.col("_good") == 1) & (unit < min(1.0, rows / max(1, n.get(1, 0)))))  # about ``rows`` rows of two numbers
    marked = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("text")).join(F.broadcast(taken), "_id", "left").select(F.coalesce("_good", F.lit(0)).alias("good"), "text")
    step = BUCKETS // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in text.slices(batch, "text"):
                good = part.column(0).to_numpy()
                doc, b = buckets(part.column(1))
                total[0] += np.bincount(b, minlength=BUCKETS)
                if good.any():
                    total[1] += np.bincount(b[good[doc] == 1], minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([total[:, lo : lo + step].tobytes() for lo in range(0, BUCKETS, step)], pa.binary())], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.frombuffer(raw.as_buffer(), np.int64)
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "n"])

    partial = marked.mapInArrow(count, "part int, n binary").repartition(16, "part").mapInArrow(add, "part int, n binary")
    total = np.zeros((2, BUCKETS), np.int64)
    for r in partial.collect():  # one row for each sixteenth of the buckets
        total[:, r.part * step : (r.part + 1) * step] += np.frombuffer(r.n, np.int64).reshape(2, step)
    if not total[1].any():
        total[1] = total[0]
    p = (total + SMOOTH) / (total + SMOOTH).sum(1, keepdims=True)
    labelled = sum(n.values())
    return Model(np.log(p[1] / p[0]), n.get(1, 0) / labelled if labelled else 1.0)


def weigh(docs: DataFrame, model: Model, text_col: str = "text", result: str = "log_ratio") -> DataFrame:
    """docs with ``result``: the mean log ratio of the models over a text's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model.log_ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for part in text.slices(batch, text_col):
                doc, b = buckets(part.column(part.schema.get_field_index(text_col)))
                n = np.bincount(doc, minlength=part.num_rows)
                total = np.bincount(doc, ratio[b], part.num_rows)
                yield appended(part, **{result: pa.array(np.where(n > 0, total / np.maximum(n, 1), FLOOR), pa.float64())})

    return extend(without(docs, result), [T.StructField(result, T.DoubleType())], run)


def gumbel_top(rows: DataFrame, key: str, order: list[str], k: int, result: str = "kept") -> DataFrame:
    """rows with ``result``: whether the row is among the k with the largest keys, equal keys by ``order``. A histogram of
    the keys finds the bin that holds the k-th; within it the histogram is refined until the bin is small, and only
    the rows of that bin are ranked."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return rows.withColumn(result, F.lit(False))
    above, inside, col = 0, rows.count(), F.col(key)
    if k >= inside:
        return rows.withColumn(result, F.lit(True))
    top = float("inf")
    while inside > KEY_BINS and high > low:
        width = (high - low) / KEY_BINS
        b = F.least(F.lit(KEY_BINS - 1), F.floor((col - low) / width)).cast("int")
        within = rows.where((col >= low) & (col <= high) & (col < top))
        counts = within.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("b")).collect()  # KEY_BINS rows at most
        for r in counts:
            if above + r.n >= k:
                break
            above += r.n
        if r.n == inside:
            break
        inside, low, high = r.n, r.lo, r.hi
    edge = rows.where((col >= low) & (col <= high)).select(key, *order)
    at = edge.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(key), *order))).where(F.col("_r") == k - above).first()
    last = F.struct(*[F.lit(at[c]).alias(c) for c in order])
    return rows.withColumn(result, (col > at[key]) | ((col == at[key]) & (F.struct(*[F.col(c).alias(c) for c in order]) <= last)))


def resample(docs: DataFrame, model: Model, share: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, log_ratio, key and kept of every document."""
    unit = (F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    rows = weigh(docs.select("doc_id", "text", unit.alias("_u")), model)
    rows = checkpointed(rows.select("doc_id", "log_ratio", (F.lit(SCALE) * F.col("log_ratio") - F.log(-F.log("_u"))).alias("key")))
    return gumbel_top(rows, "key", ["doc_id"], round(rows.count() * (model.share if share is None else share)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of op8: doc_id, log_ratio, key, kept."""
    return resample(docs, fit(docs, labels))
