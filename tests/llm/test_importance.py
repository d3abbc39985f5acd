import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolink.llm import importance as I


def rows(n=300):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        ws = rng.choices([f"fine{k}" for k in range(60)], k=40) if good else rng.choices([f"junk{k} $$" for k in range(60)], k=40)
        docs.append((i, " ".join(ws)))
        if i % 2 == 0:
            labels.append((i, int(good)))
    return docs, labels


def test_buckets_are_those_of_tokens_and_pairs():
    got = I.buckets(pa.array(["Ab1 $$x é", None, "ab1"]))
    n = Counter(got[0].tolist())
    tokens = re.findall(r"[A-Za-z0-9\x80-￿]+|[^A-Za-z0-9\x80-￿\s]+", "Ab1 $$x é")
    assert n == {0: 2 * len(tokens) - 1, 2: 1}
    assert got[1][0] == got[1][len(tokens)]  # Ab1 and ab1


def test_log_ratio_equals_plain_counting(spark):
    docs, labels = rows()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = I.fit(d, lab)
    raw, target = np.zeros(I.BUCKETS), np.zeros(I.BUCKETS)
    good = {i for i, q in labels if q}
    for i, t in docs:
        b = np.bincount(I.buckets(pa.array([t]))[1], minlength=I.BUCKETS)
        raw += b
        target += b * (i in good)
    want = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    assert np.allclose(model.log_ratio, want) and math.isclose(model.share, len(good) / len(labels))
    got = I.digest(d, lab).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept) == round(len(docs) * model.share) and sum(i % 5 != 0 for i in kept) >= 0.97 * len(kept)
    first = next(r for r in got if r.doc_id == 0)
    assert math.isclose(first.log_ratio, want[I.buckets(pa.array([docs[0][1]]))[1]].mean())


def test_top_equals_sorting_with_ties(spark):
    rng = random.Random(1)
    data = [(i, float(rng.choice([rng.random(), 0.5, 0.25]))) for i in range(30_000)]
    df = spark.createDataFrame(data, "doc_id long, key double")
    for k in (0, 1, 7, 12_000, 29_999, 30_000, 40_000):
        got = {r.doc_id for r in I.gumbel_top(df, "key", ["doc_id"], k).where("kept").collect()}
        assert got == {i for _, i in sorted((-x, i) for i, x in data)[:k]}, k


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (1, None, 2.0), (2, "", None), (None, "a b", 1.0)], "doc_id long, text string, key double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert I.digest(docs, none).where("kept").count() == 4 and I.digest(docs.limit(0), none).count() == 0
    assert I.digest(docs, none).where(F.col("log_ratio") == I.FLOOR).count() == 3
