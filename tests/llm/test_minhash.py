import random

import numpy as np
import pyarrow as pa
import pytest

from chronolink.llm import minhash as M
from chronolink.llm.components import components


def shingle_set(t):
    ws = (t or "").split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(seed, n=40):
    rng = random.Random(seed)
    v = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(n):
        base = rng.choices(v, k=rng.randint(40, 150))
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            ws = list(base)
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(v)
            docs.append(rng.choice([" ", "\n"]).join(ws))
    rng.shuffle(docs)
    return docs + [None, "", "", "a b", "a  b", "a b c"]


def brute(texts, similar=0.8):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similar:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(5)
    want = brute(texts)
    got = {r.doc_id: r for r in M.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    # the weighted similarity may link more than the plain one; what it adds must be close to the limit
    sets = [shingle_set(t) for t in texts]
    for i, w in enumerate(want):
        assert got[i].class_id == got[w].class_id and got[i].kept == (got[i].class_id == i)
        if got[i].class_id != w:
            assert max(jaccard(sets[i], sets[j]) for j in got if got[j].class_id == got[i].class_id and want[j] != w) > 0.7


def test_sample_agreement_estimates_weighted_jaccard():
    rng = random.Random(3)
    a = [f"w{k}" for k in rng.choices(range(10_000), k=400)]
    b = a[:300] + [f"v{k}" for k in range(60)] + a[:300] * 2
    doc, h, n, _ = M.shingles(pa.array([" ".join(a), " ".join(b)]))
    for w, level in ((np.ones(len(h)), None), (n.astype(float), M.levels(n.astype(np.float32)))):
        x, y = (dict(zip(h[doc == d].tolist(), w[doc == d])) for d in (0, 1))
        want = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        sig = M.samples(doc, h, level)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.2


def test_document_frequency_of_frequent_shingles_is_exact(spark):
    rng = random.Random(4)
    lines = [" ".join(f"l{k}x{j}" for j in range(6)) for k in range(30)]
    texts = [" ".join([*(x for k, x in enumerate(lines) if rng.random() < 1 / (k + 1)), *(f"u{i}y{j}" for j in range(8))]) for i in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    _, h, _, _ = M.shingles(pa.array(texts))
    u, n = np.unique(h, return_counts=True)
    for sketch in (M.SKETCH, 64):  # the small one lets everything pass to the exact count
        got, df, total = M.document_frequency(docs, sketch=sketch)
        assert total == 700 and got.tolist() == u[n >= 11].tolist() and df.tolist() == n[n >= 11].tolist()
    w = M.Weights(got, df, total)(u, np.full(len(u), 3))
    assert (w[n < 11] == 3).all() and (w[n == n.max()] < 2).all() and (w >= 1.5).all()


def sets_with_links(seed, m=120):
    """Shingle sets of which many are alike, their weights, and the components of all links."""
    rng = np.random.default_rng(seed)
    base = [rng.choice(1 << 40, 60, replace=False).astype(np.uint64) for _ in range(6)]
    sets, weights = [], {}
    for _ in range(m):
        x = base[rng.integers(6)].copy()
        x[rng.choice(60, rng.integers(0, 12), replace=False)] = rng.choice(1 << 40, 1).astype(np.uint64) + np.arange(1, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([x, rng.choice(1 << 40, rng.integers(0, 8)).astype(np.uint64)])))
    w = [np.array([weights.setdefault(int(y), 0.5 + 0.5 * rng.random()) for y in x], np.float32) * rng.integers(1, 3, len(x)) for x in sets]
    parent = list(range(m))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(m):
        for j in range(i):
            x, y = dict(zip(sets[i].tolist(), w[i])), dict(zip(sets[j].tolist(), w[j]))
            both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            if both >= 0.8 * (w[i].sum() + w[j].sum() - both) or jaccard(set(x), set(y)) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sets, w, [root(i) for i in range(m)]


@pytest.mark.parametrize("seed", range(4))
def test_joining_links_give_all_components(seed):
    sets, w, want = sets_with_links(seed)
    n, ids = np.array([len(x) for x in sets]), np.arange(len(sets))
    h, w = np.concatenate(sets), np.concatenate(w)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(pairs):
        for a, b in pairs:
            a, b = root(a), root(b)
            assert a != b
            parent[max(a, b)] = min(a, b)

    first = M.joining_links(ids, n, h, w, ids)
    join(first)
    assert len({*want}) < len(want) - 10 and [root(i) for i in ids] == want
    # some sets ask the others: all links between the two kinds are met
    asks = ids % 3 == 0
    parent = list(range(len(sets)))
    for part in (~asks, asks):
        t = np.repeat(part, n)
        join(M.joining_links(ids[part], n[part], h[t], w[t], ids[part]))
    join([p for p in M.joining_links(ids, n, h, w, np.array([root(i) for i in ids]), asks) if root(p[0]) != root(p[1])])
    assert [root(i) for i in ids] == want


def test_split_clusters_equal_whole_ones(spark, monkeypatch):
    texts = corpus(5, 8)
    rng = random.Random(9)
    base = [f"z{k}" for k in range(120)]
    for i in range(90):  # one large group, some of it too far from the rest
        ws = list(base)
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3, 5, 8])):
            ws[k] = f"e{i}x{k}"
        texts.append(" ".join(ws))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    whole = {r.doc_id: r.class_id for r in M.near_duplicates(docs).collect()}
    monkeypatch.setattr(M, "BLOCK_TOKENS", 1500)
    monkeypatch.setattr(M, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 2000)
    assert {r.doc_id: r.class_id for r in M.near_duplicates(docs).collect()} == whole
    assert {i: w for i, w in enumerate(brute(texts))} == whole


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(None, 3), (5, 5)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}


def test_edges(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "a b c d e f", 3), (4, "a b c d e f", 4), (5, None, 5)], "doc_id long, text string, n int")
    got = sorted(tuple(r)[:3] for r in M.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True)]
    assert sorted(r.n for r in M.keep_one(docs).collect()) == [1, 2, 3, 5]
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_plain_link_of_low_weighted_similarity_is_found(spark):
    rng = random.Random(8)
    ws = [f"w{rng.randrange(5000)}" for _ in range(300)]
    page, more = " ".join(ws), " ".join(ws + ws[-60:] * 10)
    assert jaccard(shingle_set(page), shingle_set(more)) > 0.9
    docs = spark.createDataFrame([(1, page), (2, more), (3, " ".join(f"v{k}" for k in range(80)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in M.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_repeated_ids_and_long_texts(spark):
    rng = random.Random(10)
    a, b = (" ".join(f"{c}{rng.randrange(9000)}" for _ in range(60)) for c in "ab")
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(300_000))
    rows = [(7, a), (7, b), (7, ""), (2, a + " x"), (9, b + " y"), (4, long), (5, long + " z"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted({(r.doc_id, r.class_id) for r in M.near_duplicates(docs).collect() if r.doc_id is not None})
    assert got == [(2, 2), (4, 4), (5, 4), (7, 2), (9, 2)]
