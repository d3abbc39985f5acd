import numpy as np
import pytest

from chronolink.llm import embedding_dedup as E


def brute(rows, cosine=E.COSINE):
    good = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    n, parent = [0] * len(rows), {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((r[0], n[i], root(r[0]), root(r[0]) == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 20])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.5:
            base = rows[rng.integers(len(rows))][1]
            e = (np.array(base) + rng.normal(size=16) * rng.choice([0, 0.03, 0.05])).tolist()
        else:
            e = rng.normal(size=16).tolist()
        rows.append((i, e, int(rng.integers(3)) if rng.random() < 0.9 else None))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] + [1.0] * 15, 1), (403, [float("nan")] + [1.0] * 15, 1), (404, [1.0, 2.0], 1), (405, [2.0, 4.0], 1), (406, [], 1), (407, [float("inf")] * 16, 1), (408, [3.0], 1), (409, [3.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(tuple(r) for r in E.link(df, block=block).collect()) == brute(rows)
    assert E.link(df.limit(0)).count() == 0


def test_multi_sequence_order_is_by_sum():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    got = list(E.visit(a, b, 1.1))
    want = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5) if a[i] + b[j] <= 1.1)
    assert got == [(i, j) for _, i, j in want]


def test_traversal_reaches_all_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.03])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = [E.codebook(x[:, :8], 8), E.codebook(x[:, 8:], 8)]
    cells = list(zip(E.nearest(x[:, :8], books[0]).tolist(), E.nearest(x[:, 8:], books[1]).tolist()))
    left, right = E.borders(x[:, :8], books[0]), E.borders(x[:, 8:], books[1])
    seen = [set(E.visit(u, v, 0.04 + E.MARGIN)) for u, v in zip(left, right)]
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert len(a) > 1000 and all(cells[j] in seen[i] for i, j in zip(a, b))
    assert np.mean([len(s) for s in seen]) < 64


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1.0, 2.0], 1), (4, [2.0, -1.0], 1), (1, [2.0, -1.0], 2)]
    got = sorted(tuple(r) for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
