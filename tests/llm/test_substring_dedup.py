import hashlib
import random
import re

import numpy as np
import pytest

from chronolink.llm import substring_dedup as S


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(docs, window=S.WINDOW):
    first = {}
    split = [(i, words(t)) for i, t in docs]
    for i, ws in split:
        if i is not None:
            for j in range(len(ws) - window + 1):
                g = tuple(ws[j : j + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, ws in split:
        gone = set()
        if i is not None:
            for j in range(len(ws) - window + 1):
                if first[tuple(ws[j : j + window])] < i:
                    gone.update(range(j, j + window))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    v = [f"w{k}" for k in range(40)]
    passages = [rng.choices(v, k=rng.randint(10, 60)) for _ in range(5)]
    docs = []
    for i in range(n):
        ws = rng.choices(v, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            at = rng.randint(0, len(ws))
            ws[at:at] = p[a : a + rng.randint(8, 60)]
        docs.append((rng.choice([i, i, 7]), rng.choice([" ", "\n", "\t "]).join(ws)))
    return docs + [(None, docs[0][1]), (200, None), (201, ""), (202, "é " * 30), (203, "é " * 40), (204, "é " * 40), (205, docs[1][1]), (206, docs[1][1])]


@pytest.mark.parametrize("seed,chunk", [(0, 4 << 20), (1, 700), (2, 150)])
def test_equals_brute_force(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.digest(df).collect()), key=str) == brute(docs)


def test_factors_are_true_and_columns_pass(spark):
    docs = [(i, t) for i, t in enumerate(t for _, t in corpus(5))]
    text = dict(docs)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, kept_text string, extra int")
    rows = S.dedup(df).collect()
    assert len(rows) == len(docs) and rows[0].extra == 1
    for r in rows:
        ws, covered = words(r.text), set()
        for f in r.factors:
            assert f.words >= S.WINDOW and f.source < r.doc_id
            assert ws[f.first : f.first + f.words] == words(text[f.source])[f.source_first : f.source_first + f.words]
            covered.update(range(f.first, f.first + f.words))
        assert len(covered) == r.n_removed and r.kept_text == " ".join(w for j, w in enumerate(ws) if j not in covered)
    assert S.digest(df.limit(0)).count() == 0


def test_equal_hashes_of_different_words_are_told_apart():
    u = lambda *x: np.array(x, np.uint64)
    h, check, doc, pos, many = S._least(u(9, 5, 5, 5, 5), u(1, 4, 2, 1, 2), np.array([3, 8, 6, 7, 2]), np.array([0, 1, 2, 3, 4]))
    assert h.tolist() == [5, 5, 5, 9] and check.tolist() == [1, 2, 4, 1] and doc.tolist() == [7, 2, 8, 3] and pos.tolist() == [3, 4, 1, 0]
    assert many.tolist() == [False, True, False, False]
    found, i = S._find(h, check, u(5, 5, 9, 5, 7), u(4, 3, 1, 1, 1))
    assert found.tolist() == [True, False, True, True, False] and i[found].tolist() == [2, 3, 0]
    ws = [f"w{k}" for k in range(40)]
    import pyarrow as pa

    p = S.Parsed(pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [" ".join(ws), " ".join(ws[:20] + ["x"] + ws[21:])]}), 0, 1, 13, 7)
    c, same = p.checks(np.arange(len(p.at))), p.row == 0
    assert ((c[same] == c[~same]) == (p.hashes()[same] == p.hashes()[~same])).all() and (c[same] == c[~same]).sum() == 8 + 7
