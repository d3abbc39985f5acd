import itertools
import random
import zlib

import numpy as np

from chronolink.llm import language_id as L

VOCAB = {"aa": "the this that with from have which their".split(), "bb": "der die das und nicht eine schön für".split(), "cc": "это что как было когда только".split()}


def make(lang, n, seed):
    return " ".join(random.Random(seed).choices(VOCAB[lang], k=n))


def rows():
    return [(i, make(k, 30, i), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)] + [(1000, None, "aa"), (1001, "", None), (1002, "123 --- 45", "bb"), (None, "the that", "aa"), (1003, "ελλάδα", None)]


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(0)
    first = np.array([0, 4, 4, 5, 10])
    scores = rng.normal(size=(10, 3)).astype(np.float32) * 3
    got = L.viterbi(scores, first, 1.5)
    for a, b in zip(first, first[1:]):
        value = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))
        if b > a:
            best = max(itertools.product(range(3), repeat=b - a), key=value)
            assert abs(value(best) - value(got[a:b])) < 1e-4


def test_held_out_accuracy_edges_and_spans(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    got = L.digest(docs).collect()
    assert len(got) == len(rows())
    for r, (i, t, lang) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows(), key=lambda r: (r[0] is None, r[0]))):
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 3 == 1)
        if t and any(c.isalpha() for c in t):
            assert r.lang_pred == lang or i == 1003
            assert 0 < r.score <= 1
        else:
            assert r.lang_pred == "und" and r.score == 0
    model = L.fit(docs.where(~L.held_out()))
    mixed = spark.createDataFrame([(1, make("aa", 12, 1) + " " + make("cc", 9, 2) + " " + make("bb", 20, 3), "x")], "doc_id long, text string, score string")
    r = L.identify(mixed, model).first()
    assert [tuple(s) for s in r.lang_spans] == [("aa", 0, 12), ("cc", 12, 21), ("bb", 21, 41)] and r.lang_pred == "bb"
    assert L.digest(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.digest(docs.withColumn("lang", L.F.lit(None).cast("string"))).collect()} == {"und"}


def test_scripts():
    assert L.NAMES[L.script("привет")] == "cyrillic" and L.script("12") == -1 and L.NAMES[L.script("中文a")] == "han"


def test_two_hundred_languages():
    rng = np.random.default_rng(4)
    first = np.array([0, 7, 9])
    scores = rng.normal(size=(9, 200)).astype(np.float32)
    scores[:7, 150] += 20
    scores[7:, 199] += 20
    assert L.viterbi(scores, first).tolist() == [150] * 7 + [199] * 2
