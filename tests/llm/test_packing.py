import itertools
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronolink.llm import packing
from chronolink.llm.common import tokenizer_path


def optimum(lengths, size):
    """Fewest bins, by trying all ways."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= size and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_bound_is_below_and_best_fit_above_the_optimum():
    rng = random.Random(3)
    for _ in range(150):
        size = rng.choice([10, 12, 30])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(1, 9))), reverse=True)
        bins, offsets, n = packing.best_fit(np.array(lengths), size)
        best = optimum(lengths, size)
        assert packing.lower_bound(np.array(lengths), size) <= best <= n
        for b in range(n):
            at = 0
            for o, x in sorted((o, x) for k, o, x in zip(bins, offsets, lengths) if k == b):
                assert o == at
                at += x
            assert at <= size
    assert packing.lower_bound(np.array([6] * 5), 10) == 5


@pytest.mark.parametrize("part", [50_000, 7])
def test_every_piece_once_and_gapless(spark, part):
    rng = random.Random(5)
    texts = [None, "", "a b", *(" ".join(["word"] * rng.randint(1, 90)) for _ in range(60))]
    docs = spark.createDataFrame([(i if i else None, x, "n") for i, x in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack(docs, size=32, part=part).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 32):
            cut = np.array(ids[k : k + 32], "<u4").tobytes()
            want[(i if i else None, k // 32)] = (k, len(cut) // 4, zlib.crc32(cut))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 32
    bound = packing.lower_bound(np.array([n for _, n, _ in want.values()]), 32)
    assert len(bins) <= bound + (1 if part > 100 else 3)
    assert packing.pack(docs.limit(0)).count() == 0


def test_rounds_go_on_while_bins_are_saved(spark, monkeypatch):
    turns, real = [], packing._packed

    def packed(rows, size, part, turn):
        turns.append(turn)
        return real(rows, size, part, turn)

    monkeypatch.setattr(packing, "_packed", packed)
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, int(x), i) for i, x in enumerate(rng.integers(1, 33, 3000))]
    df = spark.createDataFrame(rows, packing._PIECES)
    got = packing.pack_pieces(df, 32, 5).where("offset = 0").count()
    assert len(turns) > 5 and got < packing.pack_pieces(df, 32, 3000).where("offset = 0").count() * 1.1


def test_a_worker_of_the_pipeline_remembers_a_bounded_number_of_words(spark, monkeypatch):
    made = []

    class Seen(packing.Codec):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    class Docs:
        """Stands in for documents: gives the function that their rows would go through."""

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(packing, "Codec", Seen)
    monkeypatch.setattr(packing, "checkpointed", lambda df: df)
    monkeypatch.setattr(packing, "pack_pieces", lambda rows, *rest: rows)
    words = ["".join(w) for w in itertools.islice(itertools.product("etaoinshrdlucmfwypvbgkjqxz", repeat=4), 150_000)]
    texts = [" ".join(words[k : k + 5_000]) for k in range(0, len(words), 5_000)]
    texts.append(texts[0])
    most, got = 0, []
    batches = (pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x])], names=["doc_id", "text"]) for k, x in enumerate(texts))
    for out in corpus_pipeline.packing_stage(spark, Docs(), "")(batches):
        got += zip(out["doc_id"].to_pylist(), out["length"].to_pylist(), out["ids_crc32"].to_pylist())
        most = max(most, sum(len(x) + len(x.older) for x in (made[0].cache, made[0].pieces)))
    t = Tokenizer.from_file(tokenizer_path())
    for k in (0, 15, 30):
        ids = [i for x in t.encode_batch(texts[k].split(), add_special_tokens=False) for i in x.ids] + [1]
        want = [(len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for a in range(0, len(ids), packing.SIZE) for c in (ids[a : a + packing.SIZE],)]
        assert [(n, crc) for d, n, crc in got if d == k] == want
    assert most <= 4 * ((1 << 15) + 10_000)


def test_ids_equal_the_library_over_any_text_and_cut():
    rng = random.Random(4)
    chars = [*map(chr, range(0x260)), *"ſKİﬀ\u2028\u3000\ufeff٣²\u0301\u0307\u0331\u0338“”—€中яЖΣς😀\u200dⅧ"]
    texts = [None, "", "  \n", "a<|endoftext|>b", "<|startoftext|>", "</w> a</w>", "don't DON'T 've'll", *(x for c in chars for x in (f"a{c}b", f"{c}{c} 1{c}A", f"$${c}'s"))]
    some = [*chars, *"abcdeABC'  ..,,$123" * 40]
    texts += ["".join(rng.choices(some, k=rng.randint(0, 60))) + rng.choice(["", "", "", "<|endoftext|>"]) for _ in range(1500)]
    rng.shuffle(texts)
    t, codec, lo = Tokenizer.from_file(tokenizer_path()), packing.Codec(tokenizer_path(), None, bytes, 300), 0
    while lo < len(texts):
        part = pa.array(texts, pa.string()).slice(lo, rng.randint(1, 400))
        ids, begin = codec.ids_of(part)
        assert len(begin) == len(part) + 1 and begin[0] == 0 and begin[-1] == len(ids)
        for k, x in enumerate(part.to_pylist()):
            assert ids[begin[k] : begin[k + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)
        lo += len(part)


def test_new_words_of_known_pieces_cost_less_than_a_call_each(monkeypatch):
    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(packing.F, "col", lambda name: type("Column", (), {"cast": lambda self, kind: self, "alias": lambda self, name: self})())
    stems = ["".join(x) for x in itertools.product("aeioun", repeat=3)]
    words = [f"{a}-{b}" for a in stems for b in stems[:150]]  # all distinct
    run, calls = packing.pieces(Docs()), [0]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(words)])], names=["doc_id", "text"])
    list(run(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["ae"])], names=["doc_id", "text"])])))  # loads the vocabulary
    try:
        sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event in ("call", "c_call"))))
        rows = list(run(iter([batch])))
    finally:
        sys.setprofile(None)
    ids = [i for x in Tokenizer.from_file(tokenizer_path()).encode_batch(words, add_special_tokens=False) for i in x.ids] + [1]
    cut = [np.array(ids[k : k + packing.SIZE], "<u4").tobytes() for k in range(0, len(ids), packing.SIZE)]
    assert [x for r in rows for x in r["ids_crc32"].to_pylist()] == list(map(zlib.crc32, cut))
    assert calls[0] < len(words)
