"""Near-dedup by consistent weighted sampling.

A document is a weighted set of its shingles (five consecutive words; all of
them if it has fewer): weight = count * idf / 2, where idf = 1 + min(1, ln((1+N)
/ (1+df)) / ln(1 + min(N, HEAVY))) lies between 1 and 2, so that boilerplate
counts less but a large group of near copies stays alike. A shingle in fewer
than one of ``HEAVY`` documents has idf 2, at every size of the corpus. The df
of all others is exact: one pass counts into a sketch that can only be too
high, a second one counts the shingles that pass it.

Improved consistent weighted sampling (Ioffe 2010) draws ``BANDS * ROWS``
samples of each distinct word sequence; two of them draw the same sample with
the probability of their weighted Jaccard similarity. The same draws with all
weights 1 are min-hash samples, for the plain similarity. Both are banded, and
sequences that share a band are candidates of each other. They link if their
weighted Jaccard similarity, or the plain one of the shingle sets, is
``SIMILAR`` or more, computed on the shingles themselves (the plain one is what
"a similarity of 0.8 or more" means without weights; the weighted one alone
would lose such links in large groups). Classes are the connected components.

What a candidate costs is bounded in three steps, none of which loses a link:

1. A sequence whose own shingles (those that no other candidate holds) weigh more
   than a fifth of it, by both rules, can't reach 0.8 with anything. Chunks of
   texts ask hash blocks which of their shingles others hold; one record goes
   for each pair of chunk and block. Only the rest, the survivors, goes on.
2. Survivors that share bands, directly or over others, form clusters. Small
   clusters are dealt out in bundles; a cluster of more than ``BLOCK_TOKENS``
   shingles is split into blocks, each of which also gets the cluster's hub, its
   sequence with the least weight of own shingles.
3. A task holds its shingles as an inverted index. A sequence looks up only its
   rarest shingles (a fifth of its weight and one more: a partner of 0.8 must
   hold one of them), and what it finds outside its own component is compared
   exactly. Of a split cluster, the sequences outside its largest component then
   ask the other blocks in the same way.

So no pair is ever a row unless it is a link that joins two components.

Null or empty texts have no shingles and are alone in their classes. Repeated
rows of a doc_id are one document with the union of its links; a null doc_id
is left out of classes (class null, kept). Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import checkpointed, lean, release
from .components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
HEAVY, SKETCH = 64, 1 << 18
#: Text bytes of a chunk that asks for shared shingles; shingles that a hash block holds; shingles of one linking task.
CHUNK_BYTES, BLOCK_SHINGLES, BLOCK_TOKENS = 4 << 20, 1 << 20, 1 << 20
#: Rows up to which a table of ids (16 bytes each) is sent to all tasks; beyond it both sides are dealt by id.
BROADCAST_IDS = 1 << 20
#: Text bytes whose samples are drawn at a time, so that arrays stay in the processor's cache.
_DRAW_BYTES, _PARTS = 1 << 18, 16
_SEEN = 1 << 20

HASH_BITS = 44
_RNG = np.random.Generator(np.random.PCG64(11))
_POOL_BITS = 14
#: Pools of the sampler's random numbers: r and ln c from Gamma(2,1), beta uniform; a shingle's hash picks one place of them for each draw.
_R, _LNC, _BETA = _RNG.gamma(2, 1, 1 << _POOL_BITS), np.log(_RNG.gamma(2, 1, 1 << _POOL_BITS)), _RNG.uniform(0, 1, 1 << _POOL_BITS)
_ODD = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Weights are drawn in steps of 1/16 of an octave; comparisons take them as they are.
_STEPS = 16
_DRAWS: dict[int, np.ndarray] = {}


def shingles(arr: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 44-bit hash, count) of every distinct shingle, by text and hash, and a hash of each text's word sequence."""
    data, offs = text.utf8(arr)
    s, e, first = text.words(data, offs)
    h = text.span_hashes(data, s, e)
    n, doc = np.diff(first), text.owner(first)
    g = text.grams(h, k)
    ok = text.inside(first, k, len(h))
    at = np.arange(len(h)) - first[doc] if len(h) else np.zeros(0, np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    p = np.concatenate([[np.uint64(0)], np.cumsum(text.mix(h ^ (at.astype(np.uint64) * odd)))]) if len(h) else np.zeros(1, np.uint64)
    whole = text.mix(p[first[1:]] - p[first[:-1]], 3)
    short = np.flatnonzero((n > 0) & (n < k))
    shift, bits = np.uint64(64 - HASH_BITS), np.uint64(HASH_BITS)
    both = np.sort(np.concatenate([doc[: len(ok)][ok], short]).astype(np.uint64) << bits | np.concatenate([g[ok], whole[short]]) >> shift)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    only = both[at]
    return (only >> bits).astype(np.int64), only & np.uint64((1 << HASH_BITS) - 1), np.diff(np.append(at, len(both))), whole


def _cells(h: np.ndarray, sketch: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(sketch - 1)
    return (h & m).astype(np.int64), (h >> np.uint64(HASH_BITS - 20) ^ h >> np.uint64(3) & m).astype(np.int64) & int(m)


def _sketched(docs: DataFrame, sketch: int) -> tuple[np.ndarray, int]:
    """The count sketch of shingles over all texts (2 x sketch counters, whatever the input), and the number of texts."""
    step = sketch // _PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, sketch), np.int32), 0
        for batch in batches:
            n += batch.num_rows
            for part in text.slices(batch, "text"):
                for row, cell in enumerate(_cells(shingles(part.column(0))[1], sketch)):
                    total[row] += np.bincount(cell, minlength=sketch).astype(np.int32)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([total[:, k * step : (k + 1) * step].tobytes() for k in range(_PARTS)], pa.binary()), pa.array([n] + [0] * (_PARTS - 1), pa.int64())], names=["part", "n", "docs"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for k, raw, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                v = np.frombuffer(raw.as_buffer(), np.int32).astype(np.int64)
                sums[k] = sums[k] + v if k in sums else v
                n += m
        ks = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([sums[k].tobytes() for k in ks], pa.binary()), pa.array([n] + [0] * (len(ks) - 1) if ks else [], pa.int64())], names=["part", "n", "docs"])

    schema = "part int, n binary, docs long"
    total, n = np.zeros((2, sketch), np.int64), 0
    for r in docs.select("text").mapInArrow(lean(count), schema).repartition(_PARTS, "part").mapInArrow(add, schema).toLocalIterator():
        total[:, r.part * step : (r.part + 1) * step] = np.frombuffer(r.n, np.int64).reshape(2, step)
        n += r.docs
    return total, n


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(n, at) if len(at) else n


def document_frequency(docs: DataFrame, heavy: int = HEAVY, sketch: int = SKETCH) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, rising; their exact numbers of texts; number of texts) of all shingles in at least one of ``heavy`` texts, two
    at least. There are at most ``heavy`` times as many as a text has on average, whatever the number of texts."""
    total, n = _sketched(docs, sketch)
    least = max(2, -(-n // heavy))
    maybe = docs.sparkSession.sparkContext.broadcast(total >= least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = maybe.value
        h, m, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in batches:
            for part in text.slices(batch, "text"):
                x = shingles(part.column(0))[1]
                a, b = _cells(x, sketch)
                new.append(x[first[a] & second[b]])
                if sum(map(len, new)) > 1 << 20:
                    h, m = _summed(np.concatenate([h, *new]), np.concatenate([m, *(np.ones(len(y), np.int64) for y in new)]))
                    new = []
        h, m = _summed(np.concatenate([h, *new]), np.concatenate([m, *(np.ones(len(y), np.int64) for y in new)]))
        cut = np.searchsorted(h >> np.uint64(HASH_BITS - 4), np.arange(_PARTS + 1))
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([m[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["part", "h", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                h, m = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.int64)
                sums[k] = _summed(np.concatenate([sums[k][0], h]), np.concatenate([sums[k][1], m])) if k in sums else (h, m)
        for k, (h, m) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([h[m >= least].tobytes()], pa.binary()), pa.array([m[m >= least].tobytes()], pa.binary())], names=["part", "h", "n"])

    schema = "part int, h binary, n binary"
    rows = sorted(docs.select("text").mapInArrow(lean(count), schema).repartition(_PARTS, "part").mapInArrow(add, schema).collect(), key=lambda r: r.part)
    empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(empty[0] + [np.frombuffer(r.h, np.uint64) for r in rows]), np.concatenate(empty[1] + [np.frombuffer(r.n, np.int64) for r in rows]), n


class Weights:
    """Weights of shingles from the frequencies of the frequent ones; a shingle that is not among them weighs 1 a time."""

    def __init__(self, h: np.ndarray, df: np.ndarray, n: int, heavy: int = HEAVY) -> None:
        rarity = np.log((1 + n) / (1 + np.minimum(df, n))) / math.log(1 + max(1, min(n, heavy)))
        self.h, self.value = h, ((1 + np.minimum(1, rarity)) / 2).astype(np.float32)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = count.astype(np.float32)
        at = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if len(at):
            i = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            found = self.h[i] == h[at]
            out[at[found]] *= self.value[i[found]]
        return out


def _draws(level: int) -> np.ndarray:
    """For each place of the pools, what the sampler compares at this weight, in the upper 32 bits; it rises with ln a."""
    have = _DRAWS.get(level)
    if have is None:
        t = np.floor(level / _STEPS * math.log(2) / _R + _BETA)
        bits = (_LNC - _R * (t - _BETA) - _R).astype(np.float32).view(np.uint32)
        bits = bits ^ np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
        have = _DRAWS[level] = bits.astype(np.uint64) << np.uint64(32)
    return have


def levels(weight: np.ndarray) -> np.ndarray:
    return np.rint(np.log2(weight) * _STEPS).astype(np.int64)


def samples(doc: np.ndarray, h: np.ndarray, level: np.ndarray | None = None) -> np.ndarray:
    """texts x (BANDS*ROWS) 32-bit samples of texts 0, 1, ... that have a shingle each; without levels all weights are 1."""
    x0, at = text.mix(h), np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    if level is None:
        base, table = None, _draws(0)
    else:
        kinds, place = np.unique(level, return_inverse=True)
        base, table = place.astype(np.uint64) << np.uint64(_POOL_BITS), np.concatenate([_draws(int(x)) for x in kinds])
    out = np.empty((BANDS * ROWS, len(at)), np.uint64)
    x, i, z = np.empty_like(x0), np.empty_like(x0), np.empty_like(x0)
    for k in range(BANDS * ROWS):
        np.multiply(x0, _ODD[k], out=x)
        np.right_shift(x, np.uint64(64 - _POOL_BITS), out=i)
        if base is not None:
            np.add(i, base, out=i)
        np.take(table, i.view(np.int64), out=z, mode="clip")
        np.bitwise_and(x, np.uint64(0xFFFFFFFF), out=x)
        np.bitwise_or(z, x, out=z)
        np.minimum.reduceat(z, at, out=out[k])
    return (text.mix(out.T) >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of ROWS samples."""
    out = np.empty((len(sig), sig.shape[1] // ROWS), np.uint64)
    for b in range(out.shape[1]):
        x = np.full(len(sig), b + 1, np.uint64)
        for j in range(ROWS):
            x = text.mix(x * np.uint64(0x100000001B3) ^ sig[:, b * ROWS + j])
        out[:, b] = x
    return out


def bands(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> pa.Array:
    """The distinct band keys of both kinds of samples; texts without shingles get null."""
    some = np.bincount(doc, minlength=n_docs) > 0
    number = np.cumsum(some) - 1
    d, keys = number[doc], np.zeros((int(some.sum()), 2 * BANDS), np.uint64)
    keep = np.ones(keys.shape, bool)
    if len(d):
        keys[:, :BANDS] = keys[:, BANDS:] = band_keys(samples(d, h))
        level = levels(weight)
        odd = np.bincount(d, level != 0, len(keys)) > 0
        if odd.any():
            m = odd[d]
            keys[odd, BANDS:] = band_keys(samples((np.cumsum(odd) - 1)[d[m]], h[m], level[m]))
        keep[:, BANDS:] = keys[:, BANDS:] != keys[:, :BANDS]
    size = np.zeros(n_docs, np.int64)
    size[some] = keep.sum(1)
    offs = pa.array(np.append(0, np.cumsum(size)).astype(np.int32), mask=np.append(~some, False))
    return pa.ListArray.from_arrays(offs, pa.array(keys[keep].view(np.int64)))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, whole (hash of the word sequence, null without words), size (bytes of the text), bands (null without words and
    where the task has just given those of the same word sequence)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, seen = shared.value, set()
        for batch in batches:
            for part in text.slices(batch, "text", _DRAW_BYTES):
                doc, h, count, whole = shingles(part.column(1))
                some = np.bincount(doc, minlength=part.num_rows) > 0
                fresh = np.zeros(part.num_rows, bool)
                for r, x in enumerate(whole.tolist()):
                    if some[r] and x not in seen:
                        seen.add(x)
                        fresh[r] = True
                if len(seen) > _SEEN:  # forgetting costs only repeated work
                    seen.clear()
                m = fresh[doc]
                doc, h, count = doc[m], h[m], count[m]
                sizes = np.diff(text.utf8(part.column(1))[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole.view(np.int64), mask=~some), pa.array(sizes), bands(doc, h, weigh(h, count), part.num_rows)], names=["doc_id", "whole", "size", "bands"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, whole long, size long, bands array<long>")


def _sent(ids: DataFrame) -> DataFrame:
    """ids for a join: to all tasks where they are few."""
    ids = checkpointed(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _split(h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of rising hashes; the block is the hash's first bits."""
    block = (h >> np.uint64(HASH_BITS - bits)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(h) else []
    for a, b in zip(cut, [*cut[1:], len(h)]):
        yield int(block[a]), int(a), int(b)


def survivors(texts: DataFrame, total: int, weights: Weights, similar: float) -> DataFrame:
    """Of texts (whole, text; a word sequence may stand on several rows; total: their bytes), the sequences that could reach
    ``similar`` with another: whole, n, h (hashes, rising), w (weights), own (share of the weight that no other holds)."""
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    bits = max(0, (total // 6 // BLOCK_SHINGLES).bit_length())  # a word has 6 bytes or so
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    chunks = texts.select("whole", "text", F.pmod(F.xxhash64("whole"), F.lit(n_chunks)).alias("chunk")).groupBy("chunk")

    def parsed(t: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The word sequences of a chunk, each once, and (hashes, counts) of each."""
        seen, out = set(), []
        for batch in t.combine_chunks().to_batches():
            for part in text.slices(batch, "text"):
                doc, h, count, whole = shingles(part.column(1))
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for r, (x, want) in enumerate(zip(whole.view(np.int64).tolist(), part.column(0).to_pylist())):
                    # a doc_id that stands on several rows brings its other texts along
                    if x == want and x not in seen:
                        seen.add(x)
                        out.append((x, h[first[r] : first[r + 1]], count[first[r] : first[r + 1]]))
        out.sort(key=lambda v: v[0])
        return np.array([v[0] for v in out], np.int64), [v[1:] for v in out]

    def distinct(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(s[0] for s in sets)]), return_counts=True)

    def ask(t: pa.Table) -> pa.Table:
        h, n = distinct(parsed(t)[1])
        rows = [(b, (h[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), np.packbits(n[x:y] > 1).tobytes()) for b, x, y in _split(h, bits)]
        cols = list(zip(*rows)) or [()] * 3
        return pa.table({"block": pa.array(cols[0], pa.int64()), "chunk": pa.array([t["chunk"][0].as_py()] * len(rows), pa.int64()), "h": pa.array(cols[1], pa.binary()), "many": pa.array(cols[2], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        """Equal 32 bits of a block count as equal hashes here: at worst a shingle seems shared and nothing is dropped for it."""
        asked = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["h"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(x)) for m, x in zip(t["many"], asked)])
        _, place, n = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        others = (n > 1) | (np.bincount(place, many, len(n)) > 0)
        cut = np.cumsum([0, *map(len, asked)])
        bits = [np.packbits(others[place[a:b]]).tobytes() for a, b in zip(cut, cut[1:])]
        return pa.table({"block": t["block"], "chunk": t["chunk"], "n": pa.array(list(map(len, asked)), pa.int64()), "many": pa.array(bits, pa.binary())})

    def keep(t: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows:
            weigh = shared.value
            whole, sets = parsed(t)
            known = distinct(sets)[0]
            replies = sorted(zip(told["block"].to_pylist(), told["n"].to_pylist(), told["many"].to_pylist()))
            others = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for _, n, m in replies)])
            for x, (h, count) in zip(whole.tolist(), sets):
                w, own = weigh(h, count), ~others[np.searchsorted(known, h)]
                by_weight, by_number = float(w[own].sum() / w.sum()), float(own.mean())
                if min(by_weight, by_number) <= 1 - similar + 1e-5:
                    rows.append((x, len(h), h.tobytes(), w.tobytes(), min(by_weight, by_number)))
        cols = list(zip(*rows)) or [()] * 5
        release()
        return pa.table({"whole": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "h": pa.array(cols[2], pa.binary()), "w": pa.array(cols[3], pa.binary()), "own": pa.array(cols[4], pa.float64())})

    told = chunks.applyInArrow(ask, "block long, chunk long, h binary, many binary").groupBy("block").applyInArrow(answer, "block long, chunk long, n long, many binary")
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(keep, "whole long, n long, h binary, w binary, own double")


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers lo, ..., lo + size - 1 of each range, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + size, size)


def joining_links(ids: np.ndarray, n: np.ndarray, h: np.ndarray, w: np.ndarray, label: np.ndarray, asks: np.ndarray | None = None, similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links between sets (n hashes each, one after another, with weights) that join different components, label being the
    components so far: enough of them to give the components of all links. With asks, only links of those with the others."""
    m, owner = len(ids), np.repeat(np.arange(len(ids)), n)
    first = np.cumsum(n) - n
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    lo = np.flatnonzero(new)
    df = np.diff(np.append(lo, len(h)))
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    by, by_w, often = owner[order], w[order].astype(np.float64), df[place]
    weight = np.bincount(owner, w, m)
    # the rarest shingles of each set: those before which the rest could still hold `similar` of it
    rare = np.lexsort((often, owner))
    before = np.cumsum(w[rare], dtype=np.float64) - w[rare]
    before -= before[first][owner]
    rank = np.arange(len(h)) - first[owner]
    probe = ((rank < n[owner] - np.ceil(similar * n[owner] - 1e-9) + 1) | (before <= (1 - similar) * weight[owner] + 1e-4 * weight[owner])) & (often[rare] > 1)
    source = np.ones(m, bool) if asks is None else asks
    probe &= source[owner]
    probes, prober = place[rare[probe]], owner[probe]
    cut = np.searchsorted(prober, np.arange(m + 1))
    _, root = np.unique(label, return_inverse=True)
    out, mark = [], np.zeros(len(lo))
    for d in np.unique(prober).tolist():
        t = probes[cut[d] : cut[d + 1]]
        near = np.zeros(m, bool)
        near[by[_ranges(lo[t], df[t])]] = True
        near &= root != root[d]
        if asks is not None:
            near &= ~asks
        c = np.flatnonzero(near)
        if not len(c):
            continue
        own = slice(first[d], first[d] + n[d])
        t, tw = place[own], w[own].astype(np.float64)
        common = df[t] > 1
        t, tw = t[common], tw[common]
        if df[t].sum() < 4 * n[c].sum():
            at = _ranges(lo[t], df[t])
            number, both = np.bincount(by[at], minlength=m)[c], np.bincount(by[at], np.minimum(by_w[at], np.repeat(tw, df[t])), m)[c]
        else:
            mark[t] = tw
            at = _ranges(first[c], n[c])
            least = np.minimum(mark[place[at]], w[at])
            starts = np.cumsum(n[c]) - n[c]
            number, both = np.add.reduceat((least > 0).astype(np.int64), starts), np.add.reduceat(least, starts)
            mark[t] = 0
        linked = c[(both >= (similar - 1e-6) * (weight[d] + weight[c] - both)) | (number >= similar * (n[d] + n[c] - number))]
        for r in np.unique(root[linked]).tolist():
            out.append((int(ids[d]), int(ids[linked[root[linked] == r][0]])))
            root[root == r] = root[d]
    return out


def _linking(similar: float):  # noqa: ANN202
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        h, w = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("h", np.uint64), ("w", np.float32)))
        asks = t["asks"].to_numpy(zero_copy_only=False)
        found = joining_links(t["whole"].to_numpy(), t["n"].to_numpy(), h, w, t["label"].to_numpy(), asks if asks.any() else None, similar)
        del t, h, w
        release()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def _joined(sets: DataFrame, keys: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) among sets, enough to give all components of those that share keys (key, whole)."""
    keys = keys.join(sets.select("whole"), "whole", "left_semi")
    hubs = keys.groupBy("key").agg(F.min("whole").alias("hub"), F.max("whole").alias("_last")).where("hub < _last").select("key", "hub")
    clusters = checkpointed(components(keys.join(hubs, "key").where("whole <> hub").select(F.col("whole").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("id", "whole").withColumnRenamed("component", "cluster"))
    known = sets.select("whole", "n", "own").join(clusters, "whole")
    sizes = checkpointed(known.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.min_by("whole", F.struct("own", "whole")).alias("hub")).withColumn("blocks", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int")))
    total = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("tokens")))).first()[0] or 0
    bundles = max(1, -(-total // BLOCK_TOKENS))
    whole = F.col("blocks") == 1
    place = checkpointed(
        clusters.join(sizes, "cluster").select("whole", "cluster", "hub", "blocks", F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(bundles))).otherwise(F.col("cluster")).alias("group"), F.when(whole, -1).otherwise(F.pmod(F.xxhash64("whole"), "blocks")).cast("int").alias("block"))
    )
    fields = ["group", "block", "whole", "n", "h", "w", "label", "asks"]
    placed = sets.select("whole", "n", "h", "w").join(place, "whole")
    own = placed.withColumns({"label": F.col("whole"), "asks": F.lit(False)})
    task = own.select(*fields)
    split = sizes.where("blocks > 1").count() > 0
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    if split:
        hub = own.where("blocks > 1 and whole = hub").withColumn("other", others).where("other <> block").drop("block").withColumnRenamed("other", "block")
        task = task.unionByName(hub.select(*fields))
    found = checkpointed(task.groupBy("group", "block").applyInArrow(_linking(similar), "a long, b long"))
    if split:
        labels = components(found).withColumnRenamed("id", "whole")
        at = checkpointed(place.where("blocks > 1").join(labels, "whole", "left").withColumn("label", F.coalesce("component", "whole")).drop("component"))
        major = at.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("major"))
        held = sets.select("whole", "n", "h", "w").join(at, "whole")
        outside = sets.select("whole", "n", "h", "w").join(at.join(major, "cluster").where("label <> major"), "whole").withColumn("other", others).where("other <> block").drop("block").withColumnRenamed("other", "block")
        task = held.withColumn("asks", F.lit(False)).select(*fields).unionByName(outside.withColumn("asks", F.lit(True)).select(*fields))
        found = found.unionByName(checkpointed(task.groupBy("group", "block").applyInArrow(_linking(similar), "a long, b long")))
    return found


def classes(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id and whole of every row with a doc_id, class_id of every whole)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    weights = Weights(*document_frequency(docs))
    sig = checkpointed(signatures(docs, weights))
    rows = sig.where("whole is not null")
    reps = rows.groupBy("whole").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"))
    keys = rows.where("bands is not null").select("whole", F.explode("bands").alias("key"))
    # bands of one word sequence are of no use any more
    several = keys.groupBy("key").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo < hi").select("key")
    keys = checkpointed(keys.join(several, "key").select("key", "whole"))
    asked = reps.join(keys.select("whole").distinct(), "whole")
    sent = _sent(asked.select(F.col("rep").alias("doc_id"), "whole", "size"))
    total = sent.agg(F.sum("size")).first()[0] or 0
    sets = checkpointed(survivors(docs.join(sent.drop("size"), "doc_id").select("whole", "text"), total, weights, similar))
    found = _joined(sets, keys, similar)
    # a doc_id on rows with different texts is one document
    repeated = rows.groupBy("doc_id").agg(F.min("whole").alias("a"), F.max("whole").alias("_last")).where("a < _last").select("doc_id", "a")
    same = rows.select("doc_id", F.col("whole").alias("b")).join(repeated, "doc_id").where("a <> b").select("a", "b")
    groups = components(found.unionByName(same)).withColumnRenamed("id", "whole")
    of = groups.join(reps, "whole")
    least = of.groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = of.join(least, "component").select("whole", "class_id")
    return sig.select("doc_id", "whole"), reps.join(linked, "whole", "left").select("whole", F.coalesce("class_id", "rep").alias("class_id"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the class's smallest id), kept (doc_id = class_id) of every document."""
    rows, of = classes(docs, similar)
    by_id = rows.where("whole is not null").join(of, "whole").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(by_id, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without the documents that are not the smallest of their class; rows that share a kept doc_id stay."""
    dropped = _sent(near_duplicates(docs, similar).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(dropped, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
