"""Best-fit packing with certified bin counts.

Documents are encoded, closed by an end id, and cut into pieces of at most
``size`` ids (only longer documents are cut). Pieces are dealt to partitions of
about ``PART`` pieces by hash. Each partition packs its pieces by best-fit
decreasing and bounds its bin count from below by dual feasible functions; a
partition whose count equals the bound is certified optimal by itself.
Partitions with a gap give up the pieces of their bins that are not full, all
partitions those of bins with an eighth free (the last ones, which a partition
alone can't fill); the given-up pieces are dealt anew and best-fit decreasing
runs again; the new bins replace the old ones where they are fewer. This
repeats while bins are saved. Only totals reach the driver.

Null or empty text: one piece that holds the end id alone. Null or repeated
doc_ids: every row is packed on its own. No rows: no sequences. Columns other
than doc_id and text are not used.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .bpe import CACHE_WORDS, Codec, id_bytes, uncollected
from .common import checkpointed, lean, tokenizer_path

SIZE, END_ID, PART = 4096, 1, 50_000
#: For executors that earlier stages have filled: words that a worker remembers, and text bytes that it splits into words at
#: a time. Less memory than with the defaults, more CPU.
LEAN = {"words": 1 << 15, "slice_bytes": 1 << 19}

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best of three families of dual feasible functions: the identity, the threshold functions U(a), and the
    rounding functions u(k). The sum of f(length/size) over the pieces bounds the bins from below for each such f."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((n * x).sum()) // size)
    below, mass = np.cumsum(n), np.cumsum(n * x)
    a = np.arange(1, size // 2 + 1)
    # U(a): pieces over size-a count as a whole bin, pieces under a as nothing, others as they are.
    big = below[size] - below[size - a]
    mid = mass[size - a] - mass[a - 1]
    best = max(best, int((big + -(-mid // size)).max()))
    for k in range(2, 16):  # u(k): (k+1)x rounded down to a multiple of 1/k, where it is no whole number already
        scaled = (k + 1) * x
        value = np.where(scaled % size == 0, k * x, (scaled // size) * size)  # in units of 1/(k*size)
        best = max(best, -(-int((n * value).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece when each, from the longest, goes to the fullest bin that holds it; and the bins.
    ``lengths`` must fall. Bins lie in stacks by free room, and the stacks in use are the bits of one integer."""
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    used, n_bins = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, x in enumerate(lengths.tolist()):
        fit = used >> x
        if fit:
            room = x + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                used ^= 1 << room
        else:
            b, room = n_bins, size
            n_bins += 1
        bins[i], offsets[i] = b, size - room
        room -= x
        if not stacks[room]:
            used |= 1 << room
        stacks[room].append(b)
    return bins, offsets, n_bins


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, words: int = CACHE_WORDS, slice_bytes: int = text.SLICE_BYTES) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        codec, step, end = Codec(path, None, id_bytes, words), 4 * size, id_bytes([END_ID])
        with uncollected():
            for batch in batches:
                for part in text.slices(batch, "text", slice_bytes):
                    rows: list[tuple] = []
                    found, begin = codec.ids_of(part.column(1))
                    raw, at = found.tobytes(), (4 * begin).tolist()
                    for doc, a, b in zip(part.column(0).to_pylist(), at, at[1:]):
                        ids = raw[a:b] + end
                        rows += [(doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)) for k, at in enumerate(range(0, len(ids), step)) for cut in (ids[at : at + step],)]
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _PIECES)


def _packed(rows: DataFrame, size: int, part: int, turn: int) -> DataFrame:
    """Deal rows to partitions and pack each; ``gap``: bins of its partition over the bound, ``spare``: room in its bin."""
    n = rows.count()
    dealt = rows.repartition(max(1, -(-n // part)), F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = t["length"].to_numpy()
        bins, offsets, n_bins = best_fit(lengths, size)
        spare = size - np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
        gap = n_bins - lower_bound(lengths, size)
        first = (turn << 56) + (TaskContext.get().partitionId() << 32)
        more = {"sequence_id": bins + first, "offset": offsets, "gap": np.full(len(bins), gap), "spare": spare[bins]}
        for k, v in more.items():
            t = t.append_column(k, pa.array(v, pa.int64()))
        yield from t.combine_chunks().to_batches(max_chunksize=20_000)

    return checkpointed(dealt.mapInArrow(run, f"{_PIECES}, sequence_id long, offset long, gap long, spare long"))


def pack_pieces(rows: DataFrame, size: int = SIZE, part: int = PART) -> DataFrame:
    """rows (of ``pieces``) with sequence_id and offset, and ``gap``: by how many bins its partition may exceed its bound."""
    base = [x.split()[0] for x in _PIECES.split(", ")]
    current, done = _packed(rows, size, part, 0), None
    n_bins = lambda df: df.where("offset = 0").count()  # noqa: E731  every bin has one piece at 0
    is_open = f"spare > 0 and (gap > 0 or spare >= {max(1, size // 8)})"
    for turn in count(1):  # a round that goes on has saved a bin
        opened = current.where(is_open)
        old = n_bins(opened)
        if old < 2:
            break
        again = _packed(opened.select(base), size, part, turn)
        if n_bins(again) >= old:
            break
        kept = current.where(f"not ({is_open})")
        done = kept if done is None else done.unionByName(kept)
        current = again
    return (current if done is None else done.unionByName(current)).drop("spare")


def pack(docs: DataFrame, size: int = SIZE, part: int = PART, path: str | None = None, words: int = CACHE_WORDS, slice_bytes: int = text.SLICE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and gap of every piece of every document."""
    return pack_pieces(checkpointed(pieces(docs, size, path, words, slice_bytes)), size, part)
