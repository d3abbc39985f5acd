"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus, indexed in hash-partitioned blocks: block b
holds, for the word windows whose hash falls in it, the first document (by
doc_id) and word position that the window starts at. Documents are held in
chunks by a hash of their ids. A chunk asks every block it has windows for,
and the block answers with the earlier occurrences only. A document is then
parsed greedily relative to this index of first occurrences: at a word whose
window occurs in an earlier document, the factor is extended word by word as
long as the indexed occurrence goes on in the same document (another, later
document may hold a longer stretch; the words covered are the same). Where a
factor ends, each window across its boundary is looked up in turn and opens the
next factor, which then overlaps the one before. Factors are at least ``WINDOW``
words long, and their words are what is removed. Windows are equal if two
64-bit hashes over their words' hashes are; the second one is made where the
first one is found.

Asking for every window would move 8 bytes a word. Therefore a first round
asks only for anchors: of the ``WINDOW - GRAM + 1`` GRAM-word hashes in a window,
the smallest. Equal windows have equal anchors, so windows whose anchor occurs
in one document only need not be asked for. All rounds exchange sorted arrays
of hashes, one record for each pair of chunk and block, aggregated in the chunk
first: what a passage costs a block grows with the chunks that hold it, never
with its copies.

Null text or text of fewer than ``WINDOW`` words: nothing is removed. Rows with
the same doc_id are one document to each other (neither is earlier); a row with
null doc_id keeps its words and is no source. Other columns pass through, and
incoming columns with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import release, without

WINDOW, GRAM = 13, 7
#: Text bytes that a chunk holds on average, and hash entries that a block holds on average.
CHUNK_BYTES = 4 << 20

_NONE = np.iinfo(np.int64).max
FACTORS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("source", T.LongType()), T.StructField("source_first", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_first", pa.int32())]))


class Parsed:
    """Words of a slice of documents with their windows' anchors and hashes."""

    def __init__(self, part: pa.RecordBatch, key: int, column: int, window: int, gram: int, anchors: bool = True) -> None:
        data, offs = text.utf8(part.column(column))
        s, e, self.first = text.words(data, offs)
        h = text.span_hashes(data, s, e)
        ids = part.column(key)
        known = ~np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy().astype(np.int64)
        doc = text.owner(self.first)
        n = len(h) - window + 1
        ok = text.inside(self.first, window, len(h))
        self.at = np.flatnonzero(ok & known[doc[: max(n, 0)]]) if n > 0 else np.zeros(0, np.int64)
        self.row = doc[self.at]
        self.doc, self.pos = ids[self.row], self.at - self.first[self.row]
        self._words, self._window = h, window
        if anchors and n > 0:
            g = text.grams(h, gram)
            m, width, span = g, 1, window - gram + 1
            while width * 2 <= span:
                m, width = np.minimum(m[: len(m) - width], m[width:]), width * 2
            if width < span:
                m = np.minimum(m[: n], m[span - width : span - width + n])
            self.anchor = text.mix(m[self.at], 5)

    def hashes(self) -> np.ndarray:
        return text.grams(self._words, self._window)[self.at]

    def checks(self, which: np.ndarray) -> np.ndarray:
        """Second hashes of some windows."""
        out, h, at = np.zeros(len(which), np.uint64), text.mix(self._words, 9), self.at[which]
        for j in range(self._window):
            out = (out ^ h[at + j]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return text.mix(out, 2)


def _least(h: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (hash, check), rising, with their first (doc, pos), and whether more than one doc has them."""
    if not len(h):
        return h, check, doc, pos, np.zeros(0, bool)
    order = np.lexsort((pos, doc, check, h))
    h, check, doc, pos = h[order], check[order], doc[order], pos[order]
    new = np.empty(len(h), bool)
    new[0], new[1:] = True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1
    return h[at], check[at], doc[at], pos[at], doc[last] != doc[at]


def _find(h: np.ndarray, check: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (x, y) is among the rising pairs (h, check), and where."""
    if not len(h):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(h, x), len(h) - 1)
    found = (h[i] == x) & (check[i] == y)
    todo = np.flatnonzero((h[i] == x) & ~found)
    while len(todo):  # equal hashes of different words
        i[todo] += 1
        todo = todo[i[todo] < len(h)]
        todo = todo[h[i[todo]] == x[todo]]
        found[todo] = check[i[todo]] == y[todo]
        todo = todo[~found[todo]]
    return found, np.minimum(i, len(h) - 1)


def _split(h: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of rising hashes; the block is the hash's first bits."""
    block = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(h) else []
    for a, b in zip(cut, [*cut[1:], len(h)]):
        yield int(block[a]), int(a), int(b)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_MSG = "block long, chunk long, h binary, check binary, doc binary, pos binary, many binary"
_NAMES = ["block", "chunk", "h", "check", "doc", "pos", "many"]
_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 5]


def _message(block: int, chunk: int, h: np.ndarray, check: np.ndarray | None = None, doc: np.ndarray | None = None, pos: np.ndarray | None = None, many: np.ndarray | None = None) -> tuple:
    more = [b"" if x is None else x.astype(kind).tobytes() for x, kind in ((check, np.uint64), (doc, np.int64), (pos, np.int32))]
    return (block, chunk, h.tobytes(), *more, b"" if many is None else np.packbits(many).tobytes())


def _read(t: pa.Table, column: str, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) for x in t[column]]


def factors(row: np.ndarray, pos: np.ndarray, source: np.ndarray, source_pos: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Greedy parse: (row, first word, words, source, first word there) from windows that occur earlier, in order of row and position."""
    if not len(row):
        return row, pos, pos, source, source_pos
    go = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1) & (source[1:] == source[:-1]) & (source_pos[1:] == source_pos[:-1] + 1)
    cut = np.flatnonzero(np.append(True, ~go))
    length = np.diff(np.append(cut, len(row))) + window - 1
    return row[cut], pos[cut], length, source[cut], source_pos[cut]


def dedup(docs: DataFrame, text_col: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, with_factors: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_text (the words that no factor covers, joined by one space) and, if they are to be
    shown, factors (first word, words, source document and first word there; they may overlap where a source gives way)."""
    docs = without(docs, "n_words", "n_removed", "kept_text", "factors", "_chunk")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    bits = max(0, int(n_chunks - 1).bit_length())
    place = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("long"), F.xxhash64(text_col))), F.lit(n_chunks))
    docs = docs.withColumn("_chunk", place)
    k, c, at = docs.columns.index(key), docs.columns.index(text_col), docs.columns.index("_chunk")

    def parsed(t: pa.Table, anchors: bool = True) -> Iterator[tuple[pa.RecordBatch, Parsed]]:
        for batch in t.combine_chunks().to_batches():
            for part in text.slices(batch, text_col):
                yield part, Parsed(part, k, c, window, gram, anchors)

    def ask_anchors(t: pa.Table) -> pa.Table:
        found = [_least(p.anchor, np.zeros(len(p.at), np.uint64), p.doc, p.pos * 0) for _, p in parsed(t) if len(p.at)]
        rows = []
        if found:
            h, zero, doc, pos = (np.concatenate([f[i] for f in found]) for i in range(4))
            more = np.concatenate([f[4] for f in found])
            again = np.unique(h[more])
            h, _, _, _, many = _least(h, zero, doc, pos)
            many |= np.isin(h, again)
            low = (h >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if bits <= 32 else h.astype(np.uint32)
            rows = [_message(b, t["_chunk"][0].as_py(), low[x:y], many=many[x:y]) for b, x, y in _split(h, bits)]
        return pa.Table.from_batches([_batch(rows, _NAMES, _TYPES)])

    def answer_anchors(t: pa.Table) -> pa.Table:
        h, chunks = _read(t, "h", np.uint32), t["chunk"].to_pylist()
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(x)) for m, x in zip(t["many"], h)])
        _, place, n = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        shared = ((n > 1) | (np.bincount(place, many, len(n)) > 0))[place]
        block, cut = t["block"][0].as_py(), np.cumsum([0, *map(len, h)])
        rows = [_message(block, chunk, hit) for chunk, x, a, b in zip(chunks, h, cut, cut[1:]) if len(hit := x[shared[a:b]])]
        return pa.Table.from_batches([_batch(rows, _NAMES, _TYPES)])

    def shared_anchors(replies: pa.Table) -> np.ndarray:
        parts = [np.uint64(b) << np.uint64(32) | x.astype(np.uint64) for b, x in zip(replies["block"].to_pylist(), _read(replies, "h", np.uint32))]
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def member(sorted_set: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_set):
            return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        i = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
        return sorted_set[i] == x, i

    def ask_windows(t: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if t.num_rows:
            shared, found = shared_anchors(replies), []
            for _, p in parsed(t):
                if len(p.at):
                    a = p.anchor >> np.uint64(64 - bits) << np.uint64(32) | p.anchor >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF) if bits else p.anchor >> np.uint64(32)
                    hit = member(shared, a)[0]
                    found.append((p.hashes()[hit], p.checks(np.flatnonzero(hit)), p.doc[hit], p.pos[hit]))
            if found:
                h, check, doc, pos, many = _least(*(np.concatenate([f[i] for f in found]) for i in range(4)))
                rows = [_message(b, t["_chunk"][0].as_py(), h[x:y], check[x:y], doc[x:y], pos[x:y], many[x:y]) for b, x, y in _split(h, bits)]
        return pa.Table.from_batches([_batch(rows, _NAMES, _TYPES)])

    def answer_windows(t: pa.Table) -> pa.Table:
        h, check, doc, pos = _read(t, "h", np.uint64), _read(t, "check", np.uint64), _read(t, "doc", np.int64), _read(t, "pos", np.int32)
        seen, sure, least, where, _ = _least(np.concatenate(h), np.concatenate(check), np.concatenate(doc), np.concatenate(pos))
        block, rows = t["block"][0].as_py(), []
        for chunk, x, y, own, raw in zip(t["chunk"].to_pylist(), h, check, doc, t["many"]):
            many = np.unpackbits(np.frombuffer(raw.as_py(), np.uint8), count=len(x)).astype(bool)
            i = _find(seen, sure, x, y)[1]
            tell = many | (least[i] < own)
            if tell.any():
                rows.append(_message(block, chunk, x[tell], y[tell], least[i][tell], where[i][tell]))
        return pa.Table.from_batches([_batch(rows, _NAMES, _TYPES)])

    out_fields = [f for f in docs.schema.fields if f.name != "_chunk"] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    out_fields += [T.StructField("factors", FACTORS)] if with_factors else []

    def remove(t: pa.Table, replies: pa.Table) -> pa.Table:
        h, check = (np.concatenate([np.zeros(0, np.uint64), *_read(replies, c, np.uint64)]) for c in ("h", "check"))
        order = np.lexsort((check, h))
        h, check = h[order], check[order]
        source = np.concatenate([np.zeros(0, np.int64), *_read(replies, "doc", np.int64)])[order]
        where = np.concatenate([np.zeros(0, np.int32), *_read(replies, "pos", np.int32)])[order]
        done = []
        for part, p in parsed(t, anchors=False):
            x = p.hashes()
            hit = np.flatnonzero(member(h, x)[0])
            found, i = _find(h, check, x[hit], p.checks(hit))
            if len(h):
                found &= source[i] < p.doc[hit]
            hit, i = hit[found], i[found]
            row, begin, length, src, src_begin = factors(p.row[hit], p.pos[hit], source[i] if len(h) else p.doc[hit], where[i] if len(h) else p.pos[hit], window)
            edge, at = np.zeros(int(p.first[-1]) + 1, np.int32), p.first[row] + begin
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            n = np.diff(p.first)
            removed = np.add.reduceat(np.append(gone, False), p.first[:-1]) * (n > 0) if len(n) else n
            kept = []
            for raw, a, b, r in zip(text.texts(part.column(c)), p.first[:-1], p.first[1:], removed):
                ws = raw.split()
                kept.append(b" ".join(ws if not r else [w for w, g in zip(ws, gone[a:b].tolist()) if not g]).decode())
            columns = [*(part.column(j) for j in range(part.num_columns) if j != at_column), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            names = [x for j, x in enumerate(part.schema.names) if j != at_column] + ["n_words", "n_removed", "kept_text"]
            if with_factors:
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for r, *span in zip(row.tolist(), begin.tolist(), length.tolist(), src.tolist(), src_begin.tolist()):
                    spans[r].append(dict(zip(("first", "words", "source", "source_first"), span)))
                columns.append(pa.array(spans, _ARROW))
                names.append("factors")
            done.append(pa.RecordBatch.from_arrays(columns, names=names))
        del h, check, source, where
        release()
        if not done:
            return pa.Table.from_batches([], schema=empty)
        return pa.Table.from_batches(done)

    at_column = at
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = T.StructType(out_fields)
    empty = to_arrow_schema(out_schema)
    chunks = docs.groupBy("_chunk")
    shared = chunks.applyInArrow(ask_anchors, _MSG).groupBy("block").applyInArrow(answer_anchors, _MSG)
    asked = chunks.cogroup(shared.groupBy("chunk")).applyInArrow(ask_windows, _MSG)
    told = asked.groupBy("block").applyInArrow(answer_windows, _MSG)
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(remove, out_schema)


def digest(docs: DataFrame) -> DataFrame:
    """The result of op2."""
    found = dedup(docs.select("doc_id", "text"), with_factors=False)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: For small tables only: it joins every window with every other.
ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS lo FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT g.doc_id, i + o AS p FROM g JOIN f USING (k), unnest(range(0, {WINDOW})) u(o) WHERE f.lo < g.doc_id),
x AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(coalesce(ps, [])) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN (
  SELECT q.doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS i FROM w) q
  LEFT JOIN r ON r.doc_id = q.doc_id AND r.p = q.i WHERE r.p IS NULL GROUP BY q.doc_id) k ON k.doc_id = w.doc_id
"""
