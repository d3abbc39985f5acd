"""Secret scans.

Fixed patterns give the base spans. Beside them, candidate strings (runs of
``[A-Za-z0-9+/_=-]``) are judged by the Shannon entropy of a sliding window of
``WINDOW`` characters: entering and leaving characters change their counts and
the sum of c*log2(c), so a step costs two updates whatever the window. The
threshold depends on the candidate's character class. An allow-list suppresses
candidates that are long but no secrets. What base spans cover of a candidate
is not repeated; its parts outside them, of ``WINDOW`` characters or more without
the joining characters at the cuts, are judged like any other.

Null or empty text: no spans. A text is scanned whole, however long; repeated
rows are scanned alike; other columns pass through, and an incoming column
with the name of the result is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import appended, extend, without

# The base patterns, their least lengths, and the kinds in order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
KEYWORDS = (b"passw", b"secret", b"token", b"api")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits by character class, under which 1 of 100 windows of uniform random characters of the class lies (200,000 simulated).
THRESHOLDS = {"hex": 2.90, "onecase": 3.40, "alnum": 3.64, "base64": 3.64}
ALLOWED = re.compile(rb"[0-9_+/=-]+|[A-Za-z_+/=-]+|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:[A-Za-z]*[/_-])*[A-Za-z]+[0-9]{0,4}|(?i:.*(?:example|placeholder|changeme|xxxx|0000|1234567890).*)")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


_JOINTS = b"+/_=-"


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX, _CAND, _KEY = _mask(_DIGITS + b"abcdef"), _mask(_DIGITS + _LOWER + _UPPER + b"+/_=-"), _mask(_DIGITS + _UPPER)


def char_class(s: bytes) -> str:
    if re.fullmatch(rb"[0-9a-fA-F]+", s):
        return "hex"
    if not s.isalnum():
        return "base64"
    return "alnum" if s != s.lower() and s != s.upper() else "onecase"


def peak_entropy(s: bytes, window: int = WINDOW) -> float:
    """The largest Shannon entropy in bits of a window of s; of all s if it is shorter."""
    w = min(window, len(s))
    if not w:
        return 0.0
    counts, total = [0] * 256, 0.0
    xlog = [0.0, *(c * math.log2(c) for c in range(1, w + 2))]
    best = 0.0
    for i, c in enumerate(s):
        total += xlog[counts[c] + 1] - xlog[counts[c]]
        counts[c] += 1
        if i >= w:
            out = s[i - w]
            total += xlog[counts[out] - 1] - xlog[counts[out]]
            counts[out] -= 1
        if i >= w - 1:
            best = max(best, math.log2(w) - total / w)
    return best


def is_random(s: bytes) -> bool:
    if ALLOWED.fullmatch(s):
        return False
    return peak_entropy(s) >= THRESHOLDS[char_class(s)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def outside(raw: bytes, s: int, e: int, base: list[tuple[int, int]], ends: list[int]) -> list[tuple[int, int]]:
    """The parts of raw[s:e] that no base span (merged; ends: where they end) covers, of WINDOW characters or more."""
    cuts, at = [], s
    for k in range(bisect_right(ends, s), len(base)):
        a, b = base[k]
        if a >= e:
            break
        cuts.append((at, a))
        at = b
    parts = []
    for a, b in [*cuts, (at, e)]:
        if a > s:
            while a < b and raw[a] in _JOINTS:
                a += 1
        if b < e:
            while a < b and raw[b - 1] in _JOINTS:
                b -= 1
        if b - a >= WINDOW:
            parts.append((a, b))
    return parts


def find(raw: bytes, hexes: list[tuple[int, int]], candidates: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, sorted; hexes and candidates are the long runs of raw."""
    found = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    at = raw.find(b"AKIA")
    while at >= 0:
        end = at + 4
        while end < len(raw) and _KEY[raw[end]]:
            end += 1
        if end - at >= ACCESS_LEAST:
            found.append((at, 1, end))
        at = raw.find(b"AKIA", end)
    found += [(s, 2, e) for s, e in hexes]
    if candidates:
        base = merged(sorted((s, e) for s, _, e in found))
        ends = [e for _, e in base]
        for s, e in candidates:
            found += [(a, 3, b) for a, b in outside(raw, s, e, base, ends) if is_random(raw[a:b])]
    return sorted(found)


def _long(mask: np.ndarray, offs: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    s, e = text.runs(mask, offs)
    keep = e - s >= least
    s, e = s[keep], e[keep]
    doc = np.searchsorted(offs, s, "right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(doc.tolist(), s.tolist(), e.tolist()):
        out.setdefault(d, []).append((a - int(offs[d]), b - int(offs[d])))
    return out


def scan_slice(arr: pa.Array) -> list[list[tuple[int, str, int]]]:
    """Spans (start, kind, end) of each text, in code points."""
    data, offs = text.utf8(arr)
    hexes, cands = _long(_HEX[data], offs, HEX_LEAST), _long(_CAND[data], offs, WINDOW)
    out = []
    for d, raw in enumerate(text.texts(arr)):
        spans = find(raw, hexes.get(d, []), cands.get(d, []))
        if spans and not raw.isascii():
            points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            spans = [(int(points[s]), k, int(points[e])) for s, k, e in spans]
        out.append([(s, KINDS[k], e) for s, k, e in spans])
    return out


def scan(docs: DataFrame, text_col: str = "text", result: str = "secret_spans") -> DataFrame:
    """docs with ``result``: array of (kind, start, end), sorted by start, then kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, text_col):
                found = scan_slice(part.column(part.schema.get_field_index(text_col)))
                yield appended(part, **{result: pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in found], _ARROW)})

    return extend(without(docs, result), [T.StructField(result, SPANS)], run)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with every secret in text_col replaced by its kind in brackets; overlapping spans are merged into the first. Null text stays null."""
    columns = docs.columns

    def clean(raw: str, spans: list[tuple[int, str, int]]) -> str:
        parts, at = [], 0
        for s, kind, e in spans:
            if s >= at:
                parts += [raw[at:s], mark.format(kind)]
            at = max(at, e)
        return "".join([*parts, raw[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            for part in text.slices(batch, text_col):
                arr = part.column(k)
                found = scan_slice(arr)
                if any(found):
                    arr = pa.array([clean(t, f) if f else t for t, f in zip(arr.to_pylist(), found)], arr.type)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], arr, *part.columns[k + 1 :]], names=part.schema.names)

    return docs.mapInArrow(run, docs.schema).select(*[F.col(f"`{c}`") for c in columns])


def digest(docs: DataFrame) -> DataFrame:
    """The result of op1: counts of the base kinds, their digest and all spans."""
    base = lambda s: s["kind"] != "entropy"
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter(spans, base), show), ","), 256).alias("base_sha256"), F.array_join(F.transform(spans, show), ",").alias("spans"), count("entropy").alias("n_entropy"),
    )
