"""Language identification of mixed-language text.

Every word gets a score per language: mean log-likelihood of its byte n-grams
(1 to ``GRAM`` bytes of the lower-cased word with its ends marked) under hashed
count models of the languages. The script ranges that a word's letters fall
into narrow the candidates first: languages whose training text hardly uses
that script are out for this word. Viterbi over the words, with a constant
penalty for switching, labels each word; equal neighbours form spans. A text's
language is that of most of its letters, its score their share times how far
the winner leads per word.

Models are fitted on at most about ``TRAIN_DOCS`` documents a language, taken
by a hash of their ids from the rows that are allowed for learning. Values of
the language column on fewer than ``LEAST_SHARE`` of those rows are not learned,
so the fitted tables have a bounded size. Null text, or text without a letter: ``und``, score
0 and no spans. Texts are read whole; repeated rows are labelled alike; ties
go to the language first in alphabetical order. Without any row to learn from,
every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import appended, extend, without

TRAIN_DOCS, LEAST_SHARE, BUCKETS, GRAM, SWITCH, CACHE_WORDS = 2000, 1e-3, 1 << 15, 4, 12.0, 200_000
SCRIPT_SHARE, OUT = 0.02, -40.0

# First and last code points of script ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
NAMES = list(SCRIPTS)


def script(word: str) -> int:
    """Number of the script of most letters of a word, len(SCRIPTS) for another, -1 without letters."""
    n = [0] * (len(NAMES) + 1)
    for c in word:
        if c.isalpha():
            o = ord(c)
            n[next((k for k, x in enumerate(NAMES) if any(a <= o <= b for a, b in SCRIPTS[x])), len(NAMES))] += 1
    return int(np.argmax(n)) if any(n) else -1


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased words, and each word's first one (one more entry than words)."""
    marked = [b"\x02" + w.decode("utf-8", "replace").lower().encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lengths = np.array([len(m) for m in marked], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    own, parts, owners = np.repeat(np.arange(len(words)), lengths), [], []
    for n in range(1, GRAM + 1):
        h = text.mix(text.grams(data + np.uint64(1), n), n)
        ok = text.inside(first, n, len(data))
        parts.append((h[ok] & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(own[: len(h)][ok])
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return np.concatenate(parts)[order], np.searchsorted(at[order], np.arange(len(words) + 1))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts (with "other" and "none") x languages


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on a hash sample of labelled rows, of about train_docs a language at most."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().where(F.col("count") >= LEAST_SHARE * n).collect()}  # 1 / LEAST_SHARE values at most
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES) + 2, 0), bool))
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(1.0, train_docs / m))) for k, m in sorted(counts.items())])
    unit = (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("lid")), F.lit(1 << 20)) / float(1 << 20)).cast("double")
    sample = rows.where(unit < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text.slices(batch, "text"):
                by: dict[str, list[bytes]] = {}
                for lang, raw in zip(part.column(0).to_pylist(), text.texts(part.column(1))):
                    by.setdefault(lang, []).extend(raw.split())
                for lang, ws in by.items():
                    own = grams.setdefault(lang, np.zeros(BUCKETS + len(NAMES) + 2, np.int64))
                    unique = {}
                    for w in ws:
                        unique[w] = unique.get(w, 0) + 1
                    if unique:
                        n, (g, first) = np.array(list(unique.values())), word_grams(list(unique))
                        own[:BUCKETS] += np.bincount(g, np.repeat(n, np.diff(first)), BUCKETS).astype(np.int64)
                        np.add.at(own, [BUCKETS + script(w.decode()) for w in unique], n)
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array([x.tobytes() for x in grams.values()], pa.binary())], names=["lang", "n"])

    langs = sorted(counts)
    total = {k: np.zeros(BUCKETS + len(NAMES) + 2, np.int64) for k in langs}
    for r in sample.mapInArrow(count, "lang string, n binary").collect():  # 16 tasks x languages, of fixed size
        total[r.lang] += np.frombuffer(r.n, np.int64)
    all_n = np.array([total[k] for k in langs], float)
    grams = all_n[:, :BUCKETS] + 0.5
    logp = np.log(grams / grams.sum(1, keepdims=True)).T
    scripts = all_n[:, BUCKETS : BUCKETS + len(NAMES) + 1]
    allowed = np.ones((len(NAMES) + 2, len(langs)), bool)
    allowed[: len(NAMES) + 1] = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE).T
    allowed[~allowed.any(1)] = True  # a script that no language uses narrows nothing
    return Model(langs, logp.astype(np.float32), allowed)


class Scorer:
    """Scores of words, remembered in a bounded table."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}
        self._clear()

    def _clear(self) -> None:
        self.cache.clear()
        self.scores, self.letters = np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int32)

    def numbers(self, split: list[list[bytes]]) -> np.ndarray:
        """A row number of ``scores`` for each word of all texts."""
        fresh: set[bytes] = set()
        for ws in split:
            fresh.update(ws)
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self._clear()
        new = list(fresh.difference(self.cache))
        for lo in range(0, len(new), 20_000):
            self._add(new[lo : lo + 20_000])
        get = self.cache.__getitem__
        return np.fromiter((get(w) for ws in split for w in ws), np.int64)

    def _add(self, new: list[bytes]) -> None:
        at = len(self.letters)
        self.cache.update(zip(new, range(at, at + len(new))))
        decoded = [w.decode() for w in new]
        letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in decoded], np.int32)
        kinds = np.array([0 if w.isascii() and n else script(w) for w, n in zip(decoded, letters)])
        g, first = word_grams(new)
        s = np.add.reduceat(self.model.logp[g], first[:-1], axis=0)
        s -= s.max(1, keepdims=True)
        s /= np.sqrt(np.maximum(np.diff(first), 1))[:, None]  # n-grams of a word overlap: they count as fewer
        s = np.where(self.model.allowed[kinds], s, OUT)
        s = np.maximum(s - s.max(1, keepdims=True), OUT)
        s[letters == 0] = 0
        self.scores, self.letters = np.concatenate([self.scores, s.astype(np.float32)]), np.concatenate([self.letters, letters])


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; texts are consecutive rows of scores, and all texts take a step together."""
    n_langs, lengths = scores.shape[1], np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than t
    kind = np.int8 if n_langs < 128 else np.int16
    labels, came = np.zeros(len(scores), kind), np.zeros((len(scores), n_langs), kind)
    v, own = np.zeros((len(lengths), n_langs), np.float32), np.arange(n_langs, dtype=kind)
    for t in range(steps):
        a = active[t]
        now, rows = v[:a], starts[:a] + t
        best = now.argmax(1)
        jump = now[np.arange(a), best][:, None] - switch
        stay = now >= jump
        came[rows] = np.where(stay, own, best[:, None].astype(kind))
        v[:a] = np.where(stay, now, jump) + scores[rows]
    at = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        rows = starts[:a] + t
        labels[rows] = at[:a]
        at[:a] = came[rows, at[:a]]
    return labels


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and, if asked for, lang_spans (language, first word, end word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, n_langs = Scorer(model), len(model.langs)
        for batch in batches:
            for part in text.slices(batch, text_col, 2 * text.SLICE_BYTES):
                split = [raw.split() for raw in text.texts(part.column(part.schema.get_field_index(text_col)))]
                first = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
                pred, score, found = ["und"] * len(split), np.zeros(len(split)), [[] for _ in split]
                if n_langs and first[-1]:
                    rows = scorer.numbers(split)
                    scores, letters = scorer.scores[rows], scorer.letters[rows]
                    labels = viterbi(scores, first)
                    doc = text.owner(first)
                    mass = np.bincount(doc * n_langs + labels, letters, len(split) * n_langs).reshape(-1, n_langs)
                    total = mass.sum(1)
                    win = mass.argmax(1)
                    lead = np.bincount(doc, np.where(labels == win[doc], letters * (1 - np.exp(-(scores[np.arange(len(labels)), labels] - _second(scores, labels)).clip(0))), 0), len(split))
                    ok = total > 0
                    score[ok] = (0.5 * mass[ok, win[ok]] + 0.5 * lead[ok]) / total[ok]
                    pred = [model.langs[w] if k else "und" for w, k in zip(win, ok)]
                    if spans:
                        cut = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]))
                        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(labels)]):
                            if ok[doc[a]]:
                                base = first[doc[a]]
                                found[doc[a]].append({"lang": model.langs[labels[a]], "first": a - base, "end": b - base})
                out = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}
                yield appended(part, **out, **({"lang_spans": pa.array(found, _ARROW)} if spans else {}))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("lang_spans", SPANS)] if spans else [])]
    return extend(without(docs, *[f.name for f in fields]), fields, run)


def _second(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The best score of any other language than the label; far below it if there is no other."""
    if scores.shape[1] == 1:
        return np.full(len(scores), OUT)
    s = scores.copy()
    s[np.arange(len(s)), labels] = -np.inf
    return s.max(1)


def held_out(key: str = "doc_id", mod: int = 3, rest: int = 1) -> Column:
    """Whether a row is kept from learning; a null id is (it has no remainder)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(True))


def digest(docs: DataFrame) -> DataFrame:
    """The result of op10."""
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return identify(docs.select("doc_id", "text"), model, spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
