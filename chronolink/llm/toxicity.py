"""Toxicity by a weighted finite-state grammar over clauses.

Words are first mapped to symbols: insult, threat, target, negation, reporting
verb, intent, clause end, or other. Five transducers read a clause's symbols in
step and are composed into one machine (their product, restricted to states
that can be reached):

* insult: none, one, or several insulting words;
* threat: a threatening verb alone, or a whole threat, whose verb follows a word
  of intent or is followed by a target ("I will hurt", "hurt you");
* target: whether somebody is addressed or meant;
* negation: how near a negating word is, and whether a match was not negated;
* reported speech: whether a reporting verb came before, and whether a match
  came before it.

At a clause's end the machine emits the arcs that its matches have passed
(``ARCS``), and a clause's score is the sum of their weights: insults, whole
threats and targets add, negation and reported speech take away. So a clause is
one match, however many insulting words it has, and a threatening word alone
counts for little. A text's score is the logistic sum of the weights of its
clauses' arcs, each arc with the logarithm of its number of clauses.

The insult lexicon holds the fixed words below and the words and stems
(prefixes of 4 to 6 letters) that the learning rows tie to the label: in at
least ``MIN_DOCS`` toxic documents of the sample, and ``MIN_RATIO`` times as
likely there as elsewhere. Weights are fitted around a prior that knows the
arcs' signs. Learning uses about ``TRAIN_ROWS`` labelled rows of each class at
most, taken by a hash of their ids; that bounds the lexicon, too.

Null or empty text has no match and gets the score of a text without matches.
Repeated rows score alike, texts are read whole, other columns play no part.
Null labels are not learned from, a doc_id with two labels counts as toxic;
without labels the prior stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import appended, extend, without

TRAIN_ROWS, MIN_DOCS, MIN_RATIO, CACHE_WORDS = 6000, 6, 12.0, 300_000
NEG_REACH = 3

# The seed lexicon.
INSULTS = ["idiot", "moron", "stupid", "pathetic", "loser", "scum", "worthless", "clown", "trash", "disgusting", "dumb", "fool", "imbecile", "jerk", "garbage"]
THREATS = ["kill", "destroy", "hurt", "hunt", "beat", "strangle", "stab", "shoot", "crush"]
TARGETS = ["you", "your", "yours", "yourself", "he", "she", "they", "them", "him", "her", "people", "everyone", "u", "tu", "vous", "du", "ihr", "usted", "ustedes"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "wasn't", "don't", "doesn't", "nobody", "without", "nicht", "kein", "keine", "pas", "jamais", "nunca"]
INTENTS = ["will", "gonna", "going", "shall", "must", "i'll", "we'll", "should", "werde", "werden", "vais", "voy"]
REPORTS = ["said", "says", "say", "called", "calls", "wrote", "quoted", "claims", "claimed", "reported", "allegedly", "sagte", "dit", "dijo"]

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, END = range(8)
#: What a clause's matches can pass.
ARCS = ["insult", "insults", "threat word", "threat", "aimed", "negated", "reported"]


def _insult(s: int, x: int) -> int:
    return min(2, s + 1) if x == INSULT else s


def _threat(s: int, x: int) -> int:
    """0 nothing, 1 intent, 2 a threatening word, 3 a threat."""
    if x == THREAT:
        return {0: 2, 1: 3}.get(s, s)
    if s == 0 and x == INTENT:
        return 1
    return 3 if s == 2 and x == TARGET else s


def _target(s: int, x: int) -> int:
    return 1 if x == TARGET else s


def _negation(s: tuple[int, int], x: int) -> tuple[int, int]:
    """(words that the last negation still reaches, whether a match was out of reach)."""
    near, meant = s
    meant |= int(x in (INSULT, THREAT) and not near)
    return (NEG_REACH if x == NEGATION else max(0, near - 1), meant)


def _reported(s: tuple[int, int], x: int) -> tuple[int, int]:
    """(whether a reporting verb came, whether a match came before it)."""
    said, own = s
    return (said | int(x == REPORT), own | int(x in (INSULT, THREAT) and not said))


def compose() -> tuple[list[list[int]], list[tuple[int, ...] | None]]:
    """The product machine: next state by state and symbol, and what each state emits at a clause's end (None without a match);
    a clause begins in state 0."""
    start = (0, 0, 0, (0, 0), (0, 0))
    number, states, step = {start: 0}, [start], []
    for s in states:  # grows while states are met for the first time
        row = []
        for x in range(END):
            t = (_insult(s[0], x), _threat(s[1], x), _target(s[2], x), _negation(s[3], x), _reported(s[4], x))
            if t not in number:
                number[t] = len(states)
                states.append(t)
            row.append(number[t])
        step.append([*row, 0])
    emit = [(int(i > 0), int(i > 1), int(t == 2), int(t == 3), g, int(not n[1]), int(not r[1])) if i or t > 1 else None for i, t, g, n, r in states]
    return step, emit


STEP, EMIT = compose()


def matches(symbols: list[int]) -> np.ndarray:
    """Numbers of a text's clauses that pass each arc."""
    out, state, step = [0] * len(ARCS), 0, STEP
    for x in [*symbols, END]:
        if x == END and (arcs := EMIT[state]):
            out = [a + b for a, b in zip(out, arcs)]
        state = step[state][x]
    return np.array(out, float)


def features(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


#: Signs of the arcs' weights; learning keeps them.
SIGNS = np.array([1, 1, 1, 1, 1, -1, -1])


def prior() -> np.ndarray:
    """Weights before learning: the bias, then the arcs."""
    return np.array([-4.0, 6.0, 1.5, 2.0, 6.0, 1.5, -4.5, -3.0])


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    stems: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=prior)


def seeds() -> dict[str, int]:
    return {w: s for ws, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENTS, INTENT), (THREATS, THREAT), (INSULTS, INSULT)) for w in ws}


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CLAUSE = re.compile(r"[.!?;:\"”»]\W*$")


def symbol(raw: bytes, model: Model) -> tuple[int, int]:
    """The symbol of a word, and whether it ends a clause."""
    word = raw.decode()
    end = int(bool(_CLAUSE.search(word)))
    core = _EDGE.sub("", word).lower()
    s = model.words.get(core)
    if s is None:
        s = INSULT if any(core[:k] in model.stems for k in (4, 5, 6) if len(core) >= k) else OTHER
    return s, end


class Reader:
    """Symbols of texts, with words remembered in a bounded table."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}

    def counts(self, raw: bytes) -> np.ndarray | None:
        """Numbers of a text's clauses by arc; None if no word of it is an insult or threat."""
        cache, ws = self.cache, raw.split()
        fresh = set(ws).difference(cache)
        if len(cache) + len(fresh) > CACHE_WORDS:
            cache.clear()
            fresh = set(ws)
        for w in fresh:
            cache[w] = symbol(w, self.model)
        found = list(map(cache.__getitem__, ws))
        if not any(s in (INSULT, THREAT) for s, _ in set(found)):
            return None
        out: list[int] = []
        for line in raw.split(b"\n"):
            for w in line.split():
                s, end = cache[w]
                out.append(s)
                if end:
                    out.append(END)
            out.append(END)
        return matches(out)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Maximum a posteriori logistic weights around the prior, by Newton steps; no arc's weight changes its sign."""
    mean = prior()
    w, design = mean.copy(), np.hstack([np.ones((len(x), 1)), x])
    for _ in range(30):
        p = sigmoid(design @ w)
        grad = design.T @ (p - y) + strength * (w - mean)
        hess = (design * (p * (1 - p))[:, None]).T @ design + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:] * SIGNS, 0) * SIGNS
    return w


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of about ``rows`` labelled documents of each class at most, by a hash of their ids."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    unit = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("tox")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, rows / max(1, n.get(1, 0)))).otherwise(min(1.0, rows / max(1, n.get(0, 0))))
    taken = F.broadcast(labels.where(unit < share))  # about 2 * rows rows of two numbers, whatever the input
    return docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("text")).join(taken, "_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    train = sample(docs, labels, rows).persist()
    n = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    model = Model(seeds())
    if n.get(0) and n.get(1):

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally: dict[str, list[int]] = {}
            for batch in batches:
                for raw, toxic in zip(text.texts(batch.column(0)), batch.column(1).to_pylist()):
                    cores = {_EDGE.sub("", w.decode()).lower() for w in set(raw.split())}
                    for k in {*("=" + c for c in cores), *(c[:n] for c in cores for n in (4, 5, 6) if len(c) >= n)}:
                        tally.setdefault(k, [0, 0])[toxic] += 1
            for lo in range(0, len(tally), 50_000):
                items = list(tally.items())[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items]), pa.array([v[1] for _, v in items], pa.int64()), pa.array([v[0] for _, v in items], pa.int64())], names=["part", "toxic", "other"])

        ratio = ((F.col("toxic") + 0.1) / n[1]) / ((F.col("other") + 0.5) / n[0])
        tied = (
            train.mapInArrow(parts, "part string, toxic long, other long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
            .where((F.col("toxic") >= MIN_DOCS) & (ratio >= MIN_RATIO)).collect()  # what stands in MIN_DOCS of about TRAIN_ROWS texts
        )
        words = {r.part[1:]: INSULT for r in tied if r.part[0] == "="}
        model = Model({**words, **seeds()}, frozenset(r.part for r in tied if r.part[0] != "="))
        lexicon = model

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(lexicon)
            for batch in batches:
                found = [reader.counts(raw) for raw in text.texts(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([[0.0] * len(ARCS) if c is None else c.tolist() for c in found], pa.list_(pa.float64())), batch.column(1)], names=["n", "toxic"])

        table = train.mapInArrow(count, "n array<double>, toxic int").groupBy("n", "toxic").count().collect()
        x = np.array([r.n for r in table for _ in range(min(r["count"], 2 * rows))]).reshape(-1, len(ARCS))
        y = np.array([r.toxic for r in table for _ in range(min(r["count"], 2 * rows))], float)
        model = Model(model.words, model.stems, fit_weights(features(x), y))
    train.unpersist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", result: str = "toxicity") -> DataFrame:
    """docs with ``result`` (0 to 1) and result_matches: numbers of clauses by ARCS, null where nothing matches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon bounded by the sample, and len(ARCS) weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, Reader(shared.value)
        for batch in batches:
            for part in text.slices(batch, text_col):
                found = [reader.counts(raw) for raw in text.texts(part.column(part.schema.get_field_index(text_col)))]
                x = features(np.array([np.zeros(len(ARCS)) if c is None else c for c in found]))
                p = sigmoid(model.weights[0] + x @ model.weights[1:])
                yield appended(part, **{result: pa.array(p, pa.float64()), f"{result}_matches": pa.array([None if c is None else c.astype(int).tolist() for c in found], pa.list_(pa.int64()))})

    fields = [T.StructField(result, T.DoubleType()), T.StructField(f"{result}_matches", T.ArrayType(T.LongType()))]
    return extend(without(docs, *[f.name for f in fields]), fields, run)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of op7."""
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
