"""BPE encoding and decoding with a public vocabulary file.

White space separates texts into words that the tokenizer treats alone (its
normaliser and its pre-tokenizer never look across ASCII white space), so a
text's ids are its words' ids in order. Frequent words of the whole corpus are
compiled into a minimal acyclic automaton with id outputs (``lexicon``), which
is shipped to the executors as a file and mapped into memory. Words that it
lacks are merged exactly by the tokenizer's own merge rules. Each worker keeps
the words it met last in a bounded table. ``Codec.ids_of`` needs no lexicon: it
tells a slice's words apart in Arrow and merges each distinct piece once.

A text that holds the string of an added token is encoded by the tokenizer as
a whole, as added tokens are matched before anything else. Null text counts as
empty: no ids. Ties and repeated rows need no care: every row stands alone.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text
from .common import appended, extend, tokenizer_path, without
from .lexicon import Lexicon, build

#: Words in the lexicon, words that a scan task reports, and words that a worker remembers.
LEXICON_WORDS, TASK_WORDS, CACHE_WORDS = 1 << 15, 1 << 15, 200_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon.open(SparkFiles.get(name))


@lru_cache(maxsize=2)
def _merger(path: str):
    """The vocabulary's merges alone, for pieces with spaces between them; and which ids end a piece."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    t = _tokenizer(path)
    m = Tokenizer(t.model)
    m.pre_tokenizer = WhitespaceSplit()
    suffix, vocab = t.model.end_of_word_suffix, t.get_vocab(with_added_tokens=True)
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for x, i in vocab.items() if suffix and x.endswith(suffix)]] = True
    return m, last


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, str]:
    return {i: t for t, i in _tokenizer(path).get_vocab(with_added_tokens=True).items()}


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector: tables of words hold no cycles, and walking through them takes as long as the work itself."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def frequent_words(docs: DataFrame, text_col: str = "text", n: int = LEXICON_WORDS, task_words: int = TASK_WORDS) -> list[bytes]:
    """The n most frequent words of all texts. Each task counts all its words, in a table that is cut back to its
    ``task_words`` most frequent ones when four times as many are in it, so a count can fall short by what was cut;
    which words are in the lexicon changes speed, never ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in text.slices(batch, text_col):
                for raw in text.texts(part.column(0)):
                    counts.update(raw.split())
                if len(counts) > 4 * task_words:
                    counts = Counter(dict(counts.most_common(task_words)))
        top = [(w, c) for w, c in counts.most_common(task_words) if len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in found.orderBy(F.desc("n"), "word").limit(n).collect()]


def compile_lexicon(docs: DataFrame, text_col: str, path: str) -> str:
    """Build the automaton on the driver (its size is bounded by LEXICON_WORDS), ship it, and return its file's name."""
    words = frequent_words(docs, text_col)
    encoded = _tokenizer(path).encode_batch([w.decode() for w in words], add_special_tokens=False)
    added = [t.content.encode() for t in _tokenizer(path).get_added_tokens_decoder().values()]
    data = build((w, e.ids) for w, e in zip(words, encoded) if not any(a in w for a in added))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.abspath(os.path.join(tempfile.mkdtemp(), name))
    with open(file, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(file)
    return name


#: Letters below U+0250 (NFC, lower case and class of these are the same everywhere), and words that hold nothing else but ASCII.
_LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower() < "\u0250")
_PLAIN = re.compile(f"[{_LATIN}\x21-\x26\x28-\x7e]+")  # no apostrophe: contractions are cut elsewhere
_PIECE = re.compile(f"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = {b: c for b, c in _byte_chars().items()}
_SPELT = _BYTES | {32: " "}

#: What each byte of a word is; bytes of other characters make it a word for the whole tokenizer.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x27] = _OTHER  # the apostrophe
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The lower case of the Latin letters of two bytes (two bytes too), by code point; 0 for other characters.
_LOWER2 = np.zeros(0x280, np.uint16)
for _c in _LATIN[52:]:
    _LOWER2[ord(_c)] = ord(_c.lower())


def _spans(data: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The spans that data falls into at starts (the first is 0), each distinct one once."""
    offs = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(data)]).dictionary_encode()


def _gathered(flat: np.ndarray, start: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start:start+n] of each item of ``at``, one after the other, and where each begins (one more entry than items)."""
    m = n[at]
    ends = np.concatenate([[0], np.cumsum(m)])
    return flat[np.repeat(start[at] - ends[:-1], m) + np.arange(ends[-1])], ends


class Recent(dict):
    """A table of what was met last: beyond ``most`` entries it becomes the older generation, whose entries come back when asked for."""

    def __init__(self, most: int) -> None:
        self.most, self.older = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def recall(self, keys: set) -> set:
        """The keys that are in neither generation; those of the older one move here."""
        missing = keys.difference(self)
        for k in [k for k in missing if k in self.older]:
            self[k] = self.older[k]
            missing.discard(k)
        return missing


class Codec:
    """Encodes words through the lexicon, else by exact merges, remembering ``form(ids)`` of each word."""

    def __init__(self, path: str, lexicon: str | None, form: Callable[[list[int]], object], most: int = CACHE_WORDS) -> None:
        self.path, self.tokenizer, self.form = path, _tokenizer(path), form
        self.cache, self.pieces = Recent(most), Recent(most)
        self.lexicon = _lexicon(lexicon) if lexicon else None
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode_slice(self, arr: pa.Array) -> Iterator[list]:
        """The forms of each text's words; one form of all ids where the text holds an added token."""
        split = [None if any(a in raw for a in self.added) else raw.split() for raw in text.texts(arr)]
        fresh: set[bytes] = set()
        for ws in split:
            if ws:
                fresh.update(ws)
        self.cache.turn()
        unseen = []
        for w in self.cache.recall(fresh):
            ids = self.lexicon.get(w) if self.lexicon else None
            if ids is None:
                unseen.append(w)
            else:
                self.cache[w] = self.form(ids)
        self._merge(unseen)
        get = self.cache.__getitem__
        for k, ws in enumerate(split):
            if ws is None:
                yield [self.form(self.tokenizer.encode(arr[k].as_py(), add_special_tokens=False).ids)]
            else:
                yield list(map(get, ws))

    def _merge(self, unseen: list[bytes]) -> None:
        """Words of Latin letters and ASCII are cut into the pre-tokenizer's pieces here, and each new piece is merged by the
        vocabulary's model; any other word goes through the whole tokenizer."""
        split, other, pieces, model = [], [], self.pieces, self.tokenizer.model
        for w in unseen:
            if w.isalpha():  # ASCII letters alone are one piece
                split.append((w, [w.lower().decode()]))
                continue
            s = w.decode()
            if _PLAIN.fullmatch(s):
                split.append((w, _PIECE.findall(s.lower())))
            else:
                other.append(w)
        pieces.turn()
        for p in pieces.recall({p for _, ps in split for p in ps}):
            pieces[p] = tuple([t.id for t in model.tokenize(p if p.isascii() else "".join(map(_BYTES.__getitem__, p.encode())))])
        for w, ps in split:
            self.cache[w] = self.form(pieces[ps[0]] if len(ps) == 1 else [i for p in ps for i in pieces[p]])
        for lo in range(0, len(other), 20_000):
            part = other[lo : lo + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.cache[w] = self.form(e.ids)


    def ids_of(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and where each text's begin (one more entry than texts). Words are
        told apart by Arrow, and only those that differ are cut and merged; no lexicon and no ``form`` are needed."""
        raws = text.texts(arr)
        whole = [k for k, raw in enumerate(raws) if any(a in raw for a in self.added)]
        for k in whole:
            raws[k] = b""
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        space = _KIND[data] == _SPACE
        starts = np.concatenate([[0], np.flatnonzero(space[:-1] & ~space[1:]) + 1])  # a word and the white space after it
        first = np.searchsorted(starts, np.cumsum([0, *(len(raw) + 1 for raw in raws)]))
        words = _spans(data, starts)
        flat, start, n = self._ids_of_words(words.dictionary)
        at = words.indices.to_numpy()
        if whole:
            more = [id_bytes(self.tokenizer.encode(arr[k].as_py(), add_special_tokens=False).ids) for k in whole]
            at = np.insert(at, first[whole], np.arange(len(n), len(n) + len(more)))
            first = first + np.searchsorted(whole, np.arange(len(first)))
            flat, start, n = _extended(flat, start, n, more)
        ids, begin = _gathered(flat, start, n, at)
        return ids, begin[first]

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word (with white space after it) where its ids start and how many they are."""
        offs = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        data = _LOWER[np.frombuffer(words.buffers()[2], np.uint8)[: offs[-1]]]
        kind = _KIND[data]
        two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # white space ends every word, so there is a byte after each
        lower = _LOWER2[(data[two] & 31).astype(np.int64) << 6 | data[two + 1] & 63]
        known = (lower > 0) & (data[two + 1] >> 6 == 2)
        two, lower = two[known], lower[known]
        data[two], data[two + 1] = 0xC0 | lower >> 6, 0x80 | lower & 63
        kind[two] = kind[two + 1] = _LETTER
        other = np.zeros(len(words), bool)
        other[np.searchsorted(offs, np.flatnonzero(kind == _OTHER), "right") - 1] = True
        kind[np.repeat(other, np.diff(offs))] = _SPACE
        new = np.empty(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[offs[:-1]] = True
        starts = np.flatnonzero(new)
        spans = _spans(data, starts)
        empty = np.zeros(len(spans.dictionary), bool)
        at = spans.indices.to_numpy()
        empty[at[kind[starts] == _SPACE]] = True
        pieces = [b"" if e else p for e, p in zip(empty.tolist(), spans.dictionary.to_pylist())]
        self.pieces.turn()
        self.pieces[b""] = b""
        self._merge_pieces(self.pieces.recall(set(pieces)))
        found = list(map(self.pieces.__getitem__, pieces))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = _gathered(np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n, n, at)
        begin = begin[np.searchsorted(starts, offs)]
        start, n = begin[:-1], np.diff(begin)
        if other.any():
            rest = np.flatnonzero(other)
            texts = [w.strip() for w in words.take(pa.array(rest)).to_pylist()]
            self.cache.turn()
            unseen = list(self.cache.recall(set(texts)))
            for lo in range(0, len(unseen), 20_000):
                part = unseen[lo : lo + 20_000]
                for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                    self.cache[w] = id_bytes(e.ids)
            flat, start_, n_ = _extended(flat, start, n, [self.cache[w] for w in texts])
            start, n = start_[: len(start)], n_[: len(n)]
            start[rest], n[rest] = start_[len(start) :], n_[len(n) :]
        return flat, start, n

    def _merge_pieces(self, new: set[bytes]) -> None:
        """Many pieces at one call; where the ids that end a piece are not as many as the pieces, each by itself."""
        merger, last = _merger(self.path)
        plain = [p for p in new if p.isascii()]
        for todo in (plain, [p for p in new if not p.isascii()]):
            for lo in range(0, len(todo), 4096):
                part = todo[lo : lo + 4096]
                spelt = b" ".join(part).decode("latin-1")
                spelt = spelt if todo is plain else spelt.translate(_SPELT)
                ids = np.asarray(merger.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
                ends = (np.flatnonzero(last[ids]) + 1) * 4
                if len(ends) == len(part) and ends[-1] == 4 * len(ids):
                    raw, at = ids.tobytes(), 0
                    for p, end in zip(part, ends.tolist()):
                        self.pieces[p] = raw[at:end]
                        at = end
                else:
                    for p, x in zip(part, spelt.split(" ")):
                        self.pieces[p] = id_bytes([t.id for t in self.tokenizer.model.tokenize(x)])


def _extended(flat: np.ndarray, start: np.ndarray, n: np.ndarray, more: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """flat, start and n with those of more after them."""
    m = np.asarray([len(x) // 4 for x in more], np.int64)
    return np.concatenate([flat, np.frombuffer(b"".join(more), "<u4")]), np.concatenate([start, len(flat) + np.cumsum(m) - m]), np.concatenate([n, m])


def _run(docs: DataFrame, text_col: str, fields: list[T.StructField], form: Callable, rows: Callable, path: str | None, use_lexicon: bool) -> DataFrame:
    path = path or tokenizer_path()
    name = compile_lexicon(docs, text_col, path) if use_lexicon else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        codec = Codec(path, name, form(path))
        with uncollected():
            for batch in batches:
                for part in text.slices(batch, text_col):
                    yield appended(part, **rows(codec.encode_slice(part.column(part.schema.get_field_index(text_col)))))

    return extend(without(docs, *[f.name for f in fields]), fields, run)


def encode(docs: DataFrame, text_col: str = "text", result: str = "ids", path: str | None = None, use_lexicon: bool = True) -> DataFrame:
    """docs with ``result``: each text's ids, array<int>."""

    def rows(found: Iterator[list]) -> dict[str, pa.Array]:
        return {result: pa.array([np.frombuffer(b"".join(x), "<i4") for x in found], pa.list_(pa.int32()))}

    return _run(docs, text_col, [T.StructField(result, T.ArrayType(T.IntegerType()))], lambda path: id_bytes, rows, path, use_lexicon)


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.asarray(ids, "<u4").tobytes()


_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def decode(df: DataFrame, ids_col: str = "ids", result: str = "decoded", path: str | None = None) -> DataFrame:
    """df with ``result``: the text of each row's ids, as the tokenizers library decodes them; null ids count as none."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield appended(batch, **{result: pa.array([t.decode(x or [], skip_special_tokens=False) for x in ids], pa.string())})

    return extend(without(df, result), [T.StructField(result, T.StringType())], run)


def digest(docs: DataFrame, path: str | None = None, use_lexicon: bool = True) -> DataFrame:
    """The result of op6. Ids and decoded texts are hashed where they are made, so neither is sent anywhere: a word's
    ids in decimal and its tokens are remembered as strings (the vocabulary has no decoder: a decoded text is its
    tokens joined by spaces)."""

    def form(path: str) -> Callable[[list[int]], tuple[int, bytes, bytes]]:
        names = {i: t.encode() for i, t in _tokens(path).items()}
        if _tokenizer(path).decoder is not None:
            raise ValueError("a vocabulary with a decoder needs encode() and decode()")
        return lambda ids: (len(ids), b"".join(b"%d " % i for i in ids), b"".join(names[i] + b" " for i in ids))

    def rows(found: Iterator[list]) -> dict[str, pa.Array]:
        n, ids, decoded = [], [], []
        for x in found:
            n.append(sum(f[0] for f in x))
            ids.append(hashlib.sha256(b"".join([f[1] for f in x])[:-1]).hexdigest())
            decoded.append(hashlib.sha256(b"".join([f[2] for f in x])[:-1]).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _run(docs.select("doc_id", "text"), "text", fields, form, rows, path, use_lexicon).drop("text")
