import hashlib
import random

from tokenizers import Tokenizer

from chronolink.llm import bpe
from chronolink.llm.common import tokenizer_path
from chronolink.llm.lexicon import Lexicon, build

TEXTS = [
    None, "", "   \n\t", "Hello, world! it's 42 o'clock", "Éñß ΑΣ ÖffnenSie  a b c \x1c \x85 x\x0by", "see <|endoftext|>now <|startoftext|>", "é ́a café ﬁ Ⅷ ½ İI", "the the the", "z" * 3000, "😀👍🏽 中文字 عربى", "a<|endoftext", "don't DON'T 've'll",
]


def test_lexicon_finds_its_words_and_no_others():
    rng = random.Random(1)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): [rng.randint(0, 9) for _ in range(rng.randint(0, 4))] for _ in range(400)}
    lex = Lexicon(build(words.items()))
    assert lex.n_words == len(words) and lex.n_states < sum(map(len, words))
    for w, ids in words.items():
        assert lex.get(w) == ids
    for _ in range(500):
        w = bytes(rng.choices(b"abcd", k=rng.randint(0, 8)))
        assert lex.get(w) == words.get(w)
    assert Lexicon(build([])).get(b"a") is None


def test_lexicon_is_minimal():
    lex = Lexicon(build([(w, []) for w in (b"taps", b"tops", b"tap", b"top")]))
    assert lex.n_states == 5  # t, then a or o to one state, then p (final), then s


def test_all_characters_one_by_one(spark):
    chars = [chr(c) for c in range(1, 0x260)] + ["ſ", "K", "İ", "ﬀ", "\u2028", "\u3000", "\ufeff", "٣", "²"]
    texts = [x for c in chars for x in (f"a{c}b", f"{c}{c} 1{c}A", f"it{c}s")]
    t = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode(docs, use_lexicon=False).collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids, repr(r.text)


def test_digest_and_round_trip_equal_the_library(spark):
    t = Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(i, x, "q") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for use in (True, False):
        got = {r.doc_id: r for r in bpe.digest(docs, use_lexicon=use).collect()}
        for i, x in enumerate(TEXTS):
            ids = t.encode(x or "", add_special_tokens=False).ids
            assert got[i].n_tokens == len(ids), x
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), x
            assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), x
    rows = bpe.decode(bpe.encode(docs)).collect()
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.digest(docs.limit(0)).count() == 0
