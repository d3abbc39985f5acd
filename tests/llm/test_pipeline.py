import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from chronolink.llm import quality_rules, secrets
from chronolink.llm.common import tokenizer_path

from .test_minhash import brute as classes
from .test_quality_rules import brute as measures
from .test_secrets import brute as spans
from .test_substring_dedup import words


def corpus():
    rng = random.Random(12)
    v = [f"w{k}" for k in range(2000)]
    passage = " ".join(rng.choices(v, k=30))
    docs = []
    for i in range(40):
        text = " ".join(rng.choices(v, k=rng.randint(60, 90)))
        if i % 5 == 1:
            text += " " + passage + "\n" + "tail " + v[i]
        if i % 7 == 2:
            text += f"\npassword: hunter{i}x9 " + "0123456789abcdef" * 2
        docs.append(text)
    docs += [docs[3], docs[5].replace("w1", "w1", 1) + " end", None, "", "short text", "a b c " * 40, docs[1], docs[11] + " more"]
    return docs


def expected(docs):
    rows = [(i, t) for i, t in enumerate(docs)]
    m = {i: measures(t) for i, t in rows}
    # of the rules, these texts can only meet the base ones
    rows = [(i, t) for i, t in rows if not (m[i][0] < quality_rules.MIN_WORDS or 100 * m[i][4] > quality_rules.REPEAT_PCT * m[i][0])]
    group = classes([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    first = {}
    for i, t in rows:
        ws = words(t)
        for j in range(len(ws) - 12):
            first.setdefault(tuple(ws[j : j + 13]), i)
    cut = []
    for i, t in rows:
        ws = words(t)
        gone = {j + o for j in range(len(ws) - 12) if first[tuple(ws[j : j + 13])] < i for o in range(13)}
        cut.append((i, " ".join(w for j, w in enumerate(ws) if j not in gone) if gone else t))
    clean = []
    for i, t in cut:
        at, out = 0, ""
        for s, kind, e in spans(t):
            if s >= at:
                out += t[at:s] + f"[{kind}]"
            at = max(at, e)
        clean.append((i, out + t[at:]))
    tok, pieces = Tokenizer.from_file(tokenizer_path()), {}
    for i, t in clean:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            pieces[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    return pieces


def test_run_equals_brute_force(spark, tmp_path):
    docs = corpus()
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected(docs)
    assert Counter(r.sequence_id for r in got if r.offset == 0).most_common(1)[0][1] == 1
    assert not any(x for t in docs if t for x in secrets.scan_slice(__import__("pyarrow").array([t]))[0] if x[1] == "entropy")


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "word " + " ".join(f"x{k}" for k in range(80)) + " token=abcdefgh", "en", "s", 3, "extra"), (None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, kept_text string")
    for df in (docs, docs.limit(0)):
        out = df
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == df.columns
        rows = out.collect()
        assert len(rows) == (1 if df is docs else 0)
    assert rows == [] and P.STAGES[-1][1](spark, out, "").count() == 0
