"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a column expression that is true where it rejects. A rule's cost
and selectivity are measured on a random sample of about ``SAMPLE`` rows (time of
one pass that evaluates the rule alone, over the time of a pass that evaluates
nothing; share of rows that it rejects), rules are ordered by rejections per
cost, and one CASE expression tries them in that order: a later rule is never
evaluated for a row that an earlier one rejects. The sample decides the order
only; which rows are rejected does not depend on it.

Null text counts as empty: no words, so it is rejected. Long texts are read
whole, repeated rows are judged alike, other columns pass through, and an
incoming column with the name of a result is replaced. No rows: no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

SAMPLE = 1000
#: Limits of the rules; the first two are the base rules.
MIN_WORDS, REPEAT_PCT, SYMBOL_PCT, DUP_LINE_PCT, DUP_LINES, SHOUT_PCT = 50, 50, 8, 30, 5, 60

_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT, -1), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Words covered by 3-word windows found twice or more. Windows are compared by a 64-bit hash of their three words:
    sorted by it, equal windows are neighbours; their positions, in order, give the covered words by one fold."""
    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")))
    twice = lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
    at = F.sort_array(F.transform(let(F.sort_array(windows), lambda s: twice(s)), lambda x: x["p"]))
    fold = F.aggregate(
        at, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 2).alias("last"), (a["n"] + F.least(F.lit(3), p + 2 - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(ws) >= 4, fold).otherwise(0).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column, ws: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(_SYMBOLS)), F.lit(0)).cast("long"),
        "n_dup_lines": let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(ws),
    }


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules(text: Column, m: dict[str, Column]) -> list[Rule]:
    """The rules over measures m: columns that hold them, or the expressions themselves (then only what a rule needs is computed)."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{Lu}+", ""))
    return [
        Rule("few_words", m["n_words"] < MIN_WORDS),
        Rule("repeated_words", 100 * m["n_repeat_words"] > REPEAT_PCT * m["n_words"]),
        Rule("symbols", 100 * m["n_symbols"] > SYMBOL_PCT * m["word_chars"]),
        Rule("repeated_lines", (m["n_dup_lines"] >= DUP_LINES) & (100 * m["n_dup_lines"] > DUP_LINE_PCT * F.size(lines(text)))),
        Rule("shouting", 100 * capitals > SHOUT_PCT * letters),
    ]


def _prepared(docs: DataFrame, text_col: str) -> DataFrame:
    return without(docs, "_words").withColumn("_words", words(F.col(text_col)))


def ordered(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds a row) and selectivity on the sample, best rejection per cost first."""
    share = min(1.0, sample / max(1, docs.count()))
    rows = _prepared(docs.select(F.col(text_col)).sample(share, seed=9), text_col).persist()
    n = max(1, rows.count())
    text, found = F.col(text_col), []

    def timed(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hit = rows.select(rejects.alias("r")).agg(F.count_if("r")).first()[0]
        return time.perf_counter() - began, hit

    idle = timed(F.lit(False))[0]
    for rule in rules(text, measures(text, F.col("_words"))):
        took, hit = timed(rule.rejects)
        found.append((rule, max(took - idle, 1e-4) / n, hit / n))
    rows.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(order: list[Rule]) -> Column:
    """Name of the first rule in order that rejects the row, else null."""
    out = F.when(order[0].rejects, F.lit(order[0].name))
    for rule in order[1:]:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def judge(docs: DataFrame, text_col: str = "text", result: str = "rejected_by") -> DataFrame:
    """docs with ``result``: the rule that rejects the row, else null. Measures are computed as far as the cascade gets."""
    docs, text = without(docs, result), F.col(text_col)
    names = [rule.name for rule, _, _ in ordered(docs, text_col)]

    def verdict(ws: Column) -> Column:
        by_name = {rule.name: rule for rule in rules(text, measures(text, ws))}
        return cascade([by_name[n] for n in names])

    # the words are bound inside the expression: as a column of their own, a filter on the result that is pushed below
    # would cut the text into words anew at every use
    return docs.withColumn(result, let(words(text), verdict))


def digest(docs: DataFrame) -> DataFrame:
    """The result of op9: the measures of every document and the verdict of the cascade over them."""
    docs = docs.select("doc_id", "text")
    names = [rule.name for rule, _, _ in ordered(docs)]
    text, measured = F.col("text"), _prepared(docs, "text")
    measured = measured.select("doc_id", "text", *[c.alias(k) for k, c in measures(text, F.col("_words")).items()])
    by_name = {r.name: r for r in rules(text, {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})}
    verdict = cascade([by_name[n] for n in names])
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (by_name["few_words"].rejects | by_name["repeated_words"].rejects).alias("base_failed"), verdict.isNull().alias("kept"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(ls) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '{_SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words OR 100 * n_symbols > {SYMBOL_PCT} * word_chars
            OR (n_dup_lines >= {DUP_LINES} AND 100 * n_dup_lines > {DUP_LINE_PCT} * n_lines)
            OR 100 * length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) > {SHOUT_PCT} * length(regexp_replace(t, '\P{{L}}+', '', 'g'))) AS kept
FROM m
"""
