import re
from collections import Counter

import duckdb
import pytest

from chronolink.llm import quality_rules as Q

W = [f"w{i}" for i in range(60)]
TEXTS = [
    None, "", " \n\t ", "a b a b a b", " ".join(W), " ".join(W + W[:10]), "\n".join(["same line here"] * 8 + [" ".join(W)]), " ".join(w + "###" for w in W),
    " ".join(w.upper() + "ABC" for w in W), "é\x0bü\x1cx " * 20, "a a a a", "x\n\nx\n x\nx", " ".join(W * 40), "z" * 20000,
]


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(covered))


def test_measures_and_verdict_equal_brute_force_and_sql(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.digest(docs).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert tuple(got[i])[1:6] == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert [got[i].kept for i in range(9)] == [False, False, False, False, True, True, False, False, False]
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    for row in duckdb.sql(Q.ORACLE_SQL).fetchall():
        assert row == tuple(got[row[0]])


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = Q.digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_order_does_not_change_the_verdict(spark, seed):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, rejected_by string, _words int")
    want = {r.doc_id: r.kept for r in Q.digest(docs).collect()}
    order = [x[0] for x in Q.ordered(docs)]
    order = order[seed:] + order[:seed]
    got = Q._prepared(docs, "text").select("doc_id", Q.cascade(order).isNull().alias("kept")).collect()
    assert {r.doc_id: r.kept for r in got} == want
    assert {r.doc_id: r.rejected_by is None for r in Q.judge(docs).collect()} == want
    assert Q.judge(docs.limit(0)).count() == 0
