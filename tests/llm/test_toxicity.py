import random

import numpy as np

from chronolink.llm import toxicity as X


def brute(clauses):
    """Arcs straight from their definition; clauses are lists of symbols."""
    out = np.zeros(len(X.ARCS))
    for c in clauses:
        at = [i for i, x in enumerate(c) if x in (X.INSULT, X.THREAT)]
        if at:
            insults, first = c.count(X.INSULT), c.index(X.THREAT) if X.THREAT in c else None
            whole = first is not None and (X.INTENT in c[:first] or X.TARGET in c[first:])
            negated = all(X.NEGATION in c[max(0, i - X.NEG_REACH) : i] for i in at)
            reported = all(X.REPORT in c[:i] for i in at)
            out += [insults > 0, insults > 1, first is not None and not whole, whole, X.TARGET in c, negated, reported]
    return out


def test_composed_machine_equals_the_definition():
    rng = random.Random(2)
    for _ in range(2000):
        clauses = [[rng.randrange(X.END) for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(1, 4))]
        assert (X.matches([y for c in clauses for y in [*c, X.END]]) == brute(clauses)).all()


def brute_score(text, words, weights):
    clauses = [[]]
    for line in text.split("\n"):
        for w in line.split():
            clauses[-1].append(words.get(w.strip(".,!?\"").lower(), X.OTHER))
            if w[-1] in ".!?;:\"":
                clauses.append([])
        clauses.append([])
    z = weights[0] + sum(w * np.log(1 + n) for w, n in zip(weights[1:], brute(clauses)))
    return 1 / (1 + np.exp(-z))


def test_score_equals_the_definition_and_clauses_outweigh_words(spark):
    rng = random.Random(3)
    v = ["idiot", "kill", "you", "not", "said", "will", "house", "walk", "tree", "the"]
    texts = [" ".join(rng.choice(v) + rng.choice(["", "", "", ".", "!", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    texts += ["kill", "I will kill you", "an idiot", "you idiot", "you are not an idiot", "he said an idiot", "fool, moron, jerk", "long " * 200_000 + "you idiot", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.toxicity for r in X.score(df, X.Model(X.seeds())).orderBy("doc_id").collect()]
    assert np.allclose(got, [brute_score(t or "", X.seeds(), X.prior()) for t in texts])
    word, threat, plain, aimed, negated, said, several = got[200:207]
    assert word < 0.2 < 0.5 < threat and plain < aimed and negated < 0.2 and said < plain < several and got[207] == aimed and got[208] < 0.1


def rows(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        ws = rng.choices([f"word{k}" for k in range(300)], k=40)
        toxic = i % 4 == 0
        if toxic:
            ws.insert(rng.randrange(40), rng.choice(["zorgling", "zorgath", "zorgite", "idiot"]))
        docs.append((i, " ".join(ws), "src"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_stems_and_edges(spark):
    docs, labels = rows()
    docs += [(5000, None, ""), (5001, "", ""), (5002, "he said nobody is an idiot.", ""), (5003, "you idiot", ""), (5000, "", ""), (None, "zorgxyz", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    lab = spark.createDataFrame([*labels, (7, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = X.digest(d, lab).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert by[5000].score < 0.5 and by[5001].score < 0.5 and by[None].predicted == 1 and by[None].held_out
    assert by[5002].score < by[5003].score and by[5003].predicted == 1
    assert X.digest(d.limit(0), lab).count() == 0
    assert [r.predicted for r in X.digest(d.where("doc_id = 5003"), lab.limit(0)).collect()] == [1]
