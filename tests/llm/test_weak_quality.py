import random

import numpy as np

from tessera.llm import weak_quality as Q


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(2)
    n, accuracy = 40_000, [0.95, 0.8, 0.7, 0.9, 0.65, 0.85, 0.75, 0.9, 0.6]
    y = r.random(n) < 0.7
    v = np.zeros((n, len(accuracy)), np.int64)
    for j, a in enumerate(accuracy):
        right = r.random(n) < a
        v[:, j] = np.where(r.random(n) < 0.2, Q.ABSTAIN, np.where(right == y, Q.GOOD, Q.BAD))
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = Q.fit_votes(patterns, counts.astype(float))
    assert abs(model.share - 0.7) < 0.02
    assert max(abs(a - b) for a, b in zip(model.accuracies().values(), accuracy, strict=True)) < 0.03
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.95


def test_bad_texts_score_below_good_ones(spark):
    r = random.Random(4)
    stop = "the of and to in is that".split()
    docs, good = [], set()
    for i in range(600):
        if i % 3:
            good.add(i)
            docs.append((i, " ".join(" ".join(r.choice(stop) if r.random() < 0.4 else "wo" + r.choice("abcdefgh") + r.choice("rstuv") + str(r.choice("xyz")) for _ in range(12)).capitalize() + "." for _ in range(8))))
        else:
            docs.append((i, r.choice(["Of " * 90, " | ".join(f"Item{j}%%%" for j in range(60)), "BUY NOW!! " * 40, "### $$$ " * 50])))
    docs += [(1000, None), (1001, ""), (None, "x"), (1, "dup")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, votes int")
    got = Q.score_quality(d).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] > 1 and r["doc_id"] < 1000}
    assert np.mean([by[i]["predicted"] == 1 for i in by if i in good]) > 0.97 and np.mean([by[i]["predicted"] == 0 for i in by if i not in good]) > 0.9
    assert Q.score_quality(d.limit(0)).count() == 0


def test_em_equals_a_plain_one_over_rows():
    """The fit over counts of patterns against expectation and maximisation row by row, with dictionaries."""
    r = np.random.default_rng(9)
    v = r.integers(0, 3, (300, 5))
    v[:100] = np.where(r.random((100, 5)) < 0.8, Q.GOOD, v[:100])
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = Q.fit_votes(patterns, counts.astype(float), rounds=20)
    rows = [tuple(int(x) for x in row) for row in v]
    p = []
    for row in rows:
        a = (sum(x == Q.GOOD for x in row) + 1) / (sum(x != Q.ABSTAIN for x in row) + 2)
        p.append(a**4 / (a**4 + (1 - a) ** 4))
    for _ in range(20):
        share = sum(p) / len(p)
        table = {}
        for j in range(5):
            for y in (0, 1):
                w = [1.0, 1.0, 1.0]
                for row, q in zip(rows, p, strict=True):
                    w[row[j]] += q if y else 1 - q
                table[j, y] = [x / sum(w) for x in w]
        new = []
        for row in rows:
            good, bad = share, 1 - share
            for j, x in enumerate(row):
                good, bad = good * table[j, 1][x], bad * table[j, 0][x]
            new.append(good / (good + bad))
        p = new
    assert abs(model.share - share) < 1e-6 and np.allclose(model.posterior(v), p, atol=1e-6)


def test_sample_sees_every_distinct_text(spark):
    r = random.Random(1)
    good = [" ".join(r.choice("the of and to a river stone house walks under green light".split()) for _ in range(60)).capitalize() + "." for _ in range(3)]
    texts = good + ["### $$$ BUY NOW " * 30]
    d = spark.createDataFrame([(i % 40, texts[i % 4]) for i in range(20_000)], "doc_id long, text string")
    got = {(r["doc_id"] % 4, r["predicted"], round(r["posterior"])) for r in Q.score_quality(d).collect()}
    assert got == {(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 0)}


def test_linear_scorer_against_a_plain_sum(spark):
    r = np.random.default_rng(2)
    s = Q.Scorer(10)
    s.weights, s.bias = r.normal(size=2 << 10).astype(np.float32), 0.3
    texts = ["Some words, some words.", "", "x", "Ünïcode und 12 mehr"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw])
    got = s.score(data, off)
    for b, z in zip(raw, got, strict=True):
        a = np.frombuffer(b, np.uint8)
        w, _, t, _ = Q.hashed(a, np.array([0, len(a)]), 10)
        plain = 0.3 + sum(sum(float(s.weights[i]) for i in x) / max(len(x), 1) for x in (w, t))
        assert abs(z - 1 / (1 + np.exp(-plain))) < 1e-6
