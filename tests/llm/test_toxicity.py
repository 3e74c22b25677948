import random
import zlib

import numpy as np

from tessera.llm import toxicity as T


def rows(n, seed=1):
    r = random.Random(seed)
    clean = [f"w{i}" for i in range(300)]
    bad = ["zorgle" + s for s in ("a", "b", "ix", "ou", "er")] + ["idiot", "scum"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(clean) for _ in range(r.randint(20, 120))]
        y = int(r.random() < 0.2)
        if y:
            for _ in range(r.randint(2, 5)):
                w[r.randrange(len(w))] = r.choice(bad)
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, y))
    return docs, labels


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = rows(3000)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = T.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in T.score_toxicity(d, model).collect()}
    y = {i: t for i, _, t in labels}
    held = [i for i in y if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in y)
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.97
    s = np.array([got[i]["score"] for i in held])
    assert abs(s.mean() - np.mean([y[i] for i in held])) < 0.03
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_edges_and_missing_labels(spark):
    docs = [(1, None, "x"), (2, "", "x"), (None, "you idiot, you scum, idiot", "x"), (4, "fine", "x"), (4, "fine", "x"), (5, "a " * 400_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, y string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.score_toxicity(d, T.train(d, labels)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1] and sum(r["predicted"] for r in got) == 1
    one_class = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.train(d, one_class).trees is None
    assert T.score_toxicity(d.limit(0), T.train(d.limit(0), labels)).count() == 0


def test_features_see_disguise_and_address():
    data = "You st00pid ID1OT!! s t u p".encode()
    x = T.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]), (np.zeros(0, np.uint64), np.zeros(0)))[0]
    f = dict(zip(T.FEATURES, x, strict=True))
    assert f["disguised"] > 0 and f["you"] > 0 and f["capitals"] > 0 and f["doubled"] > 0 and f["inner_symbols"] > 0 and f["spaced"] > 0


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    x = r.random(500)
    xs, ys = T.isotonic(x, (r.random(500) < x).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys[0] < ys[-1] < 1


def test_labels_and_texts_that_repeat_or_disagree(spark):
    docs, labels = rows(600)
    d = spark.createDataFrame(docs + docs[:50] * 3, "doc_id long, text string, score string")
    noisy = labels + labels[:80] + [(i, 1, 1 - t) for i, _, t in labels[100:140]] + [(None, 1, 1), (5, 1, None)]
    once = [x for n, x in enumerate(labels) if not 100 <= n < 140]
    as_rows = lambda z: spark.createDataFrame(z, "doc_id long, quality int, toxic int")
    got, want = (sorted((r["doc_id"], r["score"]) for r in T.score_toxicity(d, T.train(x, as_rows(z))).collect()) for x, z in ((d, noisy), (d.limit(600), once)))
    assert got == want


def test_trees_choose_the_best_split_of_all():
    """One tree of depth one against every split of every feature."""
    r = np.random.default_rng(3)
    x, y = r.integers(0, 12, (60, 3)).astype(np.float32), (r.random(60) < 0.4).astype(float)
    tree = T.Trees(rounds=1, depth=1, rate=1.0, least=5, l2=1.0).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(60, p * (1 - p))
    best = 0.0
    for j in range(3):
        for cut in np.unique(x[:, j]):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= 5:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, gain)
    split = x[:, tree.feature[0][0][0]] <= tree.cut[0][0][0]
    got = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (split, ~split)) - g.sum() ** 2 / (h.sum() + 1)
    assert abs(got - best) < 1e-9
    leaves = np.where(split, g[split].sum() / (h[split].sum() + 1), g[~split].sum() / (h[~split].sum() + 1))
    assert np.allclose(tree.decide(x) - tree.base, leaves)


def test_isotonic_is_the_closest_monotone_fit():
    """Against the max-min formula of isotonic regression, before each pool is drawn to the mean."""
    r = np.random.default_rng(5)
    x, y = np.arange(14.0), (r.random(14) < 0.5).astype(float)
    mean = lambda a, b: y[a : b + 1].mean()
    want = np.array([max(min(mean(a, b) for b in range(i, 14)) for a in range(i + 1)) for i in range(14)])
    xs, ys = T.isotonic(x, y)
    got = np.interp(x, xs, ys)
    for i in range(14):
        pool = np.flatnonzero(np.isclose(want, want[i]))
        assert np.isclose(got[i], (want[i] * len(pool) + y.mean()) / (len(pool) + 1))
