import random
import re

import pytest

from tessera.llm import jaccard_join as J


def sets_of(texts, k=5):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts):
    sets = sets_of(texts)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [(x, len(sets[i]), (least.get(root(i)) if sets[i] else x)) for i, x in enumerate(ids)]


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(r.choice([4, 40, 400]))]
    texts = []
    while len(texts) < n:
        kind = r.random()
        if texts and kind < 0.6:
            w = (r.choice(texts) or "").split()
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w) + r.choice(["", " tail", "\n"]))
        else:
            texts.append(r.choice([None, "", " \t", " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 5, 9, 30, 120])))]) if kind > 0.9 else " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 40, 150]))))
    return texts


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 512), (3, 6), (4, 6), (5, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = corpus(seed, 140)
    ids = [None if i % 37 == 5 else i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, node long").repartition(4)
    got = [tuple(r) for r in J.near_duplicates(docs, sample_one_in=2, common_least=3).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(ids, texts), key=key)


def test_one_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (1, a + " x"), (2, b), (2, b), (5, ""), (6, None), (None, b + " y"), (7, "alone")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, label string")
    got = J.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 5, 6, 7]
    assert J.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_divide_skip(seed):
    r = random.Random(seed)
    lists = [sorted(r.sample(range(60), r.randint(0, 40))) for _ in range(r.randint(1, 25))]
    for need in (1, 2, 5, 12):
        counts = {x: sum(x in one for one in lists) for x in range(60)}
        assert J.divide_skip(lists, need) == {x: c for x, c in counts.items() if c >= need}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in J.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_joins_by_shingle_have_one_plan_at_every_size(spark, monkeypatch):
    plans = []
    cut = J.cut

    def noted(df, name, *args, **kwargs):
        if name == "met":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df, name, *args, **kwargs)

    monkeypatch.setattr(J, "cut", noted)
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i // 2}" for j in range(40))) for i in range(40)], "doc_id long, text string")
    J.near_duplicates(docs).collect()
    assert len(plans) == 3
    for plan in plans:
        by_key = [x for x in plan.splitlines() if "Join" in x and "[key" in x]
        assert by_key and all("SortMergeJoin" in x and "salt_" in x for x in by_key)
