import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import substring_dedup as S


def brute(texts, span):
    seen = Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    alphabet = "ab é\n" if seed % 2 else "abcdefghijklmnopqrstuvwxyz é😀"
    word = lambda m: "".join(r.choice(alphabet) for _ in range(m))
    shared = [word(r.randint(40, 400)) for _ in range(8)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.1 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.25 and texts:
            t = r.choice(texts) or ""
            at = r.randint(0, len(t))
            texts.append(t[:at] + word(r.randint(0, 5)) + t[at + r.randint(0, 5) :])
        elif kind < 0.3:
            texts.append(word(3) * r.randint(1, 200))
        elif kind < 0.33:
            texts.append(None)
        else:
            texts.append("".join(r.choice([word(r.randint(0, 150)), r.choice(shared), r.choice(shared)[r.randint(0, 30) :]]) for _ in range(r.randint(0, 6))))
    return texts


@pytest.mark.parametrize("seed, group", [(1, 1024), (2, 1024), (3, 2), (4, 2), (5, 12)])
def test_matches_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(S, "GROUP", group)
    texts = corpus(seed, 150)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.remove_repeats(docs).collect()}
    want = dict(enumerate(brute(texts, 200)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_edges(spark):
    rows = [(None, None), (1, ""), (2, "a" * 199), (3, "b" * 201), (4, "c" * 200), (4, "c" * 200), (None, "d" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in S.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (100, 0, 0), (199, 0, 0), (200, 200, 1), (200, 200, 1), (201, 201, 1)]
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_driver_gets_no_table_that_grows(spark, monkeypatch):
    """Tables of repeats, their contexts and their texts are shuffled while they are small, too."""
    from pyspark.sql import functions as F

    sent = []
    monkeypatch.setattr(F, "broadcast", lambda df, real=F.broadcast: sent.append(df.count()) or real(df))
    r = random.Random(7)
    word = lambda m: "".join(r.choice("abcdefgh") for _ in range(m))
    texts = []
    for p in (word(400) for _ in range(20)):
        texts += [word(30) + p + word(30), word(30) + p + word(30), word(9) + p[80:330] + word(9), p[:150]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = S.remove_repeats(docs)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == dict(enumerate(brute(texts, 200)))
    assert sum(n for *_, n, _ in got.values()) == 60 and sum(sent) == 0


def test_intervals_give_all_occurrences():
    found = list(S.maximal_repeats([b"xy", b"xz", b"xy"], [b"abc", b"abd", b"abe"], 3))
    assert (1, 2, [0, 2, 1]) in [(a, b, sorted(c, key=[0, 2, 1].index)) for a, b, c in found]
    assert (2, 2, [0, 2]) in [(a, b, sorted(c)) for a, b, c in found]


def test_narrowed_to_characters():
    raw = "é" * 10
    assert S.strip_spans(raw.encode(), [(1, 5)]).decode() == "é" * 9
