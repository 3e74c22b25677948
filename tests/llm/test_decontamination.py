import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontamination as D

RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, span=10):
    out = []
    for _, text in docs:
        w = RULE.findall(low(text))
        hit, found = set(), set()
        for item, t in items:
            b = RULE.findall(low(t))
            n = min(span, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((len(w), len(hit), len(found), sorted(map(str, found)), bool(hit)))
    return out


def sample(seed):
    r = random.Random(seed)
    vocabulary = ["Ab", "b1", "çé", "d", "Éx", "日本", "g"][: r.randint(2, 7)]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 40]))) for i in range(8)] + [(20, None)]
    docs = [(i, " ".join([text(r.randint(0, 40)), r.choice(items)[1] or "", text(r.randint(0, 9))])) for i in range(25)] + [(98, None), (99, ""), (99, "")]
    return docs, items


@pytest.mark.parametrize("seed, block", [(1, 1 << 24), (2, 1 << 24), (3, 1 << 24), (4, 200)])
def test_matches_brute_force(spark, seed, block):
    docs, items = sample(seed)
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, n_hit string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_contamination(d, b, block_chars=block).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], list(r["item_ids"]), r["contaminated"]) for r in rows)
    assert got == sorted((i, *x) for (i, _), x in zip(docs, brute(docs, items), strict=True))
    assert D.find_contamination(d.limit(0), b).count() == 0
    assert not D.find_contamination(d, b.limit(0)).filter("contaminated").count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=10), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_every_shared_span_has_a_shared_fingerprint(span, a, b):
    import numpy as np

    from tessera.llm.common import grams, mix

    chosen = []
    for around in (a, b):
        g = grams(mix(np.array([*around, *span, *around], np.uint64)), 5)
        at = [p for p in D.winnow(g, 6) if len(around) <= p <= len(around) + 5]
        chosen.append({p - len(around) for p in at})
    assert chosen[0] & chosen[1]


def test_spans_are_bytes_of_the_text(spark):
    words = "one two three four five six seven eight nine ten".split()
    d = spark.createDataFrame([(1, "é é, " + ", ".join(words) + "! end")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    r = D.find_contamination(d, b, spans=True).first()
    raw = "é é, ".encode() + ", ".join(words).encode()
    assert [tuple(s) for s in r["hit_spans"]] == [(7, len(raw))]
