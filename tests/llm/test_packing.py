import random
import zlib

import numpy as np
import pytest

from tessera.llm import packing as P
from tessera.llm.token_counts import load_tokenizer


@pytest.mark.parametrize("seed", range(6))
def test_solver_places_all_within_capacity(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 100): r.randint(1, 400) for _ in range(r.randint(1, 60))}
    bins = P.solve(counts, 100)
    placed = {}
    for content, n in bins.items():
        assert sum(content) <= 100 and n > 0
        for x in content:
            placed[x] = placed.get(x, 0) + n
    assert placed == counts
    assert sum(bins.values()) <= sum(P.best_fit(counts, 100).values())


def test_search_empties_a_bin_by_exchange():
    start = {(60, 25): 1, (50, 35): 1, (15, 15): 1}  # best fit cannot, exchanges can: 60+25+15, 50+35+15
    assert sum(P.local_search(start, 100).values()) == 2
    assert P._exchange((60, 25), (40,), 100) == ((60, 40), (25,))  # one for one
    assert P._exchange((60, 30), (20, 18), 100) == ((60, 20, 18), (30,))  # two for one
    assert P._exchange((60, 40), (10,), 100) is None


def test_contract(spark):
    texts = [None, "", "hello world", "many words here " * 900, "x " * 1023, "dup text", "dup text"] + ["some text " * n for n in range(1, 60)]
    docs = spark.createDataFrame([(None if i == 5 else i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(4)
    rows = P.pack(docs).collect()
    t = load_tokenizer(None)
    want = []
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(None if i == 5 else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert P.pack(docs.limit(0)).collect() == []


def test_ids_are_handed_on(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert P.pack(docs, keep_ids=True).first()["ids"] == [*load_tokenizer(None).encode("hello world", add_special_tokens=False).ids, 2]
