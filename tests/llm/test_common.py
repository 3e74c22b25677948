import random

import numpy as np
import pytest

from tessera.llm import common as C
from tessera.llm import jaccard_join, media, substring_dedup, warc
from test_media import pgm, scene


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_beyond_what_is_broadcast(spark, monkeypatch, how):
    rows = spark.createDataFrame([(k, n) for k in (1, 1, 1, 2, 3, None) for n in range(5)], "key long, n long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "key long, x string")
    want = sorted(map(repr, C.attach(rows, table, "key", "n", how).select("key", "n", "x").collect()))
    monkeypatch.setattr(C, "SMALL", 0)
    assert sorted(map(repr, C.attach(rows, table, "key", "n", how).select("key", "n", "x").collect())) == want
    assert len(want) == (20 if how == "inner" else 30)


def test_operators_beyond_what_is_broadcast(spark, monkeypatch):
    """All joins take their shuffled form; the results are the same."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [*base, *(b.replace(b.split()[7], "other", 1) for b in base), base[0], base[0], "lead " + base[1], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pages = docs.selectExpr("doc_id page_id", "'u' url", "text html")
    images = spark.createDataFrame([(10 * n + k, pgm(scene(n) + k)) for n in range(3) for k in range(5)], "id long, image binary")
    runs = (
        lambda: jaccard_join.near_duplicates(docs),
        lambda: jaccard_join.drop_near_duplicates(docs),
        lambda: substring_dedup.remove_repeats(docs),
        lambda: media.find_image_copies(images),
        lambda: warc.warc_round_trip(pages),
    )
    want = [sorted(map(repr, f().collect())) for f in runs]
    for module in (C, jaccard_join, substring_dedup, media):
        monkeypatch.setattr(module, "SMALL", 0)
    assert [sorted(map(repr, f().collect())) for f in runs] == want


def test_long_words_of_one_polynomial_differ():
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer(f"{word} {other} {word}".encode(), np.uint8)
        h, _, counts = C.words(data, np.array([0, len(data)]), jaccard_join.WORD_BYTES)
        assert counts.tolist() == [3] and h[0] == h[2] != h[1]


def test_written_tables_are_deleted(spark):
    import os

    made = C.cut(spark.range(3).toDF("x"), "gone")
    assert made.count() == 3 and os.path.exists(made.written_at)
    C.drop(made)
    assert not os.path.exists(made.written_at)
