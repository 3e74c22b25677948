import hashlib
import textwrap

import duckdb
import pytest

from tessera.llm import licenses as L
from tessera.llm import registry


def rewrap(text, width):
    """Paragraphs filled anew; a line that only states a copyright stays a line."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def ids(spark, texts):
    docs = spark.createDataFrame([(n, t, "q") for n, t in enumerate(texts)], "doc_id long, text string, license_id string")
    return [r["license_id"] for r in L.find_licenses(docs).orderBy("doc_id").collect()]


def test_finds_whole_texts_only(spark):
    mit = next(t for i, t in L.SHORT if i == "MIT")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Ann Author\n\n" + mit),
        (2, "(C) 2021 Somebody\n" + mit.upper().replace(",", " ;")),
        (3, mit.replace("license", "licence").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")),
        (4, mit + " and more"),
        (5, None), (6, ""), (7, "  ...  "), (8, "released under the mit licence"), (8, "released under the mit licence"), (None, "plain"), (9, "x" * 200_000),
    ]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, license_id string")
    got = [(r["doc_id"], r["license_id"]) for r in L.find_licenses(docs).collect()]
    assert sorted(got, key=lambda x: (x[0] or 0, x[1] or "")) == [(None, None), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, None), (8, "MIT"), (8, "MIT"), (9, None)]
    assert L.find_licenses(docs.limit(0)).count() == 0


def test_every_known_text_at_any_wrap(spark):
    known = L.known_texts()
    plain = [L.plain_canonical(t) for _, t in known]
    want = {c: i for c, (i, _) in reversed(list(zip(plain, known, strict=True)))}
    texts = [f(t) for i, t in known for f in (lambda x: x, lambda x: x.replace("\n", "\r\n"), lambda x: x.replace("\n", "\r"), *(lambda x, w=w: rewrap(x, w) for w in (40, 57, 72, 80, 100)))]
    expected = [want[c] for c in plain for _ in range(8)]
    assert [(n, g, w) for n, (g, w) in enumerate(zip(ids(spark, texts), expected, strict=True)) if g != w] == []
    assert set(expected) >= {"MIT", "ISC", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "CC0-1.0", "BSL-1.0"}


def test_published_wrap_of_isc(spark):
    isc = next(t for i, t in L.SHORT if i == "ISC")
    published = isc.replace("that the above copyright notice", "that the above\ncopyright notice")
    assert ids(spark, [published, "ISC License\n\nCopyright (c) 2004-2010 by Some Body\nCopyright 1995 by Another\nAll rights reserved.\n\n" + published]) == ["ISC", "ISC"]


@pytest.mark.parametrize("text", ["licence licence favour favour", "Copyright © 2001 X\nwords", "copyright law\r\nsub licence", "(c)\n(c) 2\nÉtat licence", "non commercial non-commercial per cent", "", "copyright", "copyright (c)", "Copyright 2020 Y\nz"])
def test_columns_equal_plain_python_and_duckdb(spark, text):
    want = hashlib.sha256(L.plain_canonical(text).encode()).hexdigest()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert L.find_licenses(docs).first()["canonical_digest"] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (1, ?)", [text])
    assert con.execute(registry.ORACLES["op5_license_digests"]).fetchone()[1] == want


def test_neighbouring_spellings(spark):
    assert L.plain_canonical("licence licence") == L.plain_canonical("license license") == "license license"


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = L.find_licenses(docs.withColumn("text", docs["text"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("ExistingRDD") <= 1  # the test's own table
