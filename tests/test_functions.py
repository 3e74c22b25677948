import difflib
import hashlib
import itertools
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import decide, hashing, metrics, text, udf
from tessera.operators import match, rollup


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("modulus", [2, 3, 4, 7, 100, 1000])
def test_hash_mod_is_the_whole_digest(spark, modulus):
    keys = [f"k{i}" for i in range(60)] + ["", "é", "a::b"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.hash_mod(["exp", F.col("k")], modulus).alias("m")).collect()
    assert all(r["m"] == int(hashlib.sha256(f"exp::{r['k']}".encode()).hexdigest(), 16) % modulus for r in got)


def test_uuid5(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    got = spark.createDataFrame([("a",), ("device/ü",)], "k string").select("k", hashing.uuid5(ns, F.col("k")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.UUID(ns), r["k"])) for r in got)


def test_reachability_over_all_inputs(spark):
    rows = list(itertools.product(["", None, "N", "A", "L", "P", "X"], decide.EXPOSURES))
    got = {(r["av"], r["e"]): r["r"] for r in spark.createDataFrame(rows, "av string, e string").select("av", "e", decide.reachability(F.col("av"), F.col("e")).alias("r")).collect()}
    assert [got["N", e] for e in decide.EXPOSURES] == ["no", "conditional", "yes", "yes"]
    assert [got["A", e] for e in decide.EXPOSURES] == ["no", "conditional", "conditional", "yes"]
    assert {got["L", e] for e in decide.EXPOSURES} == {"conditional"} and {got["P", e] for e in decide.EXPOSURES} == {"no"}
    assert {got[a, e] for a in ("", None) for e in decide.EXPOSURES} == {"unknown"} and got["X", "isolated-cell"] == "conditional"


@pytest.mark.parametrize(
    "source, av, exposure, tier, kev, confidence",
    [("per-cve", "N", "dmz-routable", "A", False, 0.84), ("per-cve", "N", "dmz-routable", "E", True, 0.78), ("other", "L", "dmz-routable", "E", True, 0.32), ("other", "P", "dmz-routable", "C", False, 0.55), ("per-cve", "", "dmz-routable", "A", True, 0.2), ("per-cve", "A", "control-network", "C", False, 0.6)],
)
def test_estimate(spark, source, av, exposure, tier, kev, confidence):
    assert one(spark, decide.estimate(F.lit(av), F.lit(exposure), F.lit(source), F.lit(tier), F.lit(kev)).alias("e"))["e"]["confidence"] == confidence


def test_ssvc_table_is_whole(spark):
    assert len(decide.SSVC_ROWS) == len({r[:4] for r in decide.SSVC_ROWS}) == 72
    by = {d: sum(r[4] == d for r in decide.SSVC_ROWS) for d in ("defer", "scheduled", "out-of-cycle", "immediate")}
    assert by == {"defer": 7, "scheduled": 42, "out-of-cycle": 20, "immediate": 3}
    row = spark.createDataFrame([("active", "open", "yes", "unheard of")], "exploitation string, exposure string, automatable string, human_impact string")
    assert decide.ssvc_decide(row).first()["decision"] == "defer"


def test_tree(spark):
    yes = {q: F.lit(True) for q in decide.QUESTIONS} | {"source_check": F.lit(False)}
    got = one(spark, decide.walk_tree(F.lit("N"), yes).alias("w"))["w"]
    assert (got["status"], got["justification"], got["pending"]) == ("under_investigation", "likely_affected_high", None)
    assert one(spark, decide.walk_tree(F.lit("N"), {"affected_range": F.lit(True)}).alias("w"))["w"]["pending"] == "source_check"


def test_macro_f1_of_a_known_matrix(spark):
    cells = [[520, 0, 65], [4, 588, 61], [27, 52, 800]]
    rows = [(t, g) for t, line in enumerate(cells) for g, n in enumerate(line) for _ in range(n)]
    assert round(metrics.macro_f1(spark.createDataFrame(rows, "t int, g int"), "t", "g").first()[0], 5) == 0.90381


def test_similarity_is_difflibs(spark):
    r = random.Random(3)
    rows = [("".join(r.choice("abc d") for _ in range(r.randint(0, 30))), "".join(r.choice("abc d") for _ in range(r.randint(0, 250)))) for _ in range(40)] + [(None, "x")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", udf.similarity("a", "b").alias("s")).collect()
    assert all(x["s"] == (None if x["a"] is None else difflib.SequenceMatcher(None, x["a"], x["b"]).ratio()) for x in got)


def test_vulnerabilities_in_context(spark):
    t = (
        "CWE-1 then CWE-79 precede. CVE-2024-1111 has been assigned to this vulnerability. A CVSS v3 base score of 7.5 has been calculated; the vector string is (CVSS:3.1/AV:N/AC:L). A CVSS v4 score with a base score of 8 has the vector string (AV:N/AC:L)."
        + "x" * 900
        + " CVE-2024-2222 is named alone. CVE-2024-3333  has been\nassigned. CWE-20 CVE-2024-1111 has been assigned again."
    )
    got = spark.createDataFrame([(t,), (None,)], "t string").select(udf.parse_vulnerabilities("t").alias("v")).collect()
    assert [tuple(v) for v in got[0]["v"]] == [("CVE-2024-1111", "CWE-20", None, "", None, ""), ("CVE-2024-3333", "", None, "", None, "")]
    first = spark.createDataFrame([(t[:400],)], "t string").select(udf.parse_vulnerabilities("t").alias("v")).first()["v"]
    assert [tuple(v) for v in first] == [("CVE-2024-1111", "CWE-79", 7.5, "CVSS:3.1/AV:N/AC:L", 8.0, "AV:N/AC:L")]
    assert got[1]["v"] == []


def test_jsonc():
    assert json.loads(udf.clean_jsonc('{"a": "x // y", /* c */ "b": [1, 2,], // end\n}')) == {"a": "x // y", "b": [1, 2]}
    assert udf.clean_jsonc("{nope") is None and udf.clean_jsonc(None) is None


def test_text_functions(spark):
    r = one(
        spark, text.parse_vector(F.lit("AV:N/junk/AC:L/AC:H:x")).alias("v"), text.device_identity(F.lit("Acme  Pump - 7"), F.lit("acme")).alias("d"), text.slug(F.lit("--")).alias("s"), text.parse_purl(F.lit("pkg:npm/@a/b@1.0")).alias("p"),
        text.norm_vendor(F.lit("Siemens Energy, ")).alias("n"), text.year_of(F.lit("CVE-x-1")).alias("y"), text.commit_of(F.lit("https://github.com/a/b/commit/0123456789abcdef")).alias("c"), text.score_label(F.lit(7.5)).alias("l"),
        text.coerce_status(F.lit("it is LIKELY_NOT_AFFECTED")).alias("st"), text.sentences(F.lit("One. Two!  Three")).alias("se"), text.dashboard_vendor(F.lit("​Rockwell,")).alias("dv"), text.parse_cpe(F.lit("x")).alias("none"),
    )
    assert r["v"] == {"AV": "N", "AC": "H:x"} and r["d"]["product"] == "Pump - 7" and r["s"] == "x" and tuple(r["p"]) == ("pkg:npm/@a/b", "1.0")
    assert r["n"] == "Siemens" and r["y"] is None and tuple(r["c"]) == ("a/b", "0123456789abcdef") and r["l"] == "7.5 (High)"
    assert r["st"] == "LIKELY_NOT_AFFECTED" and r["se"] == ["One.", "Two!", "Three"] and r["dv"] == "Rockwell Automation" and r["none"] is None


def test_version_with_no_items_is_pinned(spark):
    catalog = spark.createDataFrame([("c", "1", "x", 1), ("c", "2", None, 2)], "comp string, ver string, item string, pos int")
    got = match.version_or_all(spark.createDataFrame([("c", "2"), ("c", "9")], "comp string, ver string"), catalog, "comp", "ver", "item", "pos").collect()
    assert [(r["ver"], r["item"], r["pinned"]) for r in got] == [("9", "x", False)]


def test_drill_down_and_search(spark):
    df = spark.createDataFrame([("a", ["x", "Yz"], 2020)], "k string, l array<string>, y int")
    dims = {"l": F.col("l"), "y": F.col("y")}
    assert rollup.drill_down(df, dims, "l", "x").count() == rollup.drill_down(df, dims, "y", "2020").count() == 1
    assert rollup.drill_down(df, dims, "nope", "x").count() == 0
    assert rollup.search(df, "yZ", ["k"], ["l"]).count() == rollup.search(df, "", ["k"]).count() == 1 and rollup.search(df, "q", ["k"], ["l"]).count() == 0
