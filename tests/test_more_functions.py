"""The functions and readers that no registered query exercises."""

import json

from pyspark.sql import functions as F

from tessera.functions import decide, metrics, text
from tessera.operators import docs, match, rollup
from tessera.sources import readers
from tessera.streaming import feeds


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_routes_gates_and_justifications(spark):
    assert tuple(value(spark, decide.route(F.lit(True)))) == (["context", "code", "analyst"], "analyst")
    gate = value(spark, decide.presence_gate(F.lit("P"), F.lit("dmz-routable"), F.lit(False)))
    assert tuple(gate) == (decide.NOT_AFFECTED, "no", True)
    assert value(spark, decide.presence_gate(F.lit("N"), F.lit("dmz-routable"), F.lit(True)))["terminal"] is None

    def why(status, reach, pair, separable):
        return tuple(value(spark, decide.justification_for(F.lit(status), F.lit(reach), F.lit(pair), F.lit(separable))))

    assert why(decide.NOT_AFFECTED, "no", True, True)[0] == decide.CONTROLLED
    assert why(decide.NOT_AFFECTED, "yes", True, True) == ("vulnerable_code_not_present", "csaf-openvex")
    assert why(decide.AFFECTED, "yes", False, None)[0] == decide.CONTROLLABLE
    assert why(decide.AFFECTED, "conditional", False, None) == ("vulnerable_code_present", "extension")
    assert why(decide.UNDER_INVESTIGATION, "yes", True, True) == (None, None)
    tier = decide.evidence_tier
    assert value(spark, tier(F.lit(decide.AFFECTED), F.lit(True), F.lit(True), F.lit(None).cast("boolean"))) == "static-analysis-verified"
    assert value(spark, tier(F.lit(decide.AFFECTED), F.lit(True), F.lit(True), F.lit(False))) == "static-reasoned"


def test_small_decisions(spark):
    metric = "array<struct<type:string,score:double>>"
    m31 = F.from_json(F.lit('[{"type":"Secondary","score":1},{"type":"Primary","score":2}]'), metric)
    none = F.lit(None).cast(metric)
    assert value(spark, decide.pick_metric(m31, none, none))["score"] == 2 and value(spark, decide.pick_metric(none, none, m31))["score"] == 2
    assert value(spark, decide.base_platform(F.array(F.lit("vxworks"), F.lit("linux")), {"linux": "Linux", "vxworks": "VxWorks"})) == "Linux"
    assert value(spark, decide.two_signals(F.lit(decide.AFFECTED), F.lit("patched"))) == decide.NOT_AFFECTED
    assert value(spark, decide.candidate_why(F.lit(True), F.lit("yes"), F.lit("high"), F.lit(False))) == "KEV (exploited in the wild); reachability=yes; high severity"
    assert value(spark, decide.language(F.lit("spring"))) == "Java" and value(spark, decide.language(F.lit("zlib"))) == "C/C++"
    assert value(spark, decide.collection_outcome(F.lit(False), F.lit(True), F.lit(False))) == "fetch-failed"
    assert value(spark, decide.collectable(F.lit(None).cast("boolean"), F.lit(True))) is True
    assert value(spark, decide.device_scope(F.array(F.lit("OpenSSL lib")), F.array().cast("array<string>"), ["openssl"])) == "shared-oss-component"
    assert [value(spark, decide.canonical_justification(F.lit(j))) for j in ("component_not_present", "protected_at_perimeter", "x")] == ["component_not_present", "inline_mitigations_already_exist", "vulnerable_code_not_in_execute_path"]
    assert [value(spark, decide.csaf_remediation(F.lit(r))) for r in ("patch_or_firmware_upgrade", "feature_disablement", None)] == ["vendor_fix", "workaround", "mitigation"]
    assert value(spark, decide.severity_grade(F.lit(0.0))) == "None" and value(spark, decide.severity_rank(F.lit("HIGH"))) == 3


def test_more_text(spark):
    assert value(spark, text.vendor_label(F.lit("x Vendor: Acme Corp Equipment: S7 Vulnerability: overflow"), F.lit("Other thing"))) == "Acme Corp"
    assert value(spark, text.vendor_label(F.lit("nothing"), F.lit("Other thing"))) == "Other"
    assert value(spark, text.url_has(F.lit("https://X/Commit/1"), ["/commit/"])) is True
    assert value(spark, text.product_tokens(F.lit("The S7-1500 Series pump"), ["series"])) == ["1500"]
    assert value(spark, text.evidence_block([F.lit("a"), F.lit(None).cast("string"), F.lit("b")])) == "a\nb"
    assert value(spark, text.html_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert value(spark, text.unescape_basic(F.lit("&lt;a&amp;lt;"))) == "<a&lt;"
    assert value(spark, text.vendor_key(F.lit("  GE-Vernova"))) == "ge" and value(spark, text.advisory_year(F.lit("icsa-14-269-01"))) == 2014
    for key in "abcdef":
        changed = value(spark, text.perturb(F.lit("int buf;"), F.lit(key)))
        assert changed != "int buf;" and changed.replace("buffer", "buf").replace("// checked\n", "").strip() == "int buf;"
    assert value(spark, text.from_patch(F.lit(" same"))) is None


def test_more_metrics(spark):
    df = spark.createDataFrame([(0.9, 0.5), (0.7, 0.7)], "b double, c double")
    assert abs(metrics.mean_drop(df, "b", "c").first()[0] - 0.2) < 1e-12
    assert value(spark, metrics.perplexity(F.lit(0.0))) == 1.0
    assert value(spark, metrics.masked_mean(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(1), F.lit(0)))) == 1.0
    same = spark.createDataFrame([([], [])], "g array<string>, w array<string>")
    assert tuple(metrics.set_scores(same, "g", "w").first()) == (0.0, 0.0, 0.0, 1.0)


def test_more_readers(spark, tmp_path):
    (tmp_path / "adv").mkdir()
    (tmp_path / "adv" / "a.json").write_text(json.dumps({"id": "a-24-01", "year": None, "vulns": []}))
    assert readers.advisory_files(spark, str(tmp_path / "adv")).first()["file"] == "a.json"
    kb = {"components": [{"key": "zlib", "name": "Zlib", "cpe_product": "zlib", "versions": {"1.0": [{"id": "CVE-1", "kev": True}], "1.1": []}}, {"key": "z2", "name": "ZLIB", "cpe_product": None, "versions": {"2": [{"id": "CVE-1"}]}}]}
    (tmp_path / "kb.json").write_text(json.dumps(kb))
    known = readers.knowledge(spark, str(tmp_path / "kb.json"))
    assert known.count() == 3 and readers.cve_index(known).first()["key"] == "z2"
    dims = known.select("pos", "key", "name", "cpe_product").distinct()
    found = match.by_name(spark.createDataFrame([(" zlib ",)], "name string"), dims).collect()
    assert [r["key"] for r in found] == ["z2"]
    (tmp_path / "code.json").write_text(json.dumps({"CVE-1": {"vuln_code": "a", "patched_code": "b"}, "CVE-2": {"vuln_code": "a", "patched_code": ""}, "CVE-3": {"commits_found": 2}}))
    assert [r["cve"] for r in readers.code_pairs(spark, str(tmp_path / "code.json")).collect()] == ["CVE-1"]
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02"}]}))
    assert tuple(readers.exploited(spark, str(tmp_path / "kev.json")).first()) == ("CVE-1", "2024-01-02")
    listed = spark.createDataFrame([("see https://x/a/ADV-24-01 and https://y/a/adv-24-01",)], "value string")
    assert tuple(readers.listed_urls(listed, r"https://[a-z]/a/((?i)adv-\d\d-\d\d)").first()) == ("adv-24-01", "https://y/a/adv-24-01")
    refs = spark.createDataFrame([("CVE-1", [("WEB", "x"), ("FIX", "https://github.com/o/r/commit/abcdef1234")])], "cve string, references array<struct<type:string,url:string>>")
    assert readers.fix_commits(refs).first()["sha"] == "abcdef1234"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.log").write_text("BUILD OK\ntook 3 s\ntook 12 s\n")
    assert tuple(readers.build_logs(spark, str(tmp_path / "log")).first()) == ("one.log", 1, 0, 12)
    report = spark.createDataFrame([([("CVE-1", "collected"), ("CVE-2", "no-tag")],)], "records array<struct<cve:string,status:string>>")
    assert [r["cve"] for r in readers.collected(report).collect()] == ["CVE-1"]
    assert readers.first_path(spark, str(tmp_path / "nope"), str(tmp_path / "log")) == str(tmp_path / "log")
    assert readers.repositories(spark, [("zlib", "o/r", ["v{v}"], False)]).count() == 1


def test_marts_and_sets(spark):
    f = spark.createDataFrame([("CVE-1", "UNDER_INVESTIGATION", "HIGH", 7.0, "CWE-1", False, "a", "t", "c1", 1), ("CVE-1", "LIKELY_AFFECTED", None, 8.0, "", True, "b", "t", "c2", 2)], "cve string, status string, severity string, cvss double, cwe string, kev boolean, vendor string, device_type string, component string, pos int")
    r = docs.cve_mart(f).first()
    assert (r["vex"], r["component"], r["severity"], r["cvss"], r["cwe"], r["kev"], r["vendors"]) == ("LIKELY_AFFECTED", "c2", "HIGH", 8.0, "CWE-1", True, "a;b")
    assert docs.summary(f).first()["cves"] == 1
    assert value(spark, match.shares_token(F.array(F.lit("s7"), F.lit("pump")), F.array(F.lit("pump")))) is False
    assert rollup.page(spark.range(5), [F.col("id")], 0, 2).collect()[0]["id"] == 0


def test_sessions_plan(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id int, ts string").select("user_id", F.to_timestamp("ts").alias("ts"))
    assert sorted(r["n"] for r in feeds.sessions(events).collect()) == [1, 2]


def test_evidence_sentences(spark):
    import hashlib

    from tessera.functions import sentences as S

    none, yes, no = F.lit(None).cast("string"), F.lit(True), F.lit(False)
    said = value(spark, S.evidence_sentences(F.lit("d"), F.lit("V"), F.lit("P"), F.lit("CVE-1"), F.lit("CWE-79"), F.lit("N"), F.lit("high"), F.lit(0.5), yes, F.lit("dmz-routable"), yes, yes, yes, F.lit(decide.AFFECTED)))
    assert [s["kind"] for s in said] == ["cve_desc", "av", "kev", "epss", "product", "exposure", "present", "version_unknown", "exec_affected"]
    assert said[0]["text"] == "CVE-1 is a high-severity cross-site scripting issue (CWE-79)." and said[3]["text"].endswith("0.50.")
    pick = lambda pool, *seed: pool[int(hashlib.sha256("::".join(seed).encode()).hexdigest(), 16) % len(pool)]
    assert said[1]["text"] == pick(S.VECTOR["N"], "av", "d", "CVE-1") and said[5]["text"] == pick(S.EXPOSURE["dmz-routable"], "exp", "d")
    bare = value(spark, S.evidence_sentences(F.lit("d"), F.lit("V"), F.lit("P"), F.lit("CVE-1"), none, none, none, F.lit(None).cast("double"), no, F.lit("isolated-cell"), no, no, no, none))
    assert [s["kind"] for s in bare] == ["cve_desc", "av_unstated", "kev_neg", "product", "exposure", "present", "version_unknown", "src_unavailable"]
    assert bare[0]["text"] == "CVE-1 is a unrated an unspecified weakness issue (CWE-unknown)."


def test_best_match_is_the_plain_argmax(spark):
    import difflib
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde -") for _ in range(r.randint(0, 12)))
    names, known = sorted({word() for _ in range(60)}), sorted({word() for _ in range(25)})
    got = {x["query"]: x for x in match.fuzzy(spark.createDataFrame([(n,) for n in [*names, None]], "n string"), "n", spark.createDataFrame([(k,) for k in known], "k string"), "k").collect()}
    for n in names:
        want = max(((difflib.SequenceMatcher(None, n, k).ratio(), k) for k in known), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        assert abs(got[n]["score"] - want[0]) < 1e-12 and got[n]["matched"] == (want[0] >= 0.7)
        assert got[n]["best_match"] == min(k for k in known if difflib.SequenceMatcher(None, n, k).ratio() == want[0])
    assert match.fuzzy(spark.createDataFrame([("x",)], "n string"), "n", spark.createDataFrame([], "k string"), "k").count() == 0
