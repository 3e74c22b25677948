import json

from pyspark.sql import functions as F

from tessera.operators import docs
from tessera.sources import readers, sinks


def test_advisories_and_scores(spark, tmp_path):
    advisories = {"adv-24-01": {"advisory_id": "adv-24-01", "year": 2024, "title": "Acme Pump", "cves": ["CVE-2024-1"], "vulns": []}, "adv-24-02": {"error": "404"}}
    (tmp_path / "a.json").write_text(json.dumps(advisories))
    assert [r["advisory_id"] for r in readers.advisories(spark, str(tmp_path / "a.json")).collect()] == ["adv-24-01"]
    assert readers.advisories(spark, str(tmp_path / "a.json"), with_errors=True).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"CVE-2024-1": {"score": 9.8, "severity": "CRITICAL"}, "__cursor__": 2000}))
    got = readers.keyed_json(spark, str(tmp_path / "s.json"), readers.schemas.SCORE, "cve", ("__cursor__",)).collect()
    assert [(r["cve"], r["score"]) for r in got] == [("CVE-2024-1", 9.8)]


def test_findings_csv_with_bom(spark, tmp_path):
    names = [c.split()[0] for c in readers.schemas.FINDING.split(", ")]
    row = dict.fromkeys(names, "") | {"cve": "CVE-2024-1", "cvss_v3_score": "x", "kev": "True", "epss": "0.5"}
    (tmp_path / "f.csv").write_text("﻿" + ",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n", encoding="utf-8")
    r = readers.findings(spark, str(tmp_path / "f.csv")).first()
    assert (r["cve"], r["cvss"], r["is_kev"], r["epss_value"], r["av"], r["device"]) == ("CVE-2024-1", None, True, 0.5, "", "")


def test_inventory_round_trip(spark, tmp_path):
    made = docs.inventory(readers.synthetic_inventories(spark, 3), "device", "2024-01-01T00:00:00Z")
    for r in made.collect():
        (tmp_path / f"{r['device']}_SBOM.json").write_text(r["document"])
    back = readers.inventories(spark, str(tmp_path))
    assert readers.components(back).count() == 15 and readers.dependencies(back).count() == 15
    assert set(back.select("specVersion").distinct().collect()[0]) == {"1.7"}


def test_missing_files_and_bad_lines(spark, tmp_path):
    assert readers.optional(spark, str(tmp_path / "none.json"), "cve string", lambda: None).count() == 0
    (tmp_path / "v.jsonl").write_text('{"cve": "CVE-1", "kev": true}\n{broken\n')
    assert readers.verdicts(spark, str(tmp_path / "v.jsonl")).count() == 1
    (tmp_path / "c.json").write_text('{"a": 1, // note\n "b": [1,],}')
    assert readers.jsonc_documents(spark, str(tmp_path / "c.json"), "a int, b array<int>").first()["b"] == [1]


def test_run_verdict_precedence(spark):
    batch = spark.createDataFrame([("CVE-1", True, False, "s1", "1.1", "EXPLOITABLE", "batch"), ("CVE-2", True, False, "s2", "1.1", "BUILD_FAILED", "batch")], "cve string, vuln_crash boolean, patched_crash boolean, signal string, patched_version string, verdict string, method string")
    packages = spark.createDataFrame([("CVE-1", [("1.0", True, ["seen"]), ("1.2", False, [])], True)], "cve string, versions array<struct<version:string,triggered:boolean,evidence:array<string>>>, discriminates boolean")
    compiled = batch.filter("false")
    got = readers.run_verdicts(batch, packages, compiled).collect()
    assert [tuple(r) for r in got] == [("CVE-1", True, "seen", "1.2", "package")]


def test_paged_feed(spark):
    spark.dataSource.register(readers.paged_feed("echo", lambda ids: ((i, i.upper()) for i in ids)))
    df = spark.read.format("echo").option("ids", "a,b,c").option("chunk", "2").load()
    assert sorted(map(tuple, df.collect())) == [("a", "A"), ("b", "B"), ("c", "C")] and df.rdd.getNumPartitions() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.schema("k string, v int").json(str(tmp_path / "j")).count() == 2
    sinks.split(df, {str(tmp_path / "x"): F.col("k") == "a", str(tmp_path / "y"): F.lit(True)})
    assert spark.read.json(str(tmp_path / "x")).count() == 1 and spark.read.json(str(tmp_path / "y")).count() == 2
    sinks.mart(df, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == [{"k": "a", "v": 1}, {"k": "b"}]
    sinks.csv(df, str(tmp_path / "c"), ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k"]
    assert "precision" in sinks.report("Scores", {"precision": 0.5, "n": 3})


def test_documents_parse(spark, sf_dir):
    from tessera.plans.decisions import QUERIES

    for r in QUERIES["openvex_documents"](spark, sf_dir).collect():
        doc = json.loads(r["document"])
        assert doc["@context"].startswith("https://openvex.dev/") and all(s["status"] in ("affected", "not_affected", "under_investigation", "fixed") for s in doc["statements"])
        assert all("justification" in s for s in doc["statements"] if s["status"] == "not_affected")
    doc = json.loads(QUERIES["csaf_documents"](spark, sf_dir).first()["document"])
    assert doc["document"]["category"] == "csaf_vex" and all(len(v["product_status"]) == 1 for v in doc["vulnerabilities"])


def test_large_documents_come_in_parts(spark, sf_dir):
    from tessera.plans.decisions import statements

    rows = statements(spark, sf_dir).withColumn("product", F.when(F.col("product") != "hmi", F.col("product"))).cache()
    n = rows.filter("product is null").count()
    for make, field, id_of in ((docs.openvex, "statements", lambda d: d["@id"]), (docs.csaf, "vulnerabilities", lambda d: d["document"]["tracking"]["id"])):
        whole = [(r["product"], json.loads(r["document"])) for r in make(rows, "product", "tessera", "2024").collect()]
        parts = [(r["product"], json.loads(r["document"])) for r in make(rows, "product", "tessera", "2024", most=20).collect()]
        said = lambda some: sorted((k or "", json.dumps(s)) for k, d in some for s in d[field])
        assert len({k for k, _ in whole}) == len(whole) and said(parts) == said(whole)
        assert max(len(d[field]) for _, d in parts) <= 50 and len(parts) >= -(-rows.count() // 50)
        ids = [id_of(d) for k, d in parts if k]
        assert len(set(ids)) == len(ids) and {k: id_of(d) for k, d in whole if k}.items() <= {k: min((id_of(d) for j, d in parts if j == k), key=len) for k, _ in parts if k}.items()
        assert n > 20 and sum(len(d[field]) for k, d in parts if k is None) == n


def test_retries_and_missing_pages():
    from tessera.sources.readers import with_retries

    answers, waits = iter([(500, ""), (200, "body")]), []
    assert with_retries(lambda _: next(answers), sleep=waits.append)("x") == "body" and waits == [1.0]
    assert with_retries(lambda _: (404, ""))("x") is None
    try:
        with_retries(lambda _: (503, ""), sleep=waits.append)("x")
        raise AssertionError
    except OSError as e:
        assert "503" in str(e)


def test_paged_stream_goes_on_where_it_was(spark, tmp_path):
    from tessera.sources.readers import paged_stream

    feed = paged_stream("pages_of_numbers", lambda start, size: (7, [(str(i), f"b{i}") for i in range(start, min(start + size, 7))]), page=3)
    spark.dataSource.register(feed)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        query = spark.readStream.format("pages_of_numbers").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [str(i) for i in range(7)]


def test_archives_and_commits(spark, tmp_path):
    import io
    import json
    import tarfile
    import zipfile

    from tessera.sources import readers

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.c", "int a;")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("two.c")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    got = {(r["member"], r["size"], bytes(r["content"])) for r in readers.archive_members(spark, str(tmp_path)).collect()}
    assert got == {("d/one.c", 6, b"int a;"), ("two.c", 3, b"abc")}
    body = json.dumps({"sha": "abc", "files": [{"filename": "x.c", "patch": "@@"}]})
    assert [tuple(r) for r in readers.commit_files(spark.createDataFrame([(body,)], "body string")).collect()] == [("abc", "x.c", "@@")]


def test_reload_and_refine(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import feeds

    paths = [feeds.reload_marts({"m": lambda n=n: spark.range(n)}, str(tmp_path))["m"] for n in (2, 5)]
    assert [spark.read.parquet(p).count() for p in paths] == [2, 5]
    rows = spark.range(5).withColumn("x", F.col("id"))
    done = feeds.refine(rows, lambda d: F.col("x") >= 3, lambda d, n: d.withColumn("x", F.when(F.col("_open"), F.col("x") + 1).otherwise(F.col("x"))))
    assert [(r["x"], r["rounds"]) for r in done.orderBy("id").collect()] == [(2, 2), (3, 2), (3, 1), (3, 0), (4, 0)]
