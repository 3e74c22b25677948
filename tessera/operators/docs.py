"""Documents and marts built from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import decide
from tessera.operators.rollup import joined_set


def openvex_statement() -> Column:
    """The statement of a row (cve, product_id, status, justification, action_statement, component, ssvc columns ...)."""
    c = F.col
    details = F.concat_ws("; ", F.concat(F.lit("progress: "), c("progress")), F.concat(F.lit("missing: "), c("missing")), F.concat(F.lit("planned: "), c("planned")))
    fixed = F.concat_ws("; ", F.concat(F.lit("fixed in "), c("fixed_version")), F.concat(F.lit("patch: "), c("patch_reference")))
    return F.struct(
        F.struct(c("cve").alias("name")).alias("vulnerability"),
        F.array(F.struct(c("product_id").alias("@id"))).alias("products"),
        c("status").alias("status"),
        F.when(c("status") == "not_affected", decide.canonical_justification(c("justification"))).alias("justification"),
        F.when(c("status") == "affected", F.concat(F.coalesce(F.concat(c("remediation"), F.lit(": ")), F.lit("")), F.coalesce(c("action_statement"), F.concat(F.lit("Apply vendor update or mitigation for "), c("component"), F.lit("."))))).alias("action_statement"),
        F.nullif(F.when(c("status") == "not_affected", c("action_statement")).when(c("status") == "fixed", fixed).when(c("status") == "under_investigation", details), F.lit("")).alias("impact_statement"),
        c("estimation").alias("estimation"),
        F.struct(c("decision").alias("decision"), c("ssvc_vector").alias("vector")).alias("ssvc"),
    )


#: Statements of one document, about: a document is one value, which a task holds several times.
STATEMENTS = 25_000


def _parts(rows: DataFrame, key: str, body: Column, most: int) -> tuple[DataFrame, Column]:
    """Rows (key, part_, product_id, x), x being cve and body, so that no part has many more than `most` rows; and a suffix for ids.

    A key of at most `most` rows is part 0; of the others rows are dealt by their hash. Parts are dealt over as many tasks
    as there may be of them, before they are collected: a task that collects holds all of its rows."""
    n, sizes = F.col("n_"), rows.groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("n_"))
    counted = sizes.agg(F.sum("n_").alias("rows"), F.collect_list(F.when(n > most, F.struct("key_", "n_"))).alias("large")).first()
    made = rows.select(key, "product_id", F.struct("cve", body.alias("v")).alias("x"))
    if (counted["rows"] or 0) <= most:
        return made.withColumn("part_", F.lit(0).cast("bigint")), F.lit("")
    schema = StructType([StructField("key_", rows.schema[key].dataType), StructField("n_", LongType())])
    large = rows.sparkSession.createDataFrame([tuple(r) for r in counted["large"]], schema)
    part = F.coalesce(F.pmod(F.xxhash64("x"), F.ceil(n / most)), F.lit(0).cast("bigint"))
    dealt = made.join(F.broadcast(large), F.col(key).eqNullSafe(F.col("key_")), "left").withColumn("part_", part).drop("key_", "n_")
    suffix = F.when(F.col("part_") > 0, F.concat(F.lit(":"), (F.col("part_") + 1).cast("string"))).otherwise("")
    return dealt.repartition(2 * -(-counted["rows"] // most), key, "part_"), suffix


def openvex(rows: DataFrame, key: str, author: str, timestamp: str, most: int = STATEMENTS) -> DataFrame:
    """One OpenVEX document in JSON for each key; several, each whole and with its own @id, for a key of over `most` rows."""
    dealt, suffix = _parts(rows, key, openvex_statement(), most)
    by = dealt.groupBy(key, "part_").agg(F.array_sort(F.collect_list("x")).alias("list"))
    doc = F.struct(F.lit("https://openvex.dev/ns/v0.2.0").alias("@context"), F.concat(F.lit("urn:vex:"), F.col(key).cast("string"), suffix).alias("@id"), F.lit(author).alias("author"), F.lit(timestamp).alias("timestamp"), F.lit(1).alias("version"), F.transform("list", lambda x: x["v"]).alias("statements"))
    return by.select(key, F.to_json(doc).alias("document"))


def csaf(rows: DataFrame, key: str, publisher: str, timestamp: str, most: int = STATEMENTS) -> DataFrame:
    """One CSAF VEX document in JSON for each key; several, each whole and with its own id, for a key of over `most` rows."""
    c, status = F.col, F.col("status")
    ids = F.array("product_id")
    vulnerability = F.struct(
        c("cve").alias("cve"),
        F.struct(F.when(status == "affected", ids).alias("known_affected"), F.when(status == "not_affected", ids).alias("known_not_affected"), F.when(status == "fixed", ids).alias("fixed"), F.when(status == "under_investigation", ids).alias("under_investigation")).alias("product_status"),
        F.when(status == "not_affected", F.array(F.struct(decide.canonical_justification(c("justification")).alias("label"), ids.alias("product_ids")))).alias("flags"),
        F.when(status == "affected", F.array(F.struct(decide.csaf_remediation(c("remediation")).alias("category"), F.coalesce(c("action_statement"), F.concat(F.lit("Apply update for "), c("component"))).alias("details"), ids.alias("product_ids")))).when(c("fixed_version").isNotNull(), F.array(F.struct(F.lit("vendor_fix").alias("category"), F.concat(F.lit("Fixed in "), c("fixed_version")).alias("details"), ids.alias("product_ids")))).alias("remediations"),
        F.array(F.struct(F.lit("impact").alias("category"), F.concat(F.lit("SSVC "), c("decision"), F.lit(" | "), c("ssvc_vector")).alias("details"), ids.alias("product_ids"))).alias("threats"),
    )
    dealt, suffix = _parts(rows, key, vulnerability, most)
    by = dealt.groupBy(key, "part_").agg(F.array_sort(F.collect_list("x")).alias("list"), F.array_sort(F.collect_set("product_id")).alias("products"))
    tracking = F.struct(F.concat(F.lit("TESSERA-"), F.col(key).cast("string"), suffix).alias("id"), F.lit("final").alias("status"), F.lit("1").alias("version"), F.lit(timestamp).alias("initial_release_date"), F.lit(timestamp).alias("current_release_date"))
    doc = F.struct(F.struct(F.lit("csaf_vex").alias("category"), F.lit("2.0").alias("csaf_version"), F.struct(F.lit("vendor").alias("category"), F.lit(publisher).alias("name")).alias("publisher"), tracking.alias("tracking")).alias("document"), F.struct(F.transform("products", lambda p: F.struct(p.alias("product_id"), p.alias("name"))).alias("full_product_names")).alias("product_tree"), F.transform("list", lambda x: x["v"]).alias("vulnerabilities"))
    return by.select(key, F.to_json(doc).alias("document"))


def inventory(components: DataFrame, device: str, timestamp: str) -> DataFrame:
    """One CycloneDX document for each device. components: (device, ref, name, version, cpe, purl, cves)."""
    from tessera.functions.hashing import uuid5

    part = F.struct("ref", F.struct(F.lit("library").alias("type"), F.col("ref").alias("bom-ref"), "name", "version", "cpe", "purl").alias("c"), F.col("cves").alias("cves"))
    by = components.groupBy(device).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    vulnerabilities = F.flatten(F.transform("parts", lambda p: F.transform(F.coalesce(p["cves"], F.array().cast("array<string>")), lambda v: F.struct(v.alias("id"), F.array(F.struct(p["ref"].alias("ref"))).alias("affects")))))
    serial = F.concat(F.lit("urn:uuid:"), uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col(device).cast("string")))
    doc = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.7").alias("specVersion"), serial.alias("serialNumber"), F.lit(1).alias("version"), F.struct(F.lit(timestamp).alias("timestamp"), F.struct(F.lit("device").alias("type"), F.col(device).cast("string").alias("bom-ref"), F.col(device).cast("string").alias("name")).alias("component")).alias("metadata"), F.transform("parts", lambda p: p["c"]).alias("components"), vulnerabilities.alias("vulnerabilities"), F.array(F.struct(F.col(device).cast("string").alias("ref"), F.transform("parts", lambda p: p["ref"]).alias("dependsOn"))).alias("dependencies"))
    return by.select(device, F.to_json(doc).alias("document"))


def cve_mart(findings: DataFrame) -> DataFrame:
    """A row for each CVE of findings (cve, status, severity, cvss, cwe, kev, vendor, device_type, component, pos)."""
    modal = findings.filter(F.coalesce("cwe", F.lit("")) != "").groupBy("cve", "cwe").agg(F.count("*").alias("n"), F.min("pos").alias("p")).groupBy("cve").agg(F.max_by("cwe", F.struct("n", -F.col("p"))).alias("cwe"))
    worst = F.max_by(F.struct("status", "component"), F.struct(decide.status_rank(F.col("status")), -F.col("pos")))
    rank = decide.severity_rank(F.col("severity"))
    out = findings.groupBy("cve").agg(worst.alias("w"), F.when(F.max(rank) > 0, F.max_by("severity", rank)).otherwise("unrated").alias("severity"), F.max("cvss").alias("cvss"), F.bool_or("kev").alias("kev"), joined_set("vendor").alias("vendors"), joined_set("device_type").alias("device_types"), F.count("*").alias("n_findings"))
    return out.join(modal, "cve", "left").select("cve", F.col("w.status").alias("vex"), F.col("w.component").alias("component"), "severity", "cvss", F.coalesce("cwe", F.lit("")).alias("cwe"), "kev", "vendors", "device_types", "n_findings")


def summary(findings: DataFrame) -> DataFrame:
    """Counts of findings and CVEs by status in one row."""
    return findings.agg(F.count("*").alias("findings"), F.count_distinct("cve").alias("cves"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in decide.STATUS_RANK))


def source_mart(findings: DataFrame, tier: str = "A") -> DataFrame:
    """One row about the CVEs of a tier: totals, and counts by status, severity, reachability, weakness, vendor and type.

    findings: (cve, tier, status, severity, reach, cwe, kev, has_code, vendor, device_type, pos). A CVE counts by its
    worst row, the earliest of equals; vendors and types count their CVEs. The lists are sorted, most frequent first."""
    rows = findings.filter(F.col("tier") == tier)
    keep = F.struct("status", "severity", "reach", "kev", "has_code")
    worst = rows.groupBy("cve").agg(F.max_by(keep, F.struct(decide.status_rank(F.col("status")), -F.col("pos"))).alias("w"), F.min_by("cwe", F.when(F.coalesce("cwe", F.lit("")) != "", F.col("pos"))).alias("cwe")).select("cve", "cwe", "w.*")
    severity = F.when(F.col("severity").isin("critical", "high", "medium", "low"), F.col("severity")).otherwise("unrated")
    totals = worst.agg(F.count("*").alias("total_cves"), F.count_if("has_code").alias("code_collected"), F.count_if(~F.col("has_code")).alias("pending_collection"), F.count_if("kev").alias("kev"), F.count_if(F.col("cwe").isNull()).alias("cwe_none"))

    def counted(df: DataFrame, value: Column, name: str, n: Column = F.count("*")) -> DataFrame:
        by = df.groupBy(value.alias("value")).agg(n.alias("n"))
        return by.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value"))), lambda x: F.struct(x["value"].alias("value"), (-x["less"]).alias("n"))).alias(name))

    sides = [counted(worst, F.col("status"), "by_vex"), counted(worst, severity, "by_severity"), counted(worst, F.col("reach"), "by_reachability"), counted(worst.filter("cwe is not null"), F.col("cwe"), "top_cwe"), counted(rows, F.col("vendor"), "top_vendors", F.count_distinct("cve")), counted(rows, F.col("device_type"), "device_types", F.count_distinct("cve"))]
    out = totals
    for s in sides:
        out = out.join(F.broadcast(s), F.lit(True))
    return out.withColumn("top_vendors", F.slice("top_vendors", 1, 8))


def identified(hits: DataFrame, key: str, timestamp: str) -> DataFrame:
    """For each inventory a document of the CVEs identified in it, with counters by severity and their provenance.

    hits: (key, cve, ref, name, version, method, pos, description, score, severity, vector, cwes array<int>); the columns
    from description on come from metadata and are null without it."""
    c = F.col
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ref", "name", "version", "method")))
    meta = [F.first(x).alias(x) for x in ("description", "score", "severity", "vector", "cwes")]
    by = hits.groupBy(key, "cve").agg(ordered.alias("hits"), *meta)
    url = F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), c("cve"))
    source = F.struct(F.lit("NVD").alias("name"), url.alias("url"))
    prop = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    vulnerability = F.struct(
        F.concat(F.lit("vuln:"), c("cve")).alias("bom-ref"), c("cve").alias("id"), source.alias("source"), c("description"),
        F.when(c("score").isNotNull(), F.array(F.struct(source.alias("source"), c("score"), c("severity"), F.coalesce("vector", F.lit("NOASSERTION")).alias("vector")))).alias("ratings"), F.when(F.size("cwes") > 0, c("cwes")).alias("cwes"),
        F.struct(F.lit("in_triage").alias("state")).alias("analysis"),
        F.transform("hits", lambda h: F.struct(h["ref"].alias("ref"), F.array(F.struct(h["version"].alias("version"), F.lit("affected").alias("status"))).alias("versions"))).alias("affects"),
        F.array(prop("match:method", F.get("hits", 0)["method"]), prop("match:confidence", F.lit("high")), prop("match:metadata-source", F.when(c("description").isNotNull(), "nvd-api-2.0").otherwise("unavailable")), prop("match:affected-components", F.array_join(F.transform("hits", lambda h: F.concat(h["name"], F.lit("@"), h["version"])), ","))).alias("properties"),
    )
    totals = [F.count_if(F.lower("severity") == x).cast("string").alias(x) for x in ("critical", "high", "medium", "low")]
    made = by.select(key, "cve", "severity", vulnerability.alias("v")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("cve", "v"))), lambda x: x["v"]).alias("list"), F.count("*").cast("string").alias("total"), *totals)
    counters = F.array(prop("SBOM_CVE_TOTAL", c("total")), *(prop(f"SBOM_CVE_{x.upper()}", c(x)) for x in ("critical", "high", "medium", "low")))
    doc = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.struct(F.lit(timestamp).alias("timestamp"), F.array(F.struct(F.lit("operations").alias("phase"))).alias("lifecycles")).alias("metadata"), counters.alias("properties"), c("list").alias("vulnerabilities"))
    return made.select(key, F.to_json(doc).alias("document"))


def sample_record(n: Column, sentences: Column, verdict: Column, estimate: Column, route: Column, noisy: Column, tier: Column, has_code: Column) -> Column:
    """A finding's record: the evidence-based statement, the route, the estimate where that leaves it open, and labels.

    verdict, estimate and route are what decide.adjudicate, estimate and route give; noisy: the annotator's label."""
    from tessera.functions.sentences import rationale

    settled = verdict["evidence_tier"] == "execution-verified"
    guess = lambda field: F.when(~settled, estimate[field])
    clean = F.when(settled, verdict["status"]).otherwise(estimate["status"])
    return F.struct(
        F.format_string("S%06d", n).alias("sampleId"), tier.alias("tier"), verdict["status"].alias("vex_status"), verdict["justification"].alias("justification"), verdict["vocabulary"].alias("justification_vocabulary"), verdict["evidence_tier"].alias("evidence_tier"),
        has_code.alias("code_evidence_available"), tier.isin("A", "C").alias("oss_attributed"), route["stages"].alias("route_stages"), route["terminal_model"].alias("route_terminal_model"),
        guess("status").alias("estimated_status"), guess("justification").alias("estimated_justification"), guess("basis").alias("estimate_basis"), guess("confidence").alias("estimate_confidence"),
        F.when(settled, verdict["status"]).otherwise(noisy).alias("label"), clean.alias("clean_label"), F.when(settled, "execution").otherwise("av-estimate").alias("label_source"), sentences.alias("sentences"),
        F.when(settled, rationale(sentences, ("exec_affected", "exec_not_affected"))).otherwise(rationale(sentences, ("av", "exposure"))).alias("gold_rationale_ids"),
        rationale(sentences, ("src_unavailable", "src_pending", "src_available", "version_unknown", "exec_affected", "exec_not_affected")).alias("primary_rationale_ids"),
    )
