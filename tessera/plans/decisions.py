"""The decision chain over orders, customers and events that stand for findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import decide
from tessera.functions.hashing import hash_mod, hash_mod_sql, pool_pick
from tessera.operators import docs
from tessera.plans.base import Book, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

#: Device names from customers' numbers, so that all classes occur.
_WORDS = ("plc unit", "edge gateway", "scada server", "field sensor", "drive 7", "vpn box", "hmi panel")
_NAMED_SQL = "(SELECT c_custkey, c_name, list_element([" + ", ".join(f"'{w} '" for w in _WORDS) + "], CAST(c_custkey % 7 AS INTEGER) + 1) || c_custkey AS device FROM customer)"


def _devices(spark, sf_dir):
    word = F.element_at(F.array(*(F.lit(w + " ") for w in _WORDS)), (F.col("c_custkey") % 7).cast("int") + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(word, F.col("c_custkey").cast("string")).alias("device"))


def _exposure_sql(device: str) -> str:
    k = hash_mod_sql(f"'exp::' || {device}", 1000)
    out = ""
    for words, cuts in decide.EXPOSURE_CLASSES:
        test = " OR ".join(f"contains(lower({device}), '{w}')" for w in words) or "true"
        out += f" WHEN {test} THEN CASE " + " ".join(f"WHEN {k} <= {c} THEN '{e}'" for e, c in zip(decide.EXPOSURES, cuts, strict=False)) + f" ELSE '{decide.EXPOSURES[-1]}' END"
    return f"CASE{out} END"


@BOOK.add("hash_exposure", f"SELECT device, {_exposure_sql('device')} AS exposure FROM {_NAMED_SQL}")
def hash_exposure(spark, sf_dir):
    return _devices(spark, sf_dir).select("device", decide.exposure_for(F.col("device")).alias("exposure"))


@BOOK.add("hash_pool_pick", f"SELECT c_custkey, list_element(['a', 'b', 'c', 'd', 'e', 'f', 'g'], CAST({hash_mod_sql("'pool::' || c_name", 7)} AS INTEGER) + 1) AS pick, CAST({hash_mod_sql("'k::' || c_name", 100)} AS BIGINT) AS percent FROM customer")
def hash_pool_pick(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", pool_pick(list("abcdefg"), ["pool", F.col("c_name")]).alias("pick"), hash_mod(["k", F.col("c_name")], 100).alias("percent"))


_FINDINGS_SQL = f"""(SELECT o_orderkey, device, {_exposure_sql("device")} AS exposure,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'N' WHEN '2-HIGH' THEN 'A' WHEN '3-MEDIUM' THEN 'L' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'P' END AS av,
  CASE WHEN o_orderkey % 3 = 0 THEN 'per-cve' ELSE 'advisory-mode' END AS av_source, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'E' END AS tier,
  o_orderkey % 11 = 0 AS kev, o_totalprice, o_orderstatus FROM orders JOIN {_NAMED_SQL} ON o_custkey = c_custkey)"""
_REACH_SQL = """CASE WHEN av = '' THEN 'unknown' WHEN av = 'N' THEN CASE exposure WHEN 'isolated-cell' THEN 'no' WHEN 'control-network' THEN 'conditional' ELSE 'yes' END
  WHEN av = 'A' THEN CASE exposure WHEN 'isolated-cell' THEN 'no' WHEN 'remote-accessible' THEN 'yes' ELSE 'conditional' END WHEN av = 'P' THEN 'no' ELSE 'conditional' END"""


def findings(spark, sf_dir):
    """Orders as findings: a device, an exposure, an attack vector, a tier and whether it is exploited."""
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    d = _devices(spark, sf_dir).withColumn("exposure", decide.exposure_for(F.col("device")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    av = F.when(p == "1-URGENT", "N").when(p == "2-HIGH", "A").when(p == "3-MEDIUM", "L").when(p == "4-NOT SPECIFIED", "").otherwise("P")
    tier = F.when(k % 4 == 0, "A").when(k % 4 == 1, "C").otherwise("E")
    return o.join(d, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "device", "exposure", av.alias("av"), F.when(k % 3 == 0, "per-cve").otherwise("advisory-mode").alias("av_source"), tier.alias("tier"), (k % 11 == 0).alias("kev"), "o_totalprice", "o_orderstatus")


_CONF_SQL = """CASE WHEN reach = 'unknown' THEN 0.2 ELSE round(least(92, greatest(15, CASE WHEN av_source = 'per-cve' THEN 78 ELSE 55 END - CASE WHEN reach = 'conditional' THEN 18 ELSE 0 END
  + CASE tier WHEN 'A' THEN 6 WHEN 'E' THEN -5 ELSE 0 END + CASE WHEN kev AND reach = 'yes' THEN 5 ELSE 0 END)) / 100, 3) END"""
_STATUS_SQL = "CASE reach WHEN 'yes' THEN 'LIKELY_AFFECTED' WHEN 'no' THEN 'LIKELY_NOT_AFFECTED' ELSE 'UNDER_INVESTIGATION' END"


@BOOK.add("reachability_estimate", f"WITH f AS (SELECT *, {_REACH_SQL} AS reach FROM {_FINDINGS_SQL}) SELECT o_orderkey, av, exposure, reach, {_STATUS_SQL} AS status, CAST({_CONF_SQL} AS DOUBLE) AS confidence FROM f")
def reachability_estimate(spark, sf_dir):
    c = F.col
    f = findings(spark, sf_dir).withColumn("e", decide.estimate(c("av"), c("exposure"), c("av_source"), c("tier"), c("kev")))
    return f.select("o_orderkey", "av", "exposure", "e.reach", "e.status", F.col("e.confidence").cast("double").alias("confidence"))


@BOOK.add(
    "batch_sweep",
    f"""
    WITH f AS (SELECT *, {_REACH_SQL} AS reach FROM {_FINDINGS_SQL}),
    v AS (SELECT *, {_STATUS_SQL} AS status, CASE WHEN o_orderkey % 13 = 0 THEN 'code-available' WHEN tier IN ('A', 'C') THEN 'oss-attributed' ELSE 'vendor-proprietary' END AS source_class,
          CAST(CASE WHEN reach = 'no' THEN 0.72 ELSE {_CONF_SQL} END AS DOUBLE) AS confidence FROM f)
    SELECT source_class, status, CASE WHEN status = 'UNDER_INVESTIGATION' THEN 'under-investigation' ELSE 'static-reasoned' END AS evidence_tier, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS mean_confidence FROM v GROUP BY 1, 2, 3
    """,
)
def batch_sweep(spark, sf_dir):
    c = F.col
    f = findings(spark, sf_dir).withColumn("b", decide.batch_decision(c("av"), c("exposure"), c("av_source"), c("tier"), c("kev"))).select("o_orderkey", "tier", "b.status", F.col("b.confidence").cast("double").alias("confidence"))
    f = f.withColumn("source_class", decide.source_class(c("o_orderkey") % 13 == 0, c("tier"))).withColumn("evidence_tier", decide.evidence_tier(c("status")))
    return f.groupBy("source_class", "status", "evidence_tier").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@BOOK.add(
    "annotator_noise",
    f"""
    WITH f AS (SELECT *, {_REACH_SQL} AS reach FROM {_FINDINGS_SQL}), s AS (SELECT *, {_STATUS_SQL} AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'medium' ELSE 'high' END AS sev, (o_orderkey % 100) / 100.0 AS epss FROM f),
    n AS (SELECT *, {hash_mod_sql("'noise::' || device || '::' || o_orderkey", 1000)} <= CASE WHEN reach IN ('conditional', 'unknown') OR sev = 'medium' OR epss BETWEEN 0.3 AND 0.6 THEN 159 ELSE 39 END AS changed, {hash_mod_sql("'nd::' || device || '::' || o_orderkey", 2)} AS side FROM s)
    SELECT o_orderkey, CASE WHEN NOT changed THEN status WHEN status <> 'UNDER_INVESTIGATION' THEN 'UNDER_INVESTIGATION' WHEN side = 1 THEN 'LIKELY_AFFECTED' ELSE 'LIKELY_NOT_AFFECTED' END AS label FROM n
    """,
)
def annotator_noise(spark, sf_dir):
    c = F.col
    f = findings(spark, sf_dir).withColumn("reach", decide.reachability(c("av"), c("exposure")))
    status = F.when(c("reach") == "yes", decide.AFFECTED).when(c("reach") == "no", decide.NOT_AFFECTED).otherwise(decide.UNDER_INVESTIGATION)
    sev, epss = F.when(c("o_orderkey") % 5 == 0, "medium").otherwise("high"), (c("o_orderkey") % 100) / 100.0
    return f.select("o_orderkey", decide.annotator_noise(status, c("device"), c("o_orderkey").cast("string"), c("reach"), sev, epss).alias("label"))


@BOOK.add(
    "adjudicate_evidence",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 14 = 0 THEN 'LIKELY_NOT_AFFECTED' WHEN o_orderkey % 7 = 0 THEN 'LIKELY_AFFECTED' ELSE 'UNDER_INVESTIGATION' END AS status,
           CASE WHEN o_orderkey % 7 = 0 THEN 'execution-verified' WHEN o_orderkey % 5 = 0 THEN 'source-available-unverified' WHEN tier IN ('A', 'C') THEN 'source-pending' ELSE 'source-unavailable' END AS evidence_tier,
           CASE WHEN o_orderkey % 7 <> 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'asserted' ELSE 'assumed-vulnerable' END AS version_basis
    FROM {_FINDINGS_SQL}
    """,
)
def adjudicate_evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    a = decide.adjudicate(F.col("tier"), k % 5 == 0, k % 7 == 0, F.lit("fault"), F.lit("1.1"), F.when(k % 2 == 0, "1.1"))
    return findings(spark, sf_dir).withColumn("a", a).select("o_orderkey", "a.status", "a.evidence_tier", "a.version_basis")


@BOOK.add("severity_bands", "SELECT s_suppkey, CASE WHEN s_acctbal / 1000 >= 9 THEN 'critical' WHEN s_acctbal / 1000 >= 7 THEN 'high' WHEN s_acctbal / 1000 >= 4 THEN 'medium' ELSE 'low' END AS severity FROM supplier")
def severity_bands(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", decide.severity(F.col("s_acctbal") / 1000).alias("severity"))


@BOOK.add(
    "attack_vector_precedence",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' WHEN o_orderkey % 5 = 0 THEN 'L' WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 THEN 'P' ELSE '' END AS av, CASE WHEN o_orderkey % 3 = 0 THEN 'per-cve' WHEN o_orderkey % 5 = 0 THEN 'advisory-mode' WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 THEN 'nvd' ELSE '' END AS av_source FROM orders",
)
def attack_vector_precedence(spark, sf_dir):
    k = F.col("o_orderkey")
    r = decide.resolve_av(F.when(k % 3 == 0, "N").otherwise(""), F.when(k % 5 == 0, "L"), F.when(k % 2 == 0, "P"), F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").withColumn("r", r).select("o_orderkey", "r.av", "r.av_source")


@BOOK.add(
    "device_category",
    "SELECT device, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(device), '{w}')" for w in words) + f" THEN '{name}'" for name, words in decide.DEVICE_CATEGORIES) + f" ELSE '{decide.OTHER_DEVICE}' END AS category FROM {_NAMED_SQL}",
)
def device_category(spark, sf_dir):
    return _devices(spark, sf_dir).select("device", decide.device_category(F.col("device")).alias("category"))


_RULES = {"A metal": ["steel", "tin", "brass"], "B plated": ["plated", "burnished"], "C size": ["small", "large", "medium"]}


@BOOK.add(
    "device_types_multi",
    "SELECT p_partkey, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(p_type), '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in _RULES.items()) + "], lambda x: x IS NOT NULL), ';') AS types FROM part",
)
def device_types_multi(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(decide.device_types(F.array("p_type"), _RULES), ";").alias("types"))


_SSVC_VALUES = ", ".join("('" + "', '".join(r) + "')" for r in decide.SSVC_ROWS)


@BOOK.add(
    "decision_table",
    f"""
    WITH i AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'active' WHEN value / 100 >= 0.1 THEN 'poc' ELSE 'none' END AS e, CASE event_id % 4 WHEN 0 THEN 'small' WHEN 3 THEN 'open' ELSE 'controlled' END AS x, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS a FROM events),
    t(e, x, a, h, d) AS (VALUES {_SSVC_VALUES})
    SELECT event_id, coalesce(d, 'defer') AS decision, 'SSVCv2/E:' || upper(left(i.e, 1)) || '/X:' || upper(left(i.x, 1)) || '/A:' || upper(left(i.a, 1)) || '/H:M/P:' || coalesce(d, 'defer') AS vector FROM i LEFT JOIN t ON t.e = i.e AND t.x = i.x AND t.a = i.a AND t.h = 'medium'
    """,
)
def decision_table(spark, sf_dir):
    k, c = F.col("event_id"), F.col
    exposure = F.element_at(F.array(*map(F.lit, decide.EXPOSURES)), (k % 4).cast("int") + 1)
    i = table(spark, sf_dir, "events").withColumn("i", decide.ssvc_inputs(c("event_type") == "error", c("value") / 100, F.when(k % 2 == 0, "N").otherwise("L"), exposure)).select("event_id", "i.*")
    d = decide.ssvc_decide(i)
    return d.select("event_id", "decision", decide.ssvc_vector(c("exploitation"), c("exposure"), c("automatable"), c("human_impact"), c("decision")).alias("vector"))


@BOOK.add(
    "decision_tree",
    """
    WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' WHEN 3 THEN 'P' ELSE '' END AS av, quality = 1 AS in_range, toxic = 1 AS source, doc_id % 2 = 0 AS q1, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 <> 0 END AS q2, doc_id % 11 <> 0 AS q3, doc_id % 13 < 6 AS q4 FROM labels)
    SELECT doc_id, CASE WHEN NOT in_range THEN 'not_affected' WHEN source THEN 'route_to_code' WHEN av = '' THEN 'under_investigation' WHEN NOT q1 THEN 'not_affected' WHEN q2 IS NULL THEN NULL WHEN NOT q2 THEN 'not_affected' WHEN av = 'P' THEN 'under_investigation' WHEN NOT q3 THEN 'not_affected' ELSE 'under_investigation' END AS status,
           CASE WHEN NOT in_range THEN 'code_not_reachable' WHEN source THEN 'source_available' WHEN av = '' THEN 'attack_vector_unstated' WHEN NOT q1 THEN CASE WHEN av = 'L' THEN 'requires_environment' ELSE 'protected_at_perimeter' END WHEN q2 IS NULL THEN NULL
                WHEN NOT q2 THEN CASE WHEN av = 'P' THEN 'requires_configuration' ELSE 'code_not_reachable' END WHEN av <> 'P' AND NOT q3 THEN 'protected_by_mitigating_control' WHEN q4 THEN 'likely_affected_high' ELSE 'likely_affected_medium' END AS justification,
           CASE WHEN in_range AND NOT source AND av <> '' AND q1 AND q2 IS NULL THEN CASE av WHEN 'L' THEN 'loc_exec' WHEN 'P' THEN 'phy_config' ELSE 'net_exec' END END AS pending FROM a
    """,
)
def decision_tree(spark, sf_dir):
    k = F.col("doc_id")
    av = F.element_at(F.array(*map(F.lit, ["N", "A", "L", "P", ""])), (k % 5).cast("int") + 1)
    q1, q2, q3, q4 = k % 2 == 0, F.when(k % 7 != 0, k % 3 != 0), k % 11 != 0, k % 13 < 6
    answers = {"affected_range": F.col("quality") == 1, "source_check": F.col("toxic") == 1}
    answers |= {q: q1 for q in ("net_reach", "loc_priv", "phy_access")} | {q: q2 for q in ("net_exec", "loc_exec", "phy_config")} | {q: q3 for q in ("net_mit", "loc_mit")} | {q: q4 for q in ("net_impact", "loc_impact", "phy_impact")}
    return table(spark, sf_dir, "labels").withColumn("w", decide.walk_tree(av, answers)).select("doc_id", "w.status", "w.justification", "w.pending")


@BOOK.add(
    "row_status",
    "WITH a AS (SELECT o_orderkey, o_orderkey % 4 <> 3 AS ok, CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'affected' ELSE 'under_investigation' END AS auto, CASE WHEN o_orderkey % 10 = 0 THEN 'not_affected' END AS ov FROM orders) SELECT o_orderkey, CASE WHEN ok THEN coalesce(ov, auto) ELSE 'under_investigation' END AS status, CASE WHEN NOT ok THEN CASE auto WHEN 'fixed' THEN 'likely_fixed' WHEN 'affected' THEN 'likely_affected' ELSE 'unable_to_determine' END END AS estimation FROM a",
)
def row_status(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    auto = F.when(s == "F", "fixed").when(s == "O", "affected").otherwise("under_investigation")
    r = decide.row_status(k % 4 != 3, F.when(k % 10 == 0, "not_affected"), auto, F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").withColumn("r", r).select("o_orderkey", "r.status", "r.estimation")


@BOOK.add(
    "run_verdicts",
    "WITH r AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type = 'error' END AS v, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 = 0 END AS p FROM events) SELECT event_id, CASE WHEN v IS NULL OR p IS NULL THEN 'BUILD_FAILED' WHEN v AND NOT p THEN 'EXPLOITABLE' WHEN NOT v THEN 'NOT_TRIGGERED' ELSE 'NOT_DISCRIMINATING' END AS verdict FROM r",
)
def run_verdicts(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", decide.run_verdict(F.when(k % 5 != 0, F.col("event_type") == "error"), F.when(k % 7 != 0, k % 3 == 0), F.lit("build")).alias("verdict"))


@BOOK.add(
    "tier_attribution",
    "SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'E' WHEN p_size % 2 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN 'C' ELSE 'E' END AS tier, CASE WHEN p_size % 9 = 0 THEN 'blocked' WHEN p_partkey % 5 = 0 THEN 'no-repo' WHEN p_partkey % 4 <> 0 AND p_size > 40 THEN 'no-version' ELSE 'verifiable' END AS spec FROM part",
)
def tier_attribution(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    spec = decide.spec_status(s % 9 == 0, k % 5 != 0, s <= 40, k % 4 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", decide.tier_of(s % 9 == 0, s % 2 == 0, k % 3).alias("tier"), spec["status"].alias("spec"))


@BOOK.add(
    "conservative_engine",
    """
    WITH m AS (SELECT event_id, value / 100 AS conf, CASE event_id % 3 WHEN 0 THEN 'LIKELY_NOT_AFFECTED' WHEN 1 THEN 'LIKELY_AFFECTED' ELSE 'UNDER_INVESTIGATION' END AS lab, event_id % 4 = 0 AS counter, event_id % 6 = 1 AS run, event_id % 5 < 2 AS code, event_id % 7 < 3 AS present FROM events)
    SELECT event_id, CASE WHEN conf < 0.55 THEN 'UNDER_INVESTIGATION' WHEN lab = 'LIKELY_NOT_AFFECTED' AND (NOT counter OR (code AND present)) THEN 'UNDER_INVESTIGATION' WHEN lab = 'LIKELY_AFFECTED' AND NOT run AND code AND NOT present THEN 'UNDER_INVESTIGATION' ELSE lab END AS status FROM m
    """,
)
def conservative_engine(spark, sf_dir):
    k = F.col("event_id")
    label = F.when(k % 3 == 0, decide.NOT_AFFECTED).when(k % 3 == 1, decide.AFFECTED).otherwise(decide.UNDER_INVESTIGATION)
    kinds = F.array_compact(F.array(F.when(k % 4 == 0, "exposure"), F.when(k % 6 == 1, "exec_affected"), F.lit("identity")))
    c = decide.conservative(label, F.col("value") / 100, kinds, k % 5 < 2, F.when(k % 7 < 3, "present").otherwise("weak"), ["exposure", "exec_fixed"])
    return table(spark, sf_dir, "events").select("event_id", c["status"].alias("status"))


@BOOK.add(
    "cve_mart",
    f"""
    WITH f AS (SELECT *, {_REACH_SQL} AS reach, o_orderkey % 500 AS cve FROM {_FINDINGS_SQL}), s AS (SELECT *, {_STATUS_SQL} AS status FROM f),
    w AS (SELECT cve, status FROM (SELECT *, row_number() OVER (PARTITION BY cve ORDER BY CASE status WHEN 'LIKELY_AFFECTED' THEN 3 WHEN 'UNDER_INVESTIGATION' THEN 2 ELSE 1 END DESC, o_orderkey) AS k FROM s) WHERE k = 1)
    SELECT s.cve, any_value(w.status) AS vex, max(o_totalprice) AS cvss, bool_or(kev) AS kev, string_agg(DISTINCT tier, ';' ORDER BY tier) AS vendors, CAST(count(*) AS BIGINT) AS n_findings FROM s JOIN w ON s.cve = w.cve GROUP BY s.cve
    """,
)
def cve_mart(spark, sf_dir):
    c = F.col
    e = decide.estimate(c("av"), c("exposure"), c("av_source"), c("tier"), c("kev"))
    f = findings(spark, sf_dir).withColumn("status", e["status"])
    rows = f.select((c("o_orderkey") % 500).alias("cve"), "status", F.lit("high").alias("severity"), c("o_totalprice").alias("cvss"), c("av").alias("cwe"), "kev", c("tier").alias("vendor"), c("exposure").alias("device_type"), c("device").alias("component"), c("o_orderkey").alias("pos"))
    return docs.cve_mart(rows).select("cve", "vex", "cvss", "kev", "vendors", "n_findings")


def statements(spark, sf_dir):
    c, k = F.col, F.col("o_orderkey")
    e = decide.estimate(c("av"), c("exposure"), c("av_source"), c("tier"), c("kev"))
    none = F.lit(None).cast("string")
    f = findings(spark, sf_dir).withColumn("e", e).withColumn("i", decide.ssvc_inputs(c("kev"), F.lit(0.2), c("av"), c("exposure"))).select("*", "i.*")
    f = decide.ssvc_decide(f.drop("exposure").withColumn("exposure", c("i.exposure")))
    vector = decide.ssvc_vector(c("exploitation"), c("exposure"), c("automatable"), c("human_impact"), c("decision"))
    return f.select(F.concat(F.lit("CVE-2024-"), F.lpad(k.cast("string"), 6, "0")).alias("cve"), F.substring_index("device", " ", 1).alias("product"), F.concat(F.lit("pkg:generic/"), F.substring_index("device", " ", 1)).alias("product_id"), decide.canonical_status(c("e.status")).alias("status"), c("e.justification").alias("justification"), none.alias("action_statement"), none.alias("remediation"), none.alias("progress"), none.alias("missing"), none.alias("planned"), none.alias("fixed_version"), none.alias("patch_reference"), none.alias("estimation"), c("device").alias("component"), "decision", vector.alias("ssvc_vector"))


@BOOK.add("openvex_documents")
def openvex_documents(spark, sf_dir):
    """One OpenVEX document in JSON for each product; JSON text differs between engines, so tests parse it."""
    return docs.openvex(statements(spark, sf_dir), "product", "tessera", "2024-01-01T00:00:00Z")


@BOOK.add("csaf_documents")
def csaf_documents(spark, sf_dir):
    return docs.csaf(statements(spark, sf_dir), "product", "tessera", "2024-01-01T00:00:00Z")


@BOOK.add("inventory_documents")
def inventory_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("device"), F.col("p_partkey").cast("string").alias("ref"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.lit(None).cast("string").alias("cpe"), F.concat(F.lit("pkg:generic/"), F.col("p_partkey").cast("string")).alias("purl"), F.array(F.concat(F.lit("CVE-2024-"), F.col("p_partkey").cast("string"))).alias("cves"))
    return docs.inventory(p, "device", "2024-01-01T00:00:00Z")
