"""Decisions about findings as pure column expressions: exposure, reachability, estimates, evidence, SSVC, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_mod

#: Statuses, exposures (least exposed first), and the ranks that decide which status is worse.
AFFECTED, NOT_AFFECTED, UNDER_INVESTIGATION = "LIKELY_AFFECTED", "LIKELY_NOT_AFFECTED", "UNDER_INVESTIGATION"
EXPOSURES = ("isolated-cell", "control-network", "dmz-routable", "remote-accessible")
STATUS_RANK = {AFFECTED: 3, UNDER_INVESTIGATION: 2, NOT_AFFECTED: 1}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

#: Words of a device's name, and the last thousandth of each exposure but the last.
EXPOSURE_CLASSES = (
    (("plc", "rtu", "relay", "controller", "safety", "ied", "drive"), (420, 760, 920)),
    (("gateway", "firewall", "router", "switch", "vpn", "remote"), (50, 250, 650)),
    (("scada", "hmi", "historian", "server", "workstation", "engineering"), (100, 440, 780)),
    ((), (250, 550, 830)),
)

#: The category of a device by the first list that has a word of its name.
DEVICE_CATEGORIES = (
    ("OS / Protocol stack", ("vxworks", "ipnet", "tcp-ip", "tcpip", "rtos", "treck", "interpeak", "freertos", "stack")),
    ("Network / Comms", ("scalance", "ruggedcom", "switch", "router", "gateway", "sinec", "telecontrol", "firewall", "vpn", "modem", "ethernet")),
    ("PLC / Controller", ("simatic", "s7-", "-cpu", "plc", "logix", "modicon", "controller", "logic")),
    ("Drive / Motion", ("sinamics", "drive", "motion", "servo", "inverter", "robot")),
    ("HMI / SCADA / Server", ("hmi", "scada", "wincc", "historian", "workstation", "-server", "nms", "-ins")),
)
OTHER_DEVICE = "Other / Field device"

#: Component languages other than C/C++.
LANGUAGES = {"log4j": "Java", "tomcat": "Java", "jackson": "Java", "spring": "Java", "openjdk": "Java", "dotnet": "C#/.NET", "sqlserver_express": "SQL/DB", "sqlite": "C (SQL engine)"}

CONTROLLED, CONTROLLABLE = "vulnerable_code_cannot_be_controlled_by_adversary", "vulnerable_code_controllable_by_adversary"


def any_of(text: Column, keywords) -> Column:
    """Whether a lower-cased text has any of the keywords; none if there are none."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def truth(c: Column) -> Column:
    """Booleans written as text: 1, true and yes in any case are true, everything else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def exposure_for(device: Column) -> Column:
    """The exposure drawn for a device by its name's class and its hash."""
    name, k = F.lower(F.coalesce(device, F.lit(""))), hash_mod(["exp", F.coalesce(device, F.lit(""))], 1000)
    out = F.lit(None).cast("string")
    for keywords, cuts in reversed(EXPOSURE_CLASSES):
        drawn = F.lit(EXPOSURES[-1])
        for exposure, cut in reversed(list(zip(EXPOSURES, cuts, strict=False))):
            drawn = F.when(k <= cut, exposure).otherwise(drawn)
        out = F.when(any_of(name, keywords), drawn).otherwise(out) if keywords else drawn
    return out


def checked_exposure(exposure: Column) -> Column:
    """PF15: (exposure, error): an exposure outside the known ones is an error, null is none."""
    known = exposure.isin(*EXPOSURES)
    return F.struct(F.when(known, exposure).alias("exposure"), F.when(~known, F.concat(F.lit("unknown exposure: "), exposure)).alias("error"))


def exposure_tier(exposure: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, e in enumerate(EXPOSURES):
        out = F.when(exposure == e, i).otherwise(out)
    return out


def reachability(av: Column, exposure: Column, physical_unreachable: bool = True) -> Column:
    """Whether an attack vector reaches an asset at an exposure."""
    tier = exposure_tier(exposure)
    return (
        F.when(blank(av), "unknown")
        .when(av == "N", F.when(tier == 0, "no").when(tier == 1, "conditional").otherwise("yes"))
        .when(av == "A", F.when(tier == 0, "no").when(tier <= 2, "conditional").otherwise("yes"))
        .when(av == "P", F.lit("no" if physical_unreachable else "conditional"))
        .otherwise("conditional")
    )


def estimate(av: Column, exposure: Column, av_source: Column, tier: Column, kev: Column) -> Column:
    """(status, justification, vocabulary, basis, confidence, reach) where no evidence settles a finding."""
    reach = reachability(av, exposure)
    status = F.when(reach == "yes", AFFECTED).when(reach == "no", NOT_AFFECTED).otherwise(UNDER_INVESTIGATION)
    cents = F.when(av_source == "per-cve", 78).otherwise(55) - F.when(reach == "conditional", 18).otherwise(0) + F.when(tier == "A", 6).when(tier == "E", -5).otherwise(0) + F.when(kev & (reach == "yes"), 5).otherwise(0)
    confidence = F.when(reach == "unknown", F.lit(0.2)).otherwise(F.round(F.least(F.lit(92), F.greatest(F.lit(15), cents)) / 100, 3))
    basis = (
        F.when(reach == "unknown", "attack vector not stated in the source advisory")
        .when(reach == "yes", F.concat(F.lit("AV:"), av, F.lit(" reaches the asset at exposure tier '"), exposure, F.lit("'")))
        .when((reach == "no") & (av == "P"), "AV:P requires hands-on access to the hardware")
        .when(reach == "no", F.concat(F.lit("AV:"), av, F.lit(" cannot traverse to an asset at exposure tier '"), exposure, F.lit("'")))
        .otherwise(F.concat(F.lit("AV:"), av, F.lit(" is conditionally reachable at exposure tier '"), exposure, F.lit("'")))
    )
    return F.struct(
        status.alias("status"),
        F.when(reach == "yes", CONTROLLABLE).when(reach == "no", CONTROLLED).alias("justification"),
        F.when(reach == "yes", "extension").when(reach == "no", "csaf-openvex").alias("vocabulary"),
        basis.alias("basis"),
        confidence.alias("confidence"),
        reach.alias("reach"),
    )


def adjudicate(tier: Column, has_code: Column, discriminates: Column, signal: Column, patched_version: Column, version: Column) -> Column:
    """D3: (status, justification, evidence_tier, version_basis) from execution, code, attribution, in that order."""
    run = F.coalesce(discriminates, F.lit(False))
    asserted = ~blank(version)
    fixed = run & asserted & F.coalesce(version == patched_version, F.lit(False))
    fault = F.when(blank(signal), "documented failure state").otherwise(signal)
    return F.struct(
        F.when(fixed, NOT_AFFECTED).when(run, AFFECTED).otherwise(UNDER_INVESTIGATION).alias("status"),
        F.when(fixed, "vulnerable_code_not_present").when(run, "vulnerable_code_present").alias("justification"),
        F.when(fixed, "csaf-openvex").when(run, "extension").alias("vocabulary"),
        F.when(run, "execution-verified").when(has_code, "source-available-unverified").when(tier.isin("A", "C"), "source-pending").otherwise("source-unavailable").alias("evidence_tier"),
        F.when(run & asserted, "asserted").when(run, "assumed-vulnerable").alias("version_basis"),
        F.when(run, fault).alias("signal"),
    )


def annotator_noise(label: Column, device: Column, cve: Column, reach: Column, severity: Column, epss: Column) -> Column:
    """A simulated annotator's label; never turns affected into not affected or back."""
    boundary = reach.isin("conditional", "unknown") | F.coalesce(severity == "medium", F.lit(False)) | F.coalesce(epss.between(0.3, 0.6), F.lit(False))
    changed = hash_mod(["noise", device, cve], 1000) <= F.when(boundary, 159).otherwise(39)
    other = F.when(label == UNDER_INVESTIGATION, F.when(hash_mod(["nd", device, cve], 2) == 1, AFFECTED).otherwise(NOT_AFFECTED)).otherwise(UNDER_INVESTIGATION)
    return F.when(changed, other).otherwise(label)


def route(has_code: Column) -> Column:
    """The stages a finding goes through, and the model at their end."""
    return F.struct(
        F.when(has_code, F.array(F.lit("context"), F.lit("code"), F.lit("analyst"))).otherwise(F.array(F.lit("context"))).alias("stages"),
        F.when(has_code, "analyst").otherwise("context").alias("terminal_model"),
    )


def batch_decision(av: Column, exposure: Column, av_source: Column, tier: Column, kev: Column) -> Column:
    """What is unreachable is not affected at a fixed confidence; the rest is estimated."""
    est = estimate(av, exposure, av_source, tier, kev)
    gate = est["reach"] == "no"
    return F.struct(
        est["status"].alias("status"), est["justification"].alias("justification"), F.when(gate, F.lit(0.72)).otherwise(est["confidence"]).alias("confidence"), est["reach"].alias("reach"),
        F.when(gate, "presence-reachability").otherwise("presence-reachability->deterministic-estimate").alias("route"),
    )


def source_class(has_pair: Column, tier: Column) -> Column:
    """D8."""
    return F.when(has_pair, "code-available").when(tier.isin("A", "C"), "oss-attributed").otherwise("vendor-proprietary")


def evidence_tier(status: Column, has_pair: Column | None = None, separable: Column | None = None, grounded: Column | None = None) -> Column:
    """Of a batch verdict; with the other columns, of one that models and a critic have seen (a null critic agrees)."""
    decided = status.isin(AFFECTED, NOT_AFFECTED)
    out = F.when(decided, "static-reasoned").otherwise("under-investigation")
    if has_pair is None:
        return out
    return F.when(decided & has_pair & F.coalesce(separable, F.lit(False)) & F.coalesce(grounded, F.lit(True)), "static-analysis-verified").otherwise(out)


def presence_gate(av: Column, exposure: Column, version_pinned: Column) -> Column:
    """A verdict where the component can't be reached, null where the finding goes on."""
    reach = reachability(av, exposure)
    return F.struct(F.when(reach == "no", NOT_AFFECTED).alias("terminal"), reach.alias("reachability"), (~version_pinned).alias("version_unconfirmed"))


def justification_for(status: Column, reach: Column, has_pair: Column, separable: Column) -> Column:
    """(justification, vocabulary) of a final verdict."""
    proved = has_pair & F.coalesce(separable, F.lit(False))
    return F.struct(
        F.when((status == NOT_AFFECTED) & (reach != "no") & proved, "vulnerable_code_not_present").when(status == NOT_AFFECTED, CONTROLLED).when((status == AFFECTED) & (reach == "yes"), CONTROLLABLE).when(status == AFFECTED, "vulnerable_code_present").alias("justification"),
        F.when(status == NOT_AFFECTED, "csaf-openvex").when(status == AFFECTED, "extension").alias("vocabulary"),
    )


def tier_of(closed: Column, in_catalog: Column, n_hits: Column) -> Column:
    """Closed components are E, catalogued CVEs A, a device's only open-source hit C, the rest E."""
    return F.when(closed, "E").when(in_catalog, "A").when(n_hits == 1, "C").otherwise("E")


def severity(score: Column) -> Column:
    """D15."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low")


def severity_grade(score: Column) -> Column:
    """D15, as shown: None at zero."""
    return F.when(score.isNull() | (score <= 0), "None").otherwise(F.initcap(severity(score)))


def resolve_av(per_cve: Column, modal: Column, nvd: Column, has_score: Column) -> Column:
    """(av, av_source) by precedence; the national feed only where the advisory has no score."""
    return F.struct(
        F.coalesce(F.nullif(per_cve, F.lit("")), F.nullif(modal, F.lit("")), F.when(~has_score, F.nullif(nvd, F.lit(""))), F.lit("")).alias("av"),
        F.when(~blank(per_cve), "per-cve").when(~blank(modal), "advisory-mode").when(~has_score & ~blank(nvd), "nvd").otherwise("").alias("av_source"),
    )


def pick_metric(v31: Column, v30: Column, v2: Column) -> Column:
    """The newest CVSS version's primary metric, else its first."""

    def best(a: Column) -> Column:
        return F.coalesce(F.get(F.filter(a, lambda m: m["type"] == "Primary"), 0), F.get(a, 0))

    return F.coalesce(best(v31), best(v30), best(v2))


def device_category(name: Column) -> Column:
    """D19."""
    lower, out = F.lower(F.coalesce(name, F.lit(""))), F.lit(OTHER_DEVICE)
    for category, keywords in reversed(DEVICE_CATEGORIES):
        out = F.when(any_of(lower, keywords), category).otherwise(out)
    return out


def device_types(products: Column, rules: dict[str, list[str]]) -> Column:
    """The sorted names of all rules with a keyword in any product."""

    def has(words: list[str]) -> Column:
        return F.exists(products, lambda p: any_of(F.lower(p), words))

    hits = [F.when(has(words), F.lit(name)) for name, words in rules.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def device_scope(products: Column, types: Column, generic: list[str]) -> Column:
    """Whose products these are."""
    return F.when(F.size(types) > 0, "device-attributed").when(F.exists(products, lambda p: any_of(F.lower(p), generic)), "shared-oss-component").otherwise("unclassified")


def base_platform(keys: Column, known: dict[str, str], default: str = "embedded") -> Column:
    """The platform that the first known component of a device stands for."""
    out = F.lit(default)
    for key, platform in reversed(known.items()):
        out = F.when(F.array_contains(keys, key), platform).otherwise(out)
    return out


#: The questions of the decision tree. For each: what a no and a yes lead to, another question or an end.
QUESTIONS = {
    "affected_range": (("not_affected", "code_not_reachable"), "source_check"),
    "source_check": ("av_split", ("route_to_code", "source_available")),
    "net_reach": (("not_affected", "protected_at_perimeter"), "net_exec"),
    "net_exec": (("not_affected", "code_not_reachable"), "net_mit"),
    "net_mit": (("not_affected", "protected_by_mitigating_control"), "net_impact"),
    "net_impact": (("under_investigation", "likely_affected_medium"), ("under_investigation", "likely_affected_high")),
    "loc_priv": (("not_affected", "requires_environment"), "loc_exec"),
    "loc_exec": (("not_affected", "code_not_reachable"), "loc_mit"),
    "loc_mit": (("not_affected", "protected_by_mitigating_control"), "loc_impact"),
    "loc_impact": (("under_investigation", "likely_affected_medium"), ("under_investigation", "likely_affected_high")),
    "phy_access": (("not_affected", "protected_at_perimeter"), "phy_config"),
    "phy_config": (("not_affected", "requires_configuration"), "phy_impact"),
    "phy_impact": (("under_investigation", "likely_affected_medium"), ("under_investigation", "likely_affected_high")),
}
VECTOR_QUESTION = (("N", "net_reach"), ("A", "net_reach"), ("L", "loc_priv"), ("P", "phy_access"))


#: The branch of the tree that an attack vector takes.
BRANCH = {"N": "network", "A": "network", "L": "local", "P": "physical"}


def walk_tree(av: Column, answers: dict[str, Column]) -> Column:
    """The end that nullable boolean answers lead to, or the question they stop at.

    (status, justification, pending, path, av_branch, complete): path holds the questions passed, each with its answer
    ("yes", "no", or the branch at the split by attack vector)."""
    step = "array<struct<node:string,answer:string>>"
    letter = F.upper(F.coalesce(av, F.lit("")))
    branch = F.lit(None).cast("string")
    for x, name in BRANCH.items():
        branch = F.when(letter == x, name).otherwise(branch)

    def end(status: str | None, why: str | None, pending: str | None, path: list, complete: bool, along: Column) -> Column:
        made = F.array(*(F.struct(F.lit(n).alias("node"), a.cast("string").alias("answer")) for n, a in path)).cast(step)
        return F.struct(*(F.lit(v).cast("string").alias(n) for n, v in (("status", status), ("justification", why), ("pending", pending))), made.alias("path"), along.alias("av_branch"), F.lit(complete).alias("complete"))

    def at(where, path: list) -> Column:
        if isinstance(where, tuple):
            return end(*where, None, path, True, branch)
        if where == "av_split":
            out = end("under_investigation", "attack_vector_unstated", None, [*path, (where, F.lit(None))], False, F.lit(None).cast("string"))
            for x, question in reversed(VECTOR_QUESTION):
                out = F.when(letter == x, at(question, [*path, (where, F.lit(BRANCH[x]))])).otherwise(out)
            return out
        no, yes = QUESTIONS[where]
        answer = answers.get(where, F.lit(None).cast("boolean"))
        return F.when(answer.isNull(), end(None, None, where, path, False, branch)).when(answer, at(yes, [*path, (where, F.lit("yes"))])).otherwise(at(no, [*path, (where, F.lit("no"))]))

    return at("affected_range", [])


#: SSVC decisions by exploitation, exposure, automatable, for human impact low, medium, high, very high.
D, S, O, I = "defer", "scheduled", "out-of-cycle", "immediate"  # noqa: E741
SSVC = (
    ("none", "small", "no", (D, D, S, S)),
    ("none", "small", "yes", (D, S, S, S)),
    ("none", "controlled", "no", (D, S, S, S)),
    ("none", "controlled", "yes", (S, S, S, S)),
    ("none", "open", "no", (D, S, S, S)),
    ("none", "open", "yes", (S, S, S, O)),
    ("poc", "small", "no", (D, S, S, S)),
    ("poc", "small", "yes", (S, S, S, S)),
    ("poc", "controlled", "no", (D, S, S, S)),
    ("poc", "controlled", "yes", (S, S, S, O)),
    ("poc", "open", "no", (S, S, S, O)),
    ("poc", "open", "yes", (S, S, O, O)),
    ("active", "small", "no", (S, S, O, O)),
    ("active", "small", "yes", (S, O, O, O)),
    ("active", "controlled", "no", (S, S, O, O)),
    ("active", "controlled", "yes", (O, O, O, O)),
    ("active", "open", "no", (S, O, O, I)),
    ("active", "open", "yes", (O, O, I, I)),
)
IMPACTS = ("low", "medium", "high", "very high")
SSVC_ROWS = [(e, x, a, h, decision) for e, x, a, row in SSVC for h, decision in zip(IMPACTS, row, strict=True)]


def ssvc_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SSVC_ROWS, "exploitation string, exposure string, automatable string, human_impact string, decision string")


def ssvc_inputs(kev: Column, epss: Column, av: Column, exposure: Column) -> Column:
    """D23."""
    return F.struct(
        F.when(kev, "active").when(F.coalesce(epss, F.lit(0.0)) >= 0.1, "poc").otherwise("none").alias("exploitation"),
        F.when(exposure == "isolated-cell", "small").when(exposure == "remote-accessible", "open").otherwise("controlled").alias("exposure"),
        F.when(F.upper(F.coalesce(av, F.lit(""))).isin("N", "A"), "yes").otherwise("no").alias("automatable"),
        F.lit("medium").alias("human_impact"),
    )


def ssvc_decide(df: DataFrame) -> DataFrame:
    """Adds decision by a broadcast join with the 72-row table; what it lacks is deferred."""
    keys = ["exploitation", "exposure", "automatable", "human_impact"]
    return df.join(F.broadcast(ssvc_table(df.sparkSession)), keys, "left").withColumn("decision", F.coalesce("decision", F.lit("defer")))


def ssvc_vector(exploitation: Column, exposure: Column, automatable: Column, impact: Column, decision: Column) -> Column:
    """D25."""
    return F.concat(
        F.lit("SSVCv2/E:"), F.when(exploitation == "none", "N").when(exploitation == "poc", "P").otherwise("A"), F.lit("/X:"), F.upper(F.substring(exposure, 1, 1)), F.lit("/A:"), F.upper(F.substring(automatable, 1, 1)),
        F.lit("/H:"), F.when(impact == "very high", "VH").otherwise(F.upper(F.substring(impact, 1, 1))), F.lit("/P:"), decision,
    )


def canonical_status(status: Column) -> Column:
    """D27."""
    s = F.coalesce(status, F.lit(""))
    return F.when(s.isin(AFFECTED) | F.startswith(s, F.lit("likely_affected")), "affected").when(s.isin(NOT_AFFECTED, "not_affected"), "not_affected").when(s == "fixed", "fixed").otherwise("under_investigation")


def canonical_justification(justification: Column) -> Column:
    """One of the five exchanged justifications."""
    j = F.coalesce(justification, F.lit(""))
    return (
        F.when(j.rlike("component_not_present"), "component_not_present")
        .when(j.rlike("vulnerable_code_not_present"), "vulnerable_code_not_present")
        .when(j.rlike("not_in_execute_path|not_reachable|requires_configuration|requires_environment"), "vulnerable_code_not_in_execute_path")
        .when(j.rlike("cannot_be_controlled_by_adversary"), CONTROLLED)
        .when(j.rlike("perimeter|mitigat|protected"), "inline_mitigations_already_exist")
        .otherwise("vulnerable_code_not_in_execute_path")
    )


def csaf_remediation(remediation: Column) -> Column:
    """D27."""
    return F.when(remediation == "patch_or_firmware_upgrade", "vendor_fix").when(remediation == "feature_disablement", "workaround").otherwise("mitigation")


def row_status(collectable: Column, override: Column, automatic: Column, override_estimate: Column) -> Column:
    """(status, estimation): what can't be collected stays under investigation, with an estimate beside it."""
    guess = F.when(automatic == "not_affected", "likely_not_affected").when(automatic == "affected", "likely_affected").when(automatic == "fixed", "likely_fixed").otherwise("unable_to_determine")
    return F.struct(F.when(collectable, F.coalesce(override, automatic)).otherwise("under_investigation").alias("status"), F.when(~collectable, F.coalesce(override_estimate, guess)).alias("estimation"))


def spec_status(closed: Column, has_repo: Column, has_version: Column, has_commit: Column) -> Column:
    """(status, ref_basis) of a specification for a check by execution."""
    return F.struct(
        F.when(closed, "blocked").when(~has_repo, "no-repo").when(~has_commit & ~has_version, "no-version").otherwise("verifiable").alias("status"),
        F.when(has_commit, "fix-commit").when(has_version, "catalog-successor").alias("ref_basis"),
    )


def run_verdict(vulnerable_crash: Column, patched_crash: Column, stage: Column) -> Column:
    """What two recorded runs show; a null one means that its stage failed."""
    return (
        F.when(vulnerable_crash.isNull() | patched_crash.isNull(), F.when(F.startswith(stage, F.lit("trigger")), "TRIGGER_COMPILE_FAILED").when(F.startswith(stage, F.lit("build")), "BUILD_FAILED").otherwise("NEEDS_TRIGGER"))
        .when(vulnerable_crash & ~patched_crash, "EXPLOITABLE")
        .when(~vulnerable_crash, "NOT_TRIGGERED")
        .otherwise("NOT_DISCRIMINATING")
    )


def conservative(label: Column, confidence: Column, kinds: Column, code_route: Column, code_signal: Column, counter_kinds: list[str], least: float = 0.55) -> Column:
    """(status, reason) of a model's label, held back without the evidence it needs. kinds: of the selected sentences."""
    present = F.coalesce(code_signal == "present", F.lit(False))
    counter, run = F.arrays_overlap(kinds, F.array(*map(F.lit, counter_kinds))), F.array_contains(kinds, "exec_affected")
    negative, positive = label == NOT_AFFECTED, label == AFFECTED
    reason = (
        F.when(confidence < least, "model confidence below threshold")
        .when(negative & ~counter, "not-affected lacks positive counter-evidence")
        .when(negative & code_route & present, "code signal contradicts not-affected; execution check required")
        .when(negative, "positive counter-evidence present")
        .when(positive & run, "exploitability confirmed by execution")
        .when(positive & code_route & ~present, "source available but code signal weak; pending execution check")
        .when(positive & ~code_route, "affected estimated from attack vector and deployment context")
        .when(positive, "affected conditions supported by context and code signal")
        .otherwise("insufficient or conflicting evidence")
    )
    held = (confidence < least) | (negative & ~counter) | (negative & code_route & present) | (positive & ~run & code_route & ~present)
    return F.struct(F.when(held, UNDER_INVESTIGATION).otherwise(label).alias("status"), reason.alias("reason"))


def two_signals(context: Column, code: Column) -> Column:
    """Code that was found patched settles a finding; else the context does."""
    return F.when(code == "patched", NOT_AFFECTED).otherwise(context)


def candidate_why(kev: Column, reach: Column, sev: Column, ready: Column) -> Column:
    """What speaks for a candidate, in words; its status is ready with a code pair, else needs-code."""
    return F.concat_ws("; ", F.when(ready, "code pair collected"), F.when(kev, "KEV (exploited in the wild)"), F.concat(F.lit("reachability="), reach), F.when(~blank(sev), F.concat(sev, F.lit(" severity"))))


def candidate_status(ready: Column) -> Column:
    """D32."""
    return F.when(ready, "ready").otherwise("needs-code")


def language(component: Column) -> Column:
    """D33."""
    out = F.lit("C/C++")
    for key, value in LANGUAGES.items():
        out = F.when(component == key, value).otherwise(out)
    return out


def overlay(df: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Saved fields over automatic ones, row by row."""
    saved = overrides.select(key, *(F.col(f).alias(f"saved_{f}") for f in fields))
    joined = df.join(saved, key, "left")
    return joined.select(*(F.coalesce(f"saved_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns))


def collection_outcome(closed: Column, has_tag: Column, fetched: Column, dry: Column | None = None, head_status: Column | None = None) -> Column:
    """The state of a collected source; a dry run only asks for the archive's head, and no answer counts as there."""
    done = F.when(fetched, "collected").otherwise("fetch-failed")
    if dry is not None:
        there = head_status.isNull() | head_status.isin(200, 302)
        done = F.when(dry, F.when(there, "ok").otherwise(F.concat(F.lit("archive-"), head_status.cast("string")))).otherwise(done)
    return F.when(closed, "closed-source").when(~has_tag, "no-tag").otherwise(done)


def resolve_tag(candidates: Column, tags: Column, version: Column) -> Column:
    """(tag, resolver): the first candidate among a repository's tags, else the shortest that ends in the version's tokens."""
    from tessera.functions.text import tag_matches

    exact = F.get(F.filter(candidates, lambda c: F.array_contains(tags, c)), 0)
    loose = F.array_sort(F.transform(F.filter(tags, lambda t: tag_matches(t, version)), lambda t: F.struct(F.length(t).alias("n"), (F.array_position(tags, t)).alias("at"), t.alias("tag"))))
    fuzzy = F.get(loose, 0)["tag"]
    return F.struct(F.coalesce(exact, fuzzy).alias("tag"), F.when(exact.isNotNull(), "template").when(fuzzy.isNotNull(), "fuzzy").alias("resolver"))


def collectable(available: Column, has_pair: Column) -> Column:
    """D37."""
    return F.coalesce(available, F.lit(False)) | F.coalesce(has_pair, F.lit(False))


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def severity_rank(sev: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.lower(sev) == name, rank).otherwise(out)
    return out
