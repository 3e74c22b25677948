"""Text, identifiers and vectors as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vendors by alias, as advisories name them.
VENDOR_ALIASES = {
    "ge": "GE",
    "general electric": "GE",
    "ge vernova": "GE",
    "ge digital": "GE",
    "rockwell": "Rockwell Automation",
    "rockwell automation": "Rockwell Automation",
    "schneider": "Schneider Electric",
    "schneider electric": "Schneider Electric",
    "siemens": "Siemens",
    "siemens energy": "Siemens",
    "mitsubishi": "Mitsubishi Electric",
    "mitsubishi electric": "Mitsubishi Electric",
    "hitachi": "Hitachi Energy",
    "hitachi energy": "Hitachi Energy",
    "hitachi abb": "Hitachi Energy",
    "abb": "ABB",
    "wago": "WAGO",
    "moxa": "Moxa",
    "advantech": "Advantech",
    "honeywell": "Honeywell",
    "emerson": "Emerson",
    "yokogawa": "Yokogawa",
    "omron": "OMRON",
    "delta": "Delta Electronics",
    "delta electronics": "Delta Electronics",
    "phoenix": "Phoenix Contact",
    "phoenix contact": "Phoenix Contact",
    "codesys": "CODESYS",
    "beckhoff": "Beckhoff",
    "pilz": "Pilz",
    "ls": "LS ELECTRIC",
    "ls electric": "LS ELECTRIC",
    "lsis": "LS ELECTRIC",
}
#: Vendors by alias, as the dashboards name them.
DASHBOARD_VENDORS = {
    "rockwell": "Rockwell Automation",
    "rockwell automation": "Rockwell Automation",
    "schneider": "Schneider Electric",
    "schneider electric": "Schneider Electric",
    "mitsubishi": "Mitsubishi Electric",
    "mitsubishi electric": "Mitsubishi Electric",
    "siemens": "Siemens",
    "siemens ag": "Siemens",
    "ge": "GE",
    "general electric": "GE",
    "honeywell": "Honeywell",
    "honeywell international": "Honeywell",
}


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a small fixed table, null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def norm_vendor(raw: Column, aliases: dict[str, str] = VENDOR_ALIASES) -> Column:
    """By the whole name, else its first two words, else its first, else as it is."""
    name = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"[,.]+$", "")
    tokens = F.split(F.lower(name), r"\s+")
    return F.when(name == "", "Unknown").otherwise(F.coalesce(lookup(F.lower(name), aliases), lookup(F.array_join(F.slice(tokens, 1, 2), " "), aliases), lookup(F.get(tokens, 0), aliases), name))


def dashboard_vendor(raw: Column) -> Column:
    """S2."""
    name = strip(F.regexp_replace(strip(F.regexp_replace(F.coalesce(raw, F.lit("")), "\u200b", "")), "^,+|,+$", ""))
    return F.when(name == "", "Unknown").otherwise(F.coalesce(lookup(F.lower(name), DASHBOARD_VENDORS), name))


def vendor_key(raw: Column) -> Column:
    """S3: the first run of ASCII letters and digits."""
    return F.regexp_extract(F.lower(F.coalesce(raw, F.lit(""))), "[a-z0-9]+", 0)


def device_identity(title: Column, vendor: Column) -> Column:
    """(vendor, product): the title without the vendor before it."""
    t = strip(F.coalesce(title, F.lit("")))
    raw = F.coalesce(vendor, F.lit(""))
    known = norm_vendor(F.when(raw == "", F.get(F.split(t, r"\s+"), 0)).otherwise(raw))

    def without(prefix: Column) -> Column:
        return F.regexp_replace(F.substr(t, F.length(prefix) + 1), r"^[ :\-]+|[ :\-]+$", "")

    def starts(prefix: Column) -> Column:
        return (prefix != "") & F.startswith(F.lower(t), F.lower(prefix))

    product = strip(F.regexp_replace(F.when(starts(raw), without(raw)).when(starts(known), without(known)).otherwise(t), r"\s+", " "))
    return F.struct(known.alias("vendor"), F.when(product != "", product).when(t != "", t).otherwise("Unknown Product").alias("product"))


def slug(c: Column, most: int | None = 80) -> Column:
    """S5."""
    s = F.lower(F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z]+", "-"), "^-+|-+$", ""))
    s = F.substring(s, 1, most) if most else s
    return F.when(s == "", "x").otherwise(s)


def html_to_text(html: Column) -> Column:
    """S6 without entities: no scripts, styles or tags; white space in single spaces."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unescape_basic(c: Column) -> Column:
    """The five predefined entities; functions.udf.unescape knows all."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def parse_vector(vector: Column) -> Column:
    """A CVSS vector as a map; parts without a colon are dropped, of equal keys the last counts."""
    parts = F.filter(F.split(F.coalesce(vector, F.lit("")), "/"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), F.regexp_replace(p, "^[^:]*:", "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def mentions(text: Column, names: dict[str, str]) -> Column:
    """The distinct keys of names that stand in a text, not within a longer word; longer names win."""
    pattern = "(?<![A-Za-z0-9])(" + "|".join(re.escape(n).replace("/", "\\/") for n in sorted(names, key=len, reverse=True)) + ")(?![A-Za-z0-9])"
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: lookup(n, names)))


def ids(text: Column, kind: str) -> Column:
    """The sorted distinct CVE or CWE ids of a text."""
    pattern = {"cve": r"CVE-\d{4}-\d{4,7}", "cwe": r"CWE-\d+"}[kind]
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))))


#: Fixed value: a vendor's label and the words that end it in an advisory's text, whose white space is single spaces.
VENDOR_LABEL = r"Vendor:\s*([A-Za-z0-9 &.,\-/]+?)(?:\s+(?:Equipment|Product|Report|CVSS|Affected))"


def vendor_label(text: Column, title: Column) -> Column:
    """What stands between a vendor label and the next label, else the title's first word."""
    label = strip(F.regexp_extract(F.coalesce(text, F.lit("")), VENDOR_LABEL, 1))
    first = F.get(F.split(strip(F.coalesce(title, F.lit(""))), r"\s+"), 0)
    return F.when(label != "", label).otherwise(F.coalesce(first, F.lit("")))


def snippet(text: Column, markers: list[str], most: int = 9000) -> Column:
    """Up to `most` characters from the earliest marker on; the text's start if it has none."""
    first = F.least(*(F.nullif(F.instr(text, m), F.lit(0)) for m in markers), F.lit(None).cast("int"))
    return F.substr(text, F.coalesce(first, F.lit(1)), F.lit(most))


def parse_cpe(cpe: Column) -> Column:
    """(vendor, product, version) of a CPE 2.3 name; null for anything else."""
    parts = F.split(cpe, ":")
    return F.when(cpe.rlike("^cpe:2\\.3:[aoh]:[^:]*:[^:]*:[^:]*"), F.struct(F.get(parts, 3).alias("vendor"), F.get(parts, 4).alias("product"), F.get(parts, 5).alias("version")))


def build_cpe(vendor: Column, product: Column, version: Column) -> Column:
    """S15."""
    return F.format_string("cpe:2.3:a:%s:%s:%s:*:*:*:*:*:*:*", vendor, product, F.coalesce(version, F.lit("*")))


def parse_purl(purl: Column) -> Column:
    """(base, version) at the last @; the base in lower case."""
    has = F.contains(purl, F.lit("@"))
    version = F.substring_index(purl, "@", -1)
    return F.struct(F.lower(F.when(has, F.substr(purl, F.lit(1), F.length(purl) - F.length(version) - 1)).otherwise(purl)).alias("base"), F.when(has, version).alias("version"))


def cwe_label(number: Column) -> Column:
    """S16."""
    return F.concat(F.lit("CWE-"), number.cast("string"))


def cwe_numbers(label: Column) -> Column:
    """All numbers of a list of CWEs."""
    return F.transform(F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(r"CWE-(\d+)"), F.lit(1)), lambda n: n.cast("int"))


def year_of(cve: Column) -> Column:
    """The year of a CVE id, null if it isn't a number."""
    y = F.get(F.split(cve, "-"), 1)
    return F.when(y.rlike(r"^\d+$"), y.try_cast("int"))


def advisory_year(advisory: Column) -> Column:
    """The year of an advisory id with a two-digit one."""
    return F.lit(2000) + F.nullif(F.regexp_extract(advisory, r"-(\d{2})-", 1), F.lit("")).try_cast("int")


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark before white space; trimmed."""
    return F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


def commit_of(url: Column) -> Column:
    """(repository, commit) of a commit's address, null for another."""
    repo, sha = F.regexp_extract(url, r"github\.com/([^/]+/[^/]+)/commit/", 1), F.regexp_extract(url, r"/commit/([0-9a-f]{7,40})", 1)
    return F.when((repo != "") & (sha != ""), F.struct(repo.alias("repo"), sha.alias("sha")))


def from_patch(patch: Column, most: int = 1200) -> Column:
    """(before, after) of a unified diff's lines; null where they are equal or empty."""
    lines = F.filter(F.split(patch, "\n"), lambda x: ~F.startswith(x, F.lit("@@")) & ~F.startswith(x, F.lit("---")) & ~F.startswith(x, F.lit("+++")))

    def side(sign: str) -> Column:
        kept = F.filter(lines, lambda x: F.startswith(x, F.lit(" ")) | F.startswith(x, F.lit(sign)))
        return F.substring(F.array_join(F.transform(kept, lambda x: F.substr(x, F.lit(2))), "\n"), 1, most)

    before, after = side("-"), side("+")
    return F.when((F.trim(before) != "") & (F.trim(after) != "") & (before != after), F.struct(before.alias("before"), after.alias("after")))


def tag_candidates(version: Column, templates: list[str]) -> Column:
    """Tags that a version may have, each once, in the order of the templates."""
    major = F.get(F.split(version, r"\."), 0)
    made = [F.replace(F.replace(F.replace(F.replace(F.lit(t), F.lit("{v}"), version), F.lit("{u}"), F.replace(version, F.lit("."), F.lit("_"))), F.lit("{d}"), F.replace(version, F.lit("."), F.lit("-"))), F.lit("{maj}"), major) for t in templates]
    return F.array_distinct(F.array(*made))


def version_tokens(version: Column) -> Column:
    """S25."""
    return F.regexp_extract_all(F.lower(version), F.lit(r"(\d+|[a-z]+)"), F.lit(1))


def tag_matches(tag: Column, version: Column) -> Column:
    """Whether a tag's last tokens are the version's."""
    want, have = version_tokens(version), version_tokens(tag)
    return (F.size(want) > 0) & (F.size(have) >= F.size(want)) & (F.slice(have, F.greatest(F.size(have) - F.size(want) + 1, F.lit(1)), F.greatest(F.size(want), F.lit(1))) == want)


def version_numbers(version: Column) -> Column:
    """SO13: a version's numbers, which compare in order."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))


def url_has(url: Column, keywords: list[str]) -> Column:
    """S26."""
    return F.lower(url).rlike("|".join(re.escape(k) for k in keywords))


def html_escape(c: Column) -> Column:
    """S27."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def score_label(score: Column) -> Column:
    """A score with its grade."""
    from tessera.functions.decide import severity_grade

    return F.when(score.isNull(), "").otherwise(F.concat(F.format_string("%.1f", score), F.lit(" ("), severity_grade(score), F.lit(")")))


def json_in(text: Column, schema: str) -> Column:
    """The JSON object within free text, null if there is none that parses."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def coerce_status(text: Column) -> Column:
    """The status that free text names."""
    u = F.upper(F.coalesce(text, F.lit("")))
    return F.when(F.contains(u, F.lit("LIKELY_AFFECTED")), "LIKELY_AFFECTED").when(F.contains(u, F.lit("NOT_AFFECTED")), "LIKELY_NOT_AFFECTED").otherwise("UNDER_INVESTIGATION")


def perturb(code: Column, key: Column) -> Column:
    """One of four changes to a code text that keep its meaning, chosen by a hash."""
    from tessera.functions.hashing import hash_mod

    k = hash_mod(["perturb", key], 4)
    return F.when(k == 0, F.concat(F.lit("// checked\n"), code)).when(k == 1, F.concat(code, F.lit("\n"))).when(k == 2, F.regexp_replace(code, r"(?m)^(?=.*\S)", "  ")).otherwise(F.regexp_replace(code, r"\bbuf\b", "buffer"))


def product_tokens(name: Column, stop_words: list[str]) -> Column:
    """The words of a name that aren't stop words: of three characters at least with a digit, of five without."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(tokens, lambda t: ~t.isin(stop_words) & (F.length(t) >= F.when(t.rlike("[0-9]"), 3).otherwise(5)))


def evidence_block(lines: list[Column]) -> Column:
    """The lines that aren't null, one below the other."""
    return F.concat_ws("\n", *lines)
