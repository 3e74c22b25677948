"""Text functions over pages, documents, conversations and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.udf import unescape
from tessera.plans.base import Book, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

_STRIP = r"regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"
_TEXT = rf"trim(regexp_replace({_STRIP}, '\s+', ' ', 'g'))"


@BOOK.add("html_to_text", f"SELECT page_id, {_TEXT} AS body, CAST(length({_TEXT}) AS BIGINT) AS n_chars FROM pages")
def html_to_text(spark, sf_dir):
    body = T.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body"), F.length(body).cast("bigint").alias("n_chars"))


@BOOK.add(
    "html_unescaped",
    r"""
    WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(b, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '"'), '&amp;?', '&', 'g')) AS body FROM t
    """,
)
def html_unescaped(spark, sf_dir):
    """With all entities; the oracle knows those of the table's pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip(unescape(T.html_to_text(F.col("html")))).alias("body"))


@BOOK.add(
    "page_title_and_host",
    r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, CAST(length(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs, html LIKE '%<article>%' AS has_article FROM pages",
)
def page_title_and_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"), F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).cast("bigint").alias("n_paragraphs"), F.contains("html", F.lit("<article>")).alias("has_article"))


@BOOK.add(
    "sentence_dedupe",
    r"""
    WITH s AS (SELECT doc_id, lang, u.ord, trim(u.s, chr(9) || chr(10) || chr(13) || ' ') AS s FROM documents, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) WITH ORDINALITY u(s, ord)),
    k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, ord) AS n FROM s WHERE length(s) BETWEEN 40 AND 600)
    SELECT lang, CAST(count(*) AS BIGINT) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM k WHERE n = 1 GROUP BY 1
    """,
)
def sentence_dedupe(spark, sf_dir):
    """S21, PF14, W2: sentences of 40 to 600 characters, each where it first occurs; counted by language."""
    s = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(T.sentences(F.col("text"))).alias("ord", "s")).filter(F.length("s").between(40, 600))
    first = s.groupBy(F.sha2("s", 256).alias("h")).agg(F.min(F.struct("doc_id", "ord", "lang", F.length("s").alias("n"))).alias("x"))
    return first.groupBy(F.col("x.lang").alias("lang")).agg(F.count("*").alias("n_sentences"), F.sum("x.n").alias("n_chars"))


@BOOK.add(
    "slugs",
    "SELECT p_partkey, CASE WHEN s = '' THEN 'x' ELSE s END AS slug FROM (SELECT p_partkey, left(lower(regexp_replace(regexp_replace(p_name || ' / ' || p_brand || '!', '[^0-9A-Za-z]+', '-', 'g'), '^-+|-+$', '', 'g')), 80) AS s FROM part)",
)
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug"))


_RAW = "CASE s_suppkey % 6 WHEN 0 THEN ' Siemens, ' WHEN 1 THEN 'GE Vernova' WHEN 2 THEN 'Delta Industrial Works.' WHEN 3 THEN '' WHEN 4 THEN s_name ELSE 'schneider electric SE' END"


@BOOK.add(
    "vendor_normalise",
    f"""
    WITH r AS (SELECT s_suppkey, regexp_replace(trim({_RAW}), '[,.]+$', '') AS v FROM supplier), a(k, name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.VENDOR_ALIASES.items())}),
    t AS (SELECT *, string_split(lower(v), ' ') AS w FROM r)
    SELECT s_suppkey, CASE WHEN v = '' THEN 'Unknown' ELSE coalesce((SELECT name FROM a WHERE k = lower(v)), (SELECT name FROM a WHERE k = array_to_string(w[1:2], ' ')), (SELECT name FROM a WHERE k = w[1]), v) END AS vendor FROM t
    """,
)
def vendor_normalise(spark, sf_dir):
    k = F.col("s_suppkey") % 6
    raw = F.when(k == 0, " Siemens, ").when(k == 1, "GE Vernova").when(k == 2, "Delta Industrial Works.").when(k == 3, "").when(k == 4, F.col("s_name")).otherwise("schneider electric SE")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.norm_vendor(raw).alias("vendor"))


@BOOK.add(
    "cvss_vector_parse",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE substr('NALP', CAST(p_size % 4 AS INTEGER) + 1, 1) END AS av, CASE WHEN p_size % 2 = 0 THEN 'H' ELSE 'L' END AS ac, '3.1' AS version FROM part",
)
def cvss_vector_parse(spark, sf_dir):
    s = F.col("p_size")
    av = F.when(s % 5 != 0, F.concat(F.lit("AV:"), F.substr(F.lit("NALP"), s % 4 + 1, F.lit(1)), F.lit("/"))).otherwise("")
    vector = F.concat(F.lit("CVSS:3.1/junk/AC:X/"), av, F.lit("AC:"), F.when(s % 2 == 0, "H").otherwise("L"))
    m = table(spark, sf_dir, "part").select("p_partkey", T.parse_vector(vector).alias("m"))
    return m.select("p_partkey", F.try_element_at("m", F.lit("AV")).alias("av"), F.try_element_at("m", F.lit("AC")).alias("ac"), F.try_element_at("m", F.lit("CVSS")).alias("version"))


@BOOK.add(
    "cpe_and_purl_parse",
    "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN 'acme' END AS vendor, CASE WHEN p_size % 7 <> 0 THEN replace(p_name, ' ', '_') END AS product, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS version, 'pkg:npm/@acme/' || lower(replace(p_name, ' ', '-')) AS base, p_size || '.0' AS purl_version FROM part",
)
def cpe_and_purl_parse(spark, sf_dir):
    product = F.replace("p_name", F.lit(" "), F.lit("_"))
    cpe = F.when(F.col("p_size") % 7 != 0, T.build_cpe(F.lit("acme"), product, F.col("p_size").cast("string"))).otherwise("not a cpe")
    purl = F.concat(F.lit("pkg:npm/@Acme/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@"), F.col("p_size").cast("string"), F.lit(".0"))
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_cpe(cpe).alias("c"), T.parse_purl(purl).alias("u")).select("p_partkey", "c.vendor", "c.product", "c.version", F.col("u.base").alias("base"), F.col("u.version").alias("purl_version"))


@BOOK.add(
    "id_extraction",
    r"SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all('see CVE-2024-' || (1000 + event_id % 90) || ' and CVE-2023-12345, CWE-' || user_id || ', CVE-2023-12345', 'CVE-\d{4}-\d{4,7}'))), ';') AS cves, CAST(user_id AS INTEGER) AS cwe, CAST(2024 AS INTEGER) AS y FROM events",
)
def id_extraction(spark, sf_dir):
    cve = F.concat(F.lit("CVE-2024-"), (F.col("event_id") % 90 + 1000).cast("string"))
    t = F.concat(F.lit("see "), cve, F.lit(" and CVE-2023-12345, CWE-"), F.col("user_id").cast("string"), F.lit(", CVE-2023-12345"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.ids(t, "cve"), ";").alias("cves"), F.get(T.cwe_numbers(t), 0).alias("cwe"), T.year_of(cve).alias("y"))


@BOOK.add(
    "name_mentions",
    r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w IN ('idiot', 'clown', 'trash')))), ';') AS found FROM documents",
)
def name_mentions(spark, sf_dir):
    names = {"idiot": "idiot", "clown": "clown", "trash": "trash"}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.mentions(F.col("text"), names)), ";").alias("found"))


@BOOK.add(
    "context_window",
    """
    WITH m AS (SELECT conv_id, turn, text, instr(text, '.') AS dot FROM conversations)
    SELECT conv_id, turn, CASE WHEN dot > 0 THEN substr(text, greatest(1, dot - 70), least(70, dot - 1)) END AS before, CASE WHEN dot > 0 THEN substr(text, dot + 1, 80) END AS after FROM m
    """,
)
def context_window(spark, sf_dir):
    at = F.instr("text", ".")
    before = F.when(at > 0, F.substr("text", F.greatest(F.lit(1), at - 70), F.least(F.lit(70), at - 1)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("before"), F.when(at > 0, F.substr("text", at + 1, F.lit(80))).alias("after"))


@BOOK.add("snippet_from_marker", "SELECT doc_id, substr(text, greatest(1, coalesce(least(nullif(instr(text, ' the '), 0), nullif(instr(text, ' de '), 0)), 1)), 200) AS snippet FROM documents")
def snippet_from_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), [" the ", " de "], 200).alias("snippet"))


@BOOK.add("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k >= 50")


@BOOK.add("property_bag", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, 'none' AS missing FROM orders")
def property_bag(spark, sf_dir):
    bag = F.array(F.struct(F.lit("status").alias("name"), F.lit("old").alias("value")), F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")))

    def value(name):
        return F.try_element_at(F.transform(F.filter("bag", lambda p: p["name"] == name), lambda p: p["value"]), F.lit(-1))

    return table(spark, sf_dir, "orders").withColumn("bag", bag).select("o_orderkey", value("status").alias("status"), value("priority").alias("priority"), F.coalesce(value("missing"), F.lit("none")).alias("missing"))


@BOOK.add(
    "diff_sides",
    """
    WITH d AS (SELECT p_partkey, 'int a = ' || p_size || ';' AS b, 'int a = ' || (p_size % 10) || ';' AS n FROM part)
    SELECT p_partkey, CASE WHEN b <> n THEN 'void f() {' || chr(10) || b || chr(10) || '}' END AS before, CASE WHEN b <> n THEN 'void f() {' || chr(10) || n || chr(10) || '}' END AS after FROM d
    """,
)
def diff_sides(spark, sf_dir):
    s = F.col("p_size")
    patch = F.concat(F.lit("--- a/x.c\n+++ b/x.c\n@@ -1,3 +1,3 @@\n void f() {\n-int a = "), s.cast("string"), F.lit(";\n+int a = "), (s % 10).cast("string"), F.lit(";\n }"))
    return table(spark, sf_dir, "part").select("p_partkey", T.from_patch(patch).alias("p")).select("p_partkey", "p.before", "p.after")


@BOOK.add("length_filter", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) BETWEEN 40 AND 600")
def length_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n")).filter(F.col("n").between(40, 600))


@BOOK.add("json_in_text", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS status FROM events""")
def json_in_text(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, "no object here").otherwise(F.concat(F.lit('Sure: {"status": "'), "event_type", F.lit('", "note": "x"} done')))
    return table(spark, sf_dir, "events").select("event_id", T.json_in(t, "status string, note string")["status"].alias("status"))


@BOOK.add("version_tags", "SELECT p_partkey, 'v' || p_size || '.1' || ';' || 'rel_' || p_size || '_1' AS tags, true AS fits FROM part")
def version_tags(spark, sf_dir):
    v = F.concat(F.col("p_size").cast("string"), F.lit(".1"))
    tags = T.tag_candidates(v, ["v{v}", "rel_{u}", "v{v}"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, ";").alias("tags"), T.tag_matches(F.get(tags, 1), v).alias("fits"))


@BOOK.add(
    "uuid_and_digest",
    """
    WITH d AS (SELECT c_custkey, c_name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)
    SELECT c_custkey, sha256(c_name) AS digest, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM d
    """,
)
def uuid_and_digest(spark, sf_dir):
    from tessera.functions.hashing import uuid5

    u = uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"), u.alias("uuid"))
