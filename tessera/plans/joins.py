"""Joins, set operations, filters, sorts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import match, rollup
from tessera.plans.base import Book, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def _orders(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_DRILL = "SELECT o_orderkey, c_name, n_name, o_totalprice FROM {0} WHERE {1} ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 400"


def _drill(spark, sf_dir, dim, value, scope=None):
    dims = {"segment": F.col("c_mktsegment"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "nation": F.array("n_name")}
    rows = rollup.drill_down(_orders(spark, sf_dir), dims, dim, value)
    rows = rows.filter(F.col("o_orderstatus") == scope) if scope else rows
    return rows.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(400).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@BOOK.add("drilldown_segment", _DRILL.format(_ORDERS, "c_mktsegment = (SELECT min(c_mktsegment) FROM customer)"))
def drilldown_segment(spark, sf_dir):
    return _drill(spark, sf_dir, "segment", table(spark, sf_dir, "customer").agg(F.min("c_mktsegment")).scalar())


@BOOK.add("drilldown_status", _DRILL.format(_ORDERS, "o_orderstatus = 'P'"))
def drilldown_status(spark, sf_dir):
    return _drill(spark, sf_dir, "status", "P")


@BOOK.add("drilldown_priority_scoped", _DRILL.format(_ORDERS, "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"))
def drilldown_priority_scoped(spark, sf_dir):
    return _drill(spark, sf_dir, "priority", "1-URGENT", "F")


@BOOK.add("drilldown_year", _DRILL.format(_ORDERS, "CAST(year(o_orderdate) AS VARCHAR) = '1995'"))
def drilldown_year(spark, sf_dir):
    return _drill(spark, sf_dir, "year", "1995")


@BOOK.add("drilldown_member", _DRILL.format(_ORDERS, "list_contains([n_name], (SELECT min(n_name) FROM nation))"))
def drilldown_member(spark, sf_dir):
    return _drill(spark, sf_dir, "nation", table(spark, sf_dir, "nation").agg(F.min("n_name")).scalar())


@BOOK.add("drilldown_unknown", _DRILL.format(_ORDERS, "false"))
def drilldown_unknown(spark, sf_dir):
    return _drill(spark, sf_dir, "no such dimension", "x")


@BOOK.add(
    "search_substring",
    "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '1') OR contains(lower(p_type), '1') OR contains(CAST(p_size AS VARCHAR), '1') ORDER BY p_retailprice DESC, p_partkey LIMIT 100",
)
def search_substring(spark, sf_dir):
    return rollup.search(table(spark, sf_dir, "part"), "1", ["p_name", "p_brand", "p_type", "p_size"]).orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_partkey", "p_name", "p_brand")


@BOOK.add("pagination", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 300")
def pagination(spark, sf_dir):
    return rollup.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 4, 100)


@BOOK.add("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE upper(c_name) = (SELECT upper(min(c_name)) FROM customer)")
def point_lookup(spark, sf_dir):
    key = table(spark, sf_dir, "customer").agg(F.upper(F.min("c_name"))).scalar()
    return table(spark, sf_dir, "customer").filter(F.upper("c_name") == key).select("c_custkey", "c_name")


@BOOK.add("filters_and_gates", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus <> 'O' AND l_quantity BETWEEN 40 AND 50 AND l_discount >= 0.07")
def filters_and_gates(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").filter(c("l_returnflag").isin("A", "R") & (c("l_linestatus") != "O") & c("l_quantity").between(40, 50) & (c("l_discount") >= 0.07)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


@BOOK.add("anti_join_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join_customers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@BOOK.add("semi_join_flag", "SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_discount >= 0.1) AS has_pair FROM supplier")
def semi_join_flag(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("has_pair", F.lit(True))
    return table(spark, sf_dir, "supplier").join(pairs, "s_suppkey", "left").select("s_suppkey", F.coalesce("has_pair", F.lit(False)).alias("has_pair"))


@BOOK.add(
    "left_join_default",
    "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, n_name, 'unknown') AS region FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey",
)
def left_join_default(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").filter("n_nationkey < 20"), table(spark, sf_dir, "region").filter("r_regionkey < 3")
    j = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", "n_name", F.lit("unknown")).alias("region"))


@BOOK.add(
    "full_outer_sets",
    """
    WITH g AS (SELECT DISTINCT s_nationkey AS nat, s_suppkey % 50 AS item FROM supplier), w AS (SELECT DISTINCT c_nationkey AS nat, c_custkey % 50 AS item FROM customer WHERE c_acctbal > 5000)
    SELECT coalesce(g.nat, w.nat) AS nat, CAST(count(*) FILTER (g.item IS NOT NULL AND w.item IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (w.item IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (g.item IS NULL) AS BIGINT) AS fn
    FROM g FULL JOIN w ON g.nat = w.nat AND g.item = w.item GROUP BY 1
    """,
)
def full_outer_sets(spark, sf_dir):
    got = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nat"), (F.col("s_suppkey") % 50).alias("item"))
    want = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("nat"), (F.col("c_custkey") % 50).alias("item"))
    return match.compare_sets(got, want, ["nat"], "item")


@BOOK.add(
    "set_operations",
    """
    WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30)
    SELECT CAST((SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM r)) AS BIGINT) AS in_both, CAST((SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM r)) AS BIGINT) AS only_a,
           CAST((SELECT count(*) FROM (SELECT k FROM r EXCEPT SELECT k FROM a)) AS BIGINT) AS only_r, CAST((SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM r)) AS BIGINT) AS in_any
    """,
)
def set_operations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    flags = l.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)).alias("r"))
    a, r = F.col("a"), F.col("r")
    return flags.agg(F.count_if(a & r).alias("in_both"), F.count_if(a & ~r).alias("only_a"), F.count_if(r & ~a).alias("only_r"), F.count_if(a | r).alias("in_any"))


@BOOK.add(
    "union_distinct_ids",
    "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT o_orderkey FROM orders",
)
def union_distinct_ids(spark, sf_dir):
    l, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    return l.select(F.col("l_partkey").alias("k")).union(p.select("p_partkey")).union(o.select("o_orderkey")).distinct()


@BOOK.add(
    "version_or_union",
    """
    WITH cat AS (SELECT p_brand AS comp, p_size AS ver, p_type AS item, min(p_partkey) AS pos FROM part WHERE p_size % 3 <> 0 GROUP BY 1, 2, 3),
    comp AS (SELECT DISTINCT p_brand AS comp, p_size AS ver FROM part),
    m AS (SELECT c.*, EXISTS (SELECT 1 FROM cat WHERE cat.comp = c.comp AND cat.ver = c.ver) AS pinned FROM comp c),
    u AS (SELECT comp, item, min(pos) AS pos FROM cat GROUP BY 1, 2)
    SELECT m.comp, m.ver, pinned, cat.item, cat.pos FROM m JOIN cat ON m.pinned AND cat.comp = m.comp AND cat.ver = m.ver
    UNION ALL SELECT m.comp, m.ver, pinned, u.item, u.pos FROM m JOIN u ON NOT m.pinned AND u.comp = m.comp
    """,
)
def version_or_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    catalog = p.filter("p_size % 3 <> 0").groupBy(F.col("p_brand").alias("comp"), F.col("p_size").alias("ver"), F.col("p_type").alias("item")).agg(F.min("p_partkey").alias("pos"))
    components = p.select(F.col("p_brand").alias("comp"), F.col("p_size").alias("ver")).distinct()
    return match.version_or_all(components, catalog, "comp", "ver", "item", "pos").select("comp", "ver", "pinned", "item", "pos")


@BOOK.add(
    "prioritised_coalesce",
    """
    WITH q AS (SELECT l_partkey AS p, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1), s AS (SELECT l_partkey AS p, max(l_extendedprice) AS v FROM lineitem WHERE l_discount > 0.09 GROUP BY 1)
    SELECT p_partkey, coalesce(q.v, s.v, p_retailprice) AS price, CASE WHEN q.v IS NOT NULL THEN 'returned' WHEN s.v IS NOT NULL THEN 'discounted' ELSE 'list' END AS method
    FROM part LEFT JOIN q ON q.p = p_partkey LEFT JOIN s ON s.p = p_partkey
    """,
)
def prioritised_coalesce(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")  # noqa: E741

    def side(where):
        return l.filter(where).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("price"))

    sides = [("returned", side("l_returnflag = 'R' AND l_quantity > 48"), ["p_partkey"]), ("discounted", side("l_discount > 0.09"), ["p_partkey"]), ("list", p.select("p_partkey", F.col("p_retailprice").alias("price")), ["p_partkey"])]
    return match.prioritised(p.select("p_partkey"), sides, "price")


@BOOK.add(
    "embedded_union_anti",
    """
    WITH m AS (SELECT o_custkey AS k, o_orderkey AS item, 'matched' AS leg FROM orders WHERE o_orderpriority = '1-URGENT'), e AS (SELECT o_custkey AS k, o_orderkey AS item, 'embedded' AS leg FROM orders WHERE o_orderstatus = 'P')
    SELECT * FROM m UNION ALL SELECT * FROM e WHERE k NOT IN (SELECT k FROM m)
    """,
)
def embedded_union_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), "o_orderpriority", "o_orderstatus")
    m = o.filter("o_orderpriority = '1-URGENT'").select("k", "item", F.lit("matched").alias("leg"))
    e = o.filter("o_orderstatus = 'P'").select("k", "item", F.lit("embedded").alias("leg"))
    return match.embedded_or_rest(m, e, ["k"])


@BOOK.add(
    "inverted_index",
    "SELECT u.w AS word, CAST(count(DISTINCT p_partkey) AS BIGINT) AS n_parts, min(p_partkey) AS first_part FROM part, unnest(string_split(p_name, ' ')) u(w) GROUP BY 1",
)
def inverted_index(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count_distinct("p_partkey").alias("n_parts"), F.min("p_partkey").alias("first_part"))


@BOOK.add(
    "related_assets",
    """
    WITH adv AS (SELECT n_nationkey AS advisory, p_size AS cve FROM nation JOIN part ON p_partkey % 25 = n_nationkey),
    ast AS (SELECT s_suppkey AS asset, s_nationkey AS advisory, CAST(s_suppkey % 50 + 1 AS INTEGER) AS cve FROM supplier),
    b AS (SELECT advisory, asset, NULL AS cve, true AS exact FROM ast WHERE advisory IN (SELECT advisory FROM adv) UNION ALL SELECT adv.advisory, ast.asset, adv.cve, false FROM adv JOIN ast ON adv.cve = ast.cve)
    SELECT advisory, asset, bool_or(exact) AS exact, CAST(count(DISTINCT cve) AS BIGINT) AS n_cves FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY advisory ORDER BY bool_or(exact) DESC, count(DISTINCT cve) DESC, asset) <= 150
    """,
)
def related_assets(spark, sf_dir):
    adv = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "part"), F.col("p_partkey") % 25 == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("advisory")).agg(F.collect_set(F.col("p_size").cast("string")).alias("cves"))
    ast = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.array("s_nationkey").alias("advisories"), F.array((F.col("s_suppkey") % 50 + 1).cast("string")).alias("cves"))
    return match.related(adv, ast).select("advisory", "asset", "exact", F.size("cves").cast("bigint").alias("n_cves"))


@BOOK.add("fuzzy_match")
def fuzzy_match(spark, sf_dir):
    """All part names with their types against all brands and types; Ratcliff-Obershelp has no SQL form."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.concat_ws(" ", "p_type", "p_name").alias("name"))
    known = p.select(F.concat_ws(" ", "p_type", "p_brand").alias("known"))
    return match.fuzzy(names, "name", known, "known")


@BOOK.add(
    "latest_version",
    "SELECT p_brand, arg_max(ver, k) AS ver FROM (SELECT p_brand, (p_size % 12) || '.' || p_size || '.0' AS ver, [p_size % 12, p_size, 0] AS k FROM part) GROUP BY 1",
)
def latest_version(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_brand", F.concat((F.col("p_size") % 12).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit(".0")).alias("ver"))
    return match.latest_version(v, "p_brand", "ver")


@BOOK.add(
    "schema_diff",
    """
    WITH c AS (SELECT table_name AS t, column_name AS field FROM information_schema.columns WHERE table_name IN ('documents', 'benchmark'))
    SELECT field, CASE WHEN count(DISTINCT t) = 2 THEN 'both' WHEN min(t) = 'documents' THEN 'left' ELSE 'right' END AS side FROM c GROUP BY 1
    """,
)
def schema_diff(spark, sf_dir):
    """ST7: fields that two tables have in common or alone."""
    a, b = table(spark, sf_dir, "documents").schema.fieldNames(), table(spark, sf_dir, "benchmark").schema.fieldNames()
    rows = [(f, "both" if f in b else "left") for f in a] + [(f, "right") for f in b if f not in a]
    return spark.createDataFrame(rows, "field string, side string")


@BOOK.add("multi_key_sort", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_returnflag DESC, l_discount DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 400")
def multi_key_sort(spark, sf_dir):
    order = [F.desc("l_returnflag"), F.desc("l_discount"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    return table(spark, sf_dir, "lineitem").orderBy(*order).limit(400).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@BOOK.add("ids_descending", "SELECT c_custkey, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR) DESC) AS place FROM customer ORDER BY CAST(c_custkey AS VARCHAR) DESC LIMIT 300")
def ids_descending(spark, sf_dir):
    """SO10: the first of all ids in descending order as strings, with their places."""
    first = table(spark, sf_dir, "customer").select("c_custkey").orderBy(F.desc(F.col("c_custkey").cast("string"))).limit(300)
    return first.withColumn("place", F.expr("row_number() OVER (ORDER BY CAST(c_custkey AS STRING) DESC)").cast("bigint"))


@BOOK.add("override_overlay", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'fixed' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 20 = 0 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def override_overlay(spark, sf_dir):
    from tessera.functions.decide import overlay

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    saved = o.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("fixed").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 20 == 0, "x").alias("o_orderpriority")).dropDuplicates(["o_orderkey"])
    return overlay(o, saved, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
