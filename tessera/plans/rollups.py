"""Rollups: worst case, counters, modes, first and last wins, sets, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rollup
from tessera.plans.base import Book, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
RANK_SQL = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END"


def _rank():
    return F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)


@BOOK.add(
    "worst_case_rollup",
    f"""
    WITH worst AS (
      SELECT user_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {RANK_SQL} DESC, event_id) AS n FROM events)
      WHERE n = 1)
    SELECT event_type AS worst_type, CAST(count(*) AS BIGINT) AS n_users FROM worst GROUP BY 1
    """,
)
def worst_case_rollup(spark, sf_dir):
    worst = rollup.worst_case(table(spark, sf_dir, "events"), ["user_id"], _rank(), "event_id", ["event_type"])
    return worst.groupBy(F.col("event_type").alias("worst_type")).agg(F.count("*").alias("n_users"))


@BOOK.add("worst_case_rows", f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {RANK_SQL} DESC, event_id) AS n FROM events) WHERE n = 1")
def worst_case_rows(spark, sf_dir):
    return rollup.worst_case(table(spark, sf_dir, "events"), ["user_id"], _rank(), "event_id", ["event_id", "event_type"])


@BOOK.add(
    "status_counters",
    """
    SELECT 'l_returnflag' AS dim, l_returnflag AS value, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linestatus', l_linestatus, CAST(count(*) AS BIGINT) FROM lineitem GROUP BY 2
    """,
)
def status_counters(spark, sf_dir):
    return rollup.counters(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@BOOK.add(
    "class_pivot",
    """
    SELECT c_mktsegment, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS n_o,
           CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS n_p, CAST(count(o_orderkey) AS BIGINT) AS total
    FROM (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) o USING (c_mktsegment) GROUP BY 1
    """,
)
def class_pivot(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    joined = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rollup.pivot_counts(joined, "c_mktsegment", "o_orderstatus", ["F", "O", "P"], customer.select("c_mktsegment").distinct())


@BOOK.add(
    "top_keys_by_class",
    """
    SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS n_a, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS n_n,
           CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_r, CAST(count(*) AS BIGINT) AS total
    FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 20
    """,
)
def top_keys_by_class(spark, sf_dir):
    return rollup.pivot_counts(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"]).orderBy(F.desc("total"), "l_suppkey").limit(20)


@BOOK.add(
    "max_severity",
    """
    WITH r AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END AS rnk FROM orders)
    SELECT o_custkey, CASE max(rnk) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'unrated' END AS severity FROM r GROUP BY 1
    """,
)
def max_severity(spark, sf_dir):
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 3).when(p == "3-MEDIUM", 2).when(p == "5-LOW", 1).otherwise(0)
    m = F.max("rnk")
    name = F.when(m == 4, "critical").when(m == 3, "high").when(m == 2, "medium").when(m == 1, "low").otherwise("unrated")
    return table(spark, sf_dir, "orders").select("o_custkey", rank.alias("rnk")).groupBy("o_custkey").agg(name.alias("severity"))


@BOOK.add(
    "mode_first_seen",
    """
    WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1
    """,
)
def mode_first_seen(spark, sf_dir):
    return rollup.mode_first(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@BOOK.add(
    "first_last_wins_merge",
    """
    SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS first_type, arg_max(value, event_id) AS last_value,
           CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types
    FROM events GROUP BY 1
    """,
)
def first_last_wins_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("kept", F.when(F.col("event_type") != "view", F.col("event_type")))
    return e.groupBy("user_id").agg(rollup.first_wins("kept", "event_id").alias("first_type"), rollup.last_wins("value", "event_id").alias("last_value"), F.count("*").alias("n"), rollup.joined_set("event_type").alias("types"))


@BOOK.add(
    "set_valued_rollup",
    """
    SELECT n_name, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS n_suppliers, string_agg(DISTINCT CAST(year(l_shipdate) AS VARCHAR), ';' ORDER BY CAST(year(l_shipdate) AS VARCHAR)) AS ship_years,
           CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_returned
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
    """,
)
def set_valued_rollup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), "l_returnflag")  # noqa: E741
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.count_distinct("s_suppkey").alias("n_suppliers"), rollup.joined_set("y").alias("ship_years"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))


@BOOK.add(
    "bool_any",
    "SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS any_urgent, bool_or(o_orderstatus = 'P') AS any_pending FROM orders GROUP BY 1",
)
def bool_any(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"))


@BOOK.add(
    "multi_agg_candidates",
    """
    WITH c AS (
      SELECT o_custkey AS custkey, CAST(count(*) AS BIGINT) AS n_lines, bool_or(o_orderpriority = '1-URGENT') AS urgent,
             max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS flag_rank, max(l_discount) AS max_discount, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_suppliers
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT *, round(CASE WHEN urgent THEN 100 ELSE 0 END + 20 * flag_rank + 4 * n_suppliers + max_discount, 4) AS score FROM c ORDER BY score DESC, custkey LIMIT 50
    """,
)
def multi_agg_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_orderpriority")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount", "l_suppkey")  # noqa: E741
    flag = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    c = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("custkey").agg(F.count("*").alias("n_lines"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max(flag).alias("flag_rank"), F.max("l_discount").alias("max_discount"), F.count_distinct("l_suppkey").alias("n_suppliers"))
    score = F.round(F.when(F.col("urgent"), 100).otherwise(0) + 20 * F.col("flag_rank") + 4 * F.col("n_suppliers") + F.col("max_discount"), 4)
    return c.withColumn("score", score).orderBy(F.desc("score"), "custkey").limit(50)


@BOOK.add(
    "two_level_rollup",
    """
    WITH k AS (SELECT o_custkey, max(CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS r FROM orders GROUP BY 1)
    SELECT CASE r WHEN 3 THEN 'P' WHEN 2 THEN 'O' ELSE 'F' END AS worst, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM k GROUP BY r
    """,
)
def two_level_rollup(spark, sf_dir):
    s = F.col("o_orderstatus")
    k = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(s == "P", 3).when(s == "O", 2).otherwise(1)).alias("r"))
    by = k.groupBy(F.when(F.col("r") == 3, "P").when(F.col("r") == 2, "O").otherwise("F").alias("worst")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total), F.lit(True))


@BOOK.add("year_histogram", "SELECT year(o_orderdate) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY 1")
def year_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count("*").alias("n")).orderBy("y")


@BOOK.add(
    "top_vendors",
    "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 8",
)
def top_vendors(spark, sf_dir):
    by = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    named = by.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "n_name").limit(8)


@BOOK.add(
    "top_n_with_other",
    """
    WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 20)
    SELECT CASE WHEN t.p_brand IS NULL THEN 'other' ELSE c.p_brand END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN t ON c.p_brand = t.p_brand GROUP BY 1
    """,
)
def top_n_with_other(spark, sf_dir):
    return rollup.top_with_other(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand", "n", 20)


@BOOK.add(
    "share_of_total",
    "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / max(count(*)) OVER (), 6) AS bar FROM lineitem GROUP BY 1",
)
def share_of_total(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    whole = F.broadcast(by.agg(F.sum("n").alias("all"), F.max("n").alias("most")))
    return by.join(whole, F.lit(True)).select("l_returnflag", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), F.round(F.col("n") / F.col("most"), 6).alias("bar"))


@BOOK.add(
    "best_tier",
    "SELECT l_suppkey, CASE max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) WHEN 3 THEN 'A' WHEN 2 THEN 'N' ELSE 'R' END AS tier FROM lineitem GROUP BY 1",
)
def best_tier(spark, sf_dir):
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.when(f == "A", 3).when(f == "N", 2).otherwise(1)).alias("tier"))


@BOOK.add(
    "device_grouping",
    """
    WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM r WHERE k = 1
    """,
)
def device_grouping(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("better", (F.col("o_orderstatus") == "F").cast("int"))
    return rollup.worst_case(o, ["o_custkey", "o_orderpriority"], F.col("better"), "o_orderkey", ["o_orderkey", "o_totalprice"])


@BOOK.add(
    "asset_pivot",
    """
    SELECT s_nationkey, CAST(count(*) FILTER (s_acctbal >= 7000) AS BIGINT) AS critical, CAST(count(*) FILTER (s_acctbal >= 3000 AND s_acctbal < 7000) AS BIGINT) AS high,
           coalesce(max(s_acctbal) FILTER (s_acctbal >= 0), 0.0) AS max_score, CAST(count(DISTINCT s_name) AS BIGINT) AS n_components FROM supplier GROUP BY 1
    """,
)
def asset_pivot(spark, sf_dir):
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_if(b >= 7000).alias("critical"), F.count_if((b >= 3000) & (b < 7000)).alias("high"), F.coalesce(F.max(F.when(b >= 0, b)), F.lit(0.0)).alias("max_score"), F.count_distinct("s_name").alias("n_components"))


@BOOK.add(
    "ordered_hit_list",
    "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
)
def ordered_hit_list(spark, sf_dir):
    hits = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(hits, lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"), F.count("*").alias("n"))


@BOOK.add(
    "conditional_counters",
    "SELECT CAST(count(*) FILTER (value >= 50) AS BIGINT) AS high, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS total FROM events",
)
def conditional_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("value") >= 50).alias("high"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"), F.count("*").alias("total"))


@BOOK.add(
    "non_empty_counter",
    "SELECT coalesce(nullif(regexp_extract(text, '(?i)licen[cs]ed? under the ([A-Za-z]+)', 1), ''), 'none') AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1",
)
def non_empty_counter(spark, sf_dir):
    value = F.coalesce(F.nullif(F.regexp_extract("text", "(?i)licen[cs]ed? under the ([A-Za-z]+)", 1), F.lit("")), F.lit("none"))
    return table(spark, sf_dir, "documents").groupBy(value.alias("value")).agg(F.count("*").alias("n"))


@BOOK.add(
    "weighted_counters",
    "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS weight FROM orders GROUP BY 1",
)
def weighted_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("weight"))


@BOOK.add(
    "sequential_ids",
    "SELECT p_partkey, 'S' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR), 6, '0') AS sample_id FROM part",
)
def sequential_ids(spark, sf_dir):
    """W1, in order of the key. Keys fall into ranges of a fixed width, so that ranges are the same whenever they are made;
    how many keys earlier ranges have is a sum over ranges alone, and numbers within a range need that range alone."""
    keys = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / (1 << 16)).alias("part"))
    before = keys.groupBy("part").agg(F.count("*").alias("n")).select("part", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    numbered = keys.withColumn("k", F.expr("row_number() OVER (PARTITION BY part ORDER BY p_partkey) - 1"))
    return numbered.join(before, "part").select("p_partkey", F.concat(F.lit("S"), F.lpad((F.col("k") + F.col("before")).cast("string"), 6, "0")).alias("sample_id"))


@BOOK.add("lead_successor", "SELECT p_brand, p_size, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS successor FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def lead_successor(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_size").distinct().withColumn("successor", F.expr("lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size)"))


@BOOK.add("dedupe_first_wins", "SELECT text_len, doc_id FROM (SELECT length(text) AS text_len, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").cast("bigint").alias("text_len"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("text_len").alias("text_len")).select("text_len", "doc_id")
