"""Metrics of matchers and classifiers, and similarities of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.functions.hashing import hash_mod_sql, holdout
from tessera.plans.base import Book, table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles

_GUESS_SQL = "(SELECT l.quality AS truth, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS guess, (d.doc_id % 100) / 100.0 AS conf FROM labels l JOIN documents d USING (doc_id))"


def _guesses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    return j.select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("guess"), ((F.col("doc_id") % 100) / 100.0).alias("conf"))


@BOOK.add("confusion_matrix", f"SELECT truth, guess, CAST(count(*) AS BIGINT) AS n FROM {_GUESS_SQL} GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_guesses(spark, sf_dir), "truth", "guess")


@BOOK.add(
    "per_class_scores",
    f"""
    WITH g AS {_GUESS_SQL}, c AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS tp, count(*) FILTER (guess = label) AS said, count(*) FILTER (truth = label) AS support FROM g, (VALUES (0), (1)) v(label) GROUP BY 1)
    SELECT label, round(coalesce(tp / nullif(said, 0), 0), 6) AS prec, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(said + support, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM c
    """,
)
def per_class_scores(spark, sf_dir):
    s = M.per_class(_guesses(spark, sf_dir), "truth", "guess")
    return s.select("label", *(F.round(c, 6).alias(c) for c in ("prec", "recall", "f1")), "support")


@BOOK.add(
    "calibration",
    f"WITH g AS {_GUESS_SQL}, b AS (SELECT ceil(conf * 10) AS bin, count(*) AS n, avg(CASE WHEN truth = guess THEN 1.0 ELSE 0 END) AS acc, avg(conf) AS c FROM g GROUP BY 1) SELECT round(sum(CASE WHEN bin > 0 THEN n * abs(acc - c) ELSE 0 END) / sum(n), 6) AS ece FROM b",
)
def calibration(spark, sf_dir):
    g = _guesses(spark, sf_dir).withColumn("right", F.col("truth") == F.col("guess"))
    return M.calibration_error(g, "conf", "right").select(F.round("ece", 6).alias("ece"))


@BOOK.add(
    "safety_rates",
    f"SELECT CAST(count(*) FILTER (guess = 0 AND truth <> 0) AS BIGINT) AS wrong_negatives, round(avg(CASE WHEN guess = 0 AND truth <> 0 THEN 1.0 ELSE 0 END), 6) AS wrong_negative_rate, round(avg(CASE WHEN guess = 0 THEN 1.0 ELSE 0 END), 6) AS undecided_rate, round(avg(CASE WHEN guess = truth THEN 1.0 ELSE 0 END), 6) AS accuracy FROM {_GUESS_SQL}",
)
def safety_rates(spark, sf_dir):
    s = M.safety(_guesses(spark, sf_dir), "truth", "guess", 0, 0)
    return s.select("wrong_negatives", *(F.round(c, 6).alias(c) for c in ("wrong_negative_rate", "undecided_rate", "accuracy")))


@BOOK.add(
    "set_scores",
    """
    WITH s AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS got, list_distinct(string_split(p_type, ' ') || string_split(p_name, ' ')[1:1]) AS want FROM part),
    c AS (SELECT len(list_intersect(got, want)) AS tp, len(got) AS ng, len(want) AS nw FROM s)
    SELECT round(sum(tp) / sum(ng), 6) AS prec, round(sum(tp) / sum(nw), 6) AS recall, round(2.0 * sum(tp) / (sum(ng) + sum(nw)), 6) AS f1, round(avg(tp / (ng + nw - tp)), 6) AS mean_iou FROM c
    """,
)
def set_scores(spark, sf_dir):
    name = F.split("p_name", " ")
    s = table(spark, sf_dir, "part").select(F.array_distinct(name).alias("got"), F.array_distinct(F.concat(F.split("p_type", " "), F.slice(name, 1, 1))).alias("want"))
    return M.set_scores(s, "got", "want").select(*(F.round(c, 6).alias(c) for c in ("prec", "recall", "f1", "mean_iou")))


@BOOK.add(
    "cosine_nearest_of_two",
    """
    WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) WHERE label IN (0, 1) GROUP BY 1, 2) GROUP BY 1)
    SELECT vec_id, CASE WHEN list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM c WHERE label = 0)) >= list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM c WHERE label = 1)) THEN 'first' ELSE 'second' END AS nearest FROM embeddings
    """,
)
def cosine_nearest_of_two(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    means = e.filter("label IN (0, 1)").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    both = means.agg(F.max(F.when(F.col("label") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("label") == 1, F.col("v"))).alias("b"))
    return e.join(F.broadcast(both), F.lit(True)).select("vec_id", M.nearest_of_two(F.col("embedding"), F.col("a"), F.col("b"), ("first", "second")).alias("nearest"))


@BOOK.add(
    "max_similarity",
    """
    WITH t AS (SELECT list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY label)
    SELECT vec_id, round(max(list_cosine_similarity(e.embedding::DOUBLE[], t.v)), 4) AS best, CASE WHEN max(list_cosine_similarity(e.embedding::DOUBLE[], t.v)) >= 0.92 THEN 'present' ELSE 'weak' END AS signal FROM embeddings e, t GROUP BY 1
    """,
)
def max_similarity(spark, sf_dir):
    """The labels' centroids, one array of few templates, against each vector; rows aren't multiplied or moved."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    templates = means.agg(F.collect_list("v").alias("ts"))
    best = F.array_max(F.transform("ts", lambda t: M.cosine(F.col("embedding"), t)))
    return e.join(F.broadcast(templates), F.lit(True)).select("vec_id", best.alias("s")).select("vec_id", F.round("s", 4).alias("best"), F.when(F.col("s") >= 0.92, "present").otherwise("weak").alias("signal"))


@BOOK.add("holdout_split", f"SELECT c_nationkey, bool_and({hash_mod_sql("'split::' || c_nationkey", 100)} < 20) AS test, CAST(count(*) AS BIGINT) AS n_rows FROM customer GROUP BY 1")
def holdout_split(spark, sf_dir):
    """Whole groups on one side of a split; a group on both would give two rows."""
    c = table(spark, sf_dir, "customer").withColumn("test", holdout(F.col("c_nationkey"), 20))
    return c.groupBy("c_nationkey", "test").agg(F.count("*").alias("n_rows"))


@BOOK.add(
    "argmax_softmax",
    "WITH s AS (SELECT event_id, [value / 100, (event_id % 10) / 10.0, 0.45] AS v FROM events) SELECT event_id, CASE WHEN v[1] >= v[2] AND v[1] >= v[3] THEN 'a' WHEN v[2] >= v[3] THEN 'b' ELSE 'c' END AS label, round(exp(list_max(v)) / (exp(v[1]) + exp(v[2]) + exp(v[3])), 6) AS conf FROM s",
)
def argmax_softmax(spark, sf_dir):
    v = F.array(F.col("value") / 100, (F.col("event_id") % 10) / 10.0, F.lit(0.45))
    p = M.softmax(F.col("v"))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", M.argmax_label(F.col("v"), ["a", "b", "c"]).alias("label"), F.round(F.array_max(p), 6).alias("conf"))
