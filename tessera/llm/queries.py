"""Thin queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import licenses
from tessera.llm.decontamination import find_contamination
from tessera.llm.jaccard_join import near_duplicates
from tessera.llm.licenses import find_licenses
from tessera.llm.media import find_image_copies, render
from tessera.llm.packing import pack
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_counts import count_tokens
from tessera.llm.toxicity import score_toxicity, train
from tessera.llm.weak_quality import score_quality
from tessera.llm.warc import warc_round_trip

QUERIES: dict = {}
ORACLES: dict = {}


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return count_tokens(_table(spark, sf_dir, "documents"))


QUERIES["op1_token_counts"] = op1_token_counts


def op2_warc(spark, sf_dir):
    return warc_round_trip(_table(spark, sf_dir, "pages")).withColumnRenamed("row_id", "page_id")


QUERIES["op2_warc"] = op2_warc
ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def op4_best_fit_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"))


QUERIES["op4_best_fit_packing"] = op4_best_fit_packing


def op5_license_digests(spark, sf_dir):
    return find_licenses(_table(spark, sf_dir, "documents"))


QUERIES["op5_license_digests"] = op5_license_digests
ORACLES["op5_license_digests"] = licenses.oracle()


def op8_decontamination(spark, sf_dir):
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


QUERIES["op8_decontamination"] = op8_decontamination
ORACLES["op8_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM b, unnest(range(1, greatest(0, len(w) - least(10, len(w)) + 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM d, sizes, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) t(i)),
hits AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))


QUERIES["op7_toxicity"] = op7_toxicity


def op10_ngram_jaccard(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op10_ngram_jaccard"] = op10_ngram_jaccard


def op6_substring_dedup(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES["op6_substring_dedup"] = op6_substring_dedup


def op3_weak_quality(spark, sf_dir):
    return score_quality(_table(spark, sf_dir, "documents"))


QUERIES["op3_weak_quality"] = op3_weak_quality


def op9_image_copies(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")  # drawing takes longer than reading
    return find_image_copies(render(vectors)).withColumnRenamed("id", "vec_id")


QUERIES["op9_image_copies"] = op9_image_copies
