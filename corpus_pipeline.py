"""A corpus from raw documents to packed sequences: five stages, each over all that the one before has kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import decontamination, jaccard_join, packing, substring_dedup, toxicity
from tessera.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a model of the labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    scored = toxicity.score_toxicity(docs, model, with_row="row")
    return scored.filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return jaccard_join.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat; a document of which nothing is left goes. n_chars follows the text."""
    _, classes = substring_dedup.find_repeats(docs)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), substring_dedup.node_of(F.col("text")).alias("node"))
    rows = rows.join(classes.select("node", "spans"), "node", "left").select("row", "text", "spans")
    schema = StructType([rows.schema["row"], rows.schema["text"], StructField("size", LongType())])

    def strip(batches):
        for batch in batches:
            texts, all_spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size = [None] * len(texts)
            for i, spans in enumerate(all_spans):
                if spans is not None:
                    texts[i] = substring_dedup.strip_spans(texts[i].encode(), [(s["start"], s["end"]) for s in spans]).decode()
                    size[i] = len(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(size, pa.int64())], names=["row", "text", "size"])

    kept = rows.mapInArrow(strip, schema).filter("size is null or size > 0")
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.col("size"), F.col("row.n_chars"))} if "n_chars" in others else {"text": F.col("text")}
    return kept.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(docs, benchmark, with_row="row")
    return found.filter("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Trees, suffix arrays and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
