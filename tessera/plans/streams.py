"""The streaming operators over events, run to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.plans.base import Book, table
from tessera.streaming import feeds

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def _place(spark) -> str:
    """A new folder that all executors share; one of this machine only for local sessions without such a setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    return feeds.file_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@BOOK.add("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    """Complete mode to memory-free Parquet isn't possible; each batch's updated counts are kept and the last one counts."""
    place = _place(spark)
    counts = feeds.hourly_counts(_events(spark, sf_dir), "7 days")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/number={number}")

    counts.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{place}/out")
    return out.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 4).alias("total"))


@BOOK.add("stream_first_seen", "SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    """A user counts once ever, so every user's key is kept: the state grows with users, as the question asks."""
    place = _place(spark)
    return feeds.run_once(feeds.first_seen(_events(spark, sf_dir), "user_id", "36500 days"), f"{place}/out", f"{place}/check").select("user_id")


@BOOK.add("stream_append_new", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS k FROM events) WHERE k = 1")
def stream_append_new(spark, sf_dir):
    place = _place(spark)
    feeds.append_new(_events(spark, sf_dir), "event_id", f"{place}/out", f"{place}/check").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("event_id", "event_type")
