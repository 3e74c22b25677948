"""Incremental counterparts of the batch operators, on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """STR2: new Parquet files of a folder as they come, or one file; the checkpoint remembers which were read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def append_new(stream: DataFrame, key: str, sink: str, checkpoint: str):
    """STR2, STR4, STR5: rows whose key the sink doesn't have yet, each once; a repeated batch writes the same rows again.

    Each batch goes to a folder of its own number, overwritten if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            have = spark.read.schema(batch.schema.add("batch", "bigint")).parquet(sink).filter(F.col("batch") < number)
            new = new.join(have.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emit(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """STR1: progress events to a handler, batch by batch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by type in hours of event time; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """W2 on a stream: each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, into Parquet; what the sink then holds."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def reload_marts(marts: dict[str, Callable[[], DataFrame]], place: str) -> dict[str, str]:
    """STR6: every mart made anew; the folder of each. A mart's folder is new, so that readers keep what they have."""
    out = {}
    for name, build in marts.items():
        path = f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        out[name] = path
    return out


def refine(rows: DataFrame, agrees: Callable[[DataFrame], Column], revise: Callable[[DataFrame, int], DataFrame], most: int = 2) -> DataFrame:
    """STR7: rows that a critic doesn't agree with are revised, at most `most` times; rounds counts how often.

    agrees: a condition on the rows; revise: the same columns, made anew for the round of a number."""
    out = rows.withColumn("rounds", F.lit(0))
    names = rows.columns
    for n in range(most):
        open_ = ~F.coalesce(agrees(out), F.lit(False))
        new = revise(out.select(*names, "rounds", open_.alias("_open")), n)
        out = new.withColumn("rounds", F.col("rounds") + F.col("_open").cast("int")).select(*names, "rounds")
    return out
