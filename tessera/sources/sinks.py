"""Sinks of tables, logs and documents; all through Spark's file committer, so a retried task leaves nothing twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """SNK1: fixed columns with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """SNK2."""
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def split(df: DataFrame, sinks: dict[str, Column]) -> None:
    """SNK3: one computed table to several places, each with the rows of a condition."""
    df = df.persist()
    try:
        for path, condition in sinks.items():
            json_lines(df.filter(condition), path)
    finally:
        df.unpersist()


def documents(df: DataFrame, path: str, key: str, document: str = "document") -> None:
    """SNK4, SNK6: a folder for each key with its JSON document as text."""
    df.select(F.col(document).alias("value"), key).write.mode("overwrite").partitionBy(key).text(path)


def mart(df: DataFrame, path: str, most: int = 100_000) -> None:
    """SNK5: a small table as one JSON array in one file; refused if it isn't small."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} rows are no mart for one file")
    df.agg(F.coalesce(F.to_json(F.collect_list(F.struct("*"))), F.lit("[]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def summary(df: DataFrame) -> dict:
    """SNK7: the one row of a summary."""
    return df.first().asDict(recursive=True)


def report(title: str, values: dict) -> str:
    """SNK10: a plain text report of collected numbers."""
    width = max(map(len, values), default=0)
    return "\n".join([title, "-" * len(title), *(f"{k:<{width}}  {v:.4f}" if isinstance(v, float) else f"{k:<{width}}  {v}" for k, v in values.items())])
