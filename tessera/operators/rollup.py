"""Rollups by key whose ties are settled by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worst_case(df: DataFrame, keys: list[str], rank: Column, pos: str, keep: list[str]) -> DataFrame:
    """AG4, W3: each key's row of the highest rank, the earliest of equals; one partial aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(rank, -F.col(pos))).alias("w")).select(*keys, "w.*")


def mode_first(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """AG6, AG7: each key's most frequent value that isn't empty, the earliest of equals."""
    counted = df.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def first_wins(value: str, pos: str) -> Column:
    """AG15: the earliest value that isn't empty."""
    return F.min_by(value, F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.col(pos)))


def last_wins(value: str, pos: str) -> Column:
    return F.max_by(value, F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.col(pos)))


def joined_set(value: str, delimiter: str = ";") -> Column:
    """AG9, AG18: the sorted distinct values in one string."""
    return F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), delimiter)


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Each key's first row in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_with_other(counts: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """AG28: the most frequent keys, and the rest as one; counts must be a row for each key."""
    top = counts.orderBy(F.desc(n), key).limit(most).select(key)
    return counts.join(F.broadcast(top.withColumn("_top", F.lit(True))), key, "left").groupBy(F.when(F.col("_top"), F.col(key)).otherwise("other").alias(key)).agg(F.sum(n).alias(n))


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """AG1: a count by each column alone, in one pass: (dim, value, n)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, key: str, by: str, values: list[str], keys: DataFrame | None = None) -> DataFrame:
    """AG2: counts of fixed values by key, zeros included, for all keys of a given list."""
    out = df.groupBy(key).agg(*(F.count_if(F.col(by) == v).alias(f"n_{v.lower()}") for v in values), F.count("*").alias("total"))
    return out if keys is None else keys.join(out, key, "left").na.fill(0)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SO11: a page, its number at least 1."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def drill_down(df: DataFrame, dims: dict[str, Column], dim: str, value: str) -> DataFrame:
    """PF4: rows whose dimension has a value; none for an unknown dimension. An array holds it, anything else equals it."""
    if dim not in dims:
        return df.filter(F.lit(False))
    c = dims[dim]
    kind = df.select(c.alias("c")).schema["c"].dataType.typeName()
    return df.filter(F.array_contains(c, value) if kind == "array" else c.cast("string") == value)


def search(df: DataFrame, text: str, columns: list[str], lists: list[str] = ()) -> DataFrame:
    """PF5: rows with a text, in any case, in any of the columns; all rows for an empty text."""
    if not text:
        return df
    q = F.lit(text.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), q), F.lit(False))
    for c in lists:
        hit = hit | F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), q)), F.lit(False))
    return df.filter(hit)
