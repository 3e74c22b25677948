"""Matching components with what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.udf import best_of
from tessera.operators.rollup import dedupe

#: Rows of a reference side that may be sent to every executor.
SMALL = 200_000


def by_name(components: DataFrame, known: DataFrame) -> DataFrame:
    """J5, SRC11: components (name, ...) with known (key, name, cpe_product, pos, ...) under any of its three names.

    Where names collide, the later known component counts."""
    names = F.explode(F.array_distinct(F.array_compact(F.transform(F.array("key", "name", "cpe_product"), F.lower))))
    index = dedupe(known.withColumn("known_name", names), ["known_name"], [F.desc("pos")]).drop("name")
    return components.join(index, F.lower(F.trim("name")) == index["known_name"])


def version_or_all(components: DataFrame, catalog: DataFrame, comp: str, version: str, item: str, pos: str) -> DataFrame:
    """Each component's items at its version; where the catalog lacks that version, at all versions, each once.

    A version that the catalog has with no items (a null item) gives none. Adds pinned."""
    versions = catalog.select(comp, version).distinct().withColumn("pinned", F.lit(True))
    marked = components.join(versions, [comp, version], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    exact = marked.filter("pinned").join(catalog.filter(F.col(item).isNotNull()).select(comp, version, item, pos), [comp, version])
    every = catalog.filter(F.col(item).isNotNull()).groupBy(comp, item).agg(F.min(pos).alias(pos))
    union = marked.filter(~F.col("pinned")).join(every, comp)
    return exact.unionByName(union.select(exact.columns))


def prioritised(df: DataFrame, sides: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """The value of the first side that has one for a row, and which side (method) it was.

    sides: (method, table with the keys and the value, keys); keys must be unique in each."""
    out, found = df, []
    for method, table, keys in sides:
        name = f"_{method}"
        out = out.join(table.select(*keys, F.col(value).alias(name)), keys, "left")
        found.append((method, name))
    method = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(m)) for m, n in found))
    return out.withColumn(value, F.coalesce(*(F.col(n) for _, n in found))).withColumn("method", method).drop(*(n for _, n in found))


def fuzzy(names: DataFrame, name: str, known: DataFrame, known_name: str, least: float = 0.7) -> DataFrame:
    """Each distinct name's most similar known name (the smallest of equals), its score, and whether that suffices.

    known must be a reference list, which is checked; it goes to every executor, where each distinct name meets only the
    known ones whose shared letters can still win. Null names and an empty list have no match."""
    targets = known.select(F.lower(known_name).alias("k")).filter("k is not null").distinct().limit(SMALL + 1).collect()
    if len(targets) > SMALL:
        raise ValueError(f"the reference list has over {SMALL} names")
    distinct = names.select(F.lower(name).alias("query")).filter("query is not null").distinct()
    best = distinct.withColumn("b", best_of([r["k"] for r in targets])("query")).filter("b.best_match is not null")
    return best.select("query", F.col("b.score").alias("score"), F.col("b.best_match").alias("best_match"), (F.col("b.score") >= least).alias("matched"))


def embedded_or_rest(matched: DataFrame, embedded: DataFrame, key: list[str]) -> DataFrame:
    """What matched, and of the embedded rows those whose key didn't."""
    return matched.unionByName(embedded.join(matched.select(*key).distinct(), key, "left_anti"))


def compare_sets(got: DataFrame, want: DataFrame, group: list[str], item: str) -> DataFrame:
    """J20, ST4: of each group, items in both, in got alone and in want alone."""
    g = got.select(*group, item).distinct().withColumn("_g", F.lit(1))
    w = want.select(*group, item).distinct().withColumn("_w", F.lit(1))
    both = g.join(w, [*group, item], "full")
    return both.groupBy(*group).agg(F.count_if(F.col("_g").isNotNull() & F.col("_w").isNotNull()).alias("tp"), F.count_if(F.col("_w").isNull()).alias("fp"), F.count_if(F.col("_g").isNull()).alias("fn"))


def related(advisories: DataFrame, assets: DataFrame, most: int = 150) -> DataFrame:
    """Assets that name an advisory or share a CVE with it: (advisory, asset, exact, cves), of each advisory the
    first `most`: exact ones first, then by shared CVEs and asset.

    advisories: (advisory, cves); assets: (asset, advisories, cves)."""
    exact = assets.select("asset", F.explode("advisories").alias("advisory")).withColumn("cve", F.lit(None).cast("string")).withColumn("exact", F.lit(True))
    left, right = advisories.select("advisory", F.explode("cves").alias("cve")), assets.select("asset", F.explode("cves").alias("cve"))
    shared = left.join(right, "cve").withColumn("exact", F.lit(False))
    both = exact.join(advisories.select("advisory"), "advisory").select("advisory", "asset", "cve", "exact").unionByName(shared.select("advisory", "asset", "cve", "exact"))
    grouped = both.groupBy("advisory", "asset").agg(F.bool_or("exact").alias("exact"), F.array_sort(F.collect_set("cve")).alias("cves"))
    first = Window.partitionBy("advisory").orderBy(F.desc("exact"), F.desc(F.size("cves")), "asset")
    return grouped.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")


def latest_version(catalog: DataFrame, comp: str, version: str) -> DataFrame:
    """J21, SO13: each component's greatest version by its numbers."""
    from tessera.functions.text import version_numbers

    return catalog.groupBy(comp).agg(F.max_by(version, version_numbers(F.col(version))).alias(version))


def shares_token(a: Column, b: Column) -> Column:
    """Whether two token lists share one with a digit."""
    digit = lambda t: t.rlike("[0-9]")
    return F.arrays_overlap(F.filter(a, digit), F.filter(b, digit))
