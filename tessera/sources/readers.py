"""Readers of advisories, inventories, feeds and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tessera.functions.decide import truth
from tessera.functions.udf import jsonc
from tessera.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path, in whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found)


def optional(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """SRC17, SRC20: what read gives, or no rows of the schema where the path isn't there."""
    return read() if exists(spark, path) else spark.createDataFrame([], StructType.fromDDL(schema))


def first_path(spark: SparkSession, *paths: str) -> str:
    """SRC8: the first path that is there."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def safe_name(name: Column) -> Column:
    """PF17: whether a file's name stays within its folder."""
    return F.coalesce(name != "", F.lit(False)) & ~F.coalesce(name.rlike(r"[/\\\\]|^\.\.?$|\x00"), F.lit(True))


def keyed_json(spark: SparkSession, path: str, value: str, key: str = "key", drop: tuple[str, ...] = ()) -> DataFrame:
    """SRC1, SRC2, SRC18: a file that is one JSON object of records, as rows (key, its fields); sentinel keys are dropped.

    Values that aren't records, such as a cursor's number, become null and go with the sentinels."""
    kind = StructType.fromDDL(f"v {value}")["v"].dataType
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias(key, "_raw"))
    rows = rows.filter(~F.col(key).isin(*drop)) if drop else rows
    return rows.select(key, F.from_json("_raw", kind).alias("_v")).filter("_v is not null").select(key, "_v.*")


def advisories(spark: SparkSession, path: str, with_errors: bool = False) -> DataFrame:
    """SRC1, SRC2."""
    rows = keyed_json(spark, path, schemas.ADVISORY, "_id").withColumn("advisory_id", F.coalesce("advisory_id", "_id")).drop("_id")
    return rows if with_errors else rows.filter("error is null")


def advisory_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC3: one advisory in each file."""
    return spark.read.schema(schemas.ADVISORY_FILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.col("_metadata.file_name"))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: all strings as they stand; typed columns beside them. An empty cell is an empty string again."""
    raw = spark.read.schema(schemas.FINDING).option("header", True).option("encoding", "UTF-8").csv(path).na.fill("")
    return raw.withColumn("cvss", F.col("cvss_v3_score").try_cast("double")).withColumn("is_kev", truth(F.col("kev"))).withColumn("epss_value", F.col("epss").try_cast("double"))


def verdicts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """SRC5, SRC6: a log of JSON lines; malformed ones are skipped, or fail where strict."""
    return spark.read.schema(schemas.VERDICT).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def inventories(spark: SparkSession, folder: str, suffix: str = "*_SBOM.json") -> DataFrame:
    """SRC7: CycloneDX documents."""
    return spark.read.schema(schemas.INVENTORY).option("multiLine", True).option("pathGlobFilter", suffix).json(folder).withColumn("file", F.col("_metadata.file_name"))


def components(docs: DataFrame) -> DataFrame:
    """SRC9: named components, in their order."""
    rows = docs.select("file", F.posexplode("components").alias("pos", "c"))
    return rows.select("file", "pos", F.col("c.`bom-ref`").alias("ref"), F.trim("c.name").alias("name"), F.col("c.version").alias("version"), F.col("c.cpe").alias("cpe"), F.col("c.purl").alias("purl"), F.col("c.properties").alias("properties")).filter("name is not null and name <> ''")


def property_value(bag: Column, name: str) -> Column:
    """PF16: the last value of a name in a bag of properties."""
    return F.try_element_at(F.transform(F.filter(bag, lambda p: p["name"] == name), lambda p: p["value"]), F.lit(-1))


def dependencies(docs: DataFrame) -> DataFrame:
    """The edges (file, src, dst) of the documents' dependency graphs."""
    return docs.select("file", F.explode("dependencies").alias("d")).select("file", F.col("d.ref").alias("src"), F.explode("d.dependsOn").alias("dst"))


def jsonc_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC10: JSON with comments and trailing commas, one document a file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.from_json(jsonc("value"), schema).alias("d")).select("d.*")


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """SRC11, SRC12: a row for each known component, version and vulnerability; a version with none keeps a row without one."""
    rows = spark.read.schema(schemas.KNOWLEDGE).option("multiLine", True).json(path).select(F.posexplode("components").alias("pos", "c"))
    flat = rows.select("pos", "c.key", "c.name", "c.cpe_product", F.explode("c.versions").alias("version", "list"))
    return flat.select("pos", "key", "name", "cpe_product", "version", F.explode_outer("list").alias("v")).select("pos", "key", "name", "cpe_product", "version", F.col("v.id").alias("cve"), F.col("v.sev").alias("severity"), F.col("v.av").alias("av"), F.col("v.kev").alias("kev"), F.col("v.epss").alias("epss"), F.col("v.cvss").alias("cvss"))


def cve_index(known: DataFrame) -> DataFrame:
    """SRC13: the component of each CVE, the later one where several have it; SRC14 is its cve column."""
    return known.filter("cve is not null").groupBy("cve").agg(F.max_by("key", "pos").alias("key"))


def code_pairs(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: CVEs of which both codes are held."""
    return keyed_json(spark, path, schemas.CODE, "_cve").filter("vuln_code <> '' and patched_code <> ''").select(F.col("_cve").alias("cve")).distinct()


def run_verdicts(batch: DataFrame, packages: DataFrame, compiled: DataFrame) -> DataFrame:
    """SRC16: recorded runs of three layouts as one row a CVE; compiled ones count before packages, these before batches.

    Of batches only those that ended in a verdict about the pair count."""
    def plain(df: DataFrame, prio: int) -> DataFrame:
        return df.select("cve", (F.col("vuln_crash") & ~F.col("patched_crash")).alias("discriminates"), "signal", "patched_version", "method", F.lit(prio).alias("prio"))

    hit = F.filter("versions", lambda v: v["triggered"])
    fixed = F.filter("versions", lambda v: ~v["triggered"])
    own = packages.select("cve", "discriminates", F.get(F.flatten(F.transform(hit, lambda v: v["evidence"])), 0).alias("signal"), F.get(F.transform(fixed, lambda v: v["version"]), 0).alias("patched_version"), F.lit("package").alias("method"), F.lit(2).alias("prio"))
    rows = plain(batch.filter(F.col("verdict").isin("EXPLOITABLE", "NOT_TRIGGERED")), 1).unionByName(own).unionByName(plain(compiled, 3))
    return rows.groupBy("cve").agg(F.max_by(F.struct("discriminates", "signal", "patched_version", "method"), "prio").alias("x")).select("cve", "x.*")


def collected(report: DataFrame) -> DataFrame:
    """SRC19: CVEs whose sources were collected, of a report's records."""
    return report.select(F.explode("records").alias("r")).filter("r.status = 'collected'").select("r.cve").distinct()


def listed_urls(bodies: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """SRC21: addresses in listings with the id that the pattern's group gives; of one id the last."""
    found = bodies.select(F.posexplode(F.regexp_extract_all(column, F.lit(f"(?:{pattern})"), F.lit(0))).alias("pos", "url")).withColumn("id", F.lower(F.regexp_extract("url", pattern, 1)))
    return found.groupBy("id").agg(F.max_by("url", "pos").alias("url"))


def exploited(spark: SparkSession, path: str) -> DataFrame:
    """SRC23: known exploited CVEs with the date they were listed."""
    return spark.read.schema("vulnerabilities array<struct<cveID:string,dateAdded:string>>").option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cveID").alias("cve"), F.col("v.dateAdded").alias("kev_date"))


def fix_commits(records: DataFrame) -> DataFrame:
    """SRC27: of records (cve, references array<struct<type,url>>), the commits that fix, first ones first."""
    from tessera.functions.text import commit_of

    refs = records.select("cve", F.posexplode(F.filter("references", lambda r: r["type"] == "FIX")).alias("pos", "r"))
    return refs.select("cve", "pos", commit_of(F.col("r.url")).alias("c")).filter("c is not null").select("cve", "pos", "c.*")


def patch_commits(sides: list[tuple[str, DataFrame]], fallbacks: list[tuple[str, DataFrame]], most: int = 4) -> DataFrame:
    """(cve, repo, sha, place, resolver): commits that fix a CVE, from all sides together, else from the first fallback.

    Each side is (label, rows of cve, pos, repo, sha). A CVE's resolver is the first side that knows any commit; a commit
    counts once by its repository and the first twelve digits of its hash; the first `most` of a CVE stay."""

    def marked(label: str, rows: DataFrame, prio: int) -> DataFrame:
        return rows.select("cve", "pos", "repo", "sha", F.lit(prio).alias("prio"), F.lit(label).alias("resolver"))

    out = None
    for prio, (label, rows) in enumerate(sides):
        out = marked(label, rows, prio) if out is None else out.unionByName(marked(label, rows, prio))
    for prio, (label, rows) in enumerate(fallbacks, len(sides)):
        more = marked(label, rows, prio)
        out = more if out is None else out.unionByName(more.join(out.select("cve").distinct(), "cve", "left_anti"))
    order = F.struct("prio", "pos", "sha")
    once = out.groupBy("cve", "repo", F.substring("sha", 1, 12).alias("head")).agg(F.min(F.struct("prio", "pos", "sha", "resolver")).alias("x")).select("cve", "repo", "x.*")
    first = once.groupBy("cve").agg(F.array_sort(F.collect_list(F.struct("prio", "pos", "sha", "repo"))).alias("all"), F.min_by("resolver", order).alias("resolver"))
    return first.select("cve", F.posexplode(F.slice("all", 1, most)).alias("place", "c"), "resolver").select("cve", "c.repo", "c.sha", "place", "resolver")


def commit_files(bodies: DataFrame, column: str = "body") -> DataFrame:
    """SRC28: the files of recorded answers about commits: (sha, file, patch)."""
    kind = "sha string, files array<struct<filename:string,patch:string>>"
    rows = bodies.select(F.from_json(column, kind).alias("d")).select("d.sha", F.explode("d.files").alias("f"))
    return rows.select("sha", F.col("f.filename").alias("file"), F.col("f.patch").alias("patch"))


def archive_members(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """SRC29: the regular files of zip and tar archives: (archive, member, size, content); content is null beyond most_bytes."""

    def members(batches):
        import io
        import tarfile
        import zipfile

        import pandas as pd

        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        some = [(i.filename, i.file_size, z.read(i) if i.file_size <= most_bytes else None) for i in z.infolist() if not i.is_dir()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                        some = [(m.name, m.size, t.extractfile(m).read() if m.size <= most_bytes else None) for m in t if m.isfile()]
                if some:
                    yield pd.DataFrame([(name, *x) for x in some], columns=["archive", "member", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, size bigint, content binary")


def build_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BUILD_RUN).option("header", True).csv(path)


def build_logs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC32: of each log, whether its markers are there and the last duration it states."""
    rows = spark.read.text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    last = F.try_element_at(F.regexp_extract_all("value", F.lit(r"took (\d+) s"), F.lit(1)), F.lit(-1))
    return rows.select("file", F.contains("value", F.lit("BUILD OK")).cast("int").alias("build_ok"), F.contains("value", F.lit("CRITIC OK")).cast("int").alias("critic_ok"), last.cast("int").alias("seconds"))


def paged_feed(feed: str, fetch) -> type[DataSource]:
    """SRC22 to SRC26: a Spark source named feed that asks for chunks of ids; options ids (comma-joined) and chunk.

    fetch: a function of a list of ids that yields (id, body); it runs on the executors, a partition for each chunk."""

    class Reader(DataSourceReader):
        def __init__(self, options) -> None:
            self.ids, self.size = [i for i in options["ids"].split(",") if i], int(options.get("chunk", "80"))

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(self.ids[i : i + self.size]) for i in range(0, len(self.ids), self.size)] or [InputPartition([])]

        def read(self, partition: InputPartition):
            yield from fetch(partition.value)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return feed

        def schema(self) -> str:
            return "id string, body string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Feed


def with_retries(get, tries: int = 3, wait: float = 1.0, sleep=None):
    """SRC22, SRC25: a function of an address that asks again after growing waits; None where the answer is that nothing is there.

    get: a function of an address that gives (status, body); statuses of 400 and more but 404, and errors of the
    connection, are tried again, the last one is raised."""
    import time

    def ask(address: str):
        for n in range(tries):
            try:
                status, body = get(address)
                if status == 404:
                    return None
                if status < 400:
                    return body
                error: Exception = OSError(f"{address}: {status}")
            except OSError as e:
                error = e
            if n + 1 < tries:
                (sleep or time.sleep)(wait * 2**n)
        raise error

    return ask


def paged_stream(feed: str, fetch, page: int = 2000) -> type[DataSource]:
    """SRC26, STR3: a streaming source named feed that reads page after page; its offset, the next row's index, is what a
    restarted query goes on from.

    fetch: a function of (start, size) that gives (total, rows of (id, body)); a page that can't be read ends the batch
    and is asked for again with the next one."""

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"start": 0}

        def read(self, start: dict):
            at = start["start"]
            try:
                total, rows = fetch(at, page)
            except OSError:
                return iter(()), start
            return iter(rows), {"start": max(at, min(at + page, total))}

        def readBetweenOffsets(self, start: dict, end: dict):
            for at in range(start["start"], end["start"], page):
                yield from fetch(at, min(page, end["start"] - at))[1]

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return feed

        def schema(self) -> str:
            return "id string, body string"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Stream()

    return Feed


def repositories(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """SRC30: the fixed dimension of upstream repositories."""
    return spark.createDataFrame(rows, "component string, repo string, tag_templates array<string>, closed boolean")


def synthetic_inventories(spark: SparkSession, n: int, parts: int = 5) -> DataFrame:
    """SRC31: n invented inventories for tests: (device, ref, name, version, cpe, purl, cves), the same every time."""
    d = spark.range(n).withColumnRenamed("id", "k").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    h = F.pmod(F.xxhash64("k", "p"), F.lit(40))
    name = F.format_string("lib%02d", h)
    version = F.concat((h % 3 + 1).cast("string"), F.lit("."), (F.col("k") % 4).cast("string"))
    return d.select(F.format_string("device-%05d", "k").alias("device"), F.concat(F.lit("ref-"), F.col("p").cast("string")).alias("ref"), name.alias("name"), version.alias("version"), F.format_string("cpe:2.3:a:acme:%s:%s:*:*:*:*:*:*:*", name, version).alias("cpe"), F.format_string("pkg:generic/%s@%s", name, version).alias("purl"), F.when(h % 4 == 0, F.array(F.format_string("CVE-2024-%05d", h))).otherwise(F.array().cast("array<string>")).alias("cves"))
