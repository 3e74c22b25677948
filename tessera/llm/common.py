"""What the operators share: the shared folder, cut lineage, Arrow text as bytes, hashes of words."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised loops take at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch: texts are long, and a batch is held twice.
BATCH_ROWS = "1000"


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches than the engine's default, where the session still has that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only where none is set (local tests)."""
    tune(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def drop(*written: DataFrame) -> None:
    """Delete what cut has written, once nothing reads it any more."""
    for df in written:
        drop_path(df.sparkSession, df.written_at)


#: Rows of a table that may be broadcast, each of a few numbers; and over how many tasks a key's rows are dealt beyond that.
SMALL, SALT = 500_000, 8


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most SMALL rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def attach(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", stay: bool = True) -> DataFrame:
    """rows joined with the one row of their key in table, a written table of a few numbers a row.

    A table of at most SMALL rows is broadcast, so that rows stay where they are, unless stay is False: where tables grow
    beyond that anyway, the plan is then the same at every size. Of a larger one each row is repeated
    SALT times, and rows meet them by key and the hash of their column `spread`: no key lands in one task."""
    if stay and table.count() <= SMALL:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("salt_", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(SALT)))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(SALT).cast("bigint"))).join(salted, [key, "salt_"], how).drop("salt_")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_string())
    if wide.null_count:
        wide = wide.fill_null("")
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


_U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random value for each byte, and odd multipliers.
BYTE_VALUE = _RNG.integers(0, 1 << 64, 256, np.uint64)
BASE = _U(0x9E3779B97F4A7C15 | 1)
BASE_INV = _U(pow(int(BASE), -1, 1 << 64))
MULT = _RNG.integers(0, 1 << 64, 64, np.uint64) | _U(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, modulo 2 ** 64; kept up to one slice, made anew for longer texts."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    out = []
    for base in (BASE, BASE_INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    if n <= 2 * SLICE_BYTES:
        _POWERS[:] = out
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


#: Bytes of the longest word with a polynomial hash modulo 2 ** 64, which equal bytes alone make likely to be equal only
#: while words are short (Thue-Morse words of 1,024 bytes collide whatever the base is); longer ones have a hash of BLAKE2.
LONG_WORD = 64


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: a 64-bit hash of each, where each starts and ends in data, and how many each text has.

    is_word: 256 booleans, which bytes belong to words. Returns (hashes, spans of shape (n, 2), counts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(len(offsets) - 1, np.int64)
    low = LOWER[data]
    inside = is_word[low]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    p, inv = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[low] * p, out=total[1:])
    h = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    counts = np.searchsorted(starts, offsets[1:], "left") - np.searchsorted(starts, offsets[:-1], "left")
    return h, np.stack([starts, ends], 1), counts


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, _U(k), np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * MULT[j]
    return mix(out)
