"""Benchmark decontamination by winnowing: fingerprints of training and test texts are joined, and hits are extended."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tessera.llm.common import cut, grams, slices, text_bytes, tune, words

#: Bytes of a word, after A-Z are lower-cased: digits, letters, and all of any character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every `window` consecutive ones, the rightmost of equals.

    Any span with `window` hashes has one of them, and which one depends on the span's text alone."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    at = np.arange(n - window + 1)
    best, where = h[: n - window + 1].copy(), at.copy()
    for j in range(1, window):
        other = h[j : n - window + 1 + j]
        less = other <= best
        best[less] = other[less]
        where[less] = at[less] + j
    return np.unique(where)


class TestIndex:
    """The windows of benchmark items by winnowed fingerprint, and whole short items by their hash."""

    __test__ = False

    def __init__(self, items: list[tuple], span: int = 10, k: int = 5) -> None:
        self.span, self.k, self.window = span, min(k, span), span - min(k, span) + 1
        self.ids: list = []
        self.words: list[np.ndarray] = []
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        prints: dict[int, list[tuple[int, int]]] = defaultdict(list)
        seen: dict[bytes, int] = {}
        self.same: list[list] = []  # item ids by distinct sequence of words
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            h, _, _ = words(data, np.array([0, len(data)]), WORD_BYTES)
            if not len(h):
                continue
            if (key := h.tobytes()) in seen:
                self.same[seen[key]].append(item_id)
                continue
            n = seen[key] = len(self.words)
            self.words.append(h)
            self.same.append([item_id])
            if len(h) < span:
                short[len(h)][int(grams(h, len(h))[0])].append(n)
            else:
                g = grams(h, self.k)
                for p in winnow(g, self.window):
                    prints[int(g[p])].append((n, int(p)))
        self.short = {size: (np.array(sorted(d), np.uint64), {key: tuple(v) for key, v in d.items()}) for size, d in short.items()}
        self.prints = np.array(sorted(prints), np.uint64)
        # what can be extended around a print is within the windows that hold it; items that are alike there go together
        self.postings = {key: self._alike(v) for key, v in prints.items()}

    def _alike(self, places: list[tuple[int, int]]) -> tuple[tuple[np.ndarray, int, tuple[int, ...]], ...]:
        groups: dict[tuple[int, bytes], tuple[np.ndarray, set[int]]] = {}
        for n, q in places:
            lo = max(0, q + self.k - self.span)
            near = self.words[n][lo : q + self.span]
            groups.setdefault((q - lo, near.tobytes()), (near, set()))[1].add(n)
        return tuple((near, at, tuple(sorted(items))) for (at, _), (near, items) in groups.items())

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a text are hit, and the items with an occurring window. g: its k-gram hashes."""
        hit, found = np.zeros(len(h) + 1, np.int64), set()
        if len(h) >= self.span and len(self.prints):
            at = winnow(g, self.window)
            for p in at[_member(g[at], self.prints)].tolist():
                for near, q, items in self.postings[int(g[p])]:
                    lo, hi = _extend(h, p, near, q, self.k)
                    if hi - lo >= self.span:
                        hit[lo] += 1
                        hit[hi] -= 1
                        found.update(items)
        for size, (keys, items) in self.short.items():
            whole = grams(h, size)
            for p in np.flatnonzero(_member(whole, keys)).tolist():
                hit[p] += 1
                hit[p + size] -= 1
                found.update(items[int(whole[p])])
        return np.cumsum(hit[:-1]) > 0, found


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    k = np.searchsorted(known, values)
    return known[np.minimum(k, len(known) - 1)] == values


def _extend(a: np.ndarray, p: int, b: np.ndarray, q: int, k: int) -> tuple[int, int]:
    """The longest run of equal words around a[p : p + k] = b[q : q + k]; (0, 0) if those differ after all."""
    if len(b) < q + k or not np.array_equal(a[p : p + k], b[q : q + k]):
        return 0, 0
    back = min(p, q)
    differ = np.flatnonzero(a[p - back : p] != b[q - back : q])
    lo = p - back + (int(differ[-1]) + 1 if len(differ) else 0)
    ahead = min(len(a) - p - k, len(b) - q - k)
    differ = np.flatnonzero(a[p + k : p + k + ahead] != b[q + k : q + k + ahead])
    return lo, p + k + (int(differ[0]) if len(differ) else ahead)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5, block_chars: int = 16 << 20, with_row: str | None = None, spans: bool = False) -> DataFrame:
    """A row for each row of docs: its id, n_words, n_hit, n_items, item_ids (sorted strings) and contaminated.

    Lower-cases A-Z; words are runs of ASCII digits, letters and any other than ASCII characters. A window is `span`
    consecutive words of an item, or the whole of a shorter item; a word within any occurrence of a window is hit.
    Null and empty texts have no words, null item ids count as items without an id in no list, equal items count each;
    repeated rows and null ids stay rows of their own. With spans, also hit_spans: [start, end) bytes in UTF-8.
    with_row: the name of a further column that holds the whole row of docs as a struct, so that no column clashes.

    Test items are a set of queries that meets all documents block by block: a block has at most block_chars characters
    of items, or one longer item, so what is broadcast never exceeds that however large the benchmark. One block is the
    usual case and needs no shuffle; with more, each document's hits in each block are merged by a row number made before
    the blocks, and the broadcast of a block is released once its hits are written."""
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("words_of"), F.coalesce(F.length(item_text_col), F.lit(0)).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    whole = [F.struct("*").alias("row")] if with_row else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *whole)
    if total <= block_chars:
        made = _scan(rows, _index(spark, items.select("item", "words_of").collect(), span, k))
    else:
        numbered = cut(rows.withColumn("number", F.monotonically_increasing_id()), "decontaminate")
        parts = []
        for some in _blocks(items, block_chars):
            index = _index(spark, some, span, k)
            parts.append(cut(_scan(numbered.select(F.col("number").alias("id"), "text"), index), "hits"))
            index.destroy()
        hits = reduce(DataFrame.unionByName, parts)
        merged = hits.groupBy(F.col("id").alias("number")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.sum("n_items").alias("n_items"), _union(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"), _union(F.flatten(F.collect_list("word_spans"))).alias("word_spans"))
        merged = merged.withColumn("n_hit", F.aggregate("word_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]))
        made = numbered.drop("text").join(merged, "number").withColumn("contaminated", F.col("n_hit") > 0)
    return made.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "item_ids", "contaminated", *(["hit_spans"] if spans else []), *([F.col("row").alias(with_row)] if with_row else []))


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list]:
    """The items in blocks by their running size, one block at a time on the driver."""
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + r["n"] > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item"], r["words_of"]))
        size += r["n"]
    yield block


def _union(spans: Column) -> Column:
    """The union of spans, as maximal runs in order."""

    def add(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (F.size(runs) > 0) & (x["start"] <= last["end"])
        return F.when(joins, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(x)))

    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return F.aggregate(F.array_sort(spans), empty, add)


def _index(spark, rows, span: int, k: int):
    return spark.sparkContext.broadcast(TestIndex([(r[0], r[1]) for r in rows], span, k))


def _scan(rows: DataFrame, index) -> DataFrame:
    """rows: id, text and perhaps the whole row."""
    pairs = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    kinds = [("n_words", LongType()), ("n_hit", LongType()), ("n_items", LongType()), ("item_ids", ArrayType(StringType())), ("contaminated", BooleanType()), ("hit_spans", pairs), ("word_spans", pairs)]
    schema = StructType([StructField("id", rows.schema["id"].dataType), *(StructField(n, t) for n, t in kinds), *rows.schema.fields[2:]])
    more = [f.name for f in rows.schema.fields[2:]]
    pair_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = index.value
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            cols: list[list] = [[], [], [], [], [], [], []]
            for lo, hi in slices(off):
                part = off[lo : hi + 1] - off[lo]
                h, where, counts = words(data[off[lo] : off[hi]], part, WORD_BYTES)
                g = grams(h, test.k)
                at = 0
                for n, base in zip(counts.tolist(), part.tolist(), strict=False):
                    own = h[at : at + n]
                    hit, found = test.find(own, g[at : at + max(0, n - test.k + 1)])
                    items = sorted(str(i) for x in found for i in test.same[x] if i is not None)
                    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                    firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    spans = [{"start": int(where[at + a, 0]) - base, "end": int(where[at + b - 1, 1]) - base} for a, b in zip(firsts, lasts, strict=True)]
                    for c, v in zip(cols, (n, int(hit.sum()), sum(len(test.same[x]) for x in found), items, bool(len(firsts)), spans, [{"start": int(a), "end": int(b)} for a, b in zip(firsts, lasts, strict=True)]), strict=True):
                        c.append(v)
                    at += n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pair_type, pair_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), *batch.columns[2:]], names=["id", "n_words", "n_hit", "n_items", "item_ids", "contaminated", "hit_spans", "word_spans", *more])

    return rows.mapInArrow(scan, schema)
