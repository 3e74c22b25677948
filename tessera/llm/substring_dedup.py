"""Exact removal of repeated substrings by maximal repeats from the common-prefix intervals of a sampled suffix array.

A suffix array over every byte of the corpus doesn't fit. Sampling keeps it exact: of each window of `span` bytes the
smallest k-gram hash is an anchor, which depends on the window's bytes alone, so two equal windows have the same anchor at
the same place. Suffixes are kept at anchors only, each with the bytes a window around it can reach. All suffixes with one
anchor text meet; sorted, their common-prefix intervals give what follows the anchor in common, and what precedes tells
which of an interval's occurrences are repeats of at least `span` bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUE, MULT, SMALL, attach, cut, drop, mix, powers, slices, text_bytes  # noqa: F401 (tests set SMALL here)

_U = np.uint64
_MOST = _U(0xFFFFFFFFFFFFFFFF)
#: Contexts of one anchor text that one task compares; anchors with more are divided by longer keys.
GROUP = 16_384
#: Contexts of one task's share, about.
SHARE = 4_096
#: Bytes by which the coarse keys of such windows step.
STEP = 25
NO_BYTES = hashlib.sha256(b"").hexdigest()


def _slide(a: np.ndarray, w: int, better, worst) -> np.ndarray:
    """The best of every w consecutive values (blocks scanned from both ends)."""
    n = len(a)
    blocks = np.concatenate([a, np.full(-n % w, worst, a.dtype)]).reshape(-1, w)
    ahead = better.accumulate(blocks, 1).ravel()
    back = better.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return better(back[: n - w + 1], ahead[w - 1 : n])


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inv = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * p[: len(data)], out=total[1:])
    return total, inv


def find_anchors(data: np.ndarray, offsets: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, hash of the anchor, hash of its context) of all anchors of texts of at least span bytes.

    Of a window's k-grams the one with the smallest hash (its upper bits; the rightmost of equals) is its anchor."""
    n, w = len(data), span - k + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    total, inv = _hashes(data)
    h = mix((total[k:] - total[:-k]) * inv[: n - k + 1])
    sizes = np.diff(offsets)
    inside = np.arange(n - span + 1) + span <= np.repeat(offsets[1:], sizes)[: n - span + 1]
    if n < 1 << 27:
        low = _U((1 << 27) - 1)
        least = _slide((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), w, np.minimum, _MOST)[inside]
        at = np.unique(low - (least & low)).astype(np.int64)
    else:  # one huge text: all of equals, the rightmost among them
        top = h >> _U(27)
        least = _slide(top, w, np.minimum, _MOST)
        reach = _slide(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum, _U(0))
        at = np.flatnonzero(reach == top)
    text = np.searchsorted(offsets, at, "right") - 1
    lo, hi = np.maximum(at - w + 1, offsets[text]), np.minimum(at + span, offsets[text + 1])
    context = mix((total[hi] - total[lo]) * inv[lo] + (hi - lo).astype(np.uint64) * MULT[3] + (at - lo).astype(np.uint64) * MULT[5])
    return text, at - offsets[text], h[at], context


def _lcp(rows: list[bytes]) -> list[int]:
    """Common prefix lengths of neighbours."""
    out = []
    for a, b in zip(rows, rows[1:], strict=False):
        m = min(len(a), len(b))
        if a[:m] == b[:m]:
            out.append(m)
            continue
        x = np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)
        out.append(int(x.argmax()))
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of a sorted list with these neighbour prefixes, by one stack scan."""
    stack = [(0, 0)]
    for i, v in enumerate([*lcp, 0], 1):
        first = i - 1
        while stack[-1][0] > v:
            length, first = stack.pop()
            yield length, first, i - 1
        if stack[-1][0] < v:
            stack.append((v, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], span: int, novel: bool = False) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes from the anchor on, occurrences) of the maximal repeats of at least span bytes at one anchor.

    rights: from the anchor on; lefts: what precedes it, reversed. Occurrences are all of those that share the text, not
    neighbours alone. Within an interval of the sorted rights, occurrences with the same bytes before, as many as the
    repeat lacks, are sorted by what precedes them and scanned for intervals in turn; one of those is output if its
    occurrences come from more than one child of the outer interval, so that it can be extended to neither side.

    novel: output only occurrences that reach further left than in the intervals within, which come first; what the
    repeats cover stays the same, and intervals whose occurrences reach as far as they can are passed over."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    after = _lcp([rights[i] for i in order])
    reached = [-1] * len(rights)
    for right, first, last in intervals(after):
        short = max(0, span - right)
        classes: dict[bytes, list[int]] = {}
        number, child = 0, {}
        for p in range(first, last + 1):
            i = order[p]
            child[i] = number
            number += p < last and after[p] == right
            if len(lefts[i]) >= short:
                classes.setdefault(lefts[i][:short], []).append(i)
        for members in classes.values():
            if len(members) < 2 or novel and all(reached[i] >= len(lefts[i]) for i in members):
                continue
            members.sort(key=lefts.__getitem__)
            for left, lo, hi in [*intervals(_lcp([lefts[i] for i in members])), (0, 0, len(members) - 1)]:
                some = members[lo : hi + 1]
                if left < short or len(some) < 2 or all(child[i] == child[some[0]] for i in some):
                    continue
                if novel:
                    some = [i for i in some if reached[i] < left]
                    for i in some:
                        reached[i] = left
                if some:
                    yield left, right, some


def _cover(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as maximal runs."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def node_of(text: Column) -> Column:
    """The class of equal texts."""
    return F.xxhash64(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, k: int = 80) -> tuple[DataFrame, DataFrame]:
    """The bytes to remove: those of any `span`-byte string that also starts elsewhere, in the same or another row.

    Returns (rows, classes). rows: (id, n_bytes, sha256, node) of each row of docs. classes: (node, copies, spans,
    n_removed, n_spans, kept_sha256) of each class of equal texts with something to remove, spans being [start, end) in
    UTF-8 bytes. A text of at least span bytes that is there more than once goes whole. Null and empty texts have nothing
    to remove; repeated rows are copies of each other; other columns are ignored.

    Copies become one class before texts are compared, and a task makes the anchors of a class once. Anchors and contexts are counted with map-side sums, only those
    that occur twice go on, and an anchor with more than GROUP different contexts is divided by longer keys (_crowded): no
    cap, and no task gets a group that grows with the corpus. The driver gets nothing that grows with it but the anchors
    with more than GROUP contexts; all other joins shuffle both sides (merge), at every size."""
    w = span - k + 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha256"), F.xxhash64(F.col(id_col), text).alias("row_key")).withColumn("node", F.xxhash64("sha256")), "rows")
    classes = rows.filter(F.col("n_bytes") >= span).groupBy("node").agg(F.count("*").alias("copies"), F.min("row_key").alias("row_key"), F.max("n_bytes").alias("n_bytes"))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, x in enumerate(batch.column(0).to_pylist()):
                if x not in seen:
                    new.append(i)
                    seen.add(x)
            batch = batch.take(pa.array(new, pa.int64()))
            data, off = text_bytes(batch.column(1))
            node = batch.column(0).to_numpy()
            for lo, hi in slices(off):
                doc, pos, a, c = find_anchors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], span, k)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(node[lo + doc]), pa.array(pos.astype(np.int32))], names=["anchor", "context", "node", "pos"])

    texts = docs.select(node_of(F.col(text_col)).alias("node"), text.alias("text")).filter(F.octet_length("text") >= span)
    anchors = cut(texts.mapInArrow(anchor, "anchor bigint, context bigint, node bigint, pos int"), "anchors")
    place = F.xxhash64("node", "pos")
    several = cut(anchors.groupBy("anchor").agg(F.min(place).alias("p1"), F.max(place).alias("p2")).filter("p1 < p2").select("anchor"), "several")
    twice = cut(attach(anchors, several, "anchor", spread="node", stay=False).distinct(), "twice")
    drop(anchors, several)
    kinds = cut(twice.groupBy("anchor").agg((F.min("context") < F.max("context")).alias("mixed")), "kinds")
    shared = cut(attach(twice, kinds, "anchor", spread="node", stay=False).withColumn("ctx", F.xxhash64("anchor", "context")), "shared")
    drop(twice, kinds)

    # an anchor's contexts: one that occurs twice covers all its occurrences; of the others, one occurrence each goes on
    contexts = cut(shared.filter("mixed").groupBy("anchor", "context").agg(F.min("node").alias("node"), F.min_by("pos", F.struct("node", "pos")).alias("pos"), (F.min(place) < F.max(place)).alias("twice")), "contexts")
    crowds = cut(contexts.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("anchor", F.lit(True).alias("many")), "crowds")
    covered = cut(contexts.filter("twice").select(F.xxhash64("anchor", "context").alias("ctx")), "covered")
    whole = shared.filter(~F.col("mixed")).select("node", "pos").unionByName(attach(shared.filter("mixed"), covered.hint("merge"), "ctx", spread="node", stay=False).select("node", "pos"))
    whole = whole.groupBy("node").agg(F.collect_set("pos").alias("whole"))
    looked = attach(contexts, crowds, "anchor", spread="node", how="left").groupBy("node").agg(F.collect_list(F.struct("pos", "anchor", "context", "twice", F.coalesce("many", F.lit(False)).alias("many"))).alias("contexts"))
    wanted = looked.join(whole, "node", "full").join(classes.select("node", "row_key"), "node")
    source = docs.select(F.xxhash64(F.col(id_col), text).alias("row_key"), text.alias("text")).filter(F.octet_length("text") >= span)
    active = cut(wanted.hint("merge").join(source, "row_key").select("node", "text", "contexts", "whole"), "active", compression="zstd")

    def cut_out(many: bool):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            for batch in batches:
                out: list[tuple] = []
                for i in range(batch.num_rows):
                    found = [c for c in batch.column(2)[i].as_py() or () if c["many"] == many]
                    if found:
                        raw, node = batch.column(1)[i].as_py().encode(), batch.column(0)[i].as_py()
                        out += [(c["anchor"], c["context"], node, c["pos"], c["twice"], raw[max(0, c["pos"] - w + 1) : c["pos"]][::-1], raw[c["pos"] : c["pos"] + span]) for c in found]
                    if out and (len(out) > 4_000 or i + 1 == batch.num_rows):
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "context", "node", "pos", "twice", "lefts", "rights"])
                        out = []

        return active.mapInArrow(f, "anchor bigint, context bigint, node bigint, pos int, twice boolean, lefts binary, rights binary")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("anchor", "ascending"), ("context", "ascending")])
        anchor_, context = (np.asarray(table[c]) for c in ("anchor", "context"))
        new = np.ones(len(anchor_), bool)
        new[1:] = (anchor_[1:] != anchor_[:-1]) | (context[1:] != context[:-1])  # a repeated row of docs may come twice
        table, anchor_ = table.take(pa.array(np.flatnonzero(new))), anchor_[new]
        lefts, rights, twice = (table[c].to_pylist() for c in ("lefts", "rights", "twice"))
        node, pos = table["node"].to_pylist(), table["pos"].to_pylist()
        edges = [*np.flatnonzero(np.diff(anchor_, prepend=anchor_[:1] - 1)).tolist(), len(anchor_)] if len(anchor_) else [0]
        out = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            spans: dict[int, list[tuple[int, int]]] = {}
            for left, right, some in maximal_repeats(lefts[lo:hi], rights[lo:hi], span, novel=True):
                for i in some:
                    if not twice[lo + i]:
                        spans.setdefault(lo + i, []).append((pos[lo + i] - left, pos[lo + i] + right))
            out += [(node[i], s, e) for i, found in spans.items() for s, e in _cover(found)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"node": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "end": pa.array(cols[2], pa.int64())})

    n_buckets = max(1, -(-contexts.count() // SHARE))
    partial = cut_out(False).groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n_buckets))).applyInArrow(search, "node bigint, start bigint, end bigint")
    if not crowds.isEmpty():
        partial = partial.unionByName(_crowded(cut(cut_out(True).dropDuplicates(["anchor", "context"]), "crowded"), span, k, search))
    spans_of = partial.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            at, found = (np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy())]) for c in (2, 3))
            pos, pairs = batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten()
            starts, ends = (pairs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            node, out = batch.column(0).to_pylist(), []
            for i in range(batch.num_rows):
                raw = data[off[i] : off[i + 1]]
                p = pos[at[i] : at[i + 1]]
                lo, hi = np.maximum(p - w + 1, 0), np.minimum(p + span, len(raw))
                long = hi - lo >= span
                lo, hi = np.concatenate([lo[long], starts[found[i] : found[i + 1]]]), np.concatenate([hi[long], ends[found[i] : found[i + 1]]])
                if not len(lo):
                    continue
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                gap = np.flatnonzero(lo[1:] > reach[:-1])
                lo, hi = lo[np.concatenate([[0], gap + 1])].tolist(), reach[np.concatenate([gap, [len(reach) - 1]])].tolist()
                kept = hashlib.sha256()
                for a, b in zip([0, *hi], [*lo, len(raw)], strict=True):
                    kept.update(raw[a:b])
                out.append((node[i], [{"start": a, "end": b} for a, b in zip(lo, hi, strict=True)], sum(hi) - sum(lo), len(lo), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pair, pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "spans", "n_removed", "n_spans", "kept_sha256"])

    finished = active.select("node", "text", "whole").join(spans_of, "node", "left").mapInArrow(finish, "node bigint, spans array<struct<start:bigint,end:bigint>>, n_removed bigint, n_spans bigint, kept_sha256 string").dropDuplicates(["node"])
    single = finished.join(classes.filter("copies = 1").select("node", "copies"), "node")
    double = classes.filter("copies > 1").select("node", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"), F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(NO_BYTES).alias("kept_sha256"), "copies")
    repeats = cut(single.unionByName(double), "repeats")
    drop(shared, contexts, crowds, covered, active)
    return rows, repeats


def _crowded(crowded: DataFrame, span: int, k: int, search) -> DataFrame:
    """(node, start, end) of repeats among contexts of crowded anchors.

    Such an anchor is divided by coarse keys: two windows that are equal share STEP * i bytes before the anchor and what
    the rest of a window is less a step after it, for some i, so that their contexts meet under one key at least. The
    contexts of a key are scanned for intervals as those of an anchor are; a key that more than GROUP contexts have, as a
    passage of nearly a window's length in very many surroundings gives one, is resolved by counting its windows."""
    w = span - k + 1
    n_keys = (w - 1) // STEP + 1
    crowded = crowded.withColumn("ctx", F.xxhash64("anchor", "context"))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ctx, a, left, right in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for i in range(n_keys):
                    after = max(k, span - STEP * (i + 1) + 1)
                    if len(left) >= STEP * i and len(right) >= after:
                        key = hashlib.blake2b(b"%d %d " % (a, i) + left[: STEP * i] + b"|" + right[:after], digest_size=8).digest()
                        out.append((int.from_bytes(key, "little", signed=True), ctx, i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "ctx", "i"])

    keys = cut(crowded.select("ctx", "anchor", "lefts", "rights").mapInArrow(coarse, "key bigint, ctx bigint, i bigint"), "coarse")
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "coarse-sizes")
    some = attach(keys, cut(sizes.filter(F.col("n") <= GROUP).select("key"), "divided").hint("merge"), "key", spread="ctx", stay=False).select(F.col("key").alias("anchor"), "ctx")
    divided = cut(some.join(crowded.drop("anchor", "context"), "ctx").withColumnRenamed("ctx", "context").select("anchor", "context", "node", "pos", "twice", "lefts", "rights"), "divided")
    n_buckets = max(1, -(-divided.count() // SHARE))
    found = divided.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n_buckets))).applyInArrow(search, "node bigint, start bigint, end bigint")
    wide = cut(sizes.filter(F.col("n") > GROUP).select("key"), "wide")
    if not wide.isEmpty():
        chosen = attach(keys, wide, "key", spread="ctx").groupBy("ctx").agg(F.collect_set("i").alias("steps"))
        found = found.unionByName(_by_windows(cut(crowded.join(chosen, "ctx").select("ctx", "anchor", "lefts", "rights", "steps", "node", "pos", "twice"), "windows"), span, w))
    return found


def _by_windows(open_: DataFrame, span: int, w: int) -> DataFrame:
    """(node, start, end) of windows that two contexts have, by counting their hashes at the steps that are open."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            size = 0
            for n, (ctx, a, left, right, steps) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True), 1):
                raw = np.frombuffer(left[::-1] + right, np.uint8)
                total, inv = _hashes(raw)
                before = np.unique(np.concatenate([np.arange(STEP * i, STEP * (i + 1)) for i in steps]))
                before = before[(before < w) & (before <= len(left)) & (span - before <= len(right))]
                lo = len(left) - before
                h = mix((total[lo + span] - total[lo]) * inv[lo] + before.astype(np.uint64) * MULT[7] + np.array([a], np.int64).view(np.uint64) * MULT[9])
                for col, v in zip(out, (h.view(np.int64), np.full(len(h), ctx, np.int64), before.astype(np.int32)), strict=True):
                    col.append(v)
                size += len(h)
                if size > 50_000 or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["window", "ctx", "before"])
                    out, size = [[], [], []], 0

    made = open_.select("ctx", "anchor", "lefts", "rights", "steps").mapInArrow(windows, "window bigint, ctx bigint, before int")
    repeated = made.groupBy("window").agg(F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).filter("c1 < c2").select("window")
    hit = made.join(repeated, "window").groupBy("ctx").agg(F.collect_set("before").alias("befores"))
    placed = open_.filter(~F.col("twice")).select("ctx", "node", "pos").join(hit, "ctx").withColumn("before", F.explode("befores"))
    start = (F.col("pos") - F.col("before")).cast("bigint")
    return placed.select("node", start.alias("start"), (start + span).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, k: int = 80) -> DataFrame:
    """A row for each row of docs: its id, n_bytes, n_removed, n_spans and kept_sha256 (lower-case hex, of what is kept)."""
    rows, classes = find_repeats(docs, id_col, text_col, span, k)
    joined = attach(rows, classes.drop("spans", "copies").hint("merge"), "node", spread="id", how="left", stay=False)
    zero = F.lit(0).cast("bigint")
    return joined.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def strip_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left without the spans, each first narrowed to whole characters."""
    out, at = [], 0
    for lo, hi in spans:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])
