"""Best-fit packing into fixed-length sequences, improved by swap-based local search over lengths, not over documents."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.token_counts import encode_spliced, load_tokenizer

#: Counts of lengths by task that may be broadcast; more are joined by a shuffle.
SMALL = 500_000

Bin = tuple[int, ...]  # lengths, descending


def best_fit(counts: dict[int, int], capacity: int) -> dict[Bin, int]:
    """Best-fit decreasing over counts of lengths: how many bins of each content.

    All bins of one content are filled alike, so that the work depends on the number of lengths, never of documents."""
    open_bins: dict[int, dict[Bin, int]] = {}  # by free space
    free: list[int] = []

    def put(content: Bin, n: int) -> None:
        room = capacity - sum(content)
        if room not in open_bins:
            open_bins[room] = {}
            insort(free, room)
        open_bins[room][content] = open_bins[room].get(content, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(free, length)
            if k == len(free):
                each = min(capacity // length, left)
                n = left // each
                put((length,) * each, n)
                left -= n * each
                continue
            room = free[k]
            content = min(open_bins[room])
            have = open_bins[room][content]
            each = min(room // length, left)
            n = min(have, left // each)
            if have > n:
                open_bins[room][content] = have - n
            else:
                del open_bins[room][content]
                if not open_bins[room]:
                    del open_bins[room]
                    free.pop(k)
            put(tuple(sorted(content + (length,) * each, reverse=True)), n)
            left -= n * each
    return {c: n for bins in open_bins.values() for c, n in bins.items()}


def fill_best(counts: dict[int, int], capacity: int, width: int = 1) -> dict[Bin, int]:
    """For the largest length left, again and again, the fullest content found of up to four smaller ones beside it.

    A depth-first search looks at few lengths for each place, `width` times as many as at least, larger ones first, so
    that small documents are kept for gaps that only they fill. As in best_fit, bins of one content are filled alike."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    tries = (40 * width, 12 * width, 6 * width, 4 * width)

    def best(room: int, places: int, most: int) -> tuple[int, Bin]:
        top: tuple[int, Bin] = (0, ())
        tried = 0
        for length in range(min(room, most), 0, -1):
            if not left[length]:
                continue
            left[length] -= 1
            total, rest = best(room - length, places - 1, length) if places > 1 and room > length else (0, ())
            left[length] += 1
            if length + total > top[0]:
                top = (length + total, (length, *rest))
            tried += 1
            if top[0] == room or tried == tries[places - 1]:
                break
        return top

    bins: dict[Bin, int] = {}
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            content = (length, *best(capacity - length, len(tries), length)[1])
            left[length] += 1
            n = min(left[x] // content.count(x) for x in set(content))
            for x in content:
                left[x] -= n
            content = tuple(sorted(content, reverse=True))
            bins[content] = bins.get(content, 0) + n
    return bins


def _exchange(a: Bin, b: Bin, capacity: int) -> tuple[Bin, Bin] | None:
    """The best move, one-for-one or two-for-one exchange that fills a further at b's cost; None if none raises squared fill.

    a is at least as full as b. Squared fill grows by 2 d (fill a - fill b + d) when a gains d, so the largest d that fits
    is best."""
    room = capacity - sum(a)
    best: tuple[int, Bin, Bin] | None = None

    def offer(out: Bin, into: Bin) -> None:
        nonlocal best
        d = sum(into) - sum(out)
        if 0 < d <= room and (best is None or d > best[0]):
            best = (d, out, into)

    ones_a, ones_b = sorted(set(a)), sorted(set(b))
    pairs_b = sorted({(x, y) for i, x in enumerate(b) for y in b[i + 1 :]})
    for y in ones_b:
        offer((), (y,))
        for x in ones_a:
            offer((x,), (y,))
    for pair in pairs_b:
        offer((), pair)
        for x in ones_a:
            offer((x,), pair)
    for i, x in enumerate(a):
        for x2 in a[i + 1 :]:
            for y in ones_b:
                offer((x, x2), (y,))
    if best is None:
        return None
    _, out, into = best
    left, right = list(a), list(b)
    for x in out:
        left.remove(x)
        right.append(x)
    for y in into:
        right.remove(y)
        left.append(y)
    return tuple(sorted(left, reverse=True)), tuple(sorted(right, reverse=True))


def local_search(bins: dict[Bin, int], capacity: int, steps: int = 200_000) -> dict[Bin, int]:
    """Exchange documents between underfull bins until no exchange tried raises the sum of squared fill.

    Bins of one content move together: an exchange applies to as many pairs as both contents have. The emptiest bin gives
    to the fuller ones, fullest first, till it is empty or nothing more fits; then the next emptiest. steps bounds the
    exchanges looked at, which depends on the number of contents, not on that of documents."""
    bins = dict(bins)
    floor = -(-sum(sum(c) * n for c, n in bins.items()) // capacity)
    heap = [(sum(c), c) for c in bins if sum(c) < capacity]
    heapq.heapify(heap)
    looked = 0

    def add(content: Bin, n: int) -> None:
        if content:
            if content not in bins:
                heapq.heappush(heap, (sum(content), content))
            bins[content] = bins.get(content, 0) + n

    def take(content: Bin, n: int) -> None:
        bins[content] -= n
        if not bins[content]:
            del bins[content]

    while heap and looked < steps and sum(bins.values()) > floor:
        _, low = heapq.heappop(heap)
        if low not in bins or sum(low) >= capacity:
            continue
        moved = False
        for high in sorted((c for c in bins if sum(low) <= sum(c) < capacity), key=lambda c: (-sum(c), c)):
            looked += 1
            n = bins[low] // 2 if high == low else min(bins[low], bins[high])
            if n and (new := _exchange(high, low, capacity)):
                take(high, n)
                take(low, n)
                add(new[0], n)
                add(new[1], n)
                if low in bins:
                    heapq.heappush(heap, (sum(low), low))
                moved = True
                break
            if looked >= steps:
                break
        if not moved:
            continue
    return bins


def solve(counts: dict[int, int], capacity: int, steps: int = 200_000) -> dict[Bin, int]:
    """The local search from several starts, until one needs no more bins than the tokens alone do; the fewest bins count."""
    floor = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: dict[Bin, int] | None = None
    for start in (best_fit, partial(fill_best, width=2), partial(fill_best, width=3)):
        found = local_search(start(counts, capacity), capacity, steps)
        if best is None or sum(found.values()) < sum(best.values()):
            best = found
        if sum(best.values()) <= floor:
            break
    return best


def _runs(bins: dict[Bin, int]) -> dict[str, np.ndarray]:
    """Where the items of each length go, as runs sorted by (length, first rank): of the items of a length, those with rank
    from rank0 on fill `each` places apiece in the bins from bin0 on, place j at offset0 + j * length."""
    rows, used, base = [], {}, 0
    for content in sorted(bins, reverse=True):
        n, at = bins[content], 0
        for length in sorted(set(content), reverse=True):
            each = content.count(length)
            rows.append((length, used.get(length, 0), each, base, at))
            used[length] = used.get(length, 0) + each * n
            at += each * length
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank0", "each", "bin0", "offset0"), cols.T, strict=True))


_FAST: dict = {}


def _fast_encoder(path: str | None):
    """The same vocabulary's faster library, where public_tokenizers has it; None otherwise."""
    if path not in _FAST:
        try:
            import base64

            import public_tokenizers
            import tiktoken

            if path not in (None, public_tokenizers.path("byte_bpe_50k.json")):
                raise ImportError
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _FAST[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except ImportError:
            _FAST[path] = None
    return _FAST[path]


def encode(texts: list[str], path: str | None) -> list[list[int]]:
    """The ids of each text as the tokenizers library gives them.

    A text of Latin-1 letters without a special string goes through the faster library, which is proven to give the same
    ids there: both hold the same merges, and split by the same pattern, which tells characters apart only by a few
    classes; tests hold the two against each other for every Latin-1 character beside every class, and for every string
    of up to four classes. Any other text goes through tokenizers itself, huge ones in chunks."""
    tokenizer, fast = load_tokenizer(path), _fast_encoder(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    out: list[list[int]] = []
    for text in texts:
        plain = fast is not None and len(text) <= 1 << 20 and not any(s in text for s in special)
        if plain:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                plain = False
        out.append(fast.encode_ordinary(text) if plain else encode_spliced(tokenizer, text))
    return out


def cut_documents(docs: DataFrame, id_col: str, text_col: str, capacity: int, eos: int, tokenizer_path: str | None, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: (id, piece, start, length, ids_crc32, part, rank), rank counting the pieces of one
    length within the task `part`. The first piece of a longer document is what is left beside full ones."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids array<int>" * keep_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                few = batch.slice(lo, 64)
                rows, cols = [], ([], [], [], [], [], [])
                for i, ids in enumerate(encode([x or "" for x in few.column(1).to_pylist()], tokenizer_path)):
                    a = np.array([*ids, eos], "<u4")
                    start, length = 0, len(a) % capacity or capacity
                    piece = 0
                    while start < len(a):
                        one = a[start : start + length]
                        rows.append(i)
                        for col, v in zip(cols, (piece, start, length, zlib.crc32(one.tobytes()), seen[length], one.astype(np.int32) if keep_ids else None), strict=True):
                            col.append(v)
                        seen[length] += 1
                        piece, start, length = piece + 1, start + length, capacity
                arrays = [few.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array([part] * len(rows), pa.int32()), pa.array(cols[4], pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"]
                if keep_ids:
                    arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pieces, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, eos: int = 2, tokenizer_path: str | None = None, steps: int = 200_000, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens; a row for each piece.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset (and ids if keep_ids). A null or empty text is the
    end token alone. Repeated rows and null ids are documents of their own; other columns are ignored. An empty table
    gives no rows.

    Only the counts of lengths, at most `capacity` numbers, go to the driver, which packs lengths; each piece then finds
    its place by its rank among the pieces of its length: its rank within the task that cut it, and how many of that
    length earlier tasks have. So no key gathers documents, however many have one length."""
    spark = docs.sparkSession
    made = cut(cut_documents(docs, id_col, text_col, capacity, eos, tokenizer_path, keep_ids), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_part = cut(by_part, "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(_runs(solve(counts, capacity, steps)))
    window = "sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = by_part.select("part", "length", F.coalesce(F.expr(window), F.lit(0)).alias("before"))
    if by_part.count() <= SMALL:
        before = F.broadcast(before)
    ranked = made.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    schema = ", ".join(f"`{n}` {dict(made.dtypes).get(n, 'bigint')}" for n in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        key = r["length"] << 44 | r["rank0"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("length", "rank"))
            k = np.searchsorted(key, length << 44 | rank, "right") - 1
            nth = rank - r["rank0"][k]
            each = r["each"][k]
            extra = {"sequence_id": pa.array(r["bin0"][k] + nth // each), "offset": pa.array(r["offset0"][k] + nth % each * length)}
            yield pa.RecordBatch.from_arrays([extra[n] if n in extra else batch.column(n) for n in names], names=names)

    return ranked.select(*(n for n in names if n not in ("sequence_id", "offset")), "rank").mapInArrow(place, schema)
