"""Near duplicates: an exact Jaccard self-join of word shingles by T-occurrence search, and the components of its links."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SMALL, attach, cut, drop, grams, mix, slices, small, text_bytes, words

#: Words are separated by the ASCII white space 0x20 and 0x09 to 0x0D alone.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, 9, 10, 11, 12, 13]] = False
#: Documents of one block of the search, and shingles of all of them, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; of a shorter text, one for all its words; none of none."""
    for s, _ in ranked_sets(data, offsets, k, None):
        yield s


def ranked_sets(data: np.ndarray, offsets: np.ndarray, k: int, order: Order | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The sets of shingle_sets, each with the places of its shingles in the order."""
    for lo, hi in slices(offsets):
        h, _, counts = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WORD_BYTES)
        g = grams(h, k)
        weight = order.word_weights(h) if order else None
        at = 0
        for n in counts.tolist():
            if n >= k:
                s, first = np.unique(g[at : at + n - k + 1], return_index=True)
                if order:
                    total = np.concatenate([[0], np.cumsum(weight[at : at + n])])
                    yield s, order.places(s, (total[k:] - total[:-k])[first])
                else:
                    yield s, None
            else:
                s = grams(h[at : at + n], n) if n else np.zeros(0, np.uint64)
                yield s, np.zeros(len(s), np.uint64)
            at += n


class Order:
    """An order of shingles, those that few documents have first: by whether they were often met, then by their words.

    It only sets which shingles are looked at first, never which documents link, so any counts are right, and those of a
    sample do."""

    def __init__(self, common: np.ndarray, word: np.ndarray, n_word: np.ndarray) -> None:
        by = np.argsort(word)
        self.common, self.word = np.sort(common), word[by]
        self.weight = np.round(256 * np.log2(1 + n_word[by])).astype(np.int64)

    def word_weights(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[k] == h, self.weight[k], 0)

    def places(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        place = np.minimum(weight, (1 << 17) - 1).astype(np.uint64) << np.uint64(46) | mix(s) >> np.uint64(18)
        if len(self.common):
            known = self.common[np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)] == s
            place |= known.astype(np.uint64) << np.uint64(63)
        return place


class Threshold:
    """Jaccard similarity of at least percent / 100, in whole numbers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def least(self, n: int) -> int:
        """The least overlap of a set of n with any that links with it."""
        return -(-n * self.percent // 100)

    def shared(self, n: int) -> int:
        """How many elements that are looked at a set of n shares with any it links with, at least.

        With n - least(n) + 1 + n // 20 elements of each looked at, sets that link share 1 + n // 20 of these for the
        larger n, or one less where rounding has it so."""
        return max(1, n // 20)

    def prefix(self, n: int) -> int:
        """Of n elements in a fixed order, how many to look at."""
        return min(n, n - self.least(n) + 1 + n // 20)

    def overlap(self, n: int, m: int) -> int:
        """The least overlap for sets of n and m to link."""
        return -(-(n + m) * self.percent // (100 + self.percent))


def divide_skip(lists: list[list[int]], need: int, mu: float = 0.01) -> dict[int, int]:
    """T-occurrence: the ids that at least `need` of the ascending lists hold, with how many do.

    The longest lists are set aside; the short ones are merged by a heap, skipping ids that cannot reach what the long
    lists leave to reach, and each candidate is then looked up in the long lists by binary search."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < need:
        return {}
    n_long = min(need - 1, int(need / (mu * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    floor = need - n_long
    found: dict[int, int] = {}
    at = [0] * len(short)
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= floor:
        top = heap[0][0]
        same = []
        while heap and heap[0][0] == top:
            same.append(heapq.heappop(heap)[1])
        if len(same) >= floor:
            count = len(same)
            for k, x in enumerate(long):
                if count + len(long) - k < need:
                    break
                p = bisect_left(x, top)
                count += p < len(x) and x[p] == top
            if count >= need:
                found[top] = count
            jump = top + 1
        else:  # take enough off the heap that what is left on it and the next top can't be missed
            while heap and len(same) < floor - 1:
                same.append(heapq.heappop(heap)[1])
            if not heap:
                break
            jump = max(top + 1, heap[0][0])
        for i in same:
            at[i] = bisect_left(short[i], jump, at[i])
            if at[i] < len(short[i]):
                heapq.heappush(heap, (short[i][at[i]], i))
    return found


class Groups:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, labels: np.ndarray) -> None:
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.root = first[inverse].astype(np.int64)

    def join(self, a: int, b: int) -> bool:
        x, y = int(self.root[a]), int(self.root[b])
        if x == y:
            return False
        self.root[self.root == max(x, y)] = min(x, y)
        return True


def link_block(sets: list[np.ndarray], groups: Groups, rule: Threshold, indexed: np.ndarray, asked: np.ndarray, guess: np.ndarray) -> list[tuple[int, int]]:
    """Links between asked and indexed sets of different groups, until the groups are what all links make of them.

    sets come in order of size. guess: for each set one (or -1) that it probably links with, which is tried first. A set
    that is both asked and indexed meets each other such once. Pairs of one group need no test, as their link would join
    nothing."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(n), size)
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(every)))
    kept = np.repeat(length > 1, length)  # an element of one set alone is in no inverted list
    owner, length = owner[kept], length[length > 1]
    end = np.cumsum(length)
    begin = end - length
    of = np.repeat(np.arange(len(length)), length)
    by = np.argsort(owner, kind="stable")
    lists_of, edge = of[by], np.searchsorted(owner[by], np.arange(n + 1))
    edges: list[tuple[int, int]] = []

    for q in np.flatnonzero(asked & (guess >= 0)).tolist():
        g = int(guess[q])
        need = rule.overlap(int(size[q]), int(size[g]))
        if groups.root[q] != groups.root[g] and min(size[q], size[g]) >= need and len(np.intersect1d(sets[q], sets[g], assume_unique=True)) >= need and groups.join(q, g):
            edges.append((q, g))
    for q in np.flatnonzero(asked).tolist():
        m, mine = int(size[q]), lists_of[edge[q] : edge[q + 1]]
        if len(mine) < rule.least(m):
            continue
        # sets of a fitting size, of another group, and not met when they were asked themselves
        open_ = indexed & (groups.root != groups.root[q]) & (size * 100 >= m * rule.percent) & (size * rule.percent <= m * 100)
        if indexed[q]:
            open_[q:] &= ~asked[q:]
        if not open_.any():
            continue
        need = rule.overlap(m, int(size[open_].min()))
        counts = end[mine] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        docs, which = owner[at], np.repeat(np.arange(len(mine)), counts)
        docs, which = docs[open_[docs]], which[open_[docs]]
        cuts = np.flatnonzero(which[1:] != which[:-1]) + 1
        if len(cuts) + 1 < need or not len(docs):
            continue
        lists = [x.tolist() for x in np.split(docs, cuts)]
        for y, count in divide_skip(lists, need).items():
            if count >= rule.overlap(m, int(size[y])) and groups.join(q, y):
                edges.append((q, y))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b); label: the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then its label's own label, so that few rounds do
    for long chains; what a round makes is written to the shared folder."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = attach(both, labels.select(F.col("node").alias("b"), "label"), "b", spread="a").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = attach(step, labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", spread="node", how="left")
        new = cut(up.select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        drop(labels)
        labels = new
        if new.filter("was <> label").isEmpty():
            drop(both)
            return new.select("node", "label")


def by_component(rows: DataFrame, label: str, value: Column, spread: str, name: str, how: str = "left") -> DataFrame:
    """rows with `name`, the least value of all rows of their label, or null where a row is alone with it."""
    several = cut(rows.groupBy(label).agg(F.min(value).alias(name), F.count("*").alias("several_")).filter("several_ > 1").drop("several_"), "several")
    return attach(rows, several, label, spread, how)


def _order(rows: DataFrame, k: int, one_in: int, least: int, most: int) -> Order:
    """The order from one of `one_in` documents: at most `most` words and shingles that are there at least `least` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for lo, hi in slices(off):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                sets = list(shingle_sets(part, at, k))
                for kind, h in (("word", words(part, at, WORD_BYTES)[0]), ("shingle", np.concatenate(sets) if sets else np.zeros(0, np.uint64))):
                    values, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "h", "n"])

    some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(one_in)) == 0).select("text")
    counted = some.mapInArrow(count, "kind string, h bigint, n bigint").groupBy("kind", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = counted.orderBy(F.desc("n"), "h").limit(most).collect()
    of = {kind: np.array([(r["h"], r["n"]) for r in found if r["kind"] == kind], np.int64).reshape(-1, 2) for kind in ("word", "shingle")}
    return Order(of["shingle"][:, 0].copy().view(np.uint64), of["word"][:, 0].copy().view(np.uint64), of["word"][:, 1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, sample_one_in: int = 16, common_least: int = 8, common_most: int = 200_000) -> DataFrame:
    """A row for each row of docs: its id, n_shingles and component_id, the smallest id that it reaches by links.

    Words are runs of other than ASCII white space with A-Z lower-cased; a document's set holds its distinct k-word
    shingles, or its whole sequence of fewer words. Two documents link when 100 * intersection >= percent * union. Null
    and empty texts have no set and link with nothing: each is its own component. Null ids take part but are never the
    smallest; a component of such alone has a null component_id. Repeated rows keep a row each; other columns are ignored.

    Equal sets collapse into one node first, so that copies cost a row each. Nodes that share one of the shingles which a
    link needs (the prefix in an order with common shingles last) meet in blocks: first families, each in blocks of
    bounded size with its first member in every one, then, for shingles whose nodes are still in several components, each
    node in the blocks of the others. In a block, T-occurrence search finds the links between different components. So a
    family of any size costs a few rows for each member as long as its members link with its first; there is no cap."""
    found = _classes(docs, id_col, text_col, k, percent, sample_one_in, common_least, common_most)
    named = by_component(found.filter("n > 0"), "label", F.col("id"), "row_key", "first_id").unionByName(found.filter("n = 0").withColumn("first_id", F.col("id")))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first_id", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, sample_one_in: int = 16, common_least: int = 8, common_most: int = 200_000) -> DataFrame:
    """The rows of docs, with all their columns, without all but one of each component: that with the smallest id.

    Without any id in a component, one row of it stays all the same; of rows repeated with id and text, one. Rows with no
    words all stay."""
    found = _classes(docs, id_col, text_col, k, percent, sample_one_in, common_least, common_most).filter("n > 0")
    several = by_component(found, "label", F.struct(F.col("id").isNull().alias("null"), "id", "row_key"), "row_key", "first", how="inner")
    marked = cut(several.groupBy("label", "row_key").agg(F.count("*").alias("copies"), F.min("first.row_key").alias("first_key")).select("row_key", "copies", (F.col("row_key") == F.col("first_key")).alias("stays")), "marked")
    gone, again = marked.filter("not stays").select("row_key"), marked.filter("stays and copies > 1").select("row_key")

    def side(keys: DataFrame) -> DataFrame:
        return small(cut(keys, "keys"))

    all_rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    kept = all_rows.join(side(gone), "row_key", "left_anti")
    once = kept.join(side(again), "row_key", "left_anti")
    return once.unionByName(kept.join(side(again), "row_key", "left_semi").dropDuplicates(["row_key"])).select("row.*")


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, sample_one_in: int, common_least: int, common_most: int) -> DataFrame:
    """(id, row_key, n, label) of each row of docs; label: its component's smallest node, null without words."""
    spark = docs.sparkSession
    rule = Threshold(percent)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(_order(rows, k, sample_one_in, common_least, common_most))
    id_type = rows.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for s, place in ranked_sets(*text_bytes(batch.column(1)), k, order.value):
                sizes.append(len(s))
                nodes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                p = rule.prefix(len(s)) if len(s) else 0
                keys.append((s[np.argpartition(place, p - 1)[:p]] if p < len(s) else s).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "row_key", "n", "node", "keys"])

    described = cut(rows.withColumn("row_key", F.xxhash64("id", "text")).mapInArrow(describe, f"id {id_type}, row_key bigint, n bigint, node bigint, keys array<bigint>"), "sets")

    # keys that several nodes have, with those nodes
    keys = described.filter("n > 0").select(F.explode("keys").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("key", "first")
    which = described.filter("n > 0").groupBy("node").agg(F.min("row_key").alias("row_key"), F.min("n").alias("n"))
    shared = cut(shared, "shared")
    met = cut(attach(keys, shared.hint("merge"), "key", spread="node", stay=False).distinct(), "met")  # one plan at every size
    drop(shared)
    earlier = []
    for _ in range(2):  # what shares too few keys with all others together links with none of them
        enough = met.groupBy("node").agg(F.count("*").alias("keys")).join(which, "node").filter(F.col("keys") >= F.greatest(F.lit(1), F.floor(F.col("n") / 20))).select("node")
        rest = met.select("key", "node").join(enough, "node")
        shared = rest.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("key", "first")
        shared = cut(shared, "shared")
        earlier += [met, shared]
        met = cut(attach(rest, shared.hint("merge"), "key", spread="node", stay=False), "met")
    drop(*earlier)

    # a family: what shares a key with its first node; large ones in several blocks
    family = met.groupBy("node").agg(F.min("first").alias("family"))
    members = cut(family.join(which, "node"), "members")
    count = cut(members.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")), "families")
    parts = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES))
    total = count.agg(F.sum("members").alias("members"), F.sum("shingles").alias("shingles")).first()
    n_active = total["members"] or 0
    n_small = max(1, -(-n_active // BLOCK), -(-(total["shingles"] or 0) // BLOCK_SHINGLES))
    large = cut(count.select("family", parts.alias("parts")).filter("parts > 1"), "large")
    active = attach(members, large, "family", spread="node", how="left")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("family"), F.lit(n_small))).otherwise(n_small + F.pmod(F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))), F.lit(1 << 50)))
    placed = cut(active.select("node", "family", "row_key", "n", shard.alias("shard")), "placed")
    heads = placed.select("family", "shard").distinct().select(F.col("family").alias("node"), "family", "shard")
    first = placed.select("node", "family", "shard").unionByName(heads).distinct().select("*", F.lit(True).alias("indexed"), F.lit(True).alias("asked"), F.col("node").alias("label"))
    source = rows.select(F.xxhash64("id", "text").alias("row_key"), "text")
    wanted = placed.select("node", "row_key")
    texts = cut(source.join(F.broadcast(wanted) if n_active <= SMALL else wanted, "row_key").select("node", "text"), "texts")
    labels = components(_search(texts, first, k, rule))

    # keys whose nodes are in several components and blocks yet
    known = placed.join(labels, "node", "left").select("node", "shard", "n", F.coalesce("label", "node").alias("label"))
    open_keys = met.select("key", "node").join(known.select("node", "shard", "label"), "node").groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.min("shard").alias("s1"), F.max("shard").alias("s2")).filter("l1 < l2 and s1 < s2").select("key")
    open_keys = cut(open_keys, "open")
    left = cut(met.select("key", "node").join(small(open_keys), "key").join(known, "node").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))), "left")
    if not left.isEmpty():
        # what two nodes of different blocks share are open keys alone, so as many of these as a link needs
        enough = F.greatest(F.lit(1), F.floor(F.col("n") / 20))
        there = left.select("key", F.col("band").alias("band2"), F.col("shard").alias("to"), F.col("label").alias("label2")).groupBy("key", "band2", "to").agg(F.min("label2").alias("low"), F.max("label2").alias("high"))
        met_by = (F.col("to") < F.col("shard")) & (F.abs(F.col("band") - F.col("band2")) <= 1) & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
        some = left.join(left.groupBy("node").agg(F.count("*").alias("keys"), F.min("n").alias("n")).filter(F.col("keys") >= enough).select("node"), "node")
        guests = cut(some.join(there, "key").filter(met_by).select("node", "n", "label", "to", "key").distinct().groupBy("node", "n", "label", "to").agg(F.count("*").alias("keys")).filter(F.col("keys") >= enough).select("node", "n", "label", "to"), "guests")
        rooms = cut(guests.groupBy("to").agg(F.ceil(F.greatest(F.count("*") / (2 * BLOCK), F.sum("n") / (2 * BLOCK_SHINGLES))).alias("rooms")), "rooms")
        room = F.pmod(F.xxhash64("node"), F.col("rooms"))
        asking = guests.join(rooms, "to").select("node", F.lit(None).cast("bigint").alias("family"), F.xxhash64("to", room).alias("shard"), F.lit(False).alias("indexed"), F.lit(True).alias("asked"), "label")
        owners = known.join(rooms, known["shard"] == rooms["to"]).withColumn("room", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rooms") - 1)))
        hosts = owners.select("node", F.lit(None).cast("bigint").alias("family"), F.xxhash64("to", "room").alias("shard"), F.lit(True).alias("indexed"), F.lit(False).alias("asked"), "label")
        more = _search(texts, hosts.unionByName(asking), k, rule)
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more.select("a", "b")))

    of_row = attach(described.select("id", "row_key", "n", "node"), labels, "node", spread="row_key", how="left")
    named = cut(of_row.select("id", "row_key", "n", F.coalesce("label", "node").alias("label")), "named")
    drop(described, met, members, count, large, placed, texts, left, open_keys)
    return named


def _search(texts: DataFrame, places: DataFrame, k: int, rule: Threshold) -> DataFrame:
    """Edges (a, b) found in each shard. texts: (node, text). places: (node, family, shard, indexed, asked, label)."""

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = np.asarray(table["node"]).astype(np.int64)
        _, once = np.unique(node, return_index=True)
        table, node = table.take(pa.array(once)), node[once]
        sets = list(shingle_sets(*text_bytes(table["text"]), k))
        order = np.argsort(np.array([len(s) for s in sets]), kind="stable")
        node, sets = node[order], [sets[i] for i in order]
        indexed, asked = (np.asarray(table[c].to_numpy(zero_copy_only=False), bool)[order] for c in ("indexed", "asked"))
        place = {n: i for i, n in enumerate(node.tolist())}
        guess = np.array([place.get(f, -1) for f in table["family"].take(pa.array(order)).to_pylist()], np.int64)
        groups = Groups(np.asarray(table["label"]).astype(np.int64)[order])
        edges = np.array(link_block(sets, groups, rule, indexed, asked, guess), np.int64).reshape(-1, 2)
        return pa.table({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    joined = places.join(texts, "node").select("shard", "node", "family", "indexed", "asked", "label", "text")
    return cut(joined.groupBy("shard").applyInArrow(search, "a bigint, b bigint"), "links")
