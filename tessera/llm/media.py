"""Copies among images: local descriptors at multiscale corners, Hamming-table joins, and geometric consensus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tessera.llm.common import SMALL, attach, cut, drop, mix, tune
from tessera.llm.jaccard_join import Groups, by_component, components

BITS, RADIUS = 256, 13
#: Hamming tables, the bytes of a descriptor that each reads, and the orders in which an image's first two keys make one.
TABLES, KEY_BYTES, ORDERS = 16, 6, 16
#: The weight of keys (a double key's is two) from which on two images are held against each other.
ENOUGH = 2
#: Images of one block of the search, and corners of all of them, about.
BLOCK, BLOCK_CORNERS = 512, 1 << 18
#: Pixels of a cell's side, its strongest corners that are kept, and pixels of the side of what is looked at together.
CELL, PER_CELL, TILE = 32, 6, 512
SCALES = (1.0, 1.3, 1.7)
_R = np.random.default_rng(41)
#: Pairs of points within a patch, for the binary tests.
_TESTS = np.clip(_R.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
_GRID = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1), indexing="ij"), -1)
_DISC = (_GRID**2).sum(-1) <= RADIUS**2
#: The bytes that each table reads.
_BYTES = np.array([np.sort(_R.permutation(BITS // 8)[:KEY_BYTES]) for _ in range(TABLES)])
_U = np.uint64
_PLACES = _U(256) ** np.arange(KEY_BYTES, dtype=np.uint64)
_SEEDS = _R.integers(0, 1 << 64, ORDERS, np.uint64)


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey image of bytes as binary PGM."""
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_pgm(raw: bytes | None) -> np.ndarray | None:
    """The image of a binary PGM with one byte a pixel; None for anything else."""
    try:
        kind, width, height, most, body = (raw or b"").split(None, 4) if (raw or b"").count(b"\n") == 0 else _header(raw)
        shape = int(height), int(width)
        if kind != b"P5" or int(most) > 255 or min(shape) < 1 or len(body) < shape[0] * shape[1]:
            return None
        return np.frombuffer(body, np.uint8, shape[0] * shape[1]).reshape(shape)
    except ValueError:
        return None


def _header(raw: bytes) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    head, at = [], 0
    while len(head) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError
        head.append(raw[at:end])
        at = end
    return (*head, raw[at + 1 :])


def _smooth(a: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        p = np.pad(a, 1, mode="edge")
        a = (p[:-2] + 2 * p[1:-1] + p[2:])[:, 1:-1] / 4
        p = np.pad(a, 1, mode="edge")
        a = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:])[1:-1] / 4
    return a


def _sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at points, which are clipped into the image."""
    y, x = np.clip(y, 0, a.shape[0] - 1.001), np.clip(x, 0, a.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    u, v = y - i, x - j
    return (1 - u) * ((1 - v) * a[i, j] + v * a[i, j + 1]) + u * ((1 - v) * a[i + 1, j] + v * a[i + 1, j + 1])


def _tiles(image: np.ndarray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(strength, y, x, descriptor and angle) of the corners of an image shrunk by scale, tile by tile.

    A tile is looked at with a margin that all filters and patches stay within, so that tiles don't show in the result."""
    h, w = int(image.shape[0] / scale), int(image.shape[1] / scale)
    margin = RADIUS + 11
    if min(h, w) < 2 * RADIUS + 3:
        return
    for top in range(0, h, TILE):
        for side in range(0, w, TILE):
            y0, x0 = max(0, top - margin), max(0, side - margin)
            y1, x1 = min(h, top + TILE + margin), min(w, side + TILE + margin)
            ys, xs = ((np.arange(a, b) + 0.5) * scale - 0.5 for a, b in ((y0, y1), (x0, x1)))
            i, j = max(0, int(ys[0])), max(0, int(xs[0]))
            part = np.pad(image[i : int(ys[-1]) + 3, j : int(xs[-1]) + 3].astype(np.float64), ((0, 1), (0, 1)), mode="edge")
            a = _smooth(_sample(part, *np.meshgrid(ys - i, xs - j, indexing="ij")), 2)
            gy, gx = np.gradient(a)
            p, q, r = _smooth(gy * gy, 2), _smooth(gx * gx, 2), _smooth(gy * gx, 2)
            strong = (p + q) / 2 - np.sqrt(((p - q) / 2) ** 2 + r * r)
            around = np.pad(strong, 2, constant_values=-1)
            around = reduce(np.maximum, (around[k : k + a.shape[0]] for k in range(5)))
            around = reduce(np.maximum, (around[:, k : k + a.shape[1]] for k in range(5)))
            own = np.zeros(a.shape, bool)
            lo, hi = np.maximum([top, side], RADIUS), np.minimum([top + TILE, side + TILE], [h - RADIUS, w - RADIUS])
            own[lo[0] - y0 : max(0, hi[0] - y0), lo[1] - x0 : max(0, hi[1] - x0)] = True
            y, x = np.nonzero((strong == around) & (strong > 1e-3) & own)
            value = strong[y, x]
            keep = _strongest(value, (y + y0) * scale, (x + x0) * scale)  # no others can be among the image's
            y, x, value = y[keep], x[keep], value[keep]
            for at in range(0, len(y), 512):
                some = slice(at, at + 512)
                codes, angles = _codes(a, y[some], x[some])
                yield value[some], (y[some] + y0) * scale, (x[some] + x0) * scale, np.column_stack([codes, angles.astype("<f4").view(np.uint8).reshape(-1, 4)])


def _strongest(value: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The indices of the PER_CELL strongest of each cell, ties by place."""
    cell = (y // CELL).astype(np.int64) << 32 | (x // CELL).astype(np.int64)
    order = np.lexsort((x, y, -value, cell))
    first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[nth < PER_CELL]


def _codes(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed tests of the patches around some points, and the angles by which they are turned."""
    patch = a[y[:, None, None] + _GRID[..., 0], x[:, None, None] + _GRID[..., 1]]
    patch = (patch - patch.mean((1, 2), keepdims=True)) * _DISC
    angle = np.arctan2((patch * _GRID[..., 0]).sum((1, 2)), (patch * _GRID[..., 1]).sum((1, 2)))
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    v = _sample(a, y[:, None, None] + s * _TESTS[..., 1] + c * _TESTS[..., 0], x[:, None, None] + c * _TESTS[..., 1] - s * _TESTS[..., 0])
    return np.packbits(v[..., 0] < v[..., 1], axis=1), angle


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, descriptors): y, x, scale and angle of the strongest corners, and BITS tests as bytes.

    Corners are maxima of the smaller eigenvalue of the gradients' moments, at several scales; of each cell of CELL pixels
    the PER_CELL strongest over all scales stay, so that their number grows with the image and a small part of it keeps its
    own. The patch's centre of brightness gives the angle by which its tests are turned, so that turned copies have the
    same ones."""
    found = [(v, y, x, d, np.full(len(v), scale)) for scale in SCALES for v, y, x, d in _tiles(image, scale)]
    if not found:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    value, y, x, d, scale = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = _strongest(value, y, x)
    angle = np.ascontiguousarray(d[keep, BITS // 8 :]).view("<f4").ravel()
    return np.column_stack([y[keep], x[keep], scale[keep], angle]).astype(np.float32), np.ascontiguousarray(d[keep, : BITS // 8])


def match(a: np.ndarray, b: np.ndarray, hamming: int) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors of a and b that are each other's nearest, where at most `hamming` tests differ: indices into a and b."""
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return none, none
    left, right = a.view(np.uint64), b.view(np.uint64)
    step = max(1, (1 << 20) // len(right))
    near, far = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    back, back_far = np.zeros(len(right), np.int64), np.full(len(right), BITS + 1)
    for lo in range(0, len(left), step):
        d = np.bitwise_count(left[lo : lo + step, None] ^ right[None]).sum(2, dtype=np.int64)
        near[lo : lo + step], far[lo : lo + step] = d.argmin(1), d.min(1)
        closer = d.min(0) < back_far
        back[closer], back_far[closer] = lo + d.argmin(0)[closer], d.min(0)[closer]
    i = np.flatnonzero((far <= hamming) & (back[near] == np.arange(len(left))))
    return i, near[i]


def consensus(a: np.ndarray, b: np.ndarray, tolerance: float = 3.0, enough: int | None = None) -> int:
    """The most matches that one similarity transform explains; the search ends once there are enough.

    a, b: points (y, x, scale, angle) of matched corners. Each match is a transform by itself: its scales' ratio, its
    angles' difference and its places; all are tried. A match agrees with one by its place, and by turning and growing
    about as much. Matches at one place count once, on either side."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    turn, grow = b[:, 3] - a[:, 3], b[:, 2] / a[:, 2]
    place = [(np.round(p[:, 0] / 2).astype(np.int64) << 32 | np.round(p[:, 1] / 2).astype(np.int64)) for p in (a, b)]
    best = 0
    for lo in range(0, len(a), 256):
        some = slice(lo, lo + 256)
        t, g = turn[some, None], grow[some, None]
        c, s = np.cos(t) * g, np.sin(t) * g
        dy, dx = a[None, :, 0] - a[some, None, 0], a[None, :, 1] - a[some, None, 1]
        off = np.hypot(b[some, None, 0] + c * dy + s * dx - b[None, :, 0], b[some, None, 1] - s * dy + c * dx - b[None, :, 1])
        good = (off <= tolerance * np.maximum(1, g)) & (np.cos(turn[None] - t) > 0.9) & (np.abs(np.log(grow[None] / g)) < 0.4)
        counts = good.sum(1)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= best:
                break
            best = max(best, min(len(set(p[good[k]].tolist())) for p in place))
            if enough and best >= enough:
                return best
    return best


def table_keys(codes: np.ndarray) -> np.ndarray:
    """The distinct keys of an image's descriptors in all tables."""
    picked = (codes[:, _BYTES].astype(np.uint64) * _PLACES).sum(2, dtype=np.uint64)
    return np.unique(mix(picked + mix(np.arange(1, TABLES + 1, dtype=np.uint64))))


def double_keys(keys: np.ndarray) -> np.ndarray:
    """For each of ORDERS orders one key made of an image's first two: two images have it in common as likely as, twice, a key."""
    if len(keys) < 2:
        return np.zeros(0, np.uint64)
    first = [np.partition(mix(keys ^ s), 1)[:2] for s in _SEEDS]
    return np.array([mix(mix(x[:1]) + x[1:] + s)[0] for x, s in zip(first, _SEEDS, strict=True)], np.uint64)


def find_image_copies(images: DataFrame, id_col: str = "id", image_col: str = "image", hamming: int = 40, least: int = 4) -> DataFrame:
    """A row for each row of images: its id, n_corners and class_id, the smallest id that it reaches by links.

    Images are binary PGM. Each is read once, in one pass that leaves its corners alone: no image is written or moved, and
    a task describes equal bytes once. Those are one image from the start. Two different images are held against each other
    if they share keys of the Hamming tables, and link when `least` corners match, with at most `hamming` differing tests
    each, under one similarity transform: cropped, turned, scaled, noisy or brightened copies do. As all corners of such
    images are compared, a few shared keys find a pair: tests hold at least 0.9 of the links that all pairs would give.

    Images that share two keys are held against each other, unless other links have made them one class before. Beside
    keys of one descriptor there are, for several orders of an image's keys, those of the first two together, which count
    twice. The search goes block by block (_verify): a key that many images have is looked at whole, none is dropped, and
    a large group of copies costs a few rows an image as long as its images link with its first. Images of different
    content with keys in common are all compared, as many as they are.
    Null, empty and undecodable images have no corners and link with nothing; repeated rows keep a row each and null ids
    are never the smallest; other columns are ignored."""
    id_type = images.schema[id_col].dataType
    rows = images.select(F.col(id_col).alias("id"), F.when(F.octet_length(image_col) > 0, F.xxhash64(F.sha2(image_col, 256))).alias("node"), F.col(image_col).alias("image"))

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            points, codes, size = [], [], []
            for node, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                image = decode_pgm(raw.as_py()) if node is not None and node not in seen else None
                seen.add(node)
                p, c = describe(image) if image is not None else ((), ())
                points.append(p.tobytes() if len(p) else None)
                codes.append(c.tobytes() if len(p) else None)
                size.append(len(p) or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(points, pa.binary()), pa.array(codes, pa.binary())], names=["id", "node", "n_corners", "points", "codes"])

    schema = StructType([StructField("id", id_type), StructField("node", LongType()), StructField("n_corners", LongType()), StructField("points", BinaryType()), StructField("codes", BinaryType())])
    tune(images.sparkSession)
    rows = cut(rows.mapInArrow(corners, schema), "images")
    found = cut(rows.filter("points is not null").drop("id").dropDuplicates(["node"]), "corners")
    links = cut(_verify(_candidates(found), found, hamming, least), "links")
    labels = components(links)
    n_corners = found.select("node", "n_corners")
    known = rows.select("id", "node").filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("first_id"))
    of_node = known.join(labels, "node", "left").join(n_corners, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = cut(by_component(of_node, "label", F.col("first_id"), "node", "class_id").select("node", F.coalesce("class_id", "first_id").alias("class_id"), "n_corners"), "classes")
    out = attach(rows.select("id", "node"), classes, "node", spread="id", how="left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_corners", F.lit(0).cast("bigint")).alias("n_corners"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def _candidates(found: DataFrame) -> DataFrame:
    """(node, n_corners, family, keys) of the images that share keys of weight two or more: those keys, and with which image
    the search begins. found: (node, n_corners, codes)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes in batch.column(2).to_pylist():
                keys = table_keys(np.frombuffer(codes, np.uint8).reshape(-1, BITS // 8))
                out.append(np.unique(np.concatenate([keys & ~_U(1), double_keys(keys) | _U(1)])).view(np.int64))  # double keys are odd
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out)], names=["node", "n_corners", "keys"])

    lists = cut(found.select("node", "n_corners", "codes").mapInArrow(emit, "node bigint, n_corners bigint, keys array<bigint>"), "keys")
    shared = cut(lists.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1").select("key", "first"), "shared")
    met = cut(_having(lists, shared), "met")
    drop(lists, shared)
    return met


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64)))


def _having(lists: DataFrame, table: DataFrame) -> DataFrame:
    """(node, n_corners, family, keys) of lists: an image's keys that are in table (key, first), if they weigh two or more.

    family: the smallest of the first images with which an image has at least half as much in common as with any of them.
    Of at most SMALL keys, the table is broadcast, so that images keep their rows; else keys are joined one by one."""

    def rows(batch: pa.RecordBatch, known: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        flat = batch.column(2).flatten().to_numpy()
        edge = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
        if known is None:
            first, hit = batch.column(3).flatten().to_numpy(), np.ones(len(flat), bool)
        else:
            at = np.minimum(np.searchsorted(known[:, 0], flat), len(known) - 1)
            first, hit = known[at, 1], known[at, 0] == flat
        for node, n, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), edge, edge[1:], strict=False):
            yield node, n, flat[lo:hi][hit[lo:hi]], first[lo:hi][hit[lo:hi]]

    def pick(known: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if known is None or len(known) else ():
            out = []
            for node, n, keys, first in rows(batch, known):
                weight = (keys & 1) + 1
                if weight.sum() >= ENOUGH:
                    which, at = np.unique(first, return_inverse=True)
                    total = np.bincount(at, weight)
                    out.append((node, n, int(which[np.argmax(2 * total >= total.max())]), np.sort(keys)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), _lists(list(cols[3]))], names=["node", "n_corners", "family", "keys"])

    schema = "node bigint, n_corners bigint, family bigint, keys array<bigint>"
    if table.count() <= SMALL:
        pairs = _numbers(table, "key", "first")
        sent = lists.sparkSession.sparkContext.broadcast(pairs[np.argsort(pairs[:, 0])])
        return lists.select("node", "n_corners", "keys").mapInArrow(lambda batches: pick(sent.value, batches), schema)
    both = attach(lists.select("node", "n_corners", F.explode("keys").alias("key")), table, "key", spread="node").groupBy("node", "n_corners").agg(F.collect_list(F.struct("key", "first")).alias("both"))
    return both.select("node", "n_corners", "both.key", "both.first").mapInArrow(lambda batches: pick(None, batches), schema)


def link_images(keys: list[np.ndarray], images: list[tuple[np.ndarray, np.ndarray]], groups: Groups, indexed: np.ndarray, asked: np.ndarray, guess: np.ndarray, hamming: int, least: int) -> list[tuple[int, int]]:
    """Links between asked and indexed images of different groups, until the groups are what all links make of them.

    Each two of different groups that share keys of weight two or more are held against each other, those that share most
    first; guess: for each image one (or -1) that is tried before. Pairs of one group need no test, as their link would
    join nothing. images: (points, codes)."""
    n = len(keys)
    every, owner = np.concatenate([*keys, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(n), [len(k) for k in keys])
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    edges: list[tuple[int, int]] = []

    def agree(q: int, y: int) -> None:
        (p, c), (r, d) = images[q], images[y]
        i, j = match(c, d, hamming)
        if len(i) >= least and consensus(p[i], r[j], enough=least) >= least and groups.join(q, y):
            edges.append((q, y))

    for q in np.flatnonzero(asked & (guess >= 0)).tolist():
        g = int(guess[q])
        if groups.root[q] != groups.root[g] and ((np.intersect1d(keys[q], keys[g], assume_unique=True) & 1) + 1).sum() >= ENOUGH:
            agree(q, g)
    for q in np.flatnonzero(asked).tolist():
        open_ = indexed & (groups.root != groups.root[q])
        if indexed[q]:
            open_[q:] &= ~asked[q:]  # met when they are asked themselves
        if not open_.any():
            continue
        begin, end = np.searchsorted(every, keys[q], "left"), np.searchsorted(every, keys[q], "right")
        counts = end - begin
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        total = np.bincount(owner[at], np.repeat((keys[q] & 1) + 1, counts), n)
        found = np.flatnonzero((total >= ENOUGH) & open_)
        for y in found[np.argsort(-total[found], kind="stable")].tolist():
            if groups.root[y] != groups.root[q]:
                agree(q, y)
    return edges


def _verify(met: DataFrame, found: DataFrame, hamming: int, least: int) -> DataFrame:
    """(a, b), a < b: links whose components are those of all links between images that share keys of weight two or more.

    Families meet in blocks of bounded size, large ones with their first image in every block. Then, for keys whose images
    are in several components and blocks yet, each image goes to the blocks of the others. So a key that many images have
    costs a row for each block where it is open, and not one for each pair."""
    count = cut(met.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_corners").alias("corners")), "families")
    parts = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("corners") / BLOCK_CORNERS))
    total = count.agg(F.sum("members").alias("members"), F.sum("corners").alias("corners")).first()
    n_small = max(1, -(-(total["members"] or 0) // BLOCK), -(-(total["corners"] or 0) // BLOCK_CORNERS))
    large = cut(count.select("family", parts.alias("parts")).filter("parts > 1"), "large")
    active = attach(met.select("node", "n_corners", "family"), large, "family", spread="node", how="left")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("family"), F.lit(n_small))).otherwise(n_small + F.pmod(F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))), F.lit(1 << 50)))
    placed = cut(active.select("node", "n_corners", "family", shard.alias("shard")), "placed")
    heads = placed.select("family", "shard").distinct().select(F.col("family").alias("node"), "family", "shard")
    first = placed.select("node", "family", "shard").unionByName(heads).distinct().select("*", F.lit(True).alias("indexed"), F.lit(True).alias("asked"), F.col("node").alias("label"))
    made = _search(met, found, first, hamming, least)
    links = made.filter("key is null").select("a", "b")
    labels = components(links)

    # keys whose images are in several components and blocks yet
    of_key = attach(made.filter("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("shard")), labels, "node", spread="key", how="left")
    of_key = cut(of_key.groupBy("key", F.col("shard").alias("to")).agg(F.min(F.coalesce("label", "node")).alias("low"), F.max(F.coalesce("label", "node")).alias("high")), "of-key")
    open_keys = cut(of_key.groupBy("key").agg(F.min("low").alias("l1"), F.max("high").alias("l2"), F.min("to").alias("s1"), F.max("to").alias("s2")).filter("l1 < l2 and s1 < s2").select("key"), "open")
    there = cut(attach(of_key, open_keys, "key", spread="to"), "there")
    known = cut(placed.join(labels, "node", "left").select("node", "n_corners", "shard", F.coalesce("label", "node").alias("label")), "known")
    guests = cut(_guests(known.join(met.select("node", "keys"), "node"), there), "guests")
    if not guests.isEmpty():
        rooms = cut(guests.groupBy("to").agg(F.ceil(F.greatest(F.count("*") / (2 * BLOCK), F.sum("n_corners") / (2 * BLOCK_CORNERS))).alias("rooms")), "rooms")
        room = F.pmod(F.xxhash64("node"), F.col("rooms"))
        none = F.lit(None).cast("bigint").alias("family")
        asking = guests.join(rooms, "to").select("node", none, F.xxhash64("to", room).alias("shard"), F.lit(False).alias("indexed"), F.lit(True).alias("asked"), "label")
        owners = known.join(rooms, known["shard"] == rooms["to"]).withColumn("room", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rooms") - 1)))
        hosts = owners.select("node", none, F.xxhash64("to", "room").alias("shard"), F.lit(True).alias("indexed"), F.lit(False).alias("asked"), "label")
        links = links.union(_search(met, found, hosts.unionByName(asking), hamming, least, summed=False).select("a", "b"))
    drop(count, large, placed, of_key, open_keys, there, known)
    return links


def _guests(known: DataFrame, there: DataFrame) -> DataFrame:
    """(node, n_corners, label, to): the earlier blocks with which an image shares keys of weight two or more, where these
    have images of another class. known: (node, n_corners, shard, label, keys); there: (key, to, low, high), low and high
    being the first and the last class that a block's images with this key have.

    Of at most SMALL rows, there is broadcast, and an image's keys are summed where it lies; else they are joined."""
    if there.count() > SMALL:
        other = (F.col("to") < F.col("shard")) & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
        both = known.select("node", "n_corners", "shard", "label", F.explode("keys").alias("key")).join(there, "key").filter(other)
        return both.groupBy("node", "n_corners", "label", "to").agg(F.sum(F.col("key").bitwiseAND(F.lit(1)) + 1).alias("weight")).filter(F.col("weight") >= ENOUGH).drop("weight")
    table = _numbers(there, "key", "to", "low", "high")
    sent = known.sparkSession.sparkContext.broadcast(table[np.argsort(table[:, 0])])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, to, low, high = np.ascontiguousarray(sent.value.T)
        for batch in batches if len(key) else ():
            out = []
            for node, n, shard, label, keys in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                keys = keys.values.to_numpy()
                begin = np.searchsorted(key, keys, "left")
                counts = np.searchsorted(key, keys, "right") - begin
                at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
                at = at[(to[at] < shard) & ((low[at] != label) | (high[at] != label))]
                blocks, which = np.unique(to[at], return_inverse=True)
                out += [(node, n, label, b) for b in blocks[np.bincount(which, (key[at] & 1) + 1, len(blocks)) >= ENOUGH].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 4], names=["node", "n_corners", "label", "to"])

    return known.select("node", "n_corners", "shard", "label", "keys").mapInArrow(visit, "node bigint, n_corners bigint, label bigint, to bigint")


def _numbers(table: DataFrame, *names: str) -> np.ndarray:
    """The rows of a small table of numbers."""
    found = table.select(*names).toArrow()
    return np.stack([found[c].to_numpy() for c in names], 1).astype(np.int64)


def _search(met: DataFrame, found: DataFrame, places: DataFrame, hamming: int, least: int, summed: bool = True) -> DataFrame:
    """(key, a, b): links (null, a, b) found in each shard and, if summed, its keys, each once for every group that has it,
    with the group's first image and the shard. places: (node, family, shard, indexed, asked, label)."""

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, indexed, asked, label = (np.asarray(table[c].to_numpy(zero_copy_only=False)) for c in ("node", "indexed", "asked", "label"))
        place = {n: i for i, n in enumerate(node.tolist())}
        guess = np.array([place.get(f, -1) for f in table["family"].to_pylist()], np.int64)
        keys = [np.array(x, np.int64) for x in table["keys"].to_pylist()]
        images = [(np.frombuffer(p, np.float32).reshape(-1, 4), np.frombuffer(c, np.uint8).reshape(-1, BITS // 8)) for p, c in zip(table["points"].to_pylist(), table["codes"].to_pylist(), strict=True)]
        groups = Groups(label.astype(np.int64))
        edges = np.array(link_images(keys, images, groups, indexed.astype(bool), asked.astype(bool), guess, hamming, least), np.int64).reshape(-1, 2)
        ends = np.sort(node[edges], 1)
        key, a, b = np.zeros(0, np.int64), ends[:, 0], ends[:, 1]
        if summed:
            of = np.unique(np.stack([np.concatenate(keys), np.repeat(groups.root, [len(k) for k in keys])], 1), axis=0)
            key, a, b = of[:, 0], np.concatenate([a, node[of[:, 1]]]), np.concatenate([b, np.full(len(of), table["shard"][0].as_py())])
        return pa.table({"key": pa.concat_arrays([pa.nulls(len(edges), pa.int64()), pa.array(key)]), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    joined = places.join(met.select("node", "keys"), "node").join(found.select("node", "points", "codes"), "node")
    return cut(joined.groupBy("shard").applyInArrow(search, "key bigint, a bigint, b bigint"), "links")


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64) -> DataFrame:
    """(id, image): each vector as a grey image, the sum of a fixed smooth texture for each of its places.

    The test data have no images; this gives every row of a table of vectors one that depends on its values alone, so that
    near vectors have near images and others differ as natural textures do. A null or empty vector has a null image."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    textures: list[np.ndarray] = []

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                v = np.array([x or 0.0 for x in v or ()])
                if len(v) < 2:
                    out.append(None)
                    continue
                while len(textures) < len(v):
                    textures.append(_smooth(np.random.default_rng(len(textures)).normal(size=(size, size)), 5).ravel())
                image = v @ np.array(textures[: len(v)])
                out.append(encode_pgm(np.clip(128 + 90 * np.tanh(image / (2 * image.std() + 1e-9)), 0, 255).reshape(size, size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "image"])

    return vectors.select(F.col(id_col), F.col(vector_col)).mapInArrow(draw, f"id {id_type}, image binary")
