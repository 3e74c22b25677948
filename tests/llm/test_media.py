import numpy as np
import pytest

from tessera.llm import media as M


def scene(seed, size=96):
    r = np.random.default_rng(seed)
    a = np.kron(r.random((12, 12)), np.ones((size // 12, size // 12)))
    return M._smooth(a * 255, 2)


def resized(a, f):
    ys, xs = ((np.arange(int(n * f)) + 0.5) / f - 0.5 for n in a.shape)
    return M._sample(a, *np.meshgrid(ys, xs, indexing="ij"))


def turned(a, degrees):
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.meshgrid(*(np.arange(n) - n / 2 for n in a.shape), indexing="ij")
    return M._sample(a, c * y - s * x + a.shape[0] / 2, s * y + c * x + a.shape[1] / 2)


EDITS = {
    "smaller": lambda a: resized(a, 0.8),
    "larger": lambda a: resized(a, 1.3),
    "oblique": lambda a: turned(a, 15),
    "quarter": np.rot90,
    "crop": lambda a: a[8:90, 5:88],
    "noise": lambda a: a + np.random.default_rng(1).normal(0, 6, a.shape),
    "bright": lambda a: a * 0.8 + 20,
}


def pgm(a):
    return M.encode_pgm(np.clip(a, 0, 255))


def linked(one, other, hamming=40, least=4):
    (p, c), (q, d) = one, other
    i, j = M.match(c, d, hamming)
    return len(i) >= least and M.consensus(p[i], q[j]) >= least


def test_round_trip_and_junk():
    a = (np.arange(12).reshape(3, 4) * 10).astype(np.uint8)
    assert (M.decode_pgm(M.encode_pgm(a)) == a).all()
    assert M.decode_pgm(None) is None and M.decode_pgm(b"") is None and M.decode_pgm(b"P6 1 1 255\n\0\0\0") is None and M.decode_pgm(b"P5 9 9 255\n\0") is None


def test_finds_edited_copies_and_no_others(spark):
    rows = []
    for n in range(8):
        a = scene(n)
        rows += [(10 * n + k, pgm(edit(a))) for k, edit in enumerate((lambda x: x, *EDITS.values()))]
        rows.append((10 * n + 9, pgm(a)))  # same bytes
    rows += [(900, None), (901, b""), (902, b"junk"), (None, pgm(scene(0)))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, image binary, class_id string, node int")
    got = {r["id"]: r for r in M.find_image_copies(df).collect()}
    assert len(got) == len(rows)
    for n in range(8):
        assert {got[10 * n + k]["class_id"] for k in (*range(8), 9)} == {10 * n}
    assert [got[i]["class_id"] for i in (900, 901, 902)] == [900, 901, 902]
    assert got[None]["class_id"] == 0
    assert M.find_image_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("edit", EDITS)
def test_candidates_keep_nine_of_ten_links_of_all_pairs(spark, edit):
    images = [pgm(f(scene(s))) for s in range(40) for f in (lambda x: x, EDITS[edit])]
    described = [M.describe(M.decode_pgm(x)) for x in images]
    found = spark.createDataFrame([(i, len(p), p.tobytes(), c.tobytes()) for i, (p, c) in enumerate(described)], "node long, n_corners long, points binary, codes binary")
    pairs = M._candidates(found)
    got = {(r["a"], r["b"]) for r in M._verify(pairs, found, 40, 4).collect()}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if linked(described[i], described[j])}
    assert len(want) >= 36
    assert got <= want and len(got) >= 0.9 * len(want)


def test_full_keys_lose_no_group(spark):
    """A mark that all images share fills its keys; copies among them and a large family are still found."""
    mark = scene(500)[:64, :64]
    rows, family = [], scene(900)
    for n in range(60):
        a = scene(600 + n)
        a[:64, :64] = mark
        rows.append((n, pgm(a)))
    for n in range(60):
        rows.append((1000 + n, pgm(family + np.random.default_rng(n).normal(0, 2, family.shape))))
    got = {r["id"]: r["class_id"] for r in M.find_image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert {got[1000 + n] for n in range(60)} == {1000}
    by = {i: M.describe(M.decode_pgm(x)) for i, x in rows}
    links = [(i, j) for i in range(60) for j in range(i + 1, 60) if linked(by[i], by[j])]
    assert len(links) > 600 and np.mean([got[i] == got[j] for i, j in links]) >= 0.9


def test_tiles_do_not_show_and_small_crops_of_large_images_link(monkeypatch):
    r = np.random.default_rng(3)
    big = M._smooth(np.kron(r.random((90, 90)), np.ones((8, 8))) * 255, 2)
    p, c = M.describe(big.astype(np.uint8))
    monkeypatch.setattr(M, "TILE", 100)
    q, d = M.describe(big.astype(np.uint8))
    assert sorted(map(tuple, p.tolist())) == sorted(map(tuple, q.tolist())) and len(p) > 1000
    assert {x.tobytes() for x in c} == {x.tobytes() for x in d}
    part = big[300:380, 410:500].astype(np.uint8)
    i, j = M.match(*(M.describe(x)[1] for x in (part, big.astype(np.uint8))), 40)
    assert M.consensus(M.describe(part)[0][i], p[j]) >= 4


def test_ties_and_flat_images():
    flat = np.full((64, 64), 9, np.uint8)
    assert len(M.describe(flat)[0]) == 0 and len(M.describe(np.zeros((1, 1), np.uint8))[0]) == 0
    tiled = np.tile(scene(1, 48).astype(np.uint8), (3, 3))
    p, c = M.describe(tiled)
    assert len(p) and len(p) == len(c) and M.consensus(p, p) >= 4
    assert len(M.match(c, c[:0], 40)[0]) == 0


def same_marks(n, pairs):
    """Images that have the same descriptors, each at places of its own, but for pairs, which have theirs at the same."""
    r = np.random.default_rng(7)
    codes = r.integers(0, 256, (6, M.BITS // 8), np.uint8)
    points = [np.column_stack([r.random((6, 2)) * 500, np.ones(6), r.random(6) * 6]).astype(np.float32) for _ in range(n)]
    for i, j in pairs:
        points[j] = points[i]
    return [(p, codes) for p in points]


@pytest.mark.parametrize("block", [512, 4])
def test_keys_of_many_images_lose_no_partner(spark, monkeypatch, block):
    """All keys belong to all 40 images; links are between images that are neither the first nor the last of a key."""
    monkeypatch.setattr(M, "BLOCK", block)
    pairs = [(20, 21), (5, 33), (33, 34), (12, 13)]
    described = same_marks(40, pairs)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if linked(described[i], described[j])}
    assert want == {*pairs, (5, 34)}
    found = spark.createDataFrame([(i, len(p), p.tobytes(), c.tobytes()) for i, (p, c) in enumerate(described)], "node long, n_corners long, points binary, codes binary")
    got = {(r["node"], r["label"]) for r in M.components(M._verify(M._candidates(found), found, 40, 4)).collect()}
    assert got == {(20, 20), (21, 20), (5, 5), (33, 5), (34, 5), (12, 12), (13, 12)}


@pytest.mark.parametrize("block, few", [(512, 500_000), (4, 500_000), (4, 0)])
def test_classes_are_those_of_all_pairs_with_two_keys(spark, monkeypatch, block, few):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "SMALL", few)
    images = [pgm(f(scene(s))) for s in range(6) for f in (lambda x: x, *EDITS.values())]
    images += [pgm(scene(50) + np.random.default_rng(n).normal(0, 8, (96, 96))) for n in range(20)]
    described = [M.describe(M.decode_pgm(x)) for x in images]
    found = spark.createDataFrame([(i, len(p), p.tobytes(), c.tobytes()) for i, (p, c) in enumerate(described)], "node long, n_corners long, points binary, codes binary")
    got = [r["label"] for r in M.components(M._verify(M._candidates(found), found, 40, 4)).orderBy("node").collect()]
    tables = [M.table_keys(c) for _, c in described]
    sets = [{k & ~1 for k in x.tolist()} | {k | 1 for k in M.double_keys(x).tolist()} for x in tables]
    root = list(range(len(images)))
    for i in range(len(images)):
        for j in range(i):
            if root[i] != root[j] and sum(1 + k % 2 for k in sets[i] & sets[j]) > 1 and linked(described[i], described[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert got == [x for x in root if root.count(x) > 1]


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(monkeypatch):
    tried = []
    match = M.match
    monkeypatch.setattr(M, "match", lambda *a: tried.append(1) or match(*a))
    described = [M.describe(M.decode_pgm(pgm(scene(50) + np.random.default_rng(n).normal(0, 3, (96, 96))))) for n in range(60)]
    keys = [M.table_keys(c).view(np.int64) for _, c in described]
    every = np.ones(60, bool)
    edges = M.link_images(keys, described, M.Groups(np.arange(60)), every, every, np.zeros(60, np.int64), 40, 4)
    assert len(edges) == 59 and len(tried) < 90
