"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from tessera.llm.common import BYTE_VALUE, LOWER, cut, mix, powers, slices, text_bytes

#: Insults that count before anything is learned, and words that address the reader.
INSULTS = "idiot moron stupid scum trash clown loser pathetic worthless disgusting imbecile dumbass bastard bitch asshole freak vermin filth idiota estúpido imbécil imbécile connard salope abruti trottel dummkopf arschloch abschaum".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos usted tú ti vosotros su".split()
#: Characters that stand for letters in disguised words; an exclamation mark does between letters alone.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

#: Of the labelled texts with a lexicon's word, at least so many are toxic: a topic that toxic texts favour is none.
SHARE = 0.7
#: A row's own training features and calibration come from the other folds.
FOLDS = 4
PREFIXES = (4, 5, 6)
FEATURES = ("words", "insults", "n_insults", "learned", "n_learned", "weight", "near_you", "you", "capitals", "shouted", "punctuation", "exclaims", "asks", "doubled", "inner_symbols", "disguised", "stretched", "spaced")
_U = np.uint64

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LEET = LOWER.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
_PUNCT = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum()])
_INNER = np.isin(np.arange(256), [ord(c) for c in "0134579@$!*#_+"])


def _tokens(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Runs of letters: their starts, lengths and texts, and hashes of the whole and of its first bytes (0 if shorter)."""
    n = len(low)
    inside = _LETTER[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inv = powers(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[low] * p[:n], out=total[1:])
    size = ends - starts
    at = inv[starts] if n else np.zeros(0, np.uint64)
    hashes = [mix((total[ends] - total[starts]) * at + size.astype(np.uint64))]
    for k in PREFIXES:
        h = mix((total[np.minimum(starts + k, n)] - total[starts]) * at + _U(k + (k << 40)))
        hashes.append(np.where(size >= k, h, _U(0)))
    return starts, size, np.searchsorted(offsets, starts, "right") - 1, hashes


def _hash_words(all_words: list[str]) -> np.ndarray:
    data = " ".join(all_words).encode()
    a = LOWER[np.frombuffer(data, np.uint8)]
    return np.unique(_tokens(a, np.array([0, len(a)]))[3][0])


_INSULTS, _SECOND = _hash_words(INSULTS), _hash_words(SECOND_PERSON)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def features(data: np.ndarray, offsets: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each text. lexicon: sorted hashes of words and prefixes, and the weight of each."""
    n, m = len(data), len(offsets) - 1
    out = np.zeros((m, len(FEATURES)), np.float32)
    if not n:
        return out
    low = LOWER[data]
    starts, size, doc, hashes = _tokens(low, offsets)
    known, weights = lexicon
    learned = np.zeros(len(starts), bool)
    weight = np.zeros(len(starts), np.float64)
    for h in hashes:
        found = _in(h, known)
        learned |= found
        if found.any():
            weight[found] = np.maximum(weight[found], weights[np.searchsorted(known, h[found])])
    insult, you = _in(hashes[0], _INSULTS), _in(hashes[0], _SECOND)
    bad = insult | learned

    def per_doc(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flag, m)

    def per_byte(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(np.float64)

    count, bytes_ = np.maximum(per_doc(np.ones(len(doc))), 1), np.maximum(np.diff(offsets), 1).astype(np.float64)
    near = np.zeros(len(doc), bool)
    for j in range(1, 6):
        same = doc[j:] == doc[:-j]
        near[j:] |= bad[j:] & you[:-j] & same
        near[:-j] |= bad[:-j] & you[j:] & same
    upper = _UPPER[data]
    letters = np.maximum(per_byte(_ASCII_LETTER[data]), 1)
    ups = np.concatenate([[0], np.cumsum(upper)])
    shouted = (size >= 3) & (ups[starts + size] - ups[starts] == size)
    inner = np.zeros(n, bool)
    inner[1:-1] = _INNER[data[1:-1]] & _ASCII_LETTER[data[:-2]] & _ASCII_LETTER[data[2:]]
    twice = np.zeros(n, bool)
    twice[1:] = (data[1:] == data[:-1]) & ((data[1:] == 33) | (data[1:] == 63))
    stretched = np.zeros(n, bool)
    stretched[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & _ASCII_LETTER[data[2:]]
    leet_bytes = _LEET[data]
    leet_bytes[(data == 33) & inner] = ord("i")
    disguised = np.zeros(m)
    if (leet_bytes != low).any():
        _, _, leet_doc, leet_hashes = _tokens(leet_bytes, offsets)
        hits = _in(leet_hashes[0], _INSULTS) | _in(leet_hashes[0], known)
        disguised = np.maximum(np.bincount(leet_doc, hits, m) - np.bincount(doc, _in(hashes[0], _INSULTS) | _in(hashes[0], known), m), 0)
    alone = (size == 1) & np.concatenate([[False], (size[1:] == 1) & (size[:-1] == 1) & (doc[1:] == doc[:-1])])[: len(size)]
    for k, v in enumerate((
        np.log1p(count), per_doc(insult) / count * 100, np.log1p(per_doc(insult)), per_doc(learned) / count * 100, np.log1p(per_doc(learned)), np.log1p(per_doc(weight)), np.log1p(per_doc(near)), per_doc(you) / count * 100,
        per_byte(upper) / letters, per_doc(shouted) / count, per_byte(_PUNCT[data]) / bytes_, per_byte(data == 33) / bytes_ * 100, per_byte(data == 63) / bytes_ * 100, per_byte(twice) / bytes_ * 100, per_byte(inner) / count * 100, np.log1p(disguised), per_byte(stretched) / count * 100, per_doc(alone) / count * 100,
    )):
        out[:, k] = v
    return out


class Trees:
    """Boosted regression trees for a logistic loss, over features in at most 64 bins; trees are complete, of one depth."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: float = 5, l2: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.least, self.l2 = rounds, depth, rate, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        f = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, at = [], []
            for level in range(self.depth):
                k = 1 << level
                best = np.zeros(k)
                chosen, where = np.zeros(k, np.int64), np.full(k, 1 << 20)
                sg, sh = np.bincount(node, g, k), np.bincount(node, h, k)
                for j in range(d):
                    key = node * 64 + b[:, j]
                    cg, ch, cn = (np.bincount(key, w, k * 64).reshape(k, 64).cumsum(1) for w in (g, h, np.ones(n)))
                    gain = cg**2 / (ch + self.l2) + (sg[:, None] - cg) ** 2 / (sh[:, None] - ch + self.l2) - (sg**2 / (sh + self.l2))[:, None]
                    gain[(cn < self.least) | (cn[:, -1:] - cn < self.least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(k), top] > best + 1e-9
                    best[better] = gain[np.arange(k), top][better]
                    chosen[better], where[better] = j, top[better]
                node = node * 2 + (b[np.arange(n), chosen[node]] > where[node])
                feature.append(chosen)
                at.append(np.array([self.edges[j][w] if w < len(self.edges[j]) else np.inf for j, w in zip(chosen, where, strict=True)]))
            value = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2)
            f += value[node]
            self.feature.append(feature)
            self.cut.append(at)
            self.leaf.append(value)
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, at, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for chosen, where in zip(feature, at, strict=True):
                node = node * 2 + (x[rows, chosen[node]] > where[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function closest to y over score (pool adjacent violators), as (scores, values) to interpolate.

    Each pool's value is drawn towards the overall mean by one row's weight, so that none is exactly 0 or 1."""
    order = np.argsort(score, kind="stable")
    mean = float(y.mean())
    pools: list[list[float]] = []  # sum, weight, first score, last score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][3] == s:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([v, 1, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    xs, ys = [], []
    for total, weight, first, last in pools:
        value = (total + mean) / (weight + 1)
        xs += [first, last] if last > first else [first]
        ys += [value, value] if last > first else [value]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


class Model:
    """The lexicon, the trees and the calibration."""

    def __init__(self, lexicon, trees: Trees | None, curve) -> None:
        self.lexicon, self.trees, self.curve = lexicon, trees, curve

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = features(data, offsets, self.lexicon)
        if self.trees is None:
            return np.where(x[:, 2] >= math.log1p(2), 0.9, 0.1)
        return np.interp(self.trees.decide(x), *self.curve)


def held_out(id_col: Column) -> Column:
    """Whether an id is kept from training: crc32 of it as text, modulo 3, is 1; a null id is."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def _lexicon(rows: list[tuple[int, int, int]], nt: int, nc: int, n_words: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of the words that tell toxic texts. rows: hash, toxic and clean texts with the word."""
    kept = []
    floor = 2 * math.log(max(1, n_words))
    for h, t, c in rows:
        if t >= 3 and nt and nc and t >= SHARE * (t + c) and t * nc > 3 * c * nt and (g := _surprise(t, c, nt, nc)) >= floor:
            kept.append((h & (1 << 64) - 1, math.log((t + 0.5) / (nt + 1) * (nc + 1) / (c + 0.5)), g))
    kept = sorted(sorted(kept, key=lambda k: (-k[2], k[0]))[:limit])
    return np.array([k[0] for k in kept], np.uint64), np.array([k[1] for k in kept], np.float64)


def _surprise(t: float, c: float, nt: float, nc: float) -> float:
    """The log-likelihood ratio of a word's counts in toxic and clean texts against one common rate."""
    share, n = nt / (nt + nc), t + c
    return 2 * ((t * math.log(t / n / share) if t else 0) + (c * math.log(c / n / (1 - share)) if c else 0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_lexicon: int = 20_000) -> Model:
    """Fit lexicon, trees and calibration on labelled rows that are not held out.

    At most max_rows ids are used, those with the smallest hash: a bounded sample, so it may be broadcast. An id whose
    label rows disagree is left out; of several texts with one id, that with the smallest hash counts.
    Words (and first 4, 5 and 6 bytes of words) make the lexicon where most texts with them are toxic, toxic texts have
    them at least three times as often as clean ones, and more surprisingly than the most surprising of so many words by
    chance. Folds go by a text's hash, so that equal texts are in one: the lexicon for a row's own training features and
    the trees whose decisions on it calibrate come from the other folds. With labels of one kind alone there is nothing
    to learn, and two fixed insults decide."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    few = marked.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id", "y")
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(few), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    rows = cut(one.select("y", F.pmod("x.h", F.lit(FOLDS)).cast("int").alias("fold"), "x.text"), "labelled")
    names = [f"{k}{j}" for k in "ct" for j in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(2))
            kind = np.asarray(batch.column(0)) * FOLDS + np.asarray(batch.column(1))
            for lo, hi in slices(off, 1 << 22):
                _, _, doc, hashes = _tokens(LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo])
                h, d = np.concatenate(hashes), np.tile(doc, len(hashes))
                h, d = h[h != 0], d[h != 0]
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, k = h[new], kind[lo + d[new]]
                values, inverse = np.unique(h, return_inverse=True)
                table = np.bincount(inverse * 2 * FOLDS + k, minlength=2 * FOLDS * len(values)).reshape(-1, 2 * FOLDS)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(pa.array(table[:, j]) for j in range(2 * FOLDS))], names=["h", *names])

    sizes = {(r["y"], r["fold"]): r["count"] for r in rows.groupBy("y", "fold").count().collect()}
    nt, nc = (sum(n for (y, _), n in sizes.items() if y == k) for k in (1, 0))
    if not nt or not nc:
        return Model((np.zeros(0, np.uint64), np.zeros(0)), None, None)
    counted = rows.mapInArrow(count, "h bigint, " + ", ".join(f"{c} bigint" for c in names)).groupBy("h").agg(*(F.sum(c).alias(c) for c in names))
    t, c = (sum((F.col(f"{k}{j}") for j in range(1, FOLDS)), F.col(f"{k}0")) for k in "tc")
    counted = cut(counted.withColumn("t", t).withColumn("c", c).filter("t + c >= 3"), "counted")
    n_words = counted.count()
    candidates = counted.filter(F.col("t") * nc > F.col("c") * nt).orderBy(F.desc(F.col("t") - F.col("c") * (nt / nc)), "h").limit(8 * max_lexicon).collect()
    whole = [(r["h"], r["t"], r["c"]) for r in candidates]
    lexicons = []
    for k in range(FOLDS):
        others = [(r["h"], r["t"] - r[f"t{k}"], r["c"] - r[f"c{k}"]) for r in candidates]
        lexicons.append(_lexicon(others, nt - sizes.get((1, k), 0), nc - sizes.get((0, k), 0), n_words, max_lexicon))
    shared = spark.sparkContext.broadcast(lexicons)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column(1))
            data, off = text_bytes(batch.column(2))
            for lo, hi in slices(off):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                x = np.stack([features(part, at, one) for one in shared.value])[fold[lo:hi], np.arange(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x])], names=["y", "fold", "x"])

    got = rows.mapInArrow(describe, "y int, fold int, x binary").collect()
    got.sort(key=lambda r: (r["x"], r["y"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    y, fold = np.array([r["y"] for r in got], float), np.array([r["fold"] for r in got])
    out = np.zeros(len(y))
    for k in np.unique(fold).tolist():
        if (fold != k).any():
            out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).decide(x[fold == k])
    return Model(_lexicon(whole, nt, nc, n_words, max_lexicon), Trees().fit(x, y), isotonic(out, y))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, with_row: str | None = None) -> DataFrame:
    """A row for each row of docs: its id, held_out, score and predicted (1 if score >= threshold).

    A null text counts as empty; an empty one gets the score of no words. Repeated rows and null ids stay rows of their
    own (a null id is held out). with_row: the name of a further column that holds the whole row of docs as a struct, so
    that no column of docs clashes; otherwise other columns are ignored. Map-only."""
    whole = [F.struct("*").alias("row")] if with_row else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"), *whole)
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), *rows.schema.fields[3:]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            parts = [shared.value.score(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in slices(off)]
            s = np.clip(np.concatenate(parts), 0, 1) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), *batch.columns[3:]], names=["id", "held_out", "score", "predicted", *(["row"] if with_row else [])])

    out = rows.mapInArrow(score, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "score", "predicted", *([F.col("row").alias(with_row)] if with_row else []))
