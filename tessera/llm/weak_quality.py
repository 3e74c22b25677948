"""Quality without labels: heuristic labellers vote, expectation-maximisation weighs them, posteriors train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, grams, mix, slices, text_bytes, tune, words

#: Function words of the languages the stop-word labeller knows.
STOP_WORDS = "the of and to a in is it that for on are as with at be this from by le la les de des et en un une du est que qui dans pour par pas der die das und zu von mit ist den ein eine nicht sich auf el los las y que una por con para se al como".split()
#: The labellers: a measure, and two bounds. Votes are bad on one side, good on the other, none in between.
LABELLERS = (
    ("symbols", "below", 0.01, 0.04),
    ("capitals", "below", 0.10, 0.30),
    ("repeats", "below", 0.02, 0.08),
    ("variety", "above", 0.45, 0.30),
    ("endings", "above", 0.80, 0.30),
    ("stop_words", "above", 0.06, 0.02),
    ("length", "above", 20, 8),
    ("long_words", "below", 9.0, 12.0),
    ("digits", "below", 0.10, 0.30),
    ("plain_words", "above", 0.90, 0.75),
    ("bare_symbols", "below", 0.02, 0.06),
    ("symbol_runs", "below", 0.01, 0.10),
    ("triples", "below", 0.005, 0.05),
    ("old_trigrams", "below", 0.20, 0.50),
)
ABSTAIN, BAD, GOOD = 0, 1, 2
_WHITE = np.ones(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = False
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = _LETTERS[128:] = True
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_ASCII = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*@|<>{}[]^~=_\\+!"])
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 128


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(STOP_WORDS).encode(), np.uint8)
    return np.unique(words(data, np.array([0, len(data)]), _LETTERS)[0])


_STOP = _stop_hashes()


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the labellers measure, a row for each text."""
    m, n = len(offsets) - 1, len(data)
    out = np.zeros((m, len(LABELLERS)))
    if not n:
        return out
    h, where, counts = words(data, offsets, _WHITE)
    doc = np.repeat(np.arange(m), counts)
    g, _, letter_counts = words(data, offsets, _LETTERS)
    letter_doc = np.repeat(np.arange(m), letter_counts)
    size, count, letter_count = np.maximum(np.diff(offsets), 1), np.maximum(counts, 1), np.maximum(letter_counts, 1)

    def per_byte(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return c[offsets[1:]] - c[offsets[:-1]]

    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (letter_doc[1:] == letter_doc[:-1])
    triple = np.zeros(len(g), bool)
    triple[2:] = same[2:] & same[1:-1]

    def distinct_of(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, d = values[order], of[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[first], minlength=m)

    distinct = distinct_of(h, doc)
    three = grams(g, 3)
    inside = letter_doc[: len(three)] == letter_doc[2 : 2 + len(three)]
    trigrams = np.bincount(letter_doc[: len(three)][inside], minlength=m)
    new_trigrams = distinct_of(three[inside], letter_doc[: len(three)][inside])
    # a text of n words of natural language has about 4.5 n ** 0.75 different ones or fewer; short texts vary wholly
    variety = distinct / np.minimum(count, 6 * count**0.75)
    line_end = np.zeros(n, bool)
    line_end[:-1] = data[1:] == 10
    line_end[offsets[1:][np.diff(offsets) > 0] - 1] = True
    solid = line_end & (data != 10)
    closed = solid & np.isin(data, [ord(c) for c in ".!?\"')"])
    known = _STOP[np.minimum(np.searchsorted(_STOP, g), len(_STOP) - 1)] == g
    symbol, sign = _SYMBOL[data], np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    solid_byte = np.concatenate([[0], np.cumsum(_LETTERS[LOWER[data]] | _DIGIT[data])])
    signs, solids = (c[where[:, 1]] - c[where[:, 0]] for c in (sign, solid_byte))
    run = np.zeros(n, bool)
    run[1:] = symbol[1:] & symbol[:-1]
    columns = (
        per_byte(symbol) / size,
        per_byte(_UPPER[data]) / np.maximum(per_byte(_ASCII[data]), 1),
        np.bincount(letter_doc, same, m) / letter_count,
        variety,
        per_byte(closed) / np.maximum(per_byte(solid), 1),
        np.bincount(letter_doc, known, m) / letter_count,
        counts,
        np.bincount(doc, where[:, 1] - where[:, 0], m) / count,
        per_byte(_DIGIT[data]) / size,
        np.bincount(doc, (signs == 0) & (solids > 0), m) / count,
        np.bincount(doc, solids == 0, m) / count,
        per_byte(run) / count,
        np.bincount(letter_doc, triple, m) / letter_count,
        1 - new_trigrams / np.maximum(trigrams, 1) * (trigrams > 0) - (trigrams == 0),
    )
    for j, c in enumerate(columns):
        out[:, j] = c
    return out


def votes(measured: np.ndarray) -> np.ndarray:
    """The labellers' votes: ABSTAIN, BAD or GOOD."""
    out = np.zeros(measured.shape, np.int64)
    for j, (_, side, good, bad) in enumerate(LABELLERS):
        x = measured[:, j]
        out[:, j] = np.where(x <= good, GOOD, np.where(x >= bad, BAD, ABSTAIN)) if side == "below" else np.where(x >= good, GOOD, np.where(x <= bad, BAD, ABSTAIN))
    return out


_CODE = 3 ** np.arange(len(LABELLERS))


class VoteModel:
    """How often each labeller votes what, given good and bad texts, and the share of good ones."""

    def __init__(self, share: float, tables: np.ndarray) -> None:
        self.share, self.tables = share, tables

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability that a text is good, given its votes."""
        j = np.arange(v.shape[1])
        odds = np.log(self.share / (1 - self.share)) + (np.log(self.tables[1, j, v]) - np.log(self.tables[0, j, v])).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller's votes, the expected share that is right."""
        good, bad = self.share * self.tables[1], (1 - self.share) * self.tables[0]
        right = good[:, GOOD] + bad[:, BAD]
        return {name: float(r / (r + w)) for (name, *_), r, w in zip(LABELLERS, right, good[:, BAD] + bad[:, GOOD], strict=False)}


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 1.0) -> VoteModel:
    """Expectation-maximisation over the counts of vote patterns, starting from each pattern's share of good votes."""
    good, cast = (patterns == GOOD).sum(1), (patterns != ABSTAIN).sum(1)
    p = (good + 1.0) / (cast + 2.0)
    p = p**4 / (p**4 + (1 - p) ** 4)
    model = None
    for _ in range(rounds):
        tables = np.empty((2, patterns.shape[1], 3))
        for y, w in ((0, counts * (1 - p)), (1, counts * p)):
            for v in range(3):
                tables[y, :, v] = prior + ((patterns == v) * w[:, None]).sum(0)
        tables /= tables.sum(2, keepdims=True)
        model = VoteModel(float(np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3)), tables)
        new = model.posterior(patterns)
        done = np.abs(new - p).max(initial=0) < 1e-6
        p = new
        if done:
            break
    return model


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features: (buckets, counts by text) of words and of three consecutive character classes."""
    h, _, counts = words(data, offsets, _WHITE)
    shape = _CLASS[data].astype(np.uint64)
    tri = grams(shape, 3)
    sizes = np.maximum(np.diff(offsets) - 2, 0)
    at = np.arange(len(tri))
    text = np.searchsorted(offsets, at, "right") - 1
    tri = tri[at + 3 <= offsets[text + 1]]
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), counts, ((mix(tri) & mask) + (mask + np.uint64(1))).astype(np.int64), sizes


class Scorer:
    """A logistic scorer: the mean weight of a text's words plus that of its character-class trigrams."""

    def __init__(self, bits: int) -> None:
        self.bits, self.weights, self.bias = bits, np.zeros(2 << bits, np.float32), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, rate: float = 0.5, batch: int = 64) -> Scorer:
        """rows: buckets, their shares of the text, and the posterior; AdaGrad over batches in a fixed shuffled order."""
        total = np.full(len(self.weights), 1e-6)
        total_bias = 1e-6
        r = np.random.default_rng(7)
        weights = self.weights.astype(np.float64)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for lo in range(0, len(order), batch):
                some = [rows[i] for i in order[lo : lo + batch]]
                index, value = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some]).astype(np.float64)
                doc = np.repeat(np.arange(len(some)), [len(s[0]) for s in some])
                z = np.bincount(doc, weights[index] * value, len(some)) + self.bias
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([s[2] for s in some])
                touched, inverse = np.unique(index, return_inverse=True)
                grad = np.bincount(inverse, g[doc] * value) / len(some)
                total[touched] += grad**2
                weights[touched] -= rate * grad / np.sqrt(total[touched])
                total_bias += g.mean() ** 2
                self.bias -= rate * g.mean() / np.sqrt(total_bias)
        self.weights = weights.astype(np.float32)
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w, n, t, m = hashed(data, offsets, self.bits)
        k = len(offsets) - 1
        z = np.full(k, self.bias)
        for index, counts in ((w, n), (t, m)):
            z += np.bincount(np.repeat(np.arange(k), counts), self.weights[index], k) / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4_000, bits: int = 16, threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: its id, n_votes (labellers that don't abstain), posterior, score and predicted.

    posterior is the label model's probability that the text is good, given the votes; score is the hashed scorer's.
    predicted is 1 if score >= threshold. Null texts count as empty: every measure is 0 and the votes follow from that.
    Repeated rows and null ids stay rows of their own; other columns are ignored. An empty table gives no rows.

    Votes of all texts are counted by pattern, at most 3 ** 14 of them, and only those counts go to the driver. The scorer
    is fitted on at most max_rows different texts, those with the smallest hash, each once however many copies it has:
    the documented bound of its sample."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            codes = [votes(measures(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) @ _CODE for lo, hi in slices(off)]
            values, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    counted = rows.select("text").mapInArrow(vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in counted], np.int64)
    model = fit_votes(codes[:, None] // _CODE % 3, np.array([r["n"] for r in counted], float))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for lo, hi in slices(off):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                p = model.posterior(votes(measures(part, at)))
                w, n, t, m = hashed(part, at, bits)
                index, share = [], []
                w_at, t_at = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
                for i in range(hi - lo):
                    both = []
                    for x in (w[w_at[i] : w_at[i + 1]], t[t_at[i] : t_at[i + 1]]):
                        u, c = np.unique(x, return_counts=True)
                        both.append((u, c / max(len(x), 1)))
                    index.append(np.concatenate([b[0] for b in both]).astype(np.int32).tobytes())
                    share.append(np.concatenate([b[1] for b in both]).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["p", "i", "s"])

    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    chosen = rows.select(text_hash.alias("h")).distinct().orderBy(F.xxhash64("h"), "h").limit(max_rows)
    some = rows.select(text_hash.alias("h"), "text").join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text")).select("text")
    got = sorted(((r["p"], bytes(r["i"]), bytes(r["s"])) for r in some.mapInArrow(describe, "p double, i binary, s binary").collect()), key=lambda r: (r[1], r[2]))
    scorer = Scorer(bits).fit([(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32), p) for p, i, s in got])
    shared = spark.sparkContext.broadcast((model, scorer))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = shared.value
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            v, out = [], []
            for lo, hi in slices(off):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                v.append(votes(measures(part, at)))
                out.append(s.score(part, at))
            cast = np.concatenate(v) if v else np.zeros((0, len(LABELLERS)), np.int64)
            z = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((cast != ABSTAIN).sum(1).astype(np.int32)), pa.array(m.posterior(cast)), pa.array(z), pa.array((z >= threshold).astype(np.int32))], names=["id", "n_votes", "posterior", "score", "predicted"])

    return rows.mapInArrow(score, f"id {id_type}, n_votes int, posterior double, score double, predicted int").withColumnRenamed("id", id_col)
