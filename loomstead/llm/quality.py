"""Quality rules: base rules and a hashed n-gram logistic regression on labelled quality.

Features are shares of hashed character 1- to 3-grams and word 1- and 2-grams
in a text (a word that repeats the one before it counts as one fixed bigram).
The model is fitted on a bounded sample of labelled rows, its probabilities are
calibrated (a sigmoid) on the part of the sample it was not fitted on, and texts
are scored in Arrow batches: a gather of weights and a mean.

Defined cases: null and empty texts have no words, fail the base rules and get
the probability of an empty text; rows without a doc_id are left out; repeated
rows are each scored; null labels are ignored, repeated labels of a document
count once (the lowest), as do several texts of one (the greatest); without labels of both kinds the model keeps all; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import Words, slices

#: Labelled rows that the model is fitted on, at most, of each kind, and the bytes of such a row.
MOST_EACH, LONGEST = 2000, 1 << 16
#: Hash buckets of each family of n-grams; the probability from which a text is kept.
BUCKETS, KEEP = 1 << 16, 0.5
#: Base rules: fewest words, and the largest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
_REPEAT = np.uint64(0x5BD1E995)


def base_counts(text: str, data: bytes, words: Words) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    repeated = 0
    if words.n > WINDOW:
        h = words.run_hashes(WINDOW)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(words.n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int((np.cumsum(cover[:-1]) > 0).sum())
    spaces = len(data) - len(data.translate(None, _SPACES))
    return words.n, len(text) - spaces, len(data) - len(data.translate(None, _SYMBOLS)), dup, repeated


def grams(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams and of all word n-grams, repeats included."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    a = c * np.uint32(0x9E3779B1)
    two = (a[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    chars = np.concatenate([a >> shift, two >> shift, three >> shift])
    one = words.run_hashes(1)
    pairs = words.run_hashes(2)
    if len(pairs):
        pairs[one[1:] == one[:-1]] = _REPEAT
    mask = np.uint64(BUCKETS - 1)
    return chars, np.concatenate([one & mask, pairs & mask]).astype(np.uint32) + np.uint32(BUCKETS)


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values (shares, scaled)."""
    out = [np.unique(g, return_counts=True) + (len(g),) for g in grams(text, words) if len(g)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([u for u, _, _ in out]).astype(np.int64), np.concatenate([SCALE * n / t for _, n, t in out])


SCALE = 20.0


class Model:
    """weights over buckets, bias, and the calibration's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def margin(self, text: str, words: Words) -> float:
        return self.bias + sum(SCALE * float(self.weights[g].mean()) for g in grams(text, words) if len(g))

    def probability(self, text: str, words: Words) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text, words) + self.offset, -60, 60))))


def _logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-4):
    """Logistic regression by adaptive gradients on sparse rows."""
    lengths = np.array([len(i) for i, _ in rows])
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    w, bias, sums, bias_sum = np.zeros(2 * BUCKETS), 0.0, np.full(2 * BUCKETS, 1e-6), 1e-6
    weight = weight / weight.sum()
    for _ in range(rounds):
        z = np.bincount(row, w[index] * value, len(rows)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(index, error[row] * value, 2 * BUCKETS) + decay * w
        sums += g * g
        w -= rate * g / np.sqrt(sums)
        bias_sum += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_sum)
    return w, bias


def _sigmoid(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """slope and offset of a sigmoid by Newton's method, slightly pulled to (1, 0)."""
    a, b, weight = 1.0, 0.0, weight / weight.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        e, h = weight * (p - y), weight * p * (1 - p)
        g = np.array([(e * z).sum() + (a - 1), e.sum() + b])
        m = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 1]])
        step = np.linalg.solve(m, g)
        a, b = max(0.05, a - step[0]), b - step[1]
    return a, b


def fit(docs: DataFrame, labels: DataFrame, most_each: int = MOST_EACH) -> Model:
    """The model, from a bounded sample of labelled rows of each kind."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r.good: r.n for r in known.groupBy((F.col("quality") > 0).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = known.where("quality > 0").orderBy(order, "doc_id").limit(most_each).unionByName(known.where("quality <= 0").orderBy(order, "doc_id").limit(most_each))
    # at most 2 * most_each rows of two numbers are broadcast, and as many texts of bounded length come to the driver
    known_texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    found = known_texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max((F.col("quality") > 0).cast("int")).alias("good"))
    rows = sorted((r.doc_id, r.text, r.good) for r in found.collect())
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(2 * BUCKETS), 4.0)
    made = [features(t, Words(t.encode("utf-8", "surrogatepass"))) for _, t, _ in rows]
    share = {k: totals.get(bool(k), 1) / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.array([share[int(k)] for k in y])
    balanced = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum())
    kept_back = np.arange(len(rows)) % 4 == 3
    used = np.flatnonzero(~kept_back)
    w, bias = _logistic([made[i] for i in used], y[used], balanced[used])
    z = np.array([bias + float((w[i] * v).sum()) for i, v in made])
    slope, offset = _sigmoid(z[kept_back], y[kept_back], weight[kept_back])
    return Model(w, bias, slope, offset)


def rules(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        found = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, probabilities = [], []
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    data = text.encode()
                    words = Words(data)
                    counts.append(base_counts(text, data, words))
                    probabilities.append(found.probability(text, words))
                columns = [np.array(c, np.int64) for c in zip(*counts)]
                failed = (columns[0] < LEAST_WORDS) | (100 * columns[4] > MOST_REPEATED * columns[0])
                p = np.array(probabilities)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep))], names=["doc_id", *names, "base_failed", "probability", "kept"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, probability double, kept boolean"
    )
