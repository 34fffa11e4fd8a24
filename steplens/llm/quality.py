"""Quality scores by Bradley-Terry ranking of document pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steplens.llm.common import ship, slices, words

#: Labelled documents from which a ranker is learned at most; the features of these go to the driver.
SAMPLE = 4_096
#: Pairs of each document of the rarer label.
PAIRS = 8
#: The score at the quantile that the share of label 0 gives.
CUT = 0.3
#: The weight of the squares of the ranker's weights beside the mean loss of the pairs, and folds for the threshold.
RIDGE, FOLDS = 1e-4, 5

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "symbol": b"#$%&*~^@=<>{}[]\\_+/",
    "bang": b"!",
    "bar": b"|",
    "stop": b".,;:?",
    "line": b"\n",
    "wide": bytes(range(128, 256)),
}
_MEMBER = np.zeros((len(_CLASSES), 256), bool)
for _row, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[_row, list(_bytes)] = True
SHAPE = (*_CLASSES, "repeat", "word_length", "words")
#: Columns that words, and those that three bytes in a row, are hashed into.
WORD_COLUMNS, BYTE_COLUMNS = 512, 512
COLUMNS = len(SHAPE) + WORD_COLUMNS + BYTE_COLUMNS


def _shares(cell: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Roots of the shares that each column has in a row, from (row * columns + column): vectors of length one."""
    count = np.bincount(cell, minlength=rows * columns).reshape(rows, columns)
    return np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True)))


def features(text: pa.Array) -> np.ndarray:
    """One row of ``COLUMNS`` for each whole text: the shape of it, and the shares of its words and of each three bytes in a
    row, ASCII case apart, by hash. An empty or null text has zeros."""
    w = words(text, lower=True)
    rows = len(w.offsets) - 1
    by_word = _shares(np.repeat(np.arange(rows), w.counts()) * WORD_COLUMNS + (w.hashes() % np.uint64(WORD_COLUMNS)).astype(np.int64), rows, WORD_COLUMNS)
    b, own = w.raw.astype(np.uint32), np.repeat(np.arange(rows), np.diff(w.offsets))
    mixed = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    cell = own[2:] * BYTE_COLUMNS + (mixed >> np.uint32(23))
    return np.concatenate([shape(text), by_word, _shares(cell[own[:-2] == own[2:]], rows, BYTE_COLUMNS)], axis=1)


def shape(text: pa.Array) -> np.ndarray:
    """One row of ``SHAPE`` for each whole text: shares of its bytes by class, of words equal to the word before them,
    the mean word length and the logarithm of the number of words."""
    w = words(text)
    size = np.maximum(1, np.diff(w.offsets))
    n = w.counts()
    rows = []
    for member in _MEMBER:
        total = np.zeros(len(w.raw) + 1, np.int32)
        np.cumsum(member[w.raw], dtype=np.int32, out=total[1:])
        rows.append(np.diff(total[w.offsets]) / size)
    h = w.hashes()
    same = np.zeros(len(h) + 1, np.int64)
    if len(h):
        equal = np.concatenate([[False], h[1:] == h[:-1]])
        equal[w.first[:-1][n > 0]] = False
        same[1:] = np.cumsum(equal)
    length = np.concatenate([[0], np.cumsum(w.end - w.start)])
    some = np.maximum(1, n)
    rows += [np.diff(same[w.first]) / some, np.minimum(1, np.diff(length[w.first]) / some / 32), np.log1p(n) / 16]
    return np.stack(rows, axis=1)


@dataclass(frozen=True)
class Ranker:
    """Scores from 0 to 1: ``CUT`` at the quantile of what it was learned from, more for the likelier better text."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        margin = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin + np.log(CUT / (1 - CUT)), -500, 500)))


def learn(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Ranker:
    """Weights that least often prefer the worse text of a pair, by logistic loss on the differences of their features. The
    threshold is the quantile, at the share of label 0, of scores by rankers that have not seen the row's fold. With one
    label only, or none, every score is a half."""
    k = x.shape[1]
    if not len(x) or label.min() == label.max():
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(CUT / (1 - CUT))))
    mean, scale = x.mean(axis=0, dtype=np.float64), np.ones(k)
    deviation = x[:, : len(SHAPE)].std(axis=0, dtype=np.float64)
    scale[: len(SHAPE)] = np.where(deviation > 1e-9, deviation, 1)
    z = x - mean.astype(np.float32)
    z /= scale.astype(np.float32)
    fold = np.zeros(len(x), int)
    for one in (0, 1):
        own = np.flatnonzero(label == one)
        fold[own] = np.random.default_rng(3).permutation(len(own)) % FOLDS
    unseen = np.zeros(len(x))
    for f in range(FOLDS):
        rest = fold != f
        unseen[~rest] = z[~rest] @ _prefer(z[rest], label[rest], pairs, ridge) if label[rest].min() < label[rest].max() else 0
    ranked, bad = np.sort(unseen), int((label == 0).sum())
    return Ranker(mean, scale, _prefer(z, label, pairs, ridge), float((ranked[bad - 1] + ranked[bad]) / 2))


def _prefer(z: np.ndarray, label: np.ndarray, pairs: int, ridge: float) -> np.ndarray:
    """The weights, by Newton's steps that are each solved by conjugate gradients."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng, least = np.random.default_rng(7), min(len(good), len(bad)) * pairs
    better, worse = (np.resize(s, least) if len(s) * pairs <= least else rng.choice(s, least) for s in (good, bad))

    def back(values: np.ndarray) -> np.ndarray:
        """The mean of the pairs' differences, each times its value."""
        return z.T @ (np.bincount(better, values, len(z)) - np.bincount(worse, values, len(z))).astype(np.float32) / least

    w, first = np.zeros(z.shape[1]), None
    for _ in range(20):
        m = z @ w.astype(np.float32)
        p = 1 / (1 + np.exp(np.clip(m[better] - m[worse], -30, 30).astype(np.float64)))
        gradient, curve = back(p) - ridge * w, p * (1 - p)
        size = float(gradient @ gradient)
        first = first or size
        if size <= 1e-6 * first:
            break
        step, rest, way = np.zeros(len(w)), gradient, gradient
        for _ in range(20):
            v = z @ way.astype(np.float32)
            turned = back(curve * (v[better] - v[worse])) + ridge * way
            far = (rest @ rest) / (way @ turned)
            step, left = step + far * way, rest - far * turned
            if left @ left < 1e-3 * size:
                break
            way, rest = left + (left @ left) / (rest @ rest) * way, left
        w += step
    return w


def held_out(doc_id: str | Column) -> Column:
    """Whether labels of a document are kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """A ranker from at most ``sample`` labelled documents that are not held out, those first by a hash of doc_id.
    Null labels are left out; of a doc_id labelled twice the lower label counts."""
    ship(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), COLUMNS).cast(pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    # At most ``sample`` rows on the broadcast side and to the driver.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = own.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "doc_id long, quality int, x array<float>").orderBy("doc_id", "x").limit(sample).toArrow().combine_chunks()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COLUMNS)
    return learn(x, rows["quality"].to_numpy())


def score(ranker: Ranker, text: str = "text") -> Column:
    """The score of each whole text; null counts as empty."""

    @F.arrow_udf("double")
    def run(batch: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text")
        return pa.array(np.concatenate([ranker(features(p.column("text"))) for p in parts] or [np.empty(0)]))

    return run(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; a null doc_id is not held out. No labels of use give
    scores of a half; an empty table gives no rows."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(fit(docs, labels, sample)).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
