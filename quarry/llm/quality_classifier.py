"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and
character n-grams; a softmax layer on top gives the class. Both are trained
by plain stochastic gradient descent in numpy on a bounded sample of labelled
rows: the ``sample_rows`` smallest hashes of doc_id, so driver memory is at
most ``sample_rows * BUCKETS * 6`` bytes whatever the corpus. Scoring is a
narrow map over whole texts: the softmax of an average is linear in the
features up to the last step, so each bucket's vector is folded into one
number before it is shipped.

Defined results: null or empty text has no features and gets the share of
label 1 in the training sample; null ids count as unlabelled and not held
out by crc32 of the empty text; a document with several label rows has the
majority (a tie counts as 1); with no usable label every score is 0.5;
repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import code_points, crc_mod, fresh, ship, slices

BUCKETS = 1 << 15
ORDERS = (3, 4, 5)
#: Bucket of a word that repeats the one before it, and how often it counts
#: (a word has about as many n-grams).
REPEAT, REPEAT_WEIGHT = BUCKETS - 1, 8
DIM = 8
SAMPLE_ROWS = 3000
EPOCHS = 6
RATE = 2.0
_MULT = np.uint32(0x01000193)


def features(col) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of all rows, each feature with its row: words
    and the character n-grams inside a word padded by one space each side."""
    points, first = code_points(col)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    text = np.where(space, np.uint32(32), points)
    found, rows = [], []
    h, ok = text.copy(), np.ones(n, bool)
    for k in range(2, max(ORDERS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        # the place k-2 is inside now: it must be no space; the new place must lie in the same row
        h = h[:m] * _MULT ^ text[k - 1 :]
        ok = ok[:m] & ~edge[k - 1 : n]
        if k > 2:
            ok &= ~space[k - 2 : n - 1]
        if k in ORDERS:
            at = np.flatnonzero(ok)
            found.append(_bucket(h[at], k))
            rows.append(row[at])
    starts = np.flatnonzero(~space & (edge[:n] | np.concatenate([[True], space[:-1]])))
    if len(starts):
        solid = np.flatnonzero(~space)
        index = np.searchsorted(solid, starts)
        length = np.diff(np.append(index, len(solid)))
        place = (np.arange(len(solid)) - np.repeat(index, length)).astype(np.uint32)
        values = (text[solid] + np.uint32(7)) * (place * np.uint32(0x9E3779B1) | np.uint32(1))
        word = np.add.reduceat(values, index, dtype=np.uint32)
        found.append(_bucket(word, 1))
        rows.append(row[starts])
        # the word pair "same word again" is one feature, whatever the word
        again = np.flatnonzero((word[1:] == word[:-1]) & (rows[-1][1:] == rows[-1][:-1]))
        found.append(np.full(REPEAT_WEIGHT * len(again), REPEAT, np.uint16))
        rows.append(np.repeat(rows[-1][1:][again], REPEAT_WEIGHT))
    return np.concatenate(found), np.concatenate(rows)


def _bucket(h: np.ndarray, order: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * order)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(17)).astype(np.uint16)  # 15 bits


@dataclass
class QualityModel:
    weights: np.ndarray  # per bucket: vector times (class 1 - class 0)
    bias: float

    def scores(self, col) -> np.ndarray:
        buckets, rows = features(col)
        count = np.bincount(rows, minlength=len(col))
        total = np.bincount(rows, weights=self.weights[buckets], minlength=len(col))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> QualityModel:
    """SGD, one document a step. ``docs``: distinct buckets and their counts."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    prior = np.log(share / (1 - share)) * np.array([-0.5, 0.5], np.float32)
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr, step = rate * (1 - step / steps), step + 1
            ids, counts = docs[i]
            if not len(ids):
                continue
            part = (counts / counts.sum()).astype(np.float32)
            mean = part @ vectors[ids]
            z = out @ mean + prior
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ out
            out -= np.float32(lr * 0.1) * np.outer(p, mean)
            # the averaged gradient, with the average's shrinking of steps undone in part
            vectors[ids] -= np.float32(lr) * np.outer(part * np.sqrt(len(ids)), back)
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float64), float(prior[1] - prior[0]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Train on the labelled rows of ``docs`` that are not held out
    (crc32 of the id mod 3 is not 1), at most ``sample_rows`` of them."""
    ship(docs)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_mod(F.col(key), 3) != 1))
    known = known.groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    # twice as many ids as rows wanted, as labels may name ids that are no documents
    known = known.orderBy(F.xxhash64(key), key).limit(2 * sample_rows)
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(known), key).orderBy(F.xxhash64(key), key).limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "_text"):
                buckets, owner = features(part.column("_text"))
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(1, part.num_rows))
                ids, counts = [], []
                for b in np.split(buckets[order], cuts):
                    u, c = np.unique(b, return_counts=True)
                    ids.append(u.astype("<u2").tobytes())
                    counts.append(c.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["label", "ids", "counts"])

    got = rows.select("_label", "_text").mapInArrow(run, "label int, ids binary, counts binary").collect()
    parsed = [(np.frombuffer(r.ids, "<u2"), np.frombuffer(r.counts, "<u4")) for r in got]
    y = np.array([r.label for r in got], dtype=np.int64)
    if not len(y):
        return QualityModel(np.zeros(BUCKETS), 0.0)
    return train(parsed, y)


def score(df: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with a score in 0..1 for every row's whole text; a narrow map."""
    ship(df)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 256 KB
    names, copy = df.columns, fresh(df, "_text")
    staged = df.withColumn(copy, F.col(text))

    def run(batches: Iterator[pa.RecordBatch]):
        m = QualityModel(*shared.value)
        for batch in batches:
            for part in slices(batch, copy):
                cols = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(m.scores(part.column(copy)), pa.float64())], names=[*names, out])

    return staged.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``key, held_out, score, predicted`` of every row of ``docs``."""
    model = fit(docs, labels, text, key, sample_rows=sample_rows)
    scored = score(docs.select(key, text), model, text)
    return scored.select(key, (crc_mod(F.col(key), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
