"""Language identification by error-correcting output codes.

Every language gets a binary codeword (all useful columns for up to six
languages, else random columns with the widest separation of many draws).
One logistic classifier over hashed character 1-3-grams learns each bit.
Decoding sums each codeword's logistic loss over the bits, weighted by how
well that bit did for that language in training, and takes the codeword of
least loss. ``score`` is the softmax of the negative losses; ``ambiguous``
says that the runner-up's loss is within ``margin``.

Training takes at most ``per_language`` different rows (id and text) of each
language, those of the smallest hashes, so the driver holds at most
``languages * per_language`` sparse rows of up to 48 KB, whatever ids repeat.
The count of languages is taken to be small (it is broadcast).

Defined results: null text or text without a letter is ``und`` with score 0;
with no usable training row everything is ``und``; a single language is
predicted for all texts with letters; repeated rows are predicted each; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import code_points, crc_mod, ship, slices

BITS = 13
BUCKETS = 1 << BITS
PER_LANGUAGE = 600
MARGIN = 1.0
#: Texts whose dense profiles (32 KB each) a worker holds at once.
MOST_ROWS = 512
EPOCHS = 8


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """``n`` codewords of +1/-1, one row each."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=float).T
    width, best, apart = 4 * int(np.ceil(np.log2(n))) + 11, None, -1
    rng = np.random.default_rng(seed)
    for _ in range(200):
        words = rng.choice([-1.0, 1.0], (n, width))
        words = words[:, np.abs(words.sum(0)) < n]  # a column must part the languages
        gap = ((words.shape[1] - words @ words.T) / 2 + np.eye(n) * width).min() if words.size else 0
        if gap > apart:
            best, apart = words, gap
    return best


def profiles(col) -> np.ndarray:
    """Unit-length hashed n-gram counts, one dense row per text."""
    points, first = code_points(col)
    rows = len(first) - 1
    out = np.zeros((rows, BUCKETS), np.float32)
    space = (points == 32) | ((points >= 9) & (points <= 13)) | ((points >= 48) & (points <= 57))
    text = np.where(space, np.uint32(32), points)
    grams, h = [], np.zeros(len(text), np.uint32)
    for k in (1, 2, 3):
        h = h[: max(0, len(text) - k + 1)] * np.uint32(0x01000193) ^ text[k - 1 :]
        x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * k)
        grams.append(((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    for i in range(rows):
        a, b = first[i], first[i + 1]
        for k, g in enumerate(grams):
            if b - k > a:
                out[i] += np.bincount(g[a : b - k], minlength=BUCKETS)
    return np.sqrt(out) / np.maximum(np.sqrt(out.sum(1, keepdims=True)), 1)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to the number of bits

    def losses(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        return np.einsum("kb,nkb->nk", self.trust, np.logaddexp(0, -z[:, None, :] * self.code[None]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        loss = self.losses(x)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        ranked = np.sort(loss, axis=1)
        gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / p.sum(1), gap


#: A text's profile as (buckets, values).
Row = tuple[np.ndarray, np.ndarray]


def dense(rows: list[Row]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, values) in enumerate(rows):
        x[i, at] = values
    return x


def train(rows: list[Row], y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 5) -> LanguageModel:
    """All bit classifiers at once by mini-batch Adagrad on logistic loss; only
    a batch is ever dense."""
    code, rng = codebook(len(languages)), np.random.default_rng(seed)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    gw, gb = np.full(w.shape, 1e-4, np.float32), np.full(b.shape, 1e-4, np.float32)
    target = code[y].astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            at = order[i : i + 64]
            x = dense([rows[k] for k in at])
            slope = -target[at] / (1 + np.exp(np.clip(target[at] * (x @ w + b), -30, 30))) / len(at)
            dw, db = x.T @ slope, slope.sum(0)
            gw += dw * dw
            gb += db * db
            w -= 0.3 * dw / np.sqrt(gw)
            b -= 0.3 * db / np.sqrt(gb)
    right = np.concatenate([np.sign(dense(rows[i : i + 64]) @ w + b) == target[i : i + 64] for i in range(0, len(y), 64)]).astype(float)
    trust = np.array([right[y == k].mean(0) + 1e-3 if (y == k).any() else np.ones(code.shape[1]) for k in range(len(languages))])
    return LanguageModel(languages, code, w, b, trust * trust.shape[1] / trust.sum(1, keepdims=True))


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    ship(df)
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_at"))
    known = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (crc_mod(F.col(key), 5) != 0))
    # a row is known by a hash of its id and text: rows alike are one, and an
    # id that repeats with other texts is as many rows
    known = known.select(F.col(lang).alias("_lang"), F.lower(F.col(text)).alias("_text"), F.xxhash64(key, text).alias("_at"))
    # the ranking moves hashes only; those over about twice the wanted share of
    # a language's rows stay behind, so that a language's ranking is small
    sizes = known.groupBy("_lang").agg(F.approx_count_distinct("_at").alias("_n"))
    share = (F.col("_at") + F.lit(2.0**63)) / F.lit(2.0**64)
    ids = known.select("_lang", "_at").join(F.broadcast(sizes), "_lang").where(share * F.col("_n") <= 2 * per_language).select("_lang", "_at")
    ids = ids.distinct().withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("_lang", "_at")
    rows = known.join(F.broadcast(ids), ["_lang", "_at"], "left_semi").dropDuplicates(["_lang", "_at"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "_text", 1 << 18, MOST_ROWS):
                for lang_, x in zip(part.column("_lang").to_pylist(), profiles(part.column("_text"))):
                    at = np.flatnonzero(x)
                    yield pa.RecordBatch.from_arrays([pa.array([lang_]), pa.array([at.astype("<u2").tobytes()]), pa.array([x[at].astype("<f4").tobytes()])], names=["lang", "at", "x"])

    got = sorted((r.lang, r.at, r.x) for r in rows.select("_lang", "_text").mapInArrow(run, "lang string, at binary, x binary").collect())
    if not got:
        return None
    languages = sorted({g[0] for g in got})
    sparse = [(np.frombuffer(at, "<u2"), np.frombuffer(values, "<f4")) for _, at, values in got]
    return train(sparse, np.array([languages.index(g[0]) for g in got]), languages)


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text", key: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """``key, lang_pred, score, ambiguous`` for every row; a narrow map."""
    spark = ship(df)
    kind = df.schema[key].dataType.simpleString()
    staged = df.select(F.col(key).alias("k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    shared = spark.sparkContext.broadcast(model)  # buckets x bits floats

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text", 1 << 18, MOST_ROWS):
                letters = part.column("_letters").to_pylist()
                if m is None:
                    lang, score, gap = ["und"] * len(letters), [0.0] * len(letters), [0.0] * len(letters)
                else:
                    best, p, gap = m.predict(profiles(part.column("_text")))
                    lang = [m.languages[b] if ok else "und" for b, ok in zip(best, letters)]
                    score = [float(s) if ok else 0.0 for s, ok in zip(p, letters)]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(lang), pa.array(score, pa.float64()), pa.array([g < margin or not ok for g, ok in zip(gap, letters)], pa.bool_())], names=["k", "lang_pred", "score", "ambiguous"])

    return staged.mapInArrow(run, f"k {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("k", key)


def language_id(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``key, held_out, lang_pred, score, ambiguous`` of every row."""
    model = fit(df, text, key, lang, per_language)
    found = identify(df, model, text, key)
    return found.select(key, (crc_mod(F.col(key), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
