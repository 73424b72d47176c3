"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target
against the raw corpus.

Two multinomials over ``BUCKETS`` hashed n-grams are counted: one over the
trusted texts, one over the whole corpus. A document's score is the sum over
its n-grams of ``ln p_target - ln p_raw``, divided by their number, and every
document at or above ``THRESHOLD`` is kept: no draw, no quota. N-grams are the
words, the word pairs and the byte ``BYTE_GRAMS``-grams of a text with
whitespace made one kind of byte (a line of its own needs no word). Both
multinomials are smoothed by ``SMOOTH`` n-grams spread as the raw corpus is,
so an n-gram that neither holds says nothing.

Trusted are the documents whose majority label is 1; of more than
``TARGET_ROWS`` such ids those of the smallest hashes are learned from (the
bound of what is broadcast: 8 bytes an id). The raw counts take every row.
Both passes are narrow maps; a task hands on at most ``BUCKETS`` rows of
counts, and the driver gets ``BUCKETS`` summed ones.

The plain measures beside it (words, characters, symbols, repeated lines and
word windows) are counted exactly, equal words and lines being those of equal
64-bit hash.

Defined results: null texts have no word, all measures 0 and fail the base
rule; a text without n-grams scores 0; without a trusted text every score is
0, so only the base rule decides; null ids are never trusted; a tie of labels
counts as 1; repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix, ship, slices, text_buffer

BUCKETS = 1 << 15
BYTE_GRAMS = (3, 5)
SMOOTH = 2000.0
TARGET_ROWS = 50_000
#: A document whose n-grams are on average less likely under the target than
#: under the raw corpus by more than this (natural logarithm) goes.
THRESHOLD = -0.25
#: The base rule: fewer words, or a larger share (in percent) of words inside
#: three-word windows that occur again, fails.
MIN_WORDS, MAX_REPEAT = 50, 50

_VALUES = np.random.default_rng(20240311).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PLAIN = np.where(_SPACE, 32, np.arange(256)).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def runs(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that do not part them: ``(64-bit hash of each
    run, its first place, index of each row's first run with the total
    appended)``. Upper and lower case differ."""
    n = len(data)
    solid = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:n] | np.concatenate([[True], ~solid[:-1]]))) if n else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    where = np.flatnonzero(solid)
    index = np.searchsorted(where, starts)
    length = np.diff(np.append(index, len(where)))
    power = np.full(int(length.max()) + 1, _BASE, np.uint64)
    power[0] = 1
    place = np.arange(len(where)) - np.repeat(index, length)
    sums = np.add.reduceat(_VALUES[data[where]] * np.multiply.accumulate(power)[place], index)
    return mix(sums + length.astype(np.uint64)), starts, np.searchsorted(starts, offsets)


def again(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place: does its key occur twice or more in its row, and does it
    occur there at an earlier place?"""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], earlier[order] = same[1:] | same[:-1], same[:-1]
    return twice, earlier


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Measured:
    """Measures and hashed n-grams of the rows of a slice."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    buckets: np.ndarray
    rows: np.ndarray


def n_grams(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, word_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, with its row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = np.flatnonzero(word_row[1:] == word_row[:-1])
    found = [_bucket(word), _bucket(mix(word[pair] * np.uint64(3) + mix(word[pair + 1], 1), 2))]
    rows = [word_row, word_row[pair]]
    text = _PLAIN[data]
    h = np.zeros(len(text), np.uint64)
    for k in range(1, max(BYTE_GRAMS) + 1):
        m = len(text) - k + 1
        if m <= 0:
            break
        h = h[:m] << np.uint64(8) | text[k - 1 :]  # at most 8 bytes fit
        if k in BYTE_GRAMS:
            at = np.flatnonzero(row[:m] == row[k - 1 :])
            found.append(_bucket(mix(h[at], 10 + k)))
            rows.append(row[at])
    return np.concatenate(found), np.concatenate(rows)


def measure(col, grams: bool = True, base: bool = True) -> Measured:
    data, offsets = text_buffer(col)
    n = len(offsets) - 1
    word, _, first = runs(data, offsets, _SPACE)
    word_row = np.repeat(np.arange(n), np.diff(first))
    empty = np.zeros(n, np.int64)
    chars = symbols = lines = repeats = empty
    if base:
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        chars = total(~_SPACE[data] & ((data & 0xC0) != 0x80))
        symbols = total(_SYMBOL[data])
        line, start, line_first = runs(data, offsets, _BREAK)
        line_row = np.repeat(np.arange(n), np.diff(line_first))
        if len(line):
            # a line counts if a word starts in it
            inner = np.add.reduceat((~_SPACE[data]).astype(np.int64), start) > 0
            lines = np.bincount(line_row[inner], weights=again(line[inner], line_row[inner])[1], minlength=n).astype(np.int64)
        if len(word) > 2:
            window = np.flatnonzero(word_row[2:] == word_row[:-2])
            key = mix(word[window] * np.uint64(3) + mix(word[window + 1], 1) * np.uint64(5) + mix(word[window + 2], 2), 3)
            at = window[again(key, word_row[window])[0]]
            covered = np.zeros(len(word), bool)
            for k in range(3):
                covered[at + k] = True
            repeats = np.bincount(word_row, weights=covered, minlength=n).astype(np.int64)
    buckets, rows = n_grams(data, offsets, word, word_row) if grams else (np.zeros(0, np.int64),) * 2
    return Measured(np.diff(first), chars, symbols, lines, repeats, buckets, rows)


def trusted_ids(labels: DataFrame, most: int = TARGET_ROWS) -> list[int]:
    """Ids whose majority quality label is 1, the ``most`` of smallest hash."""
    votes = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("share"))
    ids = votes.where("share >= 0.5").select("doc_id")
    return [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def fit(docs: DataFrame, trusted: list[int], text: str = "text", key: str = "doc_id") -> np.ndarray:
    """``ln p_target - ln p_raw`` of every bucket."""
    spark = ship(docs)
    shared = spark.sparkContext.broadcast(np.unique(np.array(trusted, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column("text"), base=False)
                ids = part.column("k")
                of_target = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), shared.value) & ids.is_valid().to_numpy(zero_copy_only=False)
                counts[0] += np.bincount(m.buckets, minlength=BUCKETS)
                counts[1] += np.bincount(m.buckets[of_target[m.rows]], minlength=BUCKETS)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "raw", "target"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("text"))
    summed = rows.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, BUCKETS))
    for r in summed.collect():
        counts[:, r.bucket] = r.raw, r.target
    raw, target = counts
    if not target.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + SMOOTH * p_raw) / (target.sum() + SMOOTH)) - np.log(p_raw)


def score(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the id, the measures, ``base_failed``, the
    ``score`` per n-gram and the verdict ``kept``."""
    spark = ship(docs)
    shared = spark.sparkContext.broadcast(ratio)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column("text"))
                n = part.num_rows
                total = np.bincount(m.rows, weights=shared.value[m.buckets], minlength=n)
                value = total / np.maximum(np.bincount(m.rows, minlength=n), 1)
                failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT * m.n_words)
                columns = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, ~failed & (value >= threshold), value]
                yield pa.RecordBatch.from_arrays([part.column("k"), *map(pa.array, columns)], names=["k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    schema = f"k {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("k", key)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the trusted documents and judge every document."""
    return score(docs, fit(docs, trusted_ids(labels)), threshold)
