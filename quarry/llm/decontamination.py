"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; its hash takes the words at
the mask's places and ignores the rest, so a substituted word there does not
break it. The masks are chosen so that *every* window of ``WINDOW`` words
with at most two substitutions (for shorter items: 8 or 9 words with one,
10 to 12 with two) holds an intact seed: nothing within the tolerance is
lost. Hits are joined on the hash and verified: some window around the seed
must agree in at least 80 % of its words.

The benchmark's hashes are shipped as a bitmap that is sized by their number
and never over ``MAX_BITMAP_BITS``; it only thins what is shuffled (a full
one thins less), and the exact join decides.

Defined results: items of under ``MIN_WORDS`` words are no evidence and never
match, likewise null or empty texts; shorter items than a window must agree
in 80 % of the whole item; repeated rows and copied items count each; rows
with null ids are matched too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, mix, ship, slices, text_buffer, text_key, words

#: Lossless for the window sizes and substitutions above.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))
WINDOW = 13
MIN_WORDS = 8
AGREE = 0.8
MAX_BITMAP_BITS = 1 << 30
_COEFFICIENTS = np.random.default_rng(97).integers(1, 2**63, (len(MASKS), 16), dtype=np.uint64) | np.uint64(1)


def seeds(hashes: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, place)`` of mask ``m`` wherever it lies inside one row."""
    span = MASKS[m][-1] + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in MASKS[m]:
        total += hashes[j : j + n] * _COEFFICIENTS[m, j]
    last = np.repeat(first[1:], np.diff(first))[:n]  # end of the row each word is in
    place = np.flatnonzero(np.arange(n) + span <= last)
    return mix(total[place], m), place


def contexts(hashes: np.ndarray, first: np.ndarray, place: np.ndarray, row: np.ndarray, outside: int) -> np.ndarray:
    """Words from ``WINDOW - 1`` before to ``WINDOW - 1`` after each place;
    ``outside`` (no word) beyond the row."""
    at = place[:, None] + np.arange(1 - WINDOW, WINDOW)[None, :]
    inside = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
    return np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(outside))


def _hits(part: pa.RecordBatch, outside: int, wanted=None) -> Iterator[pa.RecordBatch]:
    hashes, first = words(*text_buffer(part.column("text")))
    length = np.diff(first)
    for m in range(len(MASKS)):
        h, place = seeds(hashes, first, m)
        if wanted is not None:
            keep = wanted(h)
            h, place = h[keep], place[keep]
        row = np.searchsorted(first, place, side="right") - 1
        if wanted is None:
            keep = length[row] >= MIN_WORDS
            h, place, row = h[keep], place[keep], row[keep]
        for i in range(0, len(h), 4096):
            h1, p1, r1 = h[i : i + 4096], place[i : i + 4096], row[i : i + 4096]
            ctx = np.ascontiguousarray(contexts(hashes, first, p1, r1, outside)).tobytes()
            ctx = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * (2 * WINDOW - 1)), len(h1), [None, pa.py_buffer(ctx)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("k").take(pa.array(r1)), pa.array(h1.view(np.int64)), pa.array(p1 - first[r1], pa.int64()), pa.array(length[r1], pa.int64()), ctx],
                names=["k", "seed", "place", "n_words", "context"],
            )


def _seed_rows(df: DataFrame, kind: str, outside: int, bitmap=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        wanted = None
        if bitmap is not None:
            bits, shift = bitmap.value
            wanted = lambda h: bits[(x := h >> np.uint64(shift)) >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1 == 1
        for batch in batches:
            for part in slices(batch, "text"):
                yield from _hits(part, outside, wanted)

    return df.mapInArrow(run, f"k {kind}, seed bigint, place bigint, n_words bigint, context binary")


def _bitmap(items: DataFrame, spark):
    """Bits of the seeds' top places: at least 64 per seed up to the bound.
    Each task sends the places it sets, spread by place, so no task or the
    driver holds more than the bitmap itself."""
    n = items.count()
    width = min(max(10, int(np.ceil(np.log2(max(1, n) * 64)))), MAX_BITMAP_BITS.bit_length() - 1)
    bits = np.zeros(1 << (width - 3), np.uint8)
    places = items.select(F.shiftrightunsigned("seed", 64 - width).alias("at")).distinct()
    packed = places.groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at % 8 as int)))").alias("value"))
    for batch in packed.toLocalIterator(prefetchPartitions=False):
        bits[batch.byte] = batch.value
    return spark.sparkContext.broadcast((bits, 64 - width))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        wide = 2 * WINDOW - 1
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, wide) for c in ("context", "item_context"))
        same = np.concatenate([np.zeros((len(a), 1), np.int64), np.cumsum(a == b, axis=1)], axis=1)
        size = np.minimum(batch.column("item_words").to_numpy(zero_copy_only=False), WINDOW)
        best = np.zeros(len(a), np.int64)
        for w in np.unique(size):
            at = np.flatnonzero(size == w)
            best[at] = (same[at, w:] - same[at, : wide + 1 - w]).max(1)
        keep = best >= np.ceil(AGREE * size - 1e-9)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k").filter(pa.array(keep)), batch.column("item").filter(pa.array(keep)), pa.array(best[keep]), pa.array(best[keep] / size[keep], pa.float64())],
            names=["k", "item", "agree", "share"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per contaminated ``(key, item_key)`` with the most agreeing
    words of a window (``agree``) and their share of it. The texts stay where
    they are; only seeds that the benchmark may hold are shuffled."""
    spark = ship(docs)
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    tests = benchmark.select(F.col(item_key).alias("k"), F.col(item_text).alias("text"))
    items = _seed_rows(tests, kinds[1], 1)
    bitmap = _bitmap(items, spark)
    hits = _seed_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), kinds[0], 0, bitmap)
    items = items.select("seed", F.col("k").alias("item"), F.col("n_words").alias("item_words"), F.col("context").alias("item_context"))
    joined = hits.join(items, "seed").select("k", "item", "item_words", "context", "item_context")
    found = joined.mapInArrow(_verify, f"k {kinds[0]}, item {kinds[1]}, agree bigint, share double")
    best = found.groupBy("k", "item").agg(F.max("agree").alias("agree"), F.max("share").alias("share"))
    return best.select(F.col("k").alias(key), F.col("item").alias(item_key), "agree", "share")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage. Rows are judged
    by their text alone, so null or repeated ids take no other row along."""
    name = fresh(docs, "_text_key")
    keyed = docs.withColumn(name, text_key(text))
    bad = contaminated(keyed, benchmark, text, name, item_text, item_key).select(name).distinct()
    return keyed.join(bad, name, "left_anti").select(*docs.columns)
