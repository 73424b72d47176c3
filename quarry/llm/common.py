"""Helpers of the training-data operators: byte-bounded Arrow slices, word
hashing on whole UTF-8 buffers, and written lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, ship_package

#: Bytes of text that one numpy step handles at once; a longer single text is
#: handled alone.
SLICE_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: a lineage
    cut that survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows go to a Python worker in batches of at most so many bytes, unless the
#: session says otherwise: 10,000 whole texts, Spark's default, may be many.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return spark


#: A bitmap is never larger than this; a fuller one only thins less.
MAX_BITMAP_BITS = 1 << 30
PAGE_BITS = 13


def bitmap(places: DataFrame, width: int) -> np.ndarray:
    """Bytes of a bitmap of ``2**width`` bits with those at the values of the
    only column, ``at``, set. One job makes it in pages of ``2**PAGE_BITS``
    bits; the driver gets the pages and nothing else."""

    def pages(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.sort(batch.column("at").to_numpy(zero_copy_only=False))
            numbers, first = np.unique(at >> PAGE_BITS, return_index=True)
            for number, places in zip(numbers.tolist(), np.split(at & ((1 << PAGE_BITS) - 1), first[1:])):
                page = held.setdefault(number, np.zeros(1 << PAGE_BITS - 3, np.uint8))
                np.bitwise_or.at(page, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([p.tobytes() for p in held.values()], pa.binary())], names=["number", "bits"])

    marks = places.distinct().withColumn("number", F.shiftright("at", PAGE_BITS))
    bits = np.zeros((1 << width - PAGE_BITS, 1 << PAGE_BITS - 3), np.uint8)
    for row in marks.repartition("number").select("at").mapInArrow(pages, "number bigint, bits binary").collect():
        bits[row.number] |= np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def thinned(df: DataFrame, wanted: DataFrame, key: str, per_key: int = 32) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be one of ``wanted``, to be joined
    exactly afterwards: all wanted rows and, as long as the bitmap has its
    ``per_key`` bits, about one in ``per_key`` of the others. Rows of null key
    go. The driver gets the bitmap (at most 128 MB) in pages and nothing else."""
    width = min(max(PAGE_BITS, int(np.ceil(np.log2(max(1, wanted.count()) * per_key)))), MAX_BITMAP_BITS.bit_length() - 1)
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - width)
    shared = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place.alias("at")), width))

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        a = at.to_numpy()
        return pd.Series((shared.value[a >> 3] >> (a & 7) & 1).astype(bool))

    return df.where(F.col(key).isNotNull()).withColumn("_at", place).where(marked("_at")).drop("_at")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def text_key(column: str):
    """128-bit hash of a text, by which equal texts are known; null for null."""
    return F.unhex(F.md5(F.col(column)))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's), wrapping."""
    h = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def one_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column without copying; null is empty."""
    arr = one_array(col)
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``max_bytes`` of text and
    at most ``max_rows`` rows."""
    _, off = text_buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + max_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows, A-Z lower-cased:
    ``(64-bit hash per word, index of each row's first word with the total
    appended)``. Two words are held equal when their 64-bit hashes are.
    ``space``: which bytes part words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # a row's border is a word's border
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:n]))
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    where = np.flatnonzero(solid)
    index = np.searchsorted(where, starts)  # each word's first place among solid bytes
    length = np.diff(np.append(index, len(where)))
    powers = _powers(int(length.max()))
    place = np.arange(len(where)) - np.repeat(index, length)
    values = _BYTE_VALUES[data[where]] * powers[place]
    hashes = mix(np.add.reduceat(values, index) + length.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n + 1:
        grown = np.full(max(n + 1, 64), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over rows ``first[i]:first[i+1]`` (empty rows: 0)."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def code_points(col) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and each row's first place (total appended)."""
    data, off = text_buffer(col)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, lead[off]
