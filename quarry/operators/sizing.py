"""Size checks before broadcasting: broadcast only what is proven small."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import MAX_BROADCAST_QUERIES
from quarry.session import scratch_path, write_table

#: Rows of small query blocks that are read, and searched in one job, at once.
TOGETHER_ROWS = MAX_BROADCAST_QUERIES


def at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (stops counting early)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when ``df`` is proven to hold at most
    ``max_rows`` rows, else ``(df, False)`` and Spark plans a shuffle join
    (with AQE's skew-join splitting for hot keys)."""
    if at_most(df, max_rows):
        return F.broadcast(df), True
    return df, False


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    Only small inputs are touched: a scan that already has as many splits as
    the cluster has cores (any large table) is returned unchanged, so this
    never adds a shuffle of a big corpus.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def scan_tasks(df: DataFrame) -> int:
    """Tasks that read ``df`` in place; 0 where it is planned with an exchange
    (asking for its partitions would run that)."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return 0
    return df.rdd.getNumPartitions()


def in_place(df: DataFrame) -> DataFrame:
    """``df`` for many scans: written once, so that no scan makes it again."""
    path = scratch_path(df.sparkSession, "in-place")
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_if_small(df: DataFrame, max_rows: int):
    """The rows of ``df`` as pandas when there are at most ``max_rows`` of
    them, else ``None``; one bounded job both proves the size and fetches."""
    pdf = df.limit(max_rows + 1).toPandas()
    return pdf if len(pdf) <= max_rows else None


def query_blocks(df: DataFrame, max_rows: int, key: str = "query_id") -> Iterator:
    """All rows of a query side too large to broadcast, as pandas blocks of
    about ``max_rows`` rows, one after another. Rows of one ``key`` stay
    together (its top k is final in its block); the blocks are cut by a hash of
    it from a written copy; small ones come several in one bounded read."""
    path = scratch_path(df.sparkSession, "query-side")
    write_table(df, path)
    rows = df.sparkSession.read.parquet(path)
    count = max(1, math.ceil(rows.count() / max_rows))
    number, at_once = F.pmod(F.xxhash64(key), F.lit(count)), max(1, TOGETHER_ROWS // max_rows)
    for lo in range(0, count, at_once):
        read = rows.withColumn("_block", number).where(F.col("_block").between(lo, lo + at_once - 1)).toPandas()
        blocks = read.pop("_block")
        for i in range(lo, min(lo + at_once, count)):
            yield read[blocks == i].reset_index(drop=True)


def together(parts: Iterable) -> Iterator[list]:
    """``parts`` in groups of up to ``TOGETHER_ROWS`` rows, larger ones alone."""
    group, rows = [], 0
    for part in parts:
        if group and rows + len(part) > TOGETHER_ROWS:
            yield group
            group, rows = [], 0
        group, rows = [*group, part], rows + len(part)
    if group:
        yield group


def in_blocks(spark: SparkSession, parts: Iterable, search: Callable) -> DataFrame:
    """``search(part, held)`` of each part (small parts: of a group of them, in
    one job) computed and written before the next is asked for, then read back
    as one table. What a search broadcasts it puts into the list ``held``; it is
    destroyed as soon as its part is written."""
    done = []
    for group in together(parts):
        held: list = []
        found = reduce(DataFrame.unionByName, [search(part, held) for part in group])
        path = scratch_path(spark, "block-hits")
        write_table(found, path)
        for shared in held:
            shared.destroy()
        done.append(spark.read.schema(found.schema).parquet(path))
    return reduce(DataFrame.unionByName, done)
