"""Connected components and split buckets, shared by the similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Links that one task may finish alone (16 bytes each).
ONE_TASK = 1_000_000
#: Rows of a bucket's block: a task compares at most two blocks at once.
BLOCK = 2048


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as (node, smallest node it is joined with there)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["a", "b"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (two bigint columns,
    no nulls); the component is the smallest node reachable.

    Each partition first shrinks its links to a forest. What is left is
    contracted by alternating large-star and small-star steps, each written,
    and finished in one task once it is proven to fit there.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    schema = "a bigint, b bigint"
    edges = written(edges.mapInArrow(_forest, schema).where("a <> b"), "links")
    n = edges.count()
    state = None
    while n > one_task:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = large.join(least, F.col("a") == F.col("k"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = now[0]
        if tuple(now) == state:
            break
        state = tuple(now)
    if n <= one_task:
        edges = edges.coalesce(1).mapInArrow(_forest, schema)
    found = written(edges.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots)


def blocked(rows: DataFrame, key: str, node: str, block: int = BLOCK) -> DataFrame:
    """Rows of buckets of two or more, dealt to block pairs.

    Adds ``lo, hi, part``: a bucket of up to ``block`` rows is one task group
    ``(0, 0)``; a larger one is cut by a hash of ``node`` into blocks, and each
    row goes to every pair of blocks that holds its own, so that a group never
    has much over two blocks of rows however hot the bucket is."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    cut = rows.join(sizes, key).withColumn("_k", F.ceil(F.col("_n") / block).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64(node), F.col("_k")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return cut.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_n", "_k", "_other")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` (integers) of sorted batches; only the last run
    of a batch waits for the next one."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        first = tuple(int(c[0]) for c in cols)
        if waiting and first != last:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for lo, hi in zip(cuts, cuts[1:]):
            if lo and waiting:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(lo, hi - lo))
        last = tuple(int(c[-1]) for c in cols)
    if waiting:
        yield pa.Table.from_batches(waiting)
