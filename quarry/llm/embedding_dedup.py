"""Embedding near-duplicates by spherical-cap filters.

Filter directions are the product of two random codebooks on the two halves
of a randomly rotated vector: ``size * size`` directions from ``2 * size``
stored ones. A vector is list-decoded to *all* directions whose cap holds it:
with one half's scores sorted, the partners of each word of the other half
are a prefix, so the cost is the list's length and not the number of
directions; at least the ``LEAST_CAPS`` best are taken. Vectors are joined on shared filters and verified in double
precision. Directions grow with the number of vectors (two each) and the cap
is set so that a vector lies in ``CAPS`` filters on average, so buckets stay
small at every size. Dense buckets are cut into block pairs.

Recall is a matter of chance per pair (it must share one of about 40
filters), measured in the tests against brute force; precision is exact.

Defined results: null or zero vectors, and ones with null or non-finite
components, have no links; identical vectors are all linked; vectors of
different lengths are never linked; rows of the same id are one vertex, which
has the links of all its vectors, and other ids are counted once each (a row
of it without a usable vector has none); a null id links with nothing and has
a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import one_array, ship, written
from quarry.llm.graph import blocked, components, groups

THRESHOLD = 0.95
CAPS = 32
LEAST_CAPS = 24
PER_VECTOR = 2
LEAST_DIRECTIONS = 4096


class CapCode:
    """The product code for one vector length; equal on every machine."""

    def __init__(self, dim: int, directions: int, caps: float = CAPS, least: int = LEAST_CAPS, seed: int = 3):
        self.least = least
        rng = np.random.default_rng([seed, dim])
        self.size = max(2, int(np.ceil(np.sqrt(directions))))
        if dim <= 512:
            self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        else:  # signs and a permutation, as a full rotation costs dim squared
            self.turn = None
            self.signs, self.order = rng.choice([-1.0, 1.0], dim), rng.permutation(dim)
        self.half = max(1, dim // 2)
        self.books = []
        for width in (self.half, dim - self.half):
            words = rng.standard_normal((self.size, max(1, width)))
            self.books.append(words / np.linalg.norm(words, axis=1, keepdims=True))
        probe = rng.standard_normal((256, dim))
        a, b = self.scores(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        # the cap's border: over random vectors, `caps` of all directions exceed it
        share = min(1.0, caps / self.size**2)
        # the m best sums use the m best words of either half only
        m = max(1, int(4 * caps))
        rows = []
        for x, y in zip(a, b):
            x, y = (np.partition(v, -min(m, self.size))[-min(m, self.size) :] for v in (x, y))
            sums = np.add.outer(x, y).ravel()
            rows.append(np.partition(sums, -m)[-m:] if len(sums) > m else sums)
        top = np.sort(np.concatenate(rows))[::-1]
        self.border = top[min(len(top) - 1, int(share * self.size**2 * len(probe)))]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x @ self.turn if self.turn is not None else (x * self.signs)[:, self.order]
        rest = x[:, self.half :] if x.shape[1] > self.half else np.zeros((len(x), 1))
        return x[:, : self.half] @ self.books[0].T, rest @ self.books[1].T

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """All filters of each unit vector whose score reaches the border, or
        the vector's own ``least``-th best score where that is lower: some
        regions of the sphere have few caps, and groups may live there."""
        out, k = [], min(self.least, self.size)
        for a, b in zip(*self.scores(x)):
            order = np.argsort(-b)
            # the k best sums use the k best words of either half only
            best = np.add.outer(np.partition(a, -k)[-k:], b[order[:k]]).ravel()
            border = min(self.border, np.partition(best, -k)[-k])
            many = np.searchsorted(-b[order], a - border, side="right")
            at = np.repeat(np.arange(self.size), many)
            within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            out.append(at.astype(np.int64) * self.size + order[within])
        return out


@lru_cache(maxsize=8)
def code_for(dim: int, directions: int, caps: float) -> CapCode:
    return CapCode(dim, directions, caps)


def _matrix(col, dim: int) -> np.ndarray:
    x = one_array(col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(classes: DataFrame, directions: int, threshold: float = THRESHOLD, caps: float = CAPS) -> DataFrame:
    """Distinct links ``(a, b)``, a < b, between rows ``(node, vector)``."""

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dims = np.diff(np.append(0, np.cumsum([len(v) for v in batch.column("vector")])))
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(at)
                found = code_for(int(dim), directions, caps).decode(_matrix(part.column("vector"), int(dim)))
                # vectors of another length live in other buckets
                found = [(f << 14) + int(dim) for f in found]
                for i in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_arrays([part.column("node").slice(i, 1000), pa.array(found[i : i + 1000], pa.list_(pa.int64()))], names=["node", "filters"])

    def verify(batches: Iterator[pa.RecordBatch]):
        for g in groups(batches, ("bucket", "lo", "hi")):
            node, part = g.column("node").to_numpy(), g.column("part").to_numpy()
            x = _matrix(g.column("vector"), len(g.column("vector")[0]))
            lo, hi = g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
            if lo == hi:
                i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            else:
                one, two = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
                i, j = np.nonzero(x[one] @ x[two].T >= threshold)
                i, j = one[i], two[j]
            if len(i):
                p, q = node[i], node[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    kept = written(classes.mapInArrow(assign, "node bigint, filters array<bigint>"), "caps")
    rows = blocked(kept.select("node", F.explode("filters").alias("bucket")), "bucket", "node")
    rows = rows.join(classes, "node").select("bucket", "lo", "hi", "part", "node", "vector")
    rows = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return rows.mapInArrow(verify, "a bigint, b bigint").where("a <> b").distinct()


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, caps: float = CAPS) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row of ``df``."""
    ship(df)
    v = F.col("vector")
    # x - x is 0 for finite x only; a sum of squares of 0 is the zero vector
    usable = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ((x - x) == 0))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"), F.col(key).alias("_key"))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull())
    # identical vectors are one class; an id with several vectors is in several
    node = F.xxhash64(F.sha2(F.to_json(F.struct("vector")), 256))
    good = rows.where("ok").select("id", "vector", node.alias("node"))
    member = written(good.select("id", "node").distinct(), "vector-members")
    classes = written(good.groupBy("node").agg(F.first("vector").alias("vector")), "vector-classes")
    n = classes.count()
    found = written(links(classes, max(LEAST_DIRECTIONS, PER_VECTOR * n), threshold, caps), "vector-links")
    sizes = member.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    near = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.unionByName(classes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    weight = sizes.select(F.col("node").alias("b"), "size")
    of_class = near.join(weight, "b").groupBy(F.col("a").alias("node")).agg((F.sum("size") - 1).alias("class_links"))
    several = written(member.join(member.groupBy("id").count().where("count > 1").select("id"), "id"), "several-vectors")
    joined, of_id = found, None
    if not several.isEmpty():
        # the ids of near classes, each once: what an id is counted for beyond
        # once goes off again; an id's own near classes are those of its vectors
        again = several.select(F.col("id").alias("other"), F.col("node").alias("b"))

        def counted(reach: DataFrame, owner: str) -> DataFrame:
            total = reach.join(weight, "b").groupBy(owner).agg(F.sum("size").alias("total"))
            twice = reach.join(again, "b").groupBy(owner, "other").count().groupBy(owner).agg(F.sum(F.col("count") - 1).alias("twice"))
            return total.join(twice, owner, "left").select(owner, (F.col("total") - F.coalesce("twice", F.lit(0)) - 1).alias("links"))

        of_class = counted(near.withColumnRenamed("a", "node"), "node").withColumnRenamed("links", "class_links")
        reach = several.join(near.withColumnRenamed("a", "node"), "node").select("id", "b").distinct()
        of_id = counted(reach, "id").withColumnRenamed("links", "id_links")
        first = several.groupBy("id").agg(F.min("node").alias("a"))
        joined = found.unionByName(several.join(first, "id").select("a", F.col("node").alias("b")).where("a <> b"))
    place = sizes.select("node", "least").join(components(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = place.groupBy("component").agg(F.min("least").alias("component_id"))
    values = place.join(least, "component").join(of_class, "node").select("node", "class_links", "component_id")
    out = rows.select("_key", "id", F.when(F.col("ok"), node).alias("node")).join(values, "node", "left")
    if of_id is not None:
        out = out.join(of_id, "id", "left").withColumn("class_links", F.when(F.col("node").isNotNull(), F.coalesce("id_links", "class_links")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("_key").alias(key), F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
