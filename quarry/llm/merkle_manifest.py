"""Merkle manifest of a dataset by butterfly exchange.

A document's leaf is the SHA-256 of its fields; the leaves of a source, by
ascending id, form a tree of fan-out ``FANOUT`` whose root is the source's
subroot, and the subroots form the same kind of tree up to the root. While
several nodes remain, every ``FANOUT`` consecutive ones (the last run may be
shorter, even one) become the hash of their hex texts.

A tree is cut into aligned *partitions* of ``FANOUT ** DEPTH`` leaves. A task
folds its partition to one node. Then the partitions exchange as in a
butterfly: in round r those whose numbers differ in the r-th digit only (base
``FANOUT``) swap their nodes, and each hashes the common parent itself and
appends the others to its upper proof. After the last round every partition
holds the root and its own upper proof; nothing is passed down again. The
number of partitions of a tree is filled up to a power of ``FANOUT`` with
partitions without leaves, which stand in for the missing members of a group,
so a group never has more than ``FANOUT`` rows.

Ranks come from one range sort: rows before a row in its file, plus the rows
of its tree in earlier files; only per-file counts meet. What moves is a row
of about 100 bytes a document, never its text.

Defined results: null fields are written ``-``; null ids come first in their
tree, equal ids by leaf, and their text is never tampered with; the null
source is a source of its own and comes first; repeated rows are leaves each;
an empty table has no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ship, written
from quarry.llm.graph import groups

FANOUT = 3
#: Levels that one task folds: a partition has at most FANOUT ** DEPTH leaves.
DEPTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_SIDES = "array<struct<before:string,after:string>>"


def digest(*columns) -> Column:
    """Lowercase hex SHA-256 of the columns' concatenation."""
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def leaf(**replaced: Column) -> Column:
    """The leaf of a row; ``replaced`` gives other values for some fields."""
    parts = []
    for name in FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` written, with ``rank`` (from 0, by ``order``) and ``n`` (rows)
    inside each ``tree``. The sort ends with the place in the input, so rows
    alike in all columns are spread too."""
    columns = rows.columns
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, F.col("_place").asc()).sortWithinPartitions(*keys, F.col("_place").asc())
    at = F.monotonically_increasing_id()
    files = written(placed.select(*columns, F.shiftright(at, 33).alias("_file"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "merkle-sorted")
    counts = files.groupBy(tree, "_file").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    earlier = Window.partitionBy(tree).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_first"))
    counts = counts.withColumn("n", F.sum("_count").over(Window.partitionBy(tree)))
    counts = counts.select(F.col(tree).alias("_tree"), F.col("_file").alias("_in"), "_before", "n")
    joined = files.join(counts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_file") == F.col("_in")))
    return joined.select(*columns, (F.col("_at") + F.col("_before")).alias("rank"), "n")


def levels(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    k, size = 0, 1
    while size < n:
        k, size = k + 1, size * FANOUT
    return k


def fold(leaves: list[str], depth: int) -> list[list[str]]:
    """The node lists of ``depth`` levels over ``leaves``, lowest first."""
    out = [leaves]
    for _ in range(depth):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return out


def _partitions(rows: DataFrame, tree: str) -> DataFrame:
    """Rows dealt to their partitions, in order. ``_p``: number of the
    partition; ``_t`` tells the trees apart as a number."""
    dealt = rows.withColumn("_p", F.floor(F.col("rank") / FANOUT**DEPTH).cast("bigint")).withColumn("_t", F.xxhash64(F.col(tree).isNull(), tree))
    return dealt.repartition("_t", "_p").sortWithinPartitions("_t", "_p", tree, "rank")


def _whole(batches: Iterator[pa.RecordBatch], tree: str) -> Iterator[pa.Table]:
    """The partitions in sorted batches."""
    for g in groups(batches, ("_t", "_p")):
        names = g.column(tree).to_pylist()
        cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for lo, hi in zip(cuts, cuts[1:]):  # trees of one hash, should there be any
            yield g.slice(lo, hi - lo)


def partition_nodes(rows: DataFrame, tree: str) -> DataFrame:
    """``tree, p, n, node``: one row per partition."""

    def run(batches: Iterator[pa.RecordBatch]):
        for g in _whole(batches, tree):
            n = g.column("n")[0].as_py()
            top = fold(g.column("leaf").to_pylist(), min(DEPTH, levels(n)))[-1]
            one = g.slice(0, 1)
            yield pa.RecordBatch.from_arrays([one.column(tree).combine_chunks(), one.column("_p").combine_chunks(), pa.array([n]), pa.array(top, pa.string())], names=["tree", "p", "n", "node"])

    kind = rows.schema[tree].dataType.simpleString()
    return _partitions(rows, tree).select(tree, "_t", "_p", "n", "leaf").mapInArrow(run, f"tree {kind}, p bigint, n bigint, node string")


def butterfly(nodes: DataFrame) -> DataFrame:
    """``tree, p, node, upper`` of every partition after all rounds: ``node``
    is the tree's root and ``upper`` the siblings of each round."""
    size = F.ceil(F.col("n") / FANOUT**DEPTH).cast("bigint")
    nodes = written(nodes.withColumn("m", size), "merkle-nodes")
    rounds = levels(nodes.agg(F.max("m")).first()[0] or 1)
    # the partition numbers m .. FANOUT**k - 1 are filled by the last partition
    filled = F.lit(1).cast("bigint")
    for k in range(1, rounds + 1):
        filled = F.when(F.col("m") > FANOUT ** (k - 1), F.lit(FANOUT**k).cast("bigint")).otherwise(filled)
    empty = nodes.where("p = m - 1").withColumn("full", filled).where("full > m")
    empty = empty.select("tree", F.explode(F.sequence(F.col("m"), F.col("full") - 1)).alias("p"), "n", F.lit(None).cast("string").alias("node"), "m")
    state = nodes.select("tree", "p", "n", "node", "m").unionByName(empty).withColumn("upper", F.array().cast(_SIDES))
    for r in range(rounds):
        unit = FANOUT**r
        digit = (F.floor(F.col("p") / unit) % FANOUT).cast("int")
        swap = Window.partitionBy("tree", F.col("p") - digit * unit, "m")
        # nulls, of partitions without leaves, are not collected
        mates = F.sort_array(F.collect_list(F.when(F.col("node").isNotNull(), F.struct(digit.alias("d"), F.col("node").alias("h")))).over(swap))
        state = state.withColumn("_d", digit).withColumn("_mates", mates)
        side = lambda keep: F.array_join(F.transform(F.filter("_mates", keep), lambda x: x["h"]), "")
        mine = F.struct(side(lambda x: x["d"] < F.col("_d")).alias("before"), side(lambda x: x["d"] > F.col("_d")).alias("after"))
        parent = F.when(F.size("_mates") > 0, F.sha2(side(lambda x: F.lit(True)).cast("binary"), 256))
        active = F.col("m") > unit
        state = state.select(
            "tree", "p", "n", "m",
            F.when(active, parent).otherwise(F.col("node")).alias("node"),
            F.when(active, F.concat("upper", F.array(mine))).otherwise(F.col("upper")).alias("upper"),
        )
        state = written(state, f"merkle-round-{r}")
    return state.where("p < m").select("tree", "p", "n", "node", "upper")


def lower_proofs(rows: DataFrame, tree: str, carried: list[str]) -> DataFrame:
    """``carried`` and ``lower``, the siblings inside the partition, per row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for g in _whole(batches, tree):
            depth = min(DEPTH, levels(g.column("n")[0].as_py()))
            nodes = fold(g.column("leaf").to_pylist(), depth)
            proofs = []
            for i in range(len(g)):
                proof = []
                for level in nodes[:depth]:
                    first = i - i % FANOUT
                    proof.append({"before": "".join(level[first:i]), "after": "".join(level[i + 1 : first + FANOUT])})
                    i //= FANOUT
                proofs.append(proof)
            side = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
            for lo in range(0, len(g), 2000):
                part = g.slice(lo, 2000).select(carried).combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(proofs[lo : lo + 2000], side)], names=[*carried, "lower"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    dealt = _partitions(rows, tree).select(*dict.fromkeys([tree, "_t", "_p", "n", "leaf", *carried]))
    return dealt.mapInArrow(run, f"{kinds}, lower {_SIDES}")


def prove(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Trees over ``rows`` (with ``leaf``): the ranked rows, and per partition
    ``tree, p, n, node, upper`` with ``node`` the tree's root."""
    placed = ranked(rows, tree, order)
    return placed, butterfly(partition_nodes(placed, tree))


def refolded(start: Column, proof: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, start, lambda at, x: F.sha2(F.concat(x["before"], at, x["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, leaf, subroot, root, proof``
    (siblings level by level) and ``folded_root``, the root that the leaf with
    ``tampered_text`` in place of the text gives with the original siblings."""
    ship(docs)
    changed = leaf(text=tampered_text) if tampered_text is not None else leaf()
    leaves = docs.select("doc_id", "source", leaf().alias("leaf"), changed.alias("tampered"))
    placed, parts = prove(leaves, "source", ["doc_id", "leaf"])
    parts = written(parts, "merkle-source-parts")

    tops = parts.where("p = 0").select(F.col("tree").alias("source"), F.col("node").alias("leaf"), F.lit(0).alias("all"))
    tops, over = prove(tops, "all", ["source"])
    tops = lower_proofs(tops, "all", ["source", "leaf", "rank"])
    tops = tops.withColumn("_p", F.floor(F.col("rank") / FANOUT**DEPTH).cast("bigint")).join(over.select(F.col("p").alias("_p"), F.col("node").alias("root"), F.col("upper").alias("_upper")), "_p")
    tops = tops.select(F.col("source").alias("tree"), "root", F.concat("lower", "_upper").alias("top"))

    known = parts.join(tops.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree")))
    known = known.select("tree", "p", F.col("node").alias("subroot"), "root", F.concat("upper", "top").alias("above"))
    known = written(known, "merkle-upper")

    rows = lower_proofs(placed, "source", ["doc_id", "source", "leaf", "tampered", "rank"])
    rows = rows.withColumn("_p", F.floor(F.col("rank") / FANOUT**DEPTH).cast("bigint"))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("tree")) & (F.col("_p") == F.col("p")))
    rows = rows.withColumn("proof", F.concat("lower", "above"))
    return rows.select("doc_id", "source", "leaf", "subroot", "root", "proof", refolded(F.col("tampered"), F.col("proof")).alias("folded_root"))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest's digest columns, with every document of even crc32 of the
    id tampered with by deleting its text's line feeds."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(docs, text)
    joined = F.array_join(F.transform("proof", lambda x: F.concat(x["before"], x["after"])), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(joined.cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
