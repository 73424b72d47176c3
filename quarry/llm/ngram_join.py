"""N-gram Jaccard self-join by multiple-global-order filtering.

A document's set is its distinct ``width``-word shingles; documents link at
Jaccard >= num/den. If two sets reach that, their prefixes (the first
``n - ceil(t * n) + 1`` shingles) under *any* global order of all shingles
share a shingle. Several orders are used at once:

* the joining order puts common shingles last: shingles of a fixed part of
  the hash range are counted over the corpus, those in ``COMMON`` documents
  or more become "common" in a bitmap, and the order is (counted and not
  common, not counted, common), then by hash. The bitmap is part of the
  order's definition, so a wrong bit costs time and never a link;
* ``PARTS`` further orders, each putting one part of the hash range first: a
  set keeps of each the first shingle, its prefix of length one, as one bit,
  and whether it has any. The first of the two sets' shingles in a part is in
  both sets with probability J, whatever their sizes, so the parts where the
  prefixes differ are at most binomial. A pair passes unless more parts differ
  than a pair at the threshold has with probability ``MISS`` (1e-12: a link
  is lost as rarely as two 64-bit hashes meet).

Pairs must pass all filters at once (shared prefix shingle, first shingles
under the other orders, sizes, and the parity sketch, whose differing bits
never outnumber the differing shingles and which decides small sets) before
the sets themselves are compared.

Only components are asked for, so no group is expanded to all its pairs, and
no pair that a task refutes becomes a row. A bucket's task keeps a forest of
its passing pairs: fewer rows than the bucket has, and what passes is joined
by them. The components of these forests are *families*: linked sets are
always in one family. The sets of a family are then brought together once (in
block pairs when it is large), compared exactly, sketches first, and again a
forest of the links is kept; its components are the result. Sets that are
known to be joined are not compared again. Equal sets are one vertex, named
by a 64-bit hash of the set.

Defined results: null, empty or wordless texts have an empty set and are
their own component; texts under ``width`` words have one shingle; rows of
null id join no group and have a null component; rows with the same id and
text are one document; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MAX_BITMAP_BITS, PAGE_BITS, bitmap, mix, ship, slices, text_buffer, thinned, words, written
from quarry.llm.graph import blocked, components, groups

COMMON = 48
#: Bytes of the parity sketch; orders whose first shingles are compared (a
#: multiple of 64) and the probability that a link is lost by them.
SKETCH, PARTS, MISS = 16, 256, 1e-12
#: Groups up to this size are compared together, without a step for each.
SMALL = 32


@dataclass(frozen=True)
class Rule:
    """Shingle width and the least Jaccard similarity num / den."""

    width: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    @property
    def counted(self) -> int:
        """Shingles with a smaller hash are counted: twice a prefix's share."""
        return int(min(1.0, 2 * (1 - self.num / self.den) + 0.02) * (2**64 - 1))

    def most_apart(self, na, nb):
        """Most differing shingles of linked sets of these sizes."""
        return (na + nb) * (self.den - self.num) // (self.den + self.num)

    def most_parts(self, share: float = 1.0) -> np.ndarray:
        """By the number of parts that either set has a shingle in: most parts
        whose first shingles differ, each counted with probability ``share``."""
        p, out = share * (1 - self.num / self.den), []
        for n in range(PARTS + 1):
            tail, k = 0.0, n
            while k > 0:
                tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
                if tail > MISS:
                    break
                k -= 1
            out.append(k)
        return np.array(out)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    out, n = [], len(hashes)
    total = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        total += mix(hashes[j : j + len(total)], j) * np.uint64(2 * j + 3)
    total = mix(total, 40)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:  # the whole sequence, told from full shingles by its length
            h = np.uint64(b - a)
            for w in hashes[a:b]:
                h = mix(np.array([h ^ w], np.uint64), 50)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_node(s: np.ndarray) -> int:
    """64-bit hash of a whole set that is not empty."""
    a = int(np.add.reduce(mix(s, 80))) ^ int(np.bitwise_xor.reduce(mix(s, 81)))
    return int(mix(np.array([a], np.uint64), len(s) % 1000)[0].view(np.int64))


def first_shingles(s: np.ndarray) -> bytes:
    """Per part of the hash range: has the set a shingle there, and one bit of
    the first one."""
    h = mix(s, 61)
    key = np.sort((h & np.uint64(PARTS - 1)) << np.uint64(48) | h >> np.uint64(16))
    part = (key >> np.uint64(48)).astype(np.int64)
    first = np.concatenate([[True], part[1:] != part[:-1]])
    bits = np.zeros((2, PARTS), np.uint8)
    bits[0, part[first]] = 1
    bits[1, part[first]] = (key[first] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).tobytes()


def parity_sketch(s: np.ndarray, size: int = SKETCH) -> bytes:
    """Parity of the shingles at each of ``size`` bytes' bits (a power of two);
    a sketch's halves joined by xor are the sketch of half the size."""
    bits = np.bincount((mix(s, 60) & np.uint64(size * 8 - 1)).astype(np.int64), minlength=size * 8) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


class Orders:
    """Global orders over shingles from the bitmap of common ones."""

    def __init__(self, rule: Rule, common: np.ndarray, shift: int):
        self.rule, self.common, self.shift = rule, common, np.uint64(shift)

    def classes(self, s: np.ndarray) -> np.ndarray:
        counted = s < np.uint64(self.rule.counted)
        at = s * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        common = (self.common[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return np.where(counted, np.where(common, 2, 0), 1)

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """Prefix under the joining order."""
        kind = self.classes(s)
        return np.concatenate([s[kind == c] for c in (0, 1, 2)])[: self.rule.prefix(len(s))]  # s is sorted already


def _common_bitmap(texts: DataFrame, rule: Rule) -> tuple[np.ndarray, int]:
    """Bitmap of the counted shingles that ``COMMON`` documents or more hold."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*words(*text_buffer(part.column("text"))), rule.width)
                some = np.concatenate([s[: np.searchsorted(s, np.uint64(rule.counted))] for s in sets])
                h, n = np.unique(some, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    common = texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    common = written(common.select("h"), "common-shingles")
    width = min(max(PAGE_BITS, int(np.ceil(np.log2(max(1, common.count()) * 32)))), MAX_BITMAP_BITS.bit_length() - 1)

    def places(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - width)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int64))], names=["at"])

    return bitmap(common.mapInArrow(places, "at bigint"), width), 64 - width


def _describe(texts: DataFrame, rule: Rule, shared, kind: str) -> DataFrame:
    """``k, node, n, prefix, filters`` of every row; node is null for an empty
    set; filters holds the sketch and the first shingles of the other orders."""

    def run(batches: Iterator[pa.RecordBatch]):
        orders = Orders(rule, *shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*words(*text_buffer(part.column("text"))), rule.width)
                node, prefix, filters = [], [], []
                for s in sets:
                    if not len(s):
                        node.append(None), prefix.append(None), filters.append(None)
                        continue
                    node.append(set_node(s))
                    prefix.append(orders.prefix(s).view(np.int64))
                    filters.append(parity_sketch(s) + first_shingles(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(filters, pa.binary())],
                    names=["k", "node", "n", "prefix", "filters"],
                )

    return texts.mapInArrow(run, f"k {kind}, node bigint, n bigint, prefix array<bigint>, filters binary")


class Filters:
    """Which pairs pass sizes, sketch and first shingles under ``rule``."""

    def __init__(self, rule: Rule):
        self.rule, self.most, self.most_bits = rule, rule.most_parts(), rule.most_parts(0.5)

    def passing(self, n: np.ndarray, f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``f``: filters as rows of 64-bit words, sketch first."""
        rule, w, v = self.rule, SKETCH // 8, PARTS // 64
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        at = np.flatnonzero(low * rule.den >= high * rule.num)
        a, b = f[i[at]], f[j[at]]
        ok = np.bitwise_count(a[:, :w] ^ b[:, :w]).sum(1) <= rule.most_apart(n[i[at]], n[j[at]])
        at, a, b = at[ok], a[ok], b[ok]
        both, one = a[:, w : w + v] & b[:, w : w + v], a[:, w : w + v] ^ b[:, w : w + v]
        bits = np.bitwise_count(both & (a[:, w + v :] ^ b[:, w + v :])).sum(1, dtype=np.int64)
        alone = np.bitwise_count(one).sum(1, dtype=np.int64)
        parts = np.bitwise_count(both).sum(1, dtype=np.int64) + alone
        # two different first shingles show different bits half of the time
        ok = (alone + bits <= self.most[parts]) & (bits <= self.most_bits[parts])
        out = np.zeros(len(low), bool)
        out[at[ok]] = True
        return out


class Joined:
    """Which rows of a group are joined so far. ``join`` takes pairs of rows
    and returns those that joined something: a forest."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = self.label[i], self.label[j]
        key, at = np.unique(np.minimum(p, q) * len(self.label) + np.maximum(p, q), return_index=True)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        kept = []
        for place, x, y in zip(at.tolist(), (key // len(self.label)).tolist(), (key % len(self.label)).tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(place)
        if up:
            to = np.arange(len(self.label))
            to[list(up)] = [root(x) for x in up]
            self.label = to[self.label]
        return i[kept], j[kept]


def sides(part: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The two sides of a block pair; the same rows twice for one block."""
    if lo == hi:
        return (np.arange(len(part)),) * 2
    return np.flatnonzero(part == lo), np.flatnonzero(part == hi)


def unjoined(left: np.ndarray, right: np.ndarray, joined: Joined) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows not joined yet, some rows of the left side at a time."""
    for x in range(0, len(left), 64):
        some = left[x : x + 64]
        i, j = np.nonzero(joined.label[some][:, None] != joined.label[right][None, :])
        i, j = some[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _candidates(rows: DataFrame, rule: Rule) -> DataFrame:
    """Forests ``(a, b)`` of the passing pairs inside the buckets."""
    filters = Filters(rule)

    def pairs(g: pa.Table) -> pa.RecordBatch | None:
        """The forest of a run of whole groups."""
        node, part, n, bucket, lo, hi = (g.column(c).to_numpy() for c in ("node", "part", "n", "bucket", "lo", "hi"))
        f = np.frombuffer(b"".join(g.column("filters").to_pylist()), np.uint64).reshape(len(node), -1)
        group = np.cumsum(np.concatenate([[0], (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        size = np.bincount(group)
        _, vertex = np.unique(node, return_inverse=True)  # a set is in many buckets
        joined, found = Joined(int(vertex.max()) + 1), []

        def keep(i, j):
            ok = joined.label[vertex[i]] != joined.label[vertex[j]]
            i, j = i[ok], j[ok]
            ok = filters.passing(n, f, i, j)
            a, b = joined.join(vertex[i[ok]], vertex[j[ok]])
            found.append((a, b))

        # small groups: all of them at once, by the distance of their rows
        small = (size[group] <= SMALL) & (lo == hi)
        for d in range(1, min(SMALL, int(size.max()))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            if len(i):
                keep(i, i + d)
        starts = np.concatenate([[0], np.cumsum(size)])
        for k in np.flatnonzero((size > SMALL) | (lo != hi)[starts[:-1]]):
            first = starts[k]
            left, right = (x + first for x in sides(part[first : starts[k + 1]], lo[first], hi[first]))
            same = lo[first] == hi[first]
            for x in range(0, len(left), 64):
                some = left[x : x + 64]
                i, j = np.nonzero(joined.label[vertex[some]][:, None] != joined.label[vertex[right]][None, :])
                i, j = some[i], right[j]
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    keep(i, j)
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if not len(a):
            return None
        names = np.zeros(len(joined.label), np.int64)
        names[vertex] = node
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        waiting, size = [], 0
        for g in groups(batches, ("bucket", "lo", "hi")):
            waiting.append(g)
            size += len(g)
            if size >= 20_000:
                if (out := pairs(pa.concat_tables(waiting))) is not None:
                    yield out
                waiting, size = [], 0
        if waiting and (out := pairs(pa.concat_tables(waiting))) is not None:
            yield out

    cols = "bucket", "lo", "hi"
    sorted_ = rows.repartition(*cols).sortWithinPartitions(*cols)
    return sorted_.mapInArrow(run, "a bigint, b bigint")


class Sets:
    """Sets of a family, compared exactly."""

    def __init__(self, column, rule: Rule):
        self.rule = rule
        raw = [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
        self.n = np.array([len(x) for x in raw])
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        # shingles as numbers of this family; two bits of parity a shingle
        _, flat = np.unique(np.concatenate(raw), return_inverse=True)
        self.flat, self.seen = flat, np.zeros(int(flat.max()) + 1, bool)
        size = 1 << max(3, int(self.n.max()).bit_length() - 2)
        self.sketch = np.frombuffer(b"".join(parity_sketch(x, size) for x in raw), np.uint64).reshape(len(raw), -1)

    def linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the pairs that link; pairs of one ``i`` stand together."""
        rule = self.rule
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        at = np.flatnonzero(low * rule.den >= high * rule.num)
        ok = [np.bitwise_count(self.sketch[i[p]] ^ self.sketch[j[p]]).sum(1, dtype=np.int64) <= rule.most_apart(self.n[i[p]], self.n[j[p]]) for p in np.array_split(at, 1 + len(at) // 4096)]
        at = at[np.concatenate(ok)]
        out = []
        for row in np.unique(i[at]):
            mine = at[i[at] == row]
            others = j[mine]
            here = self.flat[self.first[row] : self.first[row + 1]]
            self.seen[here] = True
            length = self.n[others]
            cuts = np.concatenate([[0], np.cumsum(length)])
            place = np.repeat(self.first[others] - cuts[:-1], length) + np.arange(cuts[-1])
            both = np.add.reduceat(self.seen[self.flat[place]].astype(np.int64), cuts[:-1])
            self.seen[here] = False
            out.append(mine[rule.den * both >= rule.num * (len(here) + length - both)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _verified(families: DataFrame, texts: DataFrame, names: DataFrame, rule: Rule) -> DataFrame:
    """Forests ``(a, b)`` of the links inside the families. Few texts but those
    of family members are shuffled; the sets of a family meet in one task, or
    in block pairs where it is large."""
    cut = blocked(families.select("node", F.col("component").alias("family")), "family", "node")
    chosen = written(names.join(cut, "node").select("k", "node", "family", "lo", "hi", "part"), "chosen-sets")
    chosen = thinned(texts, chosen, "k").join(chosen, "k")
    cols = "family", "lo", "hi"

    def sets(batches: Iterator[pa.RecordBatch]):
        sent = set()
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(*words(*text_buffer(part.column("text"))), rule.width)
                # an id may have other texts too, and its text many times
                keys = list(zip(*(part.column(c).to_pylist() for c in (*cols, "node"))))
                kept = [i for i, (s, key) in enumerate(zip(found, keys)) if len(s) and set_node(s) == key[-1] and not (key in sent or sent.add(key))]
                found, part = [found[i] for i in kept], part.take(pa.array(kept, pa.int64()))
                same = [part.column(c) for c in (*cols, "part", "node")]
                yield pa.RecordBatch.from_arrays([*same, pa.array([s.tobytes() for s in found], pa.binary())], names=[*cols, "part", "node", "set"])

    known = chosen.select(*cols, "part", "node", "text").mapInArrow(sets, "family bigint, lo int, hi int, part int, node bigint, set binary")

    def check(batches: Iterator[pa.RecordBatch]):
        for g in groups(batches, cols):
            node, held = g.column("node").to_numpy(), Sets(g.column("set"), rule)
            joined = Joined(len(node))
            for i, j in unjoined(*sides(g.column("part").to_numpy(), g.column("lo")[0].as_py(), g.column("hi")[0].as_py()), joined):
                ok = held.linked(i, j)
                a, b = joined.join(i[ok], j[ok])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return known.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(check, "a bigint, b bigint")


def near_duplicates(df: DataFrame, rule: Rule = Rule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``df``; the component
    is the smallest ``key`` reachable by links."""
    spark = ship(df)
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(_common_bitmap(texts, rule))
    table = written(_describe(texts, rule, shared, kind), "shingle-prefixes")
    usable = table.where("node is not null and k is not null")
    names = usable.groupBy("node").agg(F.min("k").alias("k"))
    # one row per set: its smallest id; rows of one id and set are alike
    names = written(names, "shingle-classes")
    sets = usable.join(names.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & usable["k"].eqNullSafe(names["k"]), "left_semi").dropDuplicates(["node"])
    sets = written(sets.select("node", "n", "prefix", "filters"), "shingle-sets")
    buckets = written(blocked(sets.select("node", F.explode("prefix").alias("bucket")), "bucket", "node"), "shingle-buckets")
    payload = sets.select("node", "n", "filters")
    families = components(_candidates(buckets.join(payload, "node"), rule))
    label = components(_verified(families, texts, names, rule))
    members = names.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = members.groupBy("component").agg(F.min("k").alias("component_id"))
    of_set = members.join(least, "component").select("node", "component_id")
    out = table.select("k", "n", F.when(F.col("k").isNotNull(), F.col("node")).alias("node")).join(of_set, "node", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))
