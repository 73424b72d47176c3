"""Bounded-space online packing.

Each partition streams its documents past at most ``open_windows`` unfinished
windows. Whole windows are cut from long documents; the rest goes best-fit
into an open window. When none fits and all places are taken, the fullest
window is topped up with the head of the piece and emitted. At the end of a
partition its leftovers are merged by the same rule with cutting, so at most
one unfinished window per partition remains, kept with its token ids. These
tails are merged in rounds of ``fan_in`` partitions a task until one is left,
which is written as sequences of power-of-two lengths: no padding at all.

Defined results: null or empty text is one end token; repeated rows and null
ids are packed each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import one_array, ship, slices, written

WINDOW = 2048
OPEN_WINDOWS = 32
FAN_IN = 512
END_ID = 1
SPECIAL = "<|endoftext|>"
FIELDS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
SCHEMA = "doc_id {kind}, " + FIELDS


class Packer:
    """Open windows of one partition; pieces are (doc_id, start, ids, doc_tokens)
    with ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, sequence: int, window: int = WINDOW, places: int = OPEN_WINDOWS):
        self.sequence, self.window, self.places = sequence, window, places
        self.open: list[list] = []  # [fill, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], keep: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.sequence, at, ids if keep else None))
            at += n
        self.sequence += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size = self.window * 4
        while len(ids) >= size:
            self.emit([(doc, start, ids[:size], total)])
            start, ids = start + self.window, ids[size:]
        while ids:
            n = len(ids) // 4
            fit = max((w for w in self.open if w[0] + n <= self.window), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.places:
                self.open.append(fit := [0, []])
            if fit is not None:
                fit[0] += n
                fit[1].append((doc, start, ids, total))
                if fit[0] == self.window:
                    self.open.remove(fit)
                    self.emit(fit[1])
                return
            fullest = max(self.open, key=lambda w: w[0])
            room = self.window - fullest[0]
            self.open.remove(fullest)
            self.emit([*fullest[1], (doc, start, ids[: room * 4], total)])
            start, ids = start + room, ids[room * 4 :]

    def finish(self, last: bool) -> None:
        """Merge the open windows; the unfinished one is kept with its ids, or,
        if ``last``, written in power-of-two lengths."""
        left = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        fill, pieces, sizes = 0, [], []
        rest = sum(len(p[2]) // 4 for p in left)
        sizes = [self.window] * (rest // self.window)
        rest %= self.window
        if last:
            sizes += [1 << b for b in reversed(range(self.window.bit_length())) if rest >> b & 1]
        elif rest:
            sizes.append(rest)
        queue = iter(sizes)
        size = next(queue, 0)
        for doc, start, ids, total in left:
            while ids:
                take = min(size - fill, len(ids) // 4)
                pieces.append((doc, start, ids[: take * 4], total))
                start, ids, fill = start + take, ids[take * 4 :], fill + take
                if fill == size:
                    self.emit(pieces, keep=not last and size < self.window)
                    fill, pieces, size = 0, [], next(queue, 0)
        self.open = []

    def take(self, names, kind) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        kinds = [kind] + [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def encoder(ranks_path: str):
    """``text -> id array`` over the byte-level BPE's rank file: the same ids
    as the tokenizer file of that vocabulary, special string included."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda text: enc.encode_to_numpy(text, allowed_special="all")


def _first_sequence(level: int) -> int:
    return level << 56 | TaskContext.get().partitionId() << 28


def pack(df: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` covering every token of every row of ``df`` exactly once. One pass
    over the texts, written once; only the tails (under one window per
    partition) move between tasks afterwards. Sequence ids carry round and
    partition, so tasks number without talking to each other."""
    spark = ship(df)
    kind = df.schema[key].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)

    def first(batches: Iterator[pa.RecordBatch]):
        import numpy as np

        encode, end = encoder(ranks_path), np.array([END_ID], "<u4").tobytes()
        packer, arrow = Packer(_first_sequence(0), window, open_windows), None
        for batch in batches:
            arrow = batch.column("doc_id").type
            for part in slices(batch, "text"):
                for doc, t in zip(part.column("doc_id").to_pylist(), one_array(part.column("text")).to_pylist()):
                    ids = (np.asarray(encode(t), "<u4").tobytes() if t else b"") + end
                    packer.add(doc, 0, ids, len(ids) // 4)
                yield packer.take(NAMES, arrow)
        packer.finish(last=False)
        if packer.rows:
            yield packer.take(NAMES, arrow)

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]):
            packer, arrow = Packer(_first_sequence(level), window, open_windows), None
            for batch in batches:
                arrow = batch.column("doc_id").type
                for row in batch.to_pylist():
                    packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
                yield packer.take(NAMES, arrow)
            packer.finish(last)
            if packer.rows:
                yield packer.take(NAMES, arrow)

        return run

    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    table = written(docs.mapInArrow(first, schema), "packed")
    parts, level = max(1, docs.rdd.getNumPartitions()), 0
    done = []
    while True:
        done.append(table.where("ids is null").drop("ids") if level == 0 or parts > 1 else table.drop("ids"))
        if level and parts == 1:
            break
        parts, level = -(-parts // fan_in), level + 1
        tails = table.where("ids is not null").repartition(parts).sortWithinPartitions("sequence_id", "offset")
        table = written(tails.mapInArrow(merge(level, parts == 1), schema), f"packed-tails-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("doc_id", key)
