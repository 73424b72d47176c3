"""Search inside document shards: block-max postings and packed vectors.

A shard is a run of the key order, and ``at = shard * 2**32 + doc`` numbers
the rows of a corpus in key order, so ties on ``at`` are ties on the key.

* ``posting_rows`` keeps the postings of a term of a shard in one row
  ``(shard, term, docs, weights, block_max)``: documents ascending, the
  largest weight of every ``BLOCK`` postings beside them. ``index_topk``
  scores a shard where its rows are: the tables are bucketed by shard, so
  grouping by it moves nothing, and a task hands on k rows per query.
* ``packed_vectors`` keeps ``VECTOR_ROWS`` vectors in one row of raw float32
  with their norms; ``packed_topk`` takes a row as one numpy view.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import TOP_K
from quarry.operators.search import RunningTopK, _rows_per_block, _unit_rows, top_k
from quarry.operators.sizing import scan_tasks

#: Postings under one stored maximum, vectors in one packed row.
BLOCK = 128
VECTOR_ROWS = 1024
#: Postings of one task that are gathered into runs at once.
RUN_POSTINGS = 2_000_000
#: Terms that go into a static filter on the index: Spark hands an IN list of
#: up to 10 values to the parquet reader as they are. More are semi-joined.
MAX_FILTER_TERMS = 10
#: Scores are compared after rounding to 9 places; bounds leave that much room.
_SLACK = 1e-6


def at_column(shard: Column | str = "shard", doc: Column | str = "doc") -> Column:
    shard, doc = (F.col(c) if isinstance(c, str) else c for c in (shard, doc))
    return F.shiftleft(shard.cast("bigint"), 32) + doc.cast("bigint")


def posting_runs(rows: DataFrame, values: list[str], term: str) -> DataFrame:
    """``rows(shard, doc, term array, <values> arrays beside it)`` -> ``(shard,
    term, docs, <values>)``: the postings of a term within some Arrow batches
    (``RUN_POSTINGS`` postings) as one row, documents ascending. A run moves a posting in a few bytes, where a
    row of its own would repeat the term. ``term`` is the terms' type; values
    keep theirs."""
    types = {v: rows.schema[v].dataType.simpleString() for v in values}

    def gathered(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch.column("term").flatten())
            if n >= RUN_POSTINGS:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, n = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    def run(batches):
        for batch in gathered(batches):
            terms = batch.column("term")
            code = terms.flatten().dictionary_encode()
            if not len(code):
                continue
            row = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            shard, doc = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("shard", "doc"))
            index = code.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((doc, index, shard))
            shard, index = shard[order], index[order]
            new = (shard[1:] != shard[:-1]) | (index[1:] != index[:-1])
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            ends = pa.array(np.concatenate([first, [len(order)]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(doc[order], pa.int32()))]
            lists += [pa.ListArray.from_arrays(ends, batch.column(v).flatten().take(pa.array(order))) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[first], pa.int32()), code.dictionary.take(pa.array(index[first])), *lists], ["shard", "term", "docs", *values]
            )

    schema = ", ".join(["shard int", f"term {term}", "docs array<int>", *(f"{v} {t}" for v, t in types.items())])
    return rows.select("shard", "doc", "term", *values).mapInArrow(run, schema)


def posting_rows(rows: DataFrame, vector: str, shards: int) -> DataFrame:
    """``rows(shard, doc, <vector> map<term, float>)`` -> one row per (shard,
    term). The only exchange deals the runs of postings to their shards, where
    they are sorted by term and joined as they stream past."""
    term = rows.schema[vector].dataType.keyType.simpleString()
    flat = rows.select("shard", "doc", F.map_keys(vector).alias("term"), F.map_values(vector).alias("weights"))
    dealt = posting_runs(flat, ["weights"], term).repartition(shards, "shard").sortWithinPartitions("term", "shard")

    def finish(batches):
        waiting: list = []  # the last row's runs may go on in the next batch
        for batch in batches:
            runs = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()[0] if batch.num_rows else None
            if runs is not None:
                shard, code = runs.column("shard").to_numpy(zero_copy_only=False), runs.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.flatnonzero((shard[1:] != shard[:-1]) | (code[1:] != code[:-1])) + 1])
                waiting = [runs.slice(first[-1])]
                if len(first) > 1:
                    yield listed(runs.slice(0, first[-1]), first[:-1])
        for runs in waiting:
            yield listed(runs, np.zeros(1, np.int64))

    def listed(runs, start):
        size = np.add.reduceat(runs.column("docs").value_lengths().to_numpy(zero_copy_only=False), start)
        docs, weights = (runs.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("docs", "weights"))
        own = np.repeat(np.arange(len(size)), size)
        if ((docs[1:] < docs[:-1]) & (own[1:] == own[:-1])).any():
            order = np.lexsort((docs, own))
            docs, weights = docs[order], weights[order]
        blocks, first = -(-size // BLOCK), np.cumsum(size) - size
        inside = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        best = np.maximum.reduceat(weights, np.repeat(first, blocks) + inside * BLOCK) if len(weights) else weights
        flats = ((size, docs, pa.int32()), (size, weights, pa.float32()), (blocks, best, pa.float32()))
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(x, t)) for n, x, t in flats]
        keys = [runs.column(c).take(pa.array(start)) for c in ("shard", "term")]
        return pa.RecordBatch.from_arrays([*keys, *lists], ["shard", "term", "docs", "weights", "block_max"])

    return dealt.mapInArrow(finish, f"shard int, term {term}, docs array<int>, weights array<float>, block_max array<float>")


class QueryTerms:
    """Query weights by query, with terms as places in a list of all terms."""

    def __init__(self, weights: pd.DataFrame):
        self.ids = np.unique(weights["query_id"].to_numpy(dtype=np.int64))
        self.terms = pd.Index(pd.unique(weights["term"]))
        query = np.searchsorted(self.ids, weights["query_id"].to_numpy(dtype=np.int64))
        order = np.argsort(query, kind="stable")
        self.term = self.terms.get_indexer(weights["term"])[order]
        self.weight = weights["weight"].to_numpy(dtype=np.float64)[order]
        self.first = np.searchsorted(query[order], np.arange(len(self.ids) + 1))


class ShardPostings:
    """The postings of a shard for the terms asked for."""

    def __init__(self, table: pa.Table, terms: pd.Index):
        table = table.combine_chunks()
        self.row = np.full(len(terms), -1)
        self.row[terms.get_indexer(table.column("term").to_pandas())] = np.arange(len(table))
        (self.docs, self.first), (self.weights, _), (self.best, self.first_block) = (self._flat(table.column(c)) for c in ("docs", "weights", "block_max"))
        self.top = np.maximum.reduceat(self.best, self.first_block[:-1]) if len(table) else np.zeros(0)
        self.size = int(self.docs.max()) + 1 if len(self.docs) else 0
        self.positive = bool((self.weights > 0).all())
        self.skipped = self.read = 0  # postings passed over by their block, and looked at

    @staticmethod
    def _flat(column) -> tuple[np.ndarray, np.ndarray]:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])

    def best_of(self, rows: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(documents, scores)``: the k best (rounded score, then document)
        by the sum of ``weight`` times the postings of ``rows``.

        Terms come in the order of what they can add at most. As soon as the
        terms to come cannot lift a new document over the k-th best, only the
        documents still in reach are followed, and of a term only the blocks
        that hold one of them and could lift it."""
        most = weight * self.top[rows]
        order = np.argsort(-most, kind="stable")
        rows, weight, most = rows[order], weight[order], most[order]
        rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])
        score, touched, high, i = np.zeros(self.size), np.zeros(self.size, bool), 0.0, 0
        again = math.inf  # a floor far below what is to come need not be looked up after every term
        bounded = bool((weight > 0).all())
        floor = -math.inf
        while i < len(rows):
            if bounded and rest[i] < min(high, again):
                # among positive scores the 0 of an untouched document is below any rest
                seen = score if self.positive else score[touched]
                floor = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else -math.inf
                if rest[i] + _SLACK < floor:
                    break
                again = max(1.25 * floor, 0.8 * rest[i])
            at = slice(self.first[rows[i]], self.first[rows[i] + 1])
            docs = self.docs[at]
            score[docs] += weight[i] * self.weights[at].astype(np.float64)
            touched[docs] = True
            high = max(high, float(score[docs].max()))
            self.read += len(docs)
            i += 1
        found = np.flatnonzero(touched)
        total = score[found]
        for j in range(i, len(rows)):
            near = total + rest[j] + _SLACK >= floor
            found, total = found[near], total[near]
            lo, hi = self.first[rows[j]], self.first[rows[j] + 1]
            docs = self.docs[lo:hi]
            if hi - lo < 4 * len(found):  # so many are in reach that adding the whole term up costs less
                score[found] = total
                score[docs] += weight[j] * self.weights[lo:hi].astype(np.float64)
                total = score[found]
                self.read += hi - lo
                if len(total) >= k:
                    floor = max(floor, np.partition(total, len(total) - k)[len(total) - k])
                continue
            place = np.searchsorted(docs, found)
            inside = np.flatnonzero(place < len(docs))
            block = self.best[self.first_block[rows[j]] + place[inside] // BLOCK]
            lifts = total[inside] + weight[j] * block + rest[j + 1] + _SLACK >= floor
            # a document that not even its block's best can lift is left behind
            gone = inside[~lifts]
            inside = inside[lifts]
            same = inside[docs[place[inside]] == found[inside]]
            total[same] += weight[j] * self.weights[lo + place[same]].astype(np.float64)
            self.read += len(inside)
            self.skipped += hi - lo - len(inside)
            if len(gone):
                stays = np.ones(len(found), bool)
                stays[gone] = False
                found, total = found[stays], total[stays]
            if len(total) >= k:
                floor = max(floor, np.partition(total, len(total) - k)[len(total) - k])
        order = np.lexsort((found, -np.round(total, 9)))[:k]
        return found[order], total[order]


def index_topk(query_weights: pd.DataFrame, index: DataFrame, k: int = TOP_K, held: list | None = None) -> DataFrame:
    """``(query_id, rank, at, score)``: inner-product top k over a shard index;
    documents that share no term with a query never appear.

    The terms filter the scan (a few are pushed to the files, which are sorted
    by term); a shard's rows are scored in the task that reads them. ``query_weights``
    was proven small by the caller, who may destroy what is put into ``held``
    once the hits are computed."""
    spark = index.sparkSession
    asked = QueryTerms(query_weights)
    terms = asked.terms.tolist()
    if len(terms) <= MAX_FILTER_TERMS:
        rows = index.where(F.col("term").isin(terms)) if terms else index.where("false")
    else:
        wanted = spark.createDataFrame(pd.DataFrame({"term": terms}), T.StructType([T.StructField("term", index.schema["term"].dataType)]))
        rows = index.join(F.broadcast(wanted), "term", "left_semi")
    shared = spark.sparkContext.broadcast(asked)
    if held is not None:
        held.append(shared)

    def score(table: pa.Table) -> pa.Table:
        q = shared.value
        shard = table.column("shard")[0].as_py()
        postings = ShardPostings(table, q.terms)
        row = postings.row[q.term]
        out: list[tuple] = []
        for i, query in enumerate(q.ids.tolist()):
            part = slice(q.first[i], q.first[i + 1])
            known = row[part] >= 0
            if known.any():
                docs, scores = postings.best_of(row[part][known], q.weight[part][known], k)
                out.append((np.full(len(docs), query), docs.astype(np.int64) + (shard << 32), scores))
        ids, at, scores = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(ids, pa.int64()), "at": pa.array(at, pa.int64()), "score": pa.array(scores, pa.float64())})

    local = rows.select("shard", "term", "docs", "weights", "block_max").groupBy("shard").applyInArrow(score, "query_id long, at long, score double")
    return top_k(local, k, key="at", tasks=scan_tasks(index))


def packed_vectors(rows: DataFrame, vector: str, at: str = "at") -> DataFrame:
    """``rows(at, <vector>)`` -> ``(n, dim, ats, norms, data)``: runs of at most
    ``VECTOR_ROWS`` vectors of one length as raw int64, float64 and float32."""

    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            first = np.concatenate([[0], np.cumsum(length)])
            cuts = np.concatenate([[0], np.flatnonzero(length[1:] != length[:-1]) + 1, [len(length)]])
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi or not length[lo]:
                    continue  # a row without a vector is found by no dense search
                m = flat[first[lo] : first[hi]].reshape(hi - lo, -1)
                for i in range(0, len(m), VECTOR_ROWS):
                    part = np.ascontiguousarray(m[i : i + VECTOR_ROWS])
                    norms = np.linalg.norm(part.astype(np.float64), axis=1)
                    yield pa.RecordBatch.from_pylist(
                        [{"n": len(part), "dim": part.shape[1], "ats": ids[lo + i : lo + i + len(part)].tobytes(), "norms": norms.tobytes(), "data": part.tobytes()}],
                        schema=pa.schema([("n", pa.int32()), ("dim", pa.int32()), ("ats", pa.binary()), ("norms", pa.binary()), ("data", pa.binary())]),
                    )

    return rows.select(at, vector).mapInArrow(pack, "n int, dim int, ats binary, norms binary, data binary")


def packed_topk(queries: pd.DataFrame, packed: DataFrame, k: int = TOP_K, held: list | None = None) -> DataFrame:
    """``(query_id, rank, at, score)``: exact cosine top k of ``queries``
    (``query_id, qv``, proven small by the caller) over packed vectors, scanned
    in place. ``held``: see ``index_topk``."""
    ids = queries["query_id"].to_numpy(dtype=np.int64)
    shared = packed.sparkSession.sparkContext.broadcast((ids, _unit_rows(list(queries["qv"]))))
    if held is not None:
        held.append(shared)

    def score(batches):
        query_ids, m = shared.value
        if not len(query_ids):
            return
        best, step = RunningTopK(query_ids, k), _rows_per_block(len(query_ids))
        for batch in batches:
            for dim, ats, norms, data in zip(*(batch.column(c) for c in ("dim", "ats", "norms", "data"))):
                place = np.frombuffer(ats.as_buffer(), np.int64)
                norm = np.frombuffer(norms.as_buffer(), np.float64)
                rows = np.frombuffer(data.as_buffer(), np.float32).reshape(-1, dim.as_py())
                scale = np.divide(1.0, norm, out=np.zeros(len(norm)), where=norm > 0)  # a zero vector has cosine 0
                for i in range(0, len(rows), step):
                    part = slice(i, i + step)
                    best.add_block((rows[part].astype(np.float64) * scale[part, None]) @ m.T, place[part])
        if (found := best.result()) is not None:
            found = found.rename(columns={"pk": "at"})
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    local = packed.mapInArrow(score, "query_id long, at long, score double")
    return top_k(local, k, key="at", tasks=scan_tasks(packed))
