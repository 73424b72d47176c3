"""Exact top-k search: sparse inner product over postings, dense cosine.

Ordering everywhere: score descending, rounded to 9 places so that float
summation order cannot reorder near-equal scores, then ``pk`` ascending.
Fewer than k matches give fewer rows. Ranks start at 1 and have no gaps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import MAX_BROADCAST_QUERIES, MAX_BROADCAST_ROWS, TOP_K
from quarry.operators.sizing import collect_if_small, in_blocks, in_place, query_blocks, scan_tasks


#: A query's candidates from more tasks than this are merged in two levels.
MERGE_TASKS = 512


def top_k(scored: DataFrame, k: int, group: str = "query_id", key: str = "pk", tasks: int = 0) -> DataFrame:
    """Keep the best ``k`` rows per ``group`` and number them ``rank`` 1..k.

    ``row_number() <= k`` becomes a partial ``WindowGroupLimit`` before the
    shuffle on ``group`` and a final one after it, so at most k rows per group
    and task cross the network however many candidates there are. Where the
    caller knows of more than ``MERGE_TASKS`` ``tasks`` behind ``scored``, their
    lists are merged per (group, salt of the task) first, so that the last
    window gets k rows a salt, not k a task: with few queries over a large
    corpus that window is one task.
    """
    order = [F.round("score", 9).desc(), F.col(key).asc()]
    if tasks > MERGE_TASKS:
        columns = scored.columns
        salts = math.ceil(math.sqrt(tasks))
        scored = scored.withColumn("_salt", F.spark_partition_id() % salts)
        first = Window.partitionBy(group, "_salt").orderBy(*order)
        scored = scored.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k).select(*columns)
    w = Window.partitionBy(group).orderBy(*order)
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def sparse_topk(
    query_weights: DataFrame,
    postings: DataFrame,
    k: int = TOP_K,
    query_side_small: bool = True,
    key: str = "pk",
) -> DataFrame:
    """J2 + A3 + W2/W3: inner product of sparse vectors, top k per query.

    ``query_weights(query_id, term, weight)`` against ``postings(pk, term,
    weight)``. When the query side is proven small it is broadcast: postings
    then stream through a hash probe without any shuffle, so a term held by a
    third of all chunks does not make one hot task. The per-(query, pk) sum is
    combined map-side before its shuffle; postings that the caller dealt by
    ``key`` are summed and cut to k where they are, so no pair is shuffled.
    """
    q = query_weights.select(
        "query_id", "term", F.col("weight").alias("qw")
    )
    if query_side_small:
        q = F.broadcast(q)
    scored = (
        postings.select(key, "term", F.col("weight").alias("dw"))
        .join(q, "term")
        .groupBy("query_id", key)
        .agg(F.sum(F.col("qw") * F.col("dw")).alias("score"))
    )
    return top_k(scored, k, key=key)


#: (query, document) sums that a task holds at once.
TASK_PAIRS = 1_000_000


def cell_tasks(documents: DataFrame, n_queries: int, most: int = TASK_PAIRS) -> int:
    """Tasks to deal documents to so that each sums about ``most`` pairs."""
    return max(documents.sparkSession.sparkContext.defaultParallelism, math.ceil(documents.count() * n_queries / most))


def with_text(
    hits: DataFrame, chunks: DataFrame, key: str = "pk", hits_small: bool = True
) -> DataFrame:
    """Fetch the text of the hits only (late materialisation).

    Hits are at most k per query. When the query set passed its size check
    (``hits_small``) they are broadcast and the chunk table streams past them
    with a column-pruned scan; it is never shuffled to fetch a few texts.
    """
    h = F.broadcast(hits) if hits_small else hits
    return h.join(chunks.select(key, "text"), key)


def few_hits(queries: pd.DataFrame, k: int, most: int = MAX_BROADCAST_ROWS // 10) -> bool:
    """Are the k best of each of these queries few enough to broadcast?"""
    return queries["query_id"].nunique() * k <= most


# ---------------------------------------------------------------- dense search


def _unit_rows(vectors: list, dim: int | None = None) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    if len({np.shape(v) for v in vectors}) > 1 or np.ndim(vectors[0]) != 1:
        raise ValueError("vectors must have one length")
    m = np.concatenate(vectors).astype(np.float64).reshape(len(vectors), -1)
    norms = np.linalg.norm(m, axis=1)
    norms[norms == 0] = np.inf  # cosine with a zero vector is 0
    return m / norms[:, None]


#: Rows scored before the first floor is taken. A term goes into the matrix
#: product when this share of all (row, query) cells gets a product of it.
FIRST_ROWS, DENSE_SHARE = 128, 0.003
#: From so many (document, query) pairs on, every ``SAMPLE``-th document sets a
#: floor that all tasks begin with.
FLOOR_PAIRS, SAMPLE = 1_000_000_000, 16


class TermQueries:
    """Query weights by term: those of term ``t`` are ``first[t]`` up to
    ``first[t + 1]``; queries are places in ``ids``."""

    def __init__(self, weights: pd.DataFrame):
        query = weights["query_id"].to_numpy(dtype=np.int64)
        self.ids = np.unique(query)
        self.terms = pd.Index(pd.unique(weights["term"]))
        term = self.terms.get_indexer(weights["term"])
        order = np.argsort(term, kind="stable")
        self.term, self.query = term[order], np.searchsorted(self.ids, query)[order]
        self.weight = weights["weight"].to_numpy(dtype=np.float64)[order]
        self.first = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        self.positive = bool((self.weight > 0).all())
        self.by_query = np.argsort(self.query, kind="stable")
        self.first_of = np.searchsorted(self.query[self.by_query], np.arange(len(self.ids) + 1))

    def exact(self, doc, query, row, col, dw, n) -> np.ndarray:
        """The scores of the pairs ``(doc, query)`` among ``n`` rows with the
        postings ``(row, col, dw)``."""
        used, own = np.unique(col, return_inverse=True)
        place = np.full(len(self.terms), len(used))  # of a term that no row holds
        place[used] = np.arange(len(used))
        out, size = np.empty(len(doc)), self.first_of[query + 1] - self.first_of[query]
        rows = max(1, MAX_CELLS // (len(used) + 1))
        for lo in range(0, n, rows):
            a, b = np.searchsorted(row, (lo, lo + rows))
            table = np.zeros((min(rows, n - lo), len(used) + 1))
            np.add.at(table, (row[a:b] - lo, own[a:b]), dw[a:b])
            i, j = np.searchsorted(doc, (lo, lo + rows))
            while i < j:
                c = min(j, i + max(1, int(np.searchsorted(np.cumsum(size[i:j]), MAX_CELLS))))
                f = size[i:c]
                entry = self.by_query[np.arange(f.sum()) + np.repeat(self.first_of[query[i:c]] - (np.cumsum(f) - f), f)]
                product = table[np.repeat(doc[i:c] - lo, f), place[self.term[entry]]] * self.weight[entry]
                out[i:c] = np.bincount(np.repeat(np.arange(c - i), f), weights=product, minlength=c - i)
                i = c
        return out


class RunningTopK:
    """Best k (rounded score desc, id asc) of every query over all the blocks
    a task has seen, so that a task yields k rows per query once, at its end.

    Candidates wait until there are about as many as kept rows and are then
    merged in one sort; ``floor`` (each query's k-th best so far) turns most
    later ones away before that."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.floor = np.full(len(query_ids), -np.inf)
        self.limit = max(100_000, 2 * k * len(query_ids))
        self.waiting: list[tuple] = []
        self.n_waiting = self.seen = 0

    def settled(self) -> np.ndarray:
        """The floor, with all that waits merged into it."""
        if self.n_waiting:
            self._merge()
        return self.floor

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Candidates as (query index, document id, score)."""
        ok = np.round(score, 9) >= self.floor[query]
        if ok.any():
            self.waiting.append((query[ok], doc[ok], score[ok]))
            self.n_waiting += int(ok.sum())
        if self.n_waiting > self.limit:
            self._merge()

    def add_block(self, scores: np.ndarray, doc: np.ndarray) -> None:
        """A block of documents x queries; -inf where there is no match. Only
        where many cells pass the floor is the block's own k-th best looked up."""
        floor, n = self.floor, len(doc)
        near = scores >= np.maximum(floor - 1e-9, np.finfo(float).min)  # ``add`` compares rounded scores
        if n > self.k and np.count_nonzero(near) > 2 * self.k * len(floor):
            rounded = np.round(scores, 9)
            near &= rounded >= np.partition(rounded, n - self.k, axis=0)[n - self.k]
        row, query = np.nonzero(near)
        self.add(query, doc[row], scores[row, query])

    def _merge(self) -> None:
        query, doc, score = zip(*self.waiting)
        query, doc, score = (np.concatenate(x) for x in (query, _same_kind(doc), score))
        rounded = np.round(score, 9)
        order = _best_first(query, rounded, doc)
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        last = order[place == self.k - 1]
        self.floor[query[last]] = np.maximum(rounded[last], self.floor[query[last]])  # it may have been given
        self.waiting = [(query[order], doc[order], score[order])]
        self.n_waiting = 0  # new ones only: kept rows are at most k per query

    def result(self) -> pd.DataFrame | None:
        if not self.waiting:
            return None
        self._merge()
        query, doc, score = self.waiting[0]
        doc = np.char.decode(doc, "ascii") if doc.dtype.kind == "S" else doc
        return pd.DataFrame({"query_id": self.query_ids[query], "pk": doc, "score": score})


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    key: str = "pk",
    vector: str = "vector",
    query_vector: str = "vector",
    strategy: str = "auto",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    block_rows: int = MAX_BROADCAST_QUERIES,
    with_plan: bool = False,
):
    """J1 + W1: exact cosine top-k of every query over the whole corpus.

    Returns the hits, or ``(hits, broadcast_used)`` with ``with_plan``; the
    flag tells the caller its hits are bounded by a checked query count.

    ``queries(query_id, <query_vector>)``, ``corpus(<key>, <vector>)``. No
    cross join is planned and no (query, document) pair is materialised:

    * ``broadcast`` – the query matrix (row count checked against
      ``max_broadcast_queries``) is shipped once to every task; each task
      multiplies its Arrow batches of corpus vectors with it (BLAS) and keeps
      only its local top k per query. The corpus is scanned in place, never
      shuffled.
    * ``blocked`` – for query sets beyond that bound: blocks of ``block_rows``
      queries go through the ``broadcast`` plan one after another (small blocks
      as tasks of one job), each block's hits written and its broadcast
      destroyed before the next one. The corpus is written first, as unit
      vectors packed in runs (``unit_runs``), so that what a scan repeats for
      every block is the product alone.

    A final ``row_number`` per query merges the local lists.
    """
    out_schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("pk", corpus.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    q = queries.select(
        F.col("query_id").cast("long").alias("query_id"), F.col(query_vector).alias("qv")
    )
    c = corpus.select(F.col(key).alias("pk"), F.col(vector).alias("dv"))
    qp = None
    if strategy in ("auto", "broadcast"):
        qp = collect_if_small(q, max_broadcast_queries)
        if qp is None and strategy == "broadcast":
            raise ValueError("query set too large to broadcast; use strategy='blocked'")
        strategy = "broadcast" if qp is not None else "blocked"
    if strategy == "broadcast":
        hits = top_k(_broadcast_block_product(qp, c, k, out_schema), k, tasks=scan_tasks(corpus))
    elif strategy == "blocked":
        c = in_place(unit_runs(c))
        tasks = scan_tasks(c)
        hits = in_blocks(
            q.sparkSession,
            query_blocks(q, block_rows),
            lambda part, held: top_k(_broadcast_block_product(part, c, k, out_schema, held), k, tasks=tasks),
        )
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    hits = hits.withColumnRenamed("pk", key) if key != "pk" else hits
    return (hits, strategy == "broadcast" and few_hits(qp, k)) if with_plan else hits


#: Scores, or (posting, query) products, that a task holds at once.
MAX_CELLS = 4_000_000


def _rows_per_block(n_queries: int, max_cells: int = MAX_CELLS) -> int:
    """Rows scored at once so a score block holds at most ``max_cells``."""
    return max(1, max_cells // max(1, n_queries))


def _ids(values: pd.Series) -> np.ndarray:
    """Keys as an array that sorts as they do; one byte a character where all
    are ASCII (digests)."""
    arr = values.to_numpy()
    if arr.dtype != object:
        return arr
    try:
        return arr.astype("S")
    except UnicodeEncodeError:
        return arr.astype(str)


def _best_first(query: np.ndarray, rounded: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by query, score descending, document. Digests are told apart
    by their first eight bytes; whole ones are compared only if those tie."""
    lead = doc
    if doc.dtype.kind == "S" and len(doc):
        lead = doc.astype("S8").view(">u8").astype(np.uint64)
    order = np.lexsort((lead, -rounded, query))
    if lead is not doc:
        a, b = order[1:], order[:-1]
        if ((lead[a] == lead[b]) & (rounded[a] == rounded[b]) & (query[a] == query[b])).any():
            order = np.lexsort((doc, -rounded, query))
    return order


def _same_kind(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Batches of ASCII and of other keys side by side."""
    if len({p.dtype.kind for p in parts}) < 2:
        return parts
    return [np.char.decode(p, "ascii") if p.dtype.kind == "S" else p for p in parts]


#: Vectors in one packed run.
RUN_ROWS = 1024


def unit_runs(c: DataFrame) -> DataFrame:
    """``(pk, dv)`` -> ``(pk array, units)``: runs of at most ``RUN_ROWS`` unit
    vectors as raw float64, with their keys."""

    def pack(batches):
        for batch in batches:
            keys, vectors = batch.column("pk"), batch.column("dv")
            for lo in range(0, len(keys), RUN_ROWS):
                part = vectors.slice(lo, RUN_ROWS)
                size = part.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                if (size != size[0]).any() or size[0] < 0:
                    raise ValueError("vectors must have one length")
                flat = part.flatten().to_numpy(zero_copy_only=False)
                units = _unit_rows(list(flat.reshape(len(part), -1))) if size[0] else np.zeros((len(part), 0))
                ends = pa.array([0, len(part)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, keys.slice(lo, RUN_ROWS)), pa.array([units.tobytes()])], ["pk", "units"])

    return c.mapInArrow(pack, f"pk array<{c.schema['pk'].dataType.simpleString()}>, units binary")


def _broadcast_block_product(qp: pd.DataFrame, c: DataFrame, k: int, out_schema, held: list | None = None) -> DataFrame:
    # ``qp`` holds at most ``max_broadcast_queries`` rows (checked by the caller)
    qids = qp["query_id"].to_numpy(dtype=np.int64)
    qmat = _unit_rows(list(qp["qv"]))
    shared = c.sparkSession.sparkContext.broadcast((qids, qmat))
    if held is not None:
        held.append(shared)
    in_runs = "units" in c.columns

    def score_batches(batches):
        ids, m = shared.value
        if len(ids) == 0:
            return
        best, step = RunningTopK(ids, k), _rows_per_block(len(ids))
        for pdf in batches:
            if in_runs:
                for pk, units in zip(pdf["pk"], pdf["units"]):
                    rows, docs = np.frombuffer(units).reshape(len(pk), -1), _ids(pd.Series(pk))
                    for i in range(0, len(docs), step):
                        best.add_block(rows[i : i + step] @ m.T, docs[i : i + step])
                continue
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                best.add_block(_unit_rows(list(part["dv"])) @ m.T, _ids(part["pk"]))
        if (rows := best.result()) is not None:
            yield rows

    return c.mapInPandas(score_batches, out_schema)


# ---------------------------------------------- sparse search, in-task scoring


def bm25_scan_topk(
    query_weights,
    chunks: DataFrame,
    stats,
    k: int = TOP_K,
    k1: float = 1.5,
    b: float = 0.75,
    doc_weight: str = "bm25",
    term_key=None,
    stored: str = "full_text_vector",
    held: list | None = None,
) -> DataFrame:
    """Full-text top k without a (query, chunk) shuffle.

    ``query_weights(query_id, term, weight)`` (a DataFrame proven small by
    the caller, or its rows already fetched as pandas) is broadcast with
    ``avgdl`` (``stats`` table or a number); every task scores its own
    chunks (``pk``, ``dl``, ``terms``) against all queries with numpy and keeps
    only its local top k per query, so the corpus is never shuffled and only
    k rows per query and task reach the final ``row_number``. Same scores and
    order as ``sparse_topk`` over ``bm25.doc_weights`` (documents sharing no
    term with a query never appear).

    Where there are many pairs, a part of the documents is searched first:
    what is below a query's k-th best there is below its k-th best of all, and
    is neither scored exactly nor handed on.
    """
    qp = query_weights if isinstance(query_weights, pd.DataFrame) else query_weights.toPandas()
    if stats is None:
        avgdl = 1.0
    elif isinstance(stats, (int, float)):
        avgdl = float(stats)
    else:
        avgdl = float(stats.select("avgdl").first()[0] or 0.0)
    asked = TermQueries(qp)
    context = chunks.sparkSession.sparkContext
    out_schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("pk", chunks.schema["pk"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score_batch(pdf, best, q, avg):
        n, nq = len(pdf), len(q.ids)
        lens = pdf["_t"].map(len).to_numpy()
        if lens.sum() == 0:
            return
        flat_terms = pd.Index(np.concatenate(pdf["_t"].to_numpy()))
        tf = np.concatenate(pdf["_tf"].to_numpy()).astype(np.float64)
        row = np.repeat(np.arange(n), lens)
        col = q.terms.get_indexer(flat_terms)
        hit = col >= 0
        row, col, tf = row[hit], col[hit], tf[hit]
        if len(row) == 0:
            return
        if doc_weight == "bm25":
            dl = pdf["dl"].to_numpy(dtype=np.float64)[row]
            dw = tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * dl / avg))
        elif doc_weight == "log_tf":  # learned-sparse stand-in, 1 + ln(tf)
            dw = 1.0 + np.log(tf)
        else:  # "stored": the value already is the document weight
            dw = tf
        docs = _ids(pdf["pk"])
        positive = q.positive and bool((dw > 0).all())
        lo = 0
        while lo < n:
            # runs of rows grow, so that the first few set a floor for the others
            hi = min(n, lo + max(FIRST_ROWS, best.seen))
            part = slice(*np.searchsorted(row, (lo, hi)))
            score_rows(row[part] - lo, col[part], dw[part], docs[lo:hi], best, q, positive)
            best.seen += hi - lo
            lo = hi

    def score_rows(row, col, dw, docs, best, q, positive):
        """Sums of a run of rows, in blocks of whole rows with a bounded number
        of (posting, query) products and of (row, query) cells. Once there is a
        floor they are made in single precision, the frequent terms' by a
        matrix product, and only those in reach of it exactly."""
        n, nq = len(docs), len(q.ids)
        fan, floor = q.first[col + 1] - q.first[col], best.settled()
        near = positive and bool((floor > 0).any())
        if near:
            # sums of single precision are some millionths off at most; no match is 0
            reach = np.maximum(floor * (1 - 1e-4) - 1e-6, np.finfo(np.float32).tiny).astype(np.float32)
            products = np.bincount(col, minlength=len(q.terms)) * np.diff(q.first)
            dense = np.flatnonzero(products >= DENSE_SHARE * n * nq)
            place = np.full(len(q.terms), -1)
            place[dense] = np.arange(len(dense))
            fan[place[col] >= 0] = 0
            asked, entry = np.zeros((len(dense), nq), np.float32), np.flatnonzero(place[q.term] >= 0)
            np.add.at(asked, (place[q.term[entry]], q.query[entry]), q.weight[entry])
        work, most = np.cumsum(np.bincount(row, weights=fan, minlength=n)), _rows_per_block(nq)
        lo = 0
        while lo < n:
            done = work[lo - 1] if lo else 0
            hi = min(lo + most, max(lo + 1, int(np.searchsorted(work, done + MAX_CELLS, side="right"))))
            part = slice(*np.searchsorted(row, (lo, hi)))
            r, c, w, f = row[part] - lo, col[part], dw[part], fan[part]
            pos = np.arange(f.sum()) + np.repeat(q.first[c] - (np.cumsum(f) - f), f)
            cell, product = np.repeat(r * nq, f) + q.query[pos], np.repeat(w, f) * q.weight[pos]
            if near:
                held = place[c] >= 0
                table = np.zeros((hi - lo, len(dense)), np.float32)
                np.add.at(table, (r[held], place[c[held]]), w[held])
                total = table @ asked
                np.add.at(total.reshape(-1), cell, product.astype(np.float32))
                doc, query = np.divmod(np.flatnonzero(total >= reach), nq)
                best.add(query, docs[lo + doc], q.exact(doc, query, r, c, w, hi - lo))
            else:
                total = np.bincount(cell, weights=product, minlength=(hi - lo) * nq)
                match = total > 0 if positive else np.bincount(cell, minlength=(hi - lo) * nq) > 0
                best.add_block(np.where(match, total, -np.inf).reshape(-1, nq), docs[lo:hi])
            lo = hi

    def score(batches, shared):
        q, avg, least = shared.value
        if len(q.ids) == 0:
            return
        best = RunningTopK(q.ids, k)
        if least is not None:
            best.floor = least.copy()
        for pdf in batches:
            score_batch(pdf, best, q, avg)
        if (rows := best.result()) is not None:
            yield rows

    if doc_weight == "stored":
        # a written store: the column maps term (or term id) -> weight
        cols = [
            F.lit(0).alias("dl"),
            F.map_keys(stored).alias("_t"),
            F.map_values(stored).cast("array<double>").alias("_tf"),
        ]
    else:
        keys = (
            F.col("terms.term") if term_key is None else F.transform("terms", lambda t: term_key(t["term"]))
        )
        cols = ["dl", keys.alias("_t"), F.col("terms.tf").alias("_tf")]

    def best_of(rows: DataFrame, least: np.ndarray | None, held: list | None) -> DataFrame:
        shared = context.broadcast((asked, avgdl, least))
        if held is not None:
            held.append(shared)
        return rows.select("pk", *cols).mapInPandas(lambda batches: score(batches, shared), out_schema)

    least = None
    if asked.positive and len(asked.ids) * chunks.count() >= FLOOR_PAIRS:
        sample = chunks.where(F.pmod(F.xxhash64("pk"), F.lit(SAMPLE)) == 0).coalesce(context.defaultParallelism)
        done: list = []
        found = top_k(best_of(sample, None, done), k).groupBy("query_id")
        lowest = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.round("score", 9)).alias("s")).where(F.col("n") == k).toPandas()
        done[0].destroy()
        least = np.full(len(asked.ids), -np.inf)
        least[np.searchsorted(asked.ids, lowest["query_id"])] = lowest["s"]
    return top_k(best_of(chunks, least, held), k, tasks=scan_tasks(chunks))
