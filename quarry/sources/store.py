"""The knowledge store as plain tables.

``<root>/log``           one row per committed version, written last
``<root>/<version>/``
  ``knowledge``   pk, text, dense_vector, source[, sparse_vector]
                  [, full_text_vector], shard, doc, first (the doc of the
                  first row with the same key)[, dl, tf]
  ``vectors``     packed blocks of dense vectors with their norms
  ``postings``    term, at, weight; partitioned by ``term_bucket`` and sorted
                  by term inside each file: a search for few matches opens the
                  buckets of its terms only. ``at`` numbers the key (8 bytes,
                  close to its neighbours) where the key itself takes 64
  ``index``, ``sparse_index``
                  postings by document shard with block maxima, bucketed by
                  shard and sorted by term (see ``operators.shards``)
  ``bm25_terms``  term, df, idf      ``bm25_stats``  n, avgdl

A write makes a new version beside the old one and commits it with one
appended log row; a reader pins the newest committed version, so it sees the
old store whole until the new one is whole, and never a mix. The reference
drops and recreates its collection. Older versions stay until the folder's
owner expires them. Nothing passes through the driver.
"""

from __future__ import annotations

import os
import time
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import MAX_BROADCAST_ROWS, MAX_TEXT_BYTES
from quarry.operators import bm25, search, shards
from quarry.operators.sizing import collect_if_small, in_blocks, query_blocks
from quarry.session import buckets_side_by_side, packed, shuffles_freed, write_table

TERM_BUCKETS = 64
#: Rows of a document shard, about; a small corpus is cut finer, down to
#: ``LEAST_ROWS``, so that every core has one.
SHARD_ROWS, LEAST_ROWS = 262_144, 4096
#: Up to so many matching (query, chunk) postings a search goes through the
#: term buckets and a join; more are scored inside the shards.
JOIN_PAIRS = 1_000_000

_LOG = "seq long, version string, shards int"


def knowledge_schema(
    dense_dim: int, add_sparse_index: bool = False, add_full_text_index: bool = False
) -> T.StructType:
    """S3: explicit schema of the knowledge table. ``dense_dim`` is checked on
    write (array columns carry no length in Spark)."""
    fields = [
        T.StructField("pk", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("dense_vector", T.ArrayType(T.FloatType())),
        T.StructField("source", T.StringType()),
    ]
    if add_sparse_index:
        fields.append(T.StructField("sparse_vector", T.MapType(T.IntegerType(), T.FloatType())))
    if add_full_text_index:
        fields.append(T.StructField("full_text_vector", T.MapType(T.StringType(), T.FloatType())))
    return T.StructType(fields)


def term_bucket(term: Column, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Store:
    """The tables of a store; the last six but ``shards`` are set on what was
    read back. ``postings`` is ``(term, pk, weight)``, ``entries`` the same as
    stored, with ``at`` for the key. ``shards``: so many shards that the rows of
    ``knowledge`` already are dealt to (``shard``, ``doc``, ``first``)."""

    knowledge: DataFrame
    postings: DataFrame
    bm25_terms: DataFrame
    bm25_stats: DataFrame
    vectors: DataFrame | None = None
    index: DataFrame | None = None
    sparse_index: DataFrame | None = None
    version: str | None = None
    entries: DataFrame | None = None
    shards: int | None = None


def validate(knowledge: DataFrame, dense_dim: int) -> DataFrame:
    """Fail the write (not silently drop rows) when a row breaks the store's
    limits: vector length != dense_dim, text/source over 65535 bytes, or a
    ``pk`` that is no lowercase hex digest (see ``chunks.chunk_key``)."""
    bad = (
        (F.size("dense_vector") != dense_dim)
        | (F.octet_length("text") > MAX_TEXT_BYTES)
        | (F.octet_length("source") > MAX_TEXT_BYTES)
        | ~F.col("pk").rlike("^[0-9a-f]{8,}$")
    )
    return knowledge.withColumn(
        "pk",
        F.when(bad, F.raise_error(F.concat(F.lit("knowledge row breaks store limits: "), F.col("pk")))).otherwise(
            F.col("pk")
        ),
    )


def shard_count(spark: SparkSession, n: int, shard_rows: int = SHARD_ROWS) -> int:
    """Document shards for ``n`` rows."""
    return max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))


def _hash(value: int) -> int:
    """Spark's hash of an INT."""
    turn = lambda x, n: (x << n | x >> 32 - n) & 0xFFFFFFFF
    h = turn(42 ^ (turn(value * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h = (h ^ 4 ^ (h ^ 4) >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


@lru_cache
def shard_tasks(count: int) -> int:
    """Partitions, or buckets, over which ``count`` shards are best hashed
    apart: up to four for each, where with ``count`` a third would be empty and
    others hold several shards."""
    codes = [_hash(i) for i in range(count)]
    load = lambda n: Counter(c % n for c in codes)
    return min(range(count, 4 * count + 1, max(1, count // 64)), key=lambda n: (max(load(n).values()), -len(load(n)), n))


def sharded(knowledge: DataFrame, count: int) -> DataFrame:
    """Adds ``shard`` (equal ranges of the digests, so shards are in key order
    and evenly filled), ``doc``, the place in the shard by key, and ``first``,
    the place of the first row with the same key."""
    lead = F.conv(F.substring("pk", 1, 8), 16, 10).cast("bigint")
    placed = knowledge.withColumn("shard", F.shiftright(lead * F.lit(count), 32).cast("int"))
    if count > 1:
        placed = placed.repartition(shard_tasks(count), "shard")
    by_key = Window.partitionBy("shard").orderBy("pk")
    return placed.withColumns({"doc": F.row_number().over(by_key) - 1, "first": F.rank().over(by_key) - 1})


def entries(store: Store, knowledge: DataFrame, stats: DataFrame, buckets: int = TERM_BUCKETS) -> DataFrame:
    """``(term, at, weight, term_bucket)`` of the written knowledge rows, dealt
    and sorted by bucket and term. Rows that carry their counts (``dl``, ``tf`` in the order of the
    map's terms) move as runs of counts and are weighted where they arrive;
    otherwise the store's postings are joined on the key.

    ``rebalance`` (not ``repartition``): AQE splits the partition of a bucket
    holding a very frequent term into several tasks and merges tiny ones."""
    at = shards.at_column(doc="first").alias("at")
    if not {"dl", "tf", "full_text_vector"} <= set(knowledge.columns):
        found = store.postings.join(knowledge.where("doc = first").select("pk", at), "pk").select("term", "at", "weight")
        found = found.withColumn("term_bucket", term_bucket(F.col("term"), buckets)).hint("rebalance", "term_bucket")
        return found.sortWithinPartitions("term_bucket", "term", "at")
    terms = F.map_keys("full_text_vector")
    # texts end at MAX_TEXT_BYTES, so their tokens less one fit into two bytes
    dl = F.array_repeat((F.col("dl") - 1).cast("smallint"), F.size(terms)).alias("dl")
    counted = knowledge.select("shard", F.col("first").alias("doc"), terms.alias("term"), "tf", dl)
    runs = shards.posting_runs(counted, ["tf", "dl"], "string").withColumn("term_bucket", term_bucket(F.col("term"), buckets))
    # rows leave a run in its order, so sorting runs sorts the postings
    dealt = runs.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term", "shard", F.get("docs", F.lit(0)))
    flat = dealt.select("shard", "term", "term_bucket", F.inline(F.arrays_zip("docs", "tf", "dl")))
    weight = bm25.doc_weight(F.col("tf"), F.col("dl").cast("int") + 1, stats.select("avgdl").scalar())
    return flat.select("term", shards.at_column(doc="docs").alias("at"), weight.alias("weight"), "term_bucket")


def _index_table(spark: SparkSession, version: str, name: str, path: str, term: str, buckets: int) -> DataFrame:
    """The bucketed files under ``path`` as a table of this session, so that
    Spark knows that a shard lies in one bucket."""
    table = f"quarry_{version}_{name}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (shard INT, term {term}, docs ARRAY<INT>, weights ARRAY<FLOAT>, block_max ARRAY<FLOAT>) "
        f"USING parquet CLUSTERED BY (shard) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def committed(spark: SparkSession, root: str, version: str | None = None) -> Row | None:
    """Log row (``seq, version, shards``) of the newest committed version, or
    of the one named."""
    try:
        rows = spark.read.schema(_LOG).parquet(f"{root.rstrip('/')}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if version is not None:
        rows = rows.where(F.col("version") == version)
    return rows.orderBy(F.desc("seq"), F.desc("version")).first()


def write_store(store: Store, root: str, dense_dim: int, buckets: int = TERM_BUCKETS, shard_rows: int = SHARD_ROWS) -> str:
    """Replace the store under ``root``; returns the version.
    One job per table, and the log row that makes them the store."""
    root, spark = root.rstrip("/"), store.knowledge.sparkSession
    before = committed(spark, root)
    version = f"v{int(time.time() * 1000)}_{os.urandom(4).hex()}"
    folder = f"{root}/{version}"
    write_table(store.bm25_stats, f"{folder}/bm25_stats")
    write_table(store.bm25_terms, f"{folder}/bm25_terms")
    count, checked = store.shards, validate(store.knowledge, dense_dim)
    if count is None:
        count = shard_count(spark, spark.read.parquet(f"{folder}/bm25_stats").first().n, shard_rows)
        checked = sharded(checked, count)
    write_table(checked, f"{folder}/knowledge")
    knowledge = spark.read.parquet(f"{folder}/knowledge")
    # what is shuffled most goes first, while the fewest tables lie beside it
    found = entries(store, knowledge, spark.read.parquet(f"{folder}/bm25_stats"), buckets)
    with shuffles_freed(spark), buckets_side_by_side(spark, buckets):
        packed(found).partitionBy("term_bucket").parquet(f"{folder}/postings")
    for vector, name in (("full_text_vector", "index"), ("sparse_vector", "sparse_index")):
        if vector in knowledge.columns:
            rows = shards.posting_rows(knowledge, vector, shard_tasks(count))  # dealt by the bucket's own hash: a bucket is one file
            with shuffles_freed(spark):
                packed(rows).bucketBy(shard_tasks(count), "shard").sortBy("term").option("path", f"{folder}/{name}").saveAsTable(f"quarry_{version}_{name}")
    write_table(shards.packed_vectors(knowledge.withColumn("at", shards.at_column()), "dense_vector"), f"{folder}/vectors")
    commit = spark.createDataFrame([(before.seq + 1 if before else 1, version, count)], _LOG)
    commit.coalesce(1).write.mode("append").parquet(f"{root}/log")
    return version


def read_store(spark: SparkSession, root: str, version: str | None = None) -> Store:
    """The newest committed version (or the given one) as lazy DataFrames.
    The version stays pinned: a later write changes nothing for this store."""
    root = root.rstrip("/")
    found = committed(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"no committed store {version or ''} under {root}")
    folder = f"{root}/{found.version}"
    out = Store(*(spark.read.parquet(f"{folder}/{t}") for t in ("knowledge", "postings", "bm25_terms", "bm25_stats")))
    out.vectors, out.version = spark.read.parquet(f"{folder}/vectors"), found.version
    keys = out.knowledge.where("doc = first").select("pk", shards.at_column(doc="first").alias("at"))
    out.entries, out.postings = out.postings, out.postings.join(keys, "at").drop("at")
    for vector, name, term in (("full_text_vector", "index", "STRING"), ("sparse_vector", "sparse_index", "INT")):
        if vector in out.knowledge.columns:
            setattr(out, name, _index_table(spark, found.version, name, f"{folder}/{name}", term, shard_tasks(found.shards)))
    return out


def _named(hits: DataFrame, knowledge: DataFrame, small: bool, doc: str = "doc") -> DataFrame:
    """Keys and texts of hits on ``at``, fetched by a column-pruned scan."""
    rows = knowledge.select("pk", "text", shards.at_column(doc=doc).alias("at"))
    return (F.broadcast(hits) if small else hits).join(rows, "at").drop("at")


def dense_store(store: Store, queries: DataFrame, k: int, max_queries: int) -> DataFrame:
    """R2 over the packed vectors: ``queries(query_id, vector)``, one block of
    queries after another where they are too many to broadcast at once."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("qv"))
    small = collect_if_small(q, max_queries)
    if small is not None:
        return _named(shards.packed_topk(small, store.vectors, k), store.knowledge, search.few_hits(small, k))
    hits = in_blocks(queries.sparkSession, query_blocks(q, max_queries), lambda part, held: shards.packed_topk(part, store.vectors, k, held))
    return _named(hits, store.knowledge, False)


def sparse_store(store: Store, weights: DataFrame, k: int, max_rows: int = MAX_BROADCAST_ROWS, index: str = "sparse_index") -> DataFrame:
    """R3/R4 over an index by document shard: ``weights(query_id, term,
    weight)``, block by block where they are too many."""
    table = getattr(store, index)
    small = collect_if_small(weights, max_rows)
    if small is not None:
        return _named(shards.index_topk(small, table, k), store.knowledge, search.few_hits(small, k))
    hits = in_blocks(weights.sparkSession, query_blocks(weights, max_rows), lambda part, held: shards.index_topk(part, table, k, held))
    return _named(hits, store.knowledge, False)


def _join_postings(store: Store, qp, schema: T.StructType, k: int, deal: bool = False) -> DataFrame:
    """Only the buckets of the query terms are read; matches are joined. Many
    are dealt by document first, and summed where they then are."""
    spark = store.knowledge.sparkSession
    # one precision for all stored forms: maps and index hold floats
    postings = store.entries.withColumn("weight", F.col("weight").cast("float").cast("double"))
    qdf = spark.createDataFrame(qp, schema)
    found = qdf.select(term_bucket(F.col("term")).alias("b")).distinct().collect()  # at most TERM_BUCKETS values
    post = postings.where(F.col("term_bucket").isin([r[0] for r in found]) & F.col("term").isin(sorted(set(qp["term"]))))
    if deal:
        post = post.repartition(search.cell_tasks(store.knowledge, qp["query_id"].nunique()), "at")
    hits = search.sparse_topk(qdf, post, k, True, key="at")
    return _named(hits, store.knowledge, search.few_hits(qp, k), "first")


def search_store(
    store: Store,
    queries: DataFrame,
    k: int = 5,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    plan: str = "auto",
    stop_words: list[str] | None = None,
    suffixes: tuple[str, ...] = (),
    join_pairs: int = JOIN_PAIRS,
) -> DataFrame:
    """Full-text top k over a written store (S9 then R4), the reference's
    query path: query terms weighted by the stored ``bm25_terms`` idf
    (``stop_words`` and ``suffixes``: those the store was built with). All
    plans give the same rows; ``auto`` chooses by the matches that the stored
    document frequencies promise:

    * ``postings``, up to ``join_pairs`` matches: the terms and their buckets become static filters of the term-bucket table,
      matches are joined from a broadcast and summed per chunk.
    * ``index``, otherwise: every shard is scored where its rows are, by block
      maxima; k rows per query and task are exchanged. A query side too large
      to broadcast goes through in blocks.
    * ``scan``: every task scores its knowledge rows' stored maps.
    """
    qw, small = bm25.query_weights(queries, store.bm25_terms, stop_words, suffixes, max_broadcast_rows=max_broadcast_rows, with_df=True)
    columns = ["query_id", "term", "weight"]
    if not small:
        return sparse_store(store, qw.select(columns), k, max_broadcast_rows, "index")
    qp = qw.toPandas()  # proven small above
    few = int(qp["df"].sum()) <= join_pairs
    qp = qp[columns]
    if plan == "postings" or (plan == "auto" and few):
        return _join_postings(store, qp, qw.select(columns).schema, k, deal=not few)
    if plan == "scan":
        return search.with_text(search.bm25_scan_topk(qp, store.knowledge, None, k, doc_weight="stored"), store.knowledge, hits_small=search.few_hits(qp, k))
    return _named(shards.index_topk(qp, store.index, k), store.knowledge, search.few_hits(qp, k))
