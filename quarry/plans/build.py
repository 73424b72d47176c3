"""Build the knowledge store from pages or documents (the reference's data
command), as one DataFrame plan per output table.

pages -> sections -> chunks (materialised once) -> {dense vector, BM25 vector}
-> knowledge + postings + BM25 model tables. One shuffle builds document
frequencies; the postings write rebalances by term bucket. Nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import bm25, encode
from quarry.operators.chunks import recursive_chunks, window_chunks
from quarry.operators.sections import sections
from quarry.operators.sizing import spread
from quarry.plans.corpus import full_text_index, materialize
from quarry.sources.store import Store, knowledge_schema, shard_count, sharded, write_store
from quarry.sources.tables import count_rows


def full_text_vector(chunks: DataFrame, stats: DataFrame) -> DataFrame:
    """P11 per chunk: ``full_text_vector`` = term -> BM25 weight map built in
    the row (terms are distinct per chunk), no shuffle."""
    avgdl = stats.select("avgdl").scalar()
    norm = F.lit(bm25.BM25_K1) * (
        F.lit(1.0 - bm25.BM25_B) + F.lit(bm25.BM25_B) * F.col("dl").cast("double") / avgdl
    )

    def weight(tf):
        tf = tf.cast("double")
        return (tf * F.lit(bm25.BM25_K1 + 1.0) / (tf + F.col("_norm"))).cast("float")

    staged = chunks.withColumn("_norm", norm)
    return staged.withColumn(
        "full_text_vector",
        F.map_from_arrays(F.col("terms.term"), F.transform(F.col("terms.tf"), weight)),
    ).drop("_norm")


#: Between two terms; the analyzer gives none that holds it.
_BREAK = "\x00"


def packed_terms(chunks: DataFrame) -> DataFrame:
    """``terms`` as one string and an array of counts, for an exchange: as an
    array of structs a term takes forty bytes there."""
    joined = F.array_join(F.col("terms.term"), _BREAK)
    return chunks.withColumns({"_words": joined, "_tf": F.col("terms.tf").cast("array<int>")}).drop("terms")


def unpacked_terms(chunks: DataFrame, zipped: bool = True) -> DataFrame:
    """``terms`` again; not ``zipped``, as one struct of two arrays, from which
    ``terms.term`` and ``terms.tf`` are taken without making a struct a term."""
    none = F.array().cast("array<string>")
    split = chunks.withColumn("_words", F.when(F.size("_tf") == 0, none).otherwise(F.split("_words", _BREAK)))
    terms = F.arrays_zip("_words", "_tf").cast("array<struct<term:string,tf:bigint>>")
    if not zipped:
        terms = F.struct(F.col("_words").alias("term"), F.col("_tf").alias("tf"))
    return split.withColumn("terms", terms).drop("_words", "_tf")


def knowledge_rows(
    chunks: DataFrame,
    settings: Settings = Settings(),
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    counts: dict | None = None,
    make_sparse_encoder: Callable | None = None,
    shards: int | None = None,
) -> tuple[DataFrame, object]:
    """Knowledge rows and the full-text index they were scored with.

    ``chunks`` must be materialised (see ``corpus.materialize``). Dense
    vectors come from ``make_encoder`` and learned-sparse ones from
    ``make_sparse_encoder`` when given, else from the stand-ins.
    With full text on, rows whose BM25 vector is empty are dropped (P10); with
    it off, nothing is dropped. With ``shards`` rows are dealt to so many
    document shards before any vector is made, so that none is shuffled.
    """
    ix = full_text_index(chunks)
    rows = ix.chunks
    if settings.enable_full_text:
        if counts is not None:  # S2/P10: rows before and after, counted in passing
            rows, counts["before_filter"] = count_rows(rows, "before_filter")
        rows = rows.where(F.size("terms") > 0)  # as large as the vector made of them
        if counts is not None:
            rows, counts["after_filter"] = count_rows(rows, "after_filter")
    placed = []
    if shards is not None:
        rows, placed = unpacked_terms(sharded(packed_terms(rows), shards), zipped=False), ["shard", "doc", "first"]
    if make_encoder is None:
        rows = encode.hash_vectors_from_terms(rows, "terms", settings.dense_dim, out="dense_vector")
    else:
        rows = encode.encode_with_model(rows, make_encoder, "text", out="dense_vector")
    cols = ["pk", "text", "dense_vector", "source"]
    if settings.enable_sparse:
        rows = encode.with_sparse_map(rows, ids=encode.term_ids("terms")) if make_sparse_encoder is None else encode.sparse_with_model(rows, make_sparse_encoder)
        cols.append("sparse_vector")
    if settings.enable_full_text:
        rows = full_text_vector(rows, ix.stats)
        cols.append("full_text_vector")
    schema = knowledge_schema(settings.dense_dim, settings.enable_sparse, settings.enable_full_text)
    # the counts behind the BM25 vector, from which a store weighs its postings
    counted = ["dl", F.col("terms.tf").cast("array<int>").alias("tf")] if settings.enable_full_text else []
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], *placed, *counted), ix


def page_chunks(
    pages: DataFrame,
    settings: Settings = Settings(),
    tag: str = "section",
    anchor_policy: str = "skip",
    chunker: str = "recursive",
) -> DataFrame:
    """pages -> sections -> chunks with tokens counted, materialised once:
    (pk, page_id, section_pos, source, chunk_pos, text, dl, terms)."""
    secs = sections(spread(pages), tag=tag, anchor_policy=anchor_policy)
    chunk = recursive_chunks if chunker == "recursive" else window_chunks
    chunks = chunk(
        secs, key_cols=["page_id", "section_pos"], size=settings.chunk_size, overlap=settings.chunk_overlap
    )
    return materialize(bm25.with_terms(chunks, stop_words=list(settings.stop_words), suffixes=settings.suffixes))


def build_store(
    pages: DataFrame,
    settings: Settings = Settings(),
    tag: str = "section",
    anchor_policy: str = "skip",
    chunker: str = "recursive",
    make_encoder=None,
    make_sparse_encoder=None,
) -> Store:
    """pages(page_id, url, html) -> the four store tables (lazy)."""
    chunks = page_chunks(pages, settings, tag, anchor_policy, chunker)
    count = shard_count(chunks.sparkSession, chunks.count())
    rows, ix = knowledge_rows(chunks, settings, make_encoder, make_sparse_encoder=make_sparse_encoder, shards=count)
    return Store(rows, ix.postings, ix.vocab, ix.stats, shards=count)


def build_and_write(pages: DataFrame, root: str, settings: Settings = Settings(), **kw) -> Store:
    store = build_store(pages, settings, **kw)
    write_store(store, root, settings.dense_dim)
    return store
