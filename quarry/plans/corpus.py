"""Shared sub-plans over the driver's tables: the chunk corpus, its BM25
model and postings, and the query table. Each returns lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.config import CHUNK_OVERLAP, CHUNK_SIZE
from quarry.operators import bm25
from quarry.operators.chunks import documents_as_sections, recursive_chunks, window_chunks
from quarry.operators.sizing import spread
from quarry.session import scratch_path, write_table
from quarry.sources.tables import queries_from_table, read_table


def document_chunks(
    spark: SparkSession,
    sf_dir: str,
    chunker: str = "window",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """``documents`` (whole texts) -> chunks(pk, doc_id, section_pos, source, chunk_pos, text)."""
    sections = spread(documents_as_sections(read_table(spark, sf_dir, "documents")))
    keys = ["doc_id", "section_pos"]
    if chunker == "window":
        return window_chunks(sections, key_cols=keys, size=size, overlap=overlap)
    if chunker == "recursive":
        return recursive_chunks(sections, key_cols=keys, size=size, overlap=overlap)
    raise ValueError(f"unknown chunker {chunker!r}")


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: write the rows as parquet into the
    shared checkpoint folder and read them back. Later stages (and recomputes
    after a lost executor) read the files instead of re-running the plan, and
    get column pruning: a scan needing ``pk, dl, terms`` skips the text.
    (``Dataset.checkpoint`` would compute the plan twice without a persist.)"""
    path = scratch_path(df.sparkSession, "table")
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


_BUILT: dict = {}


def input_stamp(spark: SparkSession, sf_dir: str, tables: tuple = ("documents", "pages", "benchmark")) -> tuple:
    """Modification time and size of the input tables, asked of their file
    system: another stamp is another input under the same path."""
    out = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            out.append((name, system.getFileStatus(path).getModificationTime(), system.getContentSummary(path).getLength()))
    return tuple(out)


def built_once(spark: SparkSession, key: tuple, make):
    """A corpus artefact built once per Spark application and input (``key[1]``
    is its folder, known by its stamp); the knowledge store is built once and
    then answers many query tables. The artefact is a table written in the
    shared checkpoint folder."""
    full = (spark.sparkContext.applicationId, input_stamp(spark, key[1])) + key
    if full not in _BUILT:
        _BUILT[full] = make()
    return _BUILT[full]


def indexed_chunks(spark: SparkSession, sf_dir: str, chunker: str = "window", suffixes: tuple = ()) -> DataFrame:
    """Chunks with their token counts, materialised once:
    (pk, doc_id, section_pos, source, chunk_pos, text, dl, terms)."""
    return built_once(
        spark,
        ("chunks", sf_dir, chunker, suffixes),
        lambda: materialize(bm25.with_terms(document_chunks(spark, sf_dir, chunker), suffixes=suffixes)),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``benchmark`` table as ``queries(query_id, query_text)``."""
    return queries_from_table(read_table(spark, sf_dir, "benchmark"), "item_id", "text")


@dataclass
class FullTextIndex:
    chunks: DataFrame
    terms: DataFrame
    vocab: DataFrame
    stats: DataFrame
    postings: DataFrame


def full_text_index(chunks: DataFrame) -> FullTextIndex:
    """BM25 model and postings over chunks that already carry ``dl``/``terms``."""
    if "terms" not in chunks.columns:
        chunks = bm25.with_terms(chunks)
    vocab, stats = bm25.fit(chunks)
    return FullTextIndex(chunks, chunks, vocab, stats, bm25.doc_weights(chunks, stats))
