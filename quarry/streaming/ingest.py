"""Incremental ingestion with Structured Streaming.

The stateless part of the build (page scan -> sections -> chunks -> dense
vectors) is the same DataFrame functions over a streaming source: new page
files are parsed, chunked and encoded as they arrive and appended to a
parquet table, exactly once per file (the checkpoint records progress). BM25
statistics are global over the whole corpus, so fitting stays a batch job
over the appended table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import CHUNK_OVERLAP, CHUNK_SIZE, DENSE_DIM
from quarry.operators.chunks import documents_as_sections, recursive_chunks, window_chunks
from quarry.operators.encode import hash_vectors
from quarry.operators.sections import sections

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def chunk_stream(
    pages: DataFrame,
    tag: str = "section",
    anchor_policy: str = "skip",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    dim: int = DENSE_DIM,
) -> DataFrame:
    """pages -> (pk, page_id, section_pos, chunk_pos, source, text, dense_vector);
    works on a batch or a streaming DataFrame."""
    secs = sections(pages, tag=tag, anchor_policy=anchor_policy)
    chunks = recursive_chunks(secs, key_cols=["page_id", "section_pos"], size=size, overlap=overlap)
    return hash_vectors(chunks, "text", dim, out="dense_vector").select(
        "pk", "page_id", "section_pos", "chunk_pos", "source", "text", "dense_vector"
    )


def start_ingest(
    spark: SparkSession,
    pages_dir: str,
    out_dir: str,
    checkpoint_location: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    **chunk_args,
):
    """Start the stream: parquet page files under ``pages_dir`` -> chunk rows
    appended under ``out_dir``. ``checkpoint_location`` must be a shared,
    durable folder (it is what makes restarts exactly-once)."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = reader.parquet(pages_dir).select(F.col("page_id").cast("long"), "url", "html")
    writer = (
        chunk_stream(pages, **chunk_args)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_location)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


DOCUMENTS_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


def ingest_documents(
    spark: SparkSession,
    documents: str,
    out_dir: str,
    checkpoint_location: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    max_files_per_trigger: int | None = None,
):
    """Start a stream over the parquet files of ``documents`` (a file or a
    folder that files are added to): window chunks appended under ``out_dir``.
    It ends when all files there are taken in; started again on the same
    checkpoint, it takes in new files only."""
    reader = spark.readStream.schema(DOCUMENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # a stream takes a single file only through a pattern, so the path is one
    pattern = f"{documents[:-1]}[{documents[-1]}]"
    sections_ = documents_as_sections(reader.parquet(pattern))
    chunks = window_chunks(sections_, key_cols=["doc_id", "section_pos"], size=size, overlap=overlap)
    writer = chunks.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_location)
    return writer.outputMode("append").trigger(availableNow=True).start()
