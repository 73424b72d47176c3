"""Scans: the driver's parquet tables, HTML files on disk, and query tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, e.g. ``read_table(spark, dir, "documents")``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_html_files(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """Page scan of a folder tree (S1): every ``*.html`` at any depth.

    Returns ``pages(page_id, url, html)``; ``url`` is the path below ``root`` with
    an ``https://`` prefix, so the base-URL rule (host + folder) applies unchanged.
    Directories are never matched by the glob filter.
    """
    root = root.rstrip("/")
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    # the scan names files by qualified paths; the root in the same form is their prefix
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = system.makeQualified(folder).toString().rstrip("/")
    rel = F.substring(F.col("path"), len(prefix) + 2, 1 << 30)
    # text mode: every line end is one newline
    html = F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "\r\n?", "\n")
    return raw.select(
        F.xxhash64("path").alias("page_id"),
        F.concat(F.lit("https://"), rel).alias("url"),
        html.alias("html"),
    )


def queries_from_table(
    df: DataFrame, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``queries(query_id, query_text)`` from any table with an id and a text."""
    return df.select(
        F.col(id_col).cast("long").alias("query_id"), F.col(text_col).alias("query_text")
    )


def user_questions(conversations: DataFrame) -> DataFrame:
    """Questions asked in ``conversations`` (user turns) as a query table.
    The id holds conversation and turn (below 2**31 and 2**32) side by side."""
    return conversations.where(F.col("role") == "user").select(
        (F.col("conv_id").cast("long") * F.lit(1 << 32) + F.col("turn")).cast("long").alias("query_id"),
        F.col("text").alias("query_text"),
    )


def count_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, object]:
    """Count rows while they stream past (no extra scan); read ``obs.get``
    after the first action on the returned DataFrame."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n")), obs
