"""Chunking: sections -> overlapping text chunks.

Input is any table with a text column plus key columns; every other column
rides along with its chunks (P8). Output adds ``chunk_pos`` (long) and a
deterministic primary key ``pk`` = sha256 of the key columns and the chunk
position, so a recompute (e.g. after a lost executor) gives the same keys.
Neither operator shuffles: each chunk is produced in the task that read its text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS
from quarry.functions.text import explode_rows, not_blank
from quarry.operators.splitter import split_spans


def chunk_key(key_cols: list[str], pos: Column | str = "chunk_pos") -> Column:
    pos_c = F.col(pos) if isinstance(pos, str) else pos
    parts = [F.col(c).cast("string") for c in key_cols] + [pos_c.cast("string")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _explode_chunks(
    df: DataFrame, chunks: Column, text_col: str, key_cols: list[str]
) -> DataFrame:
    others = [c for c in df.columns if c not in (text_col, "_pieces")]
    staged = df.withColumn("_chunks", chunks)
    exploded = explode_rows(staged, "_chunks", "_chunk", others, pos="chunk_pos")
    return exploded.select(
        chunk_key(key_cols).alias("pk"),
        *others,
        F.col("chunk_pos").cast("long").alias("chunk_pos"),
        F.col("_chunk").alias(text_col),
    )


def window_chunks(
    df: DataFrame,
    text_col: str = "text",
    key_cols: list[str] | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Fixed windows of ``size`` characters every ``size - overlap``.

    This is what the recursive splitter yields for text holding none of its
    first three separators. Pure Catalyst; blank windows are dropped, the window
    index is kept as ``chunk_pos``. The text is cut once into pieces of
    ``size - overlap`` characters and a window is put together from its pieces:
    counting to each window's start would cost the square of the text's length.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    key_cols = key_cols or [df.columns[0]]
    step = size - overlap
    n = F.length(text_col)
    count = F.when(n <= size, F.lit(1)).otherwise(
        F.lit(1) + F.ceil((n - F.lit(size)) / F.lit(step)).cast("int")
    )
    more = -(-size // step) - 1  # pieces of a window after its first
    pieces = F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    staged = df.where(F.col(text_col).isNotNull()).withColumn("_pieces", pieces)

    def window(first: Column, i: Column) -> Column:
        rest = F.array_join(F.slice("_pieces", i + 2, F.lit(more)), "")
        return F.substring(F.concat(first, rest), 1, size)

    firsts = F.slice("_pieces", 1, count)
    windows = F.transform(firsts, window) if more else firsts
    out = _explode_chunks(staged, windows, text_col, key_cols)
    return out.where(not_blank(text_col))


_CUT = "array<struct<text:string,start:bigint,end:bigint>>"


def _recursive_udf(size: int, overlap: int, separators: tuple):
    @F.pandas_udf(_CUT)
    def split_batch(texts: pd.Series) -> pd.Series:
        cut = lambda t: [{"text": t[a:b], "start": a, "end": b} for a, b in split_spans(t, size, overlap, separators)]
        return texts.map(cut)

    return split_batch


def recursive_chunks(
    df: DataFrame,
    text_col: str = "text",
    key_cols: list[str] | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple = SEPARATORS,
    offsets: bool = False,
) -> DataFrame:
    """The recursive splitter over whole texts, in Arrow batches.

    The Python step only maps one text to its list of chunks; the explode and
    keys are Catalyst. Blank text gives no chunk. With ``offsets`` each chunk
    has ``start`` and ``end`` (code points, end exclusive): it is that cut of
    its text, so an answer can be traced to its place in the source.
    """
    key_cols = key_cols or [df.columns[0]]
    split_batch = _recursive_udf(size, overlap, tuple(separators))
    out = _explode_chunks(df, split_batch(F.col(text_col)), text_col, key_cols)
    more = [F.col(f"{text_col}.{c}").alias(c) for c in ("start", "end")] if offsets else []
    return out.select(*[c for c in out.columns if c != text_col], F.col(f"{text_col}.text").alias(text_col), *more)


def documents_as_sections(documents: DataFrame) -> DataFrame:
    """The ``documents`` table in section shape: one section per document."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("section_pos"),
        F.col("source").alias("source"),
        F.col("text").alias("text"),
    )
