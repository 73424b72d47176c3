"""Combining ranked lists: reciprocal rank fusion (U1, A4, W4-W6), pooling for
reranking (U2, U3, W7) and the context string (A5).

Hit lists are ``(query_id, rank, pk, text, score)`` with ranks from 1. Fusion
is keyed by *text*, as in the reference, so equal chunk texts merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import RRF_K, TOP_K


def label_lists(lists: Sequence[DataFrame]) -> DataFrame:
    """Union of ranked lists, each tagged with its list number and the
    zero-based position (W4) of every hit in it."""
    tagged = [
        df.select(
            "query_id",
            "text",
            F.lit(i).cast("long").alias("list_no"),
            (F.col("rank") - 1).cast("long").alias("pos"),
        )
        for i, df in enumerate(lists)
    ]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def rrf(lists: Sequence[DataFrame], k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """RRF over ranked lists -> ``(query_id, rank, text, score)``, best ``k``.

    score(text) = sum over its occurrences of 1 / (pos + rrf_k). Ties keep the
    order of first appearance (first list first, then position), which is
    what a stable sort of an insertion-ordered dictionary gives.
    """
    fused = (
        label_lists(lists)
        .groupBy("query_id", "text")
        .agg(
            F.sum(F.lit(1.0) / (F.col("pos") + F.lit(rrf_k)).cast("double")).alias("score"),
            F.min(F.struct("list_no", "pos")).alias("first"),
        )
    )
    w = Window.partitionBy("query_id").orderBy(
        F.round("score", 9).desc(), F.col("first.list_no"), F.col("first.pos")
    )
    return (
        fused.withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "text", "score")
    )


def pooled(lists: Sequence[DataFrame]) -> DataFrame:
    """U2 + U3: every hit of every list, duplicates of one text removed.
    ``(query_id, text)``, one row per distinct text."""
    out = lists[0].select("query_id", "text")
    for df in lists[1:]:
        out = out.unionByName(df.select("query_id", "text"))
    return out.dropDuplicates(["query_id", "text"])


def context(hits: DataFrame, queries: DataFrame, sep: str = " ") -> DataFrame:
    """A5: texts of each query's hits joined by ``sep`` in rank order;
    ``''`` for a query without hits (every query keeps a row)."""
    joined = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]
            ),
            sep,
        ).alias("context")
    )
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id", F.coalesce(F.col("context"), F.lit("")).alias("context")
    )
