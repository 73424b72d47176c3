"""BM25 as relational jobs (E5 fit, E6 document weights, E7 query weights).

Fit over a chunk table gives two tables: ``bm25_terms(term, df, idf)`` and
``bm25_stats(n, avgdl)``. Nothing is collected to the driver: ``n``, ``avgdl``
and the mean idf are scalar subqueries that Spark computes once per query.

Formulas (k1=1.5, b=0.75, epsilon=0.25):
    idf(t)   = ln(n - df + 0.5) - ln(df + 0.5); a negative idf is replaced by
               epsilon * mean(raw idf over all terms)
    doc w    = tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl))
    query w  = idf per occurrence (repeats add up)
    score    = inner product over shared terms

Tokens come from ``functions.text.tokens`` (lower case, split on
non-letter/digit). The library analyzer of the reference also removes English
stop words and stems; pass ``stop_words`` for the first part, and ``suffixes``
(endings cut off the corpus and the query side alike) in place of its stemmer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import BM25_B, BM25_EPSILON, BM25_K1, MAX_BROADCAST_ROWS
from quarry.functions.text import explode_rows, tokens, with_term_counts
from quarry.operators.sizing import broadcast_if_small


def with_terms(
    chunks: DataFrame, text: str = "text", stop_words: list[str] | None = None, suffixes: tuple[str, ...] = ()
) -> DataFrame:
    """Adds ``dl`` (token count) and ``terms array<struct<term, tf>>`` to each
    chunk row; a narrow map, no shuffle."""
    out = chunks.withColumn("_tok", tokens(F.col(text), stop_words, suffixes))
    out = out.withColumn("dl", F.size("_tok").cast("long"))
    return with_term_counts(out, "_tok", "terms").drop("_tok")


def fit(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E5 over ``with_terms`` output -> ``(bm25_terms, bm25_stats)``.

    ``n`` counts every chunk, also those without a token, as the library does.
    The document-frequency count is a shuffle on ``term`` after a map-side
    partial count, so a term present in a third of all chunks costs one row per
    task, not one row per chunk.
    """
    stats = terms.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl")
    )
    n = stats.select(F.col("n").cast("double")).scalar()
    dfreq = (
        explode_rows(terms, "terms", "t", [])
        .groupBy(F.col("t.term").alias("term"))
        .agg(F.count(F.lit(1)).alias("df"))
    )
    raw = dfreq.withColumn(
        "raw_idf", F.log(n - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    )
    mean_idf = raw.select(F.avg("raw_idf")).scalar()
    vocab = raw.select(
        "term",
        "df",
        F.when(F.col("raw_idf") < 0, F.lit(BM25_EPSILON) * mean_idf)
        .otherwise(F.col("raw_idf"))
        .alias("idf"),
    )
    return vocab, stats


def doc_weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """Weight of a term that a chunk of ``dl`` tokens holds ``tf`` times."""
    tf = tf.cast("double")
    norm = F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * dl.cast("double") / avgdl)
    return tf * F.lit(BM25_K1 + 1.0) / (tf + norm)


def doc_weights(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``(pk, term, weight)`` for every term of every chunk (the postings).

    ``avgdl`` enters as a scalar subquery, so this is a narrow map over the
    chunk table: no join and no shuffle.
    """
    weight = doc_weight(F.col("t.tf"), F.col("dl"), stats.select("avgdl").scalar())
    return explode_rows(terms, "terms", "t", ["pk", "dl"]).select(
        "pk",
        F.col("t.term").alias("term"),
        weight.alias("weight"),
    )


def query_terms(
    queries: DataFrame, stop_words: list[str] | None = None, suffixes: tuple[str, ...] = ()
) -> DataFrame:
    """``(query_id, term, qtf)``: term counts of each query text, no shuffle."""
    q = queries.select("query_id", tokens(F.col("query_text"), stop_words, suffixes).alias("_tok"))
    return (
        explode_rows(with_term_counts(q, "_tok", "_qt"), "_qt", "t", ["query_id"])
        .select("query_id", F.col("t.term").alias("term"), F.col("t.tf").alias("qtf"))
    )


def query_weights(
    queries: DataFrame,
    vocab: DataFrame,
    stop_words: list[str] | None = None,
    suffixes: tuple[str, ...] = (),
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    with_df: bool = False,
) -> tuple[DataFrame, bool]:
    """``(query_id, term, weight = idf * count)``; unknown terms drop out.

    Returns the weights and whether they were proven small enough to
    broadcast. When they are, the vocabulary streams past a broadcast of the
    query terms and is never shuffled. ``with_df`` adds the term's document
    frequency, the number of chunks it matches.
    """
    qt, small = broadcast_if_small(query_terms(queries, stop_words, suffixes), max_broadcast_rows)
    more = ["df"] if with_df else []
    weights = vocab.select("term", "idf", *more).join(qt, "term").select(
        "query_id", "term", (F.col("idf") * F.col("qtf").cast("double")).alias("weight"), *more
    )
    return weights, small
