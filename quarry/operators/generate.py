"""Prompt, response and trust-score columns (G1-G3, G5) and the reranker
score (R6), for whole tables of queries.

Model calls are the caller's: pass a factory building the client/model once
per task; rows reach it in Arrow batches. Offline stand-ins (not models):
* response   = the first ranked passage of the context ('' if none);
* trust      = coverage: share of the query's distinct tokens found in the
               response (0 for a query without tokens);
* consistency = mean Jaccard similarity of the token sets of all pairs of
               sampled responses to one prompt (G4);
* reranker   = sum of BM25 idf over the query's distinct tokens found in the
               candidate text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import BATCH_SIZE, MAX_BROADCAST_ROWS, MAX_OUTPUT_TOKENS, SYSTEM_PROMPT
from quarry.functions.template import substitute
from quarry.functions.text import explode_rows, tokens
from quarry.operators.sizing import broadcast_if_small


def prompt_column(template: str, query: Column, context: Column | None = None) -> Column:
    """G1: fill ``$query`` (and ``$context`` when the template has both)."""
    return substitute(template, query, context)


def _map_text(
    df: DataFrame,
    make_fn: Callable[[], Callable[..., list]],
    in_cols: list[str],
    out: str,
    out_type: T.DataType,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField(out, out_type)])

    def run(batches: Iterable[pd.DataFrame]):
        fn = make_fn()
        for pdf in batches:
            vals = []
            cols = [pdf[c].fillna("").tolist() for c in in_cols]
            for i in range(0, len(pdf), batch_size):
                vals.extend(fn(*[c[i : i + batch_size] for c in cols]))
            pdf[out] = vals
            yield pdf

    return df.mapInPandas(run, schema)


def generate_responses(
    prompts: DataFrame,
    make_generator: Callable[[], Callable[[list[str], int, str], list[str]]],
    max_tokens: int = MAX_OUTPUT_TOKENS,
    system_prompt: str = SYSTEM_PROMPT,
) -> DataFrame:
    """G2 with a caller's model: ``make_generator()`` returns
    ``generate(prompts, max_tokens, system_prompt) -> responses``."""

    def make():
        gen = make_generator()
        return lambda p: gen(p, max_tokens, system_prompt)

    return _map_text(prompts, make, ["prompt"], "response", T.StringType())


def score_responses(
    rows: DataFrame, make_scorer: Callable[[], Callable[[list[str], list[str]], list[float]]]
) -> DataFrame:
    """G3 with a caller's scorer: ``score(prompts, responses) -> scores``."""
    return _map_text(rows, make_scorer, ["prompt", "response"], "trust_score", T.DoubleType())


def coverage(query_text: Column, response: Column) -> Column:
    """G3 stand-in: |distinct query tokens found in the response| / |distinct
    query tokens|; 0.0 when the query has no token."""
    q = F.array_distinct(tokens(query_text))
    hit = F.size(F.array_intersect(q, tokens(response)))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(hit.cast("double") / F.size(q).cast("double"))


#: Most samples of one query that are compared.
MAX_SAMPLES = 256


def sample_responses(
    prompts: DataFrame, make_generator: Callable, n: int, max_tokens: int = MAX_OUTPUT_TOKENS
) -> DataFrame:
    """``n`` responses of a caller's model to every prompt: one row per query
    and ``sample_no`` (from 0)."""
    rows = prompts.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return generate_responses(rows, make_generator, max_tokens)


def sample_consistency(samples: DataFrame, most: int = MAX_SAMPLES) -> DataFrame:
    """``(query_id, n_samples, consistency)`` from ``samples(query_id,
    response)``: the mean over all pairs of a query's samples of the Jaccard
    similarity of their token sets (two empty sets are alike: 1; null responses
    are empty ones; a single sample has no pair: null).

    The sets of a query are collected into one row and the pairs are folded
    there; no pair becomes a row. A query may have ``most`` samples: rows past
    that are cut before they are collected, and the query fails the job."""
    w = Window.partitionBy("query_id").orderBy("_set")
    sets = samples.select("query_id", F.array_sort(F.array_distinct(tokens(F.coalesce("response", F.lit(""))))).alias("_set"))
    kept = sets.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    rows = kept.groupBy("query_id").agg(F.collect_list("_set").alias("_sets"))
    n = F.size("_sets")

    def alike(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b)).cast("double")
        either = F.size(a) + F.size(b) - both
        return F.when(either == 0, F.lit(1.0)).otherwise(both / either)

    def with_later(total: Column, i: Column) -> Column:
        later = F.slice(F.col("_sets"), i + 2, n)
        return F.aggregate(later, total, lambda t, other: t + alike(F.get(F.col("_sets"), i), other))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), with_later)
    pairs = n.cast("double") * (n - 1) / 2
    checked = F.when(n > most, F.raise_error(F.lit(f"more than {most} samples of one query"))).otherwise(n)
    return rows.select(
        "query_id", checked.cast("long").alias("n_samples"), F.when(n > 1, total / pairs).alias("consistency")
    )


def first_passage(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """G2 stand-in: ``(query_id, response)`` = rank-1 text, '' without hits."""
    top = hits.where(F.col("rank") == 1).select("query_id", F.col("text").alias("response"))
    return queries.select("query_id").join(top, "query_id", "left").select(
        "query_id", F.coalesce(F.col("response"), F.lit("")).alias("response")
    )


def idf_overlap(candidates: DataFrame, queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """R6 stand-in scorer: ``(query_id, text, score)`` for every candidate,
    score = sum of idf over distinct query tokens present in the text.
    Only the query's own terms are joined; candidates are few per query."""
    qt = explode_rows(
        queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("_q")),
        "_q",
        "term",
        ["query_id"],
    )
    # the vocabulary grows with the corpus: stream it past the (checked) query terms
    qt, _ = broadcast_if_small(qt, MAX_BROADCAST_ROWS)
    qterms = vocab.select("term", "idf").join(qt, "term")
    cterms = explode_rows(
        candidates.select("query_id", "text", F.array_distinct(tokens(F.col("text"))).alias("_t")),
        "_t",
        "term",
        ["query_id", "text"],
    )
    scored = cterms.join(qterms, ["query_id", "term"]).groupBy("query_id", "text").agg(
        F.sum("idf").alias("score")
    )
    return candidates.select("query_id", "text").join(scored, ["query_id", "text"], "left").select(
        "query_id", "text", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
    )


def score_pairs(
    candidates: DataFrame,
    queries: DataFrame,
    make_scorer: Callable[[], Callable[[list[str], list[str]], list[float]]],
) -> DataFrame:
    """R6 with a caller's cross-encoder: ``score(query_texts, texts)``."""
    pairs = candidates.join(queries.select("query_id", "query_text"), "query_id")
    out = _map_text(pairs, make_scorer, ["query_text", "text"], "score", T.DoubleType())
    return out.select("query_id", "text", "score")
