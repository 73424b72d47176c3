"""Encoders (E1-E4): text -> dense or sparse vectors, as table jobs.

The reference's neural models cannot be downloaded here, so two offline
stand-ins ship, labelled as such (they are *not* equal to those models):

* dense  = feature hashing of analyzer tokens into ``dim`` buckets
           (bucket = first 32 bits of md5(token) mod dim), L2-normalised;
* sparse = ``1 + ln(tf)`` per term id (first 32 bits of md5 mod 2^31-1).

A real model plugs in through ``encode_with_model``: the caller passes a
factory that builds the model once per task; rows flow in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import BATCH_SIZE, DENSE_DIM
from quarry.functions.text import explode_rows, term_id, tokens, with_term_counts


#: Rows whose bucket counts are made at once; they stay in a core's cache.
UNIT_ROWS = 512


def _buckets(tokens: pa.Array, dim: int) -> np.ndarray:
    """``functions.text.hash_bucket`` of each token."""
    digests = b"".join([md5(t).digest() for t in tokens.cast(pa.binary()).to_pylist()])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dim


def term_ids(terms_col: str = "terms") -> Column:
    """``functions.text.term_id`` of each of a row's counted terms, over whole
    Arrow batches; a term that comes often in a batch is hashed once."""

    def ids(words: pa.Array) -> pa.Array:
        code = words.flatten().dictionary_encode()
        flat = _buckets(code.dictionary, 2147483647).astype(np.int32)[code.indices.to_numpy(zero_copy_only=False)]
        ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return F.arrow_udf(ids, "array<int>")(F.col(f"{terms_col}.term"))


def _unit_vectors(texts: pa.Array, counts: pa.Array | None, dim: int) -> pa.Array:
    """Unit vectors of the bucket counts of each row's tokens. A token that
    comes often in a batch is hashed once."""
    n = len(texts)
    lens = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    code = texts.flatten().dictionary_encode()
    bucket = _buckets(code.dictionary, dim)[code.indices.to_numpy(zero_copy_only=False)]
    weights = None if counts is None else counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(lens)])
    out = np.empty((n, dim), np.float32)
    for lo in range(0, n, UNIT_ROWS):
        hi = min(n, lo + UNIT_ROWS)
        part = slice(first[lo], first[hi])
        cell = np.repeat(np.arange(hi - lo) * dim, lens[lo:hi]) + bucket[part]
        m = np.bincount(cell, None if weights is None else weights[part], (hi - lo) * dim).reshape(hi - lo, dim)
        norms = np.sqrt((m * m).sum(axis=1))
        norms[norms == 0] = 1.0
        out[lo:hi] = m / norms[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(out.ravel()))


def _unit_udf(dim: int, counted: bool):
    def weighted_unit(terms: pa.Array, counts: pa.Array) -> pa.Array:
        return _unit_vectors(terms, counts, dim)

    def unit(words: pa.Array) -> pa.Array:
        return _unit_vectors(words, None, dim)

    return F.arrow_udf(weighted_unit if counted else unit, "array<float>")


def hash_vectors(
    df: DataFrame, text_col: str = "text", dim: int = DENSE_DIM, out: str = "vector"
) -> DataFrame:
    """Dense stand-in (E1/E2): adds ``out`` = ``array<float>`` of length ``dim``.

    Tokenising runs in the JVM; hashing, the bucket count and normalisation run
    over whole Arrow batches.
    """
    return df.withColumn(out, _unit_udf(dim, False)(tokens(F.col(text_col))))


def hash_vectors_from_terms(
    df: DataFrame, terms_col: str = "terms", dim: int = DENSE_DIM, out: str = "vector"
) -> DataFrame:
    """Same vectors as ``hash_vectors`` from already counted ``terms``
    (``array<struct<term, tf>>``), no re-tokenising."""
    return df.withColumn(out, _unit_udf(dim, True)(F.col(f"{terms_col}.term"), F.col(f"{terms_col}.tf")))


def sparse_vectors(df: DataFrame, text_col: str = "text", key: str = "pk") -> DataFrame:
    """Sparse stand-in (E3/E4) as exploded rows ``(key, term_id, weight)``.

    Weight ``1 + ln(tf)``; a narrow map over the input, no shuffle.
    """
    tok = df.select(key, tokens(F.col(text_col)).alias("_tok"))
    counted = explode_rows(with_term_counts(tok, "_tok", "_tc"), "_tc", "t", [key])
    return counted.select(
        key,
        term_id(F.col("t.term")).alias("term_id"),
        (F.lit(1.0) + F.log(F.col("t.tf").cast("double"))).alias("weight"),
    )


def with_sparse_map(
    df: DataFrame, terms_col: str = "terms", out: str = "sparse_vector", weight: str = "float", ids: Column | None = None
) -> DataFrame:
    """P11/A8 in the row: counted terms -> ``map<int,float>`` (or another type
    of ``weight``) of the sparse stand-in's weights. Terms of a row whose ids collide are one index with
    the sum of their weights. ``ids``: the terms' ids where they are made over
    whole batches (``term_ids``). No shuffle."""
    ids = F.transform(terms_col, lambda t: term_id(t["term"])) if ids is None else ids
    staged = df.withColumn("_ids", ids).withColumn(
        "_weights", F.transform(F.col(f"{terms_col}.tf"), lambda tf: F.lit(1.0) + F.log(tf.cast("double")))
    )
    staged = staged.withColumn("_keys", F.array_distinct("_ids"))

    def total(key):
        mine = F.filter(F.arrays_zip("_ids", "_weights"), lambda p: p["_ids"] == key)
        return F.aggregate(mine, F.lit(0.0), lambda acc, p: acc + p["_weights"])

    collide = F.size("_keys") < F.size("_ids")
    values = F.when(collide, F.transform("_keys", total)).otherwise(F.col("_weights"))
    return staged.withColumn(out, F.map_from_arrays("_keys", values.cast(f"array<{weight}>"))).drop(
        "_ids", "_weights", "_keys"
    )


def to_sparse_map(rows: DataFrame, key: str = "pk", index: str = "term_id", value: str = "weight") -> DataFrame:
    """Exploded ``(key, index, value)`` -> ``(key, map<int,float>)``;
    explicit zeros are dropped so indexes and values cannot shift."""
    return (
        rows.where(F.col(value) != 0)
        .groupBy(key, index)  # terms whose ids collide are one index
        .agg(F.sum(value).alias(value))
        .groupBy(key)
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.col(index).cast("int"), F.col(value).cast("float")))
            ).alias("sparse_vector")
        )
    )


def encode_with_model(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = "text",
    out: str = "vector",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """E1/E2 with a caller's model: ``make_encoder()`` runs once per task and
    returns ``encode(list[str]) -> ndarray (rows x dim)``; called on batches of
    ``batch_size`` texts. Adds ``out`` as ``array<float>``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterable[pd.DataFrame]):
        encode = make_encoder()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                part = np.asarray(encode(texts[i : i + batch_size]), dtype=np.float32)
                vecs.extend(list(part))
            pdf[out] = vecs
            yield pdf

    return df.mapInPandas(run, schema)


def sparse_with_model(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], list[dict[int, float]]]],
    text_col: str = "text",
    out: str = "sparse_vector",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """E3/E4 with a caller's model: ``make_encoder()`` runs once per task and
    returns ``encode(list[str])``, one ``{index: weight}`` per text; called on
    batches of ``batch_size`` texts. Adds ``out`` as ``map<int,float>``; zero
    weights are left out. Null texts are encoded as empty ones."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.MapType(T.IntegerType(), T.FloatType()))])

    def run(batches: Iterable[pd.DataFrame]):
        encode = make_encoder()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            maps: list = []
            for i in range(0, len(texts), batch_size):
                maps.extend({int(t): float(w) for t, w in m.items() if w} for m in encode(texts[i : i + batch_size]))
            pdf[out] = maps
            yield pdf

    return df.mapInPandas(run, schema)
