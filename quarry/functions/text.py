"""Column expressions for text. All are JVM-side but ``with_term_counts``,
which counts in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode white space; Spark's trim only spaces.
WHITE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
_EDGE_SPACE = f"^{WHITE}+|{WHITE}+$"
# Token rule of the offline BM25 analyzer: lower case, split on anything that is
# neither a letter nor a digit, drop blanks.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def py_strip(col: Column | str) -> Column:
    """Strip leading/trailing Unicode white space like Python ``str.strip``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, _EDGE_SPACE, "")


def not_blank(col: Column | str) -> Column:
    """Would ``py_strip`` leave anything? Stops at the first such character."""
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(WHITE.replace("[", "[^", 1))


#: Letters that must stay before an ending that is cut off.
MIN_STEM = 3


def without_suffix(token: Column, suffixes: tuple[str, ...]) -> Column:
    """``token`` without the longest of the ``suffixes`` (plain letters) that
    leaves ``MIN_STEM`` letters or more."""
    endings = sorted(suffixes, key=lambda s: (-len(s), s))
    if not all(s.isalnum() for s in endings):
        raise ValueError("suffixes are letters and digits only")
    cut = token
    for s in reversed(endings):  # the longest is asked first
        stem = F.substring(token, F.lit(1), F.char_length(token) - len(s))
        cut = F.when(F.endswith(token, F.lit(s)) & (F.char_length(token) >= len(s) + MIN_STEM), stem).otherwise(cut)
    return cut


def tokens(col: Column | str, stop_words: list[str] | None = None, suffixes: tuple[str, ...] = ()) -> Column:
    """``array<string>`` of analyzer tokens, in text order, repeats kept; stop
    words go first, then ``suffixes`` are cut (``without_suffix``)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(F.lower(c), TOKEN_SPLIT)
    keep = F.array_remove(parts, F.lit(""))
    if stop_words:
        stops = F.array(*[F.lit(w) for w in stop_words])
        keep = F.filter(keep, lambda t: ~F.array_contains(stops, t))
    if suffixes:
        keep = F.transform(keep, lambda t: without_suffix(t, suffixes))
    return F.coalesce(keep, F.array().cast("array<string>"))


def _counted(tok: pa.Array) -> pa.Array:
    """The distinct tokens of each row, ascending by their bytes (as Spark
    compares strings), with their counts."""
    n = len(tok)
    lens = tok.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    code = tok.flatten().dictionary_encode()
    order = pc.sort_indices(code.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(n), lens)
    cells, tf = np.unique(row * len(order) + place[code.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    row, at = np.divmod(cells, max(1, len(order)))
    counted = pa.StructArray.from_arrays([code.dictionary.take(pa.array(order[at])), pa.array(tf, pa.int64())], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), counted)


def with_term_counts(df: DataFrame, tok: str, out: str = "terms") -> DataFrame:
    """Adds ``out`` = ``array<struct<term, tf>>`` counted from the token array
    column ``tok``; per row, no shuffle. Whole Arrow batches are sorted at once:
    lambdas over a row's sorted tokens cost several times as much."""

    def counted(tok: pa.Array) -> pa.Array:
        return _counted(tok)

    return df.withColumn(out, F.arrow_udf(counted, "array<struct<term:string,tf:bigint>>")(F.col(tok)))


def term_id(term: Column) -> Column:
    """Stable non-negative 31-bit id of a term (first 32 bits of md5)."""
    return (
        F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % F.lit(2147483647)
    ).cast("int")


def hash_bucket(term: Column, dim: int) -> Column:
    """Feature-hashing bucket of a term in ``[0, dim)``."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % F.lit(dim)).cast(
        "int"
    )


def explode_rows(df: DataFrame, array_col: str, alias: str, keep: list[str], pos: str | None = None) -> DataFrame:
    """``explode`` (or ``posexplode`` with ``pos``) that keeps the array's
    producer expression from being duplicated.

    A plain ``explode`` makes the optimizer infer ``size(array) > 0`` and push
    that filter below the projection which computes the array, re-evaluating
    it (and any Python UDF or nested lambda in it) a second time. The outer
    form plus a null filter on the generated column gives the same rows
    without that inferred filter.
    """
    if pos is None:
        out = df.select(*keep, F.explode_outer(array_col).alias(alias))
    else:
        out = df.select(*keep, F.posexplode_outer(array_col).alias(pos, alias))
    return out.where(F.col(alias).isNotNull())
