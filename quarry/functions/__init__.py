"""Scalar column functions (JVM-side) and small driver-side helpers."""

from quarry.functions.template import split_template, substitute
from quarry.functions.text import hash_bucket, py_strip, term_id, tokens, with_term_counts

__all__ = [
    "hash_bucket",
    "py_strip",
    "split_template",
    "substitute",
    "term_id",
    "tokens",
    "with_term_counts",
]
