"""Pages -> sections (P1-P5) and the skip report.

The per-page parse runs in ``mapInPandas`` (Arrow batches, one output row per
section); URL handling and the skip rule are Catalyst. No shuffle: each page
is parsed in the task that read it.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.htmltext import page_sections

PARSED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("section_pos", T.LongType()),
        T.StructField("href", T.StringType()),
        T.StructField("has_anchor", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)


def base_url(url: Column) -> Column:
    """``https://`` + host + folder of a page URL (file name dropped).

    Query string and fragment go first (they may hold ``/``), then the
    scheme, then the last path segment.
    """
    no_query = F.regexp_replace(url, r"[?#].*$", "")
    no_scheme = F.regexp_replace(no_query, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    folder = F.regexp_replace(no_scheme, r"/[^/]*$", "")
    return F.concat(F.lit("https://"), folder)


def parse_pages(pages: DataFrame, tag: str = "section") -> DataFrame:
    """One row per ``<tag>`` element inside ``<body>``, in document
    order; a page without body or without any such element gives one row with
    that ``status`` and null section fields (for the skip report)."""

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                status, secs = page_sections(html or "", tag)
                if status != "ok":
                    rows.append((pid, url, status, None, None, None, None))
                for pos, href, has_a, text in secs:
                    rows.append((pid, url, "ok", pos, href, has_a, text))
            yield pd.DataFrame(rows, columns=PARSED.fieldNames())

    return pages.select(
        F.col("page_id").cast("long"), "url", "html"
    ).mapInPandas(run, PARSED)


def _with_reason(parsed: DataFrame, anchor_policy: str) -> DataFrame:
    if anchor_policy not in ("skip", "page"):
        raise ValueError("anchor_policy is 'skip' or 'page'")
    reason = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("href").isNotNull(), F.lit("ok"))
        .when(F.lit(anchor_policy == "page"), F.lit("ok"))
        .when(F.col("has_anchor"), F.lit("no_href"))
        .otherwise(F.lit("no_anchor"))
    )
    return parsed.withColumn("reason", reason)


def sections(
    pages: DataFrame, tag: str = "section", anchor_policy: str = "skip"
) -> DataFrame:
    """``sections(page_id, section_pos, source, text)``.

    ``source = base_url(url) + "/" + href`` of the first ``<a>`` in the
    section. A section without an ``href`` is skipped (``anchor_policy=
    "skip"``, the reference's rule) or sourced to the page's base URL
    (``"page"``, for pages whose content holds no links).
    """
    parsed = _with_reason(parse_pages(pages, tag), anchor_policy)
    base = base_url(F.col("url"))
    source = F.when(F.col("href").isNotNull(), F.concat(base, F.lit("/"), F.col("href"))).otherwise(base)
    return parsed.where(F.col("reason") == "ok").select(
        "page_id", "section_pos", source.alias("source"), "text"
    )


def skip_report(pages: DataFrame, tag: str = "section", anchor_policy: str = "skip") -> DataFrame:
    """The reference's warnings as data: ``(reason, n)`` for every reason a
    page or section gave no section row (``no_body``, ``no_section``,
    ``no_anchor``, ``no_href``), plus ``ok``."""
    parsed = _with_reason(parse_pages(pages, tag), anchor_policy)
    return parsed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
