"""Corpus inventory: archive status per document, totals, report and index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.naming import date_from_name
from ..functions.refs import product_key
from ..functions.strings import text_or_empty
from ..functions.verdicts import DEEP_READ, READ_NO, REFINEMENT, processing_method, read_flag
from .source_index import BLANK_CELL, LOCAL_ADAPTER, LOCAL_LINK, NO_ADAPTER, cell, render_row

_LINKS = ("refinement", "deep_read", "learning")


def build(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """source, method, read and artefact links of every document (entries are unique by source)."""
    joined = sources.select("source").join(entries, "source", "left")
    method = processing_method(F.col("method"), *[F.col(c) for c in _LINKS])
    return joined.select(
        "source",
        method.alias("method"),
        read_flag(method).alias("read"),
        *[text_or_empty(F.col(c)).alias(c) for c in _LINKS],
    )


def duplicate_entries(entries: DataFrame) -> DataFrame:
    """Entries that make a status manifest invalid: blank or repeated sources."""
    return (
        entries.groupBy("source").agg(F.count(F.lit(1)).alias("entries"))
        .where((F.col("entries") > 1) | (text_or_empty(F.col("source")) == ""))
    )


def totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("method") == DEEP_READ).alias("learning"),
        F.count_if(F.col("method") == REFINEMENT).alias("refinement"),
        F.count_if(F.col("read") == READ_NO).alias("unread"),
    )


def index_rows(inventory: DataFrame, existing: DataFrame) -> DataFrame:
    """Synchronised index: link, adapter and date of the last old row, fresh read flag."""
    old = existing.groupBy(product_key(F.col("product")).alias("source")).agg(
        F.max_by(F.struct("link", "extractor", "day"), "row_no").alias("old")
    )
    folder = F.col("source").endswith("/content.md")
    return inventory.join(old, "source", "left").select(
        "source",
        F.coalesce(F.col("old")["link"], F.when(folder, LOCAL_LINK).otherwise(BLANK_CELL)).alias("link"),
        F.coalesce(F.col("old")["extractor"], F.when(folder, LOCAL_ADAPTER).otherwise(NO_ADAPTER)).alias("extractor"),
        F.coalesce(F.col("old")["day"], date_from_name(F.col("source")), F.lit(BLANK_CELL)).alias("day"),
        "read",
    )


def index_line(rows: DataFrame) -> DataFrame:
    return rows.select(
        "source",
        render_row(F.col("link"), F.col("extractor"), F.col("source"), F.col("day"), F.col("read")).alias("line"),
    )


def report_rows(inventory: DataFrame, folder: str = "output/") -> DataFrame:
    """One Markdown table row per document with links to its artefacts."""
    link = lambda label, c: F.concat(F.lit(f"[{label}]("), F.col(c), F.lit(")"))
    artefacts = (
        F.when(F.col("method") == REFINEMENT, link("Refinement", "refinement"))
        .when(F.col("method") == DEEP_READ, F.concat(link("DeepRead", "deep_read"), F.lit(" · "), link("Learning", "learning")))
        .otherwise(BLANK_CELL)
    )
    return inventory.select(
        "source",
        F.concat(
            F.lit(f"| {folder}"), cell(F.col("source")), F.lit(" | "), F.col("method"), F.lit(" | "),
            F.col("read"), F.lit(" | "), artefacts, F.lit(" |"),
        ).alias("line"),
    )


def report_totals(inventory: DataFrame) -> DataFrame:
    n = lambda c: F.concat(F.lit("**"), F.col(c).cast("string"), F.lit("**"))
    return totals(inventory).select(
        F.concat(
            F.lit("原稿 "), n("total"), F.lit(" 篇；DeepRead + Learning "), n("learning"), F.lit(" 篇；Refinement "),
            n("refinement"), F.lit(" 篇；未精读 "), n("unread"), F.lit(" 篇。"),
        ).alias("line")
    )
