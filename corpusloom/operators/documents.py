"""From captured pages to document rows: the end-to-end slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H
from ..functions.clock import capture_day
from ..functions.naming import output_path
from ..functions.pages import main_content
from ..functions.refs import canonical_key, host_of, normalize_reference, task_key
from ..functions.routing import classify
from ..functions.text import document_markdown
from ..functions.verdicts import is_thin
from ..runtime import materialize, spread
from .publish import publish_latest


def web_documents(pages: DataFrame) -> DataFrame:
    """pages(url, html, captured_at, seq) -> one document row per web page with a body."""
    routed = spread(pages).withColumn("reference", normalize_reference(F.col("url"))).withColumn(
        "channel", classify(F.col("reference"))
    )
    web = routed.where(F.col("channel") == "web")
    parsed = web.withColumn("__main", main_content(F.col("html"), F.col("reference"))).withColumn(
        "__tags", H.meta_tags(F.col("html"))
    )
    author, published = H.document_author(F.col("__tags")), H.document_published(F.col("__tags"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    pairs = F.filter(
        F.array(pair("来源", host_of(F.col("reference"))), pair("作者", author), pair("发布时间", published)),
        lambda p: (p["k"] == "来源") | (p["v"] != ""),
    )
    docs = parsed.select(
        "seq",
        "captured_at",
        H.document_title(F.col("html"), F.col("__tags"), F.col("reference")).alias("title"),
        F.col("reference").alias("source_url"),
        F.lit("").alias("source_id"),
        F.lit("web").alias("source_type"),
        pairs.alias("metadata"),
        F.col("__main")["markdown"].alias("body_md"),
    )
    return (
        docs.withColumn("ok", F.col("body_md") != "")
        .withColumn("is_thin", is_thin(F.col("body_md")))
        .withColumn("task_key", task_key(F.col("source_url")))
        .withColumn("canonical_key", canonical_key(F.col("source_type"), F.col("source_id"), F.col("source_url")))
        .withColumn("capture_day", capture_day(F.col("captured_at")))
    )


def published_documents(documents: DataFrame) -> DataFrame:
    """Newest capture per title with its path and Markdown.

    The parsed documents become a table first: choosing the newest captures then reads four
    narrow columns of it, and no page is parsed twice.
    """
    latest = publish_latest(materialize(documents, "documents"))
    none = F.lit(0)
    return latest.select(
        "title",
        "source_url",
        "canonical_key",
        "capture_day",
        output_path(F.col("name"), none, none, F.array(F.lit("md"))).alias("path"),
        document_markdown(F.col("title"), F.col("metadata"), F.col("source_url"), F.col("body_md")).alias("markdown"),
    )
