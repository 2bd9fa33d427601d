"""Flagship plan: captured pages to published corpus documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.documents import published_documents, web_documents
from .registry import Tables


def captures(t: Tables) -> DataFrame:
    """Pages as captures: the page id orders them, an hour apart from a fixed start."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 3600)
    return t["pages"].select(F.col("page_id").alias("seq"), "url", "html", at.alias("captured_at"))


def corpus_documents(t: Tables) -> DataFrame:
    return published_documents(web_documents(captures(t)))
