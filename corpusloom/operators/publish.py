"""Publish captures: newest per full title, dated names, collisions, replaced paths.

Everything follows from one narrow table of (name, title) pairs with first, last and number of captures. The
tables of two sets of captures add up by `summed_days`, so what is published after several batches does not
depend on how captures were dealt into them (see `sinks.published`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.naming import dated_name


def title_days(captures: DataFrame) -> DataFrame:
    """One row per (output name, full title): its first and last successful capture.

    Everything after this works on the reduced table, so a title that was captured a billion
    times costs one row per map task.
    """
    order = F.struct("captured_at", "seq")
    return (
        captures.where("ok")
        .withColumn("name", dated_name(F.col("title"), F.col("captured_at")))
        .groupBy("name", "title")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("captures"))
    )


def summed_days(days: DataFrame) -> DataFrame:
    """One row per (name, title) of several such tables put together."""
    return days.groupBy("name", "title").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("captures").alias("captures"))


def with_owner(days: DataFrame) -> DataFrame:
    """Adds `owner`: the title that took the name first; other titles there collide."""
    owners = days.groupBy("name").agg(F.min_by("title", F.struct("first", "title")).alias("owner"))
    return days.join(owners, "name")


def refused(days: DataFrame) -> DataFrame:
    """Titles refused because another title already holds their truncated, dated name."""
    return with_owner(days).where(F.col("title") != F.col("owner")).select("name", "title", "owner", "captures")


def accepted(days: DataFrame) -> DataFrame:
    return with_owner(days).where(F.col("title") == F.col("owner"))


def newest(pairs: DataFrame) -> DataFrame:
    """title, name, captured_at, seq of the newest accepted capture of every title."""
    top = F.col("__top")
    return pairs.groupBy("title").agg(F.max(F.struct("last", "name")).alias("__top")).select(
        "title",
        top["name"].alias("name"),
        top["last"]["captured_at"].alias("captured_at"),
        top["last"]["seq"].alias("seq"),
    )


def collisions(captures: DataFrame) -> DataFrame:
    return refused(title_days(captures))


def current(captures: DataFrame) -> DataFrame:
    return newest(accepted(title_days(captures)))


def publish_latest(captures: DataFrame) -> DataFrame:
    """The capture rows that stay published, with their output name; `seq` names a capture."""
    return captures.join(current(captures).select("seq", "name"), "seq")


def replaced_paths(captures: DataFrame) -> DataFrame:
    """old_name -> new_name for earlier dates of a title that a newer capture replaced.

    The newest name of a title comes with every accepted pair of it, so pairs are built and owned once.
    """
    pairs = accepted(title_days(captures)).select("title", "name", "last")
    names = pairs.groupBy("title").agg(F.collect_set("name").alias("names"), F.max(F.struct("last", "name")).alias("__top"))
    return (
        names.select("title", F.explode("names").alias("old_name"), F.col("__top")["name"].alias("new_name"))
        .where(F.col("old_name") != F.col("new_name"))
    )
