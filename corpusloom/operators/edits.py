"""Patch edits proposed for segments: validate, drop conflicts, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.payloads import proposed_edits
from ..functions.strings import is_blank

# A replacement may be this long, or this many times the text it replaces.
NEW_FLOOR, NEW_FACTOR = 24, 4


def explode_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per proposed edit: number, id (null unless an integer), old, new, `is_object`.

    Replies without a usable `edits` array yield one row with number 0 and `reply_ok` false,
    so that the window can keep its text and a warning.
    """
    rest = [c for c in replies.columns if c != reply]
    rows = replies.select(*rest, F.posexplode_outer(proposed_edits(F.col(reply))).alias("__i", "__e"), F.col(reply))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("__e", path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get("__e", path, "string"))
    # Only rows without an element need a second look at the reply: it was empty or unusable.
    ok = F.col("__i").isNotNull() | proposed_edits(F.col(reply)).isNotNull()
    return rows.withColumn("reply_ok", ok).where(~F.col("reply_ok") | F.col("__i").isNotNull()).select(
        *rest,
        "reply_ok",
        F.coalesce(F.col("__i") + 1, F.lit(0)).cast("long").alias("number"),
        F.coalesce(F.schema_of_variant("__e").startswith("OBJECT"), F.lit(False)).alias("is_object"),
        F.when(kind("$.id") == "BIGINT", F.try_variant_get("__e", "$.id", "bigint")).alias("id"),
        text("$.old").alias("old"),
        text("$.new").alias("new"),
    )


def _occurrences(source: Column, old: Column) -> Column:
    """Non-overlapping count, as text replacement counts."""
    return F.floor(
        (F.length(source) - F.length(F.replace(source, old, F.lit("")))) / F.length(old)
    ).cast("long")


def validate(edits: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Edits joined to their segment with `reason` (empty when fine) and their span.

    `segments` holds keys, seg_no, text: the targets of each window. Edits that change
    nothing get the reason `same`, which is not a rejection.
    """
    targets = segments.select(*keys, F.col("seg_no").alias("id"), F.col("text").alias("source"))
    joined = edits.where("reply_ok").join(targets, [*keys, "id"], "left")
    old, new, source = F.col("old"), F.col("new"), F.col("source")
    count = _occurrences(source, old)
    reason = (
        F.when(~F.col("is_object"), "not_object")
        .when(F.col("id").isNull(), "id_not_integer")
        .when(source.isNull(), "id_outside_window")
        .when(is_blank(old), "old_blank")
        .when(is_blank(new), "new_blank")
        .when(new.rlike("[\r\n]"), "new_has_newline")
        .when(old == new, "same")
        .when(old == source, "whole_segment")
        .when(count != 1, "not_unique")
        .when(F.length(new) >= F.length(source), "new_as_long_as_segment")
        .when(F.length(new) > F.greatest(F.lit(NEW_FLOOR), F.length(old) * NEW_FACTOR), "new_too_long")
        .otherwise("")
    )
    start = (F.instr(source, old) - 1).cast("long")
    return joined.withColumn("reason", reason).select(
        *keys,
        "number",
        "id",
        "old",
        "new",
        "reason",
        F.when(F.col("reason") == "", start).alias("span_start"),
        F.when(F.col("reason") == "", start + F.length(old)).alias("span_end"),
    )


def mark_overlaps(validated: DataFrame, keys: list[str]) -> DataFrame:
    """Give every edit whose span touches another span of its segment the reason `overlap`.

    No pairs are formed. Spans are first reduced to one row per start position (how many,
    how far they reach), so a segment has at most as many rows as characters; a span then
    conflicts if an earlier start reaches past it, a later start lies inside it, or its
    start is shared.
    """
    seg = [*keys, "id"]
    spans = validated.where(F.col("reason") == "")
    starts = spans.groupBy(*seg, "span_start").agg(
        F.count(F.lit(1)).alias("__n"), F.max("span_end").alias("__reach")
    )
    line = W.partitionBy(*seg).orderBy("span_start")
    starts = starts.withColumn(
        "__before", F.max("__reach").over(line.rowsBetween(W.unboundedPreceding, -1))
    ).withColumn("__next", F.lead("span_start").over(line))
    # Left join keeps rejected edits, whose null span finds no partner.
    marked = validated.join(starts.drop("__reach"), [*seg, "span_start"], "left")
    clash = (
        (F.col("__n") > 1)
        | (F.coalesce("__before", F.lit(-1)) > F.col("span_start"))
        | (F.coalesce(F.col("__next") < F.col("span_end"), F.lit(False)))
    )
    return marked.withColumn(
        "reason", F.when((F.col("reason") == "") & clash, "overlap").otherwise(F.col("reason"))
    ).select(*validated.columns)


def apply_edits(segments: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with `new_text`: accepted edits of a segment applied from right to left.

    Accepted spans of a segment never overlap, so the list per segment is bounded by its text.
    """
    accepted = (
        checked.where(F.col("reason") == "")
        .groupBy(*keys, F.col("id").alias("seg_no"))
        .agg(
            F.sort_array(
                F.collect_list(F.struct("span_start", "span_end", "new")), asc=False
            ).alias("__edits")
        )
    )
    joined = segments.join(accepted, [*keys, "seg_no"], "left")
    patched = F.aggregate(
        F.coalesce("__edits", F.array().cast("array<struct<span_start:bigint,span_end:bigint,new:string>>")),
        F.col("text"),
        lambda text, e: F.concat(
            F.left(text, e["span_start"].cast("int")),
            e["new"],
            F.substring(text, (e["span_end"] + 1).cast("int"), F.length(text)),
        ),
    )
    return joined.withColumn("new_text", patched).drop("__edits")


def warnings(checked: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Rejected edits and unusable replies, one row each."""
    rejected = checked.where(~F.col("reason").isin("", "same")).select(*keys, "number", "reason")
    unusable = replies.where(~F.col("reply_ok")).select(
        *keys, F.lit(0).cast("long").alias("number"), F.lit("unusable_reply").alias("reason")
    )
    return rejected.unionByName(unusable)
