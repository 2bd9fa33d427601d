"""Choices among captured media: candidates, tracks, fallback captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.cues import CHAT_OVERLAY, LANGUAGES
from ..functions.verdicts import short_video_check


def pick_media(candidates: DataFrame, key: str) -> DataFrame:
    """First acceptable candidate per item, else the last three reasons.

    `candidates`: key, pos, url, has_audio, actual, expected. The choice is an aggregate; the
    reasons use a rank limit, which Spark applies before the shuffle.
    """
    checked = candidates.withColumn(
        "check", short_video_check(F.col("has_audio"), F.col("actual"), F.col("expected"))
    )
    ok = F.col("check")["verdict"] == "ok"
    chosen = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min_by("url", F.when(ok, F.col("pos"))).alias("media_url"),
        F.min(F.when(ok, F.col("pos"))).alias("chosen_pos"),
    )
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc("pos")))
    bad = checked.where(~ok).withColumn("__back", back).where(F.col("__back") <= 3)
    reasons = bad.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", F.col("check")["reason"].alias("r")))), lambda x: x["r"]
            ),
            "；",
        ).alias("__why")
    )
    return chosen.join(reasons, key, "left").select(
        key,
        "candidates",
        F.coalesce("media_url", F.lit("")).alias("media_url"),
        F.coalesce("chosen_pos", F.lit(-1)).alias("chosen_pos"),
        F.when(F.col("chosen_pos").isNull(), F.col("__why")).otherwise("").alias("last_errors"),
    )


def pick_subtitle(tracks: DataFrame, key: str) -> DataFrame:
    """Best track per video: manual before automatic, then language preference, then position.

    As in a player's own choice the kind is settled first; languages compete inside it:
    exact preference, preference ignoring case, else the first listed.
    """
    def rank(language: Column, exact: bool) -> Column:
        out = None
        for i, name in enumerate(LANGUAGES):
            hit = (language == name) if exact else (F.lower(language) == name.lower())
            out = F.when(hit, i) if out is None else out.when(hit, i)
        return out

    exact, loose = rank(F.col("language"), True), rank(F.col("language"), False)
    size = len(LANGUAGES)
    # A later track wins among case variants of one language, as in a lower-case lookup table.
    score = F.struct(
        F.when(F.col("kind") == "manual", 0).otherwise(1).alias("kind_rank"),
        F.coalesce(exact, loose + size, F.lit(2 * size)).alias("language_rank"),
        F.when(exact.isNull() & loose.isNotNull(), -F.col("pos")).otherwise(F.col("pos")).alias("p"),
    )
    shown = tracks.where(~((F.col("kind") == "manual") & (F.lower("language") == CHAT_OVERLAY)))
    rest = [c for c in tracks.columns if c != key]
    best = shown.groupBy(key).agg(F.min_by(F.struct(*rest), score).alias("__t"))
    return best.select(key, *[F.col("__t")[c].alias(c) for c in rest])


def prefer(primary: DataFrame, secondary: DataFrame, key: str, columns: list[str], usable: Column) -> DataFrame:
    """Primary values where `usable` holds on the primary row, else those of the secondary.

    `usable` is evaluated on the primary table; keys are unique on both sides.
    """
    left = primary.select(key, usable.alias("__ok"), *[F.col(c).alias(f"__1_{c}") for c in columns])
    right = secondary.select(key, F.lit(True).alias("__has"), *[F.col(c).alias(f"__2_{c}") for c in columns])
    joined = left.join(right, key, "left")
    return joined.select(
        key,
        F.when(F.col("__ok"), "primary").when(F.col("__has"), "fallback").otherwise("none").alias("origin"),
        *[F.when(F.col("__ok"), F.col(f"__1_{c}")).otherwise(F.col(f"__2_{c}")).alias(c) for c in columns],
    )
