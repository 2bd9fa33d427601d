"""Reading windows of subtitle tracks given as cue rows, of any length.

The rule is greedy: a window opens at the first cue, the next one at the first cue that starts a window length
later, and so on. Row by row that is a chain through the whole track. As a table it is a graph with one arrow
per cue, to the first cue a window later; the windows open at the cues that the first one leads to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.cues import DEFAULT_WINDOW
from ..functions.strings import text_or_empty
from ..runtime import cut_lineage
from .ordered import BLOCK_ROWS, PART_ROWS, as_of, block_of, ordered_text, part_of

# Blocks of time hold this many window lengths.
BLOCK_WINDOWS = 64


def _records(cues: DataFrame, group: list[str], order: str, rows: int) -> DataFrame:
    """Cues that start later than every cue before them, by a running maximum carried over blocks.

    Only these can open a window: the first cue a window later starts later than all before it.
    """
    cut = cues.select(*group, order, "start").withColumn("__block", block_of(F.col(order), rows)).withColumn("__key", F.struct(*group, "__block"))
    tops = cut.groupBy(*group, "__block").agg(F.max("start").alias("__top"))
    earlier = F.max("__top").over(W.partitionBy(*group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    carry = tops.select(F.struct(*group, "__block").alias("__key"), earlier.alias("__carry"))
    before = F.max("start").over(W.partitionBy("__key").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    seen = cut.withColumn("__before", before).join(carry, "__key").withColumn("__before", F.greatest("__before", "__carry"))
    return seen.where(F.col("__before").isNull() | (F.col("start") > F.col("__before"))).select(*group, order, "start")


def window_starts(cues: DataFrame, group: list[str], order: str, window_seconds: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, order, start) of the cues at which windows open.

    Arrows come from a range search over the sorted starts, an as-of join with time turned around. What the
    first cue reaches is found by pointer doubling: after k rounds arrows span 2**k windows and everything
    within that distance is marked, so the rounds grow with the logarithm of the longest chain.
    """
    records = cut_lineage(_records(cues, group, order, block_rows))
    span = BLOCK_WINDOWS * window_seconds
    back = records.select(*group, (-F.col("start")).alias("__back"), F.col("start").alias("next"))
    arrows = as_of(
        records.select(*group, "start"), back, group, -(F.col("start") + window_seconds), "__back", lambda at: F.floor(at / F.lit(span)).cast("long"), "__next"
    ).select(*group, "start", F.col("__next")["next"].alias("next"))
    keyed = lambda df, at: df.withColumn("__at", F.struct(*group, at))
    arrows = cut_lineage(arrows.where(F.col("next").isNotNull()))
    reached = records.groupBy(*group).agg(F.min("start").alias("start"))
    while not arrows.isEmpty():
        step = keyed(arrows, "start").select("__at", "next")
        further = keyed(reached, "start").join(step, "__at").select(*group, F.col("next").alias("start"))
        reached = cut_lineage(reached.unionByName(further).distinct())
        hop = step.withColumnRenamed("next", "__to")
        arrows = cut_lineage(keyed(arrows, "next").join(hop, "__at").select(*group, "start", F.col("__to").alias("next")))
    return keyed(records, "start").join(keyed(reached, "start").select("__at"), "__at").select(*group, order, "start")


def cue_windows(
    cues: DataFrame, group: list[str] | None = None, order: str = "cue_no", window_seconds: float = DEFAULT_WINDOW,
    part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(group, first_cue, part_no, start, end, text): the windows of cue rows (group, order, start, end, text).

    `start` and `end` belong to the part; a part holds at most `part_rows` positions of a window.
    """
    if window_seconds <= 0:
        raise ValueError("window_seconds must be positive")
    group = group or ["track_id"]
    starts = window_starts(cues, group, order, float(window_seconds), block_rows)
    marks = starts.select(*group, F.col(order).alias("first_cue"), F.col("start").alias("opened"))
    placed = as_of(cues, marks, group, F.col(order), "first_cue", lambda at: block_of(at, block_rows), "__window")
    first = F.col("__window")["first_cue"]
    return placed.where(F.col("__window").isNotNull()).groupBy(
        *group, first.alias("first_cue"), part_of(F.col(order), first, part_rows).alias("part_no")
    ).agg(
        F.min(F.col("__window")["opened"]).alias("start"), F.max("end").alias("end"), ordered_text(order, text_or_empty(F.col("text")), " ").alias("text")
    )
