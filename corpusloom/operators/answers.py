"""Question snapshots over capture rounds: merge, completeness, numbering, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.strings import text_or_empty
from .ordered import BLOCK_ROWS, PART_ROWS, ordered_text, part_of, with_row_number

# Fixed value: this many rounds without a new answer end a capture.
STABLE_ROUNDS = 5


def merge_questions(snapshots: DataFrame) -> DataFrame:
    """First non-empty title, detail and expected count over the rounds."""
    first_text = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("round")))
    return snapshots.groupBy("question_id").agg(
        text_or_empty(first_text("title")).alias("title"),
        text_or_empty(first_text("detail_md")).alias("detail_md"),
        F.min_by("expected", F.when(F.col("expected").isNotNull(), F.col("round"))).alias("expected"),
    )


def first_seen(answers: DataFrame) -> DataFrame:
    """Each answer once, as first seen: order (round, pos)."""
    rest = [c for c in answers.columns if c not in ("question_id", "answer_id")]
    order = F.struct("round", "pos")
    picked = answers.groupBy("question_id", "answer_id").agg(
        F.min_by(F.struct(*rest), order).alias("__a")
    )
    return picked.select("question_id", "answer_id", *[F.col("__a")[c].alias(c) for c in rest])


def completeness(snapshots: DataFrame, answers: DataFrame, max_answers: int = 0, max_rounds: int | None = None) -> DataFrame:
    """Per question: the round that ends the capture, why, and the answers found by then."""
    new = first_seen(answers).groupBy("question_id", "round").agg(F.count(F.lit(1)).alias("fresh"))
    rounds = (
        (snapshots if max_rounds is None else snapshots.where(F.col("round") < max_rounds))
        .join(new, ["question_id", "round"], "left")
        .select("question_id", "round", "expected", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    )
    line = W.partitionBy("question_id").orderBy("round").rowsBetween(W.unboundedPreceding, W.currentRow)
    grown = F.max(F.when((F.col("fresh") > 0) | (F.col("round") == 0), F.col("round"))).over(line)
    scored = rounds.withColumn("found", F.sum("fresh").over(line)).withColumn(
        "stable", F.col("round") - grown
    )
    why = F.when(F.lit(max_answers > 0) & (F.col("found") >= max_answers), "max_answers")
    why = why.when(F.col("expected").isNotNull() & (F.col("found") >= F.col("expected")), "expected")
    why = why.when(F.col("stable") >= STABLE_ROUNDS, "stable")
    scored = scored.withColumn("why", why)
    end = F.min(F.when(F.col("why").isNotNull(), F.struct("round", "why", "found")))
    last = F.max(F.struct("round", F.lit("exhausted").alias("why"), "found"))
    return scored.groupBy("question_id").agg(F.coalesce(end, last).alias("__e")).select(
        "question_id",
        F.col("__e")["round"].alias("last_round"),
        F.col("__e")["why"].alias("stop_reason"),
        F.col("__e")["found"].alias("answers_found"),
    )


def number_answers(answers: DataFrame, max_answers: int = 0) -> DataFrame:
    """Answers with `answer_no` in discovery order; `max_answers` > 0 keeps the first ones."""
    block = F.col("round").cast("long") * F.lit(1 << 24) + F.floor(F.col("pos") / F.lit(BLOCK_ROWS)).cast("long")
    numbered = with_row_number(first_seen(answers), ["question_id"], ["round", "pos"], block, "answer_no")
    return numbered.where(F.col("answer_no") <= max_answers) if max_answers else numbered


def top_answers(answers: DataFrame, max_answers: int) -> DataFrame:
    """First answers of each question; the rank limit is applied before the shuffle as well."""
    if not max_answers:
        return number_answers(answers)
    rank = F.row_number().over(W.partitionBy("question_id").orderBy("round", "pos"))
    return first_seen(answers).withColumn("answer_no", rank).where(F.col("answer_no") <= max_answers)


def render_questions(questions: DataFrame, numbered: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """question_id, part_no, body_md: detail, then numbered answers with a meta line each."""
    meta = F.concat_ws(
        " · ",
        F.nullif(F.col("time_text"), F.lit("")),
        F.nullif(F.col("vote_text"), F.lit("")),
        F.when(F.col("url") != "", F.concat(F.lit("原回答："), F.col("url"))),
    )
    block = F.concat(
        F.lit("### 回答 "), F.col("answer_no").cast("string"), F.lit("｜"), F.col("author"),
        F.when(meta != "", F.concat(F.lit("\n> "), meta)).otherwise(""),
        F.lit("\n\n"), F.col("body_md"), F.lit("\n\n---\n"),
    )
    parts = (
        numbered.withColumn("__block", block)
        .groupBy("question_id", part_of(F.col("answer_no"), F.lit(1), part_rows).alias("part_no"))
        .agg(ordered_text("answer_no", F.col("__block"), "\n").alias("__body"))
    )
    head = F.concat(
        F.when(F.col("detail_md") != "", F.concat(F.lit("## 问题描述\n\n"), F.col("detail_md"), F.lit("\n\n"))).otherwise(""),
        F.lit("## 回答\n\n"),
    )
    tail = F.regexp_replace(F.col("__body"), r"[-\n ]+\z", "\n")
    return parts.join(questions, "question_id").select(
        "question_id",
        "part_no",
        F.concat(F.when(F.col("part_no") == 0, head).otherwise(""), tail).alias("body_md"),
    )
