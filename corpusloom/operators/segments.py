"""Transcript segments: reading windows, chapters, rendering, normalisation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.clock import short_time, srt_time
from ..functions.strings import is_blank, strip, text_or_empty
from ..functions.text import hint_count, normalize_text
from ..runtime import materialize
from .ordered import (
    BLOCK_ROWS,
    PART_ROWS,
    as_of,
    block_of,
    local_runs,
    ordered_text,
    part_of,
    run_edges,
    with_neighbour,
    with_row_number,
    with_runs,
)

READING_WINDOW = 300
# Blocks of time of this many seconds split long documents.
SLOT_SECONDS = 900
# Fixed value: title of the chapter put before the first one.
OPENING = "开场"


def usable(segments: DataFrame) -> DataFrame:
    return segments.where(~is_blank(F.col("text")))


def bounds(segments: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """doc_id, total_seconds: the later of the last segment end and the processed time."""
    ends = segments.groupBy("doc_id").agg(F.max("end").alias("last_end"))
    if processed is None:
        return ends.select("doc_id", F.col("last_end").alias("total_seconds"))
    return ends.join(processed, "doc_id", "left").select(
        "doc_id",
        F.greatest("last_end", F.coalesce("processed_seconds", F.lit(0.0))).alias("total_seconds"),
    )


def transcript_text(segments: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, part_no, text: non-blank texts in order, a blank line between them."""
    return (
        usable(segments)
        .groupBy("doc_id", part_of(F.col("seg_no"), F.lit(0), part_rows).alias("part_no"))
        .agg(ordered_text("seg_no", strip(F.col("text")), "\n\n").alias("text"))
    )


def segment_windows(
    segments: DataFrame,
    window_seconds: int = READING_WINDOW,
    processed: DataFrame | None = None,
    *,
    part_rows: int = PART_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fixed reading windows over segments in `seg_no` order.

    A window is a run of segments whose start falls in the same slot; text parts bound its rows.
    Where runs begin is found on narrow rows. Texts are dealt out once, into the blocks of their document, and
    joined there; only the pieces of a part that lies across a block boundary meet again.
    Result: doc_id, first_seg, part_no, window_start, window_end, n_segments, text.
    """
    if window_seconds <= 0:
        raise ValueError("window_seconds must be a positive integer")
    slot = F.floor(F.greatest(F.lit(0.0), F.col("start")) / F.lit(window_seconds)).cast("long")
    live = usable(segments).select("doc_id", "seg_no", "end", strip(F.col("text")).alias("text"), slot.alias("__slot"))
    totals = bounds(live, processed).select(F.col("doc_id").alias("__doc"), F.col("total_seconds").alias("__total"))
    edges = run_edges(live, ["doc_id"], "seg_no", F.col("__slot"), block_rows)
    edges = edges.join(totals, F.col("__key")["doc_id"].eqNullSafe(F.col("__doc"))).drop("__doc")
    rows = local_runs(live, ["doc_id"], "seg_no", F.col("__slot"), block_rows).join(edges, "__key")
    part = part_of(F.col("seg_no"), F.col("first_seg"), part_rows)
    pieces = (
        rows.withColumn("first_seg", F.coalesce("__run", "__carry")).withColumn("part_no", part)
        .groupBy("__key", "first_seg", "part_no").agg(
            F.min("__slot").alias("__slot"), F.max("end").alias("__end"), F.count(F.lit(1)).alias("n_segments"),
            ordered_text("seg_no", F.col("text"), "\n\n").alias("text"), F.max("seg_no").alias("__to"),
            F.min("__total").alias("__total"), F.first(F.when(F.col("__goes_on"), F.coalesce("__last", "__carry"))).alias("__open_run"),
        )
        .withColumn("doc_id", F.col("__key")["doc_id"])
    )
    # A part lies across if its first place is before the block, or if the block's last run goes on and has room in it.
    block = F.col("__key")["__block"]
    begin = F.col("first_seg") + F.col("part_no") * part_rows
    goes_on = F.coalesce(F.col("first_seg") == F.col("__open_run"), F.lit(False))
    across = (begin < block * block_rows) | (goes_on & (begin + part_rows > (block + 1) * block_rows))
    columns = ["doc_id", "first_seg", "part_no", "__slot", "__end", "n_segments", "__total", "text"]
    whole = pieces.where(~across).select(*columns)
    joined = pieces.where(across).groupBy("doc_id", "first_seg", "part_no").agg(
        F.min("__slot").alias("__slot"), F.max("__end").alias("__end"), F.sum("n_segments").alias("n_segments"), F.min("__total").alias("__total"),
        ordered_text("__to", F.col("text"), "\n\n").alias("text"),
    ).select(*columns)
    parts = whole.unionByName(joined)
    start = (F.col("__slot") * window_seconds).cast("double")
    end = F.least("__total", F.greatest(F.least(start + window_seconds, "__total"), "__end"))
    return parts.select(
        "doc_id", "first_seg", "part_no", start.alias("window_start"), end.alias("window_end"), "n_segments", "text"
    )


def render_windows(windows: DataFrame) -> DataFrame:
    """Adds `block_md`: a time heading on the first part, then the text."""
    heading = F.concat(
        F.lit("### "), short_time(F.col("window_start")), F.lit("–"), short_time(F.col("window_end")), F.lit("\n\n")
    )
    return windows.withColumn(
        "block_md", F.concat(F.when(F.col("part_no") == 0, heading).otherwise(""), F.col("text"))
    )


def render_segments(windows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, part_no, markdown: the window blocks of a document in order.

    A part holds the windows of at most `part_rows` segment positions.
    """
    blocks = render_windows(windows)
    at = F.col("first_seg") + F.col("part_no") * part_rows
    pairs = F.sort_array(F.collect_list(F.struct(at.alias("p"), F.col("block_md").alias("t"))))
    return (
        blocks.groupBy("doc_id", part_of(at, F.lit(0), part_rows).alias("md_part"))
        .agg(F.array_join(F.transform(pairs, lambda p: p["t"]), "\n\n").alias("markdown"))
        .withColumnRenamed("md_part", "part_no")
    )


def srt_blocks(segments: DataFrame) -> DataFrame:
    """doc_id, seg_no, srt: one numbered block per segment (the list position numbers it)."""
    return segments.select(
        "doc_id",
        "seg_no",
        F.concat(
            (F.col("seg_no") + 1).cast("string"),
            F.lit("\n"),
            srt_time(F.col("start")),
            F.lit(" --> "),
            srt_time(F.col("end")),
            F.lit("\n"),
            F.col("text"),
            F.lit("\n\n"),
        ).alias("srt"),
    )


def render_srt(segments: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    return (
        srt_blocks(segments)
        .groupBy("doc_id", part_of(F.col("seg_no"), F.lit(0), part_rows).alias("part_no"))
        .agg(ordered_text("seg_no", F.col("srt"), "").alias("srt"))
    )


def chapter_bounds(chapters: DataFrame, totals: DataFrame, opening: str = OPENING) -> DataFrame:
    """doc_id, start, end, title: cleaned chapters with the end of each.

    Blank titles and starts past the end go, the first of equal starts stays, and an
    opening chapter is added when the first one starts after one second.
    """
    clean = (
        chapters.select(
            "doc_id",
            F.col("start").alias("__raw"),
            F.greatest(F.lit(0.0), F.col("start").cast("double")).alias("start"),
            strip(text_or_empty(F.col("title"))).alias("title"),
            F.col("pos"),
        )
        .where(F.col("title") != "")
        .join(totals, "doc_id")
        .where(F.col("start") < F.col("total_seconds"))
    )
    firsts = clean.groupBy("doc_id", "start").agg(
        F.min_by("title", F.struct("__raw", "pos")).alias("title"),
        F.max("total_seconds").alias("total_seconds"),
    )
    opener = (
        firsts.groupBy("doc_id")
        .agg(F.min("start").alias("__first"), F.max("total_seconds").alias("total_seconds"))
        .where(F.col("__first") > 1.0)
        .select("doc_id", F.lit(0.0).alias("start"), F.lit(opening).alias("title"), "total_seconds")
    )
    every = firsts.unionByName(opener)
    slot = F.floor(F.col("start") / F.lit(SLOT_SECONDS)).cast("long")
    nexted = with_neighbour(every, ["doc_id"], "start", slot, F.col("start"), "__next", after=True)
    return nexted.select(
        "doc_id", "start", F.coalesce("__next", "total_seconds").alias("end"), "title"
    )


def segments_in_chapters(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each usable segment with the chapter that holds its midpoint.

    Chapters do not overlap, so the one that holds a place is the last that starts before it: an as-of join in
    blocks of time. A long document is spread over its blocks, and no segment meets more than one chapter.
    """
    middle = (F.col("start") + F.col("end")) / 2
    marks = chapters.select(
        "doc_id", F.col("start").alias("chapter_start"), F.col("end").alias("chapter_end"), F.col("title").alias("chapter_title")
    )
    block = lambda at: F.floor(at / F.lit(SLOT_SECONDS)).cast("long")
    placed = as_of(usable(segments), marks, ["doc_id"], middle, "chapter_start", block, "__chapter")
    inside = placed.where(F.col("__chapter").isNotNull() & (middle < F.col("__chapter")["chapter_end"]))
    return inside.select(*segments.columns, *[F.col("__chapter")[c].alias(c) for c in ("chapter_start", "chapter_end", "chapter_title")])


def render_chapters(
    segments: DataFrame,
    chapters: DataFrame,
    window_seconds: int = READING_WINDOW,
    processed: DataFrame | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """doc_id, block_no, part_no, block_md: one block per chapter text, else per reading window.

    Documents with no chapter text fall back to plain window blocks. `block_no` orders the
    blocks of a document (chapter start in milliseconds, or first segment).
    """
    totals = bounds(segments, processed)
    # A small table that three steps read: written once, so segment ends are scanned once.
    bounded = materialize(chapter_bounds(chapters, totals), "chapters")
    placed = segments_in_chapters(segments, bounded)
    # Windows inside a chapter only set paragraphs apart, as the segments themselves do, so the
    # chapter's segments are joined directly; parts keep very long chapters split.
    heading = F.concat(
        F.lit("### "), short_time(F.col("chapter_start")), F.lit(" "), F.col("chapter_title"), F.lit("\n\n")
    )
    chapter = ["doc_id", "chapter_start"]
    firsts = placed.groupBy(*chapter).agg(F.min("seg_no").alias("first_seg"))
    body = placed.groupBy(
        *chapter, "chapter_title", part_of(F.col("seg_no"), F.lit(0), part_rows).alias("part")
    ).agg(ordered_text("seg_no", strip(F.col("text")), "\n\n").alias("body"))
    numbered = body.join(firsts, chapter).withColumn(
        "part_no", F.col("part") - part_of(F.col("first_seg"), F.lit(0), part_rows)
    )
    chaptered = numbered.select(
        "doc_id",
        F.rint(F.col("chapter_start") * 1000).cast("long").alias("block_no"),
        "part_no",
        F.concat(F.when(F.col("part_no") == 0, heading).otherwise(""), F.col("body")).alias("block_md"),
    )
    has_text = placed.select("doc_id").distinct()
    plain = render_windows(
        segment_windows(segments.join(has_text, "doc_id", "left_anti"), window_seconds, processed, part_rows=part_rows)
    ).select("doc_id", F.col("first_seg").cast("long").alias("block_no"), "part_no", "block_md")
    return chaptered.unionByName(plain)


def normalize_segments(segments: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Clean text per segment; the raw text is kept, count, order and times are untouched.

    `hints` has one row per document (doc_id, terms array, people array); documents without hints keep
    null terms. The join key is the document, whose hint list is capped when it is built.
    """
    filled = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in hints.columns else F.array().cast("array<string>")
    source = segments if hints is None else segments.join(hints.select("doc_id", F.concat(filled("terms"), filled("people")).alias("terms")), "doc_id", "left")
    terms = None if hints is None else F.col("terms")
    raw = F.col("raw_text") if "raw_text" in segments.columns else F.lit("")
    out = source.withColumn("raw_text", F.coalesce(F.nullif(raw, F.lit("")), F.col("text"))).withColumn(
        "text", normalize_text(F.col("text"), terms)
    )
    return out.drop("terms")


def normalization_report(
    normalized: DataFrame, hints: DataFrame | None = None, mode: str = "basic"
) -> DataFrame:
    """Per document: processed and changed segments and hints used."""
    changed = strip(F.col("raw_text")) != strip(F.col("text"))
    report = normalized.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("processed_segments"), F.count_if(changed).alias("changed_segments")
    )
    if hints is None:
        return report.select("doc_id", F.lit(mode).alias("mode"), "processed_segments", "changed_segments", F.lit(0).cast("long").alias("hints_used"))
    used = hints.select(
        "doc_id",
        hint_count(F.col("title"), F.col("context"), F.col("terms"), F.col("people")).cast("long").alias("hints_used"),
    )
    return report.join(used, "doc_id", "left").select(
        "doc_id", F.lit(mode).alias("mode"), "processed_segments", "changed_segments",
        F.coalesce("hints_used", F.lit(0)).alias("hints_used"),
    )


def context_windows(segments: DataFrame, size: int = 8) -> DataFrame:
    """Blocks of `size` consecutive segments with the texts just before and after each.

    Each segment also goes to the blocks next to its own, where only the nearest one counts: the aggregate keeps
    one before and one after already on the map side, so texts travel once, in one exchange.
    """
    size = max(1, size)
    own = F.floor(F.col("seg_no") / F.lit(size)).cast("long")
    side = F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1)))
    rows = segments.select("doc_id", "seg_no", "text", own.alias("__own"), side.alias("__side"))
    at = lambda k: F.when(F.col("__side") == k, F.struct("seg_no", F.col("text").alias("text")))
    blocks = rows.groupBy("doc_id", (F.col("__own") + F.col("__side")).alias("window_no")).agg(
        F.min(F.when(F.col("__side") == 0, F.col("seg_no"))).alias("first_seg"),
        F.max(F.when(F.col("__side") == 0, F.col("seg_no"))).alias("last_seg"),
        F.sort_array(F.collect_list(at(0))).alias("targets"),
        F.max(at(1)).alias("__before"),
        F.min(at(-1)).alias("__after"),
    )
    return blocks.where(F.col("first_seg").isNotNull()).select(
        "doc_id", "window_no", "first_seg", "last_seg", "targets",
        text_or_empty(F.col("__before")["text"]).alias("context_before"), text_or_empty(F.col("__after")["text"]).alias("context_after"),
    )


def with_neighbours(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Previous and next segment text, found by list position.

    The first and last segment of a block are copied into the block next to theirs; then every neighbour is
    local, and texts travel once.
    """
    place = F.pmod(F.col("seg_no"), F.lit(block_rows))
    own = block_of(F.col("seg_no"), block_rows)
    copies = F.array_compact(F.array(own, F.when(place == 0, own - 1), F.when(place == block_rows - 1, own + 1)))
    rows = segments.withColumn("__own", own).withColumn("__block", F.explode(copies))
    order = Window.partitionBy("doc_id", "__block").orderBy("seg_no")
    beside = lambda shift, step: F.when(shift("seg_no").over(order) == F.col("seg_no") + step, shift("text").over(order))
    return (
        rows.withColumn("text_before", text_or_empty(beside(F.lag, -1))).withColumn("text_after", text_or_empty(beside(F.lead, 1)))
        .where(F.col("__block") == F.col("__own")).select(*segments.columns, "text_before", "text_after")
    )


def drop_repeats(cues: DataFrame) -> DataFrame:
    """Cue rows without those that repeat the text just before them (cue_no order)."""
    live = cues.where(text_or_empty(F.col("text")) != "")
    runs = with_runs(live, ["track_id"], "cue_no", F.col("text"), "__first")
    return runs.where(F.col("__first") == F.col("cue_no")).drop("__first")


def chunk_plan(durations: DataFrame, chunk_seconds: int, limit_seconds: int = 0, batch: int = 2) -> DataFrame:
    """Chunks of each media object: index, start, end and the batch each belongs to."""
    if chunk_seconds <= 0 or limit_seconds < 0:
        raise ValueError("chunk length must be positive and the limit not negative")
    total = F.col("duration")
    if limit_seconds:
        total = F.least(total, F.lit(float(limit_seconds)))
    count = F.ceil((total - 0.5) / F.lit(float(chunk_seconds))).cast("long")
    rows = (
        durations.withColumn("__total", total)
        .where(F.col("__total") > 0.5)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    )
    start = (F.col("chunk_no") * chunk_seconds).cast("double")
    return rows.select(
        *[c for c in durations.columns],
        "chunk_no",
        F.round(start, 3).alias("chunk_start"),
        F.round(F.least(start + chunk_seconds, "__total"), 3).alias("chunk_end"),
        block_of(F.col("chunk_no"), max(1, batch)).alias("batch_no"),
    )


def throughput(log: DataFrame, key: str, batch: int = 2) -> DataFrame:
    """Speed, real-time factor and batch count per key from chunk logs (audio_s, inference_s)."""
    sums = log.groupBy(key).agg(
        F.sum("audio_s").alias("audio_s"),
        F.sum("inference_s").alias("inference_s"),
        F.count(F.lit(1)).alias("chunks"),
    )
    zero = F.lit(0.0)
    return sums.select(
        key,
        "audio_s",
        "inference_s",
        "chunks",
        F.when(F.col("inference_s") > 0, F.col("audio_s") / F.col("inference_s")).otherwise(zero).alias("speed"),
        F.when(F.col("audio_s") > 0, F.col("inference_s") / F.col("audio_s")).otherwise(zero).alias("rtf"),
        F.ceil(F.col("chunks") / F.lit(max(1, batch))).cast("long").alias("batches"),
    )


def models_used(log: DataFrame, key: str, order: str, model: str, default: str) -> DataFrame:
    """Distinct models of each key in first-use order; one row per model, numbered."""
    firsts = log.where(text_or_empty(F.col(model)) != "").groupBy(key, model).agg(F.min(order).alias("first_use"))
    numbered = with_row_number(firsts, [key], ["first_use"], block_of(F.col("first_use")), "model_no")
    missing = (
        log.select(key).distinct().join(firsts.select(key).distinct(), key, "left_anti")
        .select(key, F.lit(default).alias(model), F.lit(None).cast("long").alias("first_use"), F.lit(1).cast("long").alias("model_no"))
    )
    return numbered.select(key, model, F.col("first_use").cast("long").alias("first_use"), "model_no").unionByName(missing)
