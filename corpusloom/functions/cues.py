"""Subtitle text to cue arrays and reading windows, one track per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .clock import CUE_TIME, cue_seconds
from .strings import ANY_SPACE, decode_entities, let, strip, text_or_empty

# Language preference, the chat overlay that is not a subtitle, inline formats.
LANGUAGES = ("zh-Hans", "zh-CN", "zh", "zh-TW", "zh-Hant", "en", "en-US", "en-GB")
CHAT_OVERLAY = "danmaku"
INLINE_FORMATS = ("srt", "vtt")
DEFAULT_WINDOW = 300

_NOT_ARROW = r"(?:(?!-->).)*?"
_TIME_LINE = rf"^{_NOT_ARROW}{CUE_TIME}{_NOT_ARROW}-->.*?{CUE_TIME}"


def parse_cues(text: Column) -> Column:
    """Ordered array of struct(start, end, text); a repeat of the cue before it is dropped.

    Blank lines separate blocks; in each block the first line with two valid times opens
    the cue and the lines after it are its text.
    """
    unix = F.regexp_replace(text_or_empty(text), "\r\n?", "\n")
    blocks = F.split(unix, rf"\n(?:{ANY_SPACE}*\n)+", -1)

    def cue(lines: Column, at: Column) -> Column:
        head = F.get(lines, at)
        payload = F.filter(
            F.transform(
                F.slice(lines, at + 2, F.size(lines)),
                lambda l: strip(F.regexp_replace(l, "<[^>]+>", "")),
            ),
            lambda l: l != "",
        )
        return F.when(
            at.isNotNull(),
            F.struct(
                cue_seconds(F.regexp_extract(head, "^(.*?)-->", 1)).alias("start"),
                cue_seconds(F.regexp_extract(head, "-->(.*)$", 1)).alias("end"),
                strip(F.array_join(F.transform(payload, decode_entities), " ")).alias("text"),
            ),
        )

    def first_timed(lines: Column) -> Column:
        return F.array_min(F.transform(lines, lambda l, i: F.when(l.rlike(_TIME_LINE), i)))

    def of_block(block: Column) -> Column:
        return let(
            F.split(block, "\n", -1), lambda lines: let(first_timed(lines), lambda at: cue(lines, at))
        )

    timed = F.filter(blocks, lambda b: F.contains(b, F.lit("-->")))
    cues = F.filter(F.transform(timed, of_block), lambda c: c.isNotNull() & (c["text"] != ""))
    return drop_repeats(cues)


def drop_repeats(cues: Column) -> Column:
    """Keep a cue only if its text differs from the cue kept before it."""
    return let(
        cues,
        lambda cs: F.filter(
            cs, lambda c, i: (i == 0) | ~c["text"].eqNullSafe(F.get(cs, i - 1)["text"])
        ),
    )


def cues_before(cues: Column, limit_seconds: Column) -> Column:
    """Cues that start before the limit; no limit when it is 0 or null."""
    open_ended = F.coalesce(limit_seconds, F.lit(0)) == 0
    return F.filter(cues, lambda c: open_ended | (c["start"] < limit_seconds))


def reading_windows(cues: Column, window_seconds: int = DEFAULT_WINDOW) -> Column:
    """Fold a cue array into struct(start, end, text) windows.

    A window opens at its first cue and closes at the first cue that starts a full window length later. The
    fold only collects where windows open, so the work follows the number of cues; texts are cut out afterwards.
    Tracks too long for one row go through `operators.tracks.cue_windows`.
    """
    none = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("open"))

    def step(acc: Column, c: Column) -> Column:
        opens = acc["open"].isNull() | (c["start"] >= acc["open"] + F.lit(float(window_seconds)))
        return F.struct(
            F.when(opens, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, c["start"]).otherwise(acc["open"]).alias("open"),
        )

    def window(cs: Column, first: Column, after: Column) -> Column:
        return let(
            F.slice(cs, first + 1, after - first),
            lambda own: F.struct(
                F.get(own, F.lit(0))["start"].alias("start"),
                F.array_max(F.transform(own, lambda c: c["end"])).alias("end"),
                F.array_join(F.transform(own, lambda c: c["text"]), " ").alias("text"),
            ),
        )

    def windows(cs: Column) -> Column:
        cuts = F.aggregate(cs, none, step, lambda acc: acc["cuts"])
        return let(cuts, lambda at: F.transform(at, lambda first, k: window(cs, first, F.coalesce(F.get(at, k + 1), F.size(cs)))))

    return let(cues, windows)


def processed_seconds(windows: Column, limit_seconds: Column) -> Column:
    last = F.get(windows, F.size(windows) - 1)["end"]
    limit = F.coalesce(limit_seconds, F.lit(0)).cast("double")
    return F.when(limit > 0, F.least(last, limit)).otherwise(last)


def pick_language(languages: Column) -> Column:
    """Best listed language: by preference exactly, then ignoring case, then the first."""
    order = F.array(*[F.lit(l) for l in LANGUAGES])
    exact = F.get(F.filter(order, lambda p: F.array_contains(languages, p)), F.lit(0))
    loose = F.get(
        F.filter(
            F.transform(
                order,
                lambda p: F.get(
                    F.filter(F.reverse(languages), lambda l: F.lower(l) == F.lower(p)), F.lit(0)
                ),
            ),
            lambda l: l.isNotNull(),
        ),
        F.lit(0),
    )
    return F.coalesce(exact, loose, F.get(languages, F.lit(0)))


def pick_inline(formats: Column) -> Column:
    """Cues of the last listed inline format that yields any; null when none does."""
    parsed = F.transform(
        F.filter(
            F.reverse(formats),
            lambda f: F.lower(text_or_empty(f["ext"])).isin(*INLINE_FORMATS) & f["data"].isNotNull(),
        ),
        lambda f: parse_cues(f["data"]),
    )
    return F.get(F.filter(parsed, lambda c: F.size(c) > 0), F.lit(0))
