"""File-safe titles and dated output names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .clock import capture_day
from .strings import ANY_SPACE, let, rstrip_only, strip, strip_only

# The byte budget of `<day>__<title>.md` and what the prefix and suffix use.
NAME_BYTES = 150
TITLE_BYTES = NAME_BYTES - len("YYYYMMDD__") - len(".md")
UNTITLED = "untitled"


def _fit_bytes(text: Column, budget: int) -> Column:
    """Longest prefix of whole characters within the byte budget."""
    # Between budget / 4 and budget characters fit, since a character has one to four bytes.
    lengths = F.sequence(F.lit(budget // 4), F.lit(budget))
    fitting = F.filter(lengths, lambda n: F.octet_length(F.left(text, n)) <= budget)
    return F.when(F.octet_length(text) <= budget, text).otherwise(
        F.left(text, F.array_max(fitting))
    )


def safe_title(title: Column, budget: int = TITLE_BYTES) -> Column:
    clean = F.regexp_replace(title, r'[/\\?%*:|"<>\x00-\x1f]', "_")
    clean = strip_only(strip(F.regexp_replace(clean, f"{ANY_SPACE}+", " ")), ".")
    def fit(text: Column) -> Column:
        named = F.when(strip_only(text, "_ ") == "", F.lit(UNTITLED)).otherwise(text)
        return rstrip_only(_fit_bytes(named, budget), " .")

    # The budget bounds the characters that matter; one more keeps the length test honest.
    fitted = let(F.left(clean, F.lit(budget + 1)), fit)
    return F.coalesce(F.nullif(fitted, F.lit("")), F.lit(UNTITLED))


def dated_name(title: Column, captured_at: Column) -> Column:
    day = F.replace(capture_day(captured_at).cast("string"), F.lit("-"), F.lit(""))
    return F.concat(day, F.lit("__"), safe_title(title))


def output_path(name: Column, n_images: Column, n_attachments: Column, formats: Column) -> Column:
    """Flat file for plain text; a folder as soon as other files go with it."""
    extra = F.size(F.filter(formats, lambda f: f != "md")) > 0
    grouped = (F.coalesce(n_images, F.lit(0)) > 0) | (F.coalesce(n_attachments, F.lit(0)) > 0) | extra
    return F.when(grouped, F.concat(name, F.lit("/content.md"))).otherwise(
        F.concat(name, F.lit(".md"))
    )


def output_formats(formats: Column) -> Column:
    """`md` first, the rest once each in the order given."""
    return F.array_distinct(F.concat(F.array(F.lit("md")), formats))


def date_from_name(path: Column) -> Column:
    parts = [F.regexp_extract(path, r"^([0-9]{4})([0-9]{2})([0-9]{2})__", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts))
