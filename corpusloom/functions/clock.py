"""Times on a media clock: seconds to text and back, capture days."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the zone used to name captures is eight hours ahead of UTC.
NAMING_OFFSET_SECONDS = 8 * 3600
# Fixed value: cue times need hours, minutes, seconds and three decimals.
CUE_TIME = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})[.,]([0-9]{3})"


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long")


def short_time(seconds: Column) -> Column:
    """`mm:ss`, or `hh:mm:ss` from one hour on; fractions are cut."""
    whole = seconds.cast("double").cast("long")
    hours, rest = _div(whole, 3600), whole % 3600
    minutes, secs = _div(rest, 60), rest % 60
    return F.when(hours != 0, F.format_string("%02d:%02d:%02d", hours, minutes, secs)).otherwise(
        F.format_string("%02d:%02d", minutes, secs)
    )


def srt_time(seconds: Column) -> Column:
    """`HH:MM:SS,mmm`, milliseconds rounded half to even."""
    millis = F.rint(seconds.cast("double") * 1000).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        _div(millis, 3_600_000),
        _div(millis % 3_600_000, 60_000),
        _div(millis % 60_000, 1000),
        millis % 1000,
    )


def cue_seconds(text: Column) -> Column:
    """Seconds of the first cue time in the text, null if there is none."""
    part = [F.regexp_extract(text, CUE_TIME, i).try_cast("long") for i in (1, 2, 3, 4)]
    return (part[0] * 3600 + part[1] * 60 + part[2]).cast("double") + part[3] / F.lit(1000.0)


def mark_seconds(text: Column) -> Column:
    """Seconds of `mm:ss` or `h:mm:ss`."""
    bits = F.split(text, ":")
    nums = F.transform(bits, lambda b: b.try_cast("long"))
    return (
        F.when(F.size(bits) == 2, F.get(nums, F.lit(0)) * 60 + F.get(nums, F.lit(1)))
        .when(
            F.size(bits) == 3,
            F.get(nums, F.lit(0)) * 3600 + F.get(nums, F.lit(1)) * 60 + F.get(nums, F.lit(2)),
        )
        .cast("double")
    )


def human_duration(seconds: Column) -> Column:
    """Hours and minutes, or at least one rounded minute."""
    whole = seconds.cast("long")
    hours, minutes = _div(whole, 3600), _div(whole % 3600, 60)
    long_form = F.when(
        minutes > 0,
        F.concat(hours.cast("string"), F.lit("小时"), minutes.cast("string"), F.lit("分钟")),
    ).otherwise(F.concat(hours.cast("string"), F.lit("小时")))
    rounded = F.greatest(F.lit(1), F.rint(whole / F.lit(60)).cast("long"))
    return F.when(whole >= 3600, long_form).otherwise(
        F.concat(rounded.cast("string"), F.lit("分钟"))
    )


def capture_day(captured_at: Column) -> Column:
    """Calendar day in the naming zone, whatever zone the session uses."""
    micros = F.unix_micros(captured_at) + F.lit(NAMING_OFFSET_SECONDS * 1_000_000)
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)
