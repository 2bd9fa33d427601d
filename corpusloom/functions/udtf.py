"""Table function form of the subtitle parser, for SQL users: exact entity decoding."""

from __future__ import annotations

import html
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_TIME = re.compile(r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})[.,]([0-9]{3})")


def _seconds(text: str):
    m = _TIME.search(text)
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3]) + int(m[4]) / 1000 if m else None


@udtf(returnType="cue_no int, start double, end double, text string")
class ParseSubtitles:
    """`parse_subtitles(text)`: one row per cue of a VTT or SRT text."""

    def eval(self, text: str):
        unix = re.sub(r"\r\n?", "\n", text or "")
        number, last = 0, None
        for block in re.split(r"\n(?:\s*\n)+", unix):
            lines = block.split("\n")
            for at, line in enumerate(lines):
                left, arrow, right = line.partition("-->")
                start, end = (_seconds(left), _seconds(right)) if arrow else (None, None)
                if start is None or end is None:
                    continue
                body = [re.sub(r"<[^>]+>", "", l).strip() for l in lines[at + 1 :]]
                shown = " ".join(html.unescape(l) for l in body if l).strip()
                if shown and shown != last:
                    yield number, start, end, shown
                    number, last = number + 1, shown
                break


def register(spark: SparkSession, name: str = "parse_subtitles") -> None:
    spark.udtf.register(name, ParseSubtitles)
