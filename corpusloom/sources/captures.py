"""Scans of captured artefacts: pages, subtitles, corpus files, index and status files."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.refs import product_key
from ..functions.strings import strip, text_or_empty
from ..functions.verdicts import READ_NO
from ..operators.source_index import INDEX_COLUMNS, INDEX_TITLE
from .manifests import numbered_lines

INDEX_FILE = "sources.md"


def pages(spark: SparkSession, path, columns=("page_id", "url", "html")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def subtitle_files(spark: SparkSession, path) -> DataFrame:
    """video_id, text: the newest subtitle file of each video folder (last change, then name)."""
    files = spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.{srt,vtt,SRT,VTT}"
    ).text(path, wholetext=True)
    tagged = files.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("video_id"),
        F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("age"),
        F.regexp_replace("value", "^\ufeff", "").alias("text"),
    )
    return tagged.groupBy("video_id").agg(F.max_by("text", "age").alias("text"))


# A task holds at most so many names, or texts of about so many bytes, at a time.
_NAMES, _TEXT_BYTES = 10_000, 1 << 20


def _local_folder(spark: SparkSession, path: str) -> bytes | None:
    """The path in the file system of the machines; None if it lies in another store."""
    if path.startswith("file:"):
        return os.fsencode(re.sub("^file:/+", "/", path))
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return os.fsencode(os.path.abspath(path)) if "://" not in path and default.startswith("file:") else None


def _shown(name: bytes) -> bool:
    """Names that Spark's file sources read."""
    return not name.startswith(b".") and (not name.startswith(b"_") or b"=" in name)


def _local_corpus(spark: SparkSession, root: bytes) -> DataFrame:
    """source, markdown of a folder: its names go to all cores and are opened there, so that the driver holds none.

    One task goes through the names without keeping them. Empty files are left out, as Spark's file sources do.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with os.scandir(root) as entries:
                shown = ((e.name, e.is_dir()) for e in entries if _shown(e.name))
                found = (f for f in shown if f[1] or f[0].endswith(b".md"))
                while part := list(itertools.islice(found, _NAMES)):
                    yield pa.RecordBatch.from_pydict({"name": [n for n, _ in part], "folder": [d for _, d in part]})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, found, size = [], [], 0
            for name, folder in zip(*(c.to_pylist() for c in batch.columns)):
                source = name + b"/content.md" if folder else name
                try:
                    with open(os.path.join(root, source), "rb") as file:
                        text = file.read()
                except (FileNotFoundError, IsADirectoryError):
                    if folder:
                        continue
                    raise
                if text:
                    sources.append(source)
                    found.append(text)
                    size += len(text)
                if size >= _TEXT_BYTES:
                    yield pa.RecordBatch.from_pydict({"source": sources, "markdown": found})
                    sources, found, size = [], [], 0
            if sources:
                yield pa.RecordBatch.from_pydict({"source": sources, "markdown": found})

    listed = spark.range(0, 1, 1, 1).mapInArrow(names, "name binary, folder boolean")
    dealt = listed.repartition(4 * spark.sparkContext.defaultParallelism, "name")
    read = dealt.mapInArrow(texts, "source binary, markdown binary")
    return read.select(F.col("source").cast("string"), F.col("markdown").cast("string"))


def corpus_files(spark: SparkSession, path: str) -> DataFrame:
    """source, title, markdown of a corpus folder: top-level `.md` files and `<dir>/content.md`.

    A folder in another store than the machines' file system is listed by Spark's file source, on the driver.
    """
    local = _local_folder(spark, path)
    if local is not None:
        listed = _local_corpus(spark, local)
    else:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
        full = F.try_url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
        root = path.rstrip("/").split("://")[-1]
        inner = F.regexp_replace(full, rf"^.*\Q{root}\E/", "")
        listed = files.select(inner.alias("source"), F.col("value").alias("markdown"))
    flat = ~F.contains(F.col("source"), F.lit("/")) & (F.col("source") != INDEX_FILE)
    folder = F.col("source").rlike(r"^[^/]+/content\.md$")
    return listed.where(flat | folder).select(
        "source", F.regexp_extract("markdown", r"^# (.*)", 1).alias("title"), "markdown"
    )


def index_cells(line):
    """Cells of one pipe-table line, split at pipes that are not escaped."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: strip(c))


def parse_index(lines: DataFrame) -> DataFrame:
    """row_no, link, extractor, product, day, read of the index table in numbered lines.

    The table starts at the header line and ends at the first line that is no table row; rows
    with four cells are old ones and count as unread.
    """
    table = lines.select(
        "file", "line_number", strip(F.col("value")).alias("value"), index_cells(F.col("value")).alias("cells")
    )
    header = F.array(*[F.lit(c) for c in INDEX_COLUMNS])
    is_header = F.col("value").startswith("|") & (
        (F.col("cells") == header) | (F.col("cells") == F.slice(header, 1, len(INDEX_COLUMNS) - 1))
    )
    filled = F.filter("cells", lambda c: c != "")
    ruler = F.col("value").startswith("|") & (F.size(filled) > 0) & F.forall(filled, lambda c: c.rlike(r"^:?-{2,}:?$"))
    heads = table.where(is_header).groupBy("file").agg(F.min("line_number").alias("head"))
    after = table.join(heads, "file").where(F.col("line_number") > F.col("head"))
    # One row per file: the first line past the table.
    ends = after.groupBy("file").agg(
        F.min(F.when(~F.col("value").startswith("|"), F.col("line_number"))).alias("end")
    )
    rows = after.join(ends, "file").where(
        (F.col("end").isNull() | (F.col("line_number") < F.col("end"))) & ~ruler & (F.size("cells") >= 4)
    )
    at = lambda i: F.get("cells", F.lit(i))
    return rows.select(
        "file",
        (F.col("line_number") - F.col("head") - 2).cast("long").alias("row_no"),
        at(0).alias("link"),
        at(1).alias("extractor"),
        product_key(at(2)).alias("product"),
        at(3).alias("day"),
        F.coalesce(at(4), F.lit(READ_NO)).alias("read"),
    )


def titled(lines: DataFrame, title: str = INDEX_TITLE) -> DataFrame:
    """The numbered lines of index files; one whose first line with text is not the title is an error."""
    first = lines.where(strip(F.col("value")) != "").groupBy("file").agg(F.min_by(strip(F.col("value")), "line_number").alias("__title"))
    foreign = F.raise_error(F.concat(F.lit("not an index file: "), F.col("file"))).cast("string")
    kept = lines.join(first, "file")
    return kept.withColumn("value", F.when(F.col("__title") == title, F.col("value")).otherwise(foreign)).drop("__title")


def sections(lines: DataFrame) -> DataFrame:
    """Numbered lines with `place`: -1 before the index table, 0 in it, 1 after it; without a table all come before it."""
    rows = lines.select("file", "line_number", "value", strip(F.col("value")).alias("v"), index_cells(F.col("value")).alias("cells"))
    header = F.array(*[F.lit(c) for c in INDEX_COLUMNS])
    is_header = F.col("v").startswith("|") & ((F.col("cells") == header) | (F.col("cells") == F.slice(header, 1, len(INDEX_COLUMNS) - 1)))
    heads = rows.groupBy("file").agg(F.min(F.when(is_header, F.col("line_number"))).alias("head"))
    placed = rows.join(heads, "file")
    ends = placed.groupBy("file").agg(
        F.min(F.when((F.col("line_number") > F.col("head")) & ~F.col("v").startswith("|"), F.col("line_number"))).alias("end")
    )
    place = F.when(F.col("head").isNull() | (F.col("line_number") < F.col("head")), -1).when(F.col("line_number") >= F.col("end"), 1).otherwise(0)
    return placed.join(ends, "file").select("file", "line_number", "value", place.alias("place"), (F.col("line_number") - F.col("head") - 2).alias("row_no"), "cells")


def lines_around_index(lines: DataFrame, title: str = INDEX_TITLE) -> DataFrame:
    """(file, line_number, value) of the hand-written lines before and after the table."""
    return sections(lines).where((F.col("place") != 0) & (strip(F.col("value")) != title)).select("file", "line_number", "value")


def source_index(spark: SparkSession, path) -> DataFrame:
    return parse_index(titled(numbered_lines(spark, path, ".md")))


STATUS_SCHEMA = (
    "entries array<struct<source:string, method:string, refinement:string, deep_read:string, learning:string>>"
)


def status_entries(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """Archive entries of status manifests; blank or repeated sources are an error when strict."""
    rows = spark.read.schema(STATUS_SCHEMA).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    if not strict:
        return rows
    unique = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("method", "refinement", "deep_read", "learning")).alias("e")
    )
    bad = (F.col("n") > 1) | (text_or_empty(F.col("source")) == "")
    problem = F.concat(F.lit("duplicate or invalid source: "), text_or_empty(F.col("source")))
    return unique.select(
        F.when(bad, F.raise_error(problem).cast("string")).otherwise(F.col("source")).alias("source"), "e.*"
    )


def file_listing(spark: SparkSession, path) -> DataFrame:
    """path, size, modified_us of every file below a folder, without reading contents."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us"))
    )
