"""Manifest scans: pasted text, JSON lines and CSV files into one item table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.refs import clean_tags, extract_references, is_plain_domain, parse_tags
from ..functions.strings import strip, strip_only, text_or_empty
from ..operators.ordered import keep_first, with_row_number

ITEM_COLUMNS = ("file", "line_number", "source", "name", "tags")
# Line ends besides the newline characters the text reader already splits on.
_SOFT_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def numbered_lines(spark: SparkSession, path, suffix: str = "") -> DataFrame:
    """file, line_number (from 1), value of every line of every text file below `path`.

    Files stay splittable: rows are ordered inside a file split, and a table with one row per
    split (how many lines it holds) gives each split its first line number.
    """
    reader = spark.read.option("pathGlobFilter", f"*{suffix}") if suffix else spark.read
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    return _number_lines(raw)


def _number_lines(raw: DataFrame) -> DataFrame:
    lines = raw.select(
        "file", "split", "at", F.posexplode(F.split("value", _SOFT_BREAKS, -1)).alias("sub", "value")
    )
    numbered = with_row_number(lines, ["file"], ["at", "sub"], F.col("split"), "line_number")
    bom = (F.col("line_number") == 1) & F.col("value").startswith("\ufeff")
    return numbered.select(
        "file", "line_number", F.when(bom, F.substring("value", 2, 1 << 30)).otherwise(F.col("value")).alias("value")
    )


def lines_of_parts(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of text parts as one numbered file; the parts' names give their order."""
    raw = spark.read.text(path).select(
        F.lit(path).alias("file"),
        (F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long") * F.lit(1 << 40) + F.col("_metadata.file_block_start")).alias("split"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    return _number_lines(raw)


def _clean_source(value: Column) -> Column:
    return strip_only(strip(text_or_empty(value)), "\"'")


def text_items(lines: DataFrame, local_files: DataFrame | None = None) -> DataFrame:
    """Items of free pasted text: every reference of a line, else a lone domain or known file.

    Comment and blank lines are skipped, and a source counts once per file, at its first line.
    """
    live = lines.withColumn("value", strip(F.col("value"))).where(
        (F.col("value") != "") & ~F.col("value").startswith("#")
    )
    live = live.withColumn("refs", extract_references(F.col("value"))).withColumn(
        "lone", _clean_source(F.col("value"))
    )
    if local_files is None:
        live = live.withColumn("known", F.lit(None).cast("string"))
    else:
        listing = local_files.select(F.col("path").alias("lone"), F.col("path").alias("known")).distinct()
        live = live.join(listing, "lone", "left")
    lone = F.coalesce("known", F.when(is_plain_domain(F.col("lone")), F.col("lone")))
    sources = F.when(F.size("refs") > 0, F.col("refs")).when(lone.isNotNull(), F.array(lone))
    items = live.select("file", "line_number", F.posexplode(sources).alias("pos", "source"))
    firsts = keep_first(items, ["file", "source"], ["line_number", "pos"])
    return firsts.select(
        "file", "line_number", "pos", _clean_source(F.col("source")).alias("source"), F.lit("").alias("name"),
        F.array().cast("array<string>").alias("tags"),
    )


def json_items(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, bad lines) of JSON-lines manifests; bad lines name their file and line."""
    parsed = lines.where(strip(F.col("value")) != "").withColumn("v", F.try_parse_json("value"))
    text = lambda path: text_or_empty(F.try_variant_get("v", path, "string"))
    listed = F.try_variant_get("v", "$.tags", "array<string>")
    good = F.schema_of_variant("v").startswith("OBJECT") & (strip(text("$.source")) != "")
    good = F.coalesce(good, F.lit(False))
    items = parsed.where(good).select(
        "file", "line_number", F.lit(0).alias("pos"),
        _clean_source(text("$.source")).alias("source"),
        strip(text("$.name")).alias("name"),
        F.when(listed.isNotNull(), clean_tags(listed)).otherwise(parse_tags(text("$.tags"))).alias("tags"),
    )
    bad = parsed.where(~good).select(
        "file", "line_number",
        F.when(F.col("v").isNull(), "not_json").otherwise("source_missing").alias("reason"),
    )
    return items, bad


def csv_items(spark: SparkSession, path, suffix: str = ".csv") -> DataFrame:
    """Items of CSV manifests with a `source` column; line_number counts records from 2.

    Each file is read by its own header, whatever the order of its columns; a file without a
    `source` column is an error. Quoted fields may hold newlines, so one file is read by one
    task, as the format demands.
    """
    titles = numbered_lines(spark, path, suffix).where(F.col("line_number") == 1)
    width = titles.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    frame = (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .schema(", ".join(f"c{k} string" for k in range(width)))
        .csv(path, header=False, multiLine=True, escape='"')
    )
    records = frame.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("at"),
        F.array(*[text_or_empty(F.col(f"c{k}")) for k in range(width)]).alias("cells"),
    )
    title = lambda c: strip(F.regexp_replace(c, "^\ufeff", ""))
    heads = records.groupBy("file").agg(
        F.min("at").alias("first"), F.transform(F.min_by("cells", "at"), title).alias("head")
    )
    place = lambda name: F.array_position("head", F.lit(name)).cast("int")
    cell = lambda name: F.when(place(name) > 0, F.get("cells", place(name) - 1)).otherwise("")
    missing = F.raise_error(F.concat(F.lit("a CSV manifest needs a source column: "), F.col("file"))).cast("string")
    rows = records.join(heads, "file").where(F.col("at") > F.col("first"))
    return rows.select(
        "file",
        (F.col("at") - F.col("first") + 1).cast("long").alias("line_number"),
        F.lit(0).alias("pos"),
        F.when(place("source") > 0, strip(cell("source"))).otherwise(missing).alias("source"),
        strip(cell("name")).alias("name"),
        parse_tags(cell("tags")).alias("tags"),
    ).where(F.col("source") != "").withColumn("source", _clean_source(F.col("source")))


def manifest_records(spark: SparkSession, path: str) -> DataFrame:
    """Records (file, form, line_number, value, fields, error) of a mixed folder, in one scan (see `manifest_source`)."""
    from .manifest_source import ManifestSource

    spark.dataSource.register(ManifestSource)
    return spark.read.format("manifests").load(path)


def record_items(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, bad records) of such records; a bad one has its file, line number and reason."""
    lines = lambda form: records.where((F.col("form") == form) & F.col("error").isNull()).select("file", "line_number", "value")
    field = lambda name: text_or_empty(F.col("fields")[name])
    table = records.where((F.col("form") == "csv") & F.col("error").isNull()).select(
        "file", "line_number", F.lit(0).alias("pos"), _clean_source(field("source")).alias("source"), strip(field("name")).alias("name"), parse_tags(field("tags")).alias("tags")
    ).where(F.col("source") != "")
    parsed, refused = json_items(lines("json"))
    items = text_items(lines("txt")).unionByName(parsed).unionByName(table)
    return items, refused.unionByName(records.where(F.col("error").isNotNull()).select("file", "line_number", F.col("error").alias("reason")))


def load_manifests(
    spark: SparkSession, path: str, *, suffixes=("txt", "jsonl", "csv"), strict: bool = True
) -> DataFrame:
    """All manifests below a folder as one item table; the suffix decides the format.

    `strict` turns bad JSON lines into an error that names the line, and files of another
    format and a folder without any item into errors as well.
    """
    unknown = [s for s in suffixes if s not in ("txt", "jsonl", "csv")]
    if unknown:
        raise ValueError(f"manifest formats are txt, jsonl and csv, not {unknown}")
    if strict:
        known = r"\.(?i:" + "|".join({"jsonl": "jsonl|json"}.get(s, s) for s in suffixes) + r")$"
        other = spark.read.format("binaryFile").load(path).select("path").where(~F.col("path").rlike(known)).limit(5).collect()
        if other:
            raise ValueError("not a manifest: " + ", ".join(r["path"] for r in other))
    parts = []
    if "txt" in suffixes:
        parts.append(text_items(numbered_lines(spark, path, ".txt")))
    if "jsonl" in suffixes:
        items, bad = json_items(numbered_lines(spark, path, ".{jsonl,json}"))
        if strict:
            problem = F.concat(F.lit("bad manifest line "), F.col("line_number").cast("string"), F.lit(" in "), F.col("file"))
            bad = bad.select(
                "file", "line_number", F.lit(0).alias("pos"), F.raise_error(problem).cast("string").alias("source"),
                F.lit("").alias("name"), F.array().cast("array<string>").alias("tags"),
            )
            items = items.unionByName(bad)
        parts.append(items)
    if "csv" in suffixes:
        parts.append(csv_items(spark, path))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    if strict and out.isEmpty():
        raise ValueError(f"no items in the manifests below {path}")
    return out
