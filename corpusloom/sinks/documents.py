"""Document sinks: Markdown, text, JSON records and subtitle files as partitioned tables."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import NAMING_OFFSET_SECONDS
from ..functions.html import epoch_text
from ..runtime import spread

RECORD_KEYS = (
    "source_url", "source_id", "source_type", "title", "captured_at", "metadata", "body_md", "attachments",
    "original_title", "original_description",
)


def iso_time(at: Column) -> Column:
    """ISO text of an instant in the naming zone."""
    micros = F.unix_micros(at)
    whole = F.floor(micros / F.lit(1_000_000)).cast("long")
    part = F.pmod(micros, F.lit(1_000_000))
    base = F.replace(epoch_text(whole, NAMING_OFFSET_SECONDS), F.lit(" "), F.lit("T"))
    fraction = F.when(part > 0, F.format_string(".%06d", part)).otherwise("")
    return F.concat(base, fraction, F.lit("+08:00"))


def json_record(documents: DataFrame) -> DataFrame:
    """seq, record: the ten fixed keys (and the transcript if there is one), pairs as lists."""
    pairs = F.transform(F.col("metadata"), lambda p: F.array(p["k"], p["v"]))
    values = {
        **{c: F.col(c) for c in RECORD_KEYS if c in documents.columns},
        "captured_at": iso_time(F.col("captured_at")),
        "metadata": pairs,
    }
    empty = F.array().cast("array<string>")
    fields = [
        F.coalesce(values.get(k, F.lit(None)), empty if k == "attachments" else F.lit("")).alias(k)
        if k not in ("metadata", "captured_at")
        else values[k].alias(k)
        for k in RECORD_KEYS
    ]
    if "transcript" in documents.columns:
        fields.append(F.col("transcript"))
    return documents.select("seq", F.to_json(F.struct(*fields)).alias("record"))


def write_markdown(published: DataFrame, path: str) -> None:
    """Published rows as a table partitioned by capture day, clustered so that small days make few files and
    large ones are split by size."""
    published.hint("rebalance", F.col("capture_day")).write.mode(
        "errorifexists"
    ).partitionBy("capture_day").parquet(path)


def export_files(rows: DataFrame, name: str, text: str, folder: str) -> None:
    """Opt-in: one file per row below a shared folder, written by the executors.

    Each file is written under a task-private name and then moved, so a task that dies or runs
    twice leaves no half file. `folder` may be a path or a URI. Files cost far more than the rows that name them, so
    a small table is dealt out over all cores first.
    """
    target = re.sub("^file:/+", "/", folder)

    def write(batch):
        files = made = None
        for row in batch:
            if files is None:
                files, root = fs.FileSystem.from_uri(target)
            path = f"{root}/{row[name]}"
            parent = path.rsplit("/", 1)[0]
            if parent != made:
                files.create_dir(parent, recursive=True)
                made = parent
            partial = f"{path}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(partial) as stream:
                stream.write(row[text].encode("utf-8"))
            files.move(partial, path)

    spread(rows.select(name, text)).foreachPartition(write)
