"""Python data source `manifests`: one mixed folder of manifest files as one scan.

    spark.dataSource.register(ManifestSource)
    records = spark.read.format("manifests").load(folder)

A partition is a file, and the suffix chooses its reader; what a reader cannot use becomes an error row. Only
records are cut here; sources, names and tags are column expressions (`manifests.record_items`). One task reads
a whole file, so very large text manifests are better read by `manifests.numbered_lines`, which splits them.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, form string, line_number bigint, value string, fields map<string, string>, error string"
FORMS = {"txt": "txt", "jsonl": "json", "json": "json", "csv": "csv"}
_BREAKS = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


class ManifestFile(InputPartition):
    def __init__(self, uri: str, path: str, form: str):
        self.uri, self.path, self.form = uri, path, form


def _open(uri: str):
    local = re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(local)


def text_records(stream) -> Iterator[tuple]:
    """Lines of a text stream, cut at every line end; a line is only held once it is read."""
    number = 0
    for chunk in stream:
        for line in _BREAKS.split(chunk.removesuffix("\n").removesuffix("\r")):
            number += 1
            yield number, line, None, None


def csv_records(stream) -> Iterator[tuple]:
    """Records by the file's own header, counted from 2; quoted fields may hold line ends."""
    rows = csv.reader(stream, strict=True)
    head = [h.strip() for h in next(rows, [])]
    if "source" not in head:
        yield 1, None, None, "no_source_column"
        return
    number = 1
    try:
        for row in rows:
            if row:
                number += 1
                yield number, None, dict(zip(head, row)), None
    except csv.Error as problem:
        yield number + 1, None, None, f"not_csv: {problem}"


class ManifestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ManifestFile]:
        files, root = _open(self.path)
        infos = files.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(i.path for i in infos if i.is_file and not re.search(r"(^|/)[._]", i.path[len(root) :].lstrip("/")))
        suffix = lambda name: name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
        return [ManifestFile(self.path, n, FORMS.get(suffix(n), "")) for n in names] or [ManifestFile(self.path, "", "")]

    def read(self, part: ManifestFile) -> Iterator[tuple]:
        if not part.path:
            return
        if not part.form:
            yield part.path, "", 0, None, None, "not_a_manifest"
            return
        files, _ = _open(part.uri)
        with files.open_input_stream(part.path) as raw:
            reader = codecs.getreader("utf-8-sig")(raw, errors="replace") if part.form != "csv" else io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="")
            for number, value, fields, error in csv_records(reader) if part.form == "csv" else text_records(_whole_lines(reader)):
                yield part.path, part.form, number, value, fields, error


def _whole_lines(reader) -> Iterator[str]:
    """Newline-terminated pieces of a decoded stream, a piece at a time."""
    rest = ""
    while piece := reader.read(1 << 16):
        *lines, rest = (rest + piece).split("\n")
        yield from lines
    if rest:
        yield rest


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options["path"])
