"""The source index as a text file that is read, merged and written as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.source_index import INDEX_HEADER, INDEX_SEPARATOR, INDEX_TITLE, index_lines, upsert
from ..sources.captures import parse_index, sections, titled
from ..sources.manifests import lines_of_parts
from .snapshots import SnapshotTable


class IndexConflict(RuntimeError):
    """Someone else has written the index since it was read."""


class IndexFile:
    """Folder with a version `v=<n>` per write; a version is an ordered text file in parts.

    `merge` reads the newest version, puts rows in, and writes the next one with every hand-written line where it
    was. A file that is no index is refused. The caller may name the version it has seen: a newer one is a
    conflict, as is a next version that appears while this one is being made.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = SnapshotTable(spark, path)

    def version(self) -> int:
        """The newest complete version, -1 if there is none."""
        return max(self._versions.versions(), default=-1)

    def lines(self, version: int | None = None) -> DataFrame:
        """Numbered lines (file, line_number, value) of a version."""
        return lines_of_parts(self.spark, f"{self.path}/v={self.version() if version is None else version}")

    def rows(self) -> DataFrame:
        """Index rows of the newest version; an error if it is no index."""
        return parse_index(titled(self.lines()))

    def write(self, lines: DataFrame, order: list[str | Column], version: int) -> None:
        """Lines (column `value`) in order, as version number `version`."""
        if self.version() >= version:
            raise IndexConflict(f"{self.path} is at version {self.version()} already")
        lines.orderBy(*order).select("value").write.mode("errorifexists").text(f"{self.path}/v={version}")

    def merge(self, incoming: DataFrame, expected: int | None = None) -> int:
        """Put incoming rows (see `upsert`) in, in order of `seq`; gives the number of the version written."""
        seen = self.version()
        if expected is not None and expected != seen:
            raise IndexConflict(f"{self.path} is at version {seen}, not {expected}")
        schema = "row_no bigint, link string, extractor string, product string, day string, read string"
        line = lambda at, text: (at, 0, 0, text)
        table = [line(1, INDEX_HEADER), line(2, INDEX_SEPARATOR)]
        if seen < 0:
            old = self.spark.createDataFrame([], schema)
            fixed = [line(0, INDEX_TITLE), (0, 0, 1, ""), *table]
            kept = None
        else:
            lines = titled(self.lines(seen))
            placed = sections(lines)
            old = parse_index(lines).drop("file")
            # Lines of the table that are no rows of it keep their places too; rulers are written anew.
            ruler = F.forall(F.filter("cells", lambda c: c != ""), lambda c: c.rlike(r"^:?-{2,}:?$"))
            stray = (F.col("place") == 0) & (F.col("row_no") > -2) & (F.size("cells") < 4) & ~ruler
            kept = placed.where((F.col("place") != 0) | stray).select(
                F.when(F.col("place") == -1, 0).when(F.col("place") == 1, 4).otherwise(3).alias("part"), F.lit(0).alias("kind"),
                F.when(F.col("place") == 0, F.col("row_no")).otherwise(F.col("line_number")).alias("no"), "value",
            )
            # An index without a table gets one at its end, after a blank line.
            bare = placed.where(F.col("place") == 0).isEmpty()
            fixed = [(0, 1, 0, ""), *table] if bare else table
        rows = index_lines(upsert(old, incoming)).select(F.lit(3).alias("part"), F.col("row_kind").alias("kind"), F.col("row_no").alias("no"), F.col("line").alias("value"))
        every = rows.unionByName(self.spark.createDataFrame(fixed, "part int, kind int, no bigint, value string"))
        if kept is not None:
            every = every.unionByName(kept)
        self.write(every, ["part", "kind", "no"], seen + 1)
        return seen + 1
