"""Published captures as a table that takes one batch after another."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.clock import capture_day
from ..operators.publish import accepted, newest, refused, summed_days, title_days
from ..runtime import materialize

_PAIR = "name string, title string, first struct<captured_at: timestamp, seq: bigint>, last struct<captured_at: timestamp, seq: bigint>, captures bigint"
_LEDGER = f"{_PAIR}, stem string, batch bigint"
_REPLACED = "title string, old_name string, new_name string, batch bigint"


class PublishedTable:
    """Folder of four tables; `merge` adds a batch of captures, `read` gives what is published.

    - `ledger`: narrow rows (name, title, first, last, captures), appended by batch. Names of a title share a
      stem, its truncated text, and so do titles that compete for a name: a batch only looks at its own stems.
    - `bodies`: the newest capture of each pair of a batch, by batch and day. They are kept, because a late
      capture may take a name from its holder, whose earlier version then counts again.
    - `rows`: the published captures by day. Days that gain a row are overwritten, each as a whole.
    - `replaced`: paths that a batch made obsolete. Days that only lose rows are not touched: readers leave out
      rows that a later batch replaced, and the next overwriting of the day drops them.

    Batches are numbered upwards. The last one may be merged again after a failure, with the same result: all it
    wrote is overwritten. The result depends on the captures only, not on how they were dealt into batches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._table("ledger", _LEDGER)

    def replaced(self) -> DataFrame:
        """(title, old_name, new_name, batch): paths made obsolete; new_name is null if the title is published no more."""
        return self._table("replaced", _REPLACED)

    def collisions(self) -> DataFrame:
        return refused(summed_days(self.ledger()))

    def _live(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows that no later batch (below `before`) replaced."""
        gone = self.replaced() if before is None else self.replaced().where(F.col("batch") < before)
        last = gone.groupBy("title", F.col("old_name").alias("name")).agg(F.max("batch").alias("__gone"))
        return rows.join(last, ["title", "name"], "left").where(F.col("__gone").isNull() | (F.col("__gone") <= F.col("batch"))).drop("__gone")

    def merge(self, captures: DataFrame, batch: int) -> None:
        """Add captures (seq, title, captured_at, ok and any other columns) as batch number `batch`."""
        last = self.ledger().agg(F.max("batch")).first()[0]
        if last is not None and batch < last:
            raise ValueError(f"batch {last} is already merged")
        columns = captures.columns
        stem = F.substring("name", 11, 1 << 20)
        title_days(captures).withColumn("stem", stem).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        own = self.ledger().where(F.col("batch") == batch)
        newest_own = captures.join(own.select(F.col("last.seq").alias("seq"), "name"), "seq").select(*columns, "name")
        day = capture_day(F.col("captured_at")).alias("capture_day")
        newest_own.select("*", day).write.mode("overwrite").partitionBy("capture_day").parquet(f"{self.path}/bodies/batch={batch}")
        body_schema = f"{newest_own.select('*', day).schema.toDDL()}, batch bigint"

        old = self.ledger().where(F.col("batch") < batch).join(own.select("stem").distinct(), "stem", "left_semi")
        pairs = [c for c in own.columns if c not in ("stem", "batch")]
        after = newest(accepted(summed_days(old.select(*pairs).unionByName(own.select(*pairs)))))
        before = newest(accepted(summed_days(old.select(*pairs)))).select("title", F.col("name").alias("old_name"), F.col("seq").alias("old_seq"))
        changes = materialize(
            before.join(after, "title", "full").where(~F.col("old_seq").eqNullSafe(F.col("seq"))).select("title", "old_name", "name", "seq", capture_day(F.col("captured_at")).alias("day")),
            "published-changes",
        )
        days = [r["day"] for r in changes.where("day is not null").select("day").distinct().collect()]
        if days:
            touched = F.col("capture_day").isin(days)
            bodies = self._table("bodies", body_schema).where(touched)
            entering = bodies.join(changes.select("seq"), "seq", "left_semi").select(*columns, "name", "capture_day", F.lit(batch).cast("bigint").alias("batch"))
            kept = self._live(self._table("rows", body_schema).where(touched & (F.col("batch") < batch)), batch).join(changes.select("title"), "title", "left_anti")
            rows = materialize(kept.select(*entering.columns).unionByName(entering), "published-days")
            (
                rows.hint("rebalance", F.col("capture_day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("capture_day").parquet(f"{self.path}/rows")
            )
        moved = changes.where(F.col("old_name").isNotNull() & ~F.col("old_name").eqNullSafe(F.col("name")))
        moved.select("title", "old_name", F.col("name").alias("new_name")).write.mode("overwrite").parquet(f"{self.path}/replaced/batch={batch}")

    def read(self, columns: str) -> DataFrame:
        """Published rows with their name and day; `columns` is the DDL schema of the captures."""
        rows = self._table("rows", f"{columns}, name string, batch bigint, capture_day date")
        return self._live(rows).drop("batch")
