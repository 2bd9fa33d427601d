"""Structured Streaming jobs over landing folders of references, attempts and segments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.refs import extract_references, normalize_reference, task_key
from ..functions.routing import with_channel
from ..functions.strings import strip
from ..operators.ordered import PART_ROWS, block_of, ordered_text
from ..operators.tasks import IDENTITY, state_from_events

# Folders of the task table by key hash: a batch only reads those its keys fall into.
TASK_BUCKETS = 64
CLOSING = "close"


def identified_stream(texts: DataFrame, column: str, settings_hash: str, delay: str = "1 day", at: Column | None = None) -> DataFrame:
    """Text rows to tasks (source, normalized_source, task_key, config_fingerprint, at); repeats within `delay` go.

    The state forgets a key once the watermark has passed it, so it is bounded by what `delay` brings. `at` is the
    time of arrival unless given; no row is ever late for that one.
    """
    refs = texts.select(F.explode(extract_references(F.col(column))).alias("source"), (F.current_timestamp() if at is None else at).alias("at"))
    keyed = refs.withColumn("normalized_source", normalize_reference(F.col("source"))).withColumn(
        "task_key", task_key(F.col("normalized_source"))
    )
    return keyed.withColumn("config_fingerprint", F.lit(settings_hash)).withWatermark("at", delay).dropDuplicatesWithinWatermark(IDENTITY)


def registered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The task table that `register_stream` keeps, with the batch `b` and bucket of each row."""
    try:
        return spark.read.schema(f"{schema}, b bigint, bucket int").parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, b bigint, bucket int")


def register_stream(tasks: DataFrame, path: str, checkpoint: str, buckets: int = TASK_BUCKETS) -> StreamingQuery:
    """Add every identity once to the task table at `path`, whatever its age.

    Old repeats are found in the table itself: only the buckets of the batch's keys are read. A batch writes its
    own folder and only looks at those before it, so one that runs again after a crash gives the same rows.
    """
    schema = tasks.schema.toDDL()

    def add(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("task_key"), F.lit(buckets)).cast("int")
        # Read twice; without this each reading would run the batch and its state again.
        fresh = batch.dropDuplicates(IDENTITY).withColumn("bucket", bucket).persist()
        try:
            old = registered(batch.sparkSession, path, schema).where(F.col("b") < batch_id)
            keys = ["bucket", *IDENTITY]
            known = old.select(*keys).join(fresh.select(*keys), keys, "left_semi")
            new = fresh.join(known, keys, "left_anti")
            # One file a bucket, whatever the number of tasks: every later batch reads them.
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/b={batch_id}")
        finally:
            fresh.unpersist()

    return tasks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save_changes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an updating aggregate: each batch appends the rows it changed, in a folder of its own.

    The aggregate itself lives in the state store, so a batch costs what it touches, not what the table holds.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The last row of each key in a folder of changes."""
    columns = [f.name for f in schema]
    rest = [c for c in columns if c not in keys]
    rows = spark.read.schema(f"{schema.toDDL()}, b bigint").parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "b").alias("__r"))
    return last.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def task_states(events: DataFrame, key: str) -> DataFrame:
    """Current state of each task from its attempts, as an updating aggregate: the batch operator itself."""
    return state_from_events(events, key)


def with_closing(events: DataFrame, control: str) -> DataFrame:
    """The event stream with closing records of the folder `control`: rows of no key, only a time."""
    closing = events.sparkSession.readStream.schema("at timestamp").parquet(control)
    rest = [F.lit(CLOSING if c == "event" else None).cast(t).alias(c) for c, t in events.dtypes if c != "at"]
    return events.unionByName(closing.select("at", *rest))


def close(spark: SparkSession, control: str, at: str | None = None) -> None:
    """Say that no event before `at` will come (none at all: the far future); without it only lays out the folder."""
    times = [] if at is None else [(at,)]
    spark.createDataFrame(times, "at string").select(F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(control)


def stalled(events: DataFrame, key: str, idle: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tasks whose session of events ended in a start and then went quiet: pending again.

    A session closes when the watermark passes its end; later events for it are ignored. At the end of a stream
    nothing moves the watermark any more: a closing record does (see `with_closing`), and the last session of
    every task comes out. Closing records belong to no session.
    """
    # The condition names the event time, so it stays above the watermark, which has to see closing records.
    timed = events.withWatermark("at", delay).where(F.when(F.col("event") != CLOSING, F.col("at")).isNotNull())
    sessions = timed.groupBy(F.session_window("at", idle), key).agg(
        F.max_by("event", F.struct("at", "seq")).alias("last_event"),
        F.count_if(F.col("event") == "start").alias("attempts"),
    )
    return sessions.where(F.col("last_event") == "start").select(
        key, F.col("session_window.end").alias("stalled_at"), "attempts", F.lit("pending").alias("status")
    )


def segment_stream(
    segments: DataFrame, key: str, window_seconds: int = 300, delay: str = "10 minutes", part_rows: int = PART_ROWS
) -> DataFrame:
    """Live segments (key, at, seq, text) to fixed reading windows, in bounded text parts."""
    live = segments.where(strip(F.col("text")) != "")
    part = block_of(F.col("seq"), part_rows).alias("part_no")
    return live.withWatermark("at", delay).groupBy(
        F.window("at", f"{window_seconds} seconds"), key, part
    ).agg(
        F.count(F.lit(1)).alias("n_segments"), ordered_text("seq", strip(F.col("text")), "\n\n").alias("text")
    ).select(
        key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "part_no", "n_segments", "text",
    )


def channel_counts(references: DataFrame, url: str, at: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Captures per channel and time window."""
    routed = with_channel(references.withColumn("__reference", normalize_reference(F.col(url))), "__reference")
    return routed.withWatermark(at, delay).groupBy(F.window(at, window), "channel").count()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and read its parquet output back."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_to_rows(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregate to its end and give the last row of each key."""
    save_changes(stream, path, checkpoint).awaitTermination()
    return latest(stream.sparkSession, path, stream.schema, keys)
