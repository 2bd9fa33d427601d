"""Durable task state as a table: set-based registration and transitions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.refs import normalize_reference, task_key
from ..functions.verdicts import clipped_message
from ..runtime import materialize
from .ordered import keep_first, with_row_number

STATUSES = ("success", "failed", "pending", "running")
# The settings that change what an ingestion produces.
FINGERPRINT_FIELDS = (
    "asr_backend", "asr_language", "limit_seconds", "subtitle_window_seconds", "transcript_window_seconds",
    "sensevoice_model_dir", "sensevoice_chunk_seconds", "sensevoice_batch_size", "sensevoice_quantize",
    "openai_asr_base_url", "openai_asr_model", "openai_asr_chunk_seconds", "asr_prompt", "llm_base_url",
    "llm_model", "llm_api", "llm_chunk_seconds", "llm_candidates", "max_answers", "formats", "keep_audio",
    "keep_chunks",
)


def fingerprint(settings: dict | None = None) -> str:
    """Short hash of the given settings that matter, for one run."""
    given = settings or {}
    text = json.dumps(
        {f: given[f] for f in FINGERPRINT_FIELDS if given.get(f) is not None},
        ensure_ascii=False, sort_keys=True, default=list, separators=(",", ":"),
    )
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


def fingerprint_of(settings: dict[str, Column]) -> Column:
    """The same hash per row, for a table of settings."""
    fields = [settings[f].alias(f) for f in sorted(FINGERPRINT_FIELDS) if f in settings]
    return F.left(F.sha2(F.to_json(F.struct(*fields)), 256), F.lit(16))


def identify(items: DataFrame, settings_hash: str, local_path: Column | None = None) -> DataFrame:
    """Items (source, name, tags, pos) with normalised source, key and fingerprint."""
    return items.withColumn(
        "normalized_source", normalize_reference(F.col("source"), local_path)
    ).withColumn("task_key", task_key(F.col("normalized_source"))).withColumn(
        "config_fingerprint", F.lit(settings_hash)
    )


IDENTITY = ["task_key", "config_fingerprint"]


def blank_task(items: DataFrame) -> DataFrame:
    return items.select(
        F.col("task_id"),
        F.col("source").alias("raw_source"),
        "normalized_source",
        *IDENTITY,
        "name",
        "tags",
        *[F.lit("").alias(c) for c in ("source_type", "source_id", "canonical_key")],
        F.lit("pending").alias("status"),
        F.lit("").alias("stage"),
        F.lit(0).cast("long").alias("attempts"),
        *[F.lit("").alias(c) for c in ("output_path", "error_code", "error_message")],
        F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
    )


def register(items: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Insert or ignore: new identities get the next ids in order of `pos`, old rows stay.

    `items` comes from `identify`; of several items with one identity the first gives the
    name and tags. The new rows become a table in order of `pos` before they are numbered, so a
    retried task cannot renumber them.
    """
    firsts = keep_first(items, IDENTITY, ["pos"])
    fresh = firsts if tasks is None else firsts.join(tasks.select(*IDENTITY), IDENTITY, "left_anti")
    # Blocks of equal size whatever the positions are; written, so that both readings agree on them.
    ranged = materialize(fresh.repartitionByRange("pos").withColumn("__range", F.spark_partition_id()), "ranged-tasks")
    numbered = with_row_number(ranged, [], ["pos"], F.col("__range"), "__no").drop("__range")
    if tasks is None:
        return blank_task(numbered.withColumn("task_id", F.col("__no")))
    highest = tasks.agg(F.coalesce(F.max("task_id"), F.lit(0))).scalar()
    return tasks.unionByName(blank_task(numbered.withColumn("task_id", highest + F.col("__no"))))


def ids_of(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """Distinct task ids of the items with the first position that asked for each."""
    asked = items.groupBy(*IDENTITY).agg(F.min("pos").alias("pos"))
    return asked.join(tasks.select(*IDENTITY, "task_id"), IDENTITY).select("task_id", "pos")


def _update(tasks: DataFrame, hit: Column, **values) -> DataFrame:
    sets = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}
    return tasks.select(*[sets.get(c, F.col(c)).alias(c) for c in tasks.columns])


def _listed(tasks: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Adds `__listed`: whether the task belongs to this run. Tasks that have it already keep it."""
    if "__listed" in tasks.columns:
        return tasks
    if ids is None:
        return tasks.withColumn("__listed", F.lit(True))
    marks = ids.select("task_id").distinct().withColumn("__listed", F.lit(True))
    return tasks.join(marks, "task_id", "left").withColumn(
        "__listed", F.coalesce("__listed", F.lit(False))
    )




def reset(tasks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """New run: listed tasks start over, successes included; name and tags stay."""
    t = _listed(tasks, ids)
    cleared = {c: F.lit("") for c in (
        "stage", "output_path", "source_type", "source_id", "canonical_key", "error_code", "error_message")}
    none = F.lit(None).cast("timestamp")
    return _update(
        t, F.col("__listed"), status=F.lit("pending"), attempts=F.lit(0).cast("long"),
        started_at=none, finished_at=none, **cleared,
    ).select(*tasks.columns)


def recover(tasks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Tasks left running by a dead run are pending again."""
    t = _listed(tasks, ids)
    hit = F.col("__listed") & (F.col("status") == "running")
    return _update(t, hit, status=F.lit("pending"), stage=F.lit("")).select(*tasks.columns)


def retry(tasks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Failed tasks are pending again; attempts stay."""
    t = _listed(tasks, ids)
    hit = F.col("__listed") & (F.col("status") == "failed")
    return _update(
        t, hit, status=F.lit("pending"), stage=F.lit(""), error_code=F.lit(""), error_message=F.lit(""),
        finished_at=F.lit(None).cast("timestamp"),
    ).select(*tasks.columns)


def _by_path(tasks: DataFrame, named: Column, paths: DataFrame, how: str) -> DataFrame:
    """`named` tasks joined to a table unique by `__path` on their output path.

    The others get a key that no path has: most tasks have no output yet, and their blank paths would all meet in
    one task.
    """
    unique = F.concat(F.lit("\x00"), F.col("task_id").cast("string"))
    return tasks.withColumn("__path", F.coalesce(F.when(named, F.col("output_path")), unique)).join(paths, "__path", how).drop("__path")


def missing_outputs(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Successful tasks whose output is not in the file listing (column `path`)."""
    known = files.select(F.col("path").alias("__path")).distinct()
    done = F.col("status") == "success"
    return _by_path(tasks.where(done), done, known, "left_anti").select(*tasks.columns)


def refresh(tasks: DataFrame, files: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Successful tasks whose output is gone are pending again."""
    known = files.select(F.col("path").alias("__path")).distinct().withColumn("__known", F.lit(True))
    done = F.col("__listed") & (F.col("status") == "success")
    t = _by_path(_listed(tasks, ids), done & (F.col("output_path") != ""), known, "left")
    hit = done & (F.col("__known").isNull() | (F.col("output_path") == ""))
    return _update(t, hit, status=F.lit("pending"), output_path=F.lit("")).select(*tasks.columns)


def except_done(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """What a resumed run still has to do: everything but successes whose output exists."""
    known = files.select(F.col("path").alias("__path")).distinct()
    done = F.col("status") == "success"
    kept = _by_path(tasks.where(done), done, known, "left_semi")
    return tasks.join(kept.select("task_id"), "task_id", "left_anti").select(*tasks.columns)


def pending(tasks: DataFrame, take: int = 0) -> DataFrame:
    """Pending tasks in id order; `take` > 0 limits them."""
    if take < 0:
        raise ValueError("take must not be negative")
    ordered = tasks.where(F.col("status") == "pending").orderBy("task_id")
    return ordered.limit(take) if take else ordered


def start(tasks: DataFrame, ids: DataFrame, at: Column, stage: str = "ingesting") -> DataFrame:
    t = _listed(tasks, ids)
    return _update(
        t, F.col("__listed"), status=F.lit("running"), stage=F.lit(stage), attempts=F.col("attempts") + 1,
        started_at=at, finished_at=F.lit(None).cast("timestamp"),
    ).select(*tasks.columns)


RESULT_COLUMNS = ("source_type", "source_id", "canonical_key", "output_path")


def finish(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply outcome rows (task_id, ok, result columns, error_code, error_message, at)."""
    o = outcomes.select("task_id", F.struct(*[c for c in outcomes.columns if c != "task_id"]).alias("__o"))
    t = tasks.join(o, "task_id", "left")
    out, hit = F.col("__o"), F.col("__o").isNotNull()
    ok = F.coalesce(out["ok"], F.lit(False))
    values = {c: F.when(ok, out[c]).otherwise(F.col(c)) for c in RESULT_COLUMNS}
    return _update(
        t, hit,
        status=F.when(ok, F.lit("success")).otherwise(F.lit("failed")),
        stage=F.when(ok, F.lit("done")).otherwise(F.lit("")),
        error_code=F.when(ok, F.lit("")).otherwise(out["error_code"]),
        error_message=F.when(ok, F.lit("")).otherwise(clipped_message(out["error_message"])),
        finished_at=out["at"],
        **values,
    ).select(*tasks.columns)


def repair_outputs(tasks: DataFrame, replaced: DataFrame) -> DataFrame:
    """Point successful tasks from replaced paths (old_path) to the new ones (new_path)."""
    moves = replaced.where(F.col("old_path") != F.col("new_path")).groupBy(
        F.col("old_path").alias("__path")
    ).agg(F.max("new_path").alias("__new"))
    done = F.col("status") == "success"
    t = _by_path(tasks, done, moves, "left")
    hit = done & F.col("__new").isNotNull()
    return _update(t, hit, output_path=F.col("__new")).select(*tasks.columns)


def summary(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
    )


def plan_run(
    tasks: DataFrame, files: DataFrame, ids: DataFrame | None = None, *,
    resume: bool = False, retry_failed: bool = False, take: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(tasks, work list): resuming keeps results, a new run starts over."""
    listed = _listed(tasks, ids)
    state = refresh(recover(listed), files) if resume or retry_failed else reset(listed)
    if retry_failed:
        state = retry(state)
    return state.select(*tasks.columns), pending(state.where("__listed").select(*tasks.columns), take)


def state_from_events(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Current state per task from an attempt log (key, at, seq, event, message).

    Every value is a partial aggregate, so a task with a very long log costs one row per map task.
    """
    order = F.struct("at", "seq")
    last = F.max_by(F.struct("event", "message"), order)
    return events.groupBy(key).agg(
        F.count_if(F.col("event") == "start").alias("attempts"),
        last.alias("__last"),
        F.max("at").alias("updated_at"),
    ).select(
        key,
        "attempts",
        F.when(F.col("__last")["event"] == "start", "running").otherwise(F.col("__last")["event"]).alias("status"),
        F.when(F.col("__last")["event"] == "failed", clipped_message(F.col("__last")["message"])).otherwise("").alias("error_message"),
        "updated_at",
    )
