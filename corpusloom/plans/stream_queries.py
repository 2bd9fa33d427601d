"""Streaming runs over the tables as landing folders, each driven to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tasks import fingerprint
from ..runtime import scratch_path
from ..streaming import jobs as J
from . import duck as D
from .registry import Tables, query
from .task_queries import _STATE


def _stream(t: Tables, table: str):
    schema = t[table].schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


def _events(t: Tables):
    """Event stream with an instant as event time (the table has a time without zone)."""
    micros = (F.unix_micros(F.to_timestamp(F.col("ts").cast("string"))))
    return _stream(t, "events").withColumn("at", F.timestamp_micros(micros))


@query("stream_manifests", f"SELECT DISTINCT sha256('ref:' || {D.normalized('url')}) AS task_key, {D.normalized('url')} AS normalized_source FROM {{pages}}")
def stream_manifests(t: Tables):
    """Two drops of pages, the second one repeating the first; the restarted stream registers each identity once."""
    work = scratch_path(t.spark, "stream-manifests")
    for drop in (F.col("page_id") % 2 == 0, F.lit(True)):
        t["pages"].where(drop).select("url").write.mode("append").parquet(f"{work}/landing")
        texts = t.spark.readStream.schema("url string").option("maxBytesPerTrigger", 256 << 20).parquet(f"{work}/landing")
        tasks = J.identified_stream(texts, "url", fingerprint())
        J.register_stream(tasks, f"{work}/tasks", f"{work}/checkpoint").awaitTermination()
    return J.registered(t.spark, f"{work}/tasks", tasks.schema.toDDL()).select("task_key", "normalized_source")


def _attempts(t: Tables):
    kind = F.col("event_type")
    event = F.when(kind.isin("click", "view"), "start").when(kind == "purchase", "success").otherwise("failed")
    return _events(t).select(
        F.col("user_id").alias("task_id"), "at", F.col("event_id").alias("seq"), event.alias("event"),
        F.concat(kind, F.lit(" HTTP "), F.regexp_extract("props", "[0-9]+", 0)).alias("message"),
    )


@query("stream_task_state", _STATE)
def stream_task_state(t: Tables):
    work = scratch_path(t.spark, "stream-state")
    states = J.task_states(_attempts(t), "task_id")
    return J.run_to_rows(states, f"{work}/changes", f"{work}/checkpoint", ["task_id"]).select("task_id", "attempts", "status", "error_message")


@query("stream_stalled", """
  WITH a AS (SELECT user_id AS task_id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'start' ELSE 'other' END AS event FROM {events}),
  g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS session FROM g)
  SELECT task_id, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS stalled_at, count(*) FILTER (WHERE event = 'start') AS attempts, 'pending' AS status
  FROM s GROUP BY task_id, session HAVING arg_max(event, struct_pack(t := ts, i := event_id)) = 'start'""")
def stream_stalled(t: Tables):
    """The stream is run, closed and run on: the last session of each task comes out too."""
    work = scratch_path(t.spark, "stream-stalled")
    J.close(t.spark, f"{work}/control")
    for end in (None, "9999-01-01"):
        if end:
            J.close(t.spark, f"{work}/control", end)
        quiet = J.stalled(J.with_closing(_attempts(t), f"{work}/control"), "task_id", idle="2 hours")
        rows = J.run_to_table(quiet, f"{work}/out", f"{work}/checkpoint")
    return rows.withColumn("stalled_at", F.date_format("stalled_at", "yyyy-MM-dd HH:mm:ss"))


@query("stream_segments", """
  SELECT user_id AS doc_id, strftime(make_timestamp(CAST(floor(epoch(ts) / 300) AS BIGINT) * 300000000), '%Y-%m-%d %H:%M:%S') AS window_start,
    event_id // 1000 AS part_no, count(*) AS n_segments, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS text
  FROM {events} GROUP BY ALL""")
def stream_segments(t: Tables):
    work = scratch_path(t.spark, "stream-segments")
    live = _events(t).select(F.col("user_id").alias("doc_id"), "at", F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    windows = J.segment_stream(live, "doc_id", part_rows=1000)
    rows = J.run_to_rows(windows, f"{work}/out", f"{work}/checkpoint", ["doc_id", "window_start", "part_no"])
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rows.select("doc_id", start, "part_no", "n_segments", "text")


_LINK = """CASE event_type WHEN 'click' THEN 'https://v.douyin.com/' WHEN 'view' THEN 'https://youtu.be/' WHEN 'purchase' THEN 'https://mp.weixin.qq.com/s/' WHEN 'signup' THEN 'ftp://files/'
    ELSE 'https://example.org/' END || CAST(event_id AS STRING)"""


@query("stream_source_counts", f"SELECT {D.channel(D.normalized(_LINK))} AS channel, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS count FROM {{events}} GROUP BY 1, 2")
def stream_source_counts(t: Tables):
    work = scratch_path(t.spark, "stream-counts")
    counts = J.run_to_rows(J.channel_counts(_events(t).withColumn("url", F.expr(_LINK)), "url", "at"), f"{work}/out", f"{work}/checkpoint", ["window", "channel"])
    day = F.date_format(F.col("window.start"), "yyyy-MM-dd")
    return counts.select("channel", day.alias("day"), "count")
