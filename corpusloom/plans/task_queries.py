"""Task state: `orders` as a task table, `events` as an attempt log, references as manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..operators import tasks as K
from ..operators.hooks import map_texts
from ..runtime import scratch_path
from ..sinks.snapshots import SnapshotTable
from . import duck as D
from .reference_queries import ROUTED
from .registry import Tables, query

FINGERPRINT = K.fingerprint()

ATTEMPTS = """SELECT user_id AS task_id, ts AS at, event_id AS seq, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'start'
    WHEN 'purchase' THEN 'success' ELSE 'failed' END AS event, event_type || ' HTTP ' || regexp_extract(props, '[0-9]+', 0) AS message FROM {events}"""
_STATE = f"""
  SELECT task_id, count(*) FILTER (WHERE event = 'start') AS attempts,
    CASE WHEN arg_max(event, struct_pack(a := "at", s := seq)) = 'start' THEN 'running' ELSE arg_max(event, struct_pack(a := "at", s := seq)) END AS status,
    CASE WHEN arg_max(event, struct_pack(a := "at", s := seq)) = 'failed' THEN arg_max(message, struct_pack(a := "at", s := seq)) ELSE '' END AS error_message
  FROM ({ATTEMPTS}) GROUP BY task_id"""


@query("attempts_count", f"SELECT task_id, count(*) FILTER (WHERE event = 'start') AS attempts FROM ({ATTEMPTS}) GROUP BY task_id")
def attempts_count(t: Tables):
    return K.state_from_events(t.sql(ATTEMPTS)).select("task_id", "attempts")


@query("latest_attempt", _STATE)
def latest_attempt(t: Tables):
    return K.state_from_events(t.sql(ATTEMPTS)).select("task_id", "attempts", "status", "error_message")


TASKS = """SELECT o_orderkey AS task_id, 'https://e.org/' || CAST(o_orderkey AS STRING) AS raw_source,
    'key' || CAST(o_orderkey AS STRING) AS task_key, 'n' || CAST(o_custkey AS STRING) AS name,
    CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'pending' END AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN 'done' WHEN o_orderkey % 4 = 2 THEN 'ingesting' ELSE '' END AS stage,
    CAST(o_orderkey % 5 AS BIGINT) AS attempts,
    CASE WHEN o_orderkey % 4 = 0 THEN 'out/' || CAST(o_orderkey AS STRING) || '.md' ELSE '' END AS output_path,
    CASE WHEN o_orderkey % 4 = 1 THEN 'timeout' ELSE '' END AS error_code,
    CASE WHEN o_orderkey % 4 = 1 THEN 'late ' || o_orderpriority ELSE '' END AS error_message,
    CASE WHEN o_orderkey % 4 = 0 THEN 'web' ELSE '' END AS source_type FROM {orders}"""
FILES = "SELECT 'out/' || CAST(o_orderkey AS STRING) || '.md' AS path FROM {orders} WHERE o_orderkey % 8 = 0"
IDS = "SELECT o_orderkey AS task_id FROM {orders} WHERE o_orderstatus <> 'P'"
_SHOWN = ["task_id", "name", "status", "stage", "attempts", "output_path", "error_code", "error_message"]


def _tasks(t: Tables):
    none = F.lit(None).cast("timestamp")
    blank = {c: F.lit("") for c in ("source_id", "canonical_key")}
    return t.sql(TASKS).withColumns(
        {**blank, "config_fingerprint": F.lit(FINGERPRINT), "started_at": none, "finished_at": none}
    )


def _shown(**changes: str) -> str:
    return ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in _SHOWN)


_LISTED = f"task_id IN ({IDS})"


def _when(hit: str, **values: str) -> str:
    return _shown(**{c: f"CASE WHEN {hit} THEN {v} ELSE {c} END" for c, v in values.items()})


@query("task_summary", f"""
  SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running FROM ({TASKS})""")
def task_summary(t: Tables):
    return K.summary(_tasks(t))


@query("pending_take", f"SELECT task_id, raw_source FROM ({TASKS}) WHERE status = 'pending' ORDER BY task_id LIMIT 100")
def pending_take(t: Tables):
    return K.pending(_tasks(t), take=100).select("task_id", "raw_source")


_RESET = _when(_LISTED, status="'pending'", stage="''", attempts="0", output_path="''", error_code="''", error_message="''")


@query("state_reset", f"SELECT {_RESET} FROM ({TASKS})")
def state_reset(t: Tables):
    return K.reset(_tasks(t), t.sql(IDS)).select(*_SHOWN)


@query("state_recover", f"SELECT {_when(_LISTED + " AND status = 'running'", status="'pending'", stage="''")} FROM ({TASKS})")
def state_recover(t: Tables):
    return K.recover(_tasks(t), t.sql(IDS)).select(*_SHOWN)


@query("state_retry", f"""
  SELECT {_when(_LISTED + " AND status = 'failed'", status="'pending'", stage="''", error_code="''", error_message="''")} FROM ({TASKS})""")
def state_retry(t: Tables):
    return K.retry(_tasks(t), t.sql(IDS)).select(*_SHOWN)


_GONE = f"status = 'success' AND output_path NOT IN ({FILES})"


@query("state_refresh", f"SELECT {_when(f'{_LISTED} AND {_GONE}', status="'pending'", output_path="''")} FROM ({TASKS})")
def state_refresh(t: Tables):
    return K.refresh(_tasks(t), t.sql(FILES), t.sql(IDS)).select(*_SHOWN)


@query("state_start", f"SELECT {_when(_LISTED, status="'running'", stage="'ingesting'", attempts='attempts + 1')} FROM ({TASKS})")
def state_start(t: Tables):
    return K.start(_tasks(t), t.sql(IDS), F.timestamp_seconds(F.lit(0))).select(*_SHOWN)


OUTCOMES = """SELECT o_orderkey AS task_id, o_orderkey % 3 = 0 AS ok, 'web' AS source_type, '' AS source_id, 'k' AS canonical_key,
    'new/' || CAST(o_orderkey AS STRING) || '.md' AS output_path, 'failed' AS error_code, 'boom ' || o_orderpriority AS error_message FROM {orders} WHERE o_orderkey % 2 = 0"""


@query("state_finish", f"""
  SELECT t.task_id, t.name, CASE WHEN o.task_id IS NULL THEN t.status WHEN o.ok THEN 'success' ELSE 'failed' END AS status,
    CASE WHEN o.task_id IS NULL THEN t.stage WHEN o.ok THEN 'done' ELSE '' END AS stage, t.attempts,
    CASE WHEN o.ok THEN o.output_path ELSE t.output_path END AS output_path,
    CASE WHEN o.task_id IS NULL THEN t.error_code WHEN o.ok THEN '' ELSE o.error_code END AS error_code,
    CASE WHEN o.task_id IS NULL THEN t.error_message WHEN o.ok THEN '' ELSE o.error_message END AS error_message
  FROM ({TASKS}) t LEFT JOIN ({OUTCOMES}) o ON o.task_id = t.task_id""")
def state_finish(t: Tables):
    outcomes = t.sql(OUTCOMES).withColumn("at", F.timestamp_seconds(F.lit(0)))
    return K.finish(_tasks(t), outcomes).select(*_SHOWN)


_PLAN = f"""
  SELECT task_id, attempts FROM ({TASKS}) WHERE {_LISTED} AND (status IN ('pending', 'running', 'failed') OR ({_GONE}))
  ORDER BY task_id LIMIT 500"""


@query("run_plan", _PLAN)
def run_plan(t: Tables):
    _, work = K.plan_run(_tasks(t), t.sql(FILES), t.sql(IDS), resume=True, retry_failed=True, take=500)
    return work.select("task_id", "attempts")


@query("except_done", f"SELECT task_id, status FROM ({TASKS}) WHERE NOT (status = 'success' AND output_path IN ({FILES}))")
def except_done(t: Tables):
    return K.except_done(_tasks(t), t.sql(FILES)).select("task_id", "status")


@query("join_missing_outputs", f"SELECT task_id, output_path FROM ({TASKS}) WHERE {_GONE}")
def join_missing_outputs(t: Tables):
    return K.missing_outputs(_tasks(t), t.sql(FILES)).select("task_id", "output_path")


REPLACED = """SELECT 'out/' || CAST(o_orderkey AS STRING) || '.md' AS old_path, 'moved/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.md' AS new_path
    FROM {orders} WHERE o_orderpriority LIKE '1%'"""


@query("join_output_repair", f"""
  SELECT t.task_id, coalesce(r.new_path, t.output_path) AS output_path FROM ({TASKS}) t
  LEFT JOIN ({REPLACED}) r ON r.old_path = t.output_path AND t.status = 'success'""")
def join_output_repair(t: Tables):
    return K.repair_outputs(_tasks(t), t.sql(REPLACED)).select("task_id", "output_path")


# Items in position order: every reference, then every one again in quotes.
ITEMS = f"""SELECT 2 * id + CASE kind WHEN 'page' THEN 0 ELSE 1 END AS pos, raw AS source, kind AS name FROM ({ROUTED})
  UNION ALL SELECT 1000000000000 + 2 * id + CASE kind WHEN 'page' THEN 0 ELSE 1 END AS pos, ' "' || raw || '" ' AS source, 'again' AS name FROM ({ROUTED})"""
_KEYED = f"""SELECT pos, source, name, 'ref:' || {D.normalized("trim(trim(trim(source), '" + '"' + "'))")} AS material FROM ({ITEMS})"""
_FIRSTS = f"""SELECT material, min(pos) AS pos, arg_min(source, pos) AS source, arg_min(name, pos) AS name FROM ({_KEYED}) GROUP BY material"""


def _items(t: Tables):
    items = t.sql(ITEMS).withColumn("tags", F.array().cast("array<string>"))
    return K.identify(items, FINGERPRINT)


def _two_runs(t: Tables):
    """Pages registered first, then everything."""
    items = _items(t)
    first = K.register(items.where(F.col("name") == "page"))
    return items, K.register(items, first)


_REGISTERED = f"""
  SELECT sha256(material) AS task_key, source AS raw_source, name,
    row_number() OVER (ORDER BY CASE name WHEN 'page' THEN 0 ELSE 1 END, pos) AS task_id FROM ({_FIRSTS})"""


@query("task_register", _REGISTERED)
def task_register(t: Tables):
    _, tasks = _two_runs(t)
    return tasks.select("task_key", "raw_source", "name", "task_id")


@query("join_task_register", f"""
  SELECT r.task_id, f.pos FROM ({_REGISTERED}) r JOIN ({_FIRSTS}) f ON sha256(f.material) = r.task_key""")
def join_task_register(t: Tables):
    items, tasks = _two_runs(t)
    return K.ids_of(items, tasks)


@query("sink_task_state", f"SELECT {_RESET} FROM ({TASKS})")
def sink_task_state(t: Tables):
    """Two versions written; the reader sees the second."""
    table = SnapshotTable(t.spark, scratch_path(t.spark, "tasks"))
    table.write(_tasks(t))
    table.write(K.reset(table.read(), t.sql(IDS)))
    return table.read().select(*_SHOWN)


ERRORS = """SELECT event_id, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'FileNotFoundError' WHEN 2 THEN 'UnsupportedURLError' ELSE 'RuntimeError' END AS kind,
    CASE CAST(event_id % 11 AS INT) WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Too Many Requests' WHEN 2 THEN 'temporarily unavailable' WHEN 3 THEN 'Cookie expired'
      WHEN 4 THEN 'the author said' WHEN 5 THEN '候选 1 无音轨' WHEN 6 THEN 'invalid media' WHEN 7 THEN 'ASR crashed' WHEN 8 THEN '转写失败' WHEN 9 THEN '需要登录'
      ELSE event_type || ' HTTP ' || regexp_extract(props, '[0-9]+', 0) END AS message FROM {events}"""


@query("error_classify", f"""
  WITH c AS (SELECT event_id, kind, lower(message) AS m FROM ({ERRORS})),
  k AS (SELECT event_id, CASE WHEN kind = 'UnsupportedURLError' THEN 'unsupported' WHEN kind = 'FileNotFoundError' THEN 'input_missing'
      WHEN kind = 'TimeoutError' THEN 'timeout' WHEN m LIKE '%429%' OR m LIKE '%too many requests%' THEN 'rate_limited'
      WHEN m LIKE '%502%' OR m LIKE '%503%' OR m LIKE '%504%' OR m LIKE '%temporarily unavailable%' THEN 'transient_network'
      WHEN regexp_matches(m, 'cookie|登录|login|auth') THEN 'auth_required' WHEN regexp_matches(m, '无音轨|invalid media|媒体候选') THEN 'invalid_media'
      WHEN regexp_matches(m, 'asr|转写') THEN 'transcription_failed' ELSE 'failed' END AS code FROM c)
  SELECT event_id, code, code IN ('timeout', 'rate_limited', 'transient_network') AS retryable FROM k""")
def error_classify(t: Tables):
    verdict = V.error_class(F.col("message"), F.col("kind"))
    return t.sql(ERRORS).select("event_id", verdict.alias("v")).select("event_id", "v.code", "v.retryable")


ACCESS = """SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'Sign in to confirm you are not a bot' WHEN 1 THEN 'Cookie invalid' WHEN 2 THEN 'HTTP Error 429'
    WHEN 3 THEN 'nsig extraction failed' WHEN 4 THEN 'HTTP Error 403: Forbidden' WHEN 5 THEN 'please LOGIN' WHEN 6 THEN 'cookie file is fine' ELSE event_type END AS message FROM {events}"""


@query("access_error_classify", f"""
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'auth' WHEN 1 THEN 'cookie' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'js' WHEN 4 THEN 'playback' WHEN 5 THEN 'auth'
    ELSE 'download' END AS kind FROM ({ACCESS})""")
def access_error_classify(t: Tables):
    return t.sql(ACCESS).select("event_id", V.access_class(F.col("message")).alias("kind"))


def _fragile():
    """A batch function that refuses some inputs."""

    def run(texts):
        if any("error" in x for x in texts):
            raise ValueError("HTTP 503 from model")
        return [x.upper() for x in texts]

    return run


@query("failure_isolation", """
  SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE upper(event_type) END AS result,
    CASE WHEN event_type = 'error' THEN 'transient_network' ELSE '' END AS error_code FROM {events}""")
def failure_isolation(t: Tables):
    out = map_texts(t["events"].select("event_id", "event_type"), "event_type", _fragile, batch_size=1)
    code = F.when(F.col("error_message") != "", V.error_class(F.col("error_message"))["code"]).otherwise("")
    return out.select("event_id", F.coalesce("result", F.lit("")).alias("result"), code.alias("error_code"))
