"""Streams over several runs: restarts, replays, late events, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tracks as TR
from corpusloom.sinks.published import PublishedTable
from corpusloom.operators import publish as P
from corpusloom.streaming import jobs as J

START = datetime(2024, 1, 1)
ATTEMPTS = "task_id bigint, at timestamp, seq bigint, event string, message string"


def land(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def sessions(rows, idle):
    out = []
    for task in {r[0] for r in rows}:
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == task)
        group = []
        for k, r in enumerate(own):
            group.append(r)
            if k + 1 == len(own) or own[k + 1][0] >= r[0] + idle:
                if group[-1][2] == "start":
                    out.append((task, group[-1][0] + idle, sum(g[2] == "start" for g in group), "pending"))
                group = []
    return sorted(out)


def test_stalled_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    drops, seq = [], 0
    for run in range(3):
        rows = []
        for _ in range(80):
            seq += 1
            at = START + timedelta(hours=20 * run, minutes=rng.randrange(0, 1100))
            rows.append((rng.randrange(8), at, seq, rng.choice(["start", "success", "failed"]), ""))
        drops.append(rows)
    events, control, out, mark = (str(tmp_path / n) for n in ("events", "control", "out", "mark"))
    J.close(spark, control)

    def run():
        stream = spark.readStream.schema(ATTEMPTS).parquet(events)
        return J.run_to_table(J.stalled(J.with_closing(stream, control), "task_id", idle="1 hour", delay="10 minutes"), out, mark)

    for rows in drops:
        land(spark, rows, ATTEMPTS, events)
        before = run()
    every = [r for rows in drops for r in rows]
    assert before.count() < len(sessions(every, timedelta(hours=1)))
    # An event far behind the watermark is ignored; a closing record lets the last sessions out, once.
    land(spark, [(0, START, 0, "start", "")], ATTEMPTS, events)
    run()
    J.close(spark, control, "9999-01-01")
    run()
    assert sorted(map(tuple, run().collect())) == sessions(every, timedelta(hours=1))


def test_task_states_and_a_replayed_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(12), START + timedelta(minutes=rng.randrange(999)), k, rng.choice(["start", "success", "failed"]), f"m{k}") for k in range(200)]
    events, changes, mark = (str(tmp_path / n) for n in ("events", "changes", "mark"))
    for part in (rows[:90], rows[90:91], rows[91:]):
        land(spark, part, ATTEMPTS, events)
        stream = J.task_states(spark.readStream.schema(ATTEMPTS).parquet(events), "task_id")
        J.save_changes(stream, changes, mark).awaitTermination()
    want = {}
    for task, at, seq, event, message in sorted(rows, key=lambda r: (r[1], r[2])):
        attempts = want.get(task, (0,))[0] + (event == "start")
        want[task] = (attempts, "running" if event == "start" else event, message if event == "failed" else "", at)
    got = J.latest(spark, changes, stream.schema, ["task_id"])
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    sizes = {r.b: r["count"] for r in spark.read.parquet(changes).groupBy("b").count().collect()}
    assert sizes[1] == 1  # one event changes one row


def test_registration_once_with_bounded_state(spark, tmp_path):
    texts, table, mark = (str(tmp_path / n) for n in ("texts", "table", "mark"))
    schema = "text string, at timestamp"
    runs = []
    for run in range(5):
        day = START + timedelta(days=10 * run)
        rows = [(f"see https://e.org/{k} and https://e.org/{k}", day + timedelta(minutes=k % 7)) for k in range(run * 15, run * 15 + 20)]
        rows += [("https://e.org/always https://e.org/always", day), ("no link", day), (None, day)]
        land(spark, rows, schema, texts)
        for _ in range(2):  # the second call finds nothing new
            stream = spark.readStream.schema(schema).parquet(texts)
            tasks = J.identified_stream(stream, "text", "f", delay="1 hour", at=F.col("at"))
            query = J.register_stream(tasks, table, mark)
            query.awaitTermination()
            runs += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    found = [r.normalized_source for r in J.registered(spark, table, tasks.schema.toDDL()).collect()]
    assert sorted(found) == sorted([f"https://e.org/{k}" for k in range(80)] + ["https://e.org/always"])
    assert max(runs[len(runs) // 2 :]) <= max(runs[: len(runs) // 2])  # keys of a drop or two, not of all


def test_a_batch_writes_few_files(spark, tmp_path):
    texts, table, mark = (str(tmp_path / n) for n in ("texts", "table", "mark"))
    land(spark, [(f"https://e.org/{k}",) for k in range(200)], "text string", texts)
    tasks = J.identified_stream(spark.readStream.schema("text string").parquet(texts), "text", "f")
    J.register_stream(tasks, table, mark, buckets=4).awaitTermination()
    assert J.registered(spark, table, tasks.schema.toDDL()).count() == 200
    assert [len(list(p.glob("*.parquet"))) for p in (tmp_path / "table" / "b=0").glob("bucket=*")] == [1, 1, 1, 1]


def brute_windows(cues, length):
    out, first = [], None
    for no, start, end, text in cues:
        if first is None or start >= first[1] + length:
            first = [no, start, end, [text]]
            out.append(first)
        else:
            first[2] = max(first[2], end)
            first[3].append(text)
    return [(f, s, e, " ".join(t)) for f, s, e, t in out]


def test_cue_windows_match_the_fold(spark):
    rng = random.Random(9)
    tracks = {t: [] for t in ("a", "b", "c", None)}
    for t, own in tracks.items():
        at = 0.0
        for k in range({"a": 900, "b": 1, "c": 40, None: 70}[t]):
            at += rng.choice([-3, 0, 2, 15, 15, 400 if t == "c" else 1])
            own.append((k, max(0.0, at), max(0.0, at) + rng.randint(0, 50), f"t{k}"))
    rows = [(t, *c) for t, own in tracks.items() for c in own]
    frame = spark.createDataFrame(rows, "track_id string, cue_no bigint, start double, end double, text string")
    for length, block in ((30, 8), (300, 64)):
        got = TR.cue_windows(frame, window_seconds=length, block_rows=block).select("track_id", "first_cue", "start", "end", "text").collect()
        want = [(t, *w) for t, own in tracks.items() for w in brute_windows(own, length)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_track_of_a_million_cues(spark):
    """Far more than one row could hold; every window of 300 s has 100 cues of 3 s."""
    cues = spark.range(1_000_000).select(
        F.lit(1).alias("track_id"), F.col("id").alias("cue_no"), (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + 3).alias("end"), F.lit("x").alias("text")
    )
    starts = TR.window_starts(cues, ["track_id"], "cue_no", 300.0)
    assert starts.count() == 10_000 and starts.where(F.col("cue_no") % 100 != 0).isEmpty()


CAPTURES = "seq bigint, title string, captured_at timestamp, ok boolean, body string"


def test_batches_give_what_one_run_gives(spark, tmp_path):
    """Failed, colliding, early and repeated captures over batches, a batch merged twice, an older one refused."""
    rng = random.Random(1)
    long = "t" * 150
    rows = []
    for seq in range(90):
        title = rng.choice(["alpha", "beta", "Gamma/delta", f"{long} one", f"{long} two", f"{long} three"])
        rows.append((seq, title, START + timedelta(days=rng.randrange(5), minutes=rng.randrange(900)), rng.random() < 0.8, f"body {seq}"))
    rng.shuffle(rows)
    table = PublishedTable(spark, str(tmp_path / "published"))
    parts = [rows[:30], [], rows[30:70], rows[70:]]
    for batch, part in enumerate(parts):
        for _ in range(2 if batch == 2 else 1):
            table.merge(spark.createDataFrame(part, CAPTURES), batch)
        so_far = spark.createDataFrame([r for p in parts[: batch + 1] for r in p], CAPTURES)
        want = sorted(tuple(r) for r in P.publish_latest(so_far).select("title", "name", "seq", "body").collect())
        assert sorted(tuple(r) for r in table.read(CAPTURES).select("title", "name", "seq", "body").collect()) == want
        assert sorted(map(tuple, table.collisions().collect())) == sorted(map(tuple, P.collisions(so_far).collect()))
    names = {}
    for r in table.replaced().orderBy("batch").collect():
        names.setdefault(r.title, []).append((r.batch, r.old_name, r.new_name))
    assert all(old != new for moves in names.values() for _, old, new in moves)
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame(rows[:1], CAPTURES), 1)
