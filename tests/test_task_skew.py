"""Joins on output paths: tasks without a path are dealt out like the others."""

from pyspark.sql import functions as F

from corpusloom.operators import tasks as K


def _tasks(spark, n):
    done = F.col("id") % 4 == 0
    return spark.range(n).select(
        F.col("id").alias("task_id"), F.when(done, "success").otherwise("running").alias("status"), F.lit("").alias("stage"),
        F.when(done & (F.col("id") > 0), F.concat(F.lit("out/"), F.col("id"))).otherwise("").alias("output_path"),
    )


def _largest_share(rows):
    parts = [r["__part"] for r in rows.withColumn("__part", F.spark_partition_id()).collect()]
    return max(parts.count(p) for p in set(parts)) / len(parts)


def test_blank_paths_do_not_meet_in_one_task(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = _tasks(spark, 4000)
        files = spark.range(0, 4000, 8).select(F.concat(F.lit("out/"), F.col("id")).alias("path"))
        moves = spark.range(0, 4000, 8).select(F.concat(F.lit("out/"), F.col("id")).alias("old_path"), F.concat(F.lit("new/"), F.col("id")).alias("new_path"))
        for rows in (K.refresh(tasks, files), K.repair_outputs(tasks, moves)):
            assert rows.count() == 4000
            assert _largest_share(rows) < 0.4
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_paths_decide_only_for_successes(spark):
    tasks = spark.createDataFrame(
        [(1, "success", "s", "a"), (2, "success", "s", "b"), (3, "success", "s", ""), (4, "failed", "s", "a"), (5, "pending", "s", ""), (6, "success", "s", None)],
        "task_id bigint, status string, stage string, output_path string",
    )
    files = spark.createDataFrame([("a",), ("a",), ("",)], "path string")
    moves = spark.createDataFrame([("a", "x"), ("", "y")], "old_path string, new_path string")
    state = lambda rows: {r.task_id: (r.status, r.output_path) for r in rows.collect()}
    assert state(K.refresh(tasks, files)) == {
        1: ("success", "a"), 2: ("pending", ""), 3: ("pending", ""), 4: ("failed", "a"), 5: ("pending", ""), 6: ("pending", "")}
    assert set(state(K.missing_outputs(tasks, files))) == {2, 6}
    assert set(state(K.except_done(tasks, files))) == {2, 4, 5, 6}
    assert {k: v[1] for k, v in state(K.repair_outputs(tasks, moves)).items()} == {1: "x", 2: "b", 3: "y", 4: "a", 5: "", 6: None}


def test_a_resumed_run_joins_the_ids_once(spark):
    tasks = _tasks(spark, 40).withColumns({c: F.lit("") for c in ("error_code", "error_message")}).withColumn("finished_at", F.lit(None).cast("timestamp"))
    files, ids = spark.createDataFrame([("out/8",)], "path string"), spark.range(0, 40, 2).select(F.col("id").alias("task_id"))
    state, work = K.plan_run(tasks, files, ids, resume=True, retry_failed=True)
    assert state.columns == tasks.columns and work.columns == tasks.columns
    assert [r.task_id for r in work.collect()] == [k for k in range(0, 40, 2) if k != 8]
    assert {r.task_id for r in state.where("status = 'running'").collect()} == {k for k in range(1, 40, 2)}
    assert work._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
