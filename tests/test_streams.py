"""Streaming jobs over a file source, compared with the same job on the whole table."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from apiloom.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.union(rows.limit(50)).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)
    return path


def run(spark, frame, name, tmp_path, mode="append"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def batch(spark, folder):
    return spark.read.schema(jobs.EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def shaped(events):
    return jobs.stream_events(events).withColumn("agent_id", (F.col("user_id") % 5).cast("string")).withColumn("seconds", F.col("value") / 10)


def test_windows_match_the_batch(spark, folder, tmp_path):
    stream = jobs.stream_request_rate(jobs.event_stream(spark, folder, per_trigger=50), window="1 day", slide="1 day", watermark="1 hour")
    got = {r["start"]: r["requests"] for r in run(spark, stream, "rate", tmp_path).collect()}
    want = {r["start"]: r["requests"] for r in jobs.stream_request_rate(batch(spark, folder), window="1 day", slide="1 day").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 1


def test_replays_are_dropped(spark, folder, tmp_path):
    got = run(spark, jobs.stream_events(jobs.event_stream(spark, folder), watermark="30 days"), "once", tmp_path)
    assert got.count() == got.select("event_id").distinct().count() == batch(spark, folder).select("event_id").distinct().count()


def test_alert_jobs_run(spark, folder):
    rows = shaped(batch(spark, folder))
    assert jobs.stream_error_rate(rows, window="1 day").count() > 0
    h = jobs.stream_latency_histogram(rows, window="1 day").first()
    assert h["le_0_1"] <= h["le_0_5"] <= h["le_10_0"] <= h["n"]
    assert jobs.slow_alert(rows, window="1 day", above=0.0).count() > 0


@pytest.fixture(scope="module")
def ordered(spark, sf, tmp_path_factory):
    """Events in files by time, one file a batch, without replays."""
    path = str(tmp_path_factory.mktemp("ordered"))
    rows = spark.read.parquet(f"{sf}/events.parquet")
    day = F.dayofmonth("ts")
    for low, high in ((1, 8), (9, 16), (17, 24), (25, 31)):
        rows.where(day.between(low, high)).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return path


def test_feedback_best_equals_a_fold(spark, ordered, tmp_path):
    events = jobs.event_stream(spark, ordered)
    feedback = events.select(F.col("user_id").alias("task_id"), "event_id", F.col("value").alias("score"), F.col("props").alias("params"))
    got = sorted(tuple(r) for r in run(spark, jobs.stream_feedback_best(feedback, every=5), "best", tmp_path).collect())
    want, state = [], {}
    for r in batch(spark, ordered).orderBy("ts", "event_id").collect():
        n, score, params = state.get(r["user_id"], (0, float("-inf"), ""))
        state[r["user_id"]] = (n + 1, *((r["value"], r["props"]) if r["value"] > score else (score, params)))
        if (n + 1) % 5 == 0:
            want.append((r["user_id"], *state[r["user_id"]]))
    assert got == sorted(want) and got


def test_active_tasks_equal_a_fold(spark, ordered, tmp_path):
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "TASK_STARTED", "click": "TASK_STARTED", "purchase": "TASK_FINISHED", "error": "TASK_FAILED"}.items() for x in kv])
    shape = lambda e: e.select("event_id", "ts", (F.col("user_id") % 7).cast("string").alias("agent_id"), F.coalesce(kinds[F.col("event_type")], F.lit("other")).alias("event_type"))
    got = sorted(tuple(r) for r in run(spark, jobs.stream_active_tasks(shape(jobs.event_stream(spark, ordered)), above=3), "active", tmp_path).collect())
    want, n = [], {}
    for r in shape(batch(spark, ordered)).orderBy("ts", "event_id").collect():
        step = {"TASK_STARTED": 1, "TASK_FINISHED": -1, "TASK_FAILED": -1}.get(r["event_type"], 0)
        if step:
            n[r["agent_id"]] = max(0, n.get(r["agent_id"], 0) + step)
            want.append((r["agent_id"], r["event_id"], n[r["agent_id"]], n[r["agent_id"]] > 3))
    assert got == sorted(want) and any(a for *_, a in got) and not all(a for *_, a in got)


def test_groups_complete_once(spark, tmp_path):
    path = str(tmp_path / "group_rows")
    rows = [(1, 2, 10, "success", 1), (1, 2, 11, "retry", 2), (2, 1, 20, "failed", 3), (1, 2, 11, "failed", 4), (1, 2, 10, "failed", 5), (3, 2, 30, "success", 6), (1, 2, 12, "success", 7), (4, 2, 40, "success", 8), (4, 2, 41, "success", 9)]
    frame = spark.createDataFrame(rows, "group_id long, expected int, task_id long, status string, event_id long")
    for k in range(3):
        frame.where(f"event_id % 3 = {(k + 1) % 3} and event_id > 0").coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["group_id"]: (r["tasks"], r["succeeded"], r["status"]) for r in run(spark, jobs.stream_group_completion(stream), "groups", tmp_path).collect()}
    assert set(got) == {1, 2, 4} and got[2] == (1, 0, "failed") and got[4] == (2, 2, "success") and got[1][2] == "partial"


def test_task_states_and_time_outs(spark, tmp_path):
    path = str(tmp_path / "states")
    at = lambda m: f"2024-01-01 00:{m:02}:00"
    waves = [[(1, at(0), 1, "view"), (2, at(0), 2, "error"), (3, at(1), 3, "view"), (4, at(1), 3, "purchase")], [(5, at(20), 4, "view")], [(6, at(40), 4, "view")], [(7, at(59), 5, "view")]]
    for wave in waves:
        rows = spark.createDataFrame(wave, "event_id long, ts string, task_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    got = run(spark, jobs.stream_task_state(stream, retries=1, timeout_seconds=300, watermark="1 minute"), "state", tmp_path).collect()
    last = {}
    for r in got:
        last.setdefault(r["task_id"], []).append(r["status"])
    assert last[1][-1] == "timeout" and last[2] == ["retry", "timeout"] and last[3] == ["pending", "success"] and "timeout" not in last[3]


def requests(events):
    kind = F.when(F.col("event_id") % 4 == 0, "request").otherwise("feedback")
    return events.select((F.col("user_id") % 40).cast("string").alias("task_id"), "event_id", kind.alias("kind"), F.col("value").alias("score"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("params"))


def answers(rows, known):
    state, out = {k: v for k, v in known.items()}, []
    for task, event, kind, score, params in rows:
        n, best, held = state.get(task, (0, float("-inf"), ""))
        if kind == "request":
            out += [(task, event, n, best, held)] if n >= 3 else []
        else:
            state[task] = (n + 1, score, params) if score > best else (n + 1, best, held)
    return out


def test_requests_are_answered_from_three_records_on(spark, ordered, tmp_path):
    known = {"1": (1, 1e9, "old"), "nobody": (5, 1.0, "x")}
    frame = spark.createDataFrame([(k, *v) for k, v in known.items()], "task_id string, n long, score double, params string")
    rows = requests(jobs.event_stream(spark, ordered, per_trigger=1))
    got = run(spark, jobs.stream_best_on_request(rows, known=frame), "asked", tmp_path)
    events = [tuple(r) for r in requests(batch(spark, ordered).orderBy("ts", "event_id")).collect()]
    files = [sorted((tuple(r) for r in requests(batch(spark, ordered).where(F.dayofmonth("ts").between(a, b))).collect()), key=lambda r: r[1]) for a, b in ((1, 8), (9, 16), (17, 24), (25, 31))]
    want = answers([r for f in files for r in f], known)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) < sum(r[2] == "request" for r in events)


def test_old_records_leave_the_state_and_a_restart_goes_on(spark, ordered, tmp_path):
    files = sorted(glob.glob(f"{ordered}/*.parquet"), key=lambda f: spark.read.schema(jobs.EVENTS).parquet(f).agg(F.min("ts")).first()[0])
    feed = tmp_path / "feed"
    feed.mkdir()
    shaped_ = lambda events: events.select((F.col("user_id") % 5).cast("string").alias("agent_id"), "event_id", "ts")
    for turn, some in enumerate((files[:2], files[2:])):  # the second run restarts from the first one's checkpoint
        for i, f in enumerate(some):
            shutil.copy(f, feed / f"{turn}{i}.parquet")
            os.utime(feed / f"{turn}{i}.parquet", (1_700_000_000 + 100 * turn + i,) * 2)  # files are read by age
        stream = jobs.stream_history(shaped_(jobs.event_stream(spark, str(feed), per_trigger=1)), days=7)
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    got = {r["event_id"]: r["kept"] for r in spark.read.parquet(str(tmp_path / "out")).where("event_id IS NOT NULL").collect()}
    by = {}
    for r in shaped_(batch(spark, ordered)).withColumn("at", F.unix_millis("ts")).collect():
        by.setdefault(r["agent_id"], []).append((r["at"], r["event_id"]))
    want = {}
    for rows in by.values():
        rows.sort()
        want |= {e: sum(at - 7 * 86_400_000 <= x for x, _ in rows[: i + 1]) for i, (at, e) in enumerate(rows)}
    assert got == want
    last = max(rows[-1][0] for rows in by.values())
    assert max(want.values()) < max(map(len, by.values())) and last  # something has left
