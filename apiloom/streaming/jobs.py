"""Structured Streaming jobs over event streams. Each takes its watermark; late rows behind it are dropped.

Every windowed job is a plain DataFrame transformation, so it runs on a stream and, with the same result, on a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]


def event_stream(spark: SparkSession, folder: str, *, per_trigger: int = 1) -> DataFrame:
    """Parquet event files as a stream with a proper event-time column."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_events(events: DataFrame, *, watermark: str = "10 minutes") -> DataFrame:
    """Events without replays: an id is taken once within the watermark."""
    marked = events.withWatermark("ts", watermark)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])


def stream_error_rate(events: DataFrame, *, watermark: str = "10 minutes", window: str = "5 minutes", above: float = 0.1) -> DataFrame:
    """Agents whose share of errors in a tumbling window is above the limit."""
    g = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "agent_id")
    got = g.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return got.where(F.col("errors") > above * F.col("requests")).select(F.col("window.start").alias("start"), "agent_id", "requests", "errors")


def stream_request_rate(events: DataFrame, *, watermark: str = "10 minutes", window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Requests of each sliding window."""
    got = events.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("requests"))
    return got.select(F.col("window.start").alias("start"), "requests")


def stream_latency_histogram(events: DataFrame, *, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Cumulative latency buckets of each window, with the count and the sum."""
    parts = [F.count_if(F.col("seconds") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in LATENCY_BUCKETS]
    got = events.withWatermark("ts", watermark).groupBy(F.window("ts", window)).agg(*parts, F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("total"))
    return got.select(F.col("window.start").alias("start"), *[c for c in got.columns if c != "window"])


def slow_alert(events: DataFrame, *, watermark: str = "10 minutes", window: str = "2 minutes", above: float = 10.0) -> DataFrame:
    got = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "agent_id").agg(F.avg("seconds").alias("mean"))
    return got.where(F.col("mean") > above).select(F.col("window.start").alias("start"), "agent_id", F.round("mean", 6).alias("mean"))


def stream_active_change(events: DataFrame, *, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Started minus finished tasks of each agent and window."""
    step = F.when(F.col("event_type") == "TASK_STARTED", 1).when(F.col("event_type").isin("TASK_FINISHED", "TASK_FAILED"), -1).otherwise(0)
    got = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "agent_id").agg(F.sum(step).alias("change"))
    return got.select(F.col("window.start").alias("start"), "agent_id", "change")


def expire_history(rows: DataFrame, now, *, days: int = 7) -> DataFrame:
    return rows.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


class _Best(StatefulProcessor):
    """Keeps a count and the best score of each key, and reports after every `every` records."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "n long, score double, params string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, score, params = self.state.get() if self.state.exists() else (0, float("-inf"), "")
        out = []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            n += 1
            if r.score > score:
                score, params = float(r.score), r.params
            if n % self.every == 0:
                out.append((key[0], n, score, params))
        self.state.update((n, score, params))
        yield pd.DataFrame(out, columns=["task_id", "n", "best", "params"])

    def close(self) -> None:
        pass


def stream_feedback_best(feedback: DataFrame, *, every: int = 10) -> DataFrame:
    """(task_id, n, best, params) after every `every` records of a task: only a count and the best are kept as state."""
    return feedback.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_Best(every), outputStructType="task_id long, n long, best double, params string", outputMode="Append", timeMode="None"
    )


class _Active(StatefulProcessor):
    """The running number of started and not finished tasks of each agent, reported at each change."""

    def __init__(self, above: int):
        self.above = above

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("active", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.state.get()[0] if self.state.exists() else 0
        out = []
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for r in every.itertuples():
            step = {"TASK_STARTED": 1, "TASK_FINISHED": -1, "TASK_FAILED": -1}.get(r.event_type, 0)
            if step:
                n = max(0, n + step)
                out.append((key[0], int(r.event_id), n, n > self.above))
        self.state.update((n,))
        yield pd.DataFrame(out, columns=["agent_id", "event_id", "active", "alert"])

    def close(self) -> None:
        pass


def stream_active_tasks(events: DataFrame, *, above: int = 10) -> DataFrame:
    """(agent_id, event_id, active, alert) at each start or end of a task; the number is the state, across all batches."""
    return events.groupBy("agent_id").transformWithStateInPandas(
        statefulProcessor=_Active(above), outputStructType="agent_id string, event_id long, active long, alert boolean", outputMode="Append", timeMode="None"
    )


class _Group(StatefulProcessor):
    """The tasks of a group that have ended; the group is reported once, when all it expects have."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getMapState("ended", "task_id long", "status string")
        self.told = handle.getValueState("told", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected = 0
        for pdf in rows:
            for r in pdf.sort_values("event_id").itertuples():
                expected = int(r.expected)
                if r.status in ("success", "failed", "timeout") and not self.ended.containsKey((int(r.task_id),)):
                    self.ended.updateValue((int(r.task_id),), (r.status,))
        done = [v[0] for v in self.ended.values()]
        out = []
        if len(done) >= expected > 0 and not self.told.exists():
            self.told.update((len(done),))
            out.append((key[0], len(done), sum(x == "success" for x in done), "success" if all(x == "success" for x in done) else "partial" if "success" in done else "failed"))
        yield pd.DataFrame(out, columns=["group_id", "tasks", "succeeded", "status"])

    def close(self) -> None:
        pass


def stream_group_completion(states: DataFrame) -> DataFrame:
    """(group_id, tasks, succeeded, status) of each group, once all its `expected` tasks have ended: success, partial or
    failed. Input rows are (group_id, expected, task_id, status, event_id); a task counts with its first end."""
    return states.groupBy("group_id").transformWithStateInPandas(
        statefulProcessor=_Group(), outputStructType="group_id long, tasks long, succeeded long, status string", outputMode="Append", timeMode="None"
    )


class _Task(StatefulProcessor):
    """pending -> success, or retry up to `retries` times and then failed; a quiet task times out."""

    def __init__(self, retries: int, timeout_ms: int):
        self.retries, self.timeout_ms = retries, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, tries int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, tries = self.state.get() if self.state.exists() else ("pending", 0)
        out, last = [], 0
        for pdf in rows:
            for r in pdf.sort_values("event_id").itertuples():
                last = max(last, int(r.ts.timestamp() * 1000))
                if status in ("success", "failed", "timeout"):
                    continue
                if r.event_type == "error":
                    tries += 1
                    status = "failed" if tries > self.retries else "retry"
                else:
                    status = "success" if r.event_type == "purchase" else status
                out.append((key[0], status, tries))
        self.state.update((status, tries))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status in ("pending", "retry") and last:
            self.handle.registerTimer(last + self.timeout_ms)
        yield pd.DataFrame(out, columns=["task_id", "status", "tries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, tries = self.state.get()
        out = []
        if status in ("pending", "retry"):
            self.state.update(("timeout", tries))
            out.append((key[0], "timeout", tries))
        yield pd.DataFrame(out, columns=["task_id", "status", "tries"])

    def close(self) -> None:
        pass


def stream_task_state(events: DataFrame, *, retries: int = 3, timeout_seconds: int = 300, watermark: str = "10 minutes") -> DataFrame:
    """Status changes of tasks keyed by `task_id`, with time-outs by event time."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("task_id")
        .transformWithStateInPandas(statefulProcessor=_Task(retries, timeout_seconds * 1000), outputStructType="task_id long, status string, tries int", outputMode="Append", timeMode="EventTime")
    )


class _History(StatefulProcessor):
    """The records of each agent within a number of days of event time; older ones leave the state, and a timer clears the
    state of an agent that has been quiet for so long."""

    def __init__(self, days: int):
        self.span = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", "event_id long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.records.get()] if self.records.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            at = r.ts.value // 1_000_000
            held = [x for x in held if x[1] >= at - self.span] + [(int(r.event_id), at)]
            out.append((key[0], int(r.event_id), len(held)))
        self.records.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at for _, at in held) + self.span + 1)
        yield pd.DataFrame(out, columns=["agent_id", "event_id", "kept"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.records.clear()
        yield pd.DataFrame([(key[0], None, 0)], columns=["agent_id", "event_id", "kept"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def stream_history(events: DataFrame, *, days: int = 7, watermark: str = "1 hour") -> DataFrame:
    """(agent_id, event_id, kept): how many records of the last `days` an agent has with each new one; a row without an
    event and with 0 when the watermark shows that all of them are older. What is older leaves the state."""
    return events.withWatermark("ts", watermark).groupBy("agent_id").transformWithStateInPandas(
        statefulProcessor=_History(days), outputStructType="agent_id string, event_id long, kept long", outputMode="Append", timeMode="EventTime"
    )


class _BestOnRequest(StatefulProcessor):
    """Keeps a count and the best score of each task, and answers requests once there are enough records."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "n long, score double, params string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = initialState.sort_values("score").iloc[-1]
        self.state.update((int(initialState["n"].sum()), float(known["score"]), known["params"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, score, params = self.state.get() if self.state.exists() else (0, float("-inf"), "")
        out = []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            if r.kind != "request":
                n += 1
                if r.score > score:
                    score, params = float(r.score), r.params
            elif n >= self.least:
                out.append((key[0], int(r.event_id), n, score, params))
        self.state.update((n, score, params))
        yield pd.DataFrame(out, columns=["task_id", "event_id", "n", "best", "params"])

    def close(self) -> None:
        pass


def stream_best_on_request(events: DataFrame, *, least: int = 3, known: DataFrame | None = None) -> DataFrame:
    """(task_id, event_id, n, best, params) for each request of a task that has `least` records by then; others get no row.

    Events have task_id, event_id, kind (`request` or feedback), score and params; `known` (task_id, n, score, params) is
    what a former run knew, the state to begin with."""
    return events.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_BestOnRequest(least),
        outputStructType="task_id string, event_id long, n long, best double, params string",
        outputMode="Append",
        timeMode="None",
        initialState=known.groupBy("task_id") if known is not None else None,
    )
