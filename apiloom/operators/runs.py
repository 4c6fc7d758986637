"""Tool-call logs and experiment runs: per-run metrics, summaries and the agents to fix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ["task_id", "model"]


def hallucinated_calls(logs: DataFrame, registry: DataFrame) -> DataFrame:
    """Log rows whose agent is not in the registry (a null agent is not in it)."""
    return logs.join(registry.select("agent_id").distinct(), "agent_id", "left_anti")


def recovered_errors(logs: DataFrame) -> DataFrame:
    """Rows with status 500 whose agent also has an `ok` row in the same run."""
    fine = logs.where("status = 'ok'").select(*RUN, "agent_id").distinct()
    return logs.where("status = '500'").join(fine, [*RUN, "agent_id"], "left_semi")


def task_tool_metrics(logs: DataFrame) -> DataFrame:
    """Calls, unknown-tool calls, injected errors and recovered ones of each run.

    One shuffle by run and agent: each agent's counts tell whether its errors recovered, and a run adds up its agents.
    """
    agent = logs.groupBy(*RUN, "agent_id").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "invalid_tool").alias("unknown"),
        F.count_if(F.col("status") == "500").alias("injected"),
        F.max(F.col("status") == "ok").alias("fine"),
    )
    return agent.groupBy(*RUN).agg(
        F.sum("calls").alias("tool_calls_total"),
        F.sum("unknown").alias("hallucination_errors"),
        F.sum("injected").alias("injected_errors"),
        F.sum(F.when(F.col("fine"), F.col("injected")).otherwise(0)).alias("recovered_errors"),
    )


def executed_agents(logs: DataFrame) -> DataFrame:
    """The distinct agents of each run that ended well, in the order of their first call."""
    first = logs.where("status = 'ok'").groupBy(*RUN, "agent_id").agg(F.min(F.struct("timestamp_ms", "event_id")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "agent_id")))
    return first.groupBy(*RUN).agg(F.transform(ordered, lambda x: x["agent_id"]).alias("executed_agents"))


def run_success(runs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Adds coverage (share of the expected agents that ran) and success; runs have expected, executed and error_type."""
    want = F.array_distinct("expected_agents")
    coverage = F.when(F.size(want) > 0, F.size(F.array_intersect(want, "executed_agents")) / F.size(want)).otherwise(0.0)
    return runs.withColumn("coverage", coverage).withColumn("success", ((F.col("coverage") >= threshold) & (F.col("error_type") == "none")).cast("int"))


def compatibility(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """1 for tasks whose expected agents are all registered; a task without expected agents is compatible."""
    wanted = tasks.select("task_id", F.explode("expected_agents").alias("agent_id"))
    missing = wanted.join(registry.select("agent_id").distinct(), "agent_id", "left_anti").select("task_id").distinct()
    return tasks.join(missing.withColumn("lost", F.lit(1)), "task_id", "left").select("task_id", F.when(F.col("lost").isNull(), 1).otherwise(0).alias("compatible"))


def summarize_runs(rows: DataFrame) -> DataFrame:
    """One row for each (model, level): rates to four places, averages to two."""
    share = lambda a, b: F.round(F.sum(a) / F.greatest(F.lit(1), F.sum(b)), 4)
    return rows.groupBy("model", "level").agg(
        F.count("*").alias("n_tasks"),
        F.round(F.avg("success"), 4).alias("success_rate"),
        F.round(F.avg("tokens_total"), 2).alias("avg_tokens_total"),
        share("hallucination_errors", "tool_calls_total").alias("hallucination_rate"),
        share("recovered_errors", "injected_errors").alias("recovery_rate"),
        F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
        F.round(F.avg("tool_calls_total"), 2).alias("avg_tool_calls"),
        F.round(F.avg("compatible"), 4).alias("compatibility_rate"),
    )


def error_type_pivot(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of each error kind by model; `none` is left out. Kinds are given, so the pivot needs no extra pass."""
    return rows.where("error_type != 'none'").groupBy("model").pivot("error_type", kinds).count().fillna(0)


def token_usage(calls: DataFrame) -> DataFrame:
    """Prompt and completion tokens of each task, with the estimate where no count was reported, and its layers."""
    return calls.groupBy("task_id").agg(
        F.sum(F.coalesce("prompt_tokens", "prompt_estimate")).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", "completion_estimate")).alias("completion_tokens"),
        F.count("*").alias("calls"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "layer"))), lambda x: x["layer"]).alias("layers"),
    )


def evaluation_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0)).alias("passed"),
        F.round(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.coalesce(F.avg("execution_time"), F.lit(0.0)), 6).alias("avg_execution_time"),
    )


def failing_agents(results: DataFrame, *, more_than: int = 2) -> DataFrame:
    """Agents named as `Agent[id]` in failed tests, with more than `more_than` failures, and their distinct issues."""
    failed = results.where("not success").select(F.regexp_extract("error", r"Agent\[([^\]]+)\]", 1).alias("agent_id"), "issue").where("agent_id != ''")
    return failed.groupBy("agent_id").agg(F.count("*").alias("failures"), F.array_sort(F.collect_set("issue")).alias("issues")).where(F.col("failures") > more_than)


def level_distribution(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("level").agg(F.count("*").alias("n_tasks"))


def order_tasks(tasks: DataFrame) -> DataFrame:
    """All tasks by level and id, numbered from 1: ranks within a level plus the sizes of lower levels."""
    sizes = tasks.groupBy("level").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("task_id"))
    return tasks.withColumn("rank", rank).join(F.broadcast(before.select("level", "before")), "level").withColumn("position", F.col("rank") + F.col("before")).drop("rank", "before")


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Repeated runs of a task in one row: last, mean, majority (first seen of equals), sum, min, max and all values."""
    value = runs.groupBy("task_id", "answer").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    major = value.groupBy("task_id").agg(F.max_by("answer", F.struct("n", -F.col("first"))).alias("majority"))
    rest = runs.groupBy("task_id").agg(
        F.max_by("value", "ord").alias("last"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.sum("value"), 6).alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("*").alias("runs"),
    )
    return rest.join(major, "task_id")


def reduce_results(results: DataFrame) -> DataFrame:
    """Per group: how many subtasks succeeded, the share, and the error text of the others in order."""
    errors = F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct("ord", F.coalesce("error", F.lit("unknown error")).alias("text")))))
    return results.groupBy("group_id").agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("succeeded"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.array_join(F.transform(errors, lambda x: x["text"]), "; ").alias("errors"),
    )
