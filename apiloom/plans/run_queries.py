"""Registered queries over tool-call logs and experiment runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiloom.operators import runs
from apiloom.plans.views import LOGS, REGISTRY, TASKS, logs, registry, tasks

METRICS = """
metrics AS (
  SELECT l.task_id, l.model, count(*) AS tool_calls_total, count(*) FILTER (l.status = 'invalid_tool') AS hallucination_errors,
         count(*) FILTER (l.status = '500') AS injected_errors, count(*) FILTER (l.status = '500' AND f.agent_id IS NOT NULL) AS recovered_errors
  FROM logs l LEFT JOIN (SELECT DISTINCT task_id, model, agent_id FROM logs WHERE status = 'ok') f
    ON l.task_id = f.task_id AND l.model = f.model AND l.agent_id = f.agent_id
  GROUP BY l.task_id, l.model
), ran AS (
  SELECT task_id, model, list(agent_id ORDER BY t0, e) AS executed_agents FROM (
    SELECT task_id, model, agent_id, min(timestamp_ms) AS t0, arg_min(event_id, (timestamp_ms, event_id)) AS e FROM logs WHERE status = 'ok' GROUP BY ALL
  ) GROUP BY ALL
), spent AS (
  SELECT task_id, model, max(timestamp_ms) - min(timestamp_ms) AS duration_ms, sum(CAST(floor(value) AS BIGINT)) AS tokens_total,
         CASE WHEN count(*) FILTER (status = '500') * 4 > count(*) THEN 'server' ELSE 'none' END AS error_type
  FROM logs GROUP BY ALL
), compat AS (
  SELECT task_id, CASE WHEN list_has_all((SELECT list(agent_id) FROM registry), expected_agents) THEN 1 ELSE 0 END AS compatible FROM tasks
), runs AS (
  SELECT m.*, t.level, t.expected_agents, coalesce(r.executed_agents, []) AS executed_agents, s.duration_ms, s.tokens_total, s.error_type, c.compatible,
         len(list_intersect(list_distinct(t.expected_agents), coalesce(r.executed_agents, []))) / len(list_distinct(t.expected_agents)) AS coverage
  FROM metrics m JOIN tasks t USING (task_id) JOIN spent s USING (task_id, model) JOIN compat c USING (task_id) LEFT JOIN ran r USING (task_id, model)
), rows AS (
  SELECT *, CASE WHEN coverage >= 0.5 AND error_type = 'none' THEN 1 ELSE 0 END AS success FROM runs
)"""
BASE = f"WITH {LOGS}, {REGISTRY}, {TASKS}, {METRICS}"


def run_rows(spark, d):
    """One row for each (task, model) with all that the summary needs."""
    log, todo = logs(spark, d), tasks(spark, d)
    spent = log.groupBy("task_id", "model").agg(
        (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"),
        F.sum(F.floor("value").cast("long")).alias("tokens_total"),
        F.when(F.count_if(F.col("status") == "500") * 4 > F.count("*"), "server").otherwise("none").alias("error_type"),
    )
    rows = runs.task_tool_metrics(log).join(spent, runs.RUN).join(runs.executed_agents(log), runs.RUN, "left")
    rows = rows.join(todo, "task_id").join(runs.compatibility(todo, registry(spark)), "task_id")
    return runs.run_success(rows.withColumn("executed_agents", F.coalesce("executed_agents", F.array().cast("array<string>"))))


def _calls(spark, d):
    log = logs(spark, d)
    reported = F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("long"))
    return log.select("task_id", F.col("event_id").alias("ord"), "layer", reported.alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), F.ceil(F.length("agent_id") / 4).alias("prompt_estimate"), F.ceil(F.length("layer") / 4).alias("completion_estimate"))


def _results(spark, d):
    return logs(spark, d).select(
        (F.col("status") == "ok").alias("success"),
        (F.col("value") / 10).alias("execution_time"),
        F.concat(F.lit("failed in Agent["), "agent_id", F.lit("]")).alias("error"),
        F.col("error_type").alias("issue"),
        F.col("task_id").alias("group_id"),
        F.col("event_id").alias("ord"),
    )


def _answers(spark, d):
    return logs(spark, d).select("task_id", F.col("agent_id").alias("answer"), "value", F.col("event_id").alias("ord"))


QUERIES = {
    "recovered_errors": lambda s, d: runs.recovered_errors(logs(s, d)).select("event_id", "task_id", "model", "agent_id"),
    "hallucinated_calls": lambda s, d: runs.hallucinated_calls(logs(s, d), registry(s)).select("event_id", "task_id", "agent_id"),
    "task_tool_metrics": lambda s, d: runs.task_tool_metrics(logs(s, d)),
    "executed_agents": lambda s, d: runs.executed_agents(logs(s, d)).select("task_id", "model", F.array_join("executed_agents", ",").alias("executed_agents")),
    "compatibility": lambda s, d: runs.compatibility(tasks(s, d), registry(s)),
    "run_success": lambda s, d: run_rows(s, d).select("task_id", "model", F.round("coverage", 6).alias("coverage"), "success"),
    "summarize_runs": lambda s, d: runs.summarize_runs(run_rows(s, d)),
    "error_type_pivot": lambda s, d: runs.error_type_pivot(logs(s, d), ["server", "unknown_tool"]),
    "token_usage": lambda s, d: runs.token_usage(_calls(s, d)).withColumn("layers", F.array_join("layers", ",")),
    "evaluation_summary": lambda s, d: runs.evaluation_summary(_results(s, d)),
    "failing_agents": lambda s, d: runs.failing_agents(_results(s, d)).withColumn("issues", F.array_join("issues", ",")),
    "level_distribution": lambda s, d: runs.level_distribution(tasks(s, d)),
    "order_tasks": lambda s, d: runs.order_tasks(tasks(s, d)).select("task_id", "level", F.col("position").cast("long").alias("position")),
    "aggregate_runs": lambda s, d: runs.aggregate_runs(_answers(s, d)),
    "reduce_results": lambda s, d: runs.reduce_results(_results(s, d)),
}

RESULTS = "results AS (SELECT status = 'ok' AS success, value / 10 AS execution_time, 'failed in Agent[' || agent_id || ']' AS error, error_type AS issue, task_id AS group_id, event_id AS ord, agent_id FROM logs)"
SQL = {
    "recovered_errors": f"WITH {LOGS} SELECT event_id, task_id, model, agent_id FROM logs l WHERE status = '500' AND EXISTS (SELECT 1 FROM logs o WHERE o.status = 'ok' AND o.task_id = l.task_id AND o.model = l.model AND o.agent_id = l.agent_id)",
    "hallucinated_calls": f"WITH {LOGS}, {REGISTRY} SELECT event_id, task_id, agent_id FROM logs WHERE agent_id NOT IN (SELECT agent_id FROM registry)",
    "task_tool_metrics": f"{BASE} SELECT task_id, model, tool_calls_total, hallucination_errors, injected_errors, recovered_errors FROM metrics",
    "executed_agents": f"{BASE} SELECT task_id, model, array_to_string(executed_agents, ',') AS executed_agents FROM ran",
    "compatibility": f"{BASE} SELECT task_id, compatible FROM compat",
    "run_success": f"{BASE} SELECT task_id, model, round(coverage, 6) AS coverage, success FROM rows",
    "summarize_runs": f"""{BASE} SELECT model, level, count(*) AS n_tasks, round(avg(success), 4) AS success_rate, round(avg(tokens_total), 2) AS avg_tokens_total,
        round(sum(hallucination_errors) / greatest(1, sum(tool_calls_total)), 4) AS hallucination_rate, round(sum(recovered_errors) / greatest(1, sum(injected_errors)), 4) AS recovery_rate,
        round(avg(duration_ms), 2) AS avg_duration_ms, round(avg(tool_calls_total), 2) AS avg_tool_calls, round(avg(compatible), 4) AS compatibility_rate FROM rows GROUP BY model, level""",
    "error_type_pivot": f"WITH {LOGS} SELECT model, count(*) FILTER (error_type = 'server') AS server, count(*) FILTER (error_type = 'unknown_tool') AS unknown_tool FROM logs WHERE error_type != 'none' GROUP BY model",
    "token_usage": f"""WITH {LOGS} SELECT task_id, CAST(sum(coalesce(CASE WHEN event_id % 3 != 0 THEN CAST(floor(value) AS BIGINT) END, CAST(ceil(length(agent_id) / 4) AS BIGINT))) AS BIGINT) AS prompt_tokens,
        CAST(sum(CAST(ceil(length(layer) / 4) AS BIGINT)) AS BIGINT) AS completion_tokens, count(*) AS calls, string_agg(layer, ',' ORDER BY event_id) AS layers FROM logs GROUP BY task_id""",
    "evaluation_summary": f"WITH {LOGS}, {RESULTS} SELECT count(*) AS total, count(*) FILTER (success) AS passed, round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(execution_time), 6) AS avg_execution_time FROM results",
    "failing_agents": f"WITH {LOGS}, {RESULTS} SELECT agent_id, count(*) AS failures, array_to_string(list_sort(list(DISTINCT issue)), ',') AS issues FROM results WHERE NOT success GROUP BY agent_id HAVING count(*) > 2",
    "level_distribution": f"WITH {TASKS} SELECT level, count(*) AS n_tasks FROM tasks GROUP BY level",
    "order_tasks": f"WITH {TASKS} SELECT task_id, level, row_number() OVER (ORDER BY level, task_id) AS position FROM tasks",
    "aggregate_runs": f"""WITH {LOGS}, v AS (SELECT task_id, agent_id, count(*) AS n, min(event_id) AS f FROM logs GROUP BY ALL), m AS (SELECT task_id, arg_max(agent_id, (n, -f)) AS majority FROM v GROUP BY ALL)
        SELECT task_id, arg_max(value, event_id) AS last, round(avg(value), 6) AS mean, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, count(*) AS runs, any_value(majority) AS majority FROM logs JOIN m USING (task_id) GROUP BY task_id""",
    "reduce_results": f"""WITH {LOGS}, {RESULTS} SELECT group_id, count(*) AS total, count(*) FILTER (success) AS succeeded, round(avg(CAST(success AS INT)), 6) AS success_rate,
        coalesce(string_agg(error, '; ' ORDER BY ord) FILTER (NOT success), '') AS errors FROM results GROUP BY group_id""",
}
