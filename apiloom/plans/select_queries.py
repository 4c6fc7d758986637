"""Registered queries of ranking, selection and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiloom.operators import select as S
from apiloom.plans.views import table


def candidates(s, d):
    """`events` as candidate prompts: run = event type, iteration = day of month modulo 6 + 1, prompt = user modulo 12."""
    return table(s, d, "events").select(
        F.col("event_type").alias("run"),
        (F.dayofmonth("ts") % 6 + 1).cast("int").alias("iteration"),
        F.col("event_id").cast("int").alias("idx"),
        F.concat(F.lit("prompt "), (F.col("user_id") % 12).cast("string"), F.lit(" of "), F.col("event_type")).alias("prompt"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("score"),
        F.round(F.col("value") * 2, 6).alias("cost"),
    )


CANDIDATES = "cand AS (SELECT event_type AS run, CAST(day(ts) % 6 + 1 AS INT) AS iteration, CAST(event_id AS INT) AS idx, 'prompt ' || (user_id % 12) || ' of ' || event_type AS prompt, round(least(value / 100, 1.0), 6) AS score, round(value * 2, 6) AS cost FROM events)"


def history(s, d):
    """Mean score of each user's days, as optimisation runs."""
    e = table(s, d, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("run"), F.dayofmonth("ts").alias("iteration")).agg(F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 10000, 6).alias("score"))


HISTORY = "hist AS (SELECT CAST(user_id AS VARCHAR) AS run, CAST(day(ts) AS INT) AS iteration, round(sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 10000, 6) AS score FROM events GROUP BY ALL)"


def rules(s, d):
    return table(s, d, "events").select(
        F.col("event_type").alias("type"),
        F.concat(F.lit("pattern "), (F.col("user_id") % 40).cast("string")).alias("pattern"),
        F.get_json_object("props", "$.k").alias("action"),
        F.round(F.least(F.col("value") / 200, F.lit(1.0)), 4).alias("value"),
        ((F.col("event_id") % 100) / 100).alias("confidence"),
        ((F.col("event_id") % 7) / 7).alias("age"),
        F.col("event_id").alias("ord"),
    )


RULES = "rules AS (SELECT event_type AS type, 'pattern ' || (user_id % 40) AS pattern, json_extract_string(props, '$.k') AS action, round(least(value / 200, 1.0), 4) AS value, (event_id % 100) / 100 AS confidence, (event_id % 7) / 7 AS age, event_id AS ord FROM events)"


def _relations(s, d):
    kind = F.element_at(F.array(F.lit("LLM_GUESS"), F.lit("FIELD_REFERENCE"), F.lit("PATH_HIERARCHY")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), kind.alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.round(1 - F.col("l_discount"), 6).alias("score")
    )


RELATIONS = "rel AS (SELECT l_suppkey AS source, l_partkey % 50 AS target, ['LLM_GUESS', 'FIELD_REFERENCE', 'PATH_HIERARCHY'][l_linenumber % 3 + 1] AS type, l_orderkey * 10 + l_linenumber AS ord, round(1 - l_discount, 6) AS score FROM lineitem)"


def _quota(s, d):
    e = table(s, d, "events")
    return S.quota_fill(e.select(F.dayofmonth("ts").alias("round"), F.col("event_id").alias("idx"), ((F.dayofmonth("ts") % 10) / 10).alias("round_score")), 0.7)


def _applicable(s, d):
    r = rules(s, d).withColumn("conditions", F.create_map(F.lit("k"), F.col("action"), F.lit("other"), F.col("pattern")))
    return S.applicable_rules(r, {"k": "42"}).select("type", "ord", "confidence", "rank")


def _weighted(s, d):
    scores = table(s, d, "events").select((F.col("user_id") % 12).cast("string").alias("prompt"), F.col("event_type").alias("task"), F.round(F.col("value") * 100).cast("long").alias("score"))
    weights = table(s, d, "events").select(F.col("event_type").alias("task")).distinct().withColumn("weight", F.length("task"))
    return S.weighted_task_score(scores, weights)


CUT = ["run", "iteration", "idx", "rank"]
QUERIES = {
    "dedupe_relations": lambda s, d: S.dedupe_relations(_relations(s, d)).select("source", "target", "type", "ord"),
    "dedupe_dependencies": lambda s, d: S.dedupe_dependencies(_relations(s, d).withColumnsRenamed({"source": "src", "target": "dst"})).select("src", "dst", "score", "ord"),
    "top_tables_per_entity": lambda s, d: S.top_per_key(_relations(s, d), "target", "score", 3, "ord").select("target", "source", "score", "rank"),
    "select_top_k": lambda s, d: S.select_top_k(candidates(s, d), 5).select(*CUT),
    "ucb_select": lambda s, d: S.ucb_select(candidates(s, d), 5).select(*CUT, F.round("ucb", 6).alias("ucb")),
    "diversity_select": lambda s, d: S.diversity_select(candidates(s, d), 5),
    "ensemble_select": lambda s, d: S.ensemble_select(candidates(s, d), ["score", "cost"], 5).select(*CUT),
    "adaptive_select": lambda s, d: S.adaptive_select(candidates(s, d), 6, 5),
    "early_stop_point": lambda s, d: S.early_stop_point(history(s, d)),
    "running_best": lambda s, d: S.running_best(history(s, d)),
    "discounted_returns": lambda s, d: S.discounted_returns(history(s, d).select(F.col("run").alias("episode"), F.col("iteration").cast("long").alias("t"), F.floor(F.col("score") * 100).cast("double").alias("reward")), 0.5),
    "quota_fill": _quota,
    "resolve_rules": lambda s, d: S.resolve_rules(rules(s, d)).select("type", "pattern", "action", "ord"),
    "applicable_rules": _applicable,
    "best_parameters": lambda s, d: S.best_parameters(candidates(s, d).select(F.col("run").alias("task_id"), "score", F.col("prompt").alias("params"), F.col("idx").alias("ord"))),
    "weighted_task_score": _weighted,
}

PICK = "SELECT run, iteration, idx, CAST(rank AS INT) AS rank"
SQL = {
    "dedupe_relations": f"WITH {RELATIONS} SELECT source, target, type, ord FROM rel QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY CASE WHEN type LIKE 'LLM%' THEN 3 WHEN type LIKE 'FIELD%' THEN 2 ELSE 1 END DESC, ord) = 1",
    "dedupe_dependencies": f"WITH {RELATIONS} SELECT source AS src, target AS dst, score, ord FROM rel QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY score DESC, ord) = 1",
    "top_tables_per_entity": f"WITH {RELATIONS} SELECT target, source, score, CAST(row_number() OVER (PARTITION BY target ORDER BY score DESC, ord) AS INT) AS rank FROM rel QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, ord) <= 3",
    "select_top_k": f"WITH {CANDIDATES} {PICK} FROM (SELECT *, row_number() OVER (PARTITION BY run, iteration ORDER BY score DESC, idx DESC) AS rank FROM cand) WHERE rank <= 5",
    "ucb_select": f"""WITH {CANDIDATES}, u AS (SELECT *, round(avg(score) OVER w + 1.414 * sqrt(ln(iteration + 1) / count(*) OVER w), 9) AS ucb FROM cand WINDOW w AS (PARTITION BY run, prompt ORDER BY iteration, idx ROWS UNBOUNDED PRECEDING))
        {PICK}, round(ucb, 6) AS ucb FROM (SELECT *, row_number() OVER (PARTITION BY run, iteration ORDER BY ucb DESC, idx DESC) AS rank FROM u) WHERE rank <= 5""",
    "ensemble_select": f"""WITH {CANDIDATES}, e AS (SELECT *, round(((CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END)
        + (CASE WHEN max(cost) OVER w > min(cost) OVER w THEN (cost - min(cost) OVER w) / (max(cost) OVER w - min(cost) OVER w) ELSE cost END)) / 2, 9) AS ensemble FROM cand WINDOW w AS (PARTITION BY run, iteration))
        {PICK} FROM (SELECT *, row_number() OVER (PARTITION BY run, iteration ORDER BY ensemble DESC, idx DESC) AS rank FROM e) WHERE rank <= 5""",
    "running_best": f"WITH {HISTORY} SELECT *, max(score) OVER w AS best, round(max(score) OVER w - first_value(score) OVER w, 9) AS improvement FROM hist WINDOW w AS (PARTITION BY run ORDER BY iteration ROWS UNBOUNDED PRECEDING)",
    "discounted_returns": f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iteration) AS pos FROM hist)
        SELECT a.run AS episode, CAST(a.iteration AS BIGINT) AS t, sum(floor(b.score * 100) * power(0.5, b.pos - a.pos)) AS ret FROM r a JOIN r b ON a.run = b.run AND b.pos >= a.pos GROUP BY ALL""",
    "quota_fill": """SELECT round, idx, round_score FROM (SELECT CAST(day(ts) AS INT) AS round, event_id AS idx, (day(ts) % 10) / 10 AS round_score, count(*) OVER (PARTITION BY day(ts)) AS n, row_number() OVER (PARTITION BY day(ts) ORDER BY event_id) AS r FROM events)
        WHERE r <= CASE WHEN round_score >= 0.7 THEN n ELSE floor(n * round_score) END""",
    "resolve_rules": f"WITH {RULES} SELECT type, pattern, action, ord FROM rules QUALIFY row_number() OVER (PARTITION BY type, pattern ORDER BY round(0.4 * value + 0.4 * confidence + 0.2 * age, 9) DESC, ord) = 1",
    "applicable_rules": f"WITH {RULES} SELECT type, ord, confidence, CAST(row_number() OVER (PARTITION BY type ORDER BY confidence DESC, ord) AS INT) AS rank FROM rules WHERE action = '42'",
    "best_parameters": f"WITH {CANDIDATES} SELECT run AS task_id, max(score) AS best_score, arg_max(prompt, (score, -idx)) AS params, count(*) AS trials, CASE WHEN max(score) > 0.7 THEN 'success' ELSE 'failure' END AS rule_type FROM cand GROUP BY run",
    "weighted_task_score": "SELECT CAST(user_id % 12 AS VARCHAR) AS prompt, CAST(sum(CAST(round(value * 100) AS BIGINT) * length(event_type)) AS BIGINT) AS weighted FROM events GROUP BY ALL",
}
