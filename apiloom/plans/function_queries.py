"""Registered queries of single functions and small summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiloom.functions import schema as X
from apiloom.functions import text as T
from apiloom.operators import apis as A
from apiloom.operators import profile as P
from apiloom.plans.graph_queries import FIELDS, fields
from apiloom.plans.views import APIS, EDGES, LOGS, apis, edges, logs, table
from apiloom.streaming import jobs


def _mappings(s, d):
    """Suppliers as aligned tables: the relation by nation, business and hidden columns by number."""
    key = F.col("s_suppkey")
    pick = lambda names, n: F.slice(F.array(*map(F.lit, names)), 1, n.cast("int"))
    relation = F.element_at(F.array(*map(F.lit, ("core", "association", "log"))), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return table(s, d, "supplier").select("s_suppkey", F.lower("s_name").alias("table_name"), relation.alias("relation_type"), pick(["name", "amount", "city"], key % 4).alias("business"), pick(["deleted", "tenant_id"], key % 3).alias("hidden"))


def _active(s, d):
    kind = F.when(F.col("event_type") == "error", "TASK_FAILED").when(F.col("event_type") == "purchase", "TASK_FINISHED").otherwise("TASK_STARTED")
    rows = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).cast("string").alias("agent_id"), kind.alias("event_type"))
    return jobs.stream_active_change(rows, window="1 day")


def _constrained(s, d):
    name = F.concat("operation_id", F.when(F.col("ord") % 5 == 0, "_Refund").when(F.col("ord") % 7 == 0, "_deleteAll").otherwise(""))
    return apis(s, d).select("operation_id", name.alias("name"), "method", F.when(F.col("ord") % 2 == 0, "specialist").otherwise("manager").alias("role_level"))


QUERIES = {
    "rule_constraints": lambda s, d: A.rule_constraints(_constrained(s, d)),
    "classify_match": lambda s, d: edges(s, d).select("src", "dst", T.classify_match(F.col("score")).alias("kind")),
    "is_read": lambda s, d: apis(s, d).select("operation_id", T.is_read(F.col("path"), F.col("method")).alias("reads")),
    "api_text": lambda s, d: apis(s, d).select("operation_id", T.api_text(T.action_verb(F.col("operation_id")), F.lit(""), F.col("summary"), F.col("operation_id"), F.col("path"), F.array_join("tags", " "), F.array_join(T.path_segments(F.col("path")), " "), F.col("method")).alias("text")),
    "sanitize_string": lambda s, d: table(s, d, "customer").select("c_custkey", T.sanitize_string(F.concat(F.lit("  "), "c_name", F.lit(" <b>@"), "c_mktsegment"), 24).alias("clean")),
    "leaf_name": lambda s, d: fields(s, d, "request").select("operation_id", "name", X.leaf_name(F.concat(F.lit("data[].items."), "name", F.lit("[]"))).alias("leaf")),
    "task_level": lambda s, d: logs(s, d).groupBy("task_id").agg(F.collect_list("layer").alias("agents")).select("task_id", T.task_level(F.col("agents")).alias("level")),
    "agent_tags": lambda s, d: logs(s, d).select("event_id", F.array_join(T.agent_tags(F.concat(F.lit("x [agent:"), "agent_id", F.lit("] then [agent:"), "status", F.lit("] [other:z]"))), ",").alias("tags")),
    "mapping_summary": lambda s, d: P.mapping_summary(_mappings(s, d)),
    "hidden_filters": lambda s, d: P.hidden_filters(_mappings(s, d)).withColumn("tables", F.array_join("tables", ",")),
    "capability_entities": lambda s, d: P.capability_entities(fields(s, d, "response").join(apis(s, d).select("operation_id", "path"), "operation_id").select(F.col("entity").alias("capability"), F.col("name").alias("field"), "path")).select("capability", F.array_join("fields", ",").alias("fields"), F.array_join("paths", ",").alias("paths")),
    "active_change": _active,
}

MAPPINGS = """maps AS (SELECT s_suppkey, lower(s_name) AS table_name, ['core', 'association', 'log'][s_nationkey % 3 + 1] AS relation_type, list_slice(['name', 'amount', 'city'], 1, s_suppkey % 4) AS business, list_slice(['deleted', 'tenant_id'], 1, s_suppkey % 3) AS hidden FROM supplier)"""
SQL = {
    "rule_constraints": f"""WITH {APIS} SELECT operation_id, unnest(list_filter([CASE WHEN ord % 2 = 0 AND (method = 'DELETE' OR (ord % 7 = 0 AND ord % 5 != 0)) THEN 'approval_required' END, CASE WHEN ord % 5 = 0 THEN 'amount_limit' END, 'data_isolation'], lambda x: x IS NOT NULL)) AS "constraint" FROM apis""",
    "classify_match": f"WITH {EDGES} SELECT src, dst, CASE WHEN score >= 0.9 THEN 'CERTAIN' WHEN score >= 0.7 THEN 'PROBABLE' WHEN score >= 0.5 THEN 'WEAK' END AS kind FROM edges",
    "is_read": f"WITH {APIS} SELECT operation_id, method = 'GET' OR contains(path, '/get') OR contains(path, '/list') OR contains(path, '/page') AS reads FROM apis",
    "api_text": f"""WITH {APIS} SELECT operation_id, CASE WHEN starts_with(operation_id, 'page_') THEN '' ELSE repeat(split_part(operation_id, '_', 1) || ' ', 3) END || summary || ' ' || tags[1] || ' ' || array_to_string(list_filter(string_split(path, '/'), lambda x: x != '' AND NOT starts_with(x, '{{')), ' ') || ' ' || method AS text FROM apis""",
    "sanitize_string": "SELECT c_custkey, substr(regexp_replace(trim('  ' || c_name || ' <b>@' || c_mktsegment), '[^\\w\\s.,-]', '', 'g'), 1, 24) AS clean FROM customer",
    "leaf_name": f"WITH {APIS}, {FIELDS.format('q', 0)} SELECT operation_id, name, name AS leaf FROM q",
    "task_level": f"WITH {LOGS} SELECT task_id, CAST(least(4, greatest(1, count(DISTINCT split_part(layer, '__', 1)))) AS INT) AS level FROM logs GROUP BY task_id",
    "agent_tags": f"WITH {LOGS} SELECT event_id, agent_id || ',' || status AS tags FROM logs",
    "mapping_summary": f"WITH {MAPPINGS} SELECT relation_type, count(*) AS tables, CAST(sum(len(business)) AS BIGINT) AS business_columns, CAST(sum(len(hidden)) AS BIGINT) AS hidden_columns FROM maps GROUP BY relation_type",
    "hidden_filters": f"WITH {MAPPINGS}, u AS (SELECT table_name, unnest(hidden) AS column_name FROM maps) SELECT column_name, array_to_string(list_sort(list(DISTINCT table_name)), ',') AS tables FROM u GROUP BY column_name",
    "capability_entities": f"WITH {APIS}, {FIELDS.format('p', 1)} SELECT apis.entity AS capability, array_to_string(list_sort(list(DISTINCT name)), ',') AS fields, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM p JOIN apis USING (operation_id) GROUP BY apis.entity",
    "active_change": "SELECT date_trunc('day', ts) AS start, CAST(user_id % 10 AS VARCHAR) AS agent_id, CAST(sum(CASE WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 1 END) AS BIGINT) AS change FROM events GROUP BY ALL",
}
