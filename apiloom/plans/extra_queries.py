"""Registered queries of set operations, parsing, search and role upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiloom.functions import text as T
from apiloom.operators import graph as G
from apiloom.operators import roles as R
from apiloom.operators import trees as V
from apiloom.plans.views import APIS, EDGES, LOGS, REGISTRY, TREE, apis, edges, logs, registry, table, tree


def _response_agents(s, d):
    said = logs(s, d).select("event_id", F.concat(F.lit("I call "), "agent_id", F.lit(" and [\""), "agent_id", F.lit("\", \"agent_1\"]")).alias("r"), (F.col("event_id") % 2).alias("plain"))
    text = F.when(F.col("plain") == 1, F.regexp_replace("r", r"\[.*\]", "")).otherwise(F.col("r"))
    each = said.select("event_id", F.explode(T.response_agents(text)).alias("agent_id"))
    return each.join(registry(s), "agent_id", "left_semi").select("event_id", "agent_id")


def _set_ops(s, d):
    a = table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    b = table(s, d, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("k"))
    name = lambda df, n: df.select("k", F.lit(n).alias("part"))
    return name(a.intersect(b), "common").unionByName(name(a.exceptAll(b).distinct().join(b, "k", "left_anti"), "removed")).unionByName(name(b.join(a, "k", "left_anti"), "added"))


def _levels(s, d):
    return V.tree_intervals(tree(s, d)).select("agent_id", F.col("depth").alias("level"))


def _is_descendant(s, d):
    """Each order's customer against a nation, a region, another customer and itself."""
    o = table(s, d, "orders")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    others = F.array(name("n", F.col("o_orderkey") % 25), name("r", F.col("o_orderkey") % 5), name("c", F.col("o_orderkey") % 100), name("c", F.col("o_custkey")))
    pairs = o.select(F.explode(others).alias("ancestor"), name("c", F.col("o_custkey")).alias("node")).distinct()
    return V.is_descendant(pairs, V.tree_intervals(tree(s, d)))


def _references(s, d):
    return table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("agent_id"), (F.col("o_orderkey") % 500).cast("string").alias("capability"))


def _blueprint(s, d):
    """An organisation of suppliers, parts, and order lines between them."""
    li = table(s, d, "lineitem")
    agents = table(s, d, "supplier").select((F.col("s_nationkey") % 4).alias("level"), (F.col("s_acctbal") < 0).alias("is_virtual"))
    kinds = F.element_at(F.array(*map(F.lit, ["atomic", "composed", "strategic"])), (F.col("p_size") % 3 + 1).cast("int"))
    shared = R.shared_capabilities(li.select(F.col("l_partkey").alias("capability"), F.col("l_suppkey").alias("agent_id")), least=4)
    return R.blueprint_statistics(agents, table(s, d, "part").select(kinds.alias("kind")), shared, li.select(F.concat(F.lit("line "), "l_linestatus").alias("type")))


QUERIES = {
    "blueprint_statistics": _blueprint,
    "parse_response_agents": _response_agents,
    "parse_action": lambda s, d: logs(s, d).select("event_id", T.parse_action(F.concat(F.lit("Thought: x\nAction: "), F.when(F.col("event_id") % 4 == 0, "finish").otherwise(F.col("agent_id")))).alias("action")),
    "primary_entity": lambda s, d: apis(s, d).select("operation_id", T.primary_entity(F.when(F.col("ord") % 3 == 0, F.concat(F.lit('{"title": "'), F.initcap("summary"), F.lit('ResponseVO"}'))).when(F.col("ord") % 3 == 1, F.concat(F.lit('{"type": "array", "items": {"title": "'), "entity", F.lit('DTO"}}'))), F.col("entity")).alias("primary")),
    "set_ops": _set_ops,
    "filter_confident": lambda s, d: edges(s, d).where("score >= 0.8").select("src", "dst"),
    "search_nodes": lambda s, d: R.search_nodes(tree(s, d), "customer#00000001", parent_id="n3").select("agent_id"),
    "is_descendant": _is_descendant,
    "descendants_of": lambda s, d: G.closure(G.tree_paths(tree(s, d))).where("ancestor = 'r1' AND distance > 0").select("descendant"),
    "tree_intervals": lambda s, d: V.tree_intervals(tree(s, d)),
    "adjusted_roles": lambda s, d: R.adjusted_roles(apis(s, d).select(F.col("entity").alias("role")).distinct(), apis(s, d).where("price < 950").select(F.col("entity").alias("role")).distinct(), table(s, d, "nation").select(F.lower("n_name").alias("role"))),
    "shared_by_level": lambda s, d: R.shared_by_level(_references(s, d), _levels(s, d)),
    "task_similarity": lambda s, d: R.task_similarity(table(s, d, "events").select(F.col("event_type").alias("task"), (F.floor(F.col("value")) / 1024).alias("score"))),
    "silhouette": lambda s, d: R.silhouette(table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("cluster"))),
}

SQL = {
    "blueprint_statistics": """WITH sh AS (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 4),
k AS (SELECT ['atomic', 'composed', 'strategic'][p_size % 3 + 1] AS kind FROM part), c AS (
SELECT 'agents' AS part, 'total' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'agents', CASE WHEN s_acctbal < 0 THEN 'virtual' ELSE 'real' END, count(*) FROM supplier GROUP BY 2
UNION ALL SELECT 'agents', 'level ' || (s_nationkey % 4), count(*) FROM supplier GROUP BY 2 UNION ALL SELECT 'capabilities', 'total', count(*) FROM part UNION ALL SELECT 'capabilities', kind, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'capabilities', 'shared', count(*) FROM sh HAVING count(*) > 0 UNION ALL SELECT 'topology', 'line ' || l_linestatus, count(*) FROM lineitem GROUP BY 2)
SELECT * FROM c UNION ALL SELECT 'composition_pattern', p.name, CAST((SELECT count(*) FROM c WHERE c.part = 'capabilities' AND c.name = p.k) AS BIGINT) FROM (VALUES ('horizontal_reuse', 'shared'), ('vertical_promotion', 'composed'), ('cross_domain', 'strategic')) AS p(name, k)""",
    "parse_response_agents": f"WITH {LOGS}, {REGISTRY}, e AS (SELECT event_id, agent_id FROM logs UNION SELECT event_id, 'agent_1' FROM logs WHERE event_id % 2 = 0) SELECT * FROM e WHERE agent_id IN (SELECT agent_id FROM registry)",
    "parse_action": f"WITH {LOGS} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'FINISH' ELSE agent_id END AS action FROM logs",
    "primary_entity": f"WITH {APIS} SELECT operation_id, CASE WHEN ord % 3 = 0 THEN lower(summary) ELSE entity END AS \"primary\" FROM apis",
    "set_ops": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 != 0)
        SELECT k, 'common' AS part FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'removed' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'added' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
    "filter_confident": f"WITH {EDGES} SELECT src, dst FROM edges WHERE score >= 0.8",
    "search_nodes": f"WITH {TREE} SELECT agent_id FROM tree WHERE contains(lower(name), 'customer#00000001') AND parent_id = 'n3'",
    "is_descendant": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
p AS (SELECT DISTINCT unnest(['n' || (k % 25), 'r' || (k % 5), 'c' || (k % 100), 'c' || c]) AS ancestor, c FROM o)
SELECT ancestor, 'c' || c AS node, coalesce(ancestor IN ('n' || c_nationkey, 'r' || n_regionkey), false) AS descendant FROM p LEFT JOIN customer ON c_custkey = c LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "descendants_of": "SELECT 'n' || n_nationkey AS descendant FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1",
    "tree_intervals": """WITH c AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS p FROM customer), n AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS p FROM nation), r AS (SELECT 'r' || r_regionkey AS a FROM region),
ways AS (SELECT a AS agent_id, NULL::VARCHAR AS parent_id, 0 AS depth, [a] AS way FROM r UNION ALL SELECT a, p, 1, [p, a] FROM n UNION ALL SELECT c.a, c.p, 2, [n.p, n.a, c.a] FROM c JOIN n ON n.a = c.p),
subs AS (SELECT u AS agent_id, count(*) AS size FROM (SELECT unnest(way) AS u FROM ways) GROUP BY u),
numbers AS (SELECT *, row_number() OVER (ORDER BY way) - 1 AS before FROM ways)
SELECT agent_id, parent_id, depth, 2 * before - depth AS enter, 2 * before - depth + 2 * size - 1 AS leave FROM numbers JOIN subs USING (agent_id)""",
    "adjusted_roles": f"WITH {APIS} SELECT DISTINCT entity AS role FROM apis WHERE entity NOT IN (SELECT entity FROM apis WHERE price < 950) UNION SELECT lower(n_name) FROM nation",
    "shared_by_level": "SELECT 2 AS level, CAST(o_orderkey % 500 AS VARCHAR) AS capability, count(DISTINCT o_custkey) AS agents FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL HAVING count(DISTINCT o_custkey) >= 2",
    "task_similarity": "WITH m AS (SELECT event_type AS task, avg(floor(value) / 1024) AS m FROM events GROUP BY ALL) SELECT a.task AS a, b.task AS b, round(1 - abs(a.m - b.m), 6) AS similarity FROM m a JOIN m b ON a.task < b.task",
}
