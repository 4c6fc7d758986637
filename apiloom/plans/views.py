"""Frames that the registered queries share, each with the SQL that makes the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over the cluster: a small file is one task, whatever its rows cost or grow into."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a tool-call log: user = task, k modulo 4 = model, k / 4 = agent; agents from 20 on are unknown."""
    k = F.get_json_object("props", "$.k").cast("int")
    agent = F.floor(k / 4).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("task_id"),
        F.concat(F.lit("m"), (k % 4).cast("string")).alias("model"),
        F.concat(F.lit("agent_"), agent.cast("string")).alias("agent_id"),
        F.when(agent >= 20, "invalid_tool").when(F.col("event_type") == "error", "500").otherwise("ok").alias("status"),
        F.when(agent >= 20, "unknown_tool").when(F.col("event_type") == "error", "server").otherwise("none").alias("error_type"),
        F.expr("unix_millis(cast(ts AS timestamp))").alias("timestamp_ms"),
        "value",
        F.concat(F.lit("sys"), (agent % 5).cast("string"), F.lit("__"), agent.cast("string")).alias("layer"),
    )


LOGS = """
logs AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS task_id, 'm' || (k % 4) AS model, 'agent_' || (k // 4) AS agent_id,
         CASE WHEN k // 4 >= 20 THEN 'invalid_tool' WHEN event_type = 'error' THEN '500' ELSE 'ok' END AS status,
         CASE WHEN k // 4 >= 20 THEN 'unknown_tool' WHEN event_type = 'error' THEN 'server' ELSE 'none' END AS error_type,
         epoch_us(ts) // 1000 AS timestamp_ms, value, 'sys' || ((k // 4) % 5) || '__' || (k // 4) AS layer
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""


def registry(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.concat(F.lit("agent_"), F.col("id").cast("string")).alias("agent_id"))


REGISTRY = "registry AS (SELECT 'agent_' || i AS agent_id FROM range(20) t(i))"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task for each user of `events`: three expected agents made from its number, and its level."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    agents = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("agent_"), ((F.col("user_id") * 7 + i * 5) % 23).cast("string")))
    return users.select(F.col("user_id").cast("string").alias("task_id"), (F.col("user_id") % 4 + 1).cast("int").alias("level"), agents.alias("expected_agents"))


TASKS = """
tasks AS (
  SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(user_id % 4 + 1 AS INT) AS level,
         ['agent_' || ((user_id * 7) % 23), 'agent_' || ((user_id * 7 + 5) % 23), 'agent_' || ((user_id * 7 + 10) % 23)] AS expected_agents
  FROM (SELECT DISTINCT user_id FROM events)
)"""


def apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as an API catalogue: the entity from type and brand, method and path from the size."""
    entity = F.concat(F.lower("p_type"), F.lit("-"), F.regexp_replace(F.lower("p_brand"), "#", ""))
    kind = F.col("p_size") % 6
    tail = F.element_at(F.array(*map(F.lit, ["/create", "/update", "/list", "/{id}", "/page", "/delete"])), kind + 1)
    method = F.element_at(F.array(*map(F.lit, ["POST", "PUT", "GET", "GET", "GET", "DELETE"])), kind + 1)
    verb = F.element_at(F.array(*map(F.lit, ["create", "update", "list", "get", "page", "delete"])), kind + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(verb, F.lit("_"), F.col("p_partkey").cast("string")).alias("operation_id"),
        method.alias("method"),
        F.concat(F.lit("/api/v1/"), entity, tail).alias("path"),
        entity.alias("entity"),
        F.col("p_name").alias("summary"),
        F.array("p_brand").alias("tags"),
        F.col("p_retailprice").alias("price"),
    )


APIS = """
apis AS (
  SELECT p_partkey AS ord, ['create', 'update', 'list', 'get', 'page', 'delete'][p_size % 6 + 1] || '_' || p_partkey AS operation_id,
         ['POST', 'PUT', 'GET', 'GET', 'GET', 'DELETE'][p_size % 6 + 1] AS method,
         '/api/v1/' || lower(p_type) || '-' || replace(lower(p_brand), '#', '') || ['/create', '/update', '/list', '/{id}', '/page', '/delete'][p_size % 6 + 1] AS path,
         lower(p_type) || '-' || replace(lower(p_brand), '#', '') AS entity, p_name AS summary, [p_brand] AS tags, p_retailprice AS price
  FROM part
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies between entities of the catalogue from `lineitem`: the parts of one order, by line number."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lower("p_type"), F.lit("-"), (F.col("p_size") % 10).cast("string")).alias("node"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount").join(part, "l_partkey")
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("node").alias("src"), F.col("l_discount").alias("d"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("node").alias("dst"))
    pairs = a.join(b, ["l_orderkey", "n"]).where("src != dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.round(F.lit(0.5) + F.max("d") * 4, 6).alias("score"))


EDGES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_discount, lower(p_type) || '-' || (p_size % 10) AS node FROM lineitem JOIN part ON p_partkey = l_partkey
), edges AS (
  SELECT a.node AS src, b.node AS dst, count(*) AS weight, round(0.5 + max(a.l_discount) * 4, 6) AS score
  FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.node != b.node GROUP BY ALL
)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region - nation - customer as an agent tree: agent_id, name, parent_id."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("agent_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.col("c_name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return region.union(nation).union(customer)


TREE = """
tree AS (
  SELECT 'r' || r_regionkey AS agent_id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`labels` as references and `toxic` as a model's answer, for two prompts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select(
        F.col("doc_id").alias("example_id"),
        F.concat(F.lit("p"), (F.col("doc_id") % 2).cast("string")).alias("prompt_id"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"),
        F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("predicted"),
        F.col("text").alias("input"),
        "lang",
    )


PREDICTIONS = """
preds AS (
  SELECT doc_id AS example_id, 'p' || (doc_id % 2) AS prompt_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS expected,
         CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS predicted, text AS input, lang
  FROM labels JOIN documents USING (doc_id)
)"""
