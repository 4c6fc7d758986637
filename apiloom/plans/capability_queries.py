"""Registered queries of capabilities and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiloom.operators import apis as A
from apiloom.operators import capability as C
from apiloom.operators import roles as R
from apiloom.plans.graph_queries import CENTERS, FIELDS, fields
from apiloom.plans.views import APIS, EDGES, apis, edges, table


def _fields(s, d):
    of = apis(s, d).select("operation_id", "method", F.col("entity").alias("capability"))
    side = lambda x: fields(s, d, x).select("operation_id", "name", "type").withColumn("side", F.lit(x))
    return side("request").unionByName(side("response")).join(of.hint("merge"), "operation_id")


FROWS = f"""{FIELDS.format('q', 0)}, {FIELDS.format('p', 1).split('),', 1)[1]},
rows AS (SELECT entity AS capability, operation_id, method, side, name FROM (SELECT operation_id, name, 'request' AS side FROM q UNION ALL SELECT operation_id, name, 'response' FROM p) JOIN apis USING (operation_id))"""
MERGED = """posts AS (SELECT entity AS capability, count(DISTINCT operation_id) AS posts FROM apis WHERE method = 'POST' GROUP BY ALL),
merged AS (SELECT capability, name, bool_and(side = 'response') AS read_only, bool_and(side = 'request') AS write_only, coalesce(count(DISTINCT operation_id) FILTER (side = 'request' AND method = 'POST') = any_value(posts), FALSE) AS required,
  array_to_string(list_sort(list(DISTINCT operation_id)), ',') AS sources, CASE WHEN name LIKE '%Amount%' THEN 'number' ELSE 'string' END AS type, FALSE AS conflict FROM rows LEFT JOIN posts USING (capability) GROUP BY capability, name)"""


def _points(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), "embedding")


def _assigned(s, d):
    return apis(s, d).select(F.col("entity").alias("role"), "operation_id", F.col("summary").alias("name"), F.lit("").alias("description"))


def _roles(s, d):
    need = F.when(F.length("entity") % 2 == 0, F.array(F.lit("Ring"), F.lit("bolt"))).otherwise(F.array(F.lit("widget")))
    return apis(s, d).select("entity").distinct().select(F.col("entity").alias("role"), need.alias("required_capabilities"))


def _steps(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_partkey").alias("ord"))
    return li.join(apis(s, d).select("ord", "operation_id"), "ord").select("path_id", "operation_id").distinct()


def _connectivity(s, d):
    return C.connectivity_score(apis(s, d).withColumn("capability", F.col("entity")), C.merged_schema(_fields(s, d)))


def _metrics(s, d):
    """One row of the catalogue's clustering: sizes and completeness by entity, connectivity, and the vectors' silhouette."""
    rolled = A.capability_rollup(apis(s, d).withColumn("cluster", F.col("entity")))
    sizes = rolled.agg(
        F.avg("api_count").alias("avg_size"),
        F.stddev_pop("api_count").alias("std_size"),
        (F.sum(F.when(F.col("api_count") == 1, 1).otherwise(0)) / F.sum("api_count")).alias("noise_ratio"),
        F.max("api_count").alias("largest"),
        F.count("*").alias("capabilities"),
        F.count_if(F.col("completeness") < 1).alias("incomplete"),
    )
    linked = _connectivity(s, d).agg((F.floor(F.avg(F.round(F.col("connectivity") * 100)) * 1000) / 100_000).alias("connectivity"), F.count_if(F.col("connectivity") < 0.7).alias("low_connectivity"))
    shape = R.silhouette(_points(s, d))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(sizes).join(one(linked), "__one").join(one(shape), "__one").drop("__one")


QUERIES = {
    "merged_schema": lambda s, d: C.merged_schema(_fields(s, d)).withColumn("sources", F.array_join("sources", ",")),
    "connectivity_score": _connectivity,
    "unify_anchors": lambda s, d: C.unify_anchors(apis(s, d).withColumn("cluster", F.element_at("tags", 1))),
    "density_clusters": lambda s, d: C.density_clusters(apis(s, d).select("operation_id", F.element_at("tags", 1).alias("tag"), F.concat_ws(" ", "summary", "method").alias("text"))),
    "davies_bouldin": lambda s, d: C.davies_bouldin(_points(s, d)),
    "quality_score": lambda s, d: C.quality_score(_metrics(s, d)).select("quality"),
    "clustering_warnings": lambda s, d: C.clustering_warnings(_metrics(s, d)).select(F.array_join("warnings", ",").alias("warnings"), "largest", "capabilities", "incomplete", "low_connectivity"),
    "keyword_match": lambda s, d: C.keyword_match(table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("node_id"), "text")),
    "required_vs_optional": lambda s, d: C.required_vs_optional(_assigned(s, d), _roles(s, d)),
    "role_statistics": lambda s, d: C.role_statistics(C.required_vs_optional(_assigned(s, d), _roles(s, d))),
    "empty_roles": lambda s, d: C.empty_roles(_roles(s, d), _assigned(s, d).where("role like 's%' or role like 'p%'")),
    "cross_domain_caps": lambda s, d: C.cross_domain_caps(apis(s, d).select(F.element_at("tags", 1).alias("domain"), F.col("operation_id").alias("capability"), "ord")),
    "path_provides_fields": lambda s, d: C.path_provides_fields(_steps(s, d), fields(s, d, "response").select("operation_id", "name"), ["userId", "order_id", "email"]),
    "cross_entity_paths": lambda s, d: C.cross_entity_paths(edges(s, d), edges(s, d).select(F.col("src").alias("node")).union(edges(s, d).select("dst")).distinct().withColumn("entity", F.split_part("node", F.lit("-"), F.lit(1)))).select(F.array_join("path", ">").alias("path")),
}

CONNECTED = """b AS (SELECT entity AS capability, 30 * max(CAST(method = 'POST' AS INT)) + 20 * max(CAST(method = 'GET' AS INT)) + 30 * max(CAST(method IN ('PUT', 'PATCH') AS INT)) + 20 * max(CAST(method = 'DELETE' AS INT)) AS crud,
  CASE WHEN length(min(path)) > 1 AND substr(min(path), 1, 2) = substr(max(path), 1, 2) THEN 100 WHEN len(list_distinct(flatten(list(segments)))) < len(flatten(list(segments))) THEN 70 ELSE 30 END AS paths
  FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x != '' AND NOT starts_with(x, '{')) AS segments FROM apis) GROUP BY ALL),
c AS (SELECT capability, CASE WHEN bool_or(read_only) AND bool_or(write_only) THEN 100 WHEN bool_or(read_only) OR bool_or(write_only) THEN 50 ELSE 0 END AS cover, 100 * CAST(bool_or(NOT read_only AND NOT write_only) AS INT) AS chained FROM merged GROUP BY ALL),
connected AS (SELECT capability, (crud + coalesce(cover, 0) + coalesce(chained, 0) + paths + 2) // 4 AS h FROM b LEFT JOIN c USING (capability))"""
SQUARE = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
SILHOUETTE = f"""sz AS (SELECT label AS other, count(*) AS n FROM embeddings GROUP BY ALL),
dist AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(sqrt({SQUARE.format('a.embedding', 'b.embedding')})) AS total FROM embeddings a, embeddings b GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN own != other THEN total / n END) AS b FROM dist JOIN sz USING (other) GROUP BY vec_id),
sil AS (SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab)"""
CATALOGUE = """z AS (SELECT entity, count(*) AS n, count(DISTINCT CASE WHEN method IN ('PUT', 'PATCH') THEN 'PUT' ELSE method END) AS kinds FROM apis GROUP BY ALL),
metrics AS (SELECT avg(n) AS a, stddev_pop(n) AS s, count(*) FILTER (n = 1) / sum(n) AS noise, max(n) AS largest, count(*) AS capabilities, count(*) FILTER (kinds < 4) AS incomplete,
  (SELECT floor(avg(h) * 1000) / 100000 FROM connected) AS connectivity, (SELECT count(*) FROM connected WHERE h < 70) AS low_connectivity, (SELECT silhouette FROM sil) AS silhouette FROM z)"""
SQL = {
    "merged_schema": f"WITH {APIS}, {FROWS}, {MERGED} SELECT * FROM merged",
    "connectivity_score": f"WITH {APIS}, {FROWS}, {MERGED}, {CONNECTED} SELECT capability, h / 100 AS connectivity FROM connected",
    "unify_anchors": f"WITH {APIS}, n AS (SELECT tags[1] AS cluster, entity, count(*) AS n FROM apis GROUP BY ALL) SELECT cluster, arg_min(entity, (-n, entity)) AS anchor FROM n GROUP BY cluster",
    "quality_score": f"""WITH {APIS}, {FROWS}, {MERGED}, {CONNECTED}, {SILHOUETTE}, {CATALOGUE}
        SELECT round(((silhouette + 1) / 2 * 0.3 + greatest(0, 1 - noise * 2) * 0.2 + connectivity * 0.3 + CASE WHEN a BETWEEN 3 AND 8 THEN 1.0 ELSE greatest(0, 1 - abs(a - 5.5) / 10) END * (1 - least(1.0, s / a) * 0.5) * 0.2) * 100, 2) AS quality FROM metrics""",
    "clustering_warnings": f"""WITH {APIS}, {FROWS}, {MERGED}, {CONNECTED}, {SILHOUETTE}, {CATALOGUE}
        SELECT array_to_string(list_filter([CASE WHEN noise > 0.3 THEN 'high noise' END, CASE WHEN silhouette < 0.2 THEN 'low silhouette' END, CASE WHEN largest > 20 THEN 'large cluster' END, CASE WHEN incomplete > capabilities * 0.5 THEN 'incomplete lifecycles' END, CASE WHEN low_connectivity > 0 THEN 'low connectivity' END], lambda x: x IS NOT NULL), ',') AS warnings,
        largest, capabilities, incomplete, low_connectivity FROM metrics""",
    "silhouette": f"WITH {SILHOUETTE} SELECT * FROM sil",
    "davies_bouldin": f"""WITH {CENTERS}, w AS (SELECT c.label, any_value(center) AS center, avg(sqrt({SQUARE.format('embedding', 'center')})) AS s FROM embeddings JOIN centers c USING (label) GROUP BY c.label)
        SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT max((a.s + b.s) / sqrt({SQUARE.format('a.center', 'b.center')})) AS r FROM w a JOIN w b ON a.label != b.label GROUP BY a.label)""",
    "keyword_match": """WITH q AS (SELECT conv_id * 1000 + turn AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w != ''))) AS w FROM conversations),
        h AS (SELECT query_id, item_id AS node_id, count(*) AS hits FROM q JOIN benchmark ON contains(lower(text), w) GROUP BY ALL) SELECT query_id, arg_min(node_id, (-hits, node_id)) AS node_id, max(hits) AS hits FROM h GROUP BY query_id""",
    "required_vs_optional": f"WITH {APIS} SELECT entity AS role, operation_id, CASE WHEN (length(entity) % 2 = 0 AND (contains(lower(summary), 'ring') OR contains(lower(summary), 'bolt'))) OR (length(entity) % 2 = 1 AND contains(lower(summary), 'widget')) THEN 'required' ELSE 'optional' END AS kind FROM apis",
    "role_statistics": f"WITH {APIS}, k AS (SELECT entity AS role, (length(entity) % 2 = 0 AND (contains(lower(summary), 'ring') OR contains(lower(summary), 'bolt'))) OR (length(entity) % 2 = 1 AND contains(lower(summary), 'widget')) AS r FROM apis) SELECT role, count(*) AS apis, count(*) FILTER (r) AS required, count(*) FILTER (NOT r) AS optional FROM k GROUP BY role",
    "empty_roles": f"WITH {APIS} SELECT DISTINCT entity AS role FROM apis WHERE NOT (entity LIKE 's%' OR entity LIKE 'p%')",
    "cross_domain_caps": f"WITH {APIS} SELECT tags[1] AS domain, operation_id AS capability, ord, CAST(row_number() OVER w AS INT) AS rank FROM apis WINDOW w AS (PARTITION BY tags[1] ORDER BY ord) QUALIFY row_number() OVER w <= 2",
    "path_provides_fields": f"WITH {APIS}, {FIELDS.format('p', 1)} SELECT l_orderkey AS path_id, count(DISTINCT name) FILTER (name IN ('userId', 'order_id', 'email')) = 3 AS covered FROM lineitem JOIN apis ON ord = l_partkey JOIN p USING (operation_id) GROUP BY l_orderkey",
}
