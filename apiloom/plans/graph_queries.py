"""Registered queries over API catalogues, dependency graphs, trees, roles and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from apiloom.functions import text as T
from apiloom.operators import apis as A
from apiloom.operators import deps as D
from apiloom.operators import graph as G
from apiloom.operators import roles as R
from apiloom.operators import scenarios as X
from apiloom.operators import select as S
from apiloom.operators import trees as V
from apiloom.plans.views import APIS, EDGES, TREE, apis, edges, spread, table, tree
from apiloom.session import Scratch, cut

ENTITIES = "ent AS (SELECT entity, min(ord) AS ord FROM apis GROUP BY entity)"


def entities(s, d):
    return apis(s, d).groupBy("entity").agg(F.min("ord").alias("ord"))


def fields(s, d, side):
    """Request or response fields of each API, chosen by its number."""
    names = ["userId", "order_id", "productId", "supplierCode", "status", "email", "totalAmount", "createTime", "small_id"]
    shift = 0 if side == "request" else 1
    each = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.element_at(F.array(*map(F.lit, names)), ((F.col("ord") * 5 + i * 2 + shift) % len(names) + 1).cast("int")))
    rows = spread(apis(s, d).select("operation_id", "entity", "ord"), "operation_id").select("operation_id", "entity", F.explode(F.array_distinct(each)).alias("name"))
    return rows.withColumn("type", F.when(F.col("name").contains("Amount"), "number").otherwise("string")).withColumn("location", F.when(F.length("name") % 2 == 0, "path").otherwise("body"))


FIELDS = """
names AS (SELECT ['userId', 'order_id', 'productId', 'supplierCode', 'status', 'email', 'totalAmount', 'createTime', 'small_id'] AS l),
{0} AS (SELECT DISTINCT operation_id, entity, l[(ord * 5 + i * 2 + {1}) % 9 + 1] AS name FROM apis, names, range(3) t(i))"""
CANONICAL = """CASE WHEN {0} LIKE '%userid%' OR {0} LIKE '%uid%' THEN 'USER_ID' WHEN {0} LIKE '%orderid%' THEN 'ORDER_ID' WHEN {0} LIKE '%productid%' OR {0} LIKE '%pid%' THEN 'PRODUCT_ID'
  WHEN {0} LIKE '%token%' THEN 'TOKEN' WHEN {0} LIKE '%email%' THEN 'EMAIL' WHEN {0} LIKE '%phone%' OR {0} LIKE '%mobile%' THEN 'PHONE' WHEN {0} LIKE '%address%' THEN 'ADDRESS'
  WHEN {0} LIKE '%time%' OR {0} LIKE '%date%' THEN 'TIMESTAMP' WHEN {0} LIKE '%amount%' OR {0} LIKE '%price%' THEN 'AMOUNT' WHEN {0} LIKE '%status%' OR {0} LIKE '%state%' THEN 'STATUS' END"""
BARE = "replace(replace(lower({0}), '_', ''), '-', '')"


def allowed(s, d):
    """Entity pairs that may depend on each other: the same entity, and the next one of its brand by name."""
    e = entities(s, d).select("entity", F.split_part("entity", F.lit("-"), F.lit(2)).alias("brand"))
    following = e.withColumn("target", F.lead("entity").over(Window.partitionBy("brand").orderBy("entity"))).where("target IS NOT NULL")
    return e.select(F.col("entity").alias("source"), F.col("entity").alias("target")).unionByName(following.select(F.col("entity").alias("source"), "target"))


def _matches(s, d):
    return D.field_match_dependencies(fields(s, d, "request"), fields(s, d, "response"), allowed(s, d))


def related(s, d):
    brand = F.split_part("entity", F.lit("-"), F.lit(2))
    e = entities(s, d).select("entity", brand.alias("brand"))
    return e.select(F.col("entity").alias("source"), "brand").join(e.select(F.col("entity").alias("target"), "brand"), "brand").where("source < target").drop("brand")


RELATED = "related AS (SELECT a.entity AS source, b.entity AS target FROM ent a JOIN ent b ON split_part(a.entity, '-', 2) = split_part(b.entity, '-', 2) AND a.entity < b.entity)"
OPTYPE = """CASE WHEN lower(path) LIKE '%/create%' OR method = 'POST' THEN 'create' WHEN lower(path) LIKE '%/update%' OR method IN ('PUT', 'PATCH') THEN 'update'
  WHEN lower(path) LIKE '%/delete%' OR method = 'DELETE' THEN 'delete' WHEN lower(path) LIKE '%/page%' THEN 'page' WHEN lower(path) LIKE '%/list%' THEN 'list'
  WHEN lower(path) LIKE '%/get%' OR lower(path) LIKE '%/{id}%' OR method = 'GET' THEN 'get' ELSE 'other' END"""


def api_edges(s, d):
    """Edges between APIs: each update or delete to the first get of its entity, each create to the first list."""
    kind = T.operation_type(F.col("path"), F.col("method"))
    lists = apis(s, d).where(kind == "list").groupBy("entity").agg(F.min_by("operation_id", "ord").alias("dst"))
    create = apis(s, d).where(kind == "create").join(lists, "entity").select(F.col("operation_id").alias("src"), "dst", F.lit(0.8).alias("score"))
    return D.crud_flow_dependencies(apis(s, d)).unionByName(create)


API_EDGES = f"""
kinds AS (SELECT *, {OPTYPE} AS kind FROM apis),
crud AS (SELECT k.operation_id AS src, g.dst, CAST(0.85 AS DOUBLE) AS score FROM kinds k JOIN (SELECT entity, arg_min(operation_id, ord) AS dst FROM kinds WHERE kind = 'get' GROUP BY ALL) g USING (entity) WHERE kind IN ('update', 'delete')),
aedges AS (SELECT src, dst, score FROM crud UNION ALL SELECT k.operation_id, g.dst, CAST(0.8 AS DOUBLE) FROM kinds k JOIN (SELECT entity, arg_min(operation_id, ord) AS dst FROM kinds WHERE kind = 'list' GROUP BY ALL) g USING (entity) WHERE kind = 'create')"""


def _vectors(s, d):
    return table(s, d, "embeddings")


def _queries(s, d):
    return _vectors(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _centroids(s, d):
    each = _vectors(s, d).select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))


def _lca(s, d):
    t = V.tree_intervals(tree(s, d))
    pairs = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string")).alias("b")).distinct()
    return V.lowest_common_ancestor(pairs, t)


def _between(s, d):
    pairs = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string")).alias("b")).distinct()
    return G.path_between(pairs, G.tree_paths(tree(s, d))).withColumn("path", F.array_join("path", ">"))


def _weights(s, d):
    return edges(s, d).select("src", "dst", F.least(F.col("score"), F.lit(0.95)).alias("weight"))


def _dag(s, d):
    """The whole graph of part types and sizes, without scores."""
    return edges(s, d).select("src", "dst")


def _parts_edges(s, d):
    """A sparse graph with cycles and long ways: each part to the next part of its supplier's orders, by number."""
    li = table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    step = li.withColumn("dst", F.lead("l_partkey").over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))).where("dst IS NOT NULL AND (l_partkey + l_suppkey) % 3 != 0")
    back = F.when(F.expr("(l_partkey * 7 + l_suppkey) % 50 = 0"), F.struct(F.col("dst").alias("src"), F.col("l_partkey").alias("dst")))
    ways = F.array_compact(F.array(F.struct(F.col("l_partkey").alias("src"), "dst"), back))
    text = lambda c: F.lpad(F.col(f"way.{c}").cast("string"), 9, "0").alias(c)
    return step.select(F.explode(ways).alias("way")).select(text("src"), text("dst"))


def _parts_graph(s, d):
    return cut(_parts_edges(s, d).distinct())


def _both_ends(e):
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def _of_parts(job):
    def run(s, d):
        with Scratch(s) as keep:
            e = keep(_parts_edges(s, d))
            return job(_both_ends(e), e)

    return run


def _expanded(s, d):
    """Plans of suppliers whose steps start at the types of their parts; steps that add no node stay as rows of their own."""
    kinds = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    li = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(kinds, F.lit("-"), (F.col("p_size") % 10).cast("string")).alias("agent")), "l_partkey")
    steps = li.groupBy(F.col("l_suppkey").alias("plan_id"), F.col("l_linenumber").alias("step")).agg(F.min("agent").alias("agent"))
    return G.expand_plan(steps, _dag(s, d), G.topological_order(_nodes(s, d), _dag(s, d)), every=True)


def _expanded_parts(s, d):
    """Plans of suppliers whose steps start at their highest parts, over the sparse graph of parts."""
    e = _parts_graph(s, d)
    steps = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("plan_id"), F.col("l_linenumber").alias("step")).agg(F.lpad(F.max("l_partkey").cast("string"), 9, "0").alias("agent"))
    return G.expand_plan(steps, e, G.topological_order(_both_ends(e), e))


def _nodes(s, d):
    e = edges(s, d)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def _grants(s, d):
    li = table(s, d, "lineitem")
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 3 == k, (F.col("l_partkey") % 40).cast("string"))))
    return li.groupBy(F.col("l_suppkey").alias("agent_id")).agg(pick(0).alias("direct"), pick(1).alias("composed"), pick(2).alias("delegated"))


MATRIX = """mat AS (SELECT agent_id, capability, arg_max(mode, o) AS mode FROM (
  SELECT DISTINCT l_suppkey AS agent_id, CAST(l_partkey % 40 AS VARCHAR) AS capability, l_linenumber % 3 AS o, ['EXECUTE', 'READ_ONLY', 'DELEGATE'][l_linenumber % 3 + 1] AS mode FROM lineitem) GROUP BY ALL)"""


def _permissions(s, d):
    ask = table(s, d, "events").select("event_id", (F.col("user_id") % 100).alias("agent_id"), (F.col("user_id") % 40).cast("string").alias("capability"), F.element_at(F.array(*map(F.lit, R.MODES)), (F.col("event_id") % 4 + 1).cast("int")).alias("mode"))
    return R.check_permission(ask, R.access_matrix(_grants(s, d))).select("event_id", "allowed")


def _clusters(s, d):
    return apis(s, d).select("operation_id", "entity", "method", "path", "ord", "tags", F.col("entity").alias("cluster"))


def _fields_by_api(s, d):
    side = lambda x: fields(s, d, x).groupBy("operation_id").agg(F.array_sort(F.collect_set("name")).alias(f"{x}_fields"))
    return side("request").join(side("response"), "operation_id")


def _clustered(s, d):
    rows = apis(s, d).join(fields(s, d, "request").groupBy("operation_id").agg(F.collect_set("name").alias("fields")), "operation_id")
    return A.entity_clusters(rows)


def _steps(s, d):
    li = table(s, d, "lineitem").join(apis(s, d).select(F.col("ord").alias("l_partkey"), "operation_id").hint("merge"), "l_partkey")
    return li.groupBy(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("pos")).agg(F.min("operation_id").alias("operation_id"))


def _bindings(s, d):
    """Steps of even orders take what flows on their path; odd ones have no flow and take their inputs."""
    source = F.when(F.col("pos") % 5 == 0, F.col("name")).otherwise(F.concat("from_operation", F.lit(".response."), "name"))
    flow = _flow(s, d).where("path_id % 2 = 0").withColumn("source", source)
    return X.parameter_bindings(_steps(s, d), flow, fields(s, d, "request"))


def _coverage(s, d):
    """Scenarios of orders whose descriptions name the summary of their first step only."""
    a = apis(s, d).select("operation_id", "method", "path", "summary")
    steps = _steps(s, d)
    first = steps.groupBy("path_id").agg(F.min_by("operation_id", "pos").alias("operation_id")).join(a, "operation_id")
    outcome = F.when(F.col("path_id") % 4 == 0, "Success in the end").otherwise("error is handled")
    rows = first.select("path_id", F.concat(F.lit("Calls "), "summary").alias("description"), outcome.alias("expected_outcome"), F.when(F.col("path_id") % 2 == 0, "exception").otherwise("normal").alias("scenario_type"))
    return X.coverage_warnings(rows, steps, a)


def _flow(s, d):
    steps = _steps(s, d)
    return D.parameter_flow(steps, fields(s, d, "response").select("operation_id", "name"), fields(s, d, "request").select("operation_id", "name"))


def _reporting(s, d):
    t = V.tree_intervals(tree(s, d)).select("agent_id", F.col("depth").alias("level"))
    return R.reporting_lines(t)


QUERIES = {
    "normalize_path": lambda s, d: table(s, d, "pages").select("page_id", T.normalize_path(F.regexp_extract("url", "://[^/]+([^?#]*)", 1)).alias("path"), F.size(T.path_segments(F.regexp_extract("url", "://[^/]+([^?#]*)", 1))).alias("segments")),
    "clean_description": lambda s, d: table(s, d, "pages").select("page_id", F.md5(T.clean_description(F.col("html"))).alias("h")),
    "path_anchor": lambda s, d: apis(s, d).select("operation_id", T.path_anchor(F.col("path"), F.col("tags")).alias("anchor")),
    "operation_type": lambda s, d: apis(s, d).select("operation_id", T.operation_type(F.col("path"), F.col("method")).alias("kind"), T.is_write(F.col("path"), F.col("method")).alias("writes"), T.crud(F.col("method")).alias("crud"), T.action_verb(F.col("operation_id")).alias("verb")),
    "canonical_entity": lambda s, d: fields(s, d, "request").select("operation_id", "name", T.canonical_entity(F.col("name")).alias("canonical"), F.round(T.name_similarity(F.col("name"), F.col("entity")), 9).alias("similarity")),
    "entity_rollup": lambda s, d: A.entity_rollup(apis(s, d)).withColumn("operations", F.array_join("operations", ",")),
    "capability_rollup": lambda s, d: A.capability_rollup(_clusters(s, d)),
    "entity_clusters": _clustered,
    "refine_crud": lambda s, d: A.refine_crud(_clusters(s, d).withColumn("cluster_type", F.lit("entity"))),
    "tag_groups": lambda s, d: A.tag_groups(apis(s, d)).select("operation_id", "tag", "route"),
    "regroup_scattered": lambda s, d: A.regroup_scattered(_clusters(s, d)),
    "detect_changes": lambda s, d: A.detect_changes(apis(s, d).where("ord % 7 != 0"), apis(s, d).where("ord % 5 != 0").withColumn("summary", F.when(F.col("ord") % 11 == 0, "new").otherwise(F.col("summary")))),
    "schema_similarity": lambda s, d: A.schema_similarity(_fields_by_api(s, d)),
    "schema_classes": lambda s, d: A.schema_classes(_fields_by_api(s, d)),
    "similar_paths": lambda s, d: A.similar_paths(apis(s, d).withColumn("path", F.concat(F.lit("/admin-api"), "path"))),
    "cluster_summary": lambda s, d: A.cluster_summary(_clusters(s, d)),
    "constraints": lambda s, d: A.constraints(apis(s, d)),
    "entity_relations_by_field": lambda s, d: D.entity_relations_by_field(fields(s, d, "request").select("entity", F.concat(F.split_part("entity", F.lit("-"), F.lit(1)), F.lit("-"), F.lit("brand"), F.length("name").cast("string"), F.lit("_id")).alias("field")).distinct(), entities(s, d)),
    "entity_relations_by_path": lambda s, d: D.entity_relations_by_path(apis(s, d), entities(s, d)),
    "field_match_dependencies": lambda s, d: _matches(s, d).withColumn("matched", F.array_join("matched", ",")),
    "field_match_classes": lambda s, d: D.field_match_classes(fields(s, d, "request"), fields(s, d, "response"), allowed(s, d))[0].withColumn("matched", F.array_join("matched", ",")),
    "write_read_dependencies": lambda s, d: D.write_read_dependencies(apis(s, d), related(s, d), api_edges(s, d)),
    "crud_flow_dependencies": lambda s, d: D.crud_flow_dependencies(apis(s, d)),
    "explicit_edges": lambda s, d: D.explicit_edges(edges(s, d), _nodes(s, d).where("node like 's%' or node like '%5'")),
    "belongs_to": lambda s, d: D.belongs_to(apis(s, d), entities(s, d)),
    "neighbours": lambda s, d: D.neighbours(edges(s, d)).select("node", F.size("depends_on").alias("n_out"), F.size("depended_by").alias("n_in"), F.element_at("depends_on", 1).alias("best")),
    "api_roles": lambda s, d: D.api_roles(D.write_read_dependencies(apis(s, d), related(s, d), api_edges(s, d)).unionByName(api_edges(s, d)), apis(s, d).select("operation_id", "entity")),
    "entry_points": lambda s, d: D.entry_points(apis(s, d), api_edges(s, d)),
    "parameter_flow": _flow,
    "parameter_bindings": _bindings,
    "dependency_map": lambda s, d: X.dependency_map(_steps(s, d)),
    "coverage_warnings": _coverage,
    "adjacency": lambda s, d: G.adjacency(edges(s, d)).select("src", F.array_join("neighbours", ",").alias("neighbours")),
    "find_paths": lambda s, d: G.find_paths(edges(s, d), "economy-1", "small-3").withColumn("path", F.array_join("path", ">")),
    "greedy_paths": lambda s, d: G.greedy_paths(_nodes(s, d), edges(s, d)).withColumn("path", F.array_join("path", ">")),
    "tree_roots": lambda s, d: G.tree_roots(tree(s, d)),
    "tree_leaves": lambda s, d: G.tree_leaves(tree(s, d)),
    "tree_paths": lambda s, d: G.tree_paths(tree(s, d)).withColumn("path", F.array_join("path", "/")),
    "tree_closure": lambda s, d: G.closure(G.tree_paths(tree(s, d))),
    "siblings": lambda s, d: G.siblings(tree(s, d)),
    "lowest_common_ancestor": _lca,
    "influence_subgraph": lambda s, d: G.influence(_weights(s, d), "economy-1"),
    "scc": lambda s, d: G.scc(_nodes(s, d), _dag(s, d)),
    "topological_order": lambda s, d: G.topological_order(_nodes(s, d), _dag(s, d)),
    "scc_of_parts": _of_parts(G.scc),
    "topological_order_of_parts": _of_parts(G.topological_order),
    "path_between": _between,
    "expand_plan": _expanded,
    "expand_plan_of_parts": _expanded_parts,
    "fk_violations": lambda s, d: G.fk_violations(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent")), table(s, d, "customer").where("c_custkey % 10 != 0").select(F.col("c_custkey").alias("id"))),
    "cascade_set": lambda s, d: G.cascade_set(tree(s, d).select(F.col("agent_id").alias("id"), F.col("parent_id").alias("parent")), table(s, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))),
    "vector_search": lambda s, d: R.vector_search(_vectors(s, d), _queries(s, d), 5),
    "procedure_search": lambda s, d: R.procedure_search(_vectors(s, d).withColumn("domain", F.concat(F.lit("d"), (F.col("label") % 3).cast("string"))), _queries(s, d), 5, "d1").select("query_id", "vec_id", "rank"),
    "role_alignment": lambda s, d: R.role_alignment(_vectors(s, d), _centroids(s, d), least=0.2).select("vec_id", "role_id", "rank"),
    "nearest_cluster": lambda s, d: R.nearest_cluster(_vectors(s, d).where("vec_id % 20 = 0"), _vectors(s, d).where("vec_id % 20 != 0").withColumn("cluster", F.col("label"))).select("vec_id", "cluster"),
    "domain_scores": lambda s, d: R.domain_scores(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), s.createDataFrame([("the", "en"), ("and", "en"), ("der", "de"), ("und", "de"), ("que", "es"), ("las", "es"), ("dans", "fr")], "keyword string, domain string")),
    "access_matrix": lambda s, d: R.access_matrix(_grants(s, d)),
    "check_permission": _permissions,
    "shared_capabilities": lambda s, d: R.shared_capabilities(R.access_matrix(_grants(s, d)).select("agent_id", "capability")),
    "orphan_apis": lambda s, d: R.orphan_apis(apis(s, d), api_edges(s, d).select(F.col("src").alias("operation_id"))).select("operation_id"),
    "topology_stats": lambda s, d: R.topology_stats(tree(s, d).select(F.substring("agent_id", 1, 1).alias("type")), edges(s, d).select(F.when(F.col("score") > 0.8, "strong").otherwise("weak").alias("type"))),
    "reporting_lines": _reporting,
    "dedupe_paths": lambda s, d: G.dedupe_paths(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("path"), F.min("l_orderkey").alias("ord"))).select("ord", F.array_join("path", ",").alias("path")),
    "top_edges": lambda s, d: S.top_per_key(edges(s, d), "src", "score", 2, "dst").select("src", "dst", "rank"),
}

PATHS_CTE = f"""WITH RECURSIVE {TREE}, p AS (SELECT agent_id, 0 AS depth, [agent_id] AS path FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.agent_id, p.depth + 1, list_append(p.path, t.agent_id) FROM tree t JOIN p ON t.parent_id = p.agent_id)"""
SCHEMAS = f"""{APIS}, {FIELDS.format('q', 0)}, {FIELDS.format('p', 1).split('),', 1)[1]},
  g AS (SELECT q.operation_id AS o, list_sort(list(DISTINCT q.name)) AS rq FROM q GROUP BY ALL), h AS (SELECT p.operation_id AS o, list_sort(list(DISTINCT p.name)) AS rp FROM p GROUP BY ALL), b AS (SELECT * FROM g JOIN h USING (o)),
  classes AS (SELECT min(o) AS o, count(*) AS many, rq, rp FROM b GROUP BY rq, rp)"""
URLPATH = "regexp_extract(url, '://[^/]+([^?#]*)', 1)"
COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
CENTERS = "e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL), centers AS (SELECT label, list(x ORDER BY pos) AS center FROM m GROUP BY ALL)"
SQL = {
    "procedure_search": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round({COS.format('q.embedding', 'e.embedding')}, 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER w AS INT) AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id) QUALIFY row_number() OVER w <= 5) SELECT query_id, vec_id, rank FROM r WHERE label % 3 = 1""",
    "role_alignment": f"""WITH {CENTERS}, s AS (SELECT vec_id, c.label AS role_id, round({COS.format('embedding', 'center')} / sqrt({COS.format('embedding', 'embedding')}) / sqrt({COS.format('center', 'center')}), 9) AS similarity FROM embeddings, centers c)
        SELECT vec_id, CAST(role_id AS BIGINT) AS role_id, CAST(row_number() OVER w AS INT) AS rank FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY similarity DESC, role_id) QUALIFY row_number() OVER w <= 3 AND similarity >= 0.2""",
    "nearest_cluster": f"""WITH s AS (SELECT q.vec_id, e.vec_id AS other, e.label, round({COS.format('q.embedding', 'e.embedding')} / sqrt({COS.format('q.embedding', 'q.embedding')}) / sqrt({COS.format('e.embedding', 'e.embedding')}), 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id % 20 != 0)
        SELECT vec_id, CASE WHEN similarity >= 0.6 THEN CAST(label AS VARCHAR) ELSE 'own_' || vec_id END AS cluster FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other) = 1""",
    "influence_subgraph": f"""WITH RECURSIVE {EDGES}, p AS (SELECT 'economy-1' AS node, 1.0::DOUBLE AS strength, 0 AS hop UNION
        SELECT dst, max(round(strength * least(score, 0.95), 12)), hop + 1 FROM p JOIN edges ON node = src WHERE hop < 5 AND round(strength * least(score, 0.95), 12) >= 0.3 GROUP BY dst, hop + 1)
        SELECT node, max(strength) AS strength FROM p GROUP BY node""",
    "scc": f"WITH {EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, (SELECT min(node) FROM n) AS component FROM n",
    "normalize_path": f"SELECT page_id, regexp_replace(regexp_replace({URLPATH}, '(?i)/[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', '/{{uuid}}', 'g'), '/[0-9]+', '/{{id}}', 'g') AS path, CAST(len(list_filter(string_split({URLPATH}, '/'), lambda x: x != '' AND NOT starts_with(x, '{{'))) AS INT) AS segments FROM pages",
    "clean_description": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS h FROM pages",
    "path_anchor": f"WITH {APIS} SELECT operation_id, entity AS anchor FROM apis",
    "operation_type": f"""WITH {APIS} SELECT operation_id, {OPTYPE} AS kind, method IN ('POST', 'PUT', 'PATCH') OR path LIKE '%/create%' OR path LIKE '%/update%' AS writes,
        CASE method WHEN 'POST' THEN 'create' WHEN 'GET' THEN 'read' WHEN 'PUT' THEN 'update' WHEN 'DELETE' THEN 'delete' END AS crud,
        CASE split_part(operation_id, '_', 1) WHEN 'page' THEN NULL ELSE split_part(operation_id, '_', 1) END AS verb FROM apis""",
    "canonical_entity": f"""WITH {APIS}, {FIELDS.format('f', 0)} SELECT operation_id, name, {CANONICAL.format(BARE.format('name'))} AS canonical,
        round(1 - levenshtein({BARE.format('name')}, {BARE.format('entity')}) / greatest(length({BARE.format('name')}), length({BARE.format('entity')})), 9) AS similarity FROM f""",
    "entity_rollup": f"WITH {APIS} SELECT entity, count(*) AS api_count, array_to_string(list_sort(list(DISTINCT {OPTYPE})), ',') AS operations FROM apis GROUP BY entity",
    "capability_rollup": f"""WITH {APIS}, k AS (SELECT *, {OPTYPE} AS kind FROM apis), v AS (SELECT entity, kind, count(*) AS n, min(ord) AS f FROM k GROUP BY ALL), m AS (SELECT entity, arg_max(kind, (n, -f)) AS main_verb FROM v GROUP BY ALL)
        SELECT entity AS cluster, count(*) AS api_count, bool_or(method = 'POST') AS has_create, bool_or(method = 'GET') AS has_read, bool_or(method = 'PUT') AS has_update, bool_or(method = 'DELETE') AS has_delete,
        (CAST(bool_or(method = 'POST') AS INT) + CAST(bool_or(method = 'GET') AS INT) + CAST(bool_or(method = 'PUT') AS INT) + CAST(bool_or(method = 'DELETE') AS INT)) / 4 AS completeness, any_value(tags[1]) AS main_tag, any_value(main_verb) AS main_verb FROM k JOIN m USING (entity) GROUP BY entity""",
    "refine_crud": f"""WITH {APIS}, k AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, (SELECT count(DISTINCT method) FROM apis b WHERE b.entity = a.entity) AS kinds FROM apis a)
        SELECT operation_id, entity AS cluster, CASE WHEN kinds >= 2 THEN 'crud_complete' WHEN n = 1 THEN 'atomic' ELSE 'entity' END AS cluster_type FROM k""",
    "tag_groups": f"WITH {APIS}, k AS (SELECT operation_id, tags[1] AS tag, count(*) OVER (PARTITION BY tags[1]) AS n FROM apis) SELECT operation_id, tag, CASE WHEN n = 1 THEN 'atomic' WHEN n < 8 THEN 'tag_grouped' ELSE 'density' END AS route FROM k",
    "regroup_scattered": f"""WITH {APIS}, k AS (SELECT *, count(*) OVER (PARTITION BY entity) < 3 AS scattered FROM apis)
        SELECT operation_id, CASE WHEN scattered THEN 'atomic_' || operation_id ELSE entity END AS cluster, CASE WHEN scattered THEN 'atomic' ELSE 'kept' END AS action FROM k""",
    "detect_changes": f"""WITH {APIS} SELECT operation_id, CASE WHEN ord % 7 = 0 THEN 'added' WHEN ord % 5 = 0 THEN 'removed' ELSE 'modified' END AS change FROM apis
        WHERE (ord % 7 = 0 AND ord % 5 != 0) OR (ord % 5 = 0 AND ord % 7 != 0) OR (ord % 5 != 0 AND ord % 7 != 0 AND ord % 11 = 0)""",
    "cluster_summary": f"""WITH {APIS}, z AS (SELECT entity, count(*) AS n FROM apis GROUP BY ALL), s AS (SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS apis, avg(n) AS a, stddev_pop(n) AS sd, count(*) FILTER (n = 1) AS one FROM z)
        SELECT clusters, apis, round(a, 6) AS avg_size, round(sd, 6) AS std_size, round(one / apis, 6) AS atomic_share, round(CASE WHEN a BETWEEN 3 AND 8 THEN 1.0 ELSE greatest(0, 1 - abs(a - 5.5) / 10) END * (1 - least(1.0, sd / a) * 0.5), 6) AS distribution_score FROM s""",
    "constraints": f"""WITH {APIS}, c AS (SELECT operation_id, unnest(CASE WHEN method = 'DELETE' THEN ['audit', 'approval'] WHEN method = 'PUT' THEN ['audit'] ELSE [] END) AS "constraint" FROM apis)
        SELECT *, substr(md5(operation_id || ':' || "constraint"), 1, 8) AS contract_id FROM c""",
    "schema_similarity": f"""WITH {SCHEMAS},
        s AS (SELECT x.o AS a, y.o AS b, x.many AS n_a, y.many AS n_b, round(0.7 * len(list_intersect(x.rp, y.rp)) / len(list_distinct(list_concat(x.rp, y.rp))) + 0.3 * len(list_intersect(x.rq, y.rq)) / len(list_distinct(list_concat(x.rq, y.rq))), 9) AS similarity FROM classes x JOIN classes y ON x.o < y.o)
        SELECT * FROM s WHERE similarity >= 0.5""",
    "schema_classes": f"""WITH {SCHEMAS} SELECT b.o AS operation_id, classes.o AS class FROM b JOIN classes USING (rq, rp)""",
    "similar_paths": f"""WITH {APIS}, s AS (SELECT array_to_string(list_sort(list_distinct(list_filter(string_split('/admin-api' || path, '/'), lambda x: x != '' AND NOT starts_with(x, '{{'))))
          , '/') AS id, count(*) AS many FROM apis GROUP BY 1), l AS (SELECT *, string_split(id, '/') AS x FROM s)
        SELECT * FROM (SELECT a.id AS a, b.id AS b, a.many AS n_a, b.many AS n_b, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 9) AS similarity FROM l a JOIN l b ON a.id < b.id) WHERE similarity >= 0.8""",
    "entity_relations_by_path": f"""WITH {APIS}, {ENTITIES}, v AS (SELECT entity AS target, unnest([entity, replace(entity, '-', ''), entity || 's', split_part(entity, '-', 1), split_part(entity, '-', 2)]) AS variation FROM ent), p AS (SELECT DISTINCT entity AS source, lower(path) AS path FROM apis)
        SELECT DISTINCT source, target, 'PATH_HIERARCHY' AS type, CAST(0.75 AS DOUBLE) AS score FROM p JOIN v ON contains(path, variation) AND source != target""",
    "field_match_dependencies": f"""WITH {APIS}, {ENTITIES}, n AS (SELECT entity AS source, lead(entity) OVER (PARTITION BY split_part(entity, '-', 2) ORDER BY entity) AS target FROM ent),
        ok AS (SELECT entity AS source, entity AS target FROM ent UNION ALL SELECT source, target FROM n WHERE target IS NOT NULL), {FIELDS.format('q', 0)}, {FIELDS.format('p', 1).split('),', 1)[1]},
        x AS (SELECT *, {CANONICAL.format(BARE.format('name'))} AS canonical, CASE WHEN name LIKE '%Amount%' THEN 'number' ELSE 'string' END AS type, CASE WHEN length(name) % 2 = 0 THEN 0.95 ELSE 0.5 END AS w, {BARE.format('name')} AS bare FROM q WHERE name != 'status'),
        y AS (SELECT *, {CANONICAL.format(BARE.format('name'))} AS canonical, CASE WHEN name LIKE '%Amount%' THEN 'number' ELSE 'string' END AS type, CASE WHEN length(name) % 2 = 0 THEN 0.95 ELSE 0.5 END AS w, {BARE.format('name')} AS bare FROM p WHERE name != 'status'),
        m AS (SELECT x.operation_id AS src, y.operation_id AS dst, x.name, 1 - levenshtein(x.bare, y.bare) / greatest(length(x.bare), length(y.bare)) AS near, least(x.w, y.w) AS w, CASE WHEN x.entity = y.entity THEN 0.05 ELSE 0 END AS own FROM x JOIN ok ON ok.source = x.entity JOIN y ON y.entity = ok.target AND x.canonical = y.canonical AND x.type = y.type AND x.operation_id != y.operation_id),
        s AS (SELECT src, dst, name, round(0.4 + CASE WHEN near >= 0.5 THEN 0.3 * near + 0.1 * w + own ELSE 0 END, 9) AS score FROM m)
        SELECT src, dst, max(score) AS score, array_to_string(list_sort(list(DISTINCT name)), ',') AS matched FROM s WHERE score >= 0.7 GROUP BY src, dst""",
    "field_match_classes": f"""WITH {APIS}, {ENTITIES}, n AS (SELECT entity AS source, lead(entity) OVER (PARTITION BY split_part(entity, '-', 2) ORDER BY entity) AS target FROM ent),
        ok AS (SELECT entity AS source, entity AS target FROM ent UNION ALL SELECT source, target FROM n WHERE target IS NOT NULL), {FIELDS.format('q', 0)}, {FIELDS.format('p', 1).split('),', 1)[1]},
        x AS (SELECT *, {CANONICAL.format(BARE.format('name'))} AS canonical, CASE WHEN name LIKE '%Amount%' THEN 'number' ELSE 'string' END AS type, CASE WHEN length(name) % 2 = 0 THEN 0.95 ELSE 0.5 END AS w, {BARE.format('name')} AS bare FROM q WHERE name != 'status'),
        y AS (SELECT *, {CANONICAL.format(BARE.format('name'))} AS canonical, CASE WHEN name LIKE '%Amount%' THEN 'number' ELSE 'string' END AS type, CASE WHEN length(name) % 2 = 0 THEN 0.95 ELSE 0.5 END AS w, {BARE.format('name')} AS bare FROM p WHERE name != 'status'),
        m AS (SELECT x.operation_id AS src, y.operation_id AS dst, x.name, 1 - levenshtein(x.bare, y.bare) / greatest(length(x.bare), length(y.bare)) AS near, least(x.w, y.w) AS w, CASE WHEN x.entity = y.entity THEN 0.05 ELSE 0 END AS own FROM x JOIN ok ON ok.source = x.entity JOIN y ON y.entity = ok.target AND x.canonical = y.canonical AND x.type = y.type AND x.operation_id != y.operation_id),
        s AS (SELECT src, dst, name, round(0.4 + CASE WHEN near >= 0.5 THEN 0.3 * near + 0.1 * w + own ELSE 0 END, 9) AS score FROM m),
        e AS (SELECT src, dst, max(score) AS score, array_to_string(list_sort(list(DISTINCT name)), ',') AS matched FROM s WHERE score >= 0.7 GROUP BY src, dst),
        fx AS (SELECT operation_id, entity, list_sort(list(DISTINCT name)) AS f FROM x WHERE canonical IS NOT NULL GROUP BY ALL), cx AS (SELECT operation_id, min(operation_id) OVER (PARTITION BY entity, f) AS src_class FROM fx),
        fy AS (SELECT operation_id, entity, list_sort(list(DISTINCT name)) AS f FROM y WHERE canonical IS NOT NULL GROUP BY ALL), cy AS (SELECT operation_id, min(operation_id) OVER (PARTITION BY entity, f) AS dst_class FROM fy)
        SELECT src_class, dst_class, min(score) AS score, min(matched) AS matched, count(*) AS edges FROM e JOIN cx ON cx.operation_id = src JOIN cy ON cy.operation_id = dst GROUP BY src_class, dst_class""",
    "write_read_dependencies": f"""WITH {APIS}, {ENTITIES}, {RELATED}, {API_EDGES}, r AS (SELECT entity, arg_min(operation_id, ord) AS dst FROM apis WHERE method = 'GET' OR path LIKE '%/get%' OR path LIKE '%/list%' OR path LIKE '%/page%' GROUP BY ALL)
        SELECT a.operation_id AS src, r.dst, CAST(0.6 AS DOUBLE) AS score FROM apis a JOIN related ON source = a.entity JOIN r ON r.entity = target WHERE (method IN ('POST', 'PUT') OR path LIKE '%/create%' OR path LIKE '%/update%') AND a.operation_id NOT IN (SELECT src FROM aedges)""",
    "crud_flow_dependencies": f"WITH {APIS}, {API_EDGES} SELECT src, dst, score FROM crud",
    "explicit_edges": f"WITH {EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), k AS (SELECT node FROM n WHERE node LIKE 's%' OR node LIKE '%5') SELECT src, dst, CAST(1.0 AS DOUBLE) AS score, 'CERTAIN' AS type FROM edges WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)",
    "belongs_to": f"WITH {APIS} SELECT operation_id, entity FROM apis WHERE entity != 'unknown'",
    "neighbours": f"""WITH {EDGES}, o AS (SELECT src AS node, count(*) AS n_out, arg_min(dst, (-score, dst)) AS best FROM edges GROUP BY ALL), i AS (SELECT dst AS node, count(*) AS n_in FROM edges GROUP BY ALL)
        SELECT node, CAST(n_out AS INT) AS n_out, CAST(n_in AS INT) AS n_in, best FROM o FULL JOIN i USING (node)""",
    "api_roles": f"""WITH {APIS}, {ENTITIES}, {RELATED}, {API_EDGES}, r AS (SELECT entity, arg_min(operation_id, ord) AS dst FROM apis WHERE method = 'GET' OR path LIKE '%/get%' OR path LIKE '%/list%' OR path LIKE '%/page%' GROUP BY ALL),
        e AS (SELECT a.operation_id AS src, r.dst FROM apis a JOIN related ON source = a.entity JOIN r ON r.entity = target WHERE (method IN ('POST', 'PUT') OR path LIKE '%/create%' OR path LIKE '%/update%') AND a.operation_id NOT IN (SELECT src FROM aedges) UNION ALL SELECT src, dst FROM aedges),
        t AS (SELECT e.src, e.dst, a.entity != b.entity AS far FROM e JOIN apis a ON a.operation_id = src JOIN apis b ON b.operation_id = dst),
        o AS (SELECT src AS operation_id, count(*) AS outgoing FROM t WHERE far GROUP BY ALL), i AS (SELECT dst AS operation_id, count(*) AS incoming FROM t GROUP BY ALL),
        x AS (SELECT operation_id, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM apis LEFT JOIN o USING (operation_id) LEFT JOIN i USING (operation_id))
        SELECT *, CASE WHEN outgoing > 0 AND incoming > 0 THEN 'BRIDGE' WHEN incoming > 0 THEN 'PRODUCER' WHEN outgoing > 0 THEN 'CONSUMER' ELSE 'INTERNAL' END AS role FROM x""",
    "parameter_flow": f"""WITH {APIS}, {FIELDS.format('q', 0)}, {FIELDS.format('p', 1).split('),', 1)[1]},
        st AS (SELECT l_orderkey AS path_id, l_linenumber AS pos, min(operation_id) AS operation_id FROM lineitem JOIN apis ON ord = l_partkey GROUP BY ALL),
        g AS (SELECT path_id, name, min(pos) AS from_pos, arg_min(operation_id, pos) AS from_operation FROM st JOIN p USING (operation_id) GROUP BY ALL)
        SELECT st.path_id, pos, st.operation_id, q.name, from_pos, from_operation FROM st JOIN q ON q.operation_id = st.operation_id JOIN g ON g.path_id = st.path_id AND g.name = q.name WHERE from_pos < pos""",
    "parameter_bindings": f"""WITH {APIS}, {FIELDS.format('q', 0)}, {FIELDS.format('p', 1).split('),', 1)[1]},
        st AS (SELECT l_orderkey AS path_id, l_linenumber AS pos, min(operation_id) AS operation_id FROM lineitem JOIN apis ON ord = l_partkey GROUP BY ALL),
        g AS (SELECT path_id, name, min(pos) AS from_pos, arg_min(operation_id, pos) AS from_operation FROM st JOIN p USING (operation_id) GROUP BY ALL),
        fl AS (SELECT st.path_id, pos, st.operation_id, q.name, CASE WHEN pos % 5 = 0 THEN q.name ELSE from_operation || '.response.' || q.name END AS source FROM st JOIN q ON q.operation_id = st.operation_id JOIN g ON g.path_id = st.path_id AND g.name = q.name WHERE from_pos < pos AND st.path_id % 2 = 0),
        pr AS (SELECT *, lag(operation_id) OVER (PARTITION BY path_id ORDER BY pos) AS previous FROM st),
        fr AS (SELECT path_id, pos, operation_id, name, previous, lower(name) AS low FROM pr JOIN q USING (operation_id) WHERE (path_id, pos) NOT IN (SELECT (path_id, pos) FROM fl))
        SELECT path_id, pos, operation_id, name, CASE WHEN contains(source, '.') THEN 'dynamic_ref' ELSE 'static' END AS type, CASE WHEN contains(source, '.') THEN '{{' || source || '}}' ELSE source END AS value FROM fl
        UNION ALL SELECT path_id, pos, operation_id, name, CASE WHEN contains(low, 'id') AND previous IS NOT NULL THEN 'dynamic_ref' ELSE 'fake_data' END, CASE WHEN contains(low, 'id') AND previous IS NOT NULL THEN '{{' || previous || '.response.id}}' WHEN contains(low, 'email') THEN '{{{{fake_email}}}}' ELSE '{{{{fake_name}}}}' END
        FROM fr WHERE (contains(low, 'id') AND previous IS NOT NULL) OR contains(low, 'email') OR contains(low, 'name')""",
    "dependency_map": f"""WITH {APIS}, st AS (SELECT l_orderkey AS path_id, l_linenumber AS pos, min(operation_id) AS operation_id FROM lineitem JOIN apis ON ord = l_partkey GROUP BY ALL)
        SELECT * FROM (SELECT *, lag(operation_id) OVER (PARTITION BY path_id ORDER BY pos) AS depends_on FROM st) WHERE depends_on IS NOT NULL""",
    "coverage_warnings": f"""WITH {APIS}, st AS (SELECT l_orderkey AS path_id, l_linenumber AS pos, min(operation_id) AS operation_id FROM lineitem JOIN apis ON ord = l_partkey GROUP BY ALL), k AS (SELECT * FROM st JOIN apis USING (operation_id)),
        sc AS (SELECT path_id, lower('Calls ' || arg_min(summary, pos)) AS said, CASE WHEN path_id % 2 = 0 THEN 'exception' ELSE 'normal' END AS scenario_type FROM k GROUP BY path_id)
        SELECT path_id, scenario_type, 'write not described: ' || arg_min(operation_id, pos) AS warning FROM sc JOIN k USING (path_id) WHERE method IN ('POST', 'PUT', 'DELETE', 'PATCH') AND length(summary) > 3 AND NOT contains(said, lower(summary)) GROUP BY ALL
        UNION ALL SELECT path_id, scenario_type, 'exception with a success' FROM sc WHERE scenario_type = 'exception' AND path_id % 4 = 0""",
    "entry_points": f"""WITH {APIS}, {API_EDGES}, i AS (SELECT dst AS operation_id, count(*) AS indegree FROM aedges e JOIN apis a ON a.operation_id = src JOIN apis b ON b.operation_id = dst WHERE a.entity = b.entity GROUP BY ALL)
        SELECT entity, operation_id, coalesce(indegree, 0) AS indegree, CAST(row_number() OVER w AS INT) AS rank FROM apis LEFT JOIN i USING (operation_id) WINDOW w AS (PARTITION BY entity ORDER BY coalesce(indegree, 0), ord) QUALIFY row_number() OVER w <= 3""",
    "adjacency": f"WITH {EDGES} SELECT src, string_agg(dst, ',' ORDER BY -score, dst) AS neighbours FROM edges GROUP BY src",
    "find_paths": f"""WITH RECURSIVE {EDGES}, p AS (SELECT ['economy-1'] AS path, 0.0::DOUBLE AS total
        UNION ALL SELECT list_append(path, dst), total + score FROM p JOIN edges ON path[-1] = src WHERE NOT list_contains(path, dst) AND len(path) <= 3 AND path[-1] != 'small-3'),
        short AS (SELECT path, total / power(len(path) - 1, 1.2) AS score FROM p WHERE path[-1] = 'small-3' AND len(path) > 1),
        least AS (SELECT min(score) AS score, count(*) AS n, (SELECT max(score) FROM edges) AS most FROM (SELECT score FROM short ORDER BY score DESC LIMIT 100)),
        four AS (SELECT list_append(path, dst) AS path, p.total + e.score AS total FROM p JOIN edges e ON path[-1] = src, least l WHERE len(path) = 4 AND path[-1] != 'small-3' AND NOT list_contains(path, dst) AND (l.n < 100 OR p.total + l.most >= l.score * power(4, 1.2) - 1e-9 OR p.total + 2 * l.most >= l.score * power(5, 1.2) - 1e-9)),
        five AS (SELECT list_append(path, dst) AS path, four.total + e.score AS total FROM four JOIN edges e ON path[-1] = src WHERE path[-1] != 'small-3' AND dst = 'small-3'),
        every AS (SELECT path, score FROM short UNION ALL SELECT path, total / power(4, 1.2) FROM four WHERE path[-1] = 'small-3' UNION ALL SELECT path, total / power(5, 1.2) FROM five)
        SELECT array_to_string(path, '>') AS path, round(score, 9) AS score FROM every ORDER BY round(score, 9) DESC, path LIMIT 100""",
    "tree_roots": f"WITH {TREE} SELECT agent_id FROM tree WHERE parent_id IS NULL",
    "tree_leaves": f"WITH {TREE} SELECT agent_id FROM tree WHERE agent_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)",
    "tree_paths": f"{PATHS_CTE} SELECT agent_id, depth, array_to_string(path, '/') AS path FROM p",
    "tree_closure": f"{PATHS_CTE} SELECT unnest(path) AS ancestor, agent_id AS descendant, CAST(depth - unnest(range(len(path))) AS INT) AS distance FROM p",
    "siblings": f"WITH {TREE} SELECT agent_id, count(*) OVER (PARTITION BY parent_id) - 1 AS siblings FROM tree WHERE parent_id IS NOT NULL",
    "lowest_common_ancestor": """WITH q AS (SELECT DISTINCT 'c' || o_custkey AS a, 'n' || (o_orderkey % 25) AS b, o_custkey, o_orderkey % 25 AS n FROM orders)
        SELECT a, b, CASE WHEN c_nationkey = n THEN 'n' || n WHEN x.n_regionkey = y.n_regionkey THEN 'r' || x.n_regionkey END AS lca FROM q JOIN customer ON c_custkey = o_custkey JOIN nation x ON x.n_nationkey = c_nationkey JOIN nation y ON y.n_nationkey = n""",
    "path_between": """WITH q AS (SELECT DISTINCT 'c' || o_custkey AS a, o_custkey, o_orderkey % 25 AS n FROM orders), j AS (SELECT a, 'n' || n AS b, 'n' || c_nationkey AS cn, 'r' || x.n_regionkey AS cr, 'r' || y.n_regionkey AS br FROM q JOIN customer ON c_custkey = o_custkey JOIN nation x ON x.n_nationkey = c_nationkey JOIN nation y ON y.n_nationkey = n)
        SELECT a, b, CASE WHEN cn = b THEN a || '>' || b ELSE a || '>' || cn || '>' || cr || '>' || b END AS path FROM j WHERE cr = br""",
    "fk_violations": "SELECT o_custkey AS parent, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 != 0)",
    "cascade_set": f"{PATHS_CTE} SELECT agent_id AS id, depth AS round FROM p WHERE path[1] IN ('r0', 'r1')",
    "access_matrix": f"WITH {MATRIX} SELECT * FROM mat",
    "check_permission": f"""WITH {MATRIX}, r AS (SELECT event_id, user_id % 100 AS agent_id, CAST(user_id % 40 AS VARCHAR) AS capability, event_id % 4 AS want FROM events)
        SELECT event_id, coalesce(list_position(['MONITOR', 'READ_ONLY', 'DELEGATE', 'EXECUTE'], mode) - 1 >= want, FALSE) AS allowed FROM r LEFT JOIN mat USING (agent_id, capability)""",
    "shared_capabilities": f"WITH {MATRIX} SELECT capability, count(DISTINCT agent_id) AS agents FROM mat GROUP BY capability HAVING count(DISTINCT agent_id) >= 2",
    "orphan_apis": f"WITH {APIS}, {API_EDGES} SELECT operation_id FROM apis WHERE operation_id NOT IN (SELECT src FROM aedges)",
    "topology_stats": f"WITH {TREE}, {EDGES} SELECT substr(agent_id, 1, 1) AS name, count(*) AS n, 'node' AS part FROM tree GROUP BY 1 UNION ALL SELECT CASE WHEN score > 0.8 THEN 'strong' ELSE 'weak' END, count(*), 'edge' FROM edges GROUP BY 1",
    "reporting_lines": f"{PATHS_CTE}, n AS (SELECT depth - 1 AS level, count(*) AS reports FROM p GROUP BY 1) SELECT agent_id, depth AS level, reports FROM p JOIN n ON n.level = depth",
    "dedupe_paths": "WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS path FROM lineitem GROUP BY ALL) SELECT min(l_orderkey) AS ord, array_to_string(path, ',') AS path FROM p GROUP BY path",
    "top_edges": f"WITH {EDGES} SELECT src, dst, CAST(row_number() OVER w AS INT) AS rank FROM edges WINDOW w AS (PARTITION BY src ORDER BY score DESC, dst) QUALIFY row_number() OVER w <= 2",
    "vector_search": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 / (1 + list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
        SELECT *, CAST(row_number() OVER w AS INT) AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "domain_scores": """WITH k(keyword, domain) AS (VALUES ('the', 'en'), ('and', 'en'), ('der', 'de'), ('und', 'de'), ('que', 'es'), ('las', 'es'), ('dans', 'fr')),
        w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}]+'))) AS keyword FROM documents), h AS (SELECT domain, count(*) AS hits FROM w JOIN k USING (keyword) GROUP BY ALL),
        s AS (SELECT domain, hits, round(hits / (SELECT sum(hits) FROM h), 6) AS score FROM h) SELECT *, CASE WHEN row_number() OVER (ORDER BY score DESC, domain) = 1 THEN 'primary' WHEN score >= 0.15 THEN 'secondary' ELSE 'other' END AS kind FROM s""",
}
