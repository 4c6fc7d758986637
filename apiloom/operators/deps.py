"""Dependencies between APIs and relations between entities, by pruned joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.functions import text as T
from apiloom.session import cut

NOISE_FIELDS = ["timestamp", "message", "code", "status", "msg", "success", "error"]
LOCATION_WEIGHTS = {"path": 0.95, "query": 0.70, "body": 0.50}


def variations(entities: DataFrame) -> DataFrame:
    """(entity, ord, variation): the names under which an entity may be referred to."""
    return entities.select("entity", "ord", F.explode(T.entity_variations(F.col("entity"))).alias("variation"))


def entity_relations_by_field(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """A request field such as supplier_id refers to the entity that has `supplier` among its variations.

    Of several suffixes and entities the first in order is taken, then a field of its own entity gives no relation.
    """
    keys = fields.select("entity", "field", F.inline(T.entity_keys(F.col("field"))))
    found = keys.withColumnRenamed("ord", "suffix").join(variations(entities).select(F.col("entity").alias("target"), F.col("ord").alias("target_ord"), F.col("variation").alias("key")), "key")
    first = found.groupBy("entity", "field").agg(F.min_by("target", F.struct("suffix", "target_ord", "target")).alias("target")).where("entity != target")
    return first.select(F.col("entity").alias("source"), "target").distinct().withColumn("type", F.lit("FIELD_REFERENCE")).withColumn("score", F.lit(0.8))


def entity_relations_by_path(apis: DataFrame, entities: DataFrame, *, max_broadcast: int = 100_000) -> DataFrame:
    """Another entity's name inside a path. Paths are pre-aggregated, and the names are a bounded broadcast; with more
    names than that, paths are cut into their substrings of the names' lengths, which then join by equality."""
    names = variations(entities).select(F.col("entity").alias("target"), "variation").distinct()
    paths = apis.select(F.col("entity").alias("source"), F.lower("path").alias("path")).distinct()
    if names.limit(max_broadcast + 1).count() <= max_broadcast:
        found = paths.join(F.broadcast(names), F.col("path").contains(F.col("variation")) & (F.col("source") != F.col("target")))
    else:
        sizes = names.agg(F.array_sort(F.collect_set(F.length("variation")))).first()[0]
        cuts = F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("path") - n + 1, F.lit(1))), lambda i: F.substr("path", i, n)))))
        found = paths.select("source", F.explode(cuts).alias("variation")).join(names, "variation").where("source != target")
    return found.select("source", "target").distinct().withColumn("type", F.lit("PATH_HIERARCHY")).withColumn("score", F.lit(0.75))


def _tidy(fields: DataFrame) -> DataFrame:
    return fields.where(~F.col("name").isin(NOISE_FIELDS)).withColumn("canonical", T.canonical_entity(F.col("name"))).where("canonical is not null")


def _scored_fields(requests: DataFrame, responses: DataFrame, allowed: DataFrame, threshold: float, near_fields: DataFrame | None) -> DataFrame:
    """Pairs of distinct tidy request and response fields (entity, name, type, location) that reach the threshold.

    `near_fields` (name_r, name_p, similarity) adds 0.15 of a meaning that two names share, from an embeddings table."""
    if threshold <= 0.595 + (0.15 if near_fields is not None else 0.0):
        raise ValueError("the canonical join is exact only above .595, or .745 with meanings")
    cols = ["entity", "name", "type", "location", "canonical"]
    side = lambda df, s: df.select(*cols).distinct().select(*[F.col(c).alias(c if c in ("canonical", "type") else f"{c}_{s}") for c in cols])
    pairs = allowed.select(F.col("source").alias("entity_r"), F.col("target").alias("entity_p"))
    scored = side(requests, "r").join(pairs, "entity_r").join(side(responses, "p"), ["canonical", "type", "entity_p"])
    weight = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in LOCATION_WEIGHTS.items() for x in kv])[F.col(c)], F.lit(0.5))
    near = T.name_similarity(F.col("name_r"), F.col("name_p"))
    score = 0.4 + F.when(near >= 0.5, 0.3 * near + 0.1 * F.least(weight("location_r"), weight("location_p")) + F.when(F.col("entity_r") == F.col("entity_p"), 0.05).otherwise(0.0)).otherwise(0.0)
    if near_fields is not None:
        scored = scored.join(near_fields.select("name_r", "name_p", "similarity"), ["name_r", "name_p"], "left")
        score = score + 0.15 * F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0))
    return scored.withColumn("score", F.round(score, 9)).where(F.col("score") >= threshold)


def field_match_dependencies(requests: DataFrame, responses: DataFrame, allowed: DataFrame, *, threshold: float = 0.7, near_fields: DataFrame | None = None, share: int = 1_000_000) -> DataFrame:
    """(src, dst, score, matched): an API whose request field is another API's response field.

    Without the 0.4 of a shared canonical entity a pair cannot reach 0.6, so above that threshold the join on canonical
    entity, type and entity pair loses nothing. APIs with the same tidy fields are one class; classes are scored and
    aggregated, and a pair of classes is opened to the pairs of its APIs only at the end, so those are never shuffled or
    grouped. The lists of a class meet as the rows and columns of a grid (`_grids`), so what is sent grows with the APIs and
    not with their pairs, and a task opens about `share` rows until there are ten times the shuffle partitions. The rows grow
    with the square of the APIs of an entity: `field_match_classes` has the same edges in rows linear in the APIs.
    """
    (left, src), (right, dst) = (_signatures(fields) for fields in (requests, responses))
    each = lambda df: df.select("class", F.inline("fields"))
    scored = _scored_fields(each(left), each(right), allowed, threshold, near_fields)
    named = lambda df, s, c: each(df).select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{s}") for x in ("entity", "name", "location")], "type")
    met = scored.join(named(left, "r", "src_class"), ["entity_r", "name_r", "location_r", "type"]).join(named(right, "p", "dst_class"), ["entity_p", "name_p", "location_p", "type"])
    pairs = met.groupBy("src_class", "dst_class").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("name_r")).alias("matched"))
    grids, parts = _grids(left, src, right, dst, allowed, share)
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    own = lambda members: F.pmod(F.xxhash64(F.element_at(members, 1)), "side").cast("int")
    rows = pairs.join(grids, "dst_class").join(src.select(F.col("class").alias("src_class"), F.col("members").alias("srcs")), "src_class")
    rows = rows.select("dst_class", "score", "matched", "srcs", own("srcs").alias("row"), every.alias("column"))
    columns = dst.select(F.col("class").alias("dst_class"), F.col("members").alias("dsts")).join(grids, "dst_class").select("dst_class", "dsts", own("dsts").alias("column"), every.alias("row"))
    key = ["dst_class", "row", "column"]
    both = rows.repartition(parts, *key).join(columns.repartition(parts, *key).hint("merge"), key)
    opened = both.select(F.explode("srcs").alias("src"), "dsts", "score", "matched").select("src", F.explode("dsts").alias("dst"), "score", "matched")
    return opened.where("src != dst")


def _grids(left: DataFrame, src: DataFrame, right: DataFrame, dst: DataFrame, allowed: DataFrame, share: int) -> tuple[DataFrame, int]:
    """(dst_class, side) and the tasks that open pairs of APIs: a class gets about as many cells (side * side) as tasks are
    its part of the work, by the APIs of the entities that may depend on its own. A list is sent to `side` cells."""
    size = lambda lists: lists.groupBy("class").agg(F.sum(F.size("members")).alias("n"))
    of = lambda classes, lists: classes.select("class", F.explode(F.array_distinct(F.transform("fields", lambda f: f["entity"]))).alias("entity")).join(size(lists), "class")
    given = of(left, src).groupBy(F.col("entity").alias("source")).agg(F.sum("n").alias("given"))
    reach = allowed.select("source", "target").distinct().join(given, "source").groupBy(F.col("target").alias("entity")).agg(F.sum("given").alias("given"))
    work = cut(of(right, dst).join(reach, "entity").groupBy(F.col("class").alias("dst_class")).agg(F.sum(F.col("n") * F.col("given").cast("double")).alias("work")))
    total = work.agg(F.sum("work")).first()[0] or 1.0
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, min(math.ceil(total / share), 10 * least))
    return work.select("dst_class", F.ceil(F.sqrt(F.col("work") * (parts / total))).cast("int").alias("side")), parts


def _signatures(fields: DataFrame, *, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """(class, fields) of APIs with the same tidy fields of the same entities, named by the smallest API, and
    (class, members): the APIs of a class in lists of about `size`."""
    given = fields.where("operation_id IS NOT NULL").groupBy("operation_id").agg(F.collect_set(F.struct("entity", "name", "type", "location")).alias("fields"))
    named = F.transform("fields", lambda f: F.struct(f["entity"].alias("entity"), f["name"].alias("name"), f["type"].alias("type"), f["location"].alias("location"), T.canonical_entity(f["name"]).alias("canonical")))
    tidy = F.filter(named, lambda f: ~f["name"].isin(NOISE_FIELDS) & f["canonical"].isNotNull())
    own = cut(given.select("operation_id", F.array_sort(tidy).alias("fields")).where(F.size("fields") > 0))
    classes = cut(own.groupBy("fields").agg(F.min("operation_id").alias("class"), F.ceil(F.count("*") / size).alias("lists")))
    dealt = own.join(classes, "fields").groupBy("class", F.pmod(F.xxhash64("operation_id"), "lists").alias("list"))
    return classes.select("class", "fields"), cut(dealt.agg(F.collect_list("operation_id").alias("members")).select("class", "members"))


def field_classes(fields: DataFrame) -> DataFrame:
    """(operation_id, entity, class, fields): APIs with the same entity and the same tidy fields are one class, named by its
    smallest API."""
    own = _tidy(fields).groupBy("operation_id", "entity").agg(F.array_sort(F.collect_set(F.struct("name", "type", "location", "canonical"))).alias("fields"))
    names = own.groupBy("entity", "fields").agg(F.min("operation_id").alias("class"))
    return own.join(names, ["entity", "fields"]).select("operation_id", "entity", "class", "fields")


def field_match_classes(requests: DataFrame, responses: DataFrame, allowed: DataFrame, *, threshold: float = 0.7, near_fields: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges of `field_match_dependencies` between classes of APIs: (src_class, dst_class, score, matched, edges), and
    the members (operation_id, class) of the request and of the response classes.

    Every API of the first class depends on every other API of the second; `edges` counts them, without those of an API
    to itself. Rows are linear in the APIs and in the pairs of classes that match.
    """
    left, right = cut(field_classes(requests)), cut(field_classes(responses))
    each = lambda df: df.where("operation_id = class").select("class", "entity", F.inline("fields"))
    scored = _scored_fields(each(left), each(right), allowed, threshold, near_fields)
    named = lambda df, s, c: each(df).select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{s}") for x in ("entity", "name", "location")], "type")
    met = scored.join(named(left, "r", "src_class"), ["entity_r", "name_r", "location_r", "type"]).join(named(right, "p", "dst_class"), ["entity_p", "name_p", "location_p", "type"])
    pairs = met.groupBy("src_class", "dst_class").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("name_r")).alias("matched"))
    size = lambda df, c, n: df.groupBy(F.col("class").alias(c)).agg(F.count("*").alias(n))
    both = left.select("operation_id", F.col("class").alias("src_class")).join(right.select("operation_id", F.col("class").alias("dst_class")), "operation_id")
    both = both.groupBy("src_class", "dst_class").agg(F.count("*").alias("own"))
    out = pairs.join(size(left, "src_class", "n_src"), "src_class").join(size(right, "dst_class", "n_dst"), "dst_class").join(both, ["src_class", "dst_class"], "left")
    out = out.withColumn("edges", F.col("n_src") * F.col("n_dst") - F.coalesce("own", F.lit(0))).where("edges > 0")
    return out.select("src_class", "dst_class", "score", "matched", "edges"), left.select("operation_id", "class"), right.select("operation_id", "class")


def write_read_dependencies(apis: DataFrame, relations: DataFrame, known: DataFrame) -> DataFrame:
    """Writes that depend on nothing yet depend on the first read (by ord) of each related entity, with 0.6."""
    write = apis.where(T.is_write(F.col("path"), F.col("method"))).select(F.col("operation_id").alias("src"), F.col("entity").alias("source"))
    lonely = write.join(known.select("src").distinct(), "src", "left_anti")
    read = apis.where(T.is_read(F.col("path"), F.col("method"))).groupBy(F.col("entity").alias("target")).agg(F.min_by("operation_id", "ord").alias("dst"))
    return lonely.join(relations.select("source", "target").distinct(), "source").join(read, "target").where("src != dst").select("src", "dst", F.lit(0.6).alias("score"))


def crud_flow_dependencies(apis: DataFrame) -> DataFrame:
    """Updates and deletes depend on the first `get` of their entity, with 0.85."""
    kind = T.operation_type(F.col("path"), F.col("method"))
    get = apis.where(kind == "get").groupBy("entity").agg(F.min_by("operation_id", "ord").alias("dst"))
    return apis.where(kind.isin("update", "delete")).join(get, "entity").select(F.col("operation_id").alias("src"), "dst", F.lit(0.85).alias("score"))


def explicit_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("node").distinct()
    both = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return both.select("src", "dst", F.lit(1.0).alias("score"), F.lit("CERTAIN").alias("type"))


def belongs_to(apis: DataFrame, entities: DataFrame) -> DataFrame:
    return apis.where("entity != 'unknown'").join(entities.select("entity").distinct(), "entity").select("operation_id", "entity")


def neighbours(edges: DataFrame) -> DataFrame:
    """Each node with the nodes it depends on and those that depend on it, best scores first."""
    named = lambda a, b, n: edges.groupBy(F.col(a).alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(b).alias("x")))), lambda z: z["x"]).alias(n))
    return named("src", "dst", "depends_on").join(named("dst", "src", "depended_by"), "node", "full")


def api_roles(edges: DataFrame, members: DataFrame, *, incoming: str = "any") -> DataFrame:
    """PRODUCER, CONSUMER, BRIDGE or INTERNAL by edges to and from other entities.

    With `incoming='any'` callers of the same entity count too; `cross_entity` leaves them out.
    """
    of = lambda s: members.select(F.col("operation_id").alias(s), F.col("entity").alias(f"{s}_entity"))
    typed = edges.join(of("src"), "src").join(of("dst"), "dst")
    cross = typed.where("src_entity != dst_entity")
    out = cross.groupBy(F.col("src").alias("operation_id")).agg(F.count("*").alias("outgoing"))
    inc = (typed if incoming == "any" else cross).groupBy(F.col("dst").alias("operation_id")).agg(F.count("*").alias("incoming"))
    rows = members.select("operation_id").join(out, "operation_id", "left").join(inc, "operation_id", "left").fillna(0)
    role = F.when((F.col("outgoing") > 0) & (F.col("incoming") > 0), "BRIDGE").when(F.col("incoming") > 0, "PRODUCER").when(F.col("outgoing") > 0, "CONSUMER").otherwise("INTERNAL")
    return rows.withColumn("role", role)


def entry_points(apis: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The k APIs of each entity with the fewest edges from inside it."""
    of = lambda s: apis.select(F.col("operation_id").alias(s), F.col("entity").alias(f"{s}_entity"))
    inside = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_entity = dst_entity").groupBy(F.col("dst").alias("operation_id")).agg(F.count("*").alias("indegree"))
    rows = apis.join(inside, "operation_id", "left").withColumn("indegree", F.coalesce("indegree", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("indegree", "ord"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("entity", "operation_id", "indegree", "rank")


def parameter_flow(steps: DataFrame, responses: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each parameter of a step with the earliest earlier step of its path whose response has that name.

    Names of APIs are made by explodes, whose rows the planner counts too low: they are merged, never broadcast."""
    given = steps.join(responses.hint("merge"), "operation_id").groupBy("path_id", "name").agg(F.min(F.struct("pos", "operation_id")).alias("origin"))
    wanted = steps.join(parameters.hint("merge"), "operation_id").select("path_id", "pos", "operation_id", "name")
    flow = wanted.join(given, ["path_id", "name"]).where(F.col("origin.pos") < F.col("pos"))
    return flow.select("path_id", "pos", "operation_id", "name", F.col("origin.pos").alias("from_pos"), F.col("origin.operation_id").alias("from_operation"))
