"""API catalogues: rows from documents, grouping by entity, capabilities and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.functions import schema as X
from apiloom.functions import text as T
from apiloom.session import Scratch, cut

OPERATION = "struct<operationId:string,summary:string,description:string,tags:array<string>>"


def extract_api_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, path, method, operation_id, summary, tags, json) of every operation of OpenAPI 2 or 3 documents.

    `paths` is read as a map of maps, so operations of any shape pass; a document that is not JSON gives no rows. A document
    is read before its paths become rows: what stands beside the explode is worked out again for each of them.
    """
    base = F.coalesce(F.get_json_object("json", "$.basePath"), F.get_json_object("json", "$.servers[0].url"), F.lit(""))
    paths = F.from_json(F.get_json_object("json", "$.paths"), "map<string,map<string,string>>")
    read = docs.select("doc_id", F.regexp_replace(base, "/$", "").alias("base"), paths.alias("paths"))
    each = read.select("doc_id", "base", F.explode("paths").alias("path", "methods"))
    ops = each.select("doc_id", F.concat("base", "path").alias("path"), F.explode("methods").alias("verb", "json"))
    ops = ops.where(F.upper("verb").isin(T.HTTP_VERBS)).withColumn("op", F.from_json("json", OPERATION))
    return ops.select(
        "doc_id",
        "path",
        F.upper("verb").alias("method"),
        F.coalesce("op.operationId", F.concat_ws("_", F.lower("verb"), "path")).alias("operation_id"),
        F.col("op.summary").alias("summary"),
        F.coalesce("op.tags", F.array().cast("array<string>")).alias("tags"),
        "json",
    )


PARAMETER = "array<struct<name:string,`in`:string,type:string,required:boolean,schema:string>>"


def classify_parameters(rows: DataFrame) -> DataFrame:
    """Adds `parameters`: a map from location to (name, type, required, content_type, schema); the type falls back to the
    schema's, then string. Each content of an OpenAPI 3 request body is one more body row, with its type and schema."""
    raw = F.coalesce(F.from_json(F.get_json_object("json", "$.parameters"), PARAMETER), F.array().cast(PARAMETER))
    none = F.lit(None).cast("string")
    shape = lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["type"], F.get_json_object(p["schema"], "$.type"), F.lit("string")).alias("type"), F.coalesce(p["required"], F.lit(False)).alias("required"), none.alias("content_type"), p["schema"].alias("schema"))
    at = lambda place: F.transform(F.filter(raw, lambda p: F.coalesce(p["in"], F.lit("query")) == place), shape)
    must = F.coalesce(F.get_json_object("json", "$.requestBody.required") == "true", F.lit(False))
    content = F.coalesce(F.from_json(F.get_json_object("json", "$.requestBody.content"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    bodies = F.transform(F.map_entries(content), lambda e: F.struct(none.alias("name"), none.alias("type"), must.alias("required"), e["key"].alias("content_type"), F.get_json_object(e["value"], "$.schema").alias("schema")))
    places = ["path", "query", "body", "header"]
    lists = [F.concat(at("body"), bodies) if place == "body" else at(place) for place in places]
    return rows.withColumn("parameters", F.map_from_arrays(F.array(*map(F.lit, places)), F.array(*lists)))


def with_schemas(rows: DataFrame) -> DataFrame:
    """Adds `request_schema` (of the first content of the request body, else of the first body parameter) and
    `response_schemas` (status code to schema: the response's own, else that of the first content that has one)."""
    content = F.from_json(F.get_json_object("json", "$.requestBody.content"), "map<string,string>")
    body = F.try_element_at(F.filter(F.from_json(F.get_json_object("json", "$.parameters"), PARAMETER), lambda p: p["in"] == "body"), F.lit(1))
    request = F.when(F.size(content) > 0, F.get_json_object(F.element_at(F.map_values(content), 1), "$.schema")).otherwise(body["schema"])
    real = lambda x: (x.isNotNull()) & (x != "{}")
    responses = F.coalesce(F.from_json(F.get_json_object("json", "$.responses"), "map<string,string>"), F.create_map().cast("map<string,string>"))

    def one(r):
        inside = F.map_values(F.coalesce(F.from_json(F.get_json_object(r, "$.content"), "map<string,string>"), F.create_map().cast("map<string,string>")))
        first = F.try_element_at(F.filter(F.transform(inside, lambda c: F.get_json_object(c, "$.schema")), real), F.lit(1))
        own = F.get_json_object(r, "$.schema")
        return F.when(real(own), own).otherwise(first)

    found = F.map_filter(F.transform_values(responses, lambda _, r: one(r)), lambda _, v: v.isNotNull())
    return rows.withColumn("request_schema", request).withColumn("response_schemas", found)


FIELD = "array<struct<name:string,path:string,type:string,required:boolean>>"


def api_fields(apis: DataFrame, side: str, *, key: str = "operation_id") -> DataFrame:
    """(key, ord, name, path, type, required): the request or response fields of each API.

    A column `request_fields` or `response_fields` (name, type, required) is taken as it is. Else the request's are those
    of `request_schema`, then the body, query and path parameters (a path parameter is required unless it says otherwise),
    and the response's those of `response_schema`, then of the first of the codes 200, 201 and 204 that `response_schemas`
    has, else of its first schema. Columns that are missing count as null.
    """
    has = lambda c: F.col(c) if c in apis.columns else F.lit(None)
    direct = f"{side}_fields"
    if side == "request":
        schema = has("request_schema").cast("string")
    else:
        map_ = has("response_schemas").cast("map<string,string>")
        code = F.try_element_at(F.filter(F.array(*map(F.lit, ("200", "201", "204"))), lambda c: F.map_contains_key(map_, c)), F.lit(1))
        chosen = F.when(code.isNotNull(), F.try_element_at(map_, code)).otherwise(F.try_element_at(F.map_values(map_), F.lit(1)))
        own = F.flatten(F.array(F.array(has("response_schema").cast("string"))))
        schema = F.coalesce(F.try_element_at(own, F.lit(1)), chosen)
    given = F.transform(F.col(direct), lambda f: F.struct(f["name"].alias("name"), f["name"].alias("path"), f["type"].alias("type"), f["required"].alias("required"))) if direct in apis.columns else F.lit(None).cast(FIELD)
    rows = apis.select(key, given.alias("given"), schema.alias("schema"), (has("parameters") if side == "request" else F.lit(None)).alias("parameters"))
    out = [rows.where("given IS NOT NULL").select(key, F.posexplode("given").alias("ord", "f")).select(key, "ord", "f.*")]
    rest = rows.where("given IS NULL")
    flat = X.flatten_schema(rest.where("schema IS NOT NULL"), key=key, schema_col="schema")
    out.append(flat.select(key, "ord", "name", "path", "type", F.lit(False).alias("required")))
    if side == "request" and "parameters" in apis.columns:
        kind = "array<struct<name:string,type:string,required:boolean>>"

        def at(place: str):
            shape = lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), F.coalesce(p["required"], F.lit(place == "path")).alias("required"))
            return F.coalesce(F.transform(F.filter(F.try_element_at("parameters", F.lit(place)), lambda p: p["name"].isNotNull()), shape), F.array().cast(kind))

        named = F.concat(at("body"), at("query"), at("path"))
        more = rest.select(key, F.posexplode(named).alias("ord", "p"))
        out.append(more.select(key, (F.col("ord") + 100_000).alias("ord"), F.col("p.name").alias("name"), F.col("p.name").alias("path"), F.col("p.type").alias("type"), F.col("p.required").alias("required")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1
    return every.withColumn("ord", place).select(key, "ord", "name", "path", "type", "required")


def schema_fingerprints(apis: DataFrame, *, key: str = "operation_id") -> DataFrame:
    """(key, request, response): the lower-cased field names of the request schema with the names of the parameters, and
    of the responses 200, 201 and 202; arrays and allOf, anyOf and oneOf are followed three levels deep."""
    codes = F.array_compact(F.transform(F.array(*map(F.lit, ("200", "201", "202"))), lambda c: F.try_element_at("response_schemas", c)))
    request = X.field_names(F.array("request_schema"))
    if "parameters" in apis.columns:
        names = F.transform(F.flatten(F.map_values("parameters")), lambda p: F.lower(p["name"]))
        request = F.array_distinct(F.concat(request, F.coalesce(F.array_compact(names), F.array().cast("array<string>"))))
    return apis.select(key, F.array_sort(request).alias("request"), F.array_sort(X.field_names(codes)).alias("response"))


def entity_rollup(apis: DataFrame) -> DataFrame:
    kinds = F.array_sort(F.collect_set(T.operation_type(F.col("path"), F.col("method"))))
    return apis.groupBy("entity").agg(F.count("*").alias("api_count"), kinds.alias("operations"))


def capability_rollup(apis: DataFrame) -> DataFrame:
    """Per cluster: modal tag and verb (first seen of equals), CRUD flags, completeness and size."""
    tag = apis.select("cluster", "ord", F.explode("tags").alias("x")).groupBy("cluster", "x").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    mode = lambda df, name: df.groupBy("cluster").agg(F.max_by("x", F.struct("n", -F.col("first"))).alias(name))
    verb = apis.select("cluster", "ord", T.operation_type(F.col("path"), F.col("method")).alias("x")).groupBy("cluster", "x").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    flag = lambda c: F.bool_or(T.crud(F.col("method")) == c)
    base = apis.groupBy("cluster").agg(
        F.count("*").alias("api_count"), flag("create").alias("has_create"), flag("read").alias("has_read"), flag("update").alias("has_update"), flag("delete").alias("has_delete")
    )
    share = sum(F.col(c).cast("int") for c in ("has_create", "has_read", "has_update", "has_delete")) / 4
    return base.withColumn("completeness", share).join(mode(tag, "main_tag"), "cluster", "left").join(mode(verb, "main_verb"), "cluster", "left")


def _close_points(points: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, sim): the pairs of points of one anchor with a cosine of `least` or more.

    Points of an anchor are dealt into blocks of about `block`, and pairs of blocks meet in an equality join, so a hot
    anchor is many tasks. Sizes alone bound the cosine from above; only pairs within the bound have their fields compared."""
    counts = points.groupBy("entity").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = points.join(counts, "entity").withColumn("own", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))
    size = F.size("fields")
    dealt = dealt.select("entity", "first", "fields", "method", size.alias("k"), F.sqrt(0.26 + F.when(size > 0, 0.16 / size).otherwise(0.0)).alias("norm"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = dealt.where("own <= other").select("entity", F.col("own").alias("i"), F.col("other").alias("j"), F.struct("first", "fields", "method", "k", "norm").alias("x"))
    right = dealt.where("other <= own").select("entity", F.col("other").alias("i"), F.col("own").alias("j"), F.struct("first", "fields", "method", "k", "norm").alias("y"))
    norms = F.col("x.norm") * F.col("y.norm")
    same = F.when(F.col("x.method") == F.col("y.method"), 0.01).otherwise(0.0)
    bound = (0.25 + same + 0.16 / F.greatest(F.lit(1), "x.k", "y.k")) / norms
    once = (F.col("i") < F.col("j")) | (F.col("x.first") < F.col("y.first"))
    met = left.join(right, ["entity", "i", "j"]).where(once & (bound >= least - 1e-9))
    shared = F.when((F.col("x.k") > 0) & (F.col("y.k") > 0), 0.16 * F.size(F.array_intersect("x.fields", "y.fields")) / (F.col("x.k") * F.col("y.k"))).otherwise(0.0)
    sim = F.round((0.25 + same + shared) / norms, 12)
    return met.select(F.least("x.first", "y.first").alias("a"), F.greatest("x.first", "y.first").alias("b"), sim.alias("sim")).where(F.col("sim") >= least)


def _mutual(pairs: DataFrame) -> DataFrame:
    """(a, b): the pairs that are each other's closest. Equal cosines go by the names of the pair, so the order is total."""
    ends = pairs.select(F.col("a").alias("me"), F.struct((-F.col("sim")).alias("far"), "a", "b").alias("pair")).unionByName(pairs.select(F.col("b").alias("me"), F.struct((-F.col("sim")).alias("far"), "a", "b").alias("pair")))
    best = ends.groupBy("me").agg(F.min("pair").alias("pair")).select("me", "pair.a", "pair.b")
    return best.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")


def entity_clusters(apis: DataFrame, *, similarity: float = 0.85, block: int = 500) -> DataFrame:
    """(operation_id, cluster, cluster_type): average linkage over features anchor, fields and method.

    Rows of different anchors never reach the cut-off when it is above .405; equal feature vectors are one weighted point.
    The average cosine of two clusters is the product of their mean unit vectors, and a merged cluster is no closer to
    others than the closer of its parts. So all pairs that are each other's closest merge at once, round by round, and
    only pairs that reached the cut-off before can reach it after a merge: pairs of points are compared once, and later rounds
    are joins over the pairs that remain. No anchor meets in one task.
    """
    if similarity <= 0.405:
        raise ValueError("below .405 clusters could span anchors")
    with Scratch(apis.sparkSession) as keep:
        fields, method = F.array_sort(F.array_distinct("fields")), F.upper("method")
        points = keep(apis.groupBy("entity", fields.alias("fields"), method.alias("method")).agg(F.count("*").cast("double").alias("n"), F.min("operation_id").alias("first")))
        size = F.size("fields")
        norm = F.sqrt(0.26 + F.when(size > 0, 0.16 / size).otherwise(0.0))
        parts = F.concat(F.array(F.struct(F.lit("anchor").alias("key"), (0.5 / norm).alias("value")), F.struct(F.concat(F.lit("method "), F.coalesce("method", F.lit(""))).alias("key"), (0.1 / norm).alias("value"))), F.transform("fields", lambda f: F.struct(F.concat(F.lit("field "), f).alias("key"), (0.4 / size / norm).alias("value"))))
        groups = points.select(F.col("first").alias("cid"), "n", F.map_from_entries(parts).alias("mean"))
        pairs = keep(_close_points(points, similarity, block))
        owner = points.select("first", F.col("first").alias("cid"))
        while True:
            merges = keep(_mutual(pairs))
            if merges.isEmpty():
                break
            into = merges.select(F.col("b").alias("cid"), F.col("a").alias("into"))
            moved = lambda rows, c: rows.join(into.select(F.col("cid").alias(c), F.col("into").alias(f"{c}_into")), c, "left")  # noqa: B023, E731
            owner = keep(owner.join(into, "cid", "left").select("first", F.coalesce("into", "cid").alias("cid")))
            side = lambda c: merges.join(groups.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("mean").alias(f"m{c}")), c).select("a", "b", f"n{c}", f"m{c}")  # noqa: B023, E731
            both = side("a").join(side("b"), ["a", "b"])
            mean = F.map_zip_with("ma", "mb", lambda k, x, y: (F.coalesce(x, F.lit(0.0)) * F.col("na") + F.coalesce(y, F.lit(0.0)) * F.col("nb")) / (F.col("na") + F.col("nb")))
            new = both.select(F.col("a").alias("cid"), (F.col("na") + F.col("nb")).alias("n"), mean.alias("mean"))
            gone = merges.select(F.explode(F.array("a", "b")).alias("cid"))
            groups = keep(groups.join(gone, "cid", "left_anti").unionByName(new))
            touched = gone.withColumn("hit", F.lit(True))
            marked = pairs.join(touched.select(F.col("cid").alias("a"), F.col("hit").alias("hit_a")), "a", "left").join(touched.select(F.col("cid").alias("b"), F.col("hit").alias("hit_b")), "b", "left")
            marked = keep(marked.withColumn("hit", F.coalesce("hit_a", "hit_b", F.lit(False))).select("a", "b", "sim", "hit"))
            again = moved(moved(marked.where("hit").select("a", "b"), "a"), "b").select(F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y")).where("x != y")
            again = again.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            vector = lambda c: groups.select(F.col("cid").alias(c), F.col("mean").alias(f"m{c}"))  # noqa: B023, E731
            dot = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("mb", e["key"]), F.lit(0.0)))
            fresh = again.join(vector("a"), "a").join(vector("b"), "b").select("a", "b", F.round(dot, 12).alias("sim")).where(F.col("sim") >= similarity)
            pairs = keep(marked.where("NOT hit").select("a", "b", "sim").unionByName(fresh))
        sizes = points.join(owner, "first").groupBy("cid").agg(F.sum("n").alias("rows"))
        named = points.join(owner, "first").join(sizes, "cid").select("entity", F.col("fields").alias("f"), F.col("method").alias("m"), F.col("cid").alias("cluster"), F.when(F.col("rows") > 1, "entity").otherwise("atomic").alias("cluster_type"))
        named = cut(named)
    key = F.struct(fields.alias("f"), method.alias("m"))
    rows = apis.withColumn("__key", key)
    hit = rows["entity"].eqNullSafe(named["entity"]) & rows["__key.f"].eqNullSafe(named["f"]) & rows["__key.m"].eqNullSafe(named["m"])
    return rows.join(named, hit).select("operation_id", rows["entity"], rows["method"], "cluster", "cluster_type")


def refine_crud(clustered: DataFrame) -> DataFrame:
    """Clusters of one entity with two or more CRUD kinds are complete; clusters of several entities are split by entity."""
    w = Window.partitionBy("cluster")
    rows = clustered.withColumn("kinds", F.size(F.collect_set(T.crud(F.col("method"))).over(w))).withColumn("entities", F.size(F.collect_set("entity").over(w)))
    rows = rows.withColumn("new_cluster", F.when(F.col("entities") > 1, F.concat_ws("|", "cluster", "entity")).otherwise(F.col("cluster")))
    size = F.count("*").over(Window.partitionBy("new_cluster"))
    kind = F.when((F.col("entities") == 1) & (F.col("kinds") >= 2), "crud_complete").when((F.col("entities") > 1) & (size > 1), "entity_grouped").when(size == 1, "atomic").otherwise(F.col("cluster_type"))
    return rows.select("operation_id", F.col("new_cluster").alias("cluster"), kind.alias("cluster_type"))


def tag_groups(apis: DataFrame, *, dense: int = 8) -> DataFrame:
    """Group by the first tag, else the first segment; small groups are kept, larger ones go to density clustering."""
    tag = F.coalesce(F.try_element_at("tags", F.lit(1)), F.try_element_at(T.path_segments(F.col("path")), F.lit(1)), F.lit("untagged"))
    size = F.count("*").over(Window.partitionBy("tag"))
    return apis.withColumn("tag", tag).withColumn("route", F.when(size == 1, "atomic").when(size < dense, "tag_grouped").otherwise("density"))


def regroup_scattered(clustered: DataFrame, *, least: int = 3) -> DataFrame:
    """Rows of clusters with fewer than `least` members join a pattern group of two or more, else become atomic."""
    p, e = F.lower("path"), F.lower("entity")
    kind = T.first_of(
        [
            (e.contains("statistics") | p.contains("summary") | p.contains("dashboard"), F.lit("statistics_reporting")),
            (p.contains("simple-list") | (e == "simple-list"), F.lit("simple_list_utilities")),
            (p.contains("upload") | p.contains("download") | p.contains("export"), F.lit("file_operations")),
            (p.contains("update-status") | p.contains("update-default-status"), F.lit("status_management")),
        ]
    )
    sizes = clustered.groupBy("cluster").agg((F.count("*") < least).alias("scattered"))
    rows = clustered.join(sizes, "cluster").withColumn("kind", F.when(F.col("scattered"), kind))
    full = rows.where("kind IS NOT NULL").groupBy("kind").agg((F.count("*") >= 2).alias("grouped"))  # one row for each of the four kinds
    rows = rows.join(F.broadcast(full), "kind", "left")
    grouped = F.coalesce("grouped", F.lit(False))
    out = F.when(grouped, F.col("kind")).when(F.col("scattered"), F.concat(F.lit("atomic_"), F.col("operation_id"))).otherwise(F.col("cluster"))
    return rows.select("operation_id", out.alias("cluster"), F.when(grouped, "regrouped").when(F.col("scattered"), "atomic").otherwise("kept").alias("action"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, removed or modified operations of two catalogues, by the hash of their fields."""
    digest = lambda df, name: df.select("operation_id", T.api_hash(F.col("path"), F.col("method"), F.col("summary")).alias(name))
    both = digest(old, "h1").join(digest(new, "h2"), "operation_id", "full")
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "modified")
    return both.select("operation_id", change.alias("change")).where("change IS NOT NULL")


def schema_classes(apis: DataFrame) -> DataFrame:
    """(operation_id, class): operations with equal request and response field sets, named by their smallest operation."""
    key = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("request_fields", "response_fields")]
    rows = apis.select("operation_id", *key)
    names = rows.groupBy("request_fields", "response_fields").agg(F.min("operation_id").alias("class"))
    return rows.join(names, ["request_fields", "response_fields"]).select("operation_id", "class")


def schema_similarity(apis: DataFrame, *, least: float = 0.5) -> DataFrame:
    """(a, b, n_a, n_b, similarity): pairs of classes (see `schema_classes`; within one the similarity is 1) with .7
    Jaccard(responses) + .3 Jaccard(requests) of at least the cut-off, and how many operations each class has.

    Candidates share a response or request field; intersections are counted in the join, so no pair is compared twice,
    and copies of a schema make no pairs.
    """
    key = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("request_fields", "response_fields")]
    classes = apis.select("operation_id", *key).groupBy("request_fields", "response_fields").agg(F.min("operation_id").alias("id"), F.count("*").alias("many"))
    sides = []
    for side in ("response_fields", "request_fields"):
        each = classes.select("id", "many", F.size(side).alias("n"), F.explode(side).alias("f"))
        a = each.select(F.col("id").alias("a"), F.col("many").alias("n_a"), F.col("n").alias("na"), "f")
        b = each.select(F.col("id").alias("b"), F.col("many").alias("n_b"), F.col("n").alias("nb"), "f")
        shared = a.join(b, "f").where("a < b").groupBy("a", "b", "n_a", "n_b", "na", "nb").agg(F.count("*").alias("s"))
        sides.append(shared.select("a", "b", "n_a", "n_b", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias(side)))
    both = sides[0].join(sides[1], ["a", "b", "n_a", "n_b"], "full").fillna(0.0)
    return both.select("a", "b", "n_a", "n_b", F.round(0.7 * F.col("response_fields") + 0.3 * F.col("request_fields"), 9).alias("similarity")).where(F.col("similarity") >= least)


def similar_paths(apis: DataFrame, *, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """(a, b, n_a, n_b, similarity): pairs of different segment sets with a Jaccard similarity of at least 4/5, and how
    many operations have each; a set is written as its sorted segments.

    Operations of one set are one row. Sets of this similarity share a segment among their first n - ceil(4n/5) + 1 in
    the order of frequency, rarest first, so only those meet.
    """
    sets = apis.select(F.array_sort(F.array_distinct(T.path_segments(F.col("path")))).alias("s")).where(F.size("s") > 0).groupBy("s").agg(F.count("*").alias("many"))
    sets = sets.withColumn("id", F.array_join("s", "/"))
    each = sets.select("id", F.explode("s").alias("segment"))
    order = F.array_sort(F.collect_list(F.struct("df", "segment")))
    ranked = each.join(each.groupBy("segment").agg(F.count("*").alias("df")), "segment").groupBy("id").agg(order.alias("order"))
    rows = sets.join(ranked, "id").withColumn("n", F.size("s"))
    prefix = F.expr(f"n - (({numerator} * n + {denominator - 1}) div {denominator}) + 1").cast("int")
    probes = rows.select("id", "n", "many", "s", F.explode(F.slice(F.transform("order", lambda x: x["segment"]), 1, prefix)).alias("segment"))
    a = probes.select("segment", *(F.col(c).alias(f"a_{c}") for c in ("id", "n", "many", "s")))
    b = probes.select("segment", *(F.col(c).alias(f"b_{c}") for c in ("id", "n", "many", "s")))
    near = f"a_id < b_id and {denominator} * least(a_n, b_n) >= {numerator} * greatest(a_n, b_n)"
    met = a.join(b, "segment").where(near).dropDuplicates(["a_id", "b_id"]).withColumn("shared", F.size(F.array_intersect("a_s", "b_s")))
    whole = F.col("a_n") + F.col("b_n") - F.col("shared")
    found = met.where(denominator * F.col("shared") >= numerator * whole)
    return found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_many").alias("n_a"), F.col("b_many").alias("n_b"), F.round(F.col("shared") / whole, 9).alias("similarity"))


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Number and sizes of clusters, share of atomic rows, and the distribution part of the quality score."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"))
    stat = sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("apis"), F.avg("n").alias("avg"), F.stddev_pop("n").alias("std"), F.count_if(F.col("n") == 1).alias("atomic"))
    fit = F.when(F.col("avg").between(3, 8), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("avg") - 5.5) / 10))
    score = fit * (1 - F.least(F.lit(1.0), F.col("std") / F.col("avg")) * 0.5)
    return stat.select("clusters", "apis", F.round("avg", 6).alias("avg_size"), F.round("std", 6).alias("std_size"), F.round(F.col("atomic") / F.col("apis"), 6).alias("atomic_share"), F.round(score, 6).alias("distribution_score"))


def constraints(apis: DataFrame) -> DataFrame:
    """0 to 2 constraint rows of each API: audit for sensitive ones, approval for deletes; ids are digests."""
    sensitive = T.is_sensitive(F.col("operation_id"), F.col("path"), F.col("method"))
    rows = F.array_compact(F.array(F.when(sensitive, F.lit("audit")), F.when(F.upper("method") == "DELETE", F.lit("approval"))))
    return apis.select("operation_id", F.explode(rows).alias("constraint")).withColumn("contract_id", F.substring(F.md5(F.concat_ws(":", "operation_id", "constraint")), 1, 8))


#: Words of financial operations.
MONEY_WORDS = ["payment", "transfer", "refund"]


def rule_constraints(apis: DataFrame) -> DataFrame:
    """0 to 3 constraint rows of each API (operation_id, name, method, role_level): approval of deletes by specialists, a
    limit of amounts for financial names, and data isolation of the four CRUD methods."""
    name, method = F.lower(F.coalesce("name", F.lit(""))), F.upper(F.coalesce("method", F.lit("GET")))
    money = F.lit(False)
    for word in MONEY_WORDS:
        money = money | name.contains(word)
    rows = F.array_compact(
        F.array(
            F.when(((method == "DELETE") | name.contains("delete")) & (F.col("role_level") == "specialist"), F.lit("approval_required")),
            F.when(money, F.lit("amount_limit")),
            F.when(method.isin("GET", "POST", "PUT", "DELETE"), F.lit("data_isolation")),
        )
    )
    return apis.select("operation_id", F.explode(rows).alias("constraint"))
