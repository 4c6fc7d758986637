"""Capabilities: merged schemas, connectivity, density clusters and the quality of a clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.functions import text as T
from apiloom.operators.blocks import numbered
from apiloom.operators.graph import spread_least
from apiloom.session import cut


def merged_schema(fields: DataFrame) -> DataFrame:
    """One row for each property of a capability from field rows (capability, operation_id, method, side, name, type).

    read_only: only in responses; write_only: only in requests; required: in the request of every POST of the
    capability; conflict: more than one type. The rule does not depend on the order of the rows.
    """
    posts = fields.where("upper(method) = 'POST'").groupBy("capability").agg(F.countDistinct("operation_id").alias("posts"))
    request = F.col("side") == "request"
    got = fields.groupBy("capability", "name").agg(
        F.bool_and(~request).alias("read_only"),
        F.bool_and(request).alias("write_only"),
        F.countDistinct(F.when(request & (F.upper("method") == "POST"), F.col("operation_id"))).alias("in_posts"),
        F.array_sort(F.collect_set("operation_id")).alias("sources"),
        F.array_sort(F.collect_set("type")).alias("types"),
    )
    out = got.join(posts, "capability", "left")
    required = F.coalesce(F.col("in_posts") == F.col("posts"), F.lit(False))
    return out.select("capability", "name", "read_only", "write_only", required.alias("required"), "sources", F.element_at("types", 1).alias("type"), (F.size("types") > 1).alias("conflict"))


def connectivity_score(apis: DataFrame, merged: DataFrame) -> DataFrame:
    """Mean of CRUD weights, schema coverage, chaining of outputs into inputs, and path consistency; two places.

    The four parts are whole hundredths, and the quarter of their sum is rounded half up, so no binary fraction decides.
    The common prefix of all paths is that of the smallest and the largest."""
    has = lambda c: F.coalesce(F.bool_or(T.crud(F.col("method")) == c), F.lit(False)).cast("int")
    low, high = F.substring(F.min("path"), 1, 2), F.substring(F.max("path"), 1, 2)
    segments = F.flatten(F.collect_list(T.path_segments(F.col("path"))))
    base = apis.groupBy("capability").agg(
        (30 * has("create") + 20 * has("read") + 30 * has("update") + 20 * has("delete")).alias("crud"),
        F.when((low == high) & (F.char_length(low) == 2), 100).when(F.size(F.array_distinct(segments)) < F.size(segments), 70).otherwise(30).alias("paths"),
    )
    cover = merged.groupBy("capability").agg(F.bool_or("read_only").alias("r"), F.bool_or("write_only").alias("w"), F.bool_or(~F.col("read_only") & ~F.col("write_only")).alias("chained"))
    coverage = F.when(F.col("r") & F.col("w"), 100).when(F.col("r") | F.col("w"), 50).otherwise(0)
    rows = base.join(cover, "capability", "left")
    total = F.coalesce("crud", F.lit(0)) + F.coalesce(coverage, F.lit(0)) + F.when(F.col("chained"), 100).otherwise(0) + F.col("paths")
    return rows.select("capability", (F.floor((total + 2) / 4) / 100).alias("connectivity"))


def unify_anchors(apis: DataFrame) -> DataFrame:
    """Per cluster the modal known anchor, else the modal segment, else `cluster-id`; ties by name."""
    mode = lambda df, name: df.groupBy("cluster", "x").count().groupBy("cluster").agg(F.min_by("x", F.struct(-F.col("count"), "x")).alias(name))
    anchor = mode(apis.where("entity != 'unknown'").select("cluster", F.col("entity").alias("x")), "anchor")
    segment = mode(apis.select("cluster", F.explode(T.path_segments(F.col("path"))).alias("x")), "segment")
    all_ = apis.select("cluster").distinct().join(anchor, "cluster", "left").join(segment, "cluster", "left")
    return all_.select("cluster", F.coalesce("anchor", "segment", F.concat(F.lit("cluster-"), F.col("cluster").cast("string"))).alias("anchor"))


def tfidf(texts: DataFrame, *, terms: int = 200) -> DataFrame:
    """(tag, h, places, weights): unit TF-IDF vectors of the texts (tag, h, text) over the most frequent words and word
    pairs of their tag (ties by term); sparse, by aggregates only."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w\w+)"), F.lit(1))
    rows = texts.withColumn("w", w)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
    each = rows.select("tag", "h", F.explode(F.concat("w", pairs)).alias("term")).groupBy("tag", "h", "term").agg(F.count("*").alias("tf"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("total"), "term"))
    known = each.groupBy("tag", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).withColumn("rank", rank).where(F.col("rank") <= terms)
    count = texts.groupBy("tag").agg(F.count("*").alias("n"))
    weight = F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    kept = each.join(known, ["tag", "term"]).join(count, "tag").select("tag", "h", (F.col("rank") - 1).alias("place"), weight.alias("weight"))
    vectors = kept.groupBy("tag", "h").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("v"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = F.transform("v", lambda x: x["weight"] / F.col("norm"))
    out = texts.select("tag", "h").join(vectors.select("tag", "h", F.transform("v", lambda x: x["place"]).alias("places"), unit.alias("weights")), ["tag", "h"], "left")
    return out.select("tag", "h", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))


def _tag_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(tag, i, j, x, y): each block of about `size` rows of a tag with itself and each later block of the tag."""
    count = rows.groupBy("tag").agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = rows.join(count, "tag").withColumn("block", F.pmod(F.xxhash64("h"), "blocks"))
    grouped = cut(dealt.groupBy("tag", "blocks", "block").agg(F.collect_list(F.struct("h", "places", "weights", "core")).alias("rows")))
    x = grouped.select("tag", F.col("block").alias("i"), F.col("rows").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    y = grouped.select("tag", F.col("block").alias("j"), F.col("rows").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i"))
    return x.join(y, ["tag", "i", "j"])


def _distances(a: pa.ListScalar, b: pa.ListScalar) -> np.ndarray:
    """Cosine distances of two blocks, to six places."""
    dense = []
    for cell in (a, b):
        places, weights = cell.values.field("places"), cell.values.field("weights")
        at = places.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
        m = np.zeros((len(places), 1 + max(int(at.max(initial=0)), 0)))
        m[row, at] = weights.flatten().to_numpy(zero_copy_only=False)
        dense.append(m)
    width = max(m.shape[1] for m in dense)
    x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in dense)
    return np.round(1 - x @ y.T, 6)


def density_clusters(texts: DataFrame, *, least: int = 2, block: int = 2048) -> DataFrame:
    """(operation_id, tag, cluster): DBSCAN over TF-IDF within each tag, eps the median distance within .3 to .7.

    Equal texts of a tag are one point. Each block of a tag's points meets each other block of the tag, at every size:
    once for the distances' counts (their median is exact to six places), once for the neighbours of each point, and
    once for links of dense points, of which a pair of blocks gives a spanning forest only. The work is quadratic in the
    distinct texts of a tag, the rows are linear. A point near several clusters joins the one that sorts first; a point
    near none is `noise/` and its operation.
    """
    rows = texts.select("operation_id", F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.md5("text"))
    points = cut(rows.groupBy("tag", "h").agg(F.min("operation_id").alias("first"), F.first("text").alias("text")))
    vectors = cut(tfidf(points.select("tag", "h", "text")))
    pairs = _tag_blocks(vectors.withColumn("core", F.lit(False)), block)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, i, j, x, y in zip(*(batch.column(c) for c in ("tag", "i", "j", "x", "y")), strict=True):
                d = _distances(x, y)
                values, n = np.unique(d[np.triu_indices(len(d), 1)] if i == j else d, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([tag.as_py()] * len(n), pa.string()), pa.array(values, pa.float64()), pa.array(n, pa.int64())], names=["tag", "d", "n"])

    spread = pairs.mapInArrow(counts, "tag string, d double, n long").groupBy("tag", "d").agg(F.sum("n").alias("n"))
    median = spread.groupBy("tag").agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("eps"))
    eps = cut(points.select("tag").distinct().join(median, "tag", "left").select("tag", F.round(F.least(F.lit(0.7), F.greatest(F.lit(0.3), F.coalesce("eps", F.lit(0.3)))), 6).alias("eps")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, i, j, x, y, e in zip(*(batch.column(c) for c in ("tag", "i", "j", "x", "y", "eps")), strict=True):
                close = _distances(x, y) <= e.as_py()
                h = x.values.field("h").to_pylist() + (y.values.field("h").to_pylist() if i != j else [])
                n = np.concatenate([close.sum(1), close.sum(0)]) if i != j else close.sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([tag.as_py()] * len(h), pa.string()), pa.array(h, pa.string()), pa.array(n, pa.int64())], names=["tag", "h", "n"])

    dense = pairs.join(eps, "tag").mapInArrow(near, "tag string, h string, n long").groupBy("tag", "h").agg((F.sum("n") >= least).alias("core"))
    flagged = _tag_blocks(vectors.join(dense, ["tag", "h"]), block)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, x, y, e in zip(*(batch.column(c) for c in ("tag", "x", "y", "eps")), strict=True):
                close = _distances(x, y) <= e.as_py()
                h, g = x.values.field("h").to_pylist(), y.values.field("h").to_pylist()
                a, b = (np.array(c.values.field("core").to_pylist(), bool) for c in (x, y))
                found = set()
                top: dict[str, str] = {}

                def find(v: str, top=top) -> str:
                    while top.setdefault(v, v) != v:
                        top[v] = top[top[v]]
                        v = top[v]
                    return v

                for r, c in zip(*np.nonzero(close & (a[:, None] | b[None])), strict=True):
                    if a[r] and b[c]:
                        u, v = find(h[r]), find(g[c])
                        if u != v:
                            top[max(u, v)] = min(u, v)
                            found.add((h[r], g[c], True))
                    else:
                        found.add((h[r], g[c], False) if a[r] else (g[c], h[r], False))
                core, other, both = zip(*sorted(found), strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([tag.as_py()] * len(core), pa.string()), pa.array(core, pa.string()), pa.array(other, pa.string()), pa.array(both, pa.bool_())], names=["tag", "src", "dst", "dense"])

    # of the dense neighbours of a point that is not dense, each pair of blocks gives all; they are few, as it has fewer than `least`
    got = cut(flagged.join(eps, "tag").mapInArrow(links, "tag string, src string, dst string, dense boolean"))
    name = lambda h: F.struct("tag", F.col(h).alias("h"))
    strong = got.where("dense").select(name("src").alias("src"), name("dst").alias("dst"))
    both = cut(strong.unionByName(strong.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    first = points.select(name("h").alias("node"), "tag", "h", "first")
    label = cut(dense.where("core").join(first, ["tag", "h"]).select("node", F.col("first").alias("value")))
    core = cut(spread_least(label, both).select("node", "value"))
    edge = got.where("NOT dense").select(name("src").alias("node"), name("dst").alias("other")).join(core, "node").groupBy(F.col("other").alias("node")).agg(F.min("value").alias("value"))
    owner = core.unionByName(edge)
    named = first.join(owner, "node", "left").select("tag", "h", F.when(F.col("value").isNotNull(), F.concat_ws("/", "tag", "value")).otherwise(F.concat(F.lit("noise/"), "first")).alias("cluster"))
    return rows.join(named, ["tag", "h"]).select("operation_id", "tag", "cluster")


def centroids(points: DataFrame) -> DataFrame:
    """(cluster, n, center) of points with an `embedding`; coordinates are averaged, so partial sums do the work."""
    each = points.select("cluster", F.posexplode("embedding").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return each.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("center"))


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """The Davies-Bouldin index. Each cluster meets each other one by definition; points only meet their own center."""
    c = centroids(points)
    spread = points.join(c, "cluster").groupBy("cluster").agg(F.avg(_distance("embedding", "center")).alias("s"))
    a = c.join(spread, "cluster").select(F.col("cluster").alias("a"), F.col("center").alias("ca"), F.col("s").alias("sa"))
    b = a.select(F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("sa").alias("sb"))
    worst = a.join(b, F.col("a") != F.col("b")).withColumn("r", (F.col("sa") + F.col("sb")) / _distance("ca", "cb")).groupBy("a").agg(F.max("r").alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def clustering_warnings(metrics: DataFrame) -> DataFrame:
    """Threshold warnings of metric rows (noise_ratio, silhouette, largest, capabilities, incomplete, low_connectivity)."""
    tests = [
        ("high noise", F.col("noise_ratio") > 0.3),
        ("low silhouette", F.col("silhouette") < 0.2),
        ("large cluster", F.col("largest") > 20),
        ("incomplete lifecycles", F.col("incomplete") > F.col("capabilities") * 0.5),
        ("low connectivity", F.col("low_connectivity") > 0),
    ]
    return metrics.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests])))


def quality_score(metrics: DataFrame) -> DataFrame:
    """0 to 100: silhouette .3, noise .2, connectivity .3 and sizes .2."""
    size = F.when(F.col("avg_size").between(3, 8), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("avg_size") - 5.5) / 10))
    sizes = F.when(F.col("avg_size") > 0, size * (1 - F.least(F.lit(1.0), F.col("std_size") / F.col("avg_size")) * 0.5)).otherwise(0.0)
    total = (F.col("silhouette") + 1) / 2 * 0.3 + F.greatest(F.lit(0.0), 1 - F.col("noise_ratio") * 2) * 0.2 + F.col("connectivity") * 0.3 + sizes * 0.2
    return metrics.withColumn("quality", F.round(total * 100, 2))


def keyword_match(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node whose text contains the most words of each query (the smallest id of equals); no hit, no row.

    A word lies in a text if it lies in one of its words, so the distinct words of the nodes are cut into all their
    pieces, which meet the distinct words of the queries by equality. The nodes of a word are bits of 64 places each; the
    words of a query are sent with these and counted by place, so a word of many nodes is no row for each.
    """
    words = lambda df, i: df.select(F.col(i), F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))).alias("w"))
    asked, held = words(queries, "query_id"), words(nodes, "node_id")
    ends = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.transform(F.sequence(F.lit(1), F.length("w") - i + 1), lambda n: F.substr("w", i, n)))
    pieces = held.select("w").distinct().select(F.explode(F.array_distinct(F.flatten(ends))).alias("piece"), "w")
    inside = asked.select(F.col("w").alias("piece")).distinct().join(pieces, "piece")
    places = numbered(nodes.select(F.col("node_id").alias("id")).distinct(), "id", name="place")
    placed = held.join(places, F.col("node_id").eqNullSafe(F.col("id"))).select("place", "w")
    posted = placed.join(inside, "w").select("place", F.col("piece").alias("w")).distinct()
    bits = posted.groupBy("w", F.floor(F.col("place") / 64).alias("block")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits"))
    met = asked.join(bits, "w").select("query_id", "block", "bits").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    counts = met.groupBy("query_id", "block").agg(*[F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"n{i}") for i in range(64)])
    most = F.array_min(F.array(*[F.struct((-F.col(f"n{i}")).alias("far"), (F.col("block") * 64 + i).alias("place")) for i in range(64)]))
    best = counts.groupBy("query_id").agg(F.min(most).alias("best"))
    return best.select("query_id", "best.*").join(places, "place").select("query_id", F.col("id").alias("node_id"), (-F.col("far")).alias("hits"))


def required_vs_optional(assigned: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds `kind` to (role, operation_id, name, description): required when a required capability is contained."""
    rows = assigned.join(roles.select("role", "required_capabilities"), "role")
    text = F.lower(F.concat_ws(" ", "name", "description"))
    return rows.select("role", "operation_id", F.when(F.exists("required_capabilities", lambda c: text.contains(F.lower(c))), "required").otherwise("optional").alias("kind"))


def role_statistics(classified: DataFrame) -> DataFrame:
    return classified.groupBy("role").agg(F.count("*").alias("apis"), F.count_if(F.col("kind") == "required").alias("required"), F.count_if(F.col("kind") == "optional").alias("optional"))


def empty_roles(roles: DataFrame, assigned: DataFrame) -> DataFrame:
    return roles.join(assigned.select("role").distinct(), "role", "left_anti").select("role")


def cross_domain_caps(capabilities: DataFrame, *, k: int = 2) -> DataFrame:
    """The first k capabilities of each domain, when there are several domains."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("ord"))
    several = capabilities.agg((F.countDistinct("domain") > 1).alias("several"))
    return capabilities.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(several)).where("several").drop("several")


def path_provides_fields(steps: DataFrame, responses: DataFrame, required: list[str]) -> DataFrame:
    """Whether the responses of a path's steps together have all required names."""
    have = steps.join(responses.where(F.col("name").isin(required)), "operation_id").groupBy("path_id").agg(F.countDistinct("name").alias("n"))
    return steps.select("path_id").distinct().join(have, "path_id", "left").select("path_id", (F.coalesce("n", F.lit(0)) == len(set(required))).alias("covered"))


def cross_entity_paths(edges: DataFrame, members: DataFrame, *, seed: float = 0.7, extend: float = 0.6, longest: int = 4) -> DataFrame:
    """Paths that start with a strong edge between entities and follow the first good edge to an unvisited node."""
    of = lambda s: members.select(F.col("node").alias(s), F.col("entity").alias(f"{s}_entity"))
    start = edges.where(F.col("score") > seed).join(of("src"), "src").join(of("dst"), "dst").where("src_entity != dst_entity")
    paths = start.select(F.array("src", "dst").alias("path"))
    good = edges.where(F.col("score") > extend).select("src", "dst", "score")
    for _ in range(longest - 2):
        grown = paths.withColumn("last", F.element_at("path", -1)).join(good, F.col("last") == F.col("src"), "left")
        fresh = F.when(~F.array_contains("path", F.col("dst")), F.struct((-F.col("score")).alias("s"), "dst"))
        best = grown.groupBy("path").agg(F.min(fresh).alias("next"))
        paths = best.select(F.when(F.col("next").isNotNull(), F.concat("path", F.array("next.dst"))).otherwise(F.col("path")).alias("path"))
    return paths.distinct()
