"""Roles, domains, access and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ["MONITOR", "READ_ONLY", "DELEGATE", "EXECUTE"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _block_pairs(left: DataFrame, right: DataFrame, left_size: int, right_size: int, *, most: int = 16) -> DataFrame:
    """(x, y): arrays of rows, so that each block of the left meets each block of the right.

    A side has a block for each `size` rows, but `most` at the most: a row is sent once for each block of the other side,
    so what is shuffled stays linear in the rows, and a block is a sixteenth of them where they are many. Blocks are dealt
    by a hash of the id, so none depends on a key; both sides carry both block numbers, and the join on them spreads the
    pairs over the cluster. Nothing passes through the driver but the two counts.
    """
    sides = []
    for rows, size in ((left, left_size), (right, right_size)):
        n = min(most, max(1, -(-rows.count() // size)))
        each = F.struct(*rows.columns)
        sides.append((rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n).cast("long")).alias("block")).agg(F.collect_list(each).alias("rows")), n))
    (x, many_x), (y, many_y) = sides
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = x.select(F.col("block").alias("i"), F.col("rows").alias("x"), number(many_y).alias("j"))
    y = y.select(F.col("block").alias("j"), F.col("rows").alias("y"), number(many_x).alias("i"))
    return x.join(y.hint("merge"), ["i", "j"]).select("x", "y")


def _vectors(rows: DataFrame) -> Column:
    """The embedding in its own width: four bytes a component where it has floats, else eight."""
    kind = rows.schema["embedding"].dataType.simpleString()
    return F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding")


def _matrix(cell: pa.ListScalar) -> tuple[pa.StructArray, np.ndarray]:
    """The rows of one block and their vectors."""
    rows = cell.values
    vectors = rows.field("embedding")
    return rows, np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)


#: Cells of a table of products that a worker holds at once (8 MB).
STRIP_CELLS = 1 << 20


def _strips(rows: int, width: int) -> Iterator[slice]:
    """Slices of the rows whose products with `width` others fit in STRIP_CELLS."""
    step = max(1, STRIP_CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, measure: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, id, similarity) of the k best rows of x for each of q, by id among equals, strip by strip."""
    k, xx = min(k, len(x)), (x * x).sum(1)
    for strip in _strips(len(q), len(x)) if k else ():
        part = q[strip]
        s = part @ x.T
        if measure == "l2":
            s = 1 / (1 + np.maximum(0, (part * part).sum(1)[:, None] + xx[None] - 2 * s))
        elif measure == "cosine":
            n = np.linalg.norm(part, axis=1)[:, None] * np.sqrt(xx)[None]
            s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        s = np.round(s, 9)
        order = np.where(np.isnan(s), -np.inf, s)
        r, c = np.nonzero(order >= np.partition(order, len(x) - k, axis=1)[:, len(x) - k, None])
        by = np.lexsort((ids[c], -order[r, c], r))
        r, c = r[by], c[by]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[first], c[first]
        yield r + strip.start, ids[c], s[r, c]


def top_vectors(items: DataFrame, queries: DataFrame, k: int, *, measure: str = "l2", item_block: int = 4096, query_block: int = 4096) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the k nearest items of each query, exactly.

    Each pair of blocks gives the best k of its items for each of its queries, in strips of a few MB; a global rank ends it,
    so nothing that grows with the items or the queries is ever in one place. `l2` gives 1/(1+d), d squared; `dot` and
    `cosine` give the product. Every item is compared with every query: the work is the product of the two sides.
    """
    left = queries.select(F.col("query_id").cast("long").alias("id"), _vectors(queries))
    right = items.select(F.col("vec_id").cast("long").alias("id"), _vectors(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
                (names, q), (vecs, x) = _matrix(a), _matrix(b)
                names = names.field("id").to_numpy()
                for r, i, s in _best(q, x, vecs.field("id").to_numpy(), k, measure):
                    yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "similarity"])

    out = _block_pairs(left, right, query_block, item_block).mapInArrow(run, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(items: DataFrame, queries: DataFrame, k: int, *, threshold: float = 0.0) -> DataFrame:
    return top_vectors(items, queries, k).where(F.col("similarity") >= threshold)


def procedure_search(items: DataFrame, queries: DataFrame, k: int, domain: str) -> DataFrame:
    """Top k by dot product, and only then the domain filter: fewer than k rows may remain."""
    return top_vectors(items, queries, k, measure="dot").join(items.select("vec_id", "domain"), "vec_id").where(F.col("domain") == domain)


def best_of_few(items: DataFrame, few: DataFrame, k: int) -> DataFrame:
    """(vec_id, query_id, similarity, rank) of the k most similar (cosine) rows of the small side for each item."""
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    best = top_vectors(few.select(F.col("query_id").alias("vec_id"), "embedding"), asked, k, measure="cosine")
    return best.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("query_id"), "similarity", "rank")


def role_alignment(items: DataFrame, roles: DataFrame, *, k: int = 3, least: float = 0.6) -> DataFrame:
    """The k best roles of each API by cosine, of at least `least`."""
    best = best_of_few(items, roles, k).where(F.col("similarity") >= least)
    return best.select("vec_id", F.col("query_id").alias("role_id"), "similarity", "rank")


def nearest_cluster(noise: DataFrame, clustered: DataFrame, *, least: float = 0.6) -> DataFrame:
    """Each noise row joins the cluster of its most similar clustered row, when that is similar enough, else its own."""
    best = top_vectors(clustered, noise.select(F.col("vec_id").alias("query_id"), "embedding"), 1, measure="cosine")
    found = best.join(clustered.select("vec_id", "cluster"), "vec_id").select(F.col("query_id").alias("noise_id"), "cluster", "similarity")
    near = F.col("similarity") >= least
    return found.select(F.col("noise_id").alias("vec_id"), F.when(near, F.col("cluster").cast("string")).otherwise(F.concat(F.lit("own_"), F.col("noise_id").cast("string"))).alias("cluster"), "similarity")


def domain_scores(texts: DataFrame, keywords: DataFrame, *, secondary: float = 0.15) -> DataFrame:
    """Share of keyword hits of each domain: each word of a text that is a keyword counts once per row and keyword."""
    word = texts.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("keyword"))
    hits = word.join(keywords, "keyword").groupBy("domain").agg(F.count("*").alias("hits"))
    scored = hits.withColumn("score", F.round(F.col("hits") / F.sum("hits").over(Window.partitionBy()), 6))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "domain"))
    return scored.withColumn("kind", F.when(rank == 1, "primary").when(F.col("score") >= secondary, "secondary").otherwise("other"))


def access_matrix(grants: DataFrame) -> DataFrame:
    """(agent_id, capability, mode): the later list of direct, composed and delegated grants overrides."""
    rows = [grants.select("agent_id", F.explode(c).alias("capability"), F.lit(i).alias("ord"), F.lit(m).alias("mode")) for i, (c, m) in enumerate((("direct", "EXECUTE"), ("composed", "READ_ONLY"), ("delegated", "DELEGATE")))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("agent_id", "capability").agg(F.max_by("mode", "ord").alias("mode"))


def check_permission(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(MODES) for x in (m, i)])
    rows = requests.join(matrix.withColumnRenamed("mode", "granted"), ["agent_id", "capability"], "left")
    return rows.withColumn("allowed", F.coalesce(rank[F.col("granted")] >= rank[F.col("mode")], F.lit(False)))


def shared_capabilities(references: DataFrame, *, least: int = 2) -> DataFrame:
    """Capabilities that at least `least` agents refer to."""
    return references.groupBy("capability").agg(F.countDistinct("agent_id").alias("agents")).where(F.col("agents") >= least)


def blueprint_statistics(agents: DataFrame, capabilities: DataFrame, shared: DataFrame, topology: DataFrame) -> DataFrame:
    """(part, name, n) of an organisation: agents in all, real, virtual and by level; capabilities in all, by kind and shared;
    nodes and edges by type; and which patterns of composition (0 or 1) it has.

    Agents have `level` and `is_virtual`, capabilities `kind` (atomic, composed, strategic), the topology `type`. Each row
    names what it counts for, and one grouping with partial counts adds all of them up.
    """
    total, level = F.lit("total"), F.concat(F.lit("level "), F.col("level").cast("string"))
    real = F.when(F.coalesce("is_virtual", F.lit(False)), "virtual").otherwise("real")
    sources = ((agents, "agents", (total, real, level)), (capabilities, "capabilities", (total, F.col("kind"))), (shared, "capabilities", (F.lit("shared"),)), (topology, "topology", (F.col("type"),)))
    named = [rows.select(F.lit(part).alias("part"), F.explode(F.array_compact(F.array(*names))).alias("name")) for rows, part, names in sources]
    counts = named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]).groupBy("part", "name").agg(F.count("*").alias("n"))
    has = lambda kind: F.coalesce(F.max(F.when((F.col("part") == "capabilities") & (F.col("name") == kind), 1)), F.lit(0)).cast("long")
    patterns = F.array(*[F.struct(F.lit(p).alias("name"), has(k).alias("n")) for p, k in (("horizontal_reuse", "shared"), ("vertical_promotion", "composed"), ("cross_domain", "strategic"))])
    return counts.unionByName(counts.agg(patterns.alias("p")).select(F.lit("composition_pattern").alias("part"), F.inline("p")))


def orphan_apis(apis: DataFrame, assigned: DataFrame) -> DataFrame:
    return apis.join(assigned.select("operation_id").distinct(), "operation_id", "left_anti")


def topology_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("part", F.lit("node"))
    return n.unionByName(edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("part", F.lit("edge")))


def reporting_lines(agents: DataFrame) -> DataFrame:
    """How many agents of the level below each agent manages; a level is counted once, no pairs are made."""
    sizes = agents.groupBy((F.col("level") - 1).alias("level")).agg(F.count("*").alias("reports"))
    return agents.join(sizes, "level").select("agent_id", "level", "reports")


def search_nodes(nodes: DataFrame, text: str, **equal) -> DataFrame:
    """Nodes whose name, capability or data scope contains the text, and whose columns equal the given values."""
    found = F.lower(F.concat_ws(" ", *[c for c in ("name", "capability", "datascope") if c in nodes.columns])).contains(text.lower())
    for name, value in equal.items():
        found = found & (F.col(name) == F.lit(value))
    return nodes.where(found)


def adjusted_roles(roles: DataFrame, empty: DataFrame, new: DataFrame) -> DataFrame:
    """Roles that have APIs, and the new ones."""
    return roles.join(empty.select("role"), "role", "left_anti").select("role").unionByName(new.select("role")).distinct()


def shared_by_level(references: DataFrame, agents: DataFrame, *, least: int = 2) -> DataFrame:
    """Capabilities that at least `least` agents of one level refer to."""
    return references.join(agents.select("agent_id", "level"), "agent_id").groupBy("level", "capability").agg(F.countDistinct("agent_id").alias("agents")).where(F.col("agents") >= least)


def task_similarity(scores: DataFrame) -> DataFrame:
    """1 - |difference| of the mean scores of each pair of tasks; tasks are few, and each pair is made once."""
    mean = scores.groupBy("task").agg(F.avg("score").alias("m"))
    a, b = mean.select(F.col("task").alias("a"), F.col("m").alias("ma")), mean.select(F.col("task").alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(1 - F.abs(F.col("ma") - F.col("mb")), 6).alias("similarity"))


def _sums(q: np.ndarray, names: np.ndarray, x: np.ndarray, vecs: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of q, label, sum of the distances to the rows of x with that label), strip by strip; a point is 0 from itself."""
    by = np.argsort(labels, kind="stable")
    x, vecs = x[by], vecs[by]
    kinds, starts = np.unique(labels[by], return_index=True)
    xx, known = (x * x).sum(1), np.isin(names, vecs)
    for strip in _strips(len(q), len(x)):
        part = q[strip]
        d = np.sqrt(np.maximum(0, (part * part).sum(1)[:, None] + xx[None] - 2 * part @ x.T))
        if known[strip].any():
            d[names[strip][:, None] == vecs[None]] = 0
        yield np.repeat(np.arange(strip.start, strip.start + len(part)), len(kinds)), np.tile(kinds, len(part)), np.add.reduceat(d, starts, axis=1).ravel()


def silhouette(points: DataFrame, *, block: int = 4096) -> DataFrame:
    """Mean Euclidean silhouette over all points (vec_id, embedding, cluster).

    Every pair of points counts, so the cost is quadratic by definition; each pair of blocks gives sums by (point,
    cluster) only.
    """
    rows = points.select(F.col("vec_id").cast("long").alias("id"), _vectors(points), F.col("cluster").cast("long").alias("cluster"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("x"), batch.column("y"), strict=True):
                (names, q), (others, x) = _matrix(a), _matrix(b)
                names = names.field("id").to_numpy()
                for r, c, total in _sums(q, names, x, others.field("id").to_numpy(), others.field("cluster").to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(c), pa.array(total)], names=["vec_id", "other", "total"])

    parts = _block_pairs(rows.select("id", "embedding"), rows, block, block).mapInArrow(run, "vec_id long, other long, total double")
    total = parts.groupBy("vec_id", "other").agg(F.sum("total").alias("total")).join(rows.select(F.col("id").alias("vec_id"), "cluster"), "vec_id")
    sized = total.join(sizes.select(F.col("cluster").alias("other"), "n"), "other")
    own = F.max(F.when((F.col("other") == F.col("cluster")) & (F.col("n") > 1), F.col("total") / (F.col("n") - 1)))
    far = F.min(F.when(F.col("other") != F.col("cluster"), F.col("total") / F.col("n")))
    each = sized.groupBy("vec_id").agg(own.alias("a"), far.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.round(F.avg(value), 6).alias("silhouette"))
