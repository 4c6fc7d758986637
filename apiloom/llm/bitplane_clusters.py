"""Clusters of 64-component vectors around centroids, with distances by bit planes and popcounts.

A component becomes the integer floor(scale * x). Plane b of a vector is one uint64 whose bit j is bit b of component j in
two's complement; the last plane carries the sign and weighs -2^b. The dot product of two vectors is the sum over all
pairs of planes of weight * weight * popcount(plane AND plane), so |v|^2 - 2 v.c + |c|^2 is exact.

Vectors are packed once and written as planes (10 words of 8 bytes for components within -1 and 1 at scale 256, instead of
64 floats). Each round is one pass over them: a task adds up, for each centroid, the rows nearest to it, and gives at most
one row a centroid; Spark adds those, and only the k sums reach the driver. Nothing is shuffled but these sums.

Defined results: rows whose vector is null, of another length, or holds a null or non-finite component are left out; a
null id sorts after all hashes, equal hashes go by the vector; fewer rows than k make as many centroids as rows; equal
distances go to the smaller number; repeated rows each count and each keep a row; no rows give an empty result. Components
beyond +-2^27 after scaling are held there: a sum of 64 squared differences would not fit a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import cut, documents, in_batches, written
from apiloom.llm.vectors import MOST, is_finite, limit_of, matrix, vectors_of, whole

SIZE = 64
_CHUNK = 4096


def pack(values: np.ndarray) -> np.ndarray:
    """Planes (row, plane) of 64-component integer rows, as few as all of them need; the last one is the sign."""
    top = int(max(values.max(initial=0), -values.min(initial=0) - 1))
    bits = (values[:, None, :] >> np.arange(top.bit_length() + 1)[None, :, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def plane_weights(n: int) -> list[int]:
    return [1 << b for b in range(n - 1)] + [-(1 << (n - 1))]


def unpack(planes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    out = np.zeros((len(planes), SIZE), np.int64)
    for b, w in enumerate(plane_weights(planes.shape[1])):
        out += bits[:, b, :].astype(np.int64) * w
    return out


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact dot products of every left with every right row, from their planes."""
    out = np.zeros((len(left), len(right)), np.int64)
    for a, wa in enumerate(plane_weights(left.shape[1])):
        row = np.zeros_like(out)
        for b, wb in enumerate(plane_weights(right.shape[1])):
            row += np.bitwise_count(left[:, a, None] & right[None, :, b]).astype(np.int64) * wb
        out += row * wa
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(planes), np.int64)
    weights = plane_weights(planes.shape[1])
    for a, wa in enumerate(weights):
        for b, wb in enumerate(weights):
            out += np.bitwise_count(planes[:, a] & planes[:, b]).astype(np.int64) * (wa * wb)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid; `lengths` are the centroids' squared norms."""
    which, distance = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    for at in range(0, len(planes), _CHUNK):
        some = planes[at : at + _CHUNK]
        gap = lengths[None, :] - 2 * dots(some, centroids)
        best = gap.argmin(axis=1)
        which[at : at + _CHUNK] = best
        distance[at : at + _CHUNK] = gap[np.arange(len(some)), best] + norms(some)
    return which, distance


def _planes(batch: pa.RecordBatch) -> np.ndarray:
    """Planes of a batch whose tasks packed with different numbers of planes: a sign plane may be repeated."""
    column = batch.column("planes")
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().view(np.uint64)
    most = int(counts.max())
    ends = np.cumsum(counts)
    at = np.minimum(np.arange(most)[None, :], counts[:, None] - 1) + (ends - counts)[:, None]
    out = flat[at]
    if most > counts.min():  # the planes between the own sign and the common one repeat the sign
        return pack(np.concatenate([unpack(out[i : i + 1, :n]) for i, n in enumerate(counts)]))
    return out


def pack_rows(rows: DataFrame, *, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, planes) of the rows that count, written once for all rounds."""
    kind = rows.schema[id_col].dataType.simpleString()
    vec = vectors_of(rows, vec_col)
    chosen = rows.select(F.col(id_col).alias("id"), vec.alias("vec")).where((F.size("vec") == SIZE) & is_finite(F.col("vec")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                planes = pack(whole(matrix(batch.column("vec"), SIZE), scale, limit_of(SIZE)))
                offsets = np.arange(0, planes.size + 1, planes.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(planes.ravel().view(np.int64)))], names=["id", "planes"])

    return written(in_batches(chosen, run, f"id {kind}, planes array<bigint>"), "planes")


def _first_centroids(rows: DataFrame, k: int, seed: int, id_col: str, vec_col: str, scale: int) -> np.ndarray:
    vec = vectors_of(rows, vec_col)
    chosen = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("place"), vec.alias("vec"))
    got = chosen.where((F.size("vec") == SIZE) & is_finite(F.col("vec"))).orderBy(F.col("place").asc_nulls_last(), "vec").limit(k).collect()
    return whole(np.array([r["vec"] for r in got], np.float64).reshape(-1, SIZE), scale, limit_of(SIZE))


def _moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of the mean of its rows."""
    k = len(centroids)
    held = packed.sparkSession.sparkContext.broadcast((pack(centroids), (centroids * centroids).sum(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, SIZE), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                planes = _planes(batch)
                which, _ = nearest(planes, *held.value)
                np.add.at(sums, which, unpack(planes))
                counts += np.bincount(which, minlength=k)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found]), pa.array(list(sums[found]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = packed.select("planes").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    totals = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(SIZE)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        out[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(SIZE)]
    held.unpersist()
    return out


def cluster_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every row that counts, and the centroids as integer rows."""
    centroids = _first_centroids(rows, k, seed, id_col, vec_col, scale)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, cluster int, distance bigint"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema), centroids
    packed = pack_rows(rows, id_col=id_col, vec_col=vec_col, scale=scale)
    for _ in range(rounds):
        centroids = _moved(packed, centroids)
    held = rows.sparkSession.sparkContext.broadcast((pack(centroids), (centroids * centroids).sum(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, distance = nearest(_planes(batch), *held.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(which), pa.array(distance)], names=[id_col, "cluster", "distance"])

    return packed.mapInArrow(run, schema), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster, distance, the inertia of cluster and table, and its centroid's digest."""
    found, centroids = cluster_vectors(documents(spark, sf_dir, "embeddings"))
    found = cut(found)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(MOST, sum(sums.values()))
    digests = [(c, min(MOST, s), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(digests, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2) -> str:
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS q FROM embeddings
      WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
      f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS cluster, q FROM (SELECT vec_id, q FROM v ORDER BY sha256('{seed}:' || vec_id), q LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
          SELECT v.r, c.cluster, list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q) AS d FROM v, c{i} AS c) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT cluster, list(f ORDER BY j) AS q FROM (SELECT cluster, j, floor(sum(v.q[j]) / count(*)) AS f
              FROM a{i} JOIN v USING (r), range(1, {SIZE + 1}) AS t(j) GROUP BY cluster, j) GROUP BY cluster),
            c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster))""")
    return f"""WITH {", ".join(steps)}
    SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
      (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT), ',')) AS centroid_sha256
    FROM a{rounds} AS a JOIN v USING (r) JOIN c{rounds} AS c ON c.cluster = a.cluster"""


OP12_SQL = _oracle()
