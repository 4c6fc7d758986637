"""Compression of vectors to one code a part (product quantisation), with an exact equal-average nearest-entry search.

A component becomes the integer floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a
codebook. For a part p and an entry c of w components, (sum p - sum c)^2 / w is at most their squared distance. So entries
lie sorted by component sum; the search starts at the part's own sum and expands outward on both sides until the squared gap
of sums over w strictly exceeds the best distance found. Parts of a batch are sorted by sum, so that neighbours look at the
same entries, a block of entries at a time; a part leaves as soon as its own gap ends it.

Codebooks start as the parts of the rows with the smallest ids. A round is one pass: a task adds up the parts of each entry
and gives at most one row an entry; Spark adds those, and only the codebooks (parts x entries x w numbers) reach the
driver. Then one pass gives the codes.

Defined results: rows whose vector is null or holds a null or non-finite component are left out; the length is that of the
row with the smallest id whose length the parts divide, and a vector of another length keeps its row with null code and
error; null ids sort last and equal ids by vector; fewer rows than entries make as many entries as rows; equal distances
go to the lower index; repeated rows each count and each keep a row; no rows give an empty result. Components so large that the
sums of squares of a vector would not fit a long (+-2^25 after scaling at 64 components) are held there. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import cut, documents, in_batches
from apiloom.llm.vectors import MOST, attach, is_finite, matrix, vectors_of, whole

_ROWS, _ENTRIES = 512, 16


class Codebook:
    """The entries of one part position, sorted by component sum."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        self.norms = (entries * entries).sum(axis=1)
        self.small = not len(entries) or int(np.abs(entries).max()) < 1 << 20

    def _look(self, parts: np.ndarray, low: int, high: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the entries [low, high) by sum; the lower index where equal."""
        some = np.sort(self.order[low:high])
        entries = self.entries[some]
        if small:  # exact: products of numbers under 2^20 add up to less than 2^53
            dots = (parts.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
        else:
            dots = parts @ entries.T
        gap = self.norms[some][None, :] - 2 * dots
        best = gap.argmin(axis=1)
        return some[best], gap[np.arange(len(parts)), best] + (parts * parts).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry."""
        n, width = parts.shape
        small = self.small and width <= 4096 and (not n or int(np.abs(parts).max()) < 1 << 20)
        which, best = np.full(n, len(self.entries)), np.full(n, MOST // width)
        sums = parts.sum(axis=1)
        order = np.argsort(sums, kind="stable")

        def take(rows: np.ndarray, low: int, high: int) -> None:
            found, distance = self._look(parts[rows], low, high, small)
            better = (distance < best[rows]) | ((distance == best[rows]) & (found < which[rows]))
            which[rows[better]], best[rows[better]] = found[better], distance[better]

        def near(rows: np.ndarray, edge: int) -> np.ndarray:
            gap = sums[rows] - edge
            return rows[gap * gap <= best[rows] * width]

        for at in range(0, n, _ROWS):
            rows = order[at : at + _ROWS]
            low = int(np.searchsorted(self.sums, sums[rows[0]], "left"))
            high = int(np.searchsorted(self.sums, sums[rows[-1]], "right"))
            for start in range(low, high, 4 * _ENTRIES):
                take(rows, start, min(high, start + 4 * _ENTRIES))
            left = right = rows
            while len(left) or len(right):
                left = near(left, self.sums[low - 1]) if low else rows[:0]
                if len(left):
                    take(left, max(0, low - _ENTRIES), low)
                    low = max(0, low - _ENTRIES)
                right = near(right, self.sums[high]) if high < len(self.sums) else rows[:0]
                if len(right):
                    take(right, high, min(len(self.sums), high + _ENTRIES))
                    high = min(len(self.sums), high + _ENTRIES)
        return which, best


def _limit(size: int, width: int) -> int:
    return isqrt(MOST // (4 * size * width))


def _codes(batch: pa.RecordBatch, books: list[Codebook], size: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part) codes and distances of the batch's vectors, and the vectors as integers."""
    width = size // len(books)
    values = whole(matrix(batch.column("vec"), size), scale, _limit(size, width))
    found = [book.nearest(values[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1), values


def _round(rows: DataFrame, books: list[Codebook], size: int, scale: int) -> list[Codebook]:
    """One round: every used entry becomes the floor of the mean of its parts."""
    width, many = size // len(books), len(books[0].entries)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held.value
        sums, counts = np.zeros((len(mine) * many, width), np.int64), np.zeros(len(mine) * many, np.int64)
        for batch in batches:
            if batch.num_rows:
                codes, _, values = _codes(batch, mine, size, scale)
                place = (codes + np.arange(len(mine)) * many).ravel()
                np.add.at(sums, place, values.reshape(-1, width))
                counts += np.bincount(place, minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found]), pa.array(list(sums[found]), pa.list_(pa.int64()))], names=["place", "n", "sums"])

    parts = in_batches(rows.select("vec"), run, "place int, n bigint, sums array<bigint>")
    totals = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    entries = [book.entries.copy() for book in books]
    for r in parts.groupBy("place").agg(F.sum("n").alias("n"), *totals).collect():
        entries[r["place"] // many][r["place"] % many] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    held.unpersist()
    return [Codebook(e) for e in entries]


def encode_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, kept columns, code, error) of every row that counts, and the codebook of each part as integer rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has at most 256 entries")
    own = list(dict.fromkeys([id_col, *(keep or [])]))
    every = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], vectors_of(rows, vec_col).alias("vec")).where(is_finite(F.col("vec")))
    declared = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(every.schema.fields[:-1])) + ", code string, error bigint"
    whole_parts = every.where((F.size("vec") > 0) & (F.size("vec") % parts == 0))
    first = whole_parts.orderBy(F.col("c0").asc_nulls_last(), "vec").select(F.size("vec")).first()
    if first is None:
        return every.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    size = first[0]
    width = size // parts
    same = every.where(F.size("vec") == size)
    start = same.orderBy(F.col("c0").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    initial = whole(np.array([r["vec"] for r in start], np.float64), scale, _limit(size, width))
    books = [Codebook(initial[:, p * width : (p + 1) * width]) for p in range(parts)]
    for _ in range(rounds):
        books = _round(same, books, size, scale)
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.diff(batch.column("vec").offsets.to_numpy()) == size
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if fits.any():
                found, distances, _ = _codes(batch.filter(pa.array(fits)), held.value, size, scale)
                text = found.astype(np.uint8).tobytes().hex()
                for k, i in enumerate(np.flatnonzero(fits).tolist()):
                    codes[i] = text[2 * parts * k : 2 * parts * (k + 1)]
                    errors[i] = int(distances[k].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*batch.schema.names[:-1], "code", "error"])

    out = in_batches(every, run, declared)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "code", "error"), [b.entries for b in books]


def decode(codes: str, books: list[np.ndarray], scale: int = 1024) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p][int(codes[2 * p : 2 * p + 2], 16)] for p in range(len(books))]) / scale


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error, its label's error and the digest of the codebooks."""
    found, books = encode_vectors(documents(spark, sf_dir, "embeddings"), keep=["label"])
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    found = cut(found)
    most = F.lit(MOST).cast("decimal(38,0)")
    totals = found.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    return attach(found, totals, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, size: int = 64) -> str:
    width = size // parts
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    s AS MATERIALIZED (SELECT r, p, q[p * {width} + 1 : (p + 1) * {width}] AS q FROM v, range({parts}) AS t(p)),
    c0 AS MATERIALIZED (SELECT p, r - 1 AS e, q FROM s WHERE r <= {entries})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
          SELECT s.r, s.p, c.e, list_inner_product(s.q, s.q) - 2 * list_inner_product(s.q, c.q) + list_inner_product(c.q, c.q) AS d FROM s JOIN c{i} AS c USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT p, e, list(f ORDER BY j) AS q FROM (SELECT p, e, j, floor(sum(s.q[j]) / count(*)) AS f
              FROM a{i} JOIN s USING (r, p), range(1, {width + 1}) AS t(j) GROUP BY p, e, j) GROUP BY p, e),
            c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.q, c.q) AS q FROM c{i} AS c LEFT JOIN m{i} AS m USING (p, e))""")
    return f"""WITH {", ".join(steps)},
    k AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d) AS error FROM a{rounds} GROUP BY r),
    h AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
    SELECT v.vec_id, k.code, k.error::BIGINT AS error, (sum(k.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, h.codebooks_sha256 FROM v JOIN k USING (r), h"""


OP11_SQL = _oracle()
