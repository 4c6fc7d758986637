"""Removal of passages that repeat an earlier document, by difference-cover anchors.

A difference cover of a period P is a set of residues such that for any two positions i and j some shift of less than P
puts both i and j plus the shift on the cover. So two equal windows of `window` words have, at one common offset below P, an
anchor of window - P + 1 words that starts at a cover position in both texts. With a window of 50 words, P = 31, six
residues and anchors of 20 words, less than a fifth of all positions is hashed.

1. Exact copies of a text with a smaller id need no search: all their windows are in that document.
2. Every other text gives its distinct anchors at cover positions; an anchor that only one document has goes, by a count
   with partial sums.
3. A document with a shared anchor is read again; its shared anchors extend to the windows around them, each known by two
   64-bit hashes of its words. The smallest id of each window comes from a grouped minimum, again with partial results,
   and the windows whose smallest id is less than their document's are its repeated windows.
4. The words they cover are removed.

No group is ever listed or paired: a passage in a third of all documents is one row of counts and minima, and the joins
back to its occurrences are equality joins on written tables, whose hot keys adaptive execution splits. What is gathered
in one place belongs to one document. Small sides are broadcast only after a count.

Defined results: ids decide alone, so rows of one id never remove each other's words, and repeated rows each get the same
result; a null id neither removes nor loses anything; null and blank texts have no words; texts shorter than a window keep
all words; words are compared as bytes, unchanged. Two different windows are taken for equal only if both 64-bit hashes agree.
Other columns are carried along (`n_words`, `n_removed`, `kept` and `kept_sha256` are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import cut, discard, documents, in_batches, slices, words_of, written
from apiloom.llm.shingles import mix, run_hashes, word_hashes

#: Perfect difference sets: every residue but 0 is a difference of two members in exactly one way.
COVERS = {1: [0], 3: [0, 1], 7: [1, 2, 4], 13: [0, 1, 3, 9], 21: [3, 6, 7, 12, 14], 31: [1, 5, 11, 24, 25, 27]}
_SECOND = np.uint64(0xA0761D6478BD642F)
_SLICE = 1_000_000
_RUNS = "array<struct<first:int,last:int>>"


def cover_of(window: int) -> tuple[int, np.ndarray, int]:
    """(period, which residues are on the cover, words of an anchor) for windows of so many words."""
    period = max(p for p in COVERS if p == 1 or 3 * p <= 2 * window)
    on = np.zeros(period, bool)
    on[COVERS[period]] = True
    return period, on, window - period + 1


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of one text and the hashes of the anchors there."""
    period, on, length = cover_of(window)
    hashes = run_hashes(words, length)
    at = np.flatnonzero(on[np.arange(len(hashes)) % period])
    return at, hashes[at]


def _windows(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return run_hashes(words, window), run_hashes(mix(words ^ _SECOND), window)


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of the texts of a batch."""
    words, counts = word_hashes(batch.column("text").to_pylist(), lower=False)
    at = 0
    for i, n in enumerate(counts.tolist()):
        yield i, words[at : at + n]
        at += n


def _spread(column: pa.Array, counts: list[int]) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(counts)), counts)))


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, node): the distinct anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            found = [np.unique(_anchors(words, window)[1]) if len(words) >= window else np.zeros(0, np.uint64) for _, words in _each(batch)]
            if sum(map(len, found)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), _spread(batch.column("node"), [len(f) for f in found])], names=["anchor", "node"])

    return in_batches(texts.select("node", "text"), run, "anchor bigint, node bigint")


def _window_rows(texts: DataFrame, window: int, kind: str) -> DataFrame:
    """(a, b, id, node, start): windows around the shared anchors of each text."""
    period, _, length = cover_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, _SLICE):
            starts, one, two = [], [], []
            for i, words in _each(batch):
                at, hashes = _anchors(words, window)
                shared = batch.column("anchors")[i].values.to_numpy().view(np.uint64)
                at = at[np.isin(hashes, shared)]
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, np.maximum(0, at - (period - 1)), 1)
                np.add.at(edges, at + 1, -1)
                some = np.flatnonzero(np.cumsum(edges)[: max(0, len(words) - window + 1)])
                a, b = _windows(words, window)
                starts.append(some)
                one.append(a[some])
                two.append(b[some])
            counts = [len(s) for s in starts]
            if sum(counts):
                arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([*arrays, _spread(batch.column("id"), counts), _spread(batch.column("node"), counts), pa.array(np.concatenate(starts), pa.int32())], names=["a", "b", "id", "node", "start"])

    return in_batches(texts.select("id", "node", "text", "anchors"), run, f"a bigint, b bigint, id {kind}, node bigint, start int")


def _few(rows: DataFrame, most: int, listed: str | None = None) -> DataFrame:
    """The rows, marked for a broadcast if they, with the elements of the array column `listed`, were counted to be at
    most `most`."""
    size = rows.agg(F.sum(F.size(listed) + 1) if listed else F.count("*")).first()[0]
    return F.broadcast(rows) if (size or 0) <= most else rows


def repeated_windows(texts: DataFrame, *, window: int = 50) -> DataFrame:
    """(id, node, runs): for (id, node, text) with distinct texts, the windows that also start in a text with a smaller id, as
    runs of consecutive starts."""
    kind = texts.schema["id"].dataType.simpleString()
    anchors = written(_anchor_rows(texts, window), "anchors")
    shared = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    marked = cut(anchors.join(shared, "anchor", "left_semi").groupBy("node").agg(F.collect_set("anchor").alias("anchors")))
    discard(anchors)
    discard(shared)
    windows = written(_window_rows(texts.join(marked, "node"), window, kind), "windows")
    least = windows.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    least = written(least, "first-windows")
    late = windows.join(least, ["a", "b"]).where("id > first")
    starts, at = late.groupBy("id", "node").agg(F.array_sort(F.collect_set("start")).alias("starts")), F.col("starts")
    first = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    last = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    found = cut(starts.select("id", "node", F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))).alias("runs")))
    discard(windows)
    discard(least)
    return found


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, max_broadcast: int = 1_000_000) -> DataFrame:
    """The rows with `kept` (the kept words joined by one blank), `n_words` and `n_removed`."""
    new = ("kept", "n_words", "n_removed")
    out = [f for f in docs.schema if f.name.lower() not in new]
    text = F.col(f"`{text_col}`")
    texts = docs.where(F.col(f"`{id_col}`").isNotNull() & (F.octet_length(text) >= 2 * window - 1)).select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    texts = texts.withColumns({"node": F.xxhash64("id", "text"), "same": F.xxhash64("text"), "again": F.xxhash64(F.lit(1), "text")})
    rows = cut(texts.select("id", "node", "same", "again"))
    groups = cut(rows.groupBy("same", "again").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1"))
    later = _few(groups.where("first < last"), max_broadcast)
    copies = cut(rows.join(later, ["same", "again"]).where("id > first").select("id", "node").distinct())
    sources = texts.join(_few(copies, max_broadcast), ["id", "node"], "left_anti")
    if not groups.isEmpty():  # rows that repeat id and text count once
        again = cut(rows.groupBy("id", "node").count().where("count > 1").select("id", "node"))
        if not again.isEmpty():
            twice = _few(again, max_broadcast)
            sources = sources.join(twice, ["id", "node"], "left_anti").unionByName(sources.join(twice, ["id", "node"], "left_semi").dropDuplicates(["id", "node"]))
    found = repeated_windows(sources.select("id", "node", "text"), window=window)
    whole = copies.select("id", "node", F.array().cast(_RUNS).alias("runs"))
    marks = cut(found.unionByName(whole))
    return _apply(docs, out, F.col(f"`{id_col}`"), text, _few(marks, max_broadcast, "runs"), window)


def _apply(docs: DataFrame, out: list, own: Column, text: Column, marks: DataFrame, window: int) -> DataFrame:
    names = [f.name for f in out]
    plain = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], text.alias("text"), own.alias("id"), F.xxhash64(own, text).alias("node"))
    rows = plain.join(marks, ["id", "node"], "left").select(*[f"c{i}" for i in range(len(names))], "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(names)):
            kept, counts, removed = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = words_of(text or "")
                counts.append(len(words))
                if runs is not None:
                    every = [{"first": 0, "last": len(words) - window}] if len(words) >= window else []
                    at, left = 0, []
                    for run in runs or every:  # a copy has no runs: all its windows go
                        left += words[at : run["first"]]
                        at = max(at, run["last"] + window)
                    words = left + words[at:]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            arrays = [*batch.columns[: len(names)], pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[: len(names)], "kept", "n_words", "n_removed"])

    declared = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(out)] + ["kept string", "n_words bigint", "n_removed bigint"])
    return in_batches(rows, run, declared).toDF(*names, "kept", "n_words", "n_removed")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that a document with a smaller id has."""
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS MATERIALIZED (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT h.r, h.i + t.j AS i FROM h JOIN f USING (k), range(50) AS t(j) WHERE h.doc_id > f.first),
c AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(x.v, ' ' ORDER BY x.i) FROM (SELECT unnest(d.w) AS v, generate_subscripts(d.w, 1) AS i) AS x
    WHERE NOT list_contains(c.gone, x.i)), '') END) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
