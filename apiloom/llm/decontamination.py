"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index over Hamming blocks, and an exact
weighted-shingle similarity.

Item lengths fall into classes whose ends differ by at most a fifth; for each class a window of its middle length steps
over every text by a sixth of that length. The fingerprint of a window is the sign of the sum of its word bigrams'
hashed +-1 vectors, from running sums over the text; a bigram counts once in any sixteen words (in sixty-four, for items of
400 words and more), so that a repeated word, or a table of zeros, beside an item does not outvote it. Fingerprints are cut into four blocks of 16 bits: two within Hamming
distance 15 agree within 3 bits in at least one block, so a table of all values within 3 bits of each item's block
misses none. Items that pass the full Hamming distance are compared exactly: the best window of the item's length near
the hit, by the weight of shared five-word shingles over the weight of all, with inverse item frequencies as weights;
at 0.75 and above the document matches the item. Frequencies are counted over the whole benchmark; a shingle that the
item does not have weighs like one of a single item, so a similarity depends on the text, the item and the benchmark only.

The pass has no shuffle and no state: each text is scanned whole in one task, and memory is bounded by the slice. The
index of items is broadcast in blocks of about `block_items` items and `block_bytes` bytes of their texts; more items mean
more passes, not a larger index, and the same result.

Defined results: null or blank texts and items match nothing; an item of fewer than five words counts as one shingle;
repeated rows and null ids each get their matches; equal similarities go to the earliest window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import cut, documents, in_batches, set_aside, slices
from apiloom.llm.shingles import mix, word_hashes

RADIUS = 15
_BLOCKS, _BLOCK_BITS = 4, 16
_NEAR = 16
_MATCHES = "array<struct<item_id:long,start:int,n_words:int,similarity:double>>"


def _folded(text: str) -> list[bytes]:
    return [w.lower() for w in text.encode("utf-8", "surrogatepass").split()]


def _shingles(words: list[bytes], width: int) -> list[tuple]:
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [tuple(words)]


def _sums(words: np.ndarray, near: int = _NEAR, text: np.ndarray | None = None) -> np.ndarray:
    """Running sums (16-bit, a row for each bit) of the +-1 vectors of the bigrams before each word. A bigram that stands in
    the last `near` words of the same text (`text`: the text of each word) already adds nothing."""
    pairs = mix(words[:-1] * np.uint64(0xD1342543DE82EF95) + words[1:])
    again = np.zeros(len(pairs), bool)
    for gap in range(1, min(near, len(pairs) - 1) + 1):
        same = pairs[gap:] == pairs[:-gap]
        if text is not None:
            same &= text[gap:-1] == text[: -gap - 1]
        again[gap:] |= same
    signs = np.ascontiguousarray(np.unpackbits(pairs.view(np.uint8)).view(np.int8).reshape(-1, 64).T)
    signs += signs
    signs -= 1
    signs[:, again] = 0
    out = np.zeros((64, len(words)), np.int16)
    np.cumsum(signs, axis=1, dtype=np.int16, out=out[:, 1:])
    return out


def _near(size: int) -> int:
    """How far back a bigram counts as repeated, for windows of this many words."""
    return _NEAR if size < 400 else 4 * _NEAR


def _signs(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows [start, stop) of words."""
    inside = sums.take(stop - 1, axis=1)
    inside -= sums.take(start, axis=1)
    return np.ascontiguousarray(np.packbits(inside > 0, axis=0).T).view(np.uint64).ravel()


class Index:
    """Fingerprints of one block of items by length class, with the tables of their Hamming blocks."""

    def __init__(self, items: list[tuple[int, str]], total: int | None = None, shared: dict[bytes, int] | None = None, width: int = 5, spread: float = 1.2):
        """`total` and `shared`: the items with a word and the frequencies of shingles of several items in the whole
        benchmark; counted from `items` where these are all of it."""
        self.width = width
        self.items = [(i, w) for i, t in items if (w := _folded(t or ""))]
        if total is None or shared is None:
            total, shared = len(self.items), Counter(b" ".join(s) for _, w in self.items for s in set(_shingles(w, width)))
        self.unknown = math.log(1 + total)
        self.weights = {s: math.log(1 + total / n) for _, w in self.items for s in _shingles(w, width) if (n := shared.get(b" ".join(s), 1)) > 1}
        self.sets = [frozenset(_shingles(w, width)) for _, w in self.items]
        masks = [sum(1 << b for b in c) for r in range(RADIUS // _BLOCKS + 1) for c in combinations(range(_BLOCK_BITS), r)]
        near = np.array(masks, np.uint16)
        lengths = sorted({len(w) for _, w in self.items})
        self.classes = []
        while lengths:
            group = [n for n in lengths if n <= lengths[0] * spread]
            lengths = lengths[len(group) :]
            size = max(1, round((group[0] + group[-1]) / 2))
            own = np.array([k for k, (_, w) in enumerate(self.items) if len(w) in set(group)])
            prints = []
            for k in own:
                words, _ = word_hashes([b" ".join(self.items[k][1]).decode("utf-8", "surrogatepass")])
                prints.append(_signs(_sums(words, _near(size)), np.array([0]), np.array([len(words)]))[0])
            prints = np.array(prints, np.uint64)
            tables = []
            for b in range(_BLOCKS):
                values = ((prints >> np.uint64(b * _BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.uint16)
                slot = (values[:, None] ^ near[None, :]).ravel()
                order = np.argsort(slot, kind="stable")
                offsets = np.searchsorted(slot[order], np.arange((1 << _BLOCK_BITS) + 1)).astype(np.int32)
                tables.append((offsets, np.repeat(np.arange(len(own), dtype=np.int32), len(near))[order]))
            self.classes.append((size, own, prints, tables))

    def candidates(self, words: np.ndarray, counts: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """For each text (by place) the (item, window start) within the Hamming radius."""
        out: dict[int, set[tuple[int, int]]] = {}
        if len(words) < 1:
            return out
        text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        first = np.cumsum(counts) - counts
        sums, held = None, 0
        for size, own, prints, tables in self.classes:  # from short to long: sums of one kind are held at a time
            if held != _near(size):
                held = _near(size)
                sums = _sums(words, held, text)
            step = max(1, size // 6)
            some = np.flatnonzero(counts >= max(1, size // 2))
            n = counts[some]
            room = np.maximum(n - size, 0)
            steps = -(-room // step) + 1  # the last window ends with the text
            doc = np.repeat(some, steps)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps)
            start = np.minimum(at * step, np.repeat(room, steps))
            begin = first[doc] + start
            prints_of = _signs(sums, begin, np.minimum(begin + size, first[doc] + counts[doc]))
            for b, (offsets, entries) in enumerate(tables):
                value = ((prints_of >> np.uint64(b * _BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
                low = offsets[value]
                many = offsets[value + 1] - low
                window = np.repeat(np.arange(len(value)), many)
                entry = entries[np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
                close = np.bitwise_count(prints_of[window] ^ prints[entry]) <= RADIUS
                for d, k, s in zip(doc[window[close]].tolist(), own[entry[close]].tolist(), start[window[close]].tolist(), strict=True):
                    out.setdefault(d, set()).add((k, s))
        return out

    def similarity(self, window: list[tuple], item: int) -> float:
        mine, theirs = set(window), self.sets[item]
        get = self.weights.get
        shared = sum(get(s, self.unknown) for s in mine & theirs)
        return shared / (sum(get(s, self.unknown) for s in theirs) + len(mine - theirs) * self.unknown) if shared else 0.0

    def verify(self, text: str, found: set[tuple[int, int]], threshold: float) -> list[tuple[int, int, int, float]]:
        """(item id, start, words, similarity) of the best window of each item near its candidates. The windows of one
        stretch of starts slide: a step takes one shingle out and one in."""
        words = _folded(text)
        shingles = _shingles(words, self.width)
        near: dict[int, list[tuple[int, int]]] = {}
        for k, at in sorted(found):
            length = len(self.items[k][1])
            if not self.sets[k].isdisjoint(shingles[max(0, at - length) : at + 2 * length]):
                low, high = max(0, at - length // 2), min(max(0, len(words) - length), at + length // 2) + 1
                runs = near.setdefault(k, [])
                if runs and low <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
                elif low < high:
                    runs.append((low, high))
        best = [(self.items[k], *b) for k, runs in sorted(near.items()) if (b := self._best(k, words, shingles, runs))[1] >= threshold]
        return [(item, p, min(len(own), len(words) - p), s) for (item, own), p, s in best]

    def _best(self, k: int, words: list[bytes], shingles: list[tuple], runs: list[tuple[int, int]]) -> tuple[int, float]:
        """(start, similarity) of the best window of the item with a start in one of the runs; the first of equals."""
        length, theirs, get = len(self.items[k][1]), self.sets[k], self.weights.get
        exact = lambda w: round(w * (1 << 40))  # noqa: E731  whole numbers, so that sliding adds no rounding
        unknown = exact(self.unknown)
        all_theirs = sum(exact(get(s, self.unknown)) for s in theirs)
        best = (0, 0.0)
        for low, high in runs:
            if length < self.width:
                for p in range(low, high):
                    s = self.similarity([tuple(words[p : p + length])], k)
                    best = (p, s) if s > best[1] else best
                continue
            size = length - self.width + 1
            inside: Counter = Counter()
            shared = foreign = 0
            for end in range(low, min(high - 1 + size, len(shingles))):
                new = shingles[end]
                inside[new] += 1
                if inside[new] == 1:
                    shared, foreign = (shared + exact(get(new, self.unknown)), foreign) if new in theirs else (shared, foreign + unknown)
                if end - low >= size:
                    old = shingles[end - size]
                    inside[old] -= 1
                    if not inside[old]:
                        shared, foreign = (shared - exact(get(old, self.unknown)), foreign) if old in theirs else (shared, foreign - unknown)
                p = max(low, end - size + 1)
                if end - low >= size - 1 or end == len(shingles) - 1:
                    s = shared / (all_theirs + foreign) if shared else 0.0
                    best = (p, s) if s > best[1] else best
        return best


def _item_shingles(rows: DataFrame, width: int) -> DataFrame:
    """(shingle): the distinct shingles of each item (i, t), as their words with blanks between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = [b" ".join(s) for t in batch.column("t").to_pylist() if (w := _folded(t)) for s in set(_shingles(w, width))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["shingle"])

    return in_batches(rows, run, "shingle binary")


def indexes(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", width: int = 5, block_items: int = 5_000, block_bytes: int = 4 << 20) -> Iterator[Index]:
    """An index for each block of about `block_items` items and `block_bytes` of text, so that none grows with the benchmark."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"[^ \t-\r]"))
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(-(-total // block_items), -(-size // block_bytes))
    if blocks > 1:
        times = cut(_item_shingles(rows, width).groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else rows
        block = sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if blocks == 1:
            yield Index(block, width=width)
        else:
            own = times.join(_item_shingles(part, width).distinct(), "shingle", "left_semi").collect()
            yield Index(block, total, {bytes(r["shingle"]): r["times"] for r in own}, width=width)


def with_matches(docs: DataFrame, index: Index, *, text_col: str = "text", threshold: float = 0.75, drop_text: bool = False) -> DataFrame:
    """The rows with `matches`: the items of one block that the text contains."""
    rows = docs.drop("matches")
    kept = [f for f in rows.schema if not (drop_text and f.name == text_col)]
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in slices(batches, text_col, 500_000):
            texts = batch.column(text_col).to_pylist()
            found = ix.candidates(*word_hashes(texts))
            matches = [[] for _ in texts]
            for d, some in found.items():
                matches[d] = [dict(item_id=i, start=p, n_words=n, similarity=s) for i, p, n, s in ix.verify(texts[d], some, threshold)]
            columns = [batch.column(f.name) for f in kept] + [pa.array(matches, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["matches"])

    declared = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"matches {_MATCHES}"]
    return in_batches(rows, run, ", ".join(declared))


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, **blocks: int) -> DataFrame:
    """(id, item_id, start, n_words, similarity): each item that a document contains, at its best window."""
    parts = [
        with_matches(docs.select(id_col, text_col), index, text_col=text_col, threshold=threshold, drop_text=True).select(id_col, F.inline("matches"))
        for index in indexes(items, **blocks)
    ]
    if not parts:
        return docs.select(id_col, F.inline(F.array().cast(_MATCHES))).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", threshold: float = 0.75, **blocks: int) -> DataFrame:
    """The documents that contain no item, with their columns."""
    out, back = set_aside(docs, ["matches"])
    for index in indexes(items, **blocks):
        out = with_matches(out, index, text_col=text_col, threshold=threshold).where(F.size("matches") == 0).drop("matches")
    return back(out)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
