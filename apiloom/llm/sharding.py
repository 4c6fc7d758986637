"""Sharding by a histogram sort: exact byte counts below probes choose the splitters, then rows move once.

Rows are ordered by (hash of the text, hash of the id, number of the row), so equal texts are neighbours. Each round
counts, over all rows, the exact bytes in the sub-intervals of the few key intervals that still hold an unsettled
splitter; the driver sees only those counts. A splitter is settled when a boundary lies within the tolerance of its
target. Equal texts stay in one shard unless their bytes exceed `keep_together` of a shard; such a group is cut between
its rows, so a hot group spreads evenly, also where ids repeat or are null.

Defined results: a null text has size 1, CRC 0 and sorts as one group; a null id is an id of its own; repeated rows (same
id and text) get slots of their own and may be cut apart like other rows of their group; an empty table gives an empty
result; other columns are carried along untouched, columns named `shard` or `slot` as `own_shard` and `own_slot`
(internal columns are named `__*`).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apiloom.llm.common import cut, documents

LOW, HIGH = -(2**63), 2**63 - 1
_BITS = 12


def _settle(targets: list[int], cells: list[tuple], below: int, tolerance: list[float]) -> tuple[dict, dict]:
    """Place targets among ordered cells (start, end, bytes, key). Returns settled starts and targets left in a cell."""
    done: dict[int, object] = {}
    left: dict[int, tuple] = {}
    at = 0
    for t in sorted(targets):
        while at < len(cells) - 1 and below + cells[at][2] < t:
            below += cells[at][2]
            at += 1
        start, end, inside, key = cells[at]
        if abs(t - below) <= tolerance[0] or abs(below + inside - t) <= tolerance[0]:
            done[t] = start if abs(t - below) <= abs(below + inside - t) else end
        else:
            left[t] = (key, below, inside)
    return done, left


def histogram_splitters(keys: DataFrame, targets: list[int], tolerance: float, group_tolerance: float) -> list[tuple[int, int]]:
    """Splitters (hash, id) so that the bytes of the keys below the i-th are near `targets[i]`.

    `keys` has `__hi`, `__lo` and `__size`. The first round resolves so many bits of the hash that each target has eight
    cells (12 bits at least), the next ones 12 more bits each, only where an unsettled splitter lies; inside one hash
    value heavier than `group_tolerance` bytes the range of `__lo` is cut likewise.
    """
    found: dict[int, tuple[int, int]] = {}
    # (parent cell or None, bytes below it, targets inside it)
    open_cells: dict[int | None, tuple[int, list[int]]] = {None: (0, sorted(set(targets)))}
    hot: dict[int, tuple[int, int, list[int]]] = {}
    shift = 64
    while open_cells and shift > 0:
        bits = max(_BITS, (8 * len(targets)).bit_length()) if shift == 64 else _BITS
        parent_shift, shift = shift, max(0, shift - bits)
        cell = F.shiftright("__hi", shift)
        rows = keys
        if parent_shift < 64:
            rows = keys.where(F.shiftright("__hi", parent_shift).isin([int(p) for p in open_cells]))
        counted = rows.groupBy(cell.alias("cell")).agg(F.sum("__size").alias("bytes")).collect()
        following: dict[int | None, tuple[int, list[int]]] = {}
        for parent, (below, wanted) in open_cells.items():
            inside = sorted((r["cell"], r["bytes"]) for r in counted if parent is None or r["cell"] >> (parent_shift - shift) == parent)
            if not inside:
                continue
            cells = [((c << shift, LOW), ((c + 1) << shift, LOW), b, c) for c, b in inside]
            done, left = _settle(wanted, cells, below, [tolerance])
            found |= done
            for t, (c, base, weight) in left.items():
                if shift:
                    following.setdefault(c, (base, []))[1].append(t)
                elif weight <= group_tolerance:
                    found[t] = (c, LOW) if t - base <= base + weight - t else (c + 1, LOW)
                else:
                    hot.setdefault(c, (base, weight, []))[2].append(t)
        open_cells = following
    for value, (below, _, wanted) in hot.items():
        found |= _split_group(keys.where(F.col("__hi") == F.lit(value)), value, below, wanted, tolerance)
    return [tuple(min(HIGH, x) for x in found.get(t, (HIGH, HIGH))) for t in targets]


def _split_group(rows: DataFrame, value: int, below: int, targets: list[int], tolerance: float) -> dict:
    """Splitters inside one hash value: equal-width probes over the ids, refined where a target lies."""
    found: dict[int, tuple[int, int]] = {}
    low, high = rows.agg(F.min("__lo"), F.max("__lo")).first()
    work = [(low, high, below, targets)]
    while work:
        low, high, below, wanted = work.pop()
        width = max(1, -(-(high - low + 1) // (1 << _BITS)))
        inside = rows.where(F.col("__lo").between(low, high))
        place = F.floor((F.col("__lo").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
        counted = sorted((r[0], r[1]) for r in inside.groupBy(place.alias("cell")).agg(F.sum("__size")).collect())
        cells = [((value, low + c * width), (value, min(high, low + c * width + width - 1) + 1), b, c) for c, b in counted]
        done, left = _settle(wanted, cells, below, [tolerance])
        found |= done
        refine: dict[int, tuple[int, list[int]]] = {}
        for t, (c, base, weight) in left.items():
            if width == 1:
                found[t] = (value, low + c) if t - base <= base + weight - t else (value, low + c + 1)
            else:
                refine.setdefault(c, (base, []))[1].append(t)
        work += [(low + c * width, min(high, low + c * width + width - 1), base, ts) for c, (base, ts) in refine.items()]
    return found


def _at_or_after(splitter: tuple[int, int]) -> Column:
    hi, lo = splitter
    return (F.col("__hi") > F.lit(hi)) | ((F.col("__hi") == F.lit(hi)) & (F.col("__lo") >= F.lit(lo)))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small frame from one JSON literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{schema}>>"))))


def _ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds `__range`, the number of splitters at or below the key: those of lower cells of the hash are counted ahead,
    and only the few of the row's own cell are compared."""
    inside: dict[int, list[dict]] = {}
    for h, x in sorted(splitters):
        inside.setdefault(h >> (64 - _BITS), []).append({"h": h, "x": x})
    cells, before = [], 0
    for c in range(-(1 << (_BITS - 1)), 1 << (_BITS - 1)):
        cells.append({"__cell": c, "before": before, "inside": inside.get(c, [])})
        before += len(inside.get(c, []))
    cells = _table(rows.sparkSession, cells, "__cell:long,before:int,inside:array<struct<h:long,x:long>>")
    met = rows.withColumn("__cell", F.shiftright("__hi", 64 - _BITS)).join(F.broadcast(cells), "__cell")
    passed = F.filter("inside", lambda p: (p["h"] < F.col("__hi")) | ((p["h"] == F.col("__hi")) & (p["x"] <= F.col("__lo"))))
    return met.withColumn("__range", F.col("before") + F.size(passed)).drop("__cell", "before", "inside")


def shard_by_bytes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: Column | None = None,
    group: Column | None = None,
    shards: int = 8,
    tolerance: float = 0.001,
    keep_together: float = 0.02,
    range_bytes: int = 16 << 20,
    most_ranges: int = 1 << 16,
) -> DataFrame:
    """Add `shard` (near-equal bytes) and `slot` (gapless from 0, in key order) to every row.

    Shards are made of consecutive key ranges of about `range_bytes` (of more bytes where these would be over
    `most_ranges`), which are the units of the single exchange: a slot is a rank in its range plus the rows of the
    ranges before it. `size` is the weight of a row (default UTF-8 bytes of the text plus 1) and `group` a long that
    equal texts share (default a hash). The keyed rows are written once to the checkpoint folder, so that the row
    numbers in the keys do not change; give it digests where texts need not move.
    """
    spark = docs.sparkSession
    number = (1 << 20) - 1
    rows = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c.lower() in ("shard", "slot")})
    rows = cut(
        rows.withColumns(
            {
                "__size": (size if size is not None else F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long"),
                "__hi": group if group is not None else F.xxhash64(text_col),
                "__lo": F.xxhash64(id_col).bitwiseAND(F.lit(~number)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(number))),
            }
        )
    )
    total = rows.agg(F.sum("__size")).first()[0] or 0
    per_shard = max(1, min(most_ranges // shards, total // (shards * range_bytes)))
    ideal = total / shards
    coarse = [round(i * ideal) for i in range(1, shards)]
    fine = [round((s + j / per_shard) * ideal) for s in range(shards) for j in range(1, per_shard)]
    keys = rows.select("__hi", "__lo", "__size")
    splitters = dict(zip(coarse, histogram_splitters(keys, coarse, tolerance * ideal, keep_together * ideal), strict=True)) if total else {}
    inner = histogram_splitters(keys, fine, 0.2 * ideal / per_shard, ideal / per_shard) if fine and total else []

    shard = sum((_at_or_after(splitters[t]).cast("int") for t in coarse if t in splitters), F.lit(0))
    rows = rows.withColumn("shard", shard.cast("int"))
    rows = _ranges(rows, inner) if inner else rows.withColumn("__range", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__hi", "__lo", "__size")) - 1
    if inner:
        offsets, held = [], {}
        for s, r, n in sorted(map(tuple, rows.groupBy("shard", "__range").count().collect())):  # at most ranges + shards rows
            offsets.append({"shard": s, "__range": r, "__before": held.get(s, 0)})
            held[s] = held.get(s, 0) + n
        ahead = _table(spark, offsets, "shard:int,__range:int,__before:long")
        rows = rows.withColumn("slot", rank).join(F.broadcast(ahead), ["shard", "__range"]).withColumn("slot", F.col("slot") + F.col("__before"))
    else:
        rows = rows.withColumn("slot", rank)
    carried = [c for c in rows.columns if c not in ("shard", "slot", "__range", "__hi", "__lo", "__size", "__before")]
    return rows.select(*carried, "shard", F.col("slot").cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near-equal bytes. The texts are read once; only digests are kept."""
    docs = documents(spark, sf_dir)
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    out = shard_by_bytes(digest, size=F.col("size"), group=F.col("text_hash"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
