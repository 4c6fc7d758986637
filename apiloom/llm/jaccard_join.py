"""N-gram Jaccard join with prefix filters under several global token orders.

A text's set holds its distinct five-word shingles as 64-bit hashes. Two sets of similarity t share a token among the
first n - ceil(t n) + 1 tokens of each, under any order of all tokens. Three orders are used: A (estimated frequency,
then hash), B (estimated frequency, then another hash) and the reverse of B. Candidates must share prefix tokens under
all three; only those are compared exactly.

1. One pass over the texts gives each row's set hash (`node`: rows with equal sets are one node), a parity sketch of the
   set (one to two bits a shingle; the bits in which two sketches differ are at most the shingles in which the sets do),
   and the tokens that several sets of a slice share: the counts, added up over all slices, put frequent tokens last in
   A and B, so that passages and boilerplate leave the prefixes. Only the order depends on the estimate.
2. A second pass explodes the A-prefix of each distinct set (copies inside a task are dropped before the shuffle). Each
   entry carries its `reach`, the largest set that its place in the prefix still allows as a partner: from a shared
   token at place i on, n - i tokens are left, and 3/7 of both sizes must be common. A pair is possible in a list (the
   nodes of one token, or of several tokens with the same nodes) only if each set is within the other's reach and both
   prefixes hold enough tokens that others have. Tokens that one set has are dropped by a window; frequent tokens are
   dealt out by (token, part), so that none fills a task.
3. Lists of two nodes are pairs, if enough tokens of both prefixes can be common. In longer lists each node first meets one partner: of the cleanest members of its lists (the longest reach for their size) the one
   in most of its lists. Then the pairs of lists of two are tested where they are not connected, and, while a list spans several components, members outside its largest component meet all
   members of other components, up to `waiting` of them in a round, twice as many in the next. Reach and prefix tokens
   are conditions of these joins, so a pair that cannot be similar is no row. Pairs inside one component are not needed. A
   linked pair shares a list within reach, so it is tested or connected already: no link is lost.
4. Candidates whose sketches differ in more than 1/7 of both sizes go. The nodes of the others get a row with their B- and reverse-B-prefix and their tokens, from one text each. Candidates
   are joined with both prefixes first, the survivors with both token arrays; no text moves.

Defined results: a text with fewer words than a shingle has its whole sequence as one; null, empty and blank texts have
an empty set and stand alone; repeated rows and equal sets are linked; a component is named by its smallest id (null
when all ids are null); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apiloom.llm.common import cut, discard, documents, in_batches, slices, written
from apiloom.llm.components import components
from apiloom.llm.shingles import mix, shingle_sets, word_hashes

#: Similarity as a fraction of whole numbers: 3/4.
NUMERATOR, DENOMINATOR = 3, 4
#: A token seen so often in the estimate is dealt out in so many parts.
FREQUENT, PARTS = 256, 64


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many tokens of a set of n must be looked at: n - ceil(3n/4) + 1."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def _nodes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set, and its size."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        out[some] = np.add.reduceat(mix(np.concatenate([sets[i] for i in some]) ^ np.uint64(0xA0761D6478BD642F)), first)
    return mix(out + sizes.astype(np.uint64)).view(np.int64), sizes


def _sketches(sets: list[np.ndarray]) -> pa.ListArray:
    """The parity sketch of each set: the least power of two words of 64 bits that gives a bit a shingle."""
    sizes = np.array([len(s) for s in sets], np.int64)
    words = np.array([1 << max(0, int(n - 1).bit_length() - 6) for n in sizes], np.int64)
    first = np.concatenate([[0], np.cumsum(words)])
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    place = np.repeat(first[:-1] * 64, sizes) + (tokens & np.repeat((words * 64 - 1).astype(np.uint64), sizes)).astype(np.int64)
    bits = (np.bincount(place, minlength=int(first[-1]) * 64) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.packbits(bits, bitorder="little").view(np.int64)))


def _differing(x: str, y: str) -> Column:
    """Bits in which two sketches differ; one that is twice as long is folded first."""
    fold = lambda c: f"zip_with(slice({c}, 1, size({c}) div 2), slice({c}, size({c}) div 2 + 1, size({c}) div 2), (u, v) -> u ^ v)"
    count = lambda c, d: f"aggregate(zip_with({c}, {d}, (u, v) -> bit_count(u ^ v)), 0, (total, k) -> total + k)"
    return F.expr(f"case when size({x}) = size({y}) then {count(x, y)} when size({x}) > size({y}) then {count(fold(x), y)} else {count(x, fold(y))} end")


def _sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "__text", 1_500_000):
        yield batch, shingle_sets(*word_hashes(batch.column("__text").to_pylist()), width)


def _sized(rows: DataFrame, width: int, held_tokens: int = 2_000_000) -> DataFrame:
    """Rows (id, print, node, n, sketch) of all texts, and rows (token, times) of the tokens that sets of one slice share."""
    schema = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64())), ("token", pa.int64()), ("times", pa.int64())])

    def shared(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, times = np.unique(np.concatenate(sets), return_counts=True)
        token, times = token[times > 1].view(np.int64), times[times > 1]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(token), pa.list_(pa.int64())), pa.array(token), pa.array(times)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        count = 0
        for batch, sets in _sets_of(batches, width):
            node, n = _nodes(sets)
            none = pa.nulls(len(node), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), pa.array(node), pa.array(n), _sketches(sets), none, none], schema=schema)
            for s, x in zip(sets, node.tolist(), strict=True):
                if len(s) and x not in seen:
                    seen.add(x)
                    held.append(s)
                    count += len(s)
            if count > held_tokens:
                yield shared(held)
                held, count = [], 0
        if held:
            yield shared(held)

    return in_batches(rows, run, "id long, print long, node long, n long, sketch array<long>, token long, times long")


def with_node(docs: DataFrame, node: str, n: str, *, text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows with the hash of each text's set and the size of the set."""
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1_500_000):
            found, sizes = _nodes(shingle_sets(*word_hashes(batch.column(text_col).to_pylist()), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(sizes)], names=[*batch.schema.names, node, n])

    return in_batches(docs, run, f"{declared}, `{node}` long, `{n}` long")


class Frequencies:
    """Estimated frequencies of the most frequent tokens (a bounded table); all other tokens count as rare."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray):
        order = np.argsort(tokens.view(np.uint64))
        self.tokens, self.times = tokens.view(np.uint64)[order], times[order]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.times[at], 0)


def frequencies(sized: DataFrame, top: int = 200_000) -> Frequencies:
    """The tokens above the lowest count that at most `top` tokens exceed: only a histogram of the counts and those
    tokens reach the driver."""
    counted = cut(sized.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")))
    least, held = 0, 0
    for times, tokens in sorted(counted.groupBy("times").count().collect(), reverse=True):
        if held + tokens > top:
            least = times
            break
        held += tokens
    got = counted.where(F.col("times") > least).toPandas()
    return Frequencies(got["token"].to_numpy(np.int64), got["times"].to_numpy(np.int64))


def _prefix_entries(rows: DataFrame, freq, width: int) -> DataFrame:
    """(token, node, n, reach, part) for the A-prefix of each distinct set of a task; part is null for tokens that are not frequent."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets_of(batches, width):
            node, n = _nodes(sets)
            keep = []
            for i, x in enumerate(node.tolist()):
                if n[i] and x not in seen:
                    seen.add(x)
                    keep.append(i)
            if not keep:
                continue
            kept = [sets[i] for i in keep]
            times = freq.value.of(np.concatenate(kept))
            at, prefixes, rare = 0, [], []
            for s in kept:
                f = times[at : at + len(s)]
                at += len(s)
                rare.append(int((f < FREQUENT).sum()))
                s = s[np.argsort(f, kind="stable")] if f.any() else s
                prefixes.append(s[: prefix_length(len(s))].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(n[keep].astype(np.int32)), pa.array(rare, pa.int32()), lists], schema=schema)

    out = in_batches(rows, run, "node long, n int, rare int, tokens array<long>")
    out = out.select("node", "n", "rare", F.posexplode("tokens").alias("place", "token"))
    part = F.when(F.col("place") >= F.col("rare"), F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    return out.select("token", "node", "n", F.expr("cast((4 * n - 7 * place) div 3 as int)").alias("reach"), part.alias("part"))


#: Tokens that the prefixes of two linked sets have in common at least.
_COMMON = "(3 * ({a}n + {b}n) + 6) div 7 - (3 * greatest({a}n, {b}n) + 3) div 4 + 1"


def _lists(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list, node, n, reach, met): the members of each shared token that may have a partner there; tokens with the same
    members are one list (frequent tokens keep a list each). And (a, b): the possible pairs of lists of two.

    Of the tokens that a linked pair must share, ceil(3(n + m)/7) - ceil(3 max(n, m)/4) + 1 or more lie in both prefixes.
    `met` is how many prefix tokens of a node others have too. A list of two knows how many tokens its nodes share alone;
    they share no more others than the smaller of the numbers of prefix tokens that each has in longer lists.
    """
    token = Window.partitionBy("token", "part")
    members = entries.select(
        "token",
        "node",
        "n",
        "reach",
        "part",
        F.min("node").over(token).alias("low"),
        F.max("node").over(token).alias("high"),
        F.count("*").over(token).alias("many"),
        F.bit_xor(F.xxhash64("node")).over(token).alias("sign"),
    ).where("low < high or part is not null")
    one = F.when(F.col("part").isNull(), F.xxhash64("low", "high", "many", "sign")).otherwise(F.col("token"))
    members = members.select(one.alias("list"), "node", "n", "reach").groupBy("list", "node").agg(F.first("n").alias("n"), F.max("reach").alias("reach"), F.count("*").alias("tokens"))
    members = cut(members)
    one = F.struct("node", "n", "reach")
    size = members.groupBy("list").agg(F.min("n").alias("least"), F.max("reach").alias("furthest"), F.count("*").alias("many"), F.max("tokens").alias("tokens"), F.min(one).alias("x"), F.max(one).alias("y"))
    size = cut(size.where("many > 1"))
    counted = members.join(size.select("list", "least", "furthest", F.col("many").alias("all")), "list")
    met = cut(counted.groupBy("node").agg(F.sum("tokens").alias("met"), F.sum(F.when(F.col("all") > 2, F.col("tokens")).otherwise(0)).alias("more")))
    twos = size.where("many = 2").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("a_n"), F.col("y.n").alias("b_n"), "tokens", F.expr("x.n <= y.reach and y.n <= x.reach").alias("within"))
    # a pair has one list of two, and one more for each frequent token that only its nodes have in their prefixes
    twos = twos.groupBy("a", "b", "a_n", "b_n").agg(F.sum("tokens").alias("tokens"), F.bool_or("within").alias("within")).where("within")
    for side in ("a", "b"):
        twos = twos.join(met.select(F.col("node").alias(side), F.col("more").alias(f"{side}_more")), side)
    twos = twos.where(F.col("tokens") + F.least("a_more", "b_more") >= F.expr(_COMMON.format(a="a_", b="b_"))).select("a", "b")
    longer = counted.where("all > 2 and n <= furthest and least <= reach").select("list", "node", "n", "reach")
    return cut(longer.join(met.select("node", "met"), "node")), cut(twos)


def _node_table(docs: DataFrame, reps: DataFrame, wanted: DataFrame, freq, width: int, broadcast_nodes: int) -> DataFrame:
    """(node, n, early, late, tokens) of each wanted node, from one of its texts: B-prefix and reverse-B-prefix (the low
    half of each token) and the set. A text is found by its id and its hash, so rows of one id, or of none, meet only the
    node that they stand for."""
    few = wanted.limit(broadcast_nodes + 1).count() <= broadcast_nodes
    chosen = reps.join(wanted, "node", "left_semi").select("node", F.col("id").alias("rep"), F.col("print").alias("own"))
    same = (F.col("print") == F.col("own")) & F.col("id").eqNullSafe(F.col("rep"))
    rows = docs.join(F.broadcast(chosen) if few else chosen, same).select("node", "__text")
    low = lambda x: x.astype(np.uint32).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, sets in _sets_of(batches, width):
            out: list[tuple] = []
            for x, want, s in zip(_nodes(sets)[0].tolist(), batch.column("node").to_pylist(), sets, strict=True):
                if x == want and x not in seen:
                    seen.add(x)
                    b, p = _order_b(s, freq.value), prefix_length(len(s))
                    out.append((x, len(s), low(b[:p]), low(b[-p:]), s.view(np.int64)))
            if out:
                node, n, early, late, tokens = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(early, pa.list_(pa.int32())), pa.array(late, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "n", "early", "late", "tokens"])

    return in_batches(rows, run, "node long, n int, early array<int>, late array<int>, tokens array<long>").dropDuplicates(["node"])


def _order_b(tokens: np.ndarray, freq: Frequencies) -> np.ndarray:
    return tokens[np.lexsort((mix(tokens ^ np.uint64(0x8EBC6AF09C88C6E3)), freq.of(tokens)))]


def _both(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """The pairs with these columns of both ends, prefixed a_ and b_."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs


def _links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under B and under its reverse, and are similar."""
    near = _both(pairs, nodes, "early", "late").where(F.arrays_overlap("a_early", "b_early") & F.arrays_overlap("a_late", "b_late")).select("a", "b")
    full = _both(near, nodes, "n", "tokens").select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), F.size(F.array_intersect("a_tokens", "b_tokens")).alias("shared"))
    return full.where(DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("n") - F.col("shared"))).select("a", "b")


def _possible(node: str, other: str) -> Column:
    """Whether two members of a list are within each other's reach, and share enough of both prefixes if at all."""
    return F.expr(f"{node}n <= {other}reach and {other}n <= {node}reach and least({node}met, {other}met) >= {_COMMON.format(a=node, b=other)}")


def _close(pairs: DataFrame, reps: DataFrame, broadcast_nodes: int) -> DataFrame:
    """The pairs whose sketches differ in no more bits than linked sets do in shingles."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    few = ends.limit(broadcast_nodes + 1).count() <= broadcast_nodes
    held = reps.join(F.broadcast(ends) if few else ends, "node", "left_semi")
    return _both(pairs, held, "n", "sketch").where(7 * _differing("a_sketch", "b_sketch") <= F.col("a_n") + F.col("b_n")).select("a", "b")


def _ordered(node: str, partner: str) -> tuple[Column, Column]:
    return F.least(node, partner).alias("a"), F.greatest(node, partner).alias("b")


def _first_pairs(lists: DataFrame) -> DataFrame:
    """One pair for each node: with the clean member that it meets in most of its lists."""
    clean = F.max_by(F.struct("node", "n", "reach", "met"), F.struct(F.col("reach") / F.col("n"), F.col("node"))).alias("p")
    best = lists.groupBy("list").agg(clean).select("list", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "n", "reach", "met")))
    met = lists.join(best, "list").where(F.col("node") != F.col("p_node")).where(_possible("", "p_"))
    often = met.groupBy("node", F.col("p_node").alias("partner")).agg(F.count("*").alias("times"))
    best = often.groupBy("node").agg(F.max_by("partner", F.struct("times", "partner")).alias("partner"))
    return best.select(*_ordered("node", "partner")).distinct()


def _next_pairs(lists: DataFrame, comp: DataFrame, waiting: int) -> tuple[DataFrame, DataFrame]:
    """Pairs across components, and what is left of the lists that span several (rows without a component are their own)."""
    rows = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = rows.groupBy("list", "comp").agg(F.count("*").alias("many"))
    largest = sizes.groupBy("list").agg(F.max_by("comp", F.struct("many", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    rows = cut(rows.join(largest.drop("comps"), "list"))
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.xxhash64("node"), "node"))
    chosen = cut(rows.where("comp != largest").withColumn("rank", rank).where(F.col("rank") <= waiting).select("list", "node", "n", "reach", "met", "comp"))
    other = chosen.select("list", *(F.col(c).alias(f"p_{c}") for c in ("node", "n", "reach", "met", "comp")))
    met = rows.join(other, "list").where("comp != p_comp").where(_possible("", "p_"))
    pairs = met.select(*_ordered("node", "p_node")).distinct()
    left = rows.join(chosen.select("list", "node"), ["list", "node"], "left_anti")
    return pairs, left.select("list", "node", "n", "reach", "met")


def _across(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components."""
    if comp is None:
        return pairs
    for side in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}")), side, "left")
    return pairs.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")


def _merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after more links."""
    if comp is None:
        return components(links)
    own = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    lifted = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    step = components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    step = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    comp = comp.unionByName(ends.join(comp, "node", "left_anti").select("node", F.col("node").alias("comp")))
    return cut(comp.join(step, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, broadcast_nodes: int = 200_000, waiting: int = 1000, keep_node: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the connected parts of all pairs of similarity 3/4 or more.

    With `keep_node` also `node`, the hash of the row's set, and `component`, the smallest such hash of its part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.select("id", F.xxhash64("__text").alias("print"), "__text")
    sized = cut(_sized(rows, width))
    freq = spark.sparkContext.broadcast(frequencies(sized))
    every = sized.where("node is not null").select("id", "print", "node", "n", "sketch")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print")).alias("least")
    reps = every.where("n > 0").groupBy("node").agg(least, F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    reps = cut(reps.select("node", "least.id", "least.print", "n", "sketch"))
    lists, twos = _lists(_prefix_entries(rows, freq, width))

    pairs, comp, nodes = cut(_first_pairs(lists)), None, []
    while True:
        pairs = cut(_close(pairs, reps, broadcast_nodes))
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for known in nodes:
            wanted = wanted.join(known.select("node"), "node", "left_anti")
        if not (wanted := cut(wanted)).isEmpty():
            nodes.append(written(_node_table(rows, reps, wanted, freq, width, broadcast_nodes), "sets"))
        links = cut(_links(pairs, reduce(DataFrame.unionByName, nodes))) if nodes else pairs
        if not links.isEmpty():
            comp = _merged(comp, links)
        pairs, lists = _next_pairs(lists, comp if comp is not None else spark.createDataFrame([], "node long, comp long"), waiting)
        if twos is not None:
            pairs, twos = pairs.unionByName(_across(twos, comp)).distinct(), None
        pairs = cut(pairs)
        if pairs.isEmpty() and lists.isEmpty():
            break
        waiting *= 2
    for held in nodes:
        discard(held)

    own = F.coalesce("comp", "node").alias("component")
    placed = (reps.join(comp, "node", "left") if comp is not None else reps.withColumn("comp", F.lit(None).cast("long"))).select("node", "id", own)
    names = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = placed.join(names, "component").select("node", "component", "component_id")
    out = every.drop("sketch", "print").join(named, "node", "left")
    alone = F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    more = ["node", "component"] if keep_node else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"), *more)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard_components(documents(spark, sf_dir))
