"""Graph and tree jobs as iterative joins; each round is cut to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.operators.blocks import Blocks, contract_chains, contract_cycles, numbered
from apiloom.session import Scratch, cut

#: Nodes of a component in one list, where lists are opened to rows.
_LIST = 1000


def adjacency(edges: DataFrame) -> DataFrame:
    near = F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.5))).alias("s"), "dst")))
    return edges.groupBy("src").agg(F.transform(near, lambda x: x["dst"]).alias("neighbours"))


def find_paths(edges: DataFrame, start: str, end: str, *, max_depth: int = 5, top: int = 100) -> DataFrame:
    """Simple paths from start to end, best first: the sum of scores over length^1.2.

    Nodes carry their distance to the end (a backward sweep), so a path is only extended where the end is in reach. Once
    `top` paths are known, a path goes on only if the largest score on each further edge could still lift it to the last
    of them, at some length: no path of the result is lost, and long ways end early.
    """
    spark = edges.sparkSession
    e = cut(edges.where("src != dst").select("src", "dst", F.coalesce("score", F.lit(0.5)).alias("score")))
    most = e.agg(F.max("score")).first()[0] or 0.0
    front = reach = spark.range(1).select(F.lit(end).alias("node"), F.lit(0).alias("left"))
    for d in range(1, max_depth):
        step = e.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(reach, "node", "left_anti")
        front = cut(step.withColumn("left", F.lit(d)))
        reach = reach.unionByName(front)
    reach = cut(reach)
    paths = spark.range(1).select(F.array(F.lit(start)).alias("path"), F.lit(0.0).alias("total"), F.lit(start).alias("last"))
    found, least = None, None
    for d in range(1, max_depth + 1):
        grown = paths.join(e, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = grown.select(F.concat("path", F.array("dst")).alias("path"), (F.col("total") + F.col("score")).alias("total"), F.col("dst").alias("last"))
        near = grown.join(reach, grown["last"] == reach["node"]).where(F.col("left") <= max_depth - d)
        if least is not None:
            hope = F.greatest(*[(F.col("total") + (n - d) * most) / n**1.2 for n in range(d, max_depth + 1)], F.lit(0.0))
            near = near.where(hope >= least - 1e-9)
        near = cut(near.select("path", "total", "last"))
        done = near.where(F.col("last") == end).select("path", F.round(F.col("total") / d**1.2, 9).alias("score"))
        found = done if found is None else found.unionByName(done)
        best = found.orderBy(F.desc("score"), "path").limit(top)
        held = best.agg(F.count("*"), F.min("score")).first()
        least = held[1] if held[0] == top else None
        paths = near.where(F.col("last") != end)
    return found.orderBy(F.desc("score"), "path").limit(top)


def greedy_paths(entries: DataFrame, edges: DataFrame, *, least: int = 2, longest: int = 5) -> DataFrame:
    """From each entry follow the best edge to an unvisited node, up to `longest` nodes; paths of at least `least` stay."""
    e = cut(edges.select("src", "dst", "score"))
    open_paths = entries.select(F.array("node").alias("path"), F.col("node").alias("last"))
    done = None
    for n in range(1, longest + 1):
        if n == longest:
            ended = open_paths.select("path")
        else:
            step = open_paths.join(e, F.col("last") == F.col("src"), "left").withColumn("fresh", F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst")))
            best = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("fresh"), F.desc("score"), "dst"))
            step = cut(step.withColumn("r", best).where("r = 1"))
            ended = step.where("fresh IS NULL OR NOT fresh").select("path")
            open_paths = step.where("fresh").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        done = ended if done is None else done.unionByName(ended)
    return done.where(F.size("path") >= least)


def dedupe_paths(paths: DataFrame, limit: int | None = None) -> DataFrame:
    out = paths.withColumn("__r", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where("__r = 1").drop("__r")
    return out if limit is None else out.orderBy("ord").limit(limit)


def tree_roots(tree: DataFrame) -> DataFrame:
    return tree.where("parent_id IS NULL").select("agent_id")


def tree_leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent_id").alias("agent_id")).distinct(), "agent_id", "left_anti").select("agent_id")


def tree_paths(tree: DataFrame) -> DataFrame:
    """(agent_id, depth, path): the way from the root, however deep. Rows on parent cycles or under a missing parent are
    left out: no root reaches them, so the rounds end with the deepest row."""
    level = cut(tree.where("parent_id IS NULL").select("agent_id", F.lit(0).alias("depth"), F.array("agent_id").alias("path")))
    out, d = level, 0
    while True:
        d += 1
        parent = level.select(F.col("agent_id").alias("parent_id"), "path")
        level = cut(tree.join(parent, "parent_id").select("agent_id", F.lit(d).alias("depth"), F.concat("path", F.array("agent_id")).alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def closure(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair on a path, each node with itself at 0."""
    rows = paths.select(F.col("agent_id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return rows.select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def siblings(tree: DataFrame) -> DataFrame:
    """Each node with how many others have its parent. Counts are one aggregate, so a wide parent makes no pairs."""
    n = tree.where("parent_id IS NOT NULL").groupBy("parent_id").agg((F.count("*") - 1).alias("siblings"))
    return tree.join(n, "parent_id").select("agent_id", "siblings")


def influence(edges: DataFrame, root: str, *, threshold: float = 0.3, hops: int = 5) -> DataFrame:
    """Nodes reached from the root with the strongest product of weights, pruned below the threshold."""
    e = cut(edges.select("src", "dst", F.coalesce("weight", F.lit(0.5)).alias("w")))
    front = edges.sparkSession.createDataFrame([(root, 1.0)], "node string, strength double")
    best = front
    for _ in range(hops):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.round(F.col("strength") * F.col("w"), 12).alias("strength")).where(F.col("strength") >= threshold)
        step = step.groupBy("node").agg(F.max("strength").alias("strength"))
        better = step.join(best.withColumnRenamed("strength", "known"), "node", "left").where("known IS NULL OR strength > known").select("node", "strength")
        front = cut(better)
        best = cut(best.unionByName(front).groupBy("node").agg(F.max("strength").alias("strength")))
        if front.isEmpty():
            break
    return best


def reachable_from(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node): all nodes that each start (a column `node`) can reach, without itself unless by a cycle."""
    e = cut(edges.select("src", "dst").distinct())
    front = cut(starts.select(F.col("node").alias("start")).distinct().join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct())
    out = front
    while not front.isEmpty():
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(out, ["start", "node"], "left_anti"))
        out = cut(out.unionByName(front))
    return out


def spread_least(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, value) with each value carried along (src, dst) edges until every node has the least that reaches it."""
    front = label
    while not front.isEmpty():
        offer = edges.join(front.select(F.col("node").alias("src"), "value"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("value").alias("offer"))
        both = cut(label.join(offer, "node", "left"))
        front = both.where("offer < value").select("node", F.col("offer").alias("value"))
        label = both.select("node", F.least("value", F.coalesce("offer", "value")).alias("value"))
    return label


def scc(nodes: DataFrame, edges: DataFrame, **blocks: int) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Cycles inside ranges of names are contracted first, turn by turn, until one range holds all or little is gained. Of
    what is left, chains are contracted; nodes that no cycle reaches, or that reach none, are peeled off as components of
    their own. Of the others, each takes the least (hash, node) that reaches it, and those of one colour that reach its
    root are its component. Edges between colours go, and the rest follows under a new hash: a logarithmic number of turns
    on average. Peeling and colouring run block by block (`operators.blocks`). Rows stay linear in nodes and edges.
    """
    with Scratch(nodes.sparkSession) as keep:
        return cut(_components(nodes, edges, keep, **blocks)[0].select("node", "component"))


def _components(nodes: DataFrame, edges: DataFrame, keep: Scratch, **blocks: int) -> tuple[DataFrame, DataFrame]:
    """(node, root, component), and the (src, dst) edges between different roots; one root a component."""
    names = keep(nodes.select("node").distinct())
    plain = keep(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src != dst").distinct())
    turns, links, settled = contract_cycles(plain, keep, **{k: v for k, v in blocks.items() if k != "hub"})
    rooted = names.select("node", F.col("node").cast("string").alias("root"))
    for turn in turns:
        rooted = _renamed(rooted, turn, "root")
    rooted = keep(rooted)
    if not settled:
        found = keep(_coloured(rooted.select(F.col("root").alias("node")).distinct(), links, keep, **blocks))
        rooted = keep(_renamed(rooted, found, "root"))
        links = keep(_renamed(_renamed(links, found, "src"), found, "dst").where("src != dst").distinct())
    comp = rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "root", "component")
    return comp, links


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The rows with the root of a (node, root) table in place of the node in a column, where it has one."""
    new = names.select(F.col("node").alias(column), F.col("root").alias("__new"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*rows.columns)


def _coloured(text: DataFrame, plain: DataFrame, keep: Scratch, **blocks: int) -> DataFrame:
    """(node, root) of the nodes on cycles, each cycle's nodes with one root."""
    reduced, inner, cycles = contract_chains(plain, keep)
    on = Blocks(text.join(inner, "node", "left_anti").join(cycles, "node", "left_anti"), reduced, keep, **blocks)
    left, found, turn = on.placed(reduced), None, 0
    columns = left.columns
    while not left.isEmpty():
        for back in (False, True):
            way = _reversed(left) if back else left
            rest = on.peel(way).where("NOT peeled").select("node")
            left = keep(left.join(rest.withColumnRenamed("node", "src"), "src").join(rest.withColumnRenamed("node", "dst"), "dst").select(*columns))
        if left.isEmpty():
            break
        ends = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        start = F.concat(F.lpad(F.hex(F.xxhash64(F.lit(turn), "node")), 16, "0"), F.lit(":"), F.col("node"))
        colour = on.spread_least(ends.select("node", start.alias("value")), left)
        of = lambda side: colour.select(F.col("node").alias(side), F.col("value").alias(f"c{side}"))  # noqa: B023, E731
        same = keep(left.join(of("src"), "src").join(of("dst"), "dst").where("csrc = cdst").drop("csrc", "cdst"))
        root = F.substring("value", 18, 1 << 30)
        reached = on.spread_least(colour.select("node", F.when(root == F.col("node"), "0").otherwise("1").alias("value")), _reversed(same))
        part = keep(reached.where("value = '0'").select("node").join(colour, "node").select("node", root.alias("root")))
        found = part if found is None else keep(found.unionByName(part))
        gone = part.select("node")
        left = keep(same.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        turn += 1
    of = lambda side: on.nodes.select(F.col("node").alias(side), F.col("node").alias(f"r{side}")) if found is None else on.nodes.join(found, "node", "left").select(F.col("node").alias(side), F.coalesce("root", "node").alias(f"r{side}"))
    chained = inner.join(of("src"), "src").join(of("dst"), "dst").where("rsrc = rdst").select("node", F.col("rsrc").alias("root"))
    every = chained.unionByName(cycles.select("node", F.col("least").alias("root")))
    return every if found is None else every.unionByName(found)


def _reversed(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.col("bdst").alias("bsrc"), F.col("bsrc").alias("bdst"))


def topological_order(nodes: DataFrame, edges: DataFrame, **blocks: int) -> DataFrame:
    """(node, component, level, position): cycles collapsed; level is the longest way to a component; members by name.

    Chains of components become one weighted edge; the others are peeled block by block, and a level is the most of the
    weighted ways. Positions are ranks of sorted ranges, so no level meets in one task.
    """
    with Scratch(nodes.sparkSession) as keep:
        comp, links = _components(nodes, edges, keep, **blocks)
        comp = keep(comp)
        of = lambda s: comp.select(F.col("root").alias(s), F.col("component").cast("string").alias(f"c{s}")).distinct()
        dag = keep(links.join(of("src"), "src").join(of("dst"), "dst").select(F.col("csrc").alias("src"), F.col("cdst").alias("dst")))
        reduced, inner, _ = contract_chains(dag, keep)
        names = comp.select(F.col("component").cast("string").alias("node")).distinct()
        on = Blocks(names.join(inner, "node", "left_anti"), reduced, keep, **blocks)
        ends = keep(on.peel(on.placed(reduced)).select("node", "level"))
        within = inner.join(ends.withColumnRenamed("node", "src"), "src").select("node", (F.col("level") + F.col("place")).alias("level"))
        level = ends.unionByName(within).select(F.col("node").alias("__c"), F.col("level").cast("int").alias("level"))
        rows = comp.drop("root").join(level, F.col("component").cast("string") == F.col("__c")).drop("__c")
        return numbered(rows, "level", "component", "node").select("node", "component", "level", "position")


def expand_plan(steps: DataFrame, edges: DataFrame, order: DataFrame, *, every: bool = False, share: int = 1_000_000) -> DataFrame:
    """Each step of a plan with all nodes it can reach, every node once (the first step wins), renumbered within a plan.

    Steps move over components, not nodes, and a plan keeps only the least step of each component before it moves on, so
    what is held is the result by component, never a row for each step and each node it reaches. Numbers are differences
    of places in one sorted whole, so a long plan is no single task. In `order` the positions of a component follow each
    other (as `topological_order` gives them), so components are numbered by their sizes and opened to nodes last, in
    lists of a bounded length: the rows of the result are neither sorted nor written on the way. Few bytes of lists open to
    many rows, so the plans that open one list are dealt into shares of about `share` rows, and the tasks follow the rows.

    A step that adds nothing - its agent is not in the graph, or an earlier step has reached it - is left out, or with `every`
    stays in the plan as a row of its own, numbered after what its step adds, or last without a step number: then no step of
    a plan is lost.
    """
    with Scratch(steps.sparkSession) as keep:
        comp = keep(order.select("node", "component", "position"))
        of = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        dag = keep(edges.join(of("src"), "src").join(of("dst"), "dst").where("csrc != cdst").select("csrc", "cdst").distinct())
        front = keep(steps.join(comp.withColumnRenamed("node", "agent"), "agent").groupBy("plan_id", "component").agg(F.min("step").alias("step")))
        best = front
        while not front.isEmpty():
            offers = front.join(dag, F.col("component") == F.col("csrc")).groupBy("plan_id", F.col("cdst").alias("component")).agg(F.min("step").alias("offer"))
            both = keep(best.join(offers, ["plan_id", "component"], "full"))
            better = F.col("offer").isNotNull() & (F.col("step").isNull() | (F.col("offer") < F.col("step")))
            front = both.where(better).select("plan_id", "component", F.col("offer").alias("step"))
            best = both.select("plan_id", "component", F.least("step", "offer").alias("step"))
        sizes = keep(comp.groupBy("component").agg(F.min("position").alias("first"), F.count("*").alias("n")))
        rows = best.join(sizes, "component").withColumn("agent", F.lit(None).cast(comp.schema["node"].dataType))
        if every:
            own = steps.select("plan_id", "step", "agent").distinct().join(comp.select(F.col("node").alias("agent"), "component"), "agent", "left")
            idle = own.join(best.withColumnRenamed("step", "least"), ["plan_id", "component"], "left").where("component IS NULL OR NOT least <=> step")
            columns = {"component": F.lit(None).cast(comp.schema["component"].dataType), "first": F.lit(None).cast("long"), "n": F.lit(1).cast("long")}
            rows = rows.unionByName(idle.withColumns(columns).select(*rows.columns))
        idle = F.col("component").isNull()
        rows = rows.withColumns({"idle": idle, "late": idle & F.col("step").isNull()})
        rows = numbered(rows, "plan_id", "late", "step", "idle", "first", "agent", name="last", weight="n")
        start = rows.groupBy("plan_id").agg(F.min(F.col("last") - F.col("n")).alias("start"))
        rows = keep(rows.join(start, "plan_id").select("plan_id", "component", "step", "n", "agent", "idle", (F.col("last") - F.col("n") - F.col("start")).alias("before")))
        idle = cut(rows.where("idle").select("plan_id", F.col("agent").alias("node"), "step", (F.col("before") + 1).cast("int").alias("number"))) if every else None
        rows = rows.where("NOT idle")
        length = F.least("n", F.lit(_LIST))
        shares = keep(rows.groupBy("component").agg(F.ceil(F.sum(length) / share).alias("shares"), F.sum("n").alias("opened")))
        many = shares.agg(F.sum("opened")).first()[0] or 0
        parts = min(-(-many // share), 10 * int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1
        at = F.col("position") - F.col("first")
        lists = comp.join(sizes, "component").groupBy("component", F.floor(at / _LIST).alias("list")).agg(F.collect_list(F.struct("node", (at + 1).alias("at"))).alias("nodes"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        lists = cut(lists.join(shares, "component").select("component", "list", "nodes", each(F.col("shares")).alias("share")))
        rows = rows.join(shares, "component").withColumn("share", F.pmod(F.xxhash64("plan_id"), F.col("shares")))
        rows = cut(rows.select("plan_id", "component", "step", "before", "share", each(F.ceil(F.col("n") / _LIST)).alias("list")))
    key = ["component", "list", "share"]
    opened = rows.repartition(parts, *key).join(lists.repartition(parts, *key).hint("merge"), key).select("plan_id", "step", "before", F.explode("nodes").alias("x"))
    opened = opened.select("plan_id", F.col("x.node").alias("node"), "step", (F.col("before") + F.col("x.at")).cast("int").alias("number"))
    return opened.unionByName(idle) if every else opened


def cascade_set(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """All ids that a cascading delete removes, with the round in which each goes; no id goes twice, so it ends."""
    front = cut(deleted.select("id").distinct().withColumn("round", F.lit(0)))
    out = front
    while not front.isEmpty():
        step = children.join(front.select(F.col("id").alias("parent"), "round"), "parent").groupBy("id").agg((F.min("round") + 1).alias("round"))
        front = cut(step.join(out.select("id"), "id", "left_anti"))
        out = cut(out.unionByName(front))
    return out


def path_between(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b, path): the way from a up to the lowest common ancestor and down to b; no row where they share no root."""
    side = lambda n: paths.select(F.col("agent_id").alias(n), F.col("path").alias(f"p{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("pa", "pb"))).where("shared > 0")
    up = F.reverse(F.slice("pa", F.col("shared"), F.size("pa") - F.col("shared") + 1))
    down = F.slice("pb", F.col("shared") + 1, F.size("pb") - F.col("shared"))
    return both.select("a", "b", F.concat(up, down).alias("path"))


def fk_violations(children: DataFrame, parents: DataFrame) -> DataFrame:
    return children.where("parent IS NOT NULL").join(parents.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti")
