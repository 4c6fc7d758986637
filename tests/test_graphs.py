"""Components, levels, trees and reachability against plain versions; rounds counted on long chains."""

import random

import pandas as pd
import pytest

from apiloom import session
from apiloom.operators import blocks
from apiloom.operators import graph as G
from apiloom.operators import trees as T
from apiloom.plans import graph_queries


def components(nodes, edges):
    """Tarjan's algorithm, without recursion."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    index, low, stack, on, comp = {}, {}, [], set(), {}
    for start in nodes:
        work = [] if start in index else [start]
        its = {}
        while work:
            v = work[-1]
            if v not in index:
                index[v] = low[v] = len(index)
                stack.append(v)
                on.add(v)
                its[v] = iter(out.get(v, ()))
            for w in its[v]:
                if w not in index:
                    work.append(w)
                    break
                if w in on:
                    low[v] = min(low[v], low[w])
            else:
                work.pop()
                if low[v] == index[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    comp |= dict.fromkeys(members, min(members))
                elif work:
                    low[work[-1]] = min(low[work[-1]], low[v])
    return comp


def ordered(nodes, edges):
    comp = components(nodes, edges)
    links = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    level, left = dict.fromkeys(comp.values(), 0), True
    while left:
        left = False
        for a, b in links:
            if level[b] <= level[a]:
                level[b], left = level[a] + 1, True
    rows = sorted((level[comp[n]], comp[n], n) for n in nodes)
    return {n: (c, lv, k) for k, (lv, c, n) in enumerate(rows, 1)}


def order_of(spark, nodes, edges, **blocks):
    frame = spark.createDataFrame(edges, "src string, dst string")
    rows = G.topological_order(spark.createDataFrame([(n,) for n in nodes], "node string"), frame, **blocks).collect()
    return {r["node"]: (r["component"], r["level"], r["position"]) for r in rows}


@pytest.mark.parametrize("links", [25, 70])
def test_blocks_and_hubs_against_tarjan(spark, links):
    rng = random.Random(links)
    nodes = [f"n{i:02}" for i in range(50)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(links)]
    assert order_of(spark, nodes, edges, least=3, hub=2) == ordered(nodes, edges)


def test_rounds_are_logarithmic_in_chains(spark, monkeypatch):
    tables = []
    keep = session.Scratch.__call__
    monkeypatch.setattr(session.Scratch, "__call__", lambda self, df: tables.append(1) or keep(self, df))
    rng = random.Random(1)
    names = [f"{rng.getrandbits(40):010x}" for _ in range(1200)]
    chain = list(zip(names[:600], names[1:601], strict=True))
    ring = list(zip(names[700:900], [*names[701:900], names[700]], strict=True))
    loop = [*zip(names[900:1100], names[901:1101], strict=True), (names[1100], names[900]), (names[50], names[900]), (names[1000], names[1150])]
    assert order_of(spark, names, chain + ring + loop, least=4) == ordered(names, chain + ring + loop)
    assert len(tables) < 90


def test_tables_do_not_follow_the_ranges_of_a_long_graph(spark, monkeypatch):
    tables = []
    keep = session.Scratch.__call__
    monkeypatch.setattr(session.Scratch, "__call__", lambda self, df: tables.append(1) or keep(self, df))
    names = [f"p{i:05}" for i in range(1600)]
    forth = [(names[i], names[i + j]) for i in range(1600) for j in (1, 3, 7) if i + j < 1600 and i % 400 != 399]
    edges = forth + [(b, a) for k, (a, b) in enumerate(forth) if k % 5 == 0]
    assert order_of(spark, names, edges, size=400) == ordered(names, edges)
    assert len(tables) < 40


@pytest.mark.parametrize("most", [5, 60, 1000])
def test_cycles_inside_a_range(most):
    rng = random.Random(most)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = sorted({(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(90)) if a != b})
    batches = [pd.DataFrame(edges[i : i + 7], columns=["src", "dst"]) for i in range(0, len(edges), 7)]
    rows = [r for part in blocks._cycles_inside(iter(batches), most) for r in part.itertuples(index=False, name=None)]
    root = {a: b for kind, a, b in rows if kind == "n"}
    taken = [e for b in batches[: -(-most // 7)] for e in b.itertuples(index=False, name=None)]
    assert {n: root.get(n, n) for n in nodes} == components(nodes, taken)
    left = {(root.get(a, a), root.get(b, b)) for kind, a, b in rows if kind == "e"}
    assert {e for e in left if e[0] != e[1]} == {(root.get(a, a), root.get(b, b)) for a, b in edges if root.get(a, a) != root.get(b, b)}
    assert list(blocks._cycles_inside(iter([]), most)) == []


def test_components_of_the_parts_graph(spark, sf):
    edges = [tuple(r) for r in graph_queries._parts_graph(spark, sf).collect()]
    nodes = sorted({x for e in edges for x in e})
    want = ordered(nodes, edges)
    assert len({c for c, _, _ in want.values()}) > 20 and max(lv for _, lv, _ in want.values()) > 20
    rows = graph_queries.QUERIES["topological_order_of_parts"](spark, sf).collect()
    assert {r["node"]: (r["component"], r["level"], r["position"]) for r in rows} == want


def places(rows):
    """Depth and places on the tour, by recursion over sorted children."""
    below = {}
    for node, parent in rows:
        below.setdefault(parent, []).append(node)
    out, at, stack = {}, 0, [(n, 0, False) for n in sorted(below.get(None, ()), reverse=True)]
    while stack:
        node, depth, left = stack.pop()
        if left:
            out[node] = (*out[node], at)
        else:
            out[node] = (depth, at)
            stack.append((node, depth, True))
            stack += [(c, depth + 1, False) for c in sorted(below.get(node, ()), reverse=True)]
        at += 1
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_trees_by_their_tour(spark, kind, monkeypatch):
    tables = []
    keep = session.Scratch.__call__
    monkeypatch.setattr(session.Scratch, "__call__", lambda self, df: tables.append(1) or keep(self, df))
    rng = random.Random(7)
    n = 400
    parent = {"random": lambda i: None if i < 3 else f"t{rng.randrange(i):04}", "chain": lambda i: f"t{i - 1:04}" if i else None, "star": lambda i: "t0000" if i else None}[kind]
    rows = [(f"t{i:04}", parent(i)) for i in range(n)]
    lost = [("x", "y"), ("y", "x"), ("z", "nobody"), ("zz", "z")]
    got = T.tree_intervals(spark.createDataFrame(rows + lost, "agent_id string, parent_id string"))
    want = places(rows)
    assert {r["agent_id"]: (r["depth"], r["enter"], r["leave"]) for r in got.collect()} == want
    assert len(tables) <= 14
    up = dict(rows)

    def way(a):
        return [a, *(way(up[a]) if up[a] else [])] if kind != "chain" else [f"t{i:04}" for i in range(int(a[1:]), -1, -1)]

    pairs = [(f"t{rng.randrange(n):04}", f"t{rng.randrange(n):04}") for _ in range(60)] + [("t0005", "t0005"), ("t0000", "t0399")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    lca = {(r["a"], r["b"]): r["lca"] for r in T.lowest_common_ancestor(frame, got).collect()}
    assert lca == {(a, b): next((x for x in way(a) if x in set(way(b))), None) for a, b in pairs}
    below = T.is_descendant(frame.toDF("ancestor", "node").union(spark.createDataFrame([("x", "y"), (None, "t0001")], "a string, b string")), got).collect()
    assert {(r["ancestor"], r["node"]): r["descendant"] for r in below} == {**{(a, b): a != b and a in way(b) for a, b in pairs}, ("x", "y"): False, (None, "t0001"): False}


def test_plans_over_the_parts_graph(spark, sf):
    edges = [tuple(r) for r in graph_queries._parts_graph(spark, sf).collect()]
    nodes = sorted({x for e in edges for x in e})
    places = ordered(nodes, edges)
    below = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    steps = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_partkey").collect():
        key = (r["l_suppkey"], r["l_linenumber"])
        steps[key] = max(steps.get(key, 0), r["l_partkey"])
    want = {}
    for (plan, step), part in sorted(steps.items()):
        stack = [f"{part:09}"]
        while stack:
            x = stack.pop()
            if x in places and (plan, x) not in want:
                want[plan, x] = step
                stack += below.get(x, ())
    ranks = {}
    for plan, x in sorted(want, key=lambda k: (k[0], want[k], places[k[1]][2], k[1])):
        ranks.setdefault(plan, []).append(x)
    got = {(r["plan_id"], r["node"]): (r["step"], r["number"]) for r in graph_queries.QUERIES["expand_plan_of_parts"](spark, sf).collect()}
    assert len(set(want.values())) > 1
    assert got == {(p, x): (want[p, x], k) for p, xs in ranks.items() for k, x in enumerate(xs, 1)}


def test_every_step_stays_in_its_plan(spark, sf):
    """As the planner does: a step whose agent is unknown or was reached before stays, so agents and later steps count."""
    rng = random.Random(11)
    nodes = [f"n{i:02}" for i in range(30)]
    edges = sorted({(a, b) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(34)) if a != b})
    places = ordered(nodes, edges)
    below = {}
    for a, b in edges:
        below.setdefault(a, []).append(b)
    steps = [(p, k, rng.choice([*nodes, "gone", None])) for p in range(12) for k in range(1, 8)] + [(None, 1, "n00"), (None, 2, "gone"), (3, None, "lost")]
    want = []
    for plan in range(12):
        found, rows = set(), []
        for _, step, agent in (x for x in steps if x[0] == plan and x[1]):
            fresh, stack = set(), [agent] if agent in places else []
            while stack:
                x = stack.pop()
                if x not in found | fresh:
                    fresh.add(x)
                    stack += below.get(x, ())
            rows += [(x, step) for x in sorted(fresh, key=lambda x: places[x][2])] or [(agent, step)]
            found |= fresh
        want += [(plan, x, step, k) for k, (x, step) in enumerate([*rows, ("lost", None)] if plan == 3 else rows, 1)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    order = G.topological_order(spark.createDataFrame([(n,) for n in nodes], "node string"), frame)
    got = G.expand_plan(spark.createDataFrame([*steps, *steps[:20]], "plan_id long, step int, agent string"), frame, order, every=True)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {x[2] for x in want} == {None, *range(1, 8)} and sum(x[1] is None for x in want) and sum(x[1] == "gone" for x in want)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_linenumber").distinct().collect()
    plans = graph_queries.QUERIES["expand_plan"](spark, sf).select("plan_id", "step").distinct().collect()
    assert sorted(map(tuple, plans)) == sorted(map(tuple, lines))


def test_the_last_turn_is_one_task(spark, monkeypatch):
    """Cycles are settled where one task holds them all, also when ranges are dealt to more tasks than asked for."""
    ring = [f"n{i:02}" for i in range(60)]
    edges = spark.createDataFrame([*zip(ring, [*ring[30:], *ring[:30]], strict=True), *zip(ring, [*ring[1:], ring[0]], strict=True)], "src string, dst string")
    frame, dealt = type(edges), type(edges).repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *columns: dealt(self, max(n, 7), *columns))
    with session.Scratch(spark) as keep:
        turns, left, settled = blocks.contract_cycles(edges, keep)
        assert settled and left.isEmpty()
        assert {r["node"]: r["root"] for t in turns for r in t.collect()} == dict.fromkeys(ring[1:], "n00")
