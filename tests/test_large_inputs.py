"""What larger tables need: plans and pieces whose work and memory do not grow faster than the rows."""

import json
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from apiloom.operators import apis as A
from apiloom.operators import capability as C
from apiloom.operators import deps as D
from apiloom.operators import graph as G
from apiloom.operators import roles as R
from apiloom.operators import scenarios as X
from apiloom.plans import capability_queries, graph_queries, profile_queries


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_a_document_is_read_before_its_paths_are_rows(spark):
    paths = {f"/p{i}": {"get": {"operationId": f"o{i}"}} for i in range(40)}
    docs = spark.createDataFrame([("a", json.dumps({"basePath": "/v1/", "paths": paths})), ("b", "no"), (None, json.dumps({"servers": [{"url": "/s"}], "paths": {"/q": {"post": {}}}}))], "doc_id string, json string")
    rows = A.extract_api_rows(docs)
    lines = plan_of(rows)
    first = max(i for i, line in enumerate(lines) if "Generate explode(paths" in line)
    assert all(i > first for i, line in enumerate(lines) if "basePath" in line)
    got = sorted((r["doc_id"] or "", r["path"], r["method"], r["operation_id"]) for r in rows.collect())
    assert got == sorted([("a", f"/v1/p{i}", "GET", f"o{i}") for i in range(40)] + [("", "/s/q", "POST", "post_/s/q")])


def test_field_matches_are_opened_last(spark):
    """Pairs of APIs come out of their classes' pairs: nothing is grouped or shuffled after. Also with repeated rows, APIs of
    two entities, null keys and places, and a class of several lists."""
    names = ["userId", "user_id", "order_id", "status", "email", "code", "note"]
    rows = [(f"o{i:02}", "xyz"[i % 3], names[(i * k) % 7], "number" if i % 11 == 0 else "string", [None, "path", "body"][(i + k) % 3]) for i in range(40) for k in (1, 3)]
    rows += [("o01", "z", "order_id", "string", "path"), (None, "x", "userId", "string", "path"), ("o02", None, "userId", "string", "path"), *rows[:9]]
    kind = "operation_id string, entity string, name string, type string, location string"
    requests, responses = spark.createDataFrame(rows[:60], kind), spark.createDataFrame(rows[30:], kind)
    allowed = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("z", "x"), ("z", "z"), ("z", "z")], "source string, target string")
    scored = D._scored_fields(D._tidy(requests), D._tidy(responses), allowed, 0.7, None).distinct().collect()
    want = {}
    for s in scored:
        key = lambda r, e, s=s: (r[1], r[2], r[3], r[4]) == (s[f"entity_{e}"], s[f"name_{e}"], s["type"], s[f"location_{e}"]) and None not in r
        for a in {r[0] for r in rows[:60] if key(r, "r")}:
            for b in {r[0] for r in rows[30:] if key(r, "p")} - {a}:
                score, matched = want.get((a, b), (0, set()))
                want[a, b] = (max(score, s["score"]), matched | {s["name_r"]})
    got = D.field_match_dependencies(requests, responses, allowed)
    lines = plan_of(got)
    opened = max(i for i, line in enumerate(lines) if "Generate explode(dsts" in line)
    assert not any("Aggregate" in line or "Join" in line for line in lines[:opened])
    found = [(r["src"], r["dst"], r["score"], tuple(r["matched"])) for r in got.collect()]
    assert len(want) > 50 and sorted(found) == sorted((a, b, s, tuple(sorted(m))) for (a, b), (s, m) in want.items())


def test_lists_of_apis_are_not_sent_in_pairs(spark):
    """Two lists meet in the task that opens them. Classes large and small, cut into cells, with every pair once."""
    kind = "operation_id string, entity string, name string, type string, location string"
    big = [(f"a{i:04}", "x", "userId", "string", "body") for i in range(1500)]
    rows = [*big, *[(f"b{i}", "y", "userId", "string", "path") for i in range(5)], ("c", "w", "userId", "string", "path")]
    requests, responses = spark.createDataFrame(rows, kind), spark.createDataFrame([*big[700:], *rows[1500:]], kind)
    allowed = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y"), ("y", "y"), (None, "w")], "source string, target string")
    got = D.field_match_dependencies(requests, responses, allowed, share=50_000)
    lines = plan_of(got)
    opened = next(i for i, line in enumerate(lines) if "Generate explode(srcs" in line)
    assert "Join" in next(line for line in lines[opened:] if "Join" in line or "Repartition" in line)
    ids = {"x": [r[0] for r in big], "y": [f"b{i}" for i in range(5)]}
    want = [(a, b) for s, t in (("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")) for a in ids[s] for b in (ids[t][700:] if t == "x" else ids[t]) if a != b]
    assert sorted((r["src"], r["dst"]) for r in got.select("src", "dst").collect()) == sorted(want)
    sides = {r["dst_class"]: r["side"] for r in D._grids(*D._signatures(requests), *D._signatures(responses), allowed, 50_000)[0].collect()}
    assert sides["a0700"] > 1 and sides["b0"] == 1 and "c" not in sides


def test_blocks_of_vectors_stay_few(spark):
    """A row is sent once for each block of the other side: the blocks do not grow with the rows."""
    rows = spark.range(3000).select("id", F.array(F.col("id").cast("float")).alias("embedding"))
    pairs = R._block_pairs(rows, rows, 10, 10).select(F.size("x").alias("x"), F.size("y").alias("y")).collect()
    assert len(pairs) <= 256 and sum(r["x"] * r["y"] for r in pairs) == 9_000_000


def test_nearest_vectors_in_strips(spark):
    """The products of a block are held in strips, and equals go by id, also across strips and blocks."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (9000, 4)).astype(float)
    ids = rng.permutation(9000)
    q = x[:2000]
    tracemalloc.start()
    found = [np.concatenate(a) for a in zip(*R._best(q, x, ids, 5, "cosine"), strict=True)]
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    n = np.linalg.norm(q[:50], axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    s = np.round(np.divide(q[:50] @ x.T, n, out=np.zeros((50, 9000)), where=n > 0), 9)
    for row in range(50):
        assert found[1][found[0] == row].tolist() == ids[np.lexsort((ids, -s[row]))[:5]].tolist()
    frame = lambda v, name: spark.createDataFrame([(int(i), e.tolist()) for i, e in v], f"{name} long, embedding array<float>")
    got = R.top_vectors(frame(zip(ids[:400], x[:400]), "vec_id"), frame(enumerate(q[:7]), "query_id"), 5, measure="cosine", item_block=50, query_block=3)
    want = {(row, rank, int(i)) for row in range(7) for rank, i in enumerate(ids[:400][np.lexsort((ids[:400], -s[row, :400]))[:5]], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == want


def test_words_of_many_nodes_are_bits(spark):
    nodes = [(i * 7 - 90, f"alpha w{i} {'beta' if i % 3 else 'gamma-beta'}") for i in range(150)] + [(None, "omega alpha"), (50, "alpha"), (51, None)]
    asked = [(1, "alpha beta"), (2, "w149 alpha"), (2, "w149"), (3, "zzz"), (4, "ega Alpha alpha"), (None, "gamma"), (5, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = C.keyword_match(frame(asked, "query_id"), frame(nodes, "node_id"))
    assert "bit_or" in "".join(plan_of(got))
    want = {(1, -90, 2), (2, 149 * 7 - 90, 3), (4, None, 2), (None, -90, 1)}
    assert {tuple(r) for r in got.select("query_id", "node_id", "hits").collect()} == want


def test_plans_are_opened_last(spark):
    """A component of several lists, before and after other nodes; no sort or shuffle follows the nodes of the result."""
    ring = [f"r{i:04}" for i in range(2300)]
    edges = spark.createDataFrame([*zip(ring, [*ring[1:], ring[0]], strict=True), ("a", "r0005"), ("r0007", "z"), ("b", "z")], "src string, dst string")
    order = G.topological_order(spark.createDataFrame([(n,) for n in ["a", "b", "z", *ring]], "node string"), edges)
    steps = spark.createDataFrame([(1, 2, "a"), (1, 1, "z"), (2, 1, "r0001"), (3, 1, "b"), (3, 2, "gone")], "plan_id long, step int, agent string")
    got = G.expand_plan(steps, edges, order)
    lines = plan_of(got)
    opened = next(i for i, line in enumerate(lines) if "Generate explode(nodes" in line)
    assert not any(word in line for line in lines[:opened] for word in ("Sort", "Join", "Aggregate", "Repartition"))
    want = [(1, "z", 1, 1), (1, "a", 2, 2), *[(1, n, 2, k) for k, n in enumerate(ring, 3)], *[(2, n, 1, k) for k, n in enumerate(ring, 1)], (2, "z", 1, 2301), (3, "b", 1, 1), (3, "z", 1, 2)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_plans_are_dealt_by_their_rows(spark):
    """Lists are few bytes that open to many rows: plans that open the same ones are dealt over tasks, whatever the bytes."""
    ring = [f"r{i:04}" for i in range(2300)]
    edges = spark.createDataFrame([*zip(ring, [*ring[1:], ring[0]], strict=True), ("r0007", "z")], "src string, dst string")
    order = G.topological_order(spark.createDataFrame([(n,) for n in ["z", *ring]], "node string"), edges)
    plans = [*range(30)]
    steps = spark.createDataFrame([(p, 1, ring[p]) for p in plans] + [(None, 1, "z"), (40, 2, "z"), (40, 1, None)], "plan_id long, step int, agent string")
    got = G.expand_plan(steps, edges, order, share=5000)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 6 and max(tasks) <= 25_000
    want = [(p, n, 1, k) for p in plans for k, n in enumerate([*ring, "z"], 1)] + [(40, "z", 2, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_exploded_names_are_merged(spark):
    """The planner counts the rows of an explode too low, so it must not choose a broadcast of them."""
    steps = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "path_id long, pos int, operation_id string")
    names = spark.createDataFrame([("a", ["x", "y_id"]), ("b", ["y_id"])], "operation_id string, n array<string>").select("operation_id", F.explode("n").alias("name"))
    flow = D.parameter_flow(steps, names, names)
    assert "".join(plan_of(flow)).count("strategy=merge") == 2
    assert [tuple(r) for r in flow.collect()] == [(1, 2, "b", "y_id", 1, "a")]
    bound = X.parameter_bindings(steps, flow.where("false").withColumn("source", F.lit("s")), names)
    assert "strategy=merge" in "".join(plan_of(bound))
    assert [tuple(r) for r in bound.collect()] == [(1, 2, "b", "y_id", "dynamic_ref", "{a.response.id}")]


def test_small_files_are_dealt_out(spark, sf):
    for rows in (profile_queries._operations(spark, sf), graph_queries.fields(spark, sf, "request")):
        assert "Repartition" in "".join(plan_of(rows))
    assert "strategy=merge" in "".join(plan_of(capability_queries._fields(spark, sf)))
