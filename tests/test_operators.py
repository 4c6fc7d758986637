"""Operators against literal cases and plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from apiloom.operators import apis as A
from apiloom.operators import deps as D
from apiloom.operators import graph as G
from apiloom.operators import metrics as M
from apiloom.operators import roles as R
from apiloom.operators import runs
from apiloom.operators import select as S


def test_run_metrics(spark):
    logs = spark.createDataFrame([(i, "t", "m", a, s, i) for i, (a, s) in enumerate([("a1", "500"), ("a1", "ok"), ("a2", "ok"), ("zz", "invalid_tool"), ("a3", "500")])], "event_id long, task_id string, model string, agent_id string, status string, timestamp_ms long")
    r = runs.task_tool_metrics(logs).first()
    assert (r["tool_calls_total"], r["hallucination_errors"], r["injected_errors"], r["recovered_errors"]) == (5, 1, 2, 1)
    assert runs.executed_agents(logs).first()["executed_agents"] == ["a1", "a2"]
    assert runs.task_tool_metrics(logs.limit(0)).count() == 0
    row = spark.createDataFrame([(["a1", "a2", "a9", "a10"], ["a1", "a2"], "none"), ([], ["a1"], "none")], "expected_agents array<string>, executed_agents array<string>, error_type string")
    assert [(x["coverage"], x["success"]) for x in runs.run_success(row).collect()] == [(0.5, 1), (0.0, 0)]


def test_classification_and_text_metrics(spark):
    rows = spark.createDataFrame([("x", e, p) for e, p in zip("pnpn", "ppnn", strict=True)], "prompt_id string, expected string, predicted string")
    r = M.classification_metrics(rows, positive="p").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5, 0.5)
    assert math.isclose(M.bleu_score("a b c d e", "a b c d e"), 1.0) and M.bleu_score("a b", "a b") == 1.0
    assert M.bleu_score("a b c", "c b a") == 0.0 and M.bleu_score("a", "") == 0.0
    assert M.lcs_length("a b c d".split(), "a c d".split()) == 3
    assert [round(x, 6) for x in M.rouge_scores("a b c d", "a c d")[6:]] == [round(2 * 0.75 / 1.75, 6), 1.0, 0.75]
    rng = random.Random(1)
    for _ in range(30):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert M.lcs_length(a, b) == t[-1][-1]


def test_selection(spark):
    c = spark.createDataFrame([("r", 1, 0, "x", 0.5), ("r", 1, 1, "y", 0.6)], "run string, iteration int, idx int, prompt string, score double")
    u = {r["prompt"]: r["ucb"] for r in S.ucb_select(c, 2).collect()}
    assert round(u["x"], 3) == 1.677 and round(u["y"], 3) == 1.777
    h = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.5, 0.505, 0.508, 0.509], 1)] + [("b", i, s) for i, s in enumerate([0.5, 0.505, 0.511], 1)], "run string, iteration int, score double")
    assert {r["run"]: r["stop_at"] for r in S.early_stop_point(h).collect()} == {"a": 4, "b": None}
    ties = spark.createDataFrame([("r", 1, i, str(i), 0.5) for i in range(4)], c.schema)
    assert [r["idx"] for r in S.select_top_k(ties, 2).orderBy("rank").collect()] == [3, 2]
    picked = S.diversity_select(spark.createDataFrame([("r", 1, 0, "a b", 0.9), ("r", 1, 1, "a b", 0.89), ("r", 1, 2, "c d", 0.8)], c.schema), 2).orderBy("rank").collect()
    assert [r["idx"] for r in picked] == [0, 2]


def test_clusters_and_crud(spark):
    rows = spark.createDataFrame([(f"o{i}", "user", m, ["a", "b"]) for i, m in enumerate(["GET", "POST", "GET"])] + [("z", "shop", "GET", ["a", "b"])], "operation_id string, entity string, method string, fields array<string>")
    got = A.refine_crud(A.entity_clusters(rows)).collect()
    kinds = {r["operation_id"]: (r["cluster"], r["cluster_type"]) for r in got}
    assert len({kinds[f"o{i}"][0] for i in range(3)}) == 1 and kinds["o0"][1] == "crud_complete" and kinds["z"][1] == "atomic"


def test_purchase_order_dependencies(spark):
    spec = "operation_id string, entity string, method string, path string, ord long"
    apis = spark.createDataFrame([("updatePO", "purchase-order", "PUT", "/purchase-order/update", 0), ("getPO", "purchase-order", "GET", "/purchase-order/get", 1), ("getSupplier", "supplier", "GET", "/supplier/get", 2)], spec)
    assert [(r["src"], r["dst"], r["score"]) for r in D.crud_flow_dependencies(apis).collect()] == [("updatePO", "getPO", 0.85)]
    entities = apis.groupBy("entity").agg(F.min("ord").alias("ord"))
    fields = spark.createDataFrame([("purchase-order", "supplierCode"), ("purchase-order", "orderId"), ("purchase-order", "productList")], "entity string, field string")
    assert [(r["source"], r["target"]) for r in D.entity_relations_by_field(fields, entities).collect()] == [("purchase-order", "supplier")]
    f = "operation_id string, entity string, name string, type string, location string"
    req = spark.createDataFrame([("updatePO", "purchase-order", "orderId", "string", "body"), ("updatePO", "purchase-order", "status", "string", "body")], f)
    res = spark.createDataFrame([("getPO", "purchase-order", "orderId", "string", "body"), ("updatePO", "purchase-order", "orderId", "string", "body"), ("getPO", "purchase-order", "status", "string", "body")], f)
    allowed = spark.createDataFrame([("purchase-order", "purchase-order")], "source string, target string")
    assert [(r["src"], r["dst"], r["score"]) for r in D.field_match_dependencies(req, res, allowed).collect()] == [("updatePO", "getPO", 0.8)]
    paths = D.entity_relations_by_path(apis, entities, max_broadcast=0).collect()
    assert sorted(map(tuple, paths)) == sorted(map(tuple, D.entity_relations_by_path(apis, entities).collect()))


def test_paths_trees_and_cycles(spark):
    e = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.8), ("A", "C", 0.5), ("B", "B", 1.0), ("C", "A", 0.1)], "src string, dst string, score double")
    got = [(r["path"], round(r["score"], 4)) for r in G.find_paths(e, "A", "C").collect()]
    assert got == [(["A", "B", "C"], 0.74), (["A", "C"], 0.5)]
    tree = spark.createDataFrame([("r", "", None), ("a", "", "r"), ("b", "", "a"), ("x", "", "y"), ("y", "", "x"), ("lost", "", "nobody")], "agent_id string, name string, parent_id string")
    assert {r["agent_id"]: r["depth"] for r in G.tree_paths(tree).collect()} == {"r": 0, "a": 1, "b": 2}
    nodes = spark.createDataFrame([(n,) for n in "ABCD"], "node string")
    order = {r["node"]: (r["component"], r["level"], r["position"]) for r in G.topological_order(nodes, e.union(spark.createDataFrame([("C", "D", 1.0)], e.schema))).collect()}
    assert order == {"A": ("A", 0, 1), "B": ("A", 0, 2), "C": ("A", 0, 3), "D": ("D", 1, 4)}
    weights = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.5), ("C", "D", 0.5), ("A", "C", None)], "src string, dst string, weight double")
    assert {r["node"]: r["strength"] for r in G.influence(weights, "A").collect()} == {"A": 1.0, "B": 0.9, "C": 0.5}


def test_vectors_against_plain_products(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    items = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(5)
    queries = items.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    for block in (100, 3):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.top_vectors(items, queries, 4, query_block=block).collect()}
        for q in range(7):
            best = np.argsort(((x - x[q]) ** 2).sum(1))[:4]
            assert [got[(q, k + 1)] for k in range(4)] == best.tolist()
    near = R.nearest_cluster(items.where("vec_id < 5"), items.where("vec_id >= 5").withColumn("cluster", F.col("label")), least=-1.0).collect()
    assert len(near) == 5
    assert R.top_vectors(items, queries.limit(0), 4).count() == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert R.best_of_few(zero, zero.withColumnRenamed("vec_id", "query_id"), 1).first()["similarity"] == 0.0


def edges_of(spark, rng, nodes, links):
    rows = {(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for _ in range(links)}
    return sorted(rows), spark.createDataFrame(sorted(rows), "src string, dst string")


def reach(rows):
    below = {}
    for a, b in rows:
        below.setdefault(a, set()).add(b)
    out = {}
    for a in {x for r in rows for x in r}:
        seen, stack = set(), list(below.get(a, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += below.get(x, ())
        out[a] = seen
    return out


def test_components_and_order_against_a_plain_closure(spark):
    rng = random.Random(3)
    for nodes, links in ((14, 16), (14, 24), (10, 0)):
        rows, frame = edges_of(spark, rng, nodes, links)
        to = reach(rows)
        names = spark.createDataFrame([(x,) for x in sorted(to) + ["zz"]], "node string")
        comp = {r["node"]: r["component"] for r in G.scc(names, frame).collect()}
        assert comp == {x: min([x, *(y for y in to.get(x, ()) if x in to.get(y, ()))]) for x in [*to, "zz"]}
        place = {r["node"]: r for r in G.topological_order(names, frame).collect()}
        assert sorted(r["position"] for r in place.values()) == list(range(1, len(place) + 1))
        assert all(comp[a] == comp[b] or place[a]["level"] < place[b]["level"] for a, b in rows)
    rows, frame = edges_of(spark, rng, 12, 14)
    to = reach(rows)
    names = spark.createDataFrame([(x,) for x in sorted(to)], "node string")
    steps = spark.createDataFrame([("p", 1, rows[0][0]), ("p", 2, rows[-1][0]), ("q", 1, rows[3][1])], "plan_id string, step int, agent string")
    got = {(r["plan_id"], r["node"]): r["step"] for r in G.expand_plan(steps, frame, G.topological_order(names, frame)).collect()}
    want = {}
    for plan, step, agent in (("p", 1, rows[0][0]), ("p", 2, rows[-1][0]), ("q", 1, rows[3][1])):
        for x in {agent} | to[agent]:
            want.setdefault((plan, x), step)
    assert got == want


def test_find_paths_against_enumeration(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(9)]
    edges = {(a, b): round(rng.uniform(0.3, 0.9), 3) for a in names for b in names if a != b and rng.random() < 0.7}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, score double")
    found, stack = [], [(["n0"], 0.0)]
    while stack:
        path, total = stack.pop()
        for b in names:
            if (path[-1], b) in edges and b not in path and len(path) <= 5:
                longer = (path + [b], total + edges[(path[-1], b)])
                if b == "n8":
                    found.append((round(longer[1] / len(path) ** 1.2, 9), longer[0]))
                else:
                    stack.append(longer)
    want = sorted(found, key=lambda x: (-x[0], x[1]))
    for top in (5, 40, 10_000):
        assert [(r["score"], r["path"]) for r in G.find_paths(frame, "n0", "n8", top=top).collect()] == want[:top]


def test_deep_trees_wide_schemas_and_cascades(spark):
    from apiloom.functions import schema as X

    tree = spark.createDataFrame([("a00", None)] + [(f"a{i:02}", f"a{i - 1:02}") for i in range(1, 60)] + [("b", "a10"), ("c1", "c2"), ("c2", "c1")], "agent_id string, parent_id string")
    paths = G.tree_paths(tree)
    assert {r["agent_id"]: r["depth"] for r in paths.collect()} == {f"a{i:02}": i for i in range(60)} | {"b": 11}
    pairs = spark.createDataFrame([("a12", "b"), ("b", "b"), ("a05", "a01")], "a string, b string")
    assert {(r["a"], r["b"]): r["path"] for r in G.path_between(pairs, paths).collect()} == {("a12", "b"): ["a12", "a11", "a10", "b"], ("b", "b"): ["b"], ("a05", "a01"): ["a05", "a04", "a03", "a02", "a01"]}
    gone = G.cascade_set(tree.select(F.col("agent_id").alias("id"), F.col("parent_id").alias("parent")), spark.createDataFrame([("a00",)], "id string"))
    assert {r["id"]: r["round"] for r in gone.collect()} == {f"a{i:02}": i for i in range(60)} | {"b": 11}
    assert len(X.flatten({"properties": {f"f{i}": {"type": "string"} for i in range(10_001)}})) == 10_001
    got = spark.createDataFrame([("a.b[].c", "b.c"), ("a.b", "c.b"), ("x", "x"), ("a.id[]", "id"), ("a.b", "a")], "a string, b string").select(X.paths_compatible(F.col("a"), F.col("b")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, True, True, False]


def test_density_clusters_against_plain_dbscan(spark):
    import math
    import re
    from collections import Counter

    from apiloom.operators import capability as C

    rng = random.Random(2)
    nouns = ["ring", "bolt", "wheel", "frame", "order", "user", "stock", "price", "invoice", "report"]
    rows = [(f"op{i:03}", rng.choice(["t1", "t2"]), " ".join(rng.choice(["get", "list", "make"]) + " " + rng.choice(nouns[:4] if rng.random() < 0.5 else nouns) for _ in range(rng.randint(1, 3)))) for i in range(60)] + [("z1", None, None), ("z2", "t3", "alone")]
    frame = spark.createDataFrame(rows, "operation_id string, tag string, text string")

    def plain(texts):
        texts = sorted(texts)
        grams = []
        for t in texts:
            w = re.findall(r"\w\w+", t.lower())
            grams.append(Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))
        df = Counter(g for c in grams for g in c)
        vec = [{g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()} for c in grams]
        norm = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vec]
        d = [[round(1 - sum(x * vec[j].get(g, 0) for g, x in vec[i].items()) / norm[i] / norm[j], 6) for j in range(len(texts))] for i in range(len(texts))]
        above = sorted(d[i][j] for i in range(len(texts)) for j in range(i))
        eps = round(min(0.7, max(0.3, float(np.median(above)))), 6) if above else 0.3
        near = [[j for j in range(len(texts)) if d[i][j] <= eps] for i in range(len(texts))]
        core = [len(x) >= 2 for x in near]
        owner = list(range(len(texts)))
        for _ in texts:
            for i in range(len(texts)):
                for j in near[i]:
                    if core[i] and core[j]:
                        owner[i] = owner[j] = min(owner[i], owner[j])
        return {texts[i]: (owner[i] if core[i] else None) for i in range(len(texts))}

    for block in (7, 2048):
        got = {r["operation_id"]: r["cluster"] for r in C.density_clusters(frame, block=block).collect()}
        assert len(got) == len(rows) and got["z2"] == "noise/z2" and got["z1"] == "noise/z1"
        for tag in ("t1", "t2"):
            mine = [(o, t) for o, g, t in rows if g == tag]
            want = plain({t for _, t in mine})
            for o, t in mine:
                for p, u in mine:
                    if want[t] is not None and want[u] is not None:
                        assert (got[o] == got[p]) == (want[t] == want[u])


def test_vectors_and_silhouette_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6))
    labels = rng.integers(0, 3, 50)
    points = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(50)], "vec_id long, embedding array<double>, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(50):
        own = labels == labels[i]
        a = d[i, own].sum() / max(1, own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        s.append((b - a) / max(a, b))
    assert abs(R.silhouette(points, block=9).first()[0] - np.mean(s)) < 1e-6
    queries = points.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in R.top_vectors(points, queries, 4, item_block=9, query_block=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert got == {q: dict(enumerate(np.argsort(d[q], kind="stable")[:4].tolist(), 1)) for q in range(0, 50, 5)}


def test_mmr_rounds_equal_the_plain_choice(spark):
    rng = random.Random(9)
    rows = [("r", i % 2, i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))), round(rng.random(), 3)) for i in range(30)]
    frame = spark.createDataFrame(rows, "run string, iteration int, idx int, prompt string, score double")
    got = sorted((r["iteration"], r["rank"], r["idx"]) for r in S.diversity_select(frame, 6).collect())
    pdf = frame.toPandas()
    want = sorted((k, int(r["rank"]), int(r["idx"])) for k in (0, 1) for _, r in S.mmr_pick(pdf[pdf["iteration"] == k], 6, 0.7).iterrows())
    assert got == want


def test_fields_of_apis(spark):
    rows = [
        ("a", None, None, None, {"path": [("id", None, None)], "query": [("q", "string", False)], "body": [], "header": [("h", "string", True)]}),
        ("b", None, '{"properties":{"supplierCode":{"type":"string"},"productList":{"type":"array"}}}', {"404": "{}", "201": '{"properties":{"orderId":{"type":"string"}}}'}, None),
        ("c", [("orderId", "string", None), ("status", "string", None)], '{"properties":{"no":{}}}', {"default": '{"oneOf":[{"properties":{"X":{}}}]}'}, None),
        ("d", None, "not json", None, None),
    ]
    kind = "array<struct<name:string,type:string,required:boolean>>"
    frame = spark.createDataFrame(rows, f"operation_id string, request_fields {kind}, request_schema string, response_schemas map<string,string>, parameters map<string,{kind}>")
    got = [(r["operation_id"], r["ord"], r["name"], r["required"]) for r in A.api_fields(frame, "request").orderBy("operation_id", "ord").collect()]
    assert got == [("a", 0, "q", False), ("a", 1, "id", True), ("b", 0, "supplierCode", False), ("b", 1, "productList", False), ("c", 0, "orderId", None), ("c", 1, "status", None)]
    assert [(r["operation_id"], r["name"]) for r in A.api_fields(frame, "response").collect()] == [("b", "orderId")]
    prints = {r["operation_id"]: (r["request"], r["response"]) for r in A.schema_fingerprints(frame).collect()}
    assert prints == {"a": (["h", "id", "q"], []), "b": (["productlist", "suppliercode"], ["orderid"]), "c": (["no"], []), "d": ([], [])}
