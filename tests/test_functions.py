"""Column functions and sources on literal rows, with edge rows."""

import json

from pyspark.sql import functions as F

from apiloom.functions import schema as X
from apiloom.functions import text as T
from apiloom.operators import apis as A
from apiloom.operators import metrics as M
from apiloom.operators import profile as P
from apiloom.sources import readers as R


def one(spark, column, **values):
    kinds = {k: "array<string>" if isinstance(v, list) else "string" if not isinstance(v, int) else "int" for k, v in values.items()}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first()["x"]


def test_paths(spark):
    path = lambda p: one(spark, T.normalize_path(F.col("p")), p=p)
    assert path("/user/123/order/456") == "/user/{id}/order/{id}"
    assert path("/a/123E4567-E89B-12D3-A456-426614174000/7") == "/a/{uuid}/{id}"
    assert path(None) is None and path("") == ""
    anchor = lambda p, t: one(spark, T.path_anchor(F.col("p"), F.col("t")), p=p, t=t)
    assert anchor("/admin-api/erp/purchase-order/create", []) == "purchase-order"
    assert anchor("/api/v1/user/order/list", []) == "order"
    assert anchor("/supplier/{id}", []) == "supplier"
    assert anchor("/api/v1/list", []) == "unknown"
    assert anchor("/api/v1/list", ["Shop"]) == "shop" and anchor("/api/v1/list", ["AutoGenerated"]) == "unknown"


def test_names(spark):
    verb = lambda o: one(spark, T.action_verb(F.col("o")), o=o)
    assert [verb(x) for x in ("syncUserData", "batchCreateOrders", "loginUser", None)] == ["sync", "batch", None, None]
    canonical = lambda n: one(spark, T.canonical_entity(F.col("n")), n=n)
    assert [canonical(x) for x in ("user_ID", "order-id", "supplierCode", "createTime")] == ["USER_ID", "ORDER_ID", None, "TIMESTAMP"]
    assert one(spark, T.entity_variations(F.col("e")), e="a--bs") == ["a--bs", "abs", "a--b", "a", "bs"]
    keys = one(spark, T.entity_keys(F.col("f")), f="supplier_id")
    assert [(k["ord"], k["key"]) for k in keys] == [(0, "supplier"), (1, "supplier_")]
    assert one(spark, T.name_similarity(F.col("a"), F.col("b")), a="orderId", b="order_id") == 1.0


def test_responses(spark):
    assert one(spark, T.parse_score(F.col("r")), r="about 8.5 of 10 ||| fine") == 0.85
    assert one(spark, T.parse_score(F.col("r")), r="none") is None
    assert one(spark, T.first_line(F.col("r")), r="\n  yes it is \nno") == "yes it is"
    assert one(spark, T.agent_tags(F.col("t")), t="[agent:a1] then [agent:b]") == ["a1", "b"]
    assert one(spark, T.task_level(F.col("a")), a=["s1__x", "s1__y"]) == 1
    assert one(spark, T.task_level(F.col("a")), a=[f"s{i}__x" for i in range(5)]) == 4
    assert one(spark, T.token_estimate(F.col("t")), t="abcde") == 2
    assert one(spark, T.detect_transformation(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a="string", b="signature", c="string", d=None) == "sign"


def test_schema_flattening(spark):
    schema = {"properties": {"a": {"properties": {"b": {"type": "integer"}}}, "c": {"type": "array", "items": {"properties": {"d": {}}}}}}
    rows = spark.createDataFrame([(1, json.dumps(schema)), (2, "not json"), (3, None), (4, "[1]")], "id int, s string")
    got = [(r["id"], r["path"], r["type"]) for r in X.flatten_schema(rows, key="id", schema_col="s").orderBy("id", "ord").collect()]
    assert got == [(1, "a", "string"), (1, "c", "array"), (1, "a.b", "integer"), (1, "c[].d", "string")]
    assert one(spark, X.leaf_name(F.col("p")), p="a[].b[]") == "b"


def test_openapi_source_and_rows(spark, tmp_path):
    doc = {"basePath": "/v1/", "paths": {"/x/{id}": {"get": {"operationId": "getX", "tags": ["t"], "parameters": [{"name": "id", "in": "path", "schema": {"type": "integer"}}]}, "trace": {}}, "/y": {"post": {}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text('{"paths": {')
    good, corrupt = R.read_openapi(spark, str(tmp_path))
    assert (good.count(), corrupt.count()) == (1, 1)
    rows = {r["operation_id"]: r for r in A.classify_parameters(A.extract_api_rows(good)).collect()}
    assert set(rows) == {"getX", "post_/v1/y"}
    assert rows["getX"]["path"] == "/v1/x/{id}" and rows["getX"]["parameters"]["path"][0]["type"] == "integer"


def test_agent_records_tasks_and_manuals(spark, tmp_path):
    (tmp_path / "agents.json").write_text('[{"n": {"properties": {"agent_id": "a", "parentId": "r", "seq": "1", "name": "x\x01y"}}}, {"n": {"properties": {"name": "no id"}}}]')
    rows = R.read_agent_records(spark, str(tmp_path / "agents.json")).collect()
    assert [(r["agent_id"], r["parent_id"], r["seq"], r["name"]) for r in rows] == [("a", "r", 1, "xy")]
    (tmp_path / "tasks.json").write_text('[{"task_id": 1, "level": 2, "prompt": "p", "expected_agents": ["a"]}]')
    assert [r["expected_agents"] for r in R.read_tasks(spark, str(tmp_path / "tasks.json")).collect()] == [["a"]]
    (tmp_path / "m.md").write_text("# Doc\n## Create it\n**接口地址**:`/a/create`\n\n**请求方式**:`POST`\n\n| 参数名称 | 说明 | 类型 |\n|---|---|---|\n|a|first|object|\n|&emsp;b|second|integer(int64)|\n\n## List\n**接口地址**:`/a/list`\n**请求方式**:`GET`\n")
    manual = R.read_markdown_api(spark, str(tmp_path / "m.md"))
    assert [(r["title"], r["path"], r["method"]) for r in manual.orderBy("pos").collect()] == [("Create it", "/a/create", "POST"), ("List", "/a/list", "GET")]
    params = X.markdown_params(manual.where("pos = 1"), key="pos", text_col="section")
    tree = X.schema_tree(params, key="pos").orderBy("ord").collect()
    assert [(r["name"], r["type"], r["indent"]) for r in tree] == [("a", "object", 0), ("b", "integer", 1)]
    assert tree[1]["parent"] == tree[0]["ord"]


def test_event_rows_round_trip(spark):
    rows = spark.createDataFrame([("e", "t", "X", "s", '{"k": "1"}', 1.5, None)], "event_id string, trace_id string, event_type string, source string, content string, timestamp double, level string")
    events = R.event_from_row(rows)
    assert events.first()["content"] == {"k": "1"} and events.first()["level"] == "INFO"
    assert R.event_to_row(events).first()["timestamp"] == 1.5


def test_validation_and_scenarios(spark):
    rows = spark.createDataFrame([("a@b.co", 5), (None, 50), ("bad", None)], "mail string, n int")
    got = P.validate_columns(rows, {"mail": {"required": True, "pattern": "email"}, "n": {"max": 10}, "gone": {"required": True}}).collect()
    assert [r["errors"] for r in got] == [{"gone": "required"}, {"mail": "required", "n": "too large", "gone": "required"}, {"mail": "bad format", "gone": "required"}]
    paths = spark.createDataFrame([(1, ["a", "b", "c"])], "path_id int, path array<string>")
    built = P.validate_scenario(P.build_scenarios(paths, ["normal", "exception"], 2)).collect()
    assert len(built) == 4 and all(r["is_valid"] and r["score"] == 1.0 for r in built)
    assert {r["injection_step"] for r in built} == {None, 1}
    lost = P.validate_scenario(P.build_scenarios(paths, ["exception"]).withColumn("injection_step", F.lit(None).cast("int"))).first()
    assert lost["issues"] == ["no injection point"] and not lost["is_valid"] and lost["score"] == 0.0
    hosts = spark.createDataFrame([("::1",), ("fe80::1%eth0",), ("2001:db8::ff00:42:8329",), ("1:2:3:4:5:6:7:8",), ("1::2::3",), ("12345::",)], "ip string")
    assert [r["errors"] for r in P.validate_columns(hosts, {"ip": {"pattern": "ipv6"}}).collect()] == [{}, {}, {}, {}, {"ip": "bad format"}, {"ip": "bad format"}]


def test_keywords_and_typos(spark):
    rows = spark.createDataFrame([("k", "The end, the END. An id; to be: of it!"), ("k", "id? end")], "key string, text string")
    assert [(r["word"], r["n"]) for r in M.keywords(rows, key="key", text="text", k=2).orderBy("rank").collect()] == [("end", 3), ("id", 2)]
    texts = spark.createDataFrame([(i, "some words to disturb here") for i in range(40)] + [(40, "one"), (41, ""), (42, "a b c")], "item_id long, text string")
    typos = {r["item_id"]: r["variant"] for r in M.perturb(texts, id_col="item_id", text_col="text").where("kind = 'typo'").collect()}
    assert typos[40] == "one" and typos[41] == "" and typos[42] == "a b c" and len(set(typos.values())) > 8
    for i in range(40):
        changed = [(a, b) for a, b in zip("some words to disturb here".split(), typos[i].split(), strict=True) if a != b]
        assert len(changed) <= 1 and all(sorted(a) == sorted(b) for a, b in changed)
