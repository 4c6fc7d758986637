"""Bindings of scenario steps and the checks on them."""

from apiloom.operators import scenarios as X


def test_bindings_and_dependencies(spark):
    steps = spark.createDataFrame([(1, 1, "login"), (1, 2, "create"), (1, 3, "get"), (2, 1, "get")], "path_id long, pos int, operation_id string")
    flow = spark.createDataFrame([(1, 2, "token", "login.response.token"), (1, 2, "kind", "fixed")], "path_id long, pos int, name string, source string")
    inputs = spark.createDataFrame([("login", "Email"), ("login", "userName"), ("login", "pin"), ("create", "email"), ("get", "orderId"), ("get", "orderId")], "operation_id string, name string")
    got = {(r["path_id"], r["pos"], r["name"]): (r["type"], r["value"]) for r in X.parameter_bindings(steps, flow, inputs).collect()}
    assert got == {
        (1, 1, "Email"): ("fake_data", "{{fake_email}}"),
        (1, 1, "userName"): ("fake_data", "{{fake_name}}"),
        (1, 2, "token"): ("dynamic_ref", "{login.response.token}"),
        (1, 2, "kind"): ("static", "fixed"),
        (1, 3, "orderId"): ("dynamic_ref", "{create.response.id}"),
    }
    assert {(r["path_id"], r["operation_id"], r["depends_on"]) for r in X.dependency_map(steps).collect()} == {(1, "create", "login"), (1, "get", "create")}


def test_warnings(spark):
    steps = spark.createDataFrame([(1, 1, "login"), (1, 2, "create"), (1, 3, "drop")], "path_id long, pos int, operation_id string")
    bindings = spark.createDataFrame([(1, "gone", "a", "static", "x"), (1, "create", "b", "dynamic_ref", "login.id"), (1, "create", "c", "dynamic_ref", "{login.id}"), (1, "create", "d", "dynamic_ref", None)], "path_id long, operation_id string, name string, type string, value string")
    assert sorted(r["warning"] for r in X.binding_warnings(bindings, steps).collect()) == ["binding for unknown step: gone", "reference without braces: b", "reference without braces: d"]
    apis = spark.createDataFrame([("login", "GET", "/Auth/login", "log in"), ("create", "POST", "/order", "Create order"), ("drop", "DELETE", "/order", "Delete order")], "operation_id string, method string, path string, summary string")
    scenarios = spark.createDataFrame([(1, "normal", "We create order one", None), (1, "exception", None, "Success")], "path_id long, scenario_type string, description string, expected_outcome string")
    got = sorted((r["scenario_type"], r["warning"]) for r in X.coverage_warnings(scenarios, steps, apis).collect())
    assert got == [("exception", "exception with a success"), ("exception", "write not described: create"), ("normal", "login not described"), ("normal", "write not described: drop")]
