"""Parameters of scenario steps: where each value comes from, what a step waits for, and checks of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Methods that write.
WRITE_METHODS = ["POST", "PUT", "DELETE", "PATCH"]


def _with_previous(steps: DataFrame) -> DataFrame:
    """The step before on its path; a path is one row group of a few steps."""
    return steps.withColumn("previous", F.lag("operation_id").over(Window.partitionBy("path_id").orderBy("pos")))


def dependency_map(steps: DataFrame) -> DataFrame:
    """(path_id, pos, operation_id, depends_on): each step but the first waits for the one before."""
    return _with_previous(steps).where("previous IS NOT NULL").select("path_id", "pos", "operation_id", F.col("previous").alias("depends_on"))


def parameter_bindings(steps: DataFrame, flow: DataFrame, inputs: DataFrame) -> DataFrame:
    """(path_id, pos, operation_id, name, type, value) of the parameters of steps (path_id, pos, operation_id).

    A step with a flow (path_id, pos, name, source) takes its sources: a dotted one is a dynamic reference, another a static
    value. A step without takes its inputs (operation_id, name): an id refers to the response of the step before, and an email
    or a name is made up; others stay open.
    """
    bound = flow.select("path_id", "pos", "name", "source")
    dotted = F.col("source").contains(".")
    given = steps.join(bound, ["path_id", "pos"]).select(
        "path_id", "pos", "operation_id", "name", F.when(dotted, "dynamic_ref").otherwise("static").alias("type"), F.when(dotted, F.concat(F.lit("{"), "source", F.lit("}"))).otherwise(F.col("source")).alias("value")
    )
    low = F.lower("name")
    by_id = low.contains("id") & F.col("previous").isNotNull()
    kind = F.when(by_id, "dynamic_ref").when(low.contains("email") | low.contains("name"), "fake_data")
    value = F.when(by_id, F.concat(F.lit("{"), "previous", F.lit(".response.id}"))).when(low.contains("email"), "{{fake_email}}").when(low.contains("name"), "{{fake_name}}")
    free = _with_previous(steps).join(bound.select("path_id", "pos").distinct(), ["path_id", "pos"], "left_anti").join(inputs.select("operation_id", "name").distinct().hint("merge"), "operation_id")
    return given.unionByName(free.select("path_id", "pos", "operation_id", "name", kind.alias("type"), value.alias("value")).where("type IS NOT NULL"))


def binding_warnings(bindings: DataFrame, steps: DataFrame) -> DataFrame:
    """(path_id, warning): bindings of operations that the path does not have, and dynamic references without braces."""
    known = steps.select("path_id", "operation_id", F.lit(True).alias("known")).distinct()
    rows = bindings.join(known, ["path_id", "operation_id"], "left")
    lost = rows.where("known IS NULL").select("path_id", F.concat(F.lit("binding for unknown step: "), "operation_id").alias("warning")).distinct()
    bare = (F.col("type") == "dynamic_ref") & ~(F.coalesce("value", F.lit("")).startswith("{") & F.coalesce("value", F.lit("")).endswith("}"))
    return lost.unionByName(rows.where(F.col("known") & bare).select("path_id", F.concat(F.lit("reference without braces: "), "name").alias("warning")))


def coverage_warnings(scenarios: DataFrame, steps: DataFrame, apis: DataFrame) -> DataFrame:
    """(path_id, scenario_type, warning): the first writing step whose summary the description does not have, a description
    that says nothing of the login its path begins with, and an exception whose outcome is a success.

    Scenarios have path_id, scenario_type, description and expected_outcome; apis operation_id, method, path and summary."""
    known = steps.join(apis.select("operation_id", "method", F.lower("path").alias("url"), F.lower("summary").alias("summary")), "operation_id")
    own = scenarios.select("path_id", "scenario_type", F.lower(F.coalesce("description", F.lit(""))).alias("said"), F.lower(F.coalesce("expected_outcome", F.lit(""))).alias("outcome"))
    both = own.join(known, "path_id")
    silent = both.where(F.col("method").isin(WRITE_METHODS) & (F.length("summary") > 3) & ~F.col("said").contains(F.col("summary")))
    first = silent.groupBy("path_id", "scenario_type").agg(F.min_by("operation_id", "pos").alias("o")).select("path_id", "scenario_type", F.concat(F.lit("write not described: "), "o").alias("warning"))
    start = both.join(steps.groupBy("path_id").agg(F.min("pos").alias("pos")), ["path_id", "pos"])
    login = F.col("url").contains("login") | F.col("url").contains("auth")
    told = F.col("said").contains("登录") | F.col("said").contains("login") | F.col("said").contains("认证")
    auth = start.where((F.col("scenario_type") == "normal") & login & ~told).select("path_id", "scenario_type", F.lit("login not described").alias("warning"))
    good = F.col("outcome").contains("成功") | F.col("outcome").contains("success")
    outcome = own.where((F.col("scenario_type") == "exception") & good).select("path_id", "scenario_type", F.lit("exception with a success").alias("warning"))
    return first.unionByName(auth).unionByName(outcome)
