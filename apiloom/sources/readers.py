"""Sources and sinks: API documents, manuals, agent records, tasks, events and stage results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = "task_id int, level int, prompt string, expected_agents array<string>, domain string, _corrupt_record string"
AGENT_RECORDS = "array<struct<n:struct<properties:map<string,string>>>>"
EVENT_SCHEMA = "event_id string, trace_id string, event_type string, source string, content map<string,string>, timestamp double, level string"


def read_openapi(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, corrupt): one JSON document a file as (doc_id, json); files that are not JSON objects go to corrupt."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("json"))
    good = F.try_parse_json("json").isNotNull() & F.trim("json").startswith("{")
    return raw.where(good), raw.where(~good)


def read_openapi_yaml(spark: SparkSession, path: str) -> DataFrame:
    """YAML documents as (doc_id, json); needs PyYAML on the executors; a broken file has null json."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("yaml"))

    def convert(frames):
        import json

        import yaml

        def load(text):
            try:
                return json.dumps(yaml.safe_load(text), default=str)
            except yaml.YAMLError:
                return None

        for pdf in frames:
            yield pdf.assign(json=pdf["yaml"].map(load))[["doc_id", "json"]]

    return raw.mapInPandas(convert, "doc_id string, json string")


def read_markdown_api(spark: SparkSession, path: str) -> DataFrame:
    """Endpoints of Markdown manuals: (doc_id, pos, title, path, method, content_type, section)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    part = raw.select("doc_id", F.posexplode(F.split("text", r"(?=\*\*接口地址\*\*:)")).alias("pos", "section"), "text")
    head = F.regexp_extract_all(F.try_element_at(F.split("text", r"\*\*接口地址\*\*:"), F.col("pos")), F.lit(r"(?m)^#+ *(.+?) *$"), F.lit(1))
    get = lambda p: F.regexp_extract("section", p, 1)
    return part.where("pos > 0").select(
        "doc_id",
        "pos",
        F.try_element_at(head, F.lit(-1)).alias("title"),
        get(r"\*\*接口地址\*\*: *`?([^`\s]+)").alias("path"),
        F.upper(get(r"\*\*请求方式\*\*: *`?([A-Za-z]+)")).alias("method"),
        get(r"\*\*请求数据类型\*\*: *`?([^`\s]+)").alias("content_type"),
        "section",
    )


def read_agent_records(spark: SparkSession, path: str) -> DataFrame:
    """(agent_id, name, capability, datascope, seq, parent_id) of record files; rows without an id are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "").alias("json"))
    p = raw.select(F.explode(F.from_json("json", AGENT_RECORDS)).alias("r")).select(F.col("r.n.properties").alias("p"))
    get = lambda *names: F.coalesce(*[F.col("p")[n] for n in names])
    rows = p.select(
        get("id", "agent_id").alias("agent_id"),
        get("name").alias("name"),
        get("capability").alias("capability"),
        get("datascope").alias("datascope"),
        get("seq").try_cast("int").alias("seq"),
        get("parent_id", "parentId").alias("parent_id"),
    )
    return rows.where("agent_id IS NOT NULL")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation tasks; rows of a malformed file are left out."""
    return spark.read.schema(TASK_SCHEMA).json(path, multiLine=True, mode="PERMISSIVE").where("_corrupt_record IS NULL").drop("_corrupt_record")


def read_jdbc_tables(spark: SparkSession, url: str, tables: list[str], *, key: str | None = None, parts: int = 8, **options: str) -> dict[str, DataFrame]:
    """Tables to profile. With a numeric `key`, each is read in about `parts` parts of equal row counts, whatever the spread
    of the key: an aggregate query gives its ends, its column alone is read between them for the quantiles, and the parts
    are ranges between those, with null keys in the first."""
    source = lambda table, **more: spark.read.format("jdbc").options(url=url, dbtable=table, **options, **more).load()
    if key is None:
        return {t: source(t) for t in tables}
    return {t: spark.read.jdbc(url, t, predicates=_ranges(source, t, key, parts), properties=options) for t in tables}


def _ranges(source, table: str, key: str, parts: int) -> list[str]:
    """Predicates of parts with about equal counts: one for the rows up to each quantile of the key."""
    low, high, rows = source(f"(SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT({key}) AS n FROM {table}) ends").first()
    if not rows or low == high:
        return ["1 = 1"]
    keys = source(f"(SELECT {key} FROM {table} WHERE {key} IS NOT NULL) keys", partitionColumn=key, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(parts))
    cuts = sorted(set(keys.approxQuantile(keys.columns[0], [i / parts for i in range(1, parts)], 0.1 / parts)) - {float(high)})
    cuts = [int(c) if float(c).is_integer() else c for c in cuts]
    if not cuts:
        return ["1 = 1"]
    return [f"{key} <= {cuts[0]} OR {key} IS NULL", *[f"{key} > {x} AND {key} <= {y}" for x, y in zip(cuts, cuts[1:], strict=False)], f"{key} > {cuts[-1]}"]


def event_from_row(rows: DataFrame) -> DataFrame:
    """Stored event rows (content as JSON, epoch seconds) as typed events; the level falls back to INFO."""
    return rows.select(
        "event_id",
        "trace_id",
        "event_type",
        "source",
        F.from_json("content", T.MapType(T.StringType(), T.StringType())).alias("content"),
        F.timestamp_seconds(F.col("timestamp")).alias("ts"),
        F.coalesce("level", F.lit("INFO")).alias("level"),
    )


def event_to_row(events: DataFrame) -> DataFrame:
    return events.select("event_id", "trace_id", "event_type", "source", F.to_json("content").alias("content"), (F.unix_micros("ts") / 1e6).alias("timestamp"), "level")


def write_results(rows: DataFrame, path: str, *, by: str = "model") -> None:
    """CSV with a head, a folder for each value of `by`. A rerun replaces the folders of its own values only; files are
    written aside and moved when all tasks are done, so a failed run leaves the old ones."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).option("header", True).csv(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A summary has one row for each model and level, so one file holds it."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_stage(rows: DataFrame, path: str, *, kind: str = "parquet") -> None:
    """A stage's rows for the next one, which reads them with the schema they had."""
    rows.write.mode("overwrite").format(kind).save(path)
