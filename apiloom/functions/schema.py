"""Small vectorised helpers for nested API descriptions."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JSON_TYPES = {"string": "string", "str": "string", "int": "integer", "integer": "integer", "long": "integer", "number": "number", "double": "number", "float": "number", "boolean": "boolean", "bool": "boolean", "array": "array", "list": "array", "object": "object"}


def html_unescape(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return run(text)


def flatten(schema: dict) -> list[tuple[str, str, str, str]]:
    """(name, path, type, description) of every property; `a.b` for objects, `a[].b` for arrays. A stack, not recursion."""
    out: list[tuple[str, str, str, str]] = []
    stack = [("", schema)]
    while stack:
        prefix, node = stack.pop()
        if not isinstance(node, dict):
            continue
        if node.get("type") == "array" or "items" in node:
            stack.append((f"{prefix}[]", node.get("items") or {}))
            continue
        below = []
        for name, child in (node.get("properties") or {}).items():
            child = child if isinstance(child, dict) else {}
            path = f"{prefix}.{name}" if prefix else name
            out.append((name, path, str(child.get("type", "string")), str(child.get("description", ""))))
            below.append((path, child))
        stack += reversed(below)
    return out


def flatten_schema(rows: DataFrame, *, key: str, schema_col: str) -> DataFrame:
    """(key, ord, name, path, type, description): the fields of each JSON Schema; text that is not JSON has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for k, text in zip(pdf[key], pdf[schema_col], strict=True):
                try:
                    fields = flatten(json.loads(text)) if text else []
                except ValueError:
                    fields = []
                made += [(k, i, *f) for i, f in enumerate(fields)]
            yield pd.DataFrame(made, columns=[key, "ord", "name", "path", "type", "description"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, schema_col).mapInPandas(run, f"`{key}` {kind}, ord int, name string, path string, type string, description string")


def names_in(schema: object, deep: int = 3) -> set[str]:
    """Lower-cased property names of a schema: its own, those of array items and of allOf, anyOf and oneOf parts."""
    if not isinstance(schema, dict) or deep < 0:
        return set()
    properties = schema.get("properties")
    out = {str(name).lower() for name in properties} if isinstance(properties, dict) else set()
    parts = [schema.get("items")] if schema.get("type") == "array" else []
    for key in ("allOf", "anyOf", "oneOf"):
        parts += schema[key] if isinstance(schema.get(key), list) else []
    for part in parts:
        out |= names_in(part, deep - 1)
    return out


def field_names(schemas: Column) -> Column:
    """The names of all schemas (an array of JSON texts), sorted; text that is not JSON has none."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(texts) -> list[str]:
            found: set[str] = set()
            for t in texts if texts is not None else []:
                try:
                    found |= names_in(json.loads(t)) if t else set()
                except ValueError:
                    pass
            return sorted(found)

        return s.map(one)

    return run(F.coalesce(schemas, F.array().cast("array<string>")))


def leaf_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"\."), -1), r"\[\]", "")


def paths_compatible(a: Column, b: Column) -> Column:
    """Two field paths are compatible when they end in the same field."""
    return leaf_name(a) == leaf_name(b)


def markdown_params(sections: DataFrame, *, key: str, text_col: str) -> DataFrame:
    """Rows of the Markdown tables of a section: (key, ord, name, description, type, indent). The first two rows of a
    table are its head; the type stands last, or before the schema in tables of five and more columns; the indent counts
    the leading `&emsp;`."""
    line = sections.select(key, F.posexplode(F.split(text_col, "\n")).alias("ord", "line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = line.select(key, "ord", cells.alias("c")).where(~F.col("c")[0].rlike("^:?-{2,}") & ~F.col("c")[0].isin("参数名称", "name", "Name"))
    kinds = F.create_map(*[F.lit(x) for kv in JSON_TYPES.items() for x in kv])
    kind = F.lower(F.regexp_replace(F.coalesce(F.try_element_at("c", F.when(F.size("c") >= 5, -2).otherwise(-1)), F.lit("")), r"\(.*", ""))
    indent = (F.length(F.col("c")[0]) - F.length(F.regexp_replace(F.col("c")[0], "&emsp;", ""))) / 6
    return rows.select(key, "ord", F.regexp_replace(F.col("c")[0], "&emsp;", "").alias("name"), F.try_element_at("c", F.lit(2)).alias("description"), F.coalesce(kinds[kind], F.lit("string")).alias("type"), indent.cast("int").alias("indent"))


def schema_tree(params: DataFrame, *, key: str) -> DataFrame:
    """Adds `parent`: the last earlier row of the section with a smaller indent. A section is one endpoint's tables."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        stack: list[tuple[int, int]] = []
        parents = []
        for o, indent in zip(pdf["ord"], pdf["indent"], strict=True):
            while stack and stack[-1][1] >= indent:
                stack.pop()
            parents.append(stack[-1][0] if stack else None)
            stack.append((o, indent))
        return pdf.assign(parent=pd.array(parents, dtype="Int32"))

    kind = params.schema[key].dataType.simpleString()
    return params.groupBy(key).applyInPandas(run, f"`{key}` {kind}, ord int, name string, description string, type string, indent int, parent int")
