"""Table profiles, column rules, mappings, scenarios and row validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apiloom.functions.text import PATTERNS


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, column_count, has_data): one union of one-row aggregates, counted together."""
    rows = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")) for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("has_data", F.col("row_count") > 0)


def column_roles(columns: DataFrame) -> DataFrame:
    """technical, hidden_logic or business, by the column's name."""
    c = F.lower("column_name")
    hidden = c.isin("is_deleted", "deleted", "del_flag", "status", "state", "tenant_id", "org_id")
    technical = c.rlike("(_id|_no|_sn|_pk|key)$") | c.isin("id", "sn", "pk", "created_at", "updated_at", "create_time", "update_time")
    return columns.withColumn("role", F.when(hidden, "hidden_logic").when(technical, "technical").otherwise("business"))


def mapping_summary(mappings: DataFrame) -> DataFrame:
    """Tables of each relation type with their business and hidden columns."""
    return mappings.groupBy("relation_type").agg(
        F.count("*").alias("tables"), F.sum(F.size("business")).alias("business_columns"), F.sum(F.size("hidden")).alias("hidden_columns")
    )


def hidden_filters(mappings: DataFrame) -> DataFrame:
    """Each hidden column with the tables that have it."""
    return mappings.select("table_name", F.explode("hidden").alias("column_name")).groupBy("column_name").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def validate_columns(rows: DataFrame, rules: dict[str, dict], *, allow_extra: bool = True) -> DataFrame:
    """Adds `errors`: a map from column to what is wrong. Rules: required, min_length, max_length, min, max, pattern (a
    name or an expression), one_of, check (a function from Column to boolean Column)."""
    parts: list[Column] = []
    for name, rule in rules.items():
        c = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        there = c.isNotNull()
        tests: list[tuple[Column, str]] = []
        if rule.get("required"):
            tests.append((~there, "required"))
        if "min_length" in rule:
            tests.append((there & (F.char_length(c.cast("string")) < rule["min_length"]), "too short"))
        if "max_length" in rule:
            tests.append((there & (F.char_length(c.cast("string")) > rule["max_length"]), "too long"))
        if "min" in rule:
            tests.append((there & (c < rule["min"]), "too small"))
        if "max" in rule:
            tests.append((there & (c > rule["max"]), "too large"))
        if "pattern" in rule:
            tests.append((there & ~c.cast("string").rlike(PATTERNS.get(rule["pattern"], rule["pattern"])), "bad format"))
        if "one_of" in rule:
            tests.append((there & ~c.isin(rule["one_of"]), "not allowed"))
        if "check" in rule:
            check: Callable[[Column], Column] = rule["check"]
            tests.append((there & ~check(c), "failed check"))
        said = F.lit(None).cast("string")
        for condition, text in reversed(tests):
            said = F.when(condition, text).otherwise(said)
        parts += [F.lit(name), said]
    extra = [] if allow_extra else [c for c in rows.columns if c not in rules]
    for name in extra:
        parts += [F.lit(name), F.lit("unknown column")]
    return rows.withColumn("errors", F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull()))


def validate_scenario(scenarios: DataFrame) -> DataFrame:
    """Adds issues, warnings, is_valid and score; scenarios have title, description, steps, expected_outcome,
    scenario_type, path and injection_step (null when none)."""
    missing = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"missing {c}")) for c in ("title", "description", "expected_outcome", "scenario_type")]
    missing.append(F.when(F.col("steps").isNull() | (F.size("steps") == 0), F.lit("missing steps")))
    exception = F.col("scenario_type") == "exception"
    missing.append(F.when(exception & F.col("injection_step").isNull(), F.lit("no injection point")))
    issues = F.array_compact(F.array(*missing))
    warnings = F.array_compact(
        F.array(
            F.when(F.size("steps") != F.size("path"), F.lit("step count")),
            F.when(exception & (F.col("injection_step") >= F.size("path")), F.lit("injection outside the path")),
        )
    )
    rows = scenarios.withColumn("issues", issues).withColumn("warnings", warnings).withColumn("is_valid", F.size("issues") == 0)
    bonus = F.when(F.length("description") > 50, 0.1).otherwise(0.0) + F.when(F.size("steps") > 2, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.1 * F.size("warnings") + bonus))
    return rows.withColumn("score", F.round(F.when(F.col("is_valid"), score).otherwise(0.0), 6))


def scenario_statistics(validated: DataFrame) -> DataFrame:
    """For each type: scenarios, their paths, how many are valid, all issues and warnings, and the mean score."""
    return validated.groupBy("scenario_type").agg(
        F.count("*").alias("scenarios"),
        F.countDistinct("path_id").alias("paths"),
        F.count_if("is_valid").alias("valid"),
        F.sum(F.size("issues")).alias("issues"),
        F.sum(F.size("warnings")).alias("warnings"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


def build_scenarios(paths: DataFrame, kinds: list[str], count: int = 1) -> DataFrame:
    """`count` scenarios of each kind for each path (path_id, path): title, steps, and the middle step for exceptions."""
    each = paths.withColumn("scenario_type", F.explode(F.array(*map(F.lit, kinds)))).withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(count))))
    middle = F.when(F.col("scenario_type") == "exception", F.floor(F.size("path") / 2).cast("int"))
    return each.select(
        "path_id",
        "path",
        "scenario_type",
        "number",
        F.concat_ws(" ", "scenario_type", F.lit("flow over"), F.size("path").cast("string"), F.lit("calls")).alias("title"),
        F.concat(F.lit("Calls "), F.array_join("path", ", then ")).alias("description"),
        F.transform("path", lambda x, i: F.concat_ws(" ", F.lit("Step"), (i + 1).cast("string"), x)).alias("steps"),
        F.when(F.col("scenario_type") == "exception", "error is handled").otherwise("all calls succeed").alias("expected_outcome"),
        middle.alias("injection_step"),
    )


def association_skeleton(rows: DataFrame, columns: list[str], *, bins: int = 8, least: float = 0.1) -> DataFrame:
    """(a, b, mi): pairs of columns whose mutual information over quantile bins exceeds the cut-off.

    Bins come from approximate quantiles, so no global sort or window is needed; pair counts are one grouping."""
    points = rows.select(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(c) for c in columns]).first()
    binned = {c: sum([(F.col(c) > F.lit(p)).cast("int") for p in points[c]], F.lit(0)) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = rows.dropna(subset=columns).select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), binned[a].alias("x"), binned[b].alias("y")) for a, b in pairs])).alias("p")).select("p.*")
    cell = each.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy("a", "b", *k))
    term = F.col("n") / w() * F.ln(F.col("n") * w() / (w("x") * w("y")))
    return cell.withColumn("t", term).groupBy("a", "b").agg(F.round(F.sum("t"), 6).alias("mi")).where(F.col("mi") > least)


def capability_entities(capabilities: DataFrame) -> DataFrame:
    """Each capability's entity with its distinct fields and paths; capabilities with neither are dropped."""
    rows = capabilities.groupBy("capability").agg(F.array_sort(F.collect_set("field")).alias("fields"), F.array_sort(F.collect_set("path")).alias("paths"))
    return rows.where((F.size("fields") > 0) | (F.size("paths") > 0))
