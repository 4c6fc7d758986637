"""Column functions over API descriptions, names, prompts and responses. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
ACTION_VERBS = ["sync", "batch", "export", "import", "upload", "download", "create", "update", "delete", "get", "list", "search", "query", "fetch", "save", "remove", "add", "modify"]
HTTP_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
NOISE_SEGMENTS = ["api", "v1", "v2", "v3", "rest", "service", "json", "xml", "do", "action", "controller", "endpoint", "resource"]
ACTION_SEGMENTS = [
    "list", "page", "export-excel", "get", "create", "update", "delete", "add", "remove", "query", "search", "find", "detail", "info",
    "time-summary", "summary", "dashboard-time-summary", "bill-time-summary", "order-time-summary", "update-status",
]
CANONICAL_RULES = [
    (["userid", "uid"], "USER_ID"),
    (["orderid"], "ORDER_ID"),
    (["productid", "pid"], "PRODUCT_ID"),
    (["token", "accesstoken"], "TOKEN"),
    (["email"], "EMAIL"),
    (["phone", "mobile"], "PHONE"),
    (["address"], "ADDRESS"),
    (["time", "date"], "TIMESTAMP"),
    (["amount", "price"], "AMOUNT"),
    (["status", "state"], "STATUS"),
]
ENTITY_SUFFIXES = ["_id", "id", "_key", "key", "_code", "code"]
TRANSFORM_WORDS = [
    ("sign", ["signature", "sign", "hash", "checksum"]),
    ("encrypt", ["encrypted", "cipher", "encoded"]),
    ("aggregate", ["total", "sum", "count", "average"]),
    ("format", ["formatted", "display", "rendered"]),
]
SENSITIVE_WORDS = [
    "delete", "remove", "drop", "truncate", "update", "modify", "edit", "change", "approve", "reject", "audit",
    "payment", "transfer", "refund", "password", "secret", "token", "admin", "privilege", "permission",
]
METHOD_CRUD = {"POST": "create", "GET": "read", "PUT": "update", "PATCH": "update", "DELETE": "delete"}
DEBUG_EVENTS = ["AGENT_THINKING", "TOOL_CALLED", "TOOL_RESULT"]
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[1-9]\d{1,14}$",
    "url": r"^https?://[\w\-]+(\.[\w\-]+)+([\w\-.,@?^=%&:/~+#]*[\w\-@?^=%&/~+#])?$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "ipv6": r"^(([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:((:[0-9a-fA-F]{1,4}){1,6})|:((:[0-9a-fA-F]{1,4}){1,7}|:)|fe80:(:[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}|::(ffff(:0{1,4}){0,1}:){0,1}((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])|([0-9a-fA-F]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(25[0-5]|(2[0-4]|1{0,1}[0-9]){0,1}[0-9]))$",
    "uuid": r"^[0-9a-fA-F]{8}\-[0-9a-fA-F]{4}\-[0-9a-fA-F]{4}\-[0-9a-fA-F]{4}\-[0-9a-fA-F]{12}$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "hex_color": r"^#([A-Fa-f0-9]{6}|[A-Fa-f0-9]{3})$",
}


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def first_of(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """CASE over ordered (condition, value) pairs."""
    out = F.lit(otherwise)
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def normalize_path(path: Column) -> Column:
    """Ids in a path become parameters: UUIDs first, then numbers."""
    uuid = F.regexp_replace(path, "(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/{uuid}")
    return F.regexp_replace(uuid, r"/\d+", "/{id}")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith("{"))


def action_verb(operation_id: Column) -> Column:
    low = F.lower(operation_id)
    return first_of([(low.startswith(v), F.lit(v)) for v in ACTION_VERBS])


def clean_description(text: Column) -> Column:
    """Without tags and with single blanks; placeholders become empty. Entities are decoded by `html_unescape`."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(text.isNull() | F.lower(text).isin("no description", "none", "n/a"), "").otherwise(bare)


def path_anchor(path: Column, tags: Column) -> Column:
    """The last segment that names an entity; else the first tag; else `unknown`."""
    bare = F.regexp_replace(path, r"\.(do|json|xml)$", "")
    kept = F.filter(
        F.split(bare, "/"),
        lambda s: (s != "")
        & ~s.startswith("{")
        & ~s.startswith(":")
        & ~F.lower(s).isin(NOISE_SEGMENTS)
        & ~s.rlike("^[0-9]+$")
        & ~F.lower(s).isin(ACTION_SEGMENTS),
    )
    last = F.regexp_replace(F.lower(F.try_element_at(kept, F.lit(-1))), "^[-_]+|[-_]+$", "")
    tag = F.try_element_at(tags, F.lit(1))
    return F.coalesce(F.when(last != "", last), F.when(tag != "AutoGenerated", F.lower(tag)), F.lit("unknown"))


def operation_type(path: Column, method: Column) -> Column:
    p, m = F.lower(path), F.upper(method)
    has = p.contains
    return first_of(
        [
            (has("/create") | (m == "POST"), F.lit("create")),
            (has("/update") | m.isin("PUT", "PATCH"), F.lit("update")),
            (has("/delete") | (m == "DELETE"), F.lit("delete")),
            (has("/page"), F.lit("page")),
            (has("/list"), F.lit("list")),
            (has("/get") | has("/{id}") | (m == "GET"), F.lit("get")),
        ],
        "other",
    )


def is_write(path: Column, method: Column) -> Column:
    p = F.lower(path)
    return F.upper(method).isin("POST", "PUT", "PATCH") | p.contains("/create") | p.contains("/update")


def is_read(path: Column, method: Column) -> Column:
    p = F.lower(path)
    return (F.upper(method) == "GET") | p.contains("/get") | p.contains("/list") | p.contains("/page")


def crud(method: Column) -> Column:
    return first_of([(F.upper(method) == m, F.lit(c)) for m, c in METHOD_CRUD.items()])


def bare_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[_-]", "")


def canonical_entity(name: Column) -> Column:
    bare = bare_name(name)
    return first_of([(_any([bare.contains(w) for w in words]), F.lit(entity)) for words, entity in CANONICAL_RULES])


def entity_variations(entity: Column) -> Column:
    """The name, its parts, without separators, and its other number; empty parts are left out."""
    other = F.when(entity.endswith("s"), F.substr(entity, F.lit(1), F.length(entity) - 1)).otherwise(F.concat(entity, F.lit("s")))
    every = F.concat(F.array(entity, F.regexp_replace(entity, "[-_]", ""), other), F.split(entity, "[-_]"))
    return F.array_distinct(F.filter(every, lambda v: v != ""))


def entity_keys(field: Column) -> Column:
    """(position of the suffix, name without it) for each suffix that the field name ends with."""
    low = F.lower(field)
    found = [F.when(low.endswith(s), F.struct(F.lit(i).alias("ord"), F.substr(low, F.lit(1), F.length(low) - len(s)).alias("key"))) for i, s in enumerate(ENTITY_SUFFIXES)]
    return F.array_compact(F.array(*found))


def name_similarity(a: Column, b: Column) -> Column:
    x, y = bare_name(a), bare_name(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when(longest > 0, 1.0 - F.levenshtein(x, y) / longest).otherwise(0.0)


def detect_transformation(source_type: Column, target_name: Column, target_type: Column, target_description: Column) -> Column:
    name, text = F.lower(target_name), F.lower(F.coalesce(target_description, F.lit("")))
    pairs = [(_any([name.contains(w) | text.contains(w) for w in words]), F.lit(kind)) for kind, words in TRANSFORM_WORDS]
    pairs.append(((source_type == "array") & (target_type != "array"), F.lit("aggregate")))
    pairs.append((source_type != target_type, F.lit("convert")))
    return first_of(pairs)


def classify_match(score: Column, threshold: float = 0.7) -> Column:
    return F.when(score >= 0.9, "CERTAIN").when(score >= threshold, "PROBABLE").when(score >= 0.5, "WEAK")


def api_text(verb: Column, description: Column, summary: Column, operation_id: Column, path: Column, tags: Column, segments: Column, method: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    body = F.coalesce(blank(description), blank(summary), F.concat_ws(" ", operation_id, path))
    return F.concat_ws(" ", F.array_repeat(verb, 3) if verb is not None else F.array(), body, tags, segments, method)


def is_sensitive(name: Column, path: Column, method: Column) -> Column:
    n, p = F.lower(F.coalesce(name, F.lit(""))), F.lower(path)
    return _any([n.contains(w) | p.contains(w) for w in SENSITIVE_WORDS]) | F.upper(method).isin("DELETE", "PUT", "PATCH")


def task_level(agents: Column) -> Column:
    """Number of distinct systems (the part of an agent id before `__`), from 1 to 4."""
    systems = F.array_distinct(F.transform(agents, lambda a: F.split_part(a, F.lit("__"), F.lit(1))))
    return F.least(F.lit(4), F.greatest(F.lit(1), F.size(systems)))


def token_estimate(text: Column, divisor: int = 4, rounding: str = "ceil") -> Column:
    n = F.char_length(text) / divisor
    return (F.ceil(n) if rounding == "ceil" else F.floor(n)).cast("long")


def agent_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[agent:([^\]]+)\]"), F.lit(1))


def parse_samples(response: Column) -> Column:
    """(input, output) of the lines that hold exactly one `|||`."""
    lines = F.transform(F.split(response, "\n"), lambda x: F.split(x, r"\|\|\|"))
    return F.transform(F.filter(lines, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(p[0]).alias("input"), F.trim(p[1]).alias("output")))


def parse_score(response: Column) -> Column:
    """The first number before `|||`, on a scale of ten, as 0 to 1."""
    head = F.split_part(response, F.lit("|||"), F.lit(1))
    number = F.regexp_extract(head, r"(\d+(?:\.\d+)?)", 1).try_cast("double") / 10
    return F.when(number.isNotNull(), F.least(F.lit(1.0), number))


def first_line(response: Column) -> Column:
    return F.coalesce(F.trim(F.try_element_at(F.filter(F.split(response, "\n"), lambda x: F.trim(x) != ""), F.lit(1))), F.lit(""))


def is_correct(response: Column, expected: Column, strict: bool = False) -> Column:
    """First line (or its first word) equals the expected answer, or contains it; only equality when strict."""
    line, want = F.lower(first_line(response)), F.lower(F.trim(expected))
    if strict:
        return line == want
    return (line == want) | (F.split_part(line, F.lit(" "), F.lit(1)) == want) | line.contains(want)


def render_prompt(*parts: Column) -> Column:
    """The parts that are not blank, with an empty line between them."""
    return F.concat_ws("\n\n", *[F.when(F.trim(p) != "", p) for p in parts])


def sanitize_string(text: Column, length: int, allowed: str = r"[^\w\s.,-]") -> Column:
    return F.substring(F.regexp_replace(F.trim(text), allowed, ""), 1, length)


def event_family(kind: Column) -> Column:
    return (
        F.when(kind.startswith("TASK_") | kind.startswith("SUBTASK_"), "task")
        .when(kind.isin(DEBUG_EVENTS), "debug")
        .when(kind.startswith("AGENT_"), "agent")
        .when(kind.startswith("DATA_"), "data")
        .otherwise("other")
    )


def api_hash(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def response_agents(response: Column) -> Column:
    """Agent ids that a response names: a JSON array of strings, else its snake_case words. Known ids are a later semi-join."""
    listed = F.from_json(F.regexp_extract(response, r"(\[[^\]]*\])", 1), "array<string>")
    return F.array_distinct(F.coalesce(listed, F.regexp_extract_all(response, F.lit(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), F.lit(1))))


def parse_action(response: Column) -> Column:
    """The word after `Action:`; FINISH when the response says that it ends."""
    word = F.regexp_extract(response, r"(?m)^\s*Action:\s*([A-Za-z0-9_]+)", 1)
    return F.when(F.upper(word).isin("FINISH", "DONE", "END"), "FINISH").when(word != "", word)


def primary_entity(schema: Column, anchor: Column) -> Column:
    """The entity that a response schema names by `$ref` or `title` (of its items for arrays), else the anchor."""
    get = lambda p: F.get_json_object(schema, p)
    ref = F.element_at(F.split(F.coalesce(get("$.items.$ref"), get("$['items']['$ref']"), get("$['$ref']"), get("$.items.title"), get("$.title")), "/"), -1)
    name = F.lower(F.regexp_replace(ref, "(?i)(dto|vo|entity|model|response|request)+$", ""))
    return F.coalesce(F.when(name != "", name), anchor)
