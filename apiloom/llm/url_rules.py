"""URL rules as a sort-merge range join, with built-in functions only.

A rule is (host, path, action); it fits its host and all subdomains when the path starts with the rule's path. The labels of
a host in reverse, each with its dot, turn "this host and its subdomains" into one interval of keys, [key, next prefix). Pages
are swept by that key: sorted with the two ends of every interval, a running height and the last start at each height are
the stack of open rule hosts, nested as the intervals are. A page meets each open host once more with its path behind
it, and the same sweep over (host, path) intervals gives the innermost path rule on top of the stack. The longest rule wins.

A sweep runs in ranges of the sorted pages, and the rules open where a range begins are carried into it; pages of one host
are dealt over as many ranges as they fill, so a third of all pages on one host is many parts. Only the first and last key
of each range reach the driver.

Defined results: a null url or one without `://` has an empty host and path, no rule, and the default verdict; of rules
with one host and path the blocking one holds; equal lengths go to the longer host; repeated rows each keep a row;
no rules or no pages give the default verdict or an empty result; other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apiloom.llm.common import cut, documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: (host, path, action).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def next_prefix(key: Column) -> Column:
    """The smallest byte string above all strings that start with the key (its last byte is never 0xFF in UTF-8)."""
    data = key.cast("binary")
    last = F.conv(F.hex(F.substring(data, -1, 1)), 16, 10).cast("int") + 1
    digits = F.hex(data)
    return F.unhex(F.concat(F.substr(digits, F.lit(1), F.length(digits) - 2), F.lpad(F.hex(last), 2, "0")))


def _depth(rules: DataFrame, key: Column, outer: Column) -> int:
    """How many distinct keys contain each other at most: `outer` lists the keys that would enclose a rule's key."""
    keys = rules.select(key.alias("key")).distinct()
    around = rules.select(key.alias("inner"), F.explode(outer).alias("key")).distinct()
    return around.join(keys, "key").groupBy("inner").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def open_at(probes: DataFrame, intervals: DataFrame, depth: int, parts: int | None = None) -> DataFrame:
    """The probes (rid, key, ...) with `stack`: the values of the intervals (key, value) that are open at their key, outermost first.

    Probes are sorted into ranges, equal keys dealt on by row, so that one hot key is many ranges. An interval is [key, next
    prefix); its two ends go to each range that it touches, which carries in what is open where the range begins. In a range,
    ends and probes are sorted together; a running sum of +1 and -1 is the height of the stack, and the last start seen at
    each height up to it is the stack. Prefix intervals are nested or apart, at most `depth` deep.
    """
    n = parts or int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut(probes.repartitionByRange(n, "key", F.xxhash64("rid")).withColumn("pid", F.spark_partition_id()))
    bounds = sorted(tuple(r) for r in sorted_.groupBy("pid").agg(F.min("key"), F.max("key")).collect())  # a row a range
    nothing = F.lit(None).cast(intervals.schema["value"].dataType)
    if not bounds or not depth:
        return sorted_.drop("pid").withColumn("stack", F.array().cast(f"array<{intervals.schema['value'].dataType.simpleString()}>"))
    numbers, lows, highs = (F.array(*[F.lit(x) for x in side]) for side in zip(*bounds, strict=True))
    stop = next_prefix(F.col("key"))
    first = F.size(F.filter(highs, lambda x: x < F.col("key")))
    after = F.size(F.filter(lows, lambda x: x < F.col("stop")))
    touched = intervals.withColumn("stop", stop).withColumn("pids", F.slice(numbers, first + 1, F.greatest(after - first, F.lit(0))))
    ends = F.array(F.struct("key", F.lit(1).alias("kind"), "value"), F.struct(F.col("stop").alias("key"), F.lit(-1).alias("kind"), nothing.alias("value")))
    events = touched.select(F.explode("pids").alias("pid"), ends.alias("ends")).select("pid", F.inline("ends"))
    held = [c for c in sorted_.columns if c not in ("pid", "key")]
    rows = sorted_.select("pid", "key", F.lit(2).alias("kind"), nothing.alias("value"), F.struct(*held).alias("probe")).unionByName(events, allowMissingColumns=True)
    sweep = Window.partitionBy("pid").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("height", F.coalesce(F.sum(F.when(F.col("kind") < 2, F.col("kind"))).over(sweep), F.lit(0)))
    level = [F.last(F.when((F.col("kind") == 1) & (F.col("height") == k), F.col("value")), ignorenulls=True).over(sweep).alias(f"open{k}") for k in range(1, depth + 1)]
    rows = rows.select("*", *level).where("kind = 2")
    return rows.select("probe.*", "key", F.slice(F.array(*[f"open{k}" for k in range(1, depth + 1)]), F.lit(1), F.col("height").cast("int")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each page. `parts`: ranges of a sweep, else the shuffle partitions."""
    host, path = url_parts(F.col(url_col))
    pages = cut(pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path")))
    rules = rules.groupBy("host", "path").agg(F.max_by("action", F.col("action") == "block").alias("action"))
    host_key = lambda c: F.concat(reversed_host(c), F.lit(".")).cast("binary")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: host_key(F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    hosts = rules.select("host").distinct()
    deep = _depth(hosts, host_key(F.col("host")), suffixes)
    on = open_at(pages.withColumn("key", host_key(F.col("host"))), hosts.select(host_key(F.col("host")).alias("key"), F.col("host").alias("value")), deep, parts)

    rule_key = lambda h, p: F.concat(reversed_host(h), F.lit(".\0"), p).cast("binary")
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: rule_key(F.col("host"), F.substr("path", F.lit(1), i)))
    each = on.where("host != ''").select("rid", "id", "host", "path", F.explode_outer("stack").alias("on"))
    each = each.unionByName(on.where("host = ''").select("rid", "id", "host", "path", F.lit(None).cast("string").alias("on")))
    value = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "action")
    deep = _depth(rules, rule_key(F.col("host"), F.col("path")), prefixes)
    found = open_at(each.withColumn("key", F.coalesce(rule_key(F.col("on"), F.col("path")), F.lit("").cast("binary"))), rules.select(rule_key(F.col("host"), F.col("path")).alias("key"), value.alias("value")), deep, parts)
    top = F.try_element_at("stack", F.lit(-1))
    best = found.groupBy("rid").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(top).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url under the five rules."""
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in RULES])))
    return judge_urls(documents(spark, sf_dir, "pages"), rules)


OP9_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
