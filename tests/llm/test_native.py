"""Sharding and url rules: plain Spark operators."""

import random
import zlib

from apiloom.llm.sharding import shard_by_bytes
from apiloom.llm.url_rules import RULES, judge_urls

def sharded(spark, rows, **options):
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, other string"), **options).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert len(out) == len(rows)
    return by


def test_near_equal_bytes_and_groups_together(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 200) + str(i % 400), "o") for i in range(3000)]
    by = sharded(spark, rows, shards=8)
    sizes = [sum(len(r["text"]) + 1 for r in rs) for rs in by.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.06 * sum(sizes) / 8
    places = {}
    for s, rs in by.items():
        for r in rs:
            places.setdefault(r["text"], set()).add(s)
    assert all(len(p) == 1 for p in places.values())


def test_hot_group_is_split_by_id(spark):
    rows = [(i, "same text", "o") for i in range(2000)] + [(i, f"text {i:05d}", "o") for i in range(2000, 3000)]
    sizes = [sum(len(r["text"]) + 1 for r in rs) for rs in sharded(spark, rows, shards=8).values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.04 * sum(sizes) / 8 + 22


def test_many_ranges_keep_slots_gapless(spark):
    rows = [(i, f"text {i}", "o") for i in range(1000)]
    assert len(sharded(spark, rows, shards=4, range_bytes=200)) == 4


def test_law_holds_for_repeated_rows_and_null_ids(spark):
    for group in ([(None, None, None)] * 900, [(7, "same text", "o")] * 900):
        rows = group + [(i, f"text {i:05d}", "o") for i in range(100)]
        for options in ({}, {"range_bytes": 40}):
            sizes = [sum(len(r["text"] or "") + 1 for r in rs) for rs in sharded(spark, rows, shards=8, **options).values()]
            assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.04 * sum(sizes) / 8 + 24


def test_columns_of_the_same_names_are_kept(spark):
    frame = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 6)], "doc_id long, text string, shard string, Slot int")
    out = {r["doc_id"]: r for r in shard_by_bytes(frame, shards=2).collect()}
    assert (out[1]["own_shard"], out[2]["own_Slot"]) == ("x", 6) and sorted(r["shard"] for r in out.values()) == [0, 1]


def test_registered_query_against_its_law(spark):
    from apiloom.llm.sharding import op1_sharding

    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_sharding(spark, sf).collect()
    size, slots, places, weight = {}, {}, {}, {}
    for r in rows:
        n = len((texts[r["doc_id"]] or "").encode()) + 1
        assert (r["size"], r["law"], r["grown_shard"]) == (n, "bytes", None)
        size[r["shard"]] = size.get(r["shard"], 0) + n
        slots.setdefault(r["shard"], []).append(r["slot"])
        places.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        weight[texts[r["doc_id"]]] = weight.get(texts[r["doc_id"]], 0) + n
    assert sorted(size) == list(range(8)) and sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    ideal = sum(size.values()) / 8
    heaviest = max(n for n in weight.values() if n <= 0.02 * ideal)
    assert max(size.values()) - min(size.values()) <= 0.004 * ideal + 2 * max(heaviest, max(weight.values()) - 0.02 * ideal)
    assert all(len(p) == 1 for t, p in places.items() if weight[t] <= 0.02 * ideal)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None), (1, None, "a"), (1, "a", "a"), (1, "a", "a"), (2, "", "b"), (3, "long " * 30_000, "c")]
    by = sharded(spark, rows, shards=3)
    assert sum(map(len, by.values())) == 6
    assert sharded(spark, [], shards=3) == {}


def test_extra_columns_and_registered_query(spark, sf):
    from apiloom.llm.sharding import op1_sharding

    rows = op1_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.org", "www.Example.org", "org", "com", "a.b.com", "example.orgs", "x.net", "", "a..org", "EXAMPLE.ORG"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/de/a/b?x=/fr/", "/fr#a", "/ü/é", "/a\U0010ffffb", "?q=/es/"]
    urls = [None, "", "no scheme", "://", "http://", *[f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]]
    rules = [*RULES, ("example.org", "", "block"), ("example.org", "/en/", "allow"), ("b.com", "/de/a", "allow"), ("org", "/a\U0010ffff", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"), parts=7).collect()
    assert len(got) == len(urls)
    again = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"), parts=1).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_url_rules_on_empty_tables_and_repeats(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in judge_urls(pages, rules).collect()] == ["allow"] * 3
    some = spark.createDataFrame(RULES, "host string, path string, action string")
    assert judge_urls(pages.limit(0), some).collect() == []
    assert sorted(r["rule"] or "" for r in judge_urls(pages, some).collect()) == ["", "org/", "org/"]
