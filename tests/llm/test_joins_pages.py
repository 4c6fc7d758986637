"""The Jaccard join, page extraction, WARC derivatives and the pipeline."""

import base64
import hashlib
import html
import random
import re

from apiloom.llm import html_extraction as H
from apiloom.llm import jaccard_join as J
from apiloom.llm import warc_derivatives as W
from apiloom.llm.components import components
from apiloom.llm.html_dom import parse


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k))) for k, (i, s) in enumerate(sets)), key=repr)


def got(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=repr)


def documents(seed, groups=12, members=6, long_list=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno") + rng.choice("pqrst")
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, members)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy += passage
            rows.append((n, " ".join(copy)))
            n += 1
    base = [word() for _ in range(80)]
    for _ in range(long_list):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        if rng.random() < 0.3:
            copy[rng.randrange(80)] = word()
            copy[rng.randrange(80)] = word()
        rows.append((n, " ".join(copy)))
        n += 1
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    rows = documents(1) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (None, "one two"), (905, "x"), (905, "x")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    assert got(J.jaccard_components(frame)) == brute_components(rows)
    assert got(J.jaccard_components(frame, broadcast_nodes=0)) == brute_components(rows)


def test_long_lists_are_resolved_exactly(spark):
    rows = documents(2, groups=4, long_list=60)
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_components(rows)


def test_frequent_tokens_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 2)
    rows = documents(3, groups=10, long_list=25)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.jaccard_components(frame)) == brute_components(rows)
    assert got(J.jaccard_components(frame, waiting=2)) == brute_components(rows)


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(7)
    ids = [rng.getrandbits(64) - 2**63 for _ in range(500)]
    links = list(zip(ids[:400], ids[1:400], strict=False)) + [(ids[400], x) for x in ids[401:480]] + [(ids[480], ids[481]), (ids[481], ids[480]), (ids[490], ids[490])]
    want = {x: min(part) for part in (ids[:400], ids[400:480], ids[480:482]) for x in part}
    frame = spark.createDataFrame(links, "a long, b long")
    for in_task in (0, 50, 100_000):
        assert sorted(map(tuple, components(frame, in_task=in_task).collect())) == sorted(want.items())
    assert components(frame.limit(0)).collect() == []


def test_chain_of_revisions_is_one_component(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2 * 400 + 18)]
    ids = rng.sample(range(10_000), 400)
    rows = [(i, " ".join(words[2 * k : 2 * k + 20])) for k, i in enumerate(ids)]
    out = got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {c for _, _, c in out} == {min(ids)} and out == brute_components(rows)


def test_empty_and_all_alone(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert got(J.jaccard_components(frame)) == [(1, 2, 1), (2, 2, 2)]
    assert got(J.jaccard_components(frame.limit(0))) == []


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert got(J.op7_jaccard_join(spark, sf)) == brute_components([tuple(r) for r in docs.collect()])


def article(page):
    inside = page[page.index("<article>") + 9 :].split("</article>")[0]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else "", inside)).split())


def test_main_text_of_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = H.op10_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_pages_labelled_by_hand_and_odd_pages(spark):
    model = H.train([])
    first = model.extract(H.LABELLED_PAGES[0])
    assert first.startswith("A long walk") and "cookies" not in first and "Great walk" not in first and "Buy shoes" not in first
    odd = [None, "", "   ", "plain text", "<p", "<article>" * 300, "<article><p>a &amp; b<br>c<p>d &#233;</article>", "<script>var x='<p>';", "<a '" * 2000]
    assert all(isinstance(model.extract(p), str) for p in odd)
    frame = spark.createDataFrame([(i, p, "u", "t") for i, p in enumerate(odd)] + [(None, None, None, None)], "page_id long, html string, url string, text string")
    assert H.extract_text(frame, model).count() == len(odd) + 1
    assert H.extract_text(frame.limit(0), model).count() == 0
    assert H.fit(frame.limit(0).select("page_id", "html")).weights


def test_messages_match_enumeration():
    import itertools
    import math

    rng = random.Random(4)
    parent = [-1, 0, 0, 1, 1, 2, 5]
    own = [rng.uniform(-2, 2) for _ in parent]
    pair = [[math.exp(rng.uniform(-1, 1)) for _ in (0, 1)] for _ in (0, 1)]
    total, ones = 0.0, [0.0] * len(parent)
    for y in itertools.product((0, 1), repeat=len(parent)):
        w = math.exp(sum(o for o, v in zip(own, y, strict=True) if v))
        for i in range(1, len(parent)):
            w *= pair[y[parent[i]]][y[i]]
        total += w
        ones = [o + w * v for o, v in zip(ones, y, strict=True)]
    _, full, _ = H._messages(parent, own, pair)
    assert all(abs(H._sigmoid(f) - o / total) < 1e-9 for f, o in zip(full, ones, strict=True))


def test_tree_reader_closes_what_html_closes():
    tree = parse("<ul><li>a<li>b</ul><p>c<div>d</div><table><tr><td>e<td>f<tr><td>g</table><!-- <p>x</p> --><style>p{}</style>h")
    assert [("".join(p)) for _, p in tree.blocks] == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert tree.tags.count("li") == 2 and tree.tags.count("td") == 3


def test_attributes_of_any_length():
    long = "x>" * 25_000
    tree = parse(f"<div><p>a<img src='{long}'>b</p><aside class=\"k\" data-state=\"{long}\">c</aside>d</div>e<!{long[:1] * 9000}>f")
    assert ["".join(p) for _, p in tree.blocks] == ["ab", "c", "d", "ef"] and "aside" in tree.tags
    assert tree.attributes[tree.tags.index("aside")].startswith(' class="k"')
    fields = W.metadata_fields(f'<html data-x="{long}" lang="de"><a data-y="{long}" href="/z">l</a></html>', "", "d")
    assert ("language", "de") in fields and ("outlink", "/z") in fields
    texts = lambda page: ["".join(p) for _, p in parse(page).blocks]
    assert texts("<p>it<b 'tis>a</b> isn't</p><p title=\"x>b</p>c<!-- d") == ["ita isn't", "b", "c"]
    assert texts("<p>a<!-- b <i>c</i> d") == ["a"]
    assert texts("<a" * 100_000) == ["<a" * 100_000] and len(texts("<a x=\">\" " * 100_000)) <= 1


def test_warc_records_refer_to_their_response(spark, tmp_path):
    page = "<html lang='de'><title>T &amp; x</title><p>Ein <b>Satz</b>.<a href='/a b'>L</a></html>"
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX: y\r\n", page, 1), ("<urn:uuid:2>", None, None, None, None, 2), ("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX: y\r\n", page, 1)]
    frame = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_header string, payload string, block int")
    out = W.build_derivatives(frame)
    got = out.collect()
    assert len(got) == 6
    digest = lambda t: "sha1:" + base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    for r in got:
        assert r["block_digest"] == digest(r["block"]) and r["content_length"] == len(r["block"].encode())
        assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["headers"] and r["record_id"] != r["refers_to"]
    meta = next(r for r in got if r["record_type"] == "metadata" and r["target_uri"])
    text = next(r for r in got if r["record_type"] == "conversion" and r["target_uri"])
    assert meta["payload_digest"] == text["payload_digest"] == digest(page)
    assert "http-header: X: y" in meta["block"] and "title: T & x" in meta["block"] and "language: de" in meta["block"] and "outlink: /a b" in meta["block"]
    assert text["block"] == "T & x\nEin Satz.L"
    path = str(tmp_path / "warc")
    W.write_warc(out.coalesce(1), path)
    import glob

    data = open(glob.glob(path + "/part*")[0], newline="").read()
    records = []
    while data:
        head, rest = data.split("\r\n\r\n", 1)
        n = int(re.search(r"Content-Length: (\d+)", head)[1])
        body = rest.encode()[:n]
        records.append(body.decode())
        data = rest.encode()[n + 4 :].decode()
    assert sorted(records) == sorted(r["block"] for r in got)
    assert W.build_derivatives(frame.limit(0)).count() == 0


def test_warc_nulls_and_line_breaks():
    page = "<title>a</title><p>b</p>"
    for made in (W.derivatives(None, "http://a/\r\nX: y", None, "", page), W.derivatives(None, None, None, "", page)):
        for r in made:
            assert "None" not in r[7] and "WARC-Date" not in r[7] and "WARC-Refers-To:" not in r[7] and "\r\nX:" not in r[7]
    ids = {r[1] for u, d, p in ((None, None, "a"), (None, None, "b"), ("u", None, "a"), (None, "d", "a")) for r in W.derivatives(None, u, d, "", p)}
    assert len(ids) == 8


def test_warc_outlinks_are_elements():
    page = """<!--[if IE]><html lang="xx"><![endif]--><html lang="en"><script>var a = '<a href="/script">';</script><!-- <a href="/comment"> -->
    <template><a href="/template">t</a></template><a href="/one">1</a><p><A HREF = '/two'>2</A></p><a name="none">n</a></html>"""
    fields = W.metadata_fields(page, "", "d")
    assert [v for k, v in fields if k == "outlink"] == ["/one", "/two"] and ("language", "en") in fields


def test_warc_query_over_the_whole_table(spark, sf):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.links, self.title, self.lang, self.text, self.silent, self.tag = [], "", None, [], 0, ""

        def handle_starttag(self, tag, attrs):
            self.tag = tag
            self.silent += tag in ("script", "style")
            if tag == "a" and dict(attrs).get("href"):
                self.links.append(" ".join(dict(attrs)["href"].split()))
            if tag == "html":
                self.lang = dict(attrs).get("lang")

        def handle_endtag(self, tag):
            self.silent -= tag in ("script", "style")
            self.tag = ""

        def handle_data(self, data):
            if self.tag == "title":
                self.title += data
            if not self.silent:
                self.text.append(data)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = W.op6_warc_derivatives(spark, sf).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in rows) == sorted((i, k) for i in pages for k in ("conversion", "metadata"))
    digest = lambda t: "sha1:" + base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    for r in rows:
        page = pages[r["page_id"]]
        plain = Plain()
        plain.feed(page["html"])
        assert r["target_uri"] == page["url"] and r["payload_digest"] == digest(page["html"]) and r["block_digest"] == digest(r["block"])
        if r["record_type"] == "metadata":
            lines = [x.split(": ", 1) for x in r["block"].strip().split("\r\n")]
            assert [v for k, v in lines if k == "outlink"] == plain.links
            assert [v for k, v in lines if k == "title"] == [" ".join(plain.title.split())][: bool(plain.title.strip())]
            assert [v for k, v in lines if k == "language"] == [plain.lang][: bool(plain.lang)]
        else:
            assert "".join(r["block"].split()) == "".join("".join(plain.text).split())
    assert len({r["record_id"] for r in rows}) == len(rows)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in out]
    assert ids and len(ids) == len(set(ids)) and all(r["round_trip"] for r in out)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a " * 3, None, None, 6)], docs.schema)
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs.union(odd), sf)
        if name != "tokens":
            assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        got.collect()
        stage(spark, docs.limit(0), sf).collect()


def test_near_duplicates_are_dropped_by_row(spark):
    import corpus_pipeline as pipeline

    text = lambda k, *edits: " ".join(f"w{k}x{i}" if i not in edits else f"e{k}{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (2, text(1, 3)), (3, text(2, 5)), (1, text(1)), (4, text(3)), (None, text(4)), (None, text(4)), (None, text(1)), (5, ""), (5, ""), (6, None), (None, text(5)), (None, text(6))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, text(1)), (1, text(2)), (4, text(3)), (None, text(4)), (5, ""), (5, ""), (6, None), (None, text(5)), (None, text(6))]
    for limit in (1_000_000, 0):
        assert sorted(map(tuple, pipeline.near_duplicates(spark, frame, "", limit).collect()), key=repr) == sorted(want, key=repr)
    unique = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for limit in (1_000_000, 0):
        assert {r["doc_id"] for r in pipeline.near_duplicates(spark, unique, "", limit).collect()} == {0, 1, 5, 6, 9, 10, 11, 12, 13}


def test_stages_keep_columns_that_clash(spark, sf):
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"kept": F.lit("mine"), "n_words": F.lit("own"), "matches": F.lit(7), "id": F.lit(1), "node": F.lit("x"), "spans": F.lit(True)})
    for name, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf)
        assert rows.schema.simpleString() == docs.schema.simpleString(), name
        assert {(r["kept"], r["n_words"], r["matches"], r["spans"]) for r in rows.collect()} == {("mine", "own", 7, True)}, name


def test_batches_are_bounded(spark):
    from apiloom.llm.common import BATCH_BYTES, in_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    in_batches(spark.range(1), lambda it: it, "id long").collect()
    assert spark.conf.get(key) == str(BATCH_BYTES)
    for own in ("1m", "64m"):
        spark.conf.set(key, own)
        in_batches(spark.range(1), lambda it: it, "id long").collect()
        assert spark.conf.get(key) in (own, {"1m": "1048576b", "64m": "67108864b"}[own], own + "b")
    spark.conf.set(key, str(BATCH_BYTES))
