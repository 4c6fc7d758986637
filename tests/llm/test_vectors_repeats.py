"""Vector codes, bit-plane clusters and repeated passages against plain versions, with nulls, ties and odd rows."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from apiloom.llm.bitplane_clusters import OP12_SQL, cluster_vectors, dots, nearest, norms, pack, unpack
from apiloom.llm.cover_dedup import COVERS, cover_of, without_repeats
from apiloom.llm.entry import ORACLE_SQL, QUERIES
from apiloom.llm.vector_codes import Codebook, decode, encode_vectors


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_centroid_clusters", "op13_substring_dedup"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    assert sorted(map(tuple, QUERIES[name](spark, sf).select(names).collect())) == want


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for top in (1, 5, 300, 1 << 27):
        x, y = rng.integers(-top, top, (20, 64)), rng.integers(-3 * top // 2, top, (7, 64)).clip(-(1 << 27), None)
        assert (unpack(pack(x)) == x).all()
        assert (dots(pack(x), pack(y)) == x @ y.T).all() and (norms(pack(x)) == (x * x).sum(axis=1)).all()
        which, far = nearest(pack(x), pack(y), (y * y).sum(axis=1))
        gaps = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
        assert (which == gaps.argmin(axis=1)).all() and (far == gaps.min(axis=1)).all()


@pytest.mark.parametrize("top", [2, 40, 3000, 1 << 24])
def test_equal_average_search_is_exact(top):
    rng = np.random.default_rng(top)
    for n, m, w in ((700, 256, 16), (50, 3, 4), (600, 200, 1), (5, 1, 16)):
        x, c = rng.integers(-top, top + 1, (n, w)), rng.integers(-top, top + 1, (m, w))
        which, best = Codebook(c).nearest(x)
        gaps = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (which == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()


def odd_vectors(n, size, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(size)], i % 3, "x", 1) for i in range(n)]
    rows += [(0, rows[0][1], None, "x", 1), (n, rows[1][1], None, "x", 1), (None, rows[2][1], 1, "x", 1)]
    rows += [(n + 1, None, 1, "x", 1), (n + 2, [None] * size, 1, "x", 1), (n + 3, [math.nan] * size, 1, "x", 1), (n + 4, [math.inf] * size, 1, "x", 1)]
    rows += [(n + 5, [0.5] * (size - 1), 1, "x", 1), (n + 6, [], 1, "x", 1), (n + 7, [1e30] * size, 2, "x", 1)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label long, code string, cluster int"


def plain_clusters(rows, k, rounds):
    limit = math.isqrt((2**63 - 1) // 256)
    kept = [(i, [max(-limit, min(limit, math.floor(256 * x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        best = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(kept, best, strict=True) if b == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i is None, i or 0), j, d) for (i, _), (d, j) in zip(kept, best, strict=True)), centroids


def test_clusters_of_odd_rows(spark):
    rows = odd_vectors(60, 64)
    got, centroids = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), k=7, rounds=3)
    want, plain = plain_clusters(rows, 7, 3)
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in got.collect()) == want
    assert centroids.tolist() == plain
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert len(cluster_vectors(few, k=40)[0].collect()) == 3
    assert cluster_vectors(few.where("vec_id > 9"), k=40)[0].collect() == []


def plain_codes(rows, parts, entries, rounds, size):
    width = size // parts
    limit = math.isqrt((2**63 - 1) // (4 * size * width))
    kept = [(i, [max(-limit, min(limit, math.floor(1024 * x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    for r in range(rounds + 1):
        best = [[min((far(cut(v, p), c), j) for j, c in enumerate(books[p])) for p in range(parts)] for _, v in kept]
        if r < rounds:
            for p, j in itertools.product(range(parts), range(len(first))):
                own = [cut(v, p) for (_, v), b in zip(kept, best, strict=True) if b[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i is None, i or 0), "".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b)) for (i, _), b in zip(kept, best, strict=True)), books


def test_codes_of_odd_rows(spark):
    rows = odd_vectors(50, 8)
    got, books = encode_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), keep=["label"], entries=9, rounds=3)
    found = got.collect()
    want, plain = plain_codes(rows, 4, 9, 3, 8)
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["code"], r["error"]) for r in found if r["code"]) == want
    assert [b.tolist() for b in books] == plain
    assert sorted(r["vec_id"] for r in found if r["code"] is None) == [55, 56]  # of another length: kept, without a code
    assert got.columns == ["vec_id", "label", "code", "error"]
    code = next(r["code"] for r in found if r["code"])
    assert len(decode(code, books)) == 8
    assert encode_vectors(spark.createDataFrame(rows, SCHEMA).where("vec_id > 999"))[0].collect() == []


def test_covers_meet_every_shift():
    for period, members in COVERS.items():
        for gap in range(period):
            assert any((a - b) % period == gap for a in members for b in members)
    for window in (1, 2, 5, 12, 50, 400):
        period, _, length = cover_of(window)
        assert length >= 1 and period - 1 + length <= window


def plain_repeats(rows, window):
    words = {}
    for n, (i, text) in enumerate(rows):
        words[n] = (i, [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w])
    first = {}
    for i, ws in words.values():
        if i is not None:
            for s in range(len(ws) - window + 1):
                key = tuple(ws[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words.values():
        gone = {s + j for s in range(len(ws) - window + 1) if i is not None and first[tuple(ws[s : s + window])] < i for j in range(window)}
        out.append(((i is None, i or 0), len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [1, 2, 5, 12, 50])
@pytest.mark.parametrize("most", [0, 1000])
def test_repeats_against_brute_force(spark, window, most):
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(3 if window < 12 else 300)}"
    shared = [[word() for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, window + 3))]
        rows.append((i if rng.random() < 0.95 else rng.randrange(60), rng.choice([" ", "\n", "\t ", "\x0b"]).join(ws)))
    rows += [(None, rows[3][1]), (None, rows[4][1]), (70, None), (71, ""), (72, "  \n"), (5, rows[5][1]), (5, rows[5][1]), (73, rows[5][1]), (74, "same " * 4 * window), (75, "same " * 3 * window), (76, "Same " * 3 * window), (77, "a b " * 2 * window), (78, "a b " * 2 * window)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = without_repeats(docs, window=window, max_broadcast=most)
    assert got.columns == ["doc_id", "text", "kept", "n_words", "n_removed"]
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == plain_repeats(rows, window)


def test_repeats_of_an_empty_table_and_a_long_text(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(200_000)))), (2, "x " + " ".join(map(str, range(100, 150_100)))), (3, "é " * 60)], "doc_id long, text string")
    assert without_repeats(docs.where("doc_id > 5")).collect() == []
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in without_repeats(docs).collect()} == {1: (200_000, 0), 2: (150_001, 150_000), 3: (60, 0)}
    names = spark.createDataFrame([("b", "u v w x"), ("a", "v w x y")], "doc_id string, text string")
    assert {r["doc_id"]: r["kept"] for r in without_repeats(names, window=3).collect()} == {"a": "v w x y", "b": "u"}


def test_sql_names_all_rounds():
    assert all(f"a{i} AS" in OP12_SQL for i in range(6))
