"""Samples, strategies, greedy paths, associations and ROUGE against plain versions."""

import math
import random
from collections import Counter

import pytest

from apiloom.operators import capability as C
from apiloom.operators import graph as G
from apiloom.operators import metrics as M
from apiloom.operators import profile as P
from apiloom.operators import select as S


def test_a_sample_repeats_and_moves_with_its_seed(spark):
    rows = spark.range(500).toDF("id").repartition(7)
    one, again, other = ({r["id"] for r in S.sample_n(rows.coalesce(k), 40, id_col="id", seed=s).collect()} for k, s in ((1, 1), (5, 1), (3, 2)))
    assert one == again and len(one) == 40 and one != other
    assert 100 < sum(one) / 40 < 400 and S.sample_n(rows.where("id < 3"), 40, id_col="id").count() == 3


def test_strategies_follow_progress(spark):
    rng = random.Random(2)
    rows = [("r", i, k, f"{rng.choice('abc')} {rng.choice('xyz')} w{k}", rng.random()) for i in range(10) for k in range(6)]
    frame = spark.createDataFrame(rows, "run string, iteration int, idx int, prompt string, score double")
    got = {}
    for r in S.adaptive_select(frame, 10, 2).collect():
        got.setdefault(r["iteration"], []).append((r["rank"], r["strategy"], r["idx"]))
    assert sorted(got) == list(range(10))
    for i, picks in got.items():
        assert [p[:2] for p in sorted(picks)] == [(k, "diversity" if i < 3 else "ucb" if i < 7 else "top_k") for k in (1, 2)]
        if i >= 7:
            best = sorted((r for r in rows if r[1] == i), key=lambda r: -r[4])[:2]
            assert [p[2] for p in sorted(picks)] == [r[2] for r in best]


def follow(edges, path, longest, cut=-1.0):
    while len(path) < longest:
        best = min(((-s, b) for a, b, s in edges if a == path[-1] and b not in path and s > cut), default=None)
        if best is None:
            break
        path = [*path, best[1]]
    return path


def test_greedy_paths_against_plain_steps(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(12)]
    edges = sorted({(a, b): rng.choice([0.55, 0.65, 0.75, 0.9]) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(26)) if a != b}.items())
    edges = [(a, b, s) for (a, b), s in edges]
    frame = spark.createDataFrame(edges, "src string, dst string, score double")
    got = sorted(r["path"] for r in G.greedy_paths(spark.createDataFrame([(n,) for n in nodes], "node string"), frame).collect())
    assert got == sorted(p for n in nodes if len(p := follow(edges, [n], 5)) >= 2)
    entity = {n: f"e{i % 3}" for i, n in enumerate(nodes)}
    members = spark.createDataFrame(list(entity.items()), "node string, entity string")
    crossed = sorted(r["path"] for r in C.cross_entity_paths(frame, members).collect())
    want = {tuple(follow(edges, [a, b], 4, 0.6)) for a, b, s in edges if s > 0.7 and entity[a] != entity[b]}
    assert crossed == sorted(map(list, want))


def test_associations_against_plain_counts(spark):
    rng = random.Random(4)
    rows = [(x := rng.randrange(4), x * 2 + rng.randrange(2), rng.randrange(4)) for _ in range(400)] + [(None, 1, 1)]
    frame = spark.createDataFrame(rows, "a int, b int, c int")
    got = {(r["a"], r["b"]): r["mi"] for r in P.association_skeleton(frame, ["a", "b", "c"], bins=4, least=-1.0).collect()}
    points = {c: [sorted(r[i] for r in rows if r[i] is not None)[max(0, math.ceil(q * sum(r[i] is not None for r in rows) / 4) - 1)] for q in (1, 2, 3)] for i, c in enumerate("abc")}
    cells = [tuple(sum(r[i] > p for p in points[c]) for i, c in enumerate("abc")) for r in rows if None not in r]
    for (x, i), (y, j) in ((("a", 0), ("b", 1)), (("a", 0), ("c", 2)), (("b", 1), ("c", 2))):
        n, both, one, two = len(cells), Counter((r[i], r[j]) for r in cells), Counter(r[i] for r in cells), Counter(r[j] for r in cells)
        assert got[x, y] == pytest.approx(sum(k / n * math.log(k * n / (one[u] * two[v])) for (u, v), k in both.items()), abs=1e-5)
    strong = P.association_skeleton(frame, ["a", "b", "c"], bins=4, least=0.3)
    assert got["a", "b"] > 0.5 and [(r["a"], r["b"]) for r in strong.collect()] == [("a", "b")]


def test_rouge_of_words_and_pairs(spark):
    pairs = [("the cat sat on the mat", "The cat the mat"), ("a b c d", "d c b a"), ("", "x"), (None, None), ("one two two", "two two two one")]
    got = [r["s"] for r in spark.createDataFrame(pairs, "r string, h string").select(M.rouge("r", "h").alias("s")).collect()]
    for (ref, hyp), s in zip(pairs, got, strict=True):
        a, b = (ref or "").lower().split(), (hyp or "").lower().split()
        for n, name in ((1, "rouge_1"), (2, "rouge_2")):
            x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
            shared = sum((x & y).values())
            want = (0.0, 0.0, 0.0) if not shared else (2 * shared / (x.total() + y.total()), shared / y.total(), shared / x.total())
            assert tuple(s.asDict()[c] for c in M.ROUGE if c.startswith(name)) == pytest.approx(want)
