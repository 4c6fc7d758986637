"""Average linkage by rounds of mutual closest pairs against the plain algorithm."""

import random

import numpy as np
import pytest

from apiloom.operators import apis as A


def plain_linkage(points, weights, least):
    """Merge the closest pair until none reaches the cut-off; the first in order of names of equal ones."""
    groups = [([i], weights[i]) for i in range(len(points))]
    sim = lambda x, y: round(sum(weights[i] * weights[j] * float(points[i] @ points[j]) for i in x[0] for j in y[0]) / (x[1] * y[1]), 12)
    while True:
        best = max(((sim(x, y), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), default=(0, 0, 0))
        if best[0] < least:
            return groups
        i, j = -best[1], -best[2]
        groups[i] = (groups[i][0] + groups[j][0], groups[i][1] + groups[j][1])
        del groups[j]


def plain_clusters(rows, least):
    out = {}
    for entity in {r[1] for r in rows}:
        keys = {}
        for op, e, method, fields in rows:
            if e == entity:
                keys.setdefault((tuple(sorted(set(fields))), method.upper()), []).append(op)
        order = sorted(keys, key=lambda k: min(keys[k]))
        names = sorted({f for k in order for f in k[0]})
        methods = sorted({k[1] for k in order})
        x = np.zeros((len(order), 1 + len(names) + len(methods)))
        for i, (fields, method) in enumerate(order):
            x[i, 0] = 0.5
            for f in fields:
                x[i, 1 + names.index(f)] = 0.4 / len(fields)
            x[i, 1 + len(names) + methods.index(method)] = 0.1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for members, _ in plain_linkage(x, [len(keys[k]) for k in order], least):
            ops = [op for m in members for op in keys[order[m]]]
            out |= dict.fromkeys(ops, (min(ops), "entity" if len(ops) > 1 else "atomic"))
    return out


@pytest.mark.parametrize(("least", "block"), [(0.85, 500), (0.85, 7), (0.93, 10), (0.6, 10)])
def test_clusters_equal_the_plain_linkage(spark, least, block):
    rng = random.Random(int(least * 100) + block)
    names = [f"f{i}" for i in range(9)]
    rows = []
    for i in range(70):
        entity = "hot" if rng.random() < 0.9 else f"e{rng.randrange(3)}"
        rows.append((f"o{i:03}", entity, rng.choice(["GET", "post", "PUT"]), rng.sample(names, rng.choice([0, 1, 1, 2, 3, 5]))))
    frame = spark.createDataFrame(rows, "operation_id string, entity string, method string, fields array<string>")
    got = {r["operation_id"]: (r["cluster"], r["cluster_type"]) for r in A.entity_clusters(frame, similarity=least, block=block).collect()}
    assert got == plain_clusters(rows, least)


def test_clusters_of_no_rows(spark):
    frame = spark.createDataFrame([], "operation_id string, entity string, method string, fields array<string>")
    assert A.entity_clusters(frame).collect() == []
    with pytest.raises(ValueError, match="405"):
        A.entity_clusters(frame, similarity=0.4)
