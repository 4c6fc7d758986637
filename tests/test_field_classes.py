"""Field matches between classes of APIs, and with meanings from an embeddings table."""

import random

import pytest

from apiloom.operators import deps as D

NAMES = ["userId", "user_id", "order_id", "orderId", "productId", "email", "totalAmount", "createTime", "status", "plain"]


def fields_of(rng, n, side):
    rows = []
    for i in range(n):
        for name in rng.sample(NAMES, rng.randint(1, 3)):
            rows.append((f"op{i:02}", f"e{i % 3}", name, "string", rng.choice(["path", "query", "body"]) if i % 5 == 0 else side))
    return rows


@pytest.mark.parametrize("meanings", [False, True])
def test_classes_stand_for_all_edges(spark, meanings):
    rng = random.Random(4)
    spec = "operation_id string, entity string, name string, type string, location string"
    req, res = spark.createDataFrame(fields_of(rng, 24, "body"), spec), spark.createDataFrame(fields_of(rng, 24, "path"), spec)
    allowed = spark.createDataFrame([("e0", "e0"), ("e0", "e1"), ("e1", "e2"), ("e2", "e2")], "source string, target string")
    near = spark.createDataFrame([("userId", "user_id", 0.9), ("order_id", "orderId", -0.5), ("email", "email", 1.0)], "name_r string, name_p string, similarity double") if meanings else None
    options = {"threshold": 0.8, "near_fields": near} if meanings else {}
    plain = {(r["src"], r["dst"]): (r["score"], tuple(r["matched"])) for r in D.field_match_dependencies(req, res, allowed, **options).collect()}
    classes, left, right = D.field_match_classes(req, res, allowed, **options)
    of = lambda df: {c: {r["operation_id"] for r in df.collect() if r["class"] == c} for c in {r["class"] for r in df.collect()}}
    sources, targets = of(left), of(right)
    got = {}
    for r in classes.collect():
        pairs = [(a, b) for a in sources[r["src_class"]] for b in targets[r["dst_class"]] if a != b]
        assert len(pairs) == r["edges"]
        got |= dict.fromkeys(pairs, (r["score"], tuple(r["matched"])))
    assert plain and got == plain


def test_meanings_lift_a_pair(spark):
    spec = "operation_id string, entity string, name string, type string, location string"
    req, res = spark.createDataFrame([("a", "e", "uid", "string", "body")], spec), spark.createDataFrame([("b", "e", "user_id", "string", "body")], spec)
    allowed = spark.createDataFrame([("e", "e")], "source string, target string")
    near = spark.createDataFrame([("uid", "user_id", 1.0)], "name_r string, name_p string, similarity double")
    assert D.field_match_dependencies(req, res, allowed, threshold=0.75).collect() == []
    scores = [r["score"] for r in D.field_match_dependencies(req, res, allowed, threshold=0.746, near_fields=near).collect()]
    plain = [r["score"] for r in D.field_match_dependencies(req, res, allowed, threshold=0.6).collect()]
    assert len(scores) <= 1 and (not plain or round(scores[0] - plain[0], 9) == 0.15)
    with pytest.raises(ValueError, match="exact"):
        D.field_match_dependencies(req, res, allowed, near_fields=near)
