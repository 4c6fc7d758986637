"""Writers that can run again, reads of a database in even parts, and selections without SQL."""

import random

import pytest

from apiloom.operators import roles as R
from apiloom.sources import readers


def test_a_rerun_replaces_its_own_models_only(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("m1", "t1", 1), ("m1", "t2", 2), ("m2", "t1", 3)], "model string, task string, score int")
    readers.write_results(rows, path)
    readers.write_results(spark.createDataFrame([("m1", "t9", 9)], rows.schema), path)
    got = spark.read.option("header", True).csv(path)
    assert sorted((r["model"], r["task"], r["score"]) for r in got.collect()) == [("m1", "t9", "9"), ("m2", "t1", "3")]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        readers.write_results(rows.selectExpr("model", "task", "1 / (score - 3) AS score"), path)
    assert spark.read.option("header", True).csv(path).count() == 2


def test_summaries_and_stages_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "L1", 0.5), ("m2", None, None)], "model string, level string, rate double")
    readers.write_summary(rows, str(tmp_path / "summary"))
    readers.write_summary(rows, str(tmp_path / "summary"))
    assert len(list((tmp_path / "summary").glob("*.csv"))) == 1
    assert sorted(r["model"] for r in spark.read.option("header", True).csv(str(tmp_path / "summary")).collect()) == ["m1", "m2"]
    for kind in ("parquet", "json"):
        readers.write_stage(rows, str(tmp_path / kind), kind=kind)
        readers.write_stage(rows, str(tmp_path / kind), kind=kind)
        assert sorted(map(tuple, spark.read.schema(rows.schema).format(kind).load(str(tmp_path / kind)).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_database_tables_in_even_parts(spark):
    url = "jdbc:derby:memory:stores;create=true"
    rng = random.Random(1)
    rows = [(int(rng.paretovariate(0.7) * 10), f"n{i}") for i in range(2000)] + [(None, f"x{i}") for i in range(20)]
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    for name, data in (("SKEWED", rows), ("EMPTY", []), ("ONE", [(7, "a"), (7, "b")])):
        spark.createDataFrame(data, "K long, NAME string").write.mode("overwrite").jdbc(url, name, properties=options)
    got = readers.read_jdbc_tables(spark, url, ["SKEWED", "EMPTY", "ONE"], key="K", parts=5, **options)
    assert sorted(map(str, got["SKEWED"].collect())) == sorted(map(str, readers.read_jdbc_tables(spark, url, ["SKEWED"], **options)["SKEWED"].collect()))
    sizes = got["SKEWED"].rdd.mapPartitions(lambda rs: [sum(1 for _ in rs)]).collect()
    assert len(sizes) == 5 and sum(sizes) == 2020 and max(sizes) < 2 * 2020 / 5
    assert got["EMPTY"].collect() == [] and got["ONE"].count() == 2


def test_blueprint_of_little(spark):
    agents = spark.createDataFrame([(1, True), (1, None), (None, False)], "level int, is_virtual boolean")
    none = spark.createDataFrame([], "kind string")
    got = {(r["part"], r["name"]): r["n"] for r in R.blueprint_statistics(agents, spark.createDataFrame([("composed",)], "kind string"), none, none.toDF("type")).collect()}
    assert got == {
        ("agents", "total"): 3, ("agents", "virtual"): 1, ("agents", "real"): 2, ("agents", "level 1"): 2, ("capabilities", "total"): 1, ("capabilities", "composed"): 1,
        ("composition_pattern", "horizontal_reuse"): 0, ("composition_pattern", "vertical_promotion"): 1, ("composition_pattern", "cross_domain"): 0,
    }
