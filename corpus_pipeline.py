"""The corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. `run`
writes each stage's result as Parquet in the shared checkpoint folder and gives the file to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import cut, discard, documents, written
from apiloom.llm.decontamination import clean_documents
from apiloom.llm.jaccard_join import jaccard_components, with_node
from apiloom.llm.quality_rules import fit_rules, keep_good
from apiloom.llm.secrets import redact
from apiloom.llm.sentencepiece_sa import encode, model_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep."""
    rules = fit_rules(docs, documents(spark, sf_dir, "labels"))
    return keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """One document of each component: the one with the smallest id (null ids last). Texts without a word stay.

    Where ids are unique and not null, the rows to drop are known by id: broadcast when they are at most `max_broadcast`,
    else joined by a shuffle. Otherwise rows are known by (id, hash of the set), of which one row stays for each component.
    """
    found = cut(jaccard_components(docs, keep_node=True))
    shaky = found.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if shaky.isEmpty():
        gone = cut(found.where("doc_id != component_id").select("doc_id"))
        few = gone.count() <= max_broadcast
        return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("best")
    stays = found.where("component is not null").groupBy("component").agg(best)
    stays = cut(stays.select(F.col("best.doc_id").alias("__id"), F.col("best.node").alias("__node")))
    few = stays.limit(max_broadcast + 1).count() <= max_broadcast
    rows = with_node(docs, "__node", "__n")
    same = (rows["__node"] == stays["__node"]) & rows["doc_id"].eqNullSafe(stays["__id"])
    firsts = rows.where("__n > 0").join(F.broadcast(stays) if few else stays, same, "left_semi").dropDuplicates(["doc_id", "__node"])
    return firsts.unionByName(rows.where("__n = 0")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return clean_documents(docs, documents(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and `n_chars` of the new text where it was set."""
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with the text they decode to."""
    return encode(docs, model_path(), round_trip=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The learned rules and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's file goes once the next one is written; the last one reads what is left."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = written(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
