"""Small pieces that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from apiloom.session import cut, ensure_checkpoint_dir

__all__ = ["BLANKS", "cut", "discard", "documents", "ensure_checkpoint_dir", "in_batches", "set_aside", "slices", "words_of", "written"]

#: White space of the word rule: words are the runs of other bytes.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared checkpoint folder and read it back: columns can then be pruned."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that `written` made, once nothing reads them any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


BATCH_BYTES = 8 << 20


def in_batches(rows: DataFrame, run, schema: str) -> DataFrame:
    """`mapInArrow`. Where the session has no Arrow batch limit of its own, 8 MB is set, so that a worker's memory does
    not follow the length of texts."""
    conf = rows.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def set_aside(rows: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with columns of these names moved out of the way, and a function that restores the columns as they were."""
    clash = [c for c in rows.columns if c.lower() in names]
    moved = rows.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    return moved, lambda out: out.drop(*clash).withColumnsRenamed({f"__own_{c}": c for c in clash}).select(*rows.columns)


def words_of(text: str) -> list[bytes]:
    """Words of a text as UTF-8: bytes.split() cuts at exactly the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about `limit` bytes of the text column (a longer row stands alone)."""
    for batch in batches:
        lengths = batch.column(text).nbytes
        if lengths <= limit:
            if batch.num_rows:
                yield batch
            continue
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)
