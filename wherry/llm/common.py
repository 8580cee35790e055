"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    The setting names the cluster's shared store. Where it is unset, a local session gets a folder of this machine,
    remembered in the session; on a cluster that would be another one on each node, which is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.wherry.localShared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = "file://" + tempfile.mkdtemp(prefix="wherry-")
        spark.conf.set("spark.wherry.localShared", base)
    return f"{base.rstrip('/')}/wherry-{uuid.uuid4().hex}"


#: Folders that this process has written and not deleted, in order.
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def result_of(make) -> DataFrame:
    """The materialised result of ``make()``, whose own intermediate tables are then deleted: nothing reads them any more."""
    before = len(_written)
    made = make()
    out = materialize(made)
    spark, doomed = made.sparkSession, _written[before:-1]
    for path in doomed:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[before:-1] = []
    return out


#: Rows of a few short columns that may be sent to every task; as a hash table they take a few MB.
BROADCAST_ROWS = 1 << 15


def by_size(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a few short columns, as a side of a join: broadcast if it has few rows as counted, else shuffled.

    Left alone, Spark decides by the bytes of compressed files, and takes an exploded row for one row.
    """
    return df.hint("broadcast" if df.count() <= BROADCAST_ROWS else "merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null ids count as bucket 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def partition_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of an Arrow batch that are Python objects at the same time.
PIECE_ROWS = 256


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows each, so that a worker holds few texts as Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
