"""Shared-folder snapshots: materialised tables and versioned stores with an atomic pointer."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.wherry.localShared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = "file://" + tempfile.mkdtemp(prefix="wherry-")
        spark.conf.set("spark.wherry.localShared", base)
    return f"{base.rstrip('/')}/wherry-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and no executor holds the only copy."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedStore:
    """Tables in numbered version folders; the pointer file with the largest number names the current version.

    A commit writes every table of the new version first and renames its pointer into place last, so readers see
    all of a version or none of it, and an older pointer stays until the new one is there.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        pointers = sorted(n for n in names if n.startswith("pointer-"))
        if not pointers:
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{pointers[-1]}").collect()))

    def read(self, name: str) -> DataFrame:
        now = self.current()
        if now is None:
            raise FileNotFoundError(f"{self.root} has no committed version")
        return self.spark.read.parquet(f"{self.root}/v{now['version']}/{name}")

    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None) -> int:
        now = self.current()
        version = (now["version"] if now else 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        state = (now or {}).get("meta", {}) | (meta or {})
        temporary, final = self._path(f"{self.root}/_next-{uuid.uuid4().hex}"), self._path(f"{self.root}/pointer-{version:012d}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"version": version, "meta": state}).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise RuntimeError(f"version {version} was committed by someone else")
        return version

    def require(self, **expected) -> None:
        """Raise if the current version's metadata differ: content version, model name, vector size."""
        meta = (self.current() or {}).get("meta", {})
        wrong = {k: (meta.get(k), v) for k, v in expected.items() if meta.get(k) != v}
        if wrong:
            raise ValueError(f"the store must be rebuilt: {wrong}")


def check_matrix(df: DataFrame, count: int, dim: int, column: str = "embedding") -> None:
    """Raise unless a vector table has ``count`` rows of ``dim`` numbers each."""
    from pyspark.sql import functions as F

    n, low, high = df.agg(F.count("*"), F.min(F.size(column)), F.max(F.size(column))).first()
    if n != count or (n and (low != dim or high != dim)):
        raise ValueError(f"{n} vectors of {low} to {high} numbers; expected {count} of {dim}")
