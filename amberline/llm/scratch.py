"""Intermediate tables in the folder that the cluster shares.

A saved table cuts lineage, survives lost executors and is read by any of them.
The folder is the one that ``spark.checkpoint.dir`` names; only where that is unset
(a local session, as in tests) one is made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark removes the shuffle files of a statement when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder, from the session; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="amberline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables of one run of one operator; ``drop`` removes those no longer needed.

    What a lazy result still reads stays until the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(_remove, spark, self.base)

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read again."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._amberline_path = path
        return out

    def clear(self) -> None:
        """Remove all tables of this run."""
        _remove(self.spark, self.base)

    def drop(self, *saved: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for df in saved:
            _remove(self.spark, df._amberline_path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
