"""Tables that cut lineage and outlive any executor.

Iterative operators write each round here instead of caching it: a lost executor then costs a task, never a round. The folder is the one the
cluster names in ``spark.checkpoint.dir``; a folder of our own is used only where that is unset (tests, local runs).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="vecstrand-"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = f"file://{_own[0]}"
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one run of one operator, under a folder of its own. tidy: a table's shuffle files go as soon as it is written, not
    when the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.tidy = tidy
        self.spark, self.root = spark, f"{shared_dir(spark)}/vecstrand/{name}-{uuid.uuid4().hex}"
        self._n = 0
        # What a query leaves for its reader goes when the session ends.
        where = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """by: a column whose values get a folder each."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            if self.tidy:
                self.spark.conf.set(_CLEANUP, "true")
            df.write.parquet(path, partitionBy=by)
        finally:
            if self.tidy:
                self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vecstrand_path = path
        return out

    def uri(self, df: DataFrame) -> str:
        """Where a saved table lies, for readers other than Spark."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(df._vecstrand_path)
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
        return f"file://{found.getPath()}" if found.getScheme() == "file" else found.toString()

    def free(self, *frames: DataFrame | None) -> None:
        """Removes tables that nothing will read again."""
        for df in frames:
            path = getattr(df, "_vecstrand_path", None)
            if path and path.startswith(self.root):
                _remove(self.spark, path)

    def exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
