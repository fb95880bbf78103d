"""Tables in the folder that the driver and all executors share: they cut lineage, so that loops don't grow plans and lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    On one machine it may be unset, as in tests; a temporary folder then serves the session. On a cluster no folder of one machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = getattr(spark, "_tallyforge_shared", None) or tempfile.mkdtemp(prefix="tallyforge-")
        spark._tallyforge_shared = folder
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, each read back as plain Parquet; they are removed when the session's JVM ends, or earlier by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        path, files = self._files(self.root)
        files.mkdirs(path)  # what isn't there can't be registered
        files.deleteOnExit(path)

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in tables:
            path, files = self._files(df._scratch_path)
            files.delete(path, True)
