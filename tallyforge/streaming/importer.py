"""Incremental import of session logs: a file stream whose batches are appended to a versioned table.

Each version is a folder of its own rows and a commit file: its name is the version's number, its one line names the folder. It is only created, never replaced: a batch is there
once that line is, and of two writers of one number the later one fails and may try again. A writer that dies before leaves nothing that a reader sees, or a commit file without a line:
an empty version, after which the next one goes on.
Readers take the commits up to the highest number, or up to one that they name, so what they read doesn't change under them. Contents are kept apart, by their digest. Files that were
imported with the same content are skipped, a changed file gets the next generation, and files that are gone are marked
as missing but kept: both are rows of the new version, nothing is written again.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES_PER_BATCH = 32
SOURCES = "locator string, generation long, fingerprint string, bytes long, available boolean"


class Ledger:
    """Versions of the table of sources in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> dict[int, str]:
        """The folder of each version; the empty string where its writer died."""
        folder = self._path(f"{self.root}/commits")
        found = [f.getPath() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return {int(p.getName()): self._line(p) for p in sorted(found, key=lambda p: p.getName()) if p.getName().isdigit()}

    def _line(self, path) -> str:
        stream = self._fs.open(path)
        try:
            line = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return line[:-1] if line.endswith("\n") else ""

    def revision(self) -> int:
        return max(self._commits(), default=0)

    def sources(self, revision: int | None = None) -> DataFrame:
        """The sources as of a revision, the latest by default: of each generation what was said last."""
        folders = [f"{self.root}/rows/{rows}" for n, rows in self._commits().items() if rows and (revision is None or n <= revision)]
        if not folders:
            return self.spark.createDataFrame([], SOURCES)
        rows = self.spark.read.schema(f"{SOURCES}, revision long").parquet(*folders)
        last = rows.groupBy("locator", "generation").agg(F.max_by(F.struct("fingerprint", "bytes", "available"), "revision").alias("s"))
        return last.select("locator", "generation", "s.*")

    def contents(self) -> DataFrame:
        """fingerprint, content of all generations; what no commit names may be among them."""
        folder = f"{self.root}/contents"
        if not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], "fingerprint string, content binary")
        return self.spark.read.schema("fingerprint string, content binary").option("recursiveFileLookup", "true").parquet(folder).dropDuplicates(["fingerprint"])

    def _commit(self, rows: DataFrame, after: int, name: str) -> int:
        rows.withColumn("revision", F.lit(after).cast("long")).write.parquet(f"{self.root}/rows/{name}")
        path = self._path(f"{self.root}/commits/{after:012d}")
        try:
            stream = self._fs.create(path, False)  # atomic: of two writers one creates it
        except Py4JJavaError as error:
            if not self._fs.exists(path):
                raise
            raise RuntimeError(f"another writer made version {after}; read it and try again") from error
        try:
            stream.write(f"{name}\n".encode())
        finally:
            stream.close()
        return after

    def merge(self, batch: DataFrame) -> bool:
        """Adds a batch of (path, content, and modificationTime if known); whether anything changed."""
        before = self.revision()
        last = self.sources(before).groupBy("locator").agg(F.max_by("fingerprint", "generation").alias("last"), F.max("generation").alias("top"))
        at = F.col("modificationTime") if "modificationTime" in batch.columns else F.lit(None).cast("timestamp")
        own = batch.select(F.col("path").alias("locator"), "content", F.sha2("content", 256).alias("fingerprint"), at.alias("at")).groupBy("locator", "fingerprint").agg(F.min("at").alias("at"), F.first("content").alias("content"))
        joined = own.join(last, "locator", "left").where("last IS NULL OR last != fingerprint")
        rank = F.row_number().over(Window.partitionBy("locator").orderBy("at", "fingerprint"))
        new = joined.select("locator", (F.coalesce("top", F.lit(0)) + rank).cast("long").alias("generation"), "fingerprint", F.length("content").cast("long").alias("bytes"), F.lit(True).alias("available"), "content")
        if new.isEmpty():
            return False
        name = uuid.uuid4().hex
        new.select("fingerprint", "content").write.parquet(f"{self.root}/contents/{name}")
        self._commit(new.drop("content"), before + 1, name)
        return True

    def mark_missing(self, present: DataFrame) -> bool:
        """Marks the files that a listing (path) no longer has, and those that are back; their history stays."""
        before = self.revision()
        here = present.select(F.col("path").alias("locator")).distinct().withColumn("here", F.lit(True))
        after = self.sources(before).join(here, "locator", "left").withColumn("now", F.coalesce("here", F.lit(False))).where("now != available")
        if after.isEmpty():
            return False
        self._commit(after.select("locator", "generation", "fingerprint", "bytes", F.col("now").alias("available")), before + 1, uuid.uuid4().hex)
        return True


def import_stream(spark: SparkSession, folder: str, ledger: Ledger, checkpoint: str, pattern: str = "*.jsonl"):
    """A streaming query that imports what lies in ``folder`` and ends; run again, it only reads what is new."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES_PER_BATCH).load(folder)
    )
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ledger.merge(batch) and None).start()
