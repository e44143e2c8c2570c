"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing Parquet below
``spark.checkpoint.dir``: the files outlive any executor, unlike cached blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master, whose tasks share the driver's disk, may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Named tables of one operator run, each written once and read back.

    Tables that a returned DataFrame still reads are deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/quern/{name}-{uuid.uuid4().hex}"
        path = self._hadoop(self.base)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            path = self._hadoop(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Files:
    """Small files and folders below a path, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        """What is in a folder, in order; nothing if there is no such folder."""
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all: written aside, then renamed."""
        aside, at = self._path(f"{name}.tmp"), self._path(name)
        self.fs.mkdirs(at.getParent())
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(at, False)
        if not self.fs.rename(aside, at):
            raise OSError(f"cannot write {at}")

    def read(self, name: str) -> str | None:
        """The text of a file; None if there is none."""
        at = self._path(name)
        if not self.fs.exists(at):
            return None
        held = self.fs.open(at)
        try:
            return bytes(held.readAllBytes()).decode()
        finally:
            held.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
