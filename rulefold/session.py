"""Session helpers: table access and the shared folder for checkpoints and written results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by the session; a temporary one only in local mode."""
    folder = _setting(spark, "spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="rulefold-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/rulefold/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Folder:
    """The file system of a path, through Spark's own configuration."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.system = self.of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.of(path))

    def names(self, path: str) -> list[str]:
        """Names of what lies in a folder; none if there is no such folder."""
        return sorted(f.getPath().getName() for f in self.system.listStatus(self.of(path))) if self.exists(path) else []

    def claim(self, path: str) -> bool:
        """Create an empty file, which of several writers only one succeeds in."""
        return self.system.createNewFile(self.of(path))

    def move(self, source: str, target: str) -> None:
        if not self.system.rename(self.of(source), self.of(target)):
            raise FileExistsError(target)

    def remove(self, path: str) -> None:
        self.system.delete(self.of(path), True)
