"""Shared folders, written tables and file access for the text operators.

Everything that must outlive a task goes below ``spark.checkpoint.dir``: the
driver and every executor see that folder, so a lost executor costs a re-run
of its tasks and never their input.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new, empty place (URI) below the cluster's shared checkpoint folder.

    Without ``spark.checkpoint.dir`` only a local master is accepted (tests):
    there one machine is the whole cluster and a temporary folder will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch, where the session has no setting of its own; Spark's default, of 64 MB, would stand in the JVM and in Python at once, in every task.
BATCH_BYTES, _SPARKS_DEFAULT = "4m", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES, unless they are set already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, _SPARKS_DEFAULT) == _SPARKS_DEFAULT:
        spark.conf.set(key, BATCH_BYTES)


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


#: Rows up to which ``few`` broadcasts; at some hundred bytes each they take some 30 MB.
BROADCAST_ROWS = 200_000


def few(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table (of counted rows), to be broadcast if it is small."""
    return broadcast(table) if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned, once nothing reads them any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared-folder URI and the path inside it (also on executors)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class TaskFile:
    """One output file of one task attempt, visible under its name only when closed well.

    Names carry a fresh id, so a repeated or speculative attempt never touches
    the file of another; readers follow the manifest of committed attempts.
    """

    def __init__(self, folder: str, suffix: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.path = posixpath.join(base, self.name)
        self.uri = f"{folder.rstrip('/')}/{self.name}"
        self._out = self.fs.open_output_stream(f"{self.path}.open", compression=None)
        self.size = 0

    def write(self, data: Any) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()
        self.fs.move(f"{self.path}.open", self.path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
