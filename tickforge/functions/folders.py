"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new place below ``spark.checkpoint.dir``; a temporary folder only where one machine is the whole cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: what follows neither recomputes nor loses them."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a stored table that make one part (of events some hundred thousand rows).
PART_BYTES = 2 << 20


def parts(spark: SparkSession, path: str) -> int:
    """So many parts that each holds PART_BYTES of the table's files or less: a number that grows with the table, 1 for a small one."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return -(-at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength() // PART_BYTES) or 1


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files, as the file system lists them."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a table's write was finished and its folder is still there."""
    sc = spark.sparkContext
    mark = sc._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark)


_KEPT: dict[tuple, tuple[str, StructType]] = {}


def stored_once(spark: SparkSession, label: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``'s rows, stored once for each application and state of the source table's files, and read by all that ask for them.

    A table whose folder has been cleared meanwhile is made again.
    """
    key = (spark.sparkContext.applicationId, label, fingerprint(spark, source))
    if key not in _KEPT or not _whole(spark, _KEPT[key][0]):
        df = make()
        path = shared_folder(spark, label)
        df.write.option("compression", "zstd").parquet(path)
        _KEPT[key] = (path, df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)
