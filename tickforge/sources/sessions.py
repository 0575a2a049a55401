"""Raw session files: one table for each session, its date in the name."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOOTERS_AT_ONCE = 16
#: <prefix>_trades_<date>.parquet; files still being written end in _partial.
NAME = r"([^/=]+_trades_(\d{4}-\d{2}-\d{2}))\.parquet(?:/|$)"


def session_files(spark: SparkSession, folder: str, start: str = "0001-01-01", end: str = "9999-12-31") -> DataFrame:
    """name, session_date, path of the folder's session files from ``start`` to ``end`` (inclusive), partial ones left out.

    Only names are listed; no file is opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
    named = listed.select(F.regexp_extract("path", NAME, 1).alias("name"), F.regexp_extract("path", NAME, 2).alias("_d"), "path").filter("name <> ''")
    files = named.select("name", F.to_date("_d").alias("session_date"), "path")
    return files.filter(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def check_files(files: DataFrame) -> DataFrame:
    """session_date, files, doubled: how many tables claim a session, and whether more than one does."""
    out = files.groupBy("session_date").agg(F.countDistinct("name").alias("files"))
    return out.withColumn("doubled", (F.col("files") > 1).cast("int"))


def read_sessions(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The rows of the named files, with session_date; a session given twice or a schema unlike the first file's raises.

    The list of files is the calendar's length; their footers are read in
    tasks, some at once.
    """
    rows = files.orderBy("session_date", "name", "path").collect()
    first: dict = {}
    for r in rows:
        if first.setdefault(r.session_date, r.name) != r.name:
            raise ValueError(f"two tables for the session of {r.session_date}")
    one = {r.name: r.path for r in rows}
    # A schema is a job of one task that reads a footer; many of them run at once.
    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        schemas = dict(zip(one, pool.map(lambda path: spark.read.parquet(path).schema, one.values()), strict=True))
    for name, schema in schemas.items():
        if schema != next(iter(schemas.values())):
            raise ValueError(f"the schema of {name} differs")
    table = spark.read.schema(next(iter(schemas.values()))).parquet(*(r.path for r in rows))
    return table.withColumn("session_date", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), NAME, 2)))
