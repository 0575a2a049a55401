"""Trades as a table: written by strategy, read back typed; samples for people to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole-number columns of trades; whatever a writer made of them, statistics read longs.
WHOLE = ("row", "side", "entry_row", "exit_row", "exit_ts_row", "entry_px", "exit_px", "result", "pnl", "year", "month")
MONEY = ("tp", "sl", "gross_usd", "net_usd")


def write_trades(trades: DataFrame, path: str) -> None:
    """The trades by strategy, with year and month of their session; an earlier table's strategies of the same names are replaced."""
    dated = trades.withColumns({"year": F.year("session_date"), "month": F.month("session_date")})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("strategy").parquet(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """The trades with whole numbers as long, money as double, the strategy as text."""
    table = spark.read.parquet(path)
    kinds = {c: "long" for c in WHOLE} | {c: "double" for c in MONEY} | {"strategy": "string", "session_date": "date"}
    return table.withColumns({c: F.col(c).cast(kinds[c]) for c in table.columns if c in kinds})


def export_sample(df: DataFrame, path: str, order: list[str], n: int) -> None:
    """The first n rows by ``order`` as one CSV file with a header: a sample for a spreadsheet, so one task writes it."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
