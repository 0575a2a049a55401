"""The feature table: one row for each bar, stored by session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.folders import stored

from .bars import order_violations

KEY = ("symbol", "session_date", "bar_no")


def write_features(features: DataFrame, path: str) -> None:
    """Writes the table, a folder for each session: a session written again replaces itself and no other. A session is one file unless it is large."""
    features.hint("rebalance", "session_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("session_date").parquet(path)


def warm_up(rows: DataFrame, ready: Sequence[str]) -> DataFrame:
    """Each symbol's rows from its first session on whose first row has all ``ready`` columns.

    A symbol without such a session has no rows; if no symbol has one, this
    raises.
    """
    whole = F.lit(True)
    for c in ready:
        whole = whole & F.col(c).isNotNull()
    first = rows.groupBy("symbol", "session_date").agg(F.min_by(whole, "bar_no").alias("_whole"))
    starts = stored(first.filter("_whole").groupBy("symbol").agg(F.min("session_date").alias("_from")), "warm-up")
    if not starts.limit(1).count():
        raise ValueError(f"no session starts with {', '.join(ready)}")
    return rows.join(starts, "symbol").filter("session_date >= _from").drop("_from")


def read_features(spark: SparkSession, path: str, columns: Sequence[str], *, start: str | None = None, end: str | None = None, ready: str | None = None) -> DataFrame:
    """symbol, session_date, bar_no, start_ind and the named columns, from ``start`` to ``end``.

    ``ready`` drops sessions whose first bar has no value of that column (the
    burn-in). The table may be read in order only if every bar starts after
    the one before it; else this raises.
    """
    f = spark.read.parquet(path).select(*KEY, "start_ind", *dict.fromkeys([*columns, *([ready] if ready else [])]))
    if start:
        f = f.filter(F.col("session_date") >= F.lit(start).cast("date"))
    if end:
        f = f.filter(F.col("session_date") <= F.lit(end).cast("date"))
    if late := order_violations(f).filter("violations > 0").head(1):
        raise ValueError(f"start_ind does not rise in {late[0].symbol}")
    if ready:
        first = F.first(ready).over(Window.partitionBy("symbol", "session_date").orderBy("bar_no"))
        f = f.withColumn("_first", first).filter("_first is not null").drop("_first")
    return f.select(*KEY, "start_ind", *columns)
