"""Streaming bars and appends: the batch operators' aggregates over an unbounded trade stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickforge.functions.clock import session_clock
from tickforge.functions.folders import stored

STREAM_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def trade_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events from a folder of Parquet files as a stream; clock is the session clock as a TIMESTAMP for the watermark."""
    raw = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)
    return raw.select(
        "event_id", F.col("event_type").alias("symbol"), session_clock(F.col("ts")).cast("timestamp").alias("clock"),
        (F.lit(1) + F.col("user_id") % 9).alias("size"), F.get_json_object("props", "$.k").cast("long").alias("price"),
    )


def tumbling(trades: DataFrame, size: str, late: str | None = "10 minutes") -> DataFrame:
    """Bars of the given size for each symbol; first and last go by event id, so any batch order gives the same bar.

    late: the watermark; None if the stream has one already.
    """
    w = (trades.withWatermark("clock", late) if late else trades).groupBy("symbol", F.window("clock", size))
    out = w.agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
    )
    return out.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def deduplicated(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Redelivered trades go by their id, inside the watermark; equal fills of different ids stay."""
    return trades.withWatermark("clock", late).dropDuplicatesWithinWatermark(["event_id"])


def write_in_order(events: DataFrame, folder: str, order: str, steps: int, files: int = 1) -> None:
    """The rows in so many steps of ``order``, written one after the other: a file stream takes the oldest first.

    A step is exactly so many ``files``, written side by side, so a stream
    whose batches take whole steps sees them in order whatever their size.
    """
    ranged = stored(events.repartitionByRange(steps * files, order).withColumn("_part", F.spark_partition_id()), "stream-parts")
    for step in range(steps):
        rows = ranged.filter(F.floor(F.col("_part") / files) == step).drop("_part")
        rows = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, order)
        write_files(rows.sortWithinPartitions(order), folder, files)


def write_files(rows: DataFrame, folder: str, files: int) -> None:
    """Adds the rows, in ``files`` partitions or fewer, as exactly so many Parquet files: an empty partition leaves none, so empty files stand in."""
    spark, schema = rows.sparkSession, rows.schema
    count = lambda: len(spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder).inputFiles())
    try:
        there = count()
    except AnalysisException:  # no folder yet
        there = 0
    rows.write.mode("append").parquet(folder)
    for _ in range(there + files - count()):
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(folder)


def zigzag_state(move: float) -> Callable:
    """A stateful zigzag over each symbol's trades: (rising, level) is the state; each turn is a row.

    A micro-batch's trades of one symbol are held together, so triggers must
    keep micro-batches small; trades must come in event order from batch to
    batch, in any order inside one.
    """

    def update(key: tuple, batches, state: GroupState):
        rising, level, turns = state.get if state.exists else (False, None, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for event_id, price in zip(rows["event_id"], rows["price"], strict=True):
            level = price if level is None else level
            if rising and level - price > move or not rising and price - level > move:
                turns += 1
                out.append((key[0], int(event_id), float(level), int(turns)))
                rising, level = not rising, price
            else:
                level = max(level, price) if rising else min(level, price)
        state.update((bool(rising), float(level), int(turns)))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "event_id", "level", "turn"])

    return update


def zigzag(trades: DataFrame, move: float = 40.0) -> DataFrame:
    return trades.groupBy("symbol").applyInPandasWithState(
        zigzag_state(move), "symbol string, event_id long, level double, turn long", "rising boolean, level double, turns long", "append", GroupStateTimeout.NoTimeout)


def append_sessions(new: DataFrame, path: str) -> DataFrame:
    """Writes each session of a batch as its own partition, replacing what an earlier attempt left: a rerun changes nothing."""
    new.hint("rebalance", "session_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(path)
    return new.sparkSession.read.parquet(path)


def record_commit(stored: DataFrame, path: str) -> None:
    """The commit record beside a table: how many rows each session of each symbol has, written after the rows."""
    stored.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("recorded")).coalesce(1).write.mode("overwrite").parquet(f"{path}-record")


def uncommitted(spark: SparkSession, path: str) -> DataFrame:
    """symbol, session_date, stored, recorded of sessions whose rows are not what the commit record says: an append was cut off."""
    stored = spark.read.parquet(path).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("stored"))
    both = stored.join(spark.read.parquet(f"{path}-record"), ["symbol", "session_date"], "full").fillna(0, ["stored", "recorded"])
    return both.filter("stored <> recorded")


def appendable(new: DataFrame, after: str, until: str, holidays: DataFrame, open_from: DataFrame) -> DataFrame:
    """Rows of ``new`` that a run may append: sessions after ``after``, before the first gap, and closed.

    A gap is a weekday up to ``until`` without rows that is no holiday: what
    comes behind it is refused until it is filled. open_from: one row, the
    first session that is still open. Sessions not after ``after`` are stored
    already and refused as well.
    """
    spark = new.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.date_add(F.lit(after).cast("date"), 1), F.lit(until).cast("date"))).alias("session_date")).filter(F.weekday("session_date") < 5)
    missing = days.join(holidays, "session_date", "left_anti").join(new.select("session_date").distinct(), "session_date", "left_anti")
    first = missing.agg(F.min("session_date").alias("_gap")).join(open_from.select(F.col("open_from").alias("_open")), F.lit(True))
    ready = (F.col("session_date") > F.lit(after).cast("date")) & (F.col("_gap").isNull() | (F.col("session_date") < F.col("_gap"))) & (F.col("session_date") < F.col("_open"))
    return new.join(F.broadcast(first), F.lit(True)).filter(ready).drop("_gap", "_open")


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a Parquet table (append) whose checkpoint lies beside it; returns the table."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")
