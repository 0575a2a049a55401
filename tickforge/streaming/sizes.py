"""Bars of every size from one stream: each closed bar feeds the next larger size; trades that come too late go to a table of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.clock import epoch_us
from tickforge.operators.bars import SIZES, child

#: A bar still open, or closed: its first second, prices with the trades that hold first and last place, and sums.
BAR = "symbol string, start long, open long, high long, low long, close long, volume long, n long, first_id long, last_id long"
#: A trade of a batch.
TRADE = "symbol string, event_id long, start long, price long, volume long, late boolean"


def _merged(parts: DataFrame, seconds: int) -> DataFrame:
    """Bars of a size from bars that lie inside them, in any order."""
    return parts.groupBy("symbol", (F.floor(F.col("start") / seconds) * seconds).alias("start")).agg(
        F.min_by("open", "first_id").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_id").alias("close"),
        F.sum("volume").alias("volume"), F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _bars(spark: SparkSession, folder: str, name: str, number: int | None = None, is_open: bool = False) -> DataFrame:
    """The closed or the open bars of a size that a batch wrote, or all batches."""
    path = f"{folder}/bars/freq={name}" if number is None else f"{folder}/bars/freq={name}/batch={number:08d}"
    return _read(spark, path, f"{BAR}, is_open boolean").filter(F.col("is_open") == is_open).drop("is_open")


def size_cascade(folder: str, delay_seconds: int = 600, sizes: dict[str, int] = SIZES):
    """A ``foreachBatch`` function that keeps bars of all sizes below ``folder``: trades, late, bars (freq, batch, is_open) and state.

    A trade (symbol, event_id, clock, price, size) is late if the bar of the
    smallest size that it falls in has closed, that is if its end is not after
    the watermark: the latest clock of earlier batches less the delay. Late
    trades change no bar. A bar closes when the watermark passes its end, and
    only closed bars go up into the next size, so sizes tile each other. Open
    bars are the state: at most some of each size and symbol within the delay
    and the size's own length. Each bar is written once, under is_open, and a
    batch's trades are parsed once. Every table has a folder for each batch
    that a repeated batch writes anew; a batch's open bars and watermark are
    read by the next alone.
    """
    order = sorted(sizes, key=sizes.__getitem__)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/state/batch={number - 1:08d}"
        first = number == 0
        mark = None if first else _read(spark, f"{before}/watermark", "mark long").first().mark
        second = F.floor(epoch_us(F.col("clock").cast("timestamp_ntz")) / 1_000_000)
        smallest = sizes[order[0]]
        rows = batch.select("symbol", "event_id", second.alias("start"), F.col("price").cast("long").alias("price"), F.col("size").cast("long").alias("volume"))
        rows = rows.withColumn("late", F.lit(False) if mark is None else (F.floor(F.col("start") / smallest) + 1) * smallest <= mark)
        rows.write.mode("overwrite").parquet(f"{folder}/trades/batch={number:08d}")
        rows = _read(spark, f"{folder}/trades/batch={number:08d}", TRADE)
        rows.filter("late").drop("late").write.mode("overwrite").parquet(f"{folder}/late/batch={number:08d}")
        newest = rows.agg(F.max("start").alias("m")).first().m
        mark = max(m for m in (mark, None if newest is None else newest - delay_seconds, -(1 << 62)) if m is not None)
        price = F.col("price")
        fresh = rows.filter("not late").select(
            "symbol", "start", price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"), "volume",
            F.lit(1).cast("long").alias("n"), F.col("event_id").alias("first_id"), F.col("event_id").alias("last_id"))
        for name in order:
            below = child(name, sizes)
            parts = fresh if below is None else _bars(spark, folder, below, number)
            if not first:
                parts = parts.unionByName(_bars(spark, folder, name, number - 1, is_open=True))
            is_open = F.col("start") + sizes[name] > mark
            _merged(parts, sizes[name]).withColumn("is_open", is_open).write.mode("overwrite").partitionBy("is_open").parquet(f"{folder}/bars/freq={name}/batch={number:08d}")
        spark.createDataFrame([(mark,)], "mark long").write.mode("overwrite").parquet(f"{folder}/state/batch={number:08d}/watermark")

    return step


def run(trades: DataFrame, folder: str, **how) -> tuple[DataFrame, DataFrame]:
    """Runs the cascade over all that the stream has now; returns the closed bars (freq, ...) and the late trades so far."""
    query = trades.writeStream.foreachBatch(size_cascade(folder, **how)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    spark = trades.sparkSession
    sizes = how.get("sizes", SIZES)
    bars = reduce(DataFrame.unionByName, (_bars(spark, folder, n).withColumn("freq", F.lit(n)) for n in sizes))
    return bars, _read(spark, f"{folder}/late", "symbol string, event_id long, start long, price long, volume long")
