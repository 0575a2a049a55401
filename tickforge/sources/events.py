"""Trades from the events table: an integer price walk of each symbol within each session."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.clock import from_epoch, session_clock
from tickforge.functions.folders import parts


NEW_YORK = ZoneInfo("America/New_York")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def utc_bounds(session: str) -> tuple[str, str]:
    """When the session of a date begins and ends (past its last moment), in UTC: 18:00 New York the evening before to 17:00."""
    day = date.fromisoformat(session)
    at = lambda d, hour: datetime.combine(d, time(hour), NEW_YORK).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return at(day - timedelta(days=1), 18), at(day, 17)


def pull(rows: DataFrame, symbol: str, session: str, ts: str = "ts_utc") -> DataFrame:
    """One symbol's rows of one session in order of time and arrival; both bounds are constants that a scan can prune by."""
    lo, hi = (F.expr(f"TIMESTAMP_NTZ '{x}'") for x in utc_bounds(session))
    return rows.filter((F.col(ts) >= lo) & (F.col(ts) < hi) & (F.col("symbol") == symbol)).orderBy(ts, "arrival_id")


def trades(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """arrival_id, symbol, ts_utc, ts_clock, session_date, k, size, instrument_id, price_ticks, price.

    The walk is a running sum inside one symbol's session, so its window is as
    large as a session however long the history. Sessions are dealt over parts
    whose number grows with the table: Spark's own coalescing goes by the bytes
    shuffled, and fills, ticks and bars of a session are made in the same task.
    ``since`` (a session date) leaves out earlier sessions by a bound on the
    stored time, so a scan skips the row groups before it.
    """
    raw = events(spark, sf_dir)
    if since:
        raw = raw.filter(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{utc_bounds(since)[0]}'"))
    e = raw.select(
        F.col("event_id").alias("arrival_id"), F.col("event_type").alias("symbol"), F.col("ts").alias("ts_utc"), session_clock(F.col("ts")).alias("ts_clock"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), (F.lit(1) + F.col("user_id") % 9).cast("long").alias("size"),
        (F.lit(17001) + F.length("event_type") % 5).cast("int").alias("instrument_id"),
    ).withColumn("session_date", F.to_date("ts_clock"))
    e = e.repartition(parts(spark, f"{sf_dir}/events.parquet"), "symbol", "session_date")
    walk = Window.partitionBy("symbol", "session_date").orderBy("arrival_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("price_ticks", (F.lit(20000) + F.sum(F.col("k") % 5 - 2).over(walk)).cast("long"))
    return e.withColumn("price", F.col("price_ticks") / F.lit(4.0))


def fills(trades: DataFrame) -> DataFrame:
    """Each trade as one to three fills of the same time and price."""
    return trades.withColumn("fill", F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("k") % 3)))


def json_trades(lines: DataFrame, fields: Mapping[str, str], unit: str = "s", column: str = "value") -> DataFrame:
    """id, size, ts_utc from trades as JSON lines.

    ``fields`` names the lines' fields for id, time and size. Times are whole
    seconds (``s``) or milliseconds (``ms``) since 1970, or ISO texts below
    ``$date``. Lines that are no JSON give nulls; further fields are ignored.
    """
    kinds = {"s": "long", "ms": "long", "$date": "struct<`$date`:string>"}
    if unit not in kinds:
        raise ValueError(f"unknown time unit: {unit}")
    doc = F.from_json(column, f"`{fields['id']}` long, `{fields['time']}` {kinds[unit]}, `{fields['size']}` long")
    at = F.col("x").getField(fields["time"])
    ts = F.regexp_replace(at["$date"], "Z$", "").cast("timestamp_ntz") if unit == "$date" else from_epoch(at, "SECOND" if unit == "s" else "MILLISECOND")
    return lines.select(doc.alias("x")).select(F.col("x").getField(fields["id"]).alias("id"), F.col("x").getField(fields["size"]).alias("size"), ts.alias("ts_utc"))
