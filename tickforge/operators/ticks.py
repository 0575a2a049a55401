"""Clean ticks: session check, price grid, labels, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.clock import SESSION_SECONDS, epoch_us, floor_second, hour, is_rth, second_of_day, session_no

NEWS = ("fomc", "nfp", "cpi", "ppi", "gdp")


def in_session(trades: DataFrame) -> DataFrame:
    return trades.filter(second_of_day(F.col("ts_clock")) < SESSION_SECONDS)


def out_of_session(trades: DataFrame) -> DataFrame:
    """Quarantine: trades in the closed hour."""
    return trades.filter(second_of_day(F.col("ts_clock")) >= SESSION_SECONDS)


def merge(fills: DataFrame) -> DataFrame:
    """One tick for each (symbol, session, time, price): sizes add up, the first arrival keeps its place.

    tick_no numbers a session's ticks from 0 in arrival order. After the merge
    times are cut to whole seconds, so news windows and bars see those.
    """
    one = in_session(fills).groupBy("symbol", "session_date", "ts_clock", F.col("price_ticks").alias("price")).agg(
        F.sum("size").alias("volume"), F.min("arrival_id").alias("arrival_id"), F.min("instrument_id").alias("instrument_id"),
    )
    order = Window.partitionBy("symbol", "session_date").orderBy("arrival_id")
    one = one.withColumn("tick_no", (F.row_number().over(order) - 1).cast("long"))
    return one.withColumn("ts_clock", floor_second(F.col("ts_clock"))).withColumn("sod", second_of_day(F.col("ts_clock")))


def labelled(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({"rth": is_rth(F.col("sod")), "session": session_no(F.col("sod")), "hour": hour(F.col("sod"))})


def with_tick_ind(ticks: DataFrame) -> DataFrame:
    """Global row numbers: the rows of earlier sessions (a small table, summed by symbol) plus the place in the session."""
    counts = ticks.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("symbol", "session_date", (F.sum("_n").over(Window.partitionBy("symbol").orderBy("session_date")) - F.col("_n")).alias("_before"))
    return ticks.join(before, ["symbol", "session_date"]).withColumn("tick_ind", F.col("_before") + F.col("tick_no")).drop("_before")


def news_flags(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    """A 0/1 column for each news type: the tick lies in [event - 5 min, event + 5 min).

    windows: kind, session_date, lo, hi (microseconds). The calendar is a
    few rows a month, so it is broadcast; the join is by session date, so
    each tick meets its own session's windows only.
    """
    us = epoch_us(F.col("ts_clock"))
    day = windows.groupBy("session_date").agg(*(F.collect_list(F.when(F.col("kind") == k, F.struct("lo", "hi"))).alias(f"_{k}") for k in NEWS))
    out = ticks.join(F.broadcast(day), "session_date", "left").withColumn("_us", us)
    inside = lambda k: F.coalesce(F.exists(F.col(f"_{k}"), lambda w: (F.col("_us") >= w["lo"]) & (F.col("_us") < w["hi"])), F.lit(False)).cast("int")
    return out.withColumns({f"news_{k}": inside(k) for k in NEWS}).drop("_us", *(f"_{k}" for k in NEWS))


def splice_roll(block: DataFrame, main: DataFrame, by: list[str], order: str, contract: str = "instrument_id") -> DataFrame:
    """A roll day's rows of one contract: the block, then the main table's rows of the block's contract.

    Each group of ``by`` (a session of a symbol) is spliced by itself. What may
    not be is refused: other columns in the block than in the main table (at
    once); and, when the rows are read, a block of several contracts, a main
    table without the block's contract, and a block that does not end before
    that contract's first row there. Groups without a block are left out.
    """
    if [(f.name, f.dataType) for f in block.schema] != [(f.name, f.dataType) for f in main.schema]:
        raise ValueError(f"the block's columns differ: {block.schema.simpleString()} for {main.schema.simpleString()}")
    facts = block.groupBy(*by).agg(F.min(contract).alias(contract), F.max(contract).alias("_other"), F.max(order).alias("_end"))
    starts = main.groupBy(*by, contract).agg(F.min(order).alias("_start"))
    named = lambda text: F.raise_error(F.concat(F.lit(text), F.concat_ws(" ", *(F.col(c).cast("string") for c in by))))
    gate = F.when(F.col(contract) != F.col("_other"), named("a block holds several contracts: ")).when(
        F.col("_start").isNull(), named("the main table lacks the block's contract: ")).when(F.col("_end") >= F.col("_start"), named("a block overlaps the main table: "))
    passed = facts.join(starts, [*by, contract], "left").select(*by, contract, F.coalesce(gate.cast("boolean"), F.lit(True)).alias("_passed"))
    return block.unionByName(main).join(passed, [*by, contract]).filter("_passed").select(*main.columns)


def contract_codes(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds code, the contract that has the row's id on its session; one that none or several have raises.

    Ids are looked up once for each session, not for each row.
    """
    keys = ["session_date", "instrument_id"]
    asked = rows.select(*keys).distinct()
    fits = asked.join(contracts, "instrument_id", "left").withColumn("_on", F.col("session_date").between(F.col("first"), F.col("last")))
    found = fits.groupBy(*keys).agg(F.max(F.when(F.col("_on"), F.col("code"))).alias("code"), F.count(F.when(F.col("_on"), 1)).alias("_n"))
    text = F.concat(F.col("_n").cast("string"), F.lit(" contracts have id "), F.col("instrument_id").cast("string"), F.lit(" on "), F.col("session_date").cast("string"))
    found = found.withColumn("code", F.when(F.col("_n") != 1, F.raise_error(text).cast("string")).otherwise(F.col("code"))).drop("_n")
    return rows.join(found, keys)
