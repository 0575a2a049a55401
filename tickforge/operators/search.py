"""Level search: which of two levels an entry's bar touches first, by descent through the bars that tile it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.folders import stored

from .bars import KEYS, SIZES, child

#: Rows up to which the entries still open are broadcast, so bars and ticks stay where they lie (some 100 bytes a row).
OPEN_ROWS = 200_000
#: Levels beyond this are no levels; prices are far below it.
FAR = float(1 << 62)


def levels(upper: Column, lower: Column) -> tuple[Column, Column]:
    """Whole levels with the same hits, prices being whole: upper rounded up, lower down. Infinite or null is no level; NaN raises."""
    def whole(c: Column, rounded, none: float) -> Column:
        c = F.coalesce(c.cast("double"), F.lit(none))
        return F.when(F.isnan(c), F.raise_error(F.lit("a level is NaN")).cast("long")).otherwise(rounded(F.greatest(F.least(c, F.lit(FAR)), F.lit(-FAR))).cast("long"))

    return whole(upper, F.ceil, FAR), whole(lower, F.floor, -FAR)


def _side(up: Column, down: Column) -> Column:
    """1 or -1 where one level lies inside, 0 where none does, null where both do."""
    return F.when(up & down, F.lit(None).cast("int")).when(up, 1).when(down, -1).otherwise(0)


def level_search(entries: DataFrame, bars: DataFrame, ticks: DataFrame, size: str, sizes: dict[str, int] = SIZES, *, made: bool = True) -> DataFrame:
    """Adds hit to entries (entry_id, symbol, session_date, start_tick, upper, lower): 1 upper first, -1 lower first, 0 neither inside the bar.

    ``start_tick`` is the first tick of a bar of ``size``; anything else
    raises. bars holds all sizes below it too (freq, bar_no, start_tick, high,
    low), ticks hold sod, tick_no and price. A bar with one level inside
    decides; of one with both, the first of its tiles that touches a level is
    looked at in its turn, and of a smallest bar its ticks. Only entries that
    are still open go down, so a level costs their number times the tiles of
    one bar. They are written and counted at each level: few of them are
    broadcast, and the descent ends where none is left. A bar whose tiles or
    ticks hold neither level is broken and raises.

    Without ``made`` bars hold ``size`` alone: the tiles are made from the
    ticks of those bars in which an entry is open, which are written once.
    """
    upper, lower = levels(F.col("upper"), F.col("lower"))
    own = bars.filter(F.col("freq") == size).select(*KEYS, "start_tick", F.col("bar_no").alias("_bar"), F.col("high").alias("_high"), F.col("low").alias("_low"))
    # Bars are as many as the history is long, however small their files: they are not broadcast.
    e = entries.join(own.hint("merge"), [*KEYS, "start_tick"], "left").withColumns({"_upper": upper, "_lower": lower})
    astray = F.raise_error(F.concat(F.lit("tick "), F.coalesce(F.col("start_tick").cast("string"), F.lit("null")), F.lit(f" is not the first tick of a bar of size {size}")))
    side = F.when(F.col("_bar").isNull(), astray.cast("int")).otherwise(_side(F.col("_high") >= F.col("_upper"), F.col("_low") <= F.col("_lower")))
    e = stored(e.withColumn("hit", side), "search-entries")
    frontier = e.filter("hit is null").select("entry_id", *KEYS, "_bar", "_upper", "_lower")
    found: list[DataFrame] = []
    at: str | None = size
    while at is not None and (n := frontier.count()):
        if not made and at == size:
            ticks = stored(inside_open(ticks, frontier, n, sizes[size]), "search-ticks")
        below = child(at, sizes)
        if below is None:
            inside = ticks.select(*KEYS, F.floor(F.col("sod") / sizes[at]).cast("long").alias("_bar"), F.col("tick_no").alias("_order"), F.col("price").alias("_high"), F.col("price").alias("_low"))
        else:
            ratio = sizes[at] // sizes[below]
            tiles = bars.filter(F.col("freq") == below) if made else extremes(ticks, sizes[below])
            inside = tiles.select(*KEYS, F.floor(F.col("bar_no") / ratio).cast("long").alias("_bar"), F.col("bar_no").alias("_order"), F.col("high").alias("_high"), F.col("low").alias("_low"))
        frontier = stored(descend(frontier, inside, n, at, leaf=below is None), "search-open")
        found.append(frontier.filter("hit is not null").select("entry_id", "hit"))
        frontier = frontier.filter("hit is null").select("entry_id", *KEYS, "_bar", "_upper", "_lower")
        at = below
    e = e.drop("_bar", "_high", "_low", "_upper", "_lower")
    if not found:
        return e
    below = reduce(DataFrame.unionByName, found).withColumnRenamed("hit", "_found")
    return e.join(below, "entry_id", "left").withColumn("hit", F.coalesce("hit", "_found")).drop("_found")


def inside_open(ticks: DataFrame, frontier: DataFrame, n: int, seconds: int) -> DataFrame:
    """The ticks of the bars (of so many seconds) that the frontier's n rows are in."""
    bars = frontier.select(*KEYS, "_bar").distinct()
    inside = ticks.withColumn("_bar", F.floor(F.col("sod") / seconds).cast("long"))
    return inside.join(F.broadcast(bars) if n <= OPEN_ROWS else bars, [*KEYS, "_bar"], "left_semi").drop("_bar")


def extremes(ticks: DataFrame, seconds: int) -> DataFrame:
    """Number, high and low of the bars of so many seconds."""
    return ticks.groupBy(*KEYS, F.floor(F.col("sod") / seconds).cast("long").alias("bar_no")).agg(F.max("price").alias("high"), F.min("price").alias("low"))


def descend(frontier: DataFrame, inside: DataFrame, n: int, size: str, leaf: bool) -> DataFrame:
    """The first row inside each open bar that touches a level: its order becomes _bar; hit is null where it holds both.

    A tick (``leaf``) that is beyond both levels, as when they cross, is the upper's.
    """
    up, down = F.col("_high") >= F.col("_upper"), F.col("_low") <= F.col("_lower")
    side = F.struct(F.col("_order").alias("bar"), (F.when(up, 1).otherwise(-1) if leaf else _side(up, down)).alias("hit"))
    few = n <= OPEN_ROWS
    met = inside.join(F.broadcast(frontier) if few else frontier, [*KEYS, "_bar"]).filter(up | down).groupBy("entry_id").agg(F.min_by(side, "_order").alias("_first"))
    out = frontier.join(met, "entry_id", "left")
    broken = F.raise_error(F.concat(F.lit(f"a bar of size {size} is broken: its extremes are in none of its parts, entry "), F.col("entry_id").cast("string")))
    out = out.withColumn("_bar", F.when(F.col("_first").isNull(), broken.cast("long")).otherwise(F.col("_first.bar")))
    return out.withColumn("hit", F.col("_first.hit")).drop("_first")
