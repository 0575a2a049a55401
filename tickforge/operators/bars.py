"""OHLCV bars of any size, aligned to the session's start, built once and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.folders import stored

KEYS = ("symbol", "session_date")
SIZES = {"1s": 1, "5s": 5, "15s": 15, "1": 60, "5": 300, "10": 600, "15": 900, "30": 1800, "60": 3600, "day": 86400}


def bars(ticks: DataFrame, seconds: int, flags: tuple[str, ...] = (), firsts: tuple[str, ...] = ()) -> DataFrame:
    """Bars from ticks: open, high, low, close, volume, n_ticks, first and last tick, first places of the extremes.

    A bar has a flag if any tick has it, and its first tick's ``firsts``.
    Every aggregate is mergeable (first and last go by tick_no), so the
    shuffle moves one row for each bar and map task.
    """
    places = {
        "_hi": F.min(F.struct((-F.col("price")).alias("p"), "tick_no")), "_lo": F.min(F.struct(F.col("price").alias("p"), F.col("tick_no").alias("tick_no"))),
    }
    out = ticks.groupBy(*KEYS, F.floor(F.col("sod") / seconds).cast("long").alias("bar_no")).agg(
        F.min_by("price", "tick_no").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tick_no").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_ticks"), F.min("tick_no").alias("start_tick"), F.max("tick_no").alias("last_tick"),
        *(c.alias(n) for n, c in places.items()), *(F.max(c).alias(c) for c in flags), *(F.min_by(c, "tick_no").alias(c) for c in firsts),
    )
    return out.withColumns({"hi_tick": F.col("_hi.tick_no"), "lo_tick": F.col("_lo.tick_no")}).drop("_hi", "_lo")


def roll_up(small: DataFrame, ratio: int, flags: tuple[str, ...] = (), firsts: tuple[str, ...] = ()) -> DataFrame:
    """Larger bars from smaller ones that tile them."""
    out = small.groupBy(*KEYS, F.floor(F.col("bar_no") / ratio).cast("long").alias("bar_no")).agg(
        F.min_by("open", "start_tick").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_tick").alias("close"),
        F.sum("volume").alias("volume"), F.sum("n_ticks").alias("n_ticks"), F.min("start_tick").alias("start_tick"), F.max("last_tick").alias("last_tick"),
        F.min(F.struct((-F.col("high")).alias("p"), F.col("hi_tick").alias("t"))).alias("_hi"), F.min(F.struct(F.col("low").alias("p"), F.col("lo_tick").alias("t"))).alias("_lo"),
        *(F.max(c).alias(c) for c in flags), *(F.min_by(c, "start_tick").alias(c) for c in firsts),
    )
    return out.withColumns({"hi_tick": F.col("_hi.t"), "lo_tick": F.col("_lo.t")}).drop("_hi", "_lo")


def child(size: str, sizes: dict[str, int] = SIZES) -> str | None:
    """The largest smaller size that tiles a size; None if ticks alone do."""
    smaller = [n for n, s in sizes.items() if s < sizes[size] and sizes[size] % s == 0]
    return max(smaller, key=sizes.__getitem__, default=None)


def write_sizes(
    ticks: DataFrame, path: str, sizes: dict[str, int] = SIZES, flags: tuple[str, ...] = (), firsts: tuple[str, ...] = (), by: tuple[str, ...] = ("freq",),
) -> DataFrame:
    """Writes bars of all sizes below ``path`` by freq, and reads them back (freq names the size).

    A cascade: the smallest size is built from ticks, each other from the
    stored bars of the size that tiles it. Ticks are shuffled once, as bars of
    the smallest size, and no bar is copied. ``by`` may have session_date as
    well: then a session of all symbols is one file, unless it is large and
    the rebalance splits it. What is there already of the folders written is
    replaced, so a rerun changes nothing.
    """
    schema = None
    for name in sorted(sizes, key=sizes.__getitem__):
        below = child(name, sizes)
        if below is None:
            one = bars(ticks, sizes[name], flags, firsts)
            schema = one.schema.add("freq", "string")
        else:
            stored = ticks.sparkSession.read.schema(schema).option("basePath", path).parquet(f"{path}/freq={below}")
            one = roll_up(stored, sizes[name] // sizes[below], flags, firsts)
        rows = one.withColumn("freq", F.lit(name))
        rows = rows.hint("rebalance", "session_date") if "session_date" in by else rows
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)
    return ticks.sparkSession.read.schema(schema).parquet(path)


def with_hl(bars: DataFrame) -> DataFrame:
    """hl: the bar's first highest tick comes before its first lowest."""
    return bars.withColumn("hl", F.col("hi_tick") < F.col("lo_tick"))


def pointers(bars: DataFrame) -> DataFrame:
    """Global first and past-last tick row of each bar, by sums over earlier sessions."""
    days = bars.groupBy(*KEYS).agg(F.sum("n_ticks").alias("_n"))
    before = days.select(*KEYS, (F.sum("_n").over(Window.partitionBy("symbol").orderBy("session_date")) - F.col("_n")).alias("_before"))
    return bars.join(before, list(KEYS)).withColumns({"start_ind": F.col("_before") + F.col("start_tick"), "next_ind": F.col("_before") + F.col("last_tick") + 1}).drop("_before")


def index_ticks(ticks: DataFrame, bars: DataFrame, sizes: dict[str, int] = SIZES) -> DataFrame:
    """Adds tick_ind and, for each size, bar_, high_, low_ and next_<size>: the bar's number, and on its first tick its values (0 on the others).

    ticks have a global row, tick_ind; bars is a table of those sizes. A bar's values come by its first
    tick's number, all sizes that start there in one row, so ticks are
    shuffled once whatever the number of sizes.
    """
    at = lambda n, c: F.max(F.when(F.col("freq") == n, F.col(c)))
    starts = bars.groupBy(*KEYS, F.col("start_tick").alias("tick_no")).agg(*(at(n, c).alias(f"_{c}_{n}") for n in sizes for c in ("high", "low", "last_tick")))
    out = ticks.join(starts, [*KEYS, "tick_no"], "left")
    offset = F.col("tick_ind") - F.col("tick_no") + 1
    columns = {}
    for n, seconds in sizes.items():
        columns |= {
            f"bar_{n}": F.floor(F.col("sod") / seconds).cast("long"), f"high_{n}": F.coalesce(f"_high_{n}", F.lit(0)), f"low_{n}": F.coalesce(f"_low_{n}", F.lit(0)),
            f"next_{n}": F.coalesce(offset + F.col(f"_last_tick_{n}"), F.lit(0)),
        }
    return out.withColumns(columns).drop(*(f"_{c}_{n}" for n in sizes for c in ("high", "low", "last_tick")))


def asof_sizes(bars: dict[int, DataFrame], base: int, columns: list[str], session_seconds: int = 82800) -> DataFrame:
    """The base size's bars with, for each larger size (minutes), the columns of the last bar that has closed: <column>_<size>.

    A larger bar shows on the base row in which it closes. All sizes go
    through one union and one running last value for each, so one shuffle.
    """
    larger = sorted(m for m in bars if m != base)
    value = lambda m: F.struct(*(F.col(c).alias(c) for c in columns))
    kinds = {m: bars[m].select(value(m).alias("v")).schema["v"].dataType for m in larger}
    close = lambda m: F.least((F.col("bar_no") + 1) * (m * 60), F.lit(session_seconds)) - base * 60
    parts = []
    for m in [base, *larger]:
        shown = [value(m).alias(f"_v{k}") if k == m else F.lit(None).cast(kinds[k]).alias(f"_v{k}") for k in larger]
        at = F.col("bar_no") * (base * 60) if m == base else close(m)
        parts.append(bars[m].select(*KEYS, "bar_no", *(F.col(c) if m == base else F.lit(None).cast(bars[base].schema[c].dataType).alias(c) for c in columns), at.alias("_at"), F.lit(m == base).alias("_base"), *shown))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    w = Window.partitionBy("symbol").orderBy("session_date", "_at", "_base").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({f"_v{m}": F.last(f"_v{m}", ignorenulls=True).over(w) for m in larger}).filter("_base")
    return both.select(*KEYS, "bar_no", *columns, *(F.col(f"_v{m}.{c}").alias(f"{c}_{m}") for m in larger for c in columns))


def order_violations(bars: DataFrame) -> DataFrame:
    """For each symbol: bars, and how many of them do not start after the bar before; 0 for a table that may be read in order."""
    before = F.lag("start_ind").over(history())
    b = bars.withColumn("_late", F.coalesce(F.col("start_ind") <= before, F.lit(False)))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(F.col("_late"), 1)).alias("violations"), F.max("start_ind").alias("last_start"))


def history(*by: str) -> Window:
    """A symbol's bars in time order, across sessions, or those of a part of its history (``by``). Bars are few: a symbol's history is bounded by its calendar."""
    return Window.partitionBy("symbol", *by).orderBy("session_date", "bar_no")


def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with what is known of their session: facts has one row for each (symbol, session_date), null keys included.

    Facts are written first, so Spark knows how few they are and rows stay where they lie.
    """
    named = stored(facts, "session-facts").withColumnsRenamed({k: f"_of_{k}" for k in KEYS})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in KEYS]
    return rows.join(named, same).drop(*(f"_of_{k}" for k in KEYS))
