"""Forms of an older generation of features: bands, ordered moves, bar vectors and windows of them, resampled bars, burn-in rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import history
from .scores import NORM


def padded(xs: Column, n: int, fill: float = 0.0) -> Column:
    """The first n entries, without nulls, and ``fill`` up to n."""
    kept = F.array_compact(xs)
    return F.slice(F.concat(kept, F.array_repeat(F.lit(fill), n)), 1, n)


def stacked(names: list[str]) -> Column:
    """Several numeric columns as one vector of doubles."""
    return F.array(*(F.col(c).cast("double") for c in names))


def named_entries(xs: str, names: tuple[str, ...]) -> dict[str, Column]:
    """A column for each entry of an array, null where the array is."""
    return {n: F.try_element_at(F.col(xs), F.lit(k + 1)) for k, n in enumerate(names)}


def wide_bands(df: DataFrame, n: int = 20, deviations: float = 4.0) -> DataFrame:
    """Adds upper, lower and targets ([mean, upper, lower]) at so many deviations; needs <n>_sma and <n>_std."""
    mean, far = F.col(f"{n}_sma"), F.col(f"{n}_std") * deviations
    whole = mean.isNotNull() & far.isNotNull()
    return df.withColumns({"upper": mean + far, "lower": mean - far, "targets": F.when(whole, F.array(mean, mean + far, mean - far))})


def bar_vector() -> Column:
    """Open, high, low, close in the order in which the bar met them: the low before the high unless hl."""
    return F.array("open", F.when(F.col("hl"), F.col("high")).otherwise(F.col("low")), F.when(F.col("hl"), F.col("low")).otherwise(F.col("high")), "close")


def ordered_moves(df: DataFrame) -> DataFrame:
    """Adds moves: differences of open, high, low and close to the bar before, in the order of ``bar_vector``; null for the first bar."""
    step = lambda c: F.col(c) - F.lag(c).over(history())
    high, low = step("high"), step("low")
    df = df.withColumns({"_o": step("open"), "_h": high, "_l": low, "_c": step("close")})
    moves = F.array("_o", F.when(F.col("hl"), F.col("_h")).otherwise(F.col("_l")), F.when(F.col("hl"), F.col("_l")).otherwise(F.col("_h")), "_c")
    return df.withColumn("moves", F.when(F.col("_o").isNotNull(), moves)).drop("_o", "_h", "_l", "_c")


def raw_windows(df: DataFrame, n: int) -> DataFrame:
    """Adds closes, highs and lows: the bar's own value and up to n before it, oldest first."""
    w = history().rowsBetween(-n, 0)
    return df.withColumns({f"{c}s": F.collect_list(c).over(w) for c in ("close", "high", "low")})


def vector_windows(df: DataFrame, n: int, norm: float = NORM) -> DataFrame:
    """Adds pre_vec (the bar before and the bar, eight prices) and movement: n + 1 bars' prices less their own reference and their moves.

    df has hl, moves and ref_px. movement is a list of [price, move] pairs over
    the norm, four for each bar, oldest first.
    """
    df = df.withColumn("vec", bar_vector())
    df = df.withColumn("pre_vec", F.concat(F.lag("vec").over(history()), "vec"))
    moves = F.coalesce("moves", F.array_repeat(F.lit(None).cast("long"), 4))
    pairs = F.zip_with(F.transform("vec", lambda x: (x - F.col("ref_px")) / F.lit(norm)), F.transform(moves, lambda x: x / F.lit(norm)), lambda a, b: F.array(a, b))
    df = df.withColumn("_pairs", pairs)
    return df.withColumn("movement", F.flatten(F.collect_list("_pairs").over(history().rowsBetween(-n, 0)))).drop("_pairs", "vec")


def scaled(df: DataFrame, near: list[str], sizes: list[str], vectors: list[str] = (), close: str = "close", norm: float = NORM) -> DataFrame:
    """Prices and vectors of prices as distances from the close, and sizes, all over the norm, under their own names."""
    from_close = lambda x: (x - F.col(close)) / F.lit(norm)
    df = df.withColumns({c: F.transform(c, from_close) for c in vectors} | {c: F.col(c) / F.lit(norm) for c in sizes}) if [*vectors, *sizes] else df
    return df.withColumns({c: from_close(F.col(c)) for c in near})


def resampled(bars: DataFrame, group: Column, name: str) -> DataFrame:
    """Larger bars of any grouping (720 minutes, weeks) from bars with hl and avg_px.

    First and last values, extremes, summed volume, avg_px weighted by volume,
    and hl: which extreme came first; where one bar holds both, that bar's hl.
    Of equal extremes the first counts. vec holds the prices in that order.
    """
    at = F.struct("session_date", "bar_no")
    first = lambda c: F.min_by(c, at)
    top, bottom = F.min(F.struct((-F.col("high")).alias("p"), at.alias("at"), "hl")), F.min(F.struct(F.col("low").alias("p"), at.alias("at"), "hl"))
    out = bars.groupBy("symbol", group.alias(name)).agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
        (F.sum(F.col("avg_px") * F.col("volume")) / F.sum("volume")).alias("avg_px"), top.alias("_top"), bottom.alias("_bottom"))
    hl = F.when(F.col("_top.at") == F.col("_bottom.at"), F.col("_top.hl")).otherwise(F.col("_top.at") < F.col("_bottom.at"))
    out = out.withColumn("hl", hl).drop("_top", "_bottom")
    return out.withColumns({"vec": bar_vector(), "bar_range": F.col("high") - F.col("low"), "bar_diff": F.col("close") - F.col("open")})


def from_ready(df: DataFrame, ready: Column, drop_last: bool = True) -> DataFrame:
    """A symbol's numbered rows from the first ready one on, without the last one; a symbol that is never ready has none."""
    own = Window.partitionBy("symbol")
    df = df.withColumns({"_first": F.min(F.when(ready, F.col("row"))).over(own), "_last": F.max("row").over(own)})
    return df.filter((F.col("row") >= F.col("_first")) & ((F.col("row") < F.col("_last")) | F.lit(not drop_last))).drop("_first", "_last")


def merged_sizes(base: DataFrame, big: DataFrame, columns: list[str], skip: int = 2) -> DataFrame:
    """Outer merge of a larger size on the base rows' times: a bar's columns show on the row before the next bar, else null.

    base and big: symbol, session_date, at. A larger bar stands at its own
    time; one that no base row has makes a row of its own, with nulls for the
    base. The first ``skip`` larger bars' times show nothing before them.
    """
    keys = ["symbol", "session_date", "at"]
    own = F.struct(*columns)
    j = base.join(big.select(*keys, own.alias("_big")), keys, "full")
    w = Window.partitionBy("symbol").orderBy("session_date", "at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(F.col("_big").isNotNull().cast("int")).over(upto)
    j = j.withColumns({"_kept": F.last("_big", ignorenulls=True).over(upto), "_nth": nth})
    follows = F.lead("_big").over(w).isNotNull() & (F.col("_nth") >= skip)
    return j.withColumns({c: F.when(follows, F.col(f"_kept.{c}")) for c in columns}).drop("_big", "_kept", "_nth")


def after(df: DataFrame, begin: str, order: list[str]) -> DataFrame:
    """The first of rows alike in symbol, session and bar, from a date on."""
    keys = ["symbol", "session_date", "bar_no"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.filter(F.col("session_date") >= F.lit(begin).cast("date")).withColumn("_r", first).filter("_r = 1").drop("_r")
