"""Indicators over a symbol's bars. A window that is not full yet gives null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import history


def full(value: Column, n: int, of: Column, frame) -> Column:
    """The value where the frame holds n non-null numbers."""
    return F.when(F.count(of).over(frame) == n, value)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0).cast("double"))


def last(n: int, *by: str):
    return history(*by).rowsBetween(1 - n, 0)


#: Rows of a block in which a symbol's numbered bars are looked at.
BLOCK_ROWS = 4096


def in_blocks(df: DataFrame, make: Callable[[DataFrame, str], DataFrame], back: int) -> DataFrame:
    """``make(df)`` for a value that looks at most ``back`` rows back, over a symbol's numbered bars (row) in blocks.

    The rows before a block lead it in and are left out again, so a symbol's
    history is as many parts as it has blocks. ``make`` gets the column that
    parts the history as its second argument.
    """
    own = F.expr(f"row div {BLOCK_ROWS}")
    led = F.when(F.col("row") % BLOCK_ROWS >= BLOCK_ROWS - back, own + 1)
    held = df.withColumn("_block", F.explode(F.array_compact(F.array(own, led))))
    return make(held, "_block").filter(F.col("_block") == own).drop("_block")


def sma(df: DataFrame, n: int = 20, col: str = "close") -> DataFrame:
    w = last(n)
    return df.withColumn(f"{n}_sma", full(F.avg(col).over(w), n, F.col(col), w))


def std(df: DataFrame, n: int = 20, col: str = "close") -> DataFrame:
    w = last(n)
    return df.withColumn(f"{n}_std", full(F.stddev_pop(col).over(w), n, F.col(col), w))


def bbands(df: DataFrame, n: int = 20) -> DataFrame:
    df = std(sma(df, n), n)
    return df.withColumn(f"{n}_bbands", ratio(F.col("close") - F.col(f"{n}_sma"), 2 * F.round(f"{n}_std", 9)))


def avedev(df: DataFrame, n: int = 20) -> DataFrame:
    """Mean distance from the window's mean."""
    w = last(n)
    xs, m = F.collect_list("close").over(w), F.avg("close").over(w)
    df = df.withColumns({"_xs": xs, "_m": m})
    dev = F.aggregate("_xs", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
    return df.withColumn("avedev", F.when(F.size("_xs") == n, dev)).drop("_xs", "_m")


CHUNK = 256


def _chunk(alpha: float) -> int:
    """Rows of a chunk: so many that two or three chunks hold all that counts, few enough for the powers of the decay inside one."""
    most = int(600 / -math.log(1 - alpha)) if alpha < 1 else 1
    return max(1, min(max(CHUNK, int(20 / alpha)), most))


def ewm(df: DataFrame, value: str, out: str, alpha: float, *, adjust: bool = False, min_rows: int = 1) -> DataFrame:
    """Exponentially weighted mean over a symbol's bars, by an affine scan of two levels.

    y = (1 - a) y' + a x composes: inside a chunk of rows it is a running
    sum of a x (1 - a)^-j; chunk ends are combined with powers of the decay,
    as far back as they count in double precision. ``adjust`` divides the
    weighted sum by the sum of the weights instead of starting from the first
    value. Null before ``min_rows`` rows.
    """
    decay, chunk = 1 - alpha, _chunk(alpha)
    back = 1
    while decay ** (chunk * back) > 1e-18:
        back += 1
    x = F.col(value).cast("double")
    df = df.withColumn("_t", F.row_number().over(history()) - 1)
    df = df.withColumns({"_c": F.floor(F.col("_t") / chunk), "_j": F.col("_t") % chunk})
    weighted = x if adjust else F.when(F.col("_t") == 0, x).otherwise(x * alpha)
    inside = Window.partitionBy("symbol", "_c").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_y", F.pow(F.lit(decay), F.col("_j")) * F.sum(weighted * F.pow(F.lit(decay), -F.col("_j"))).over(inside))
    ends = df.groupBy("symbol", "_c").agg(F.max_by("_y", "_t").alias("_e"))
    order = Window.partitionBy("symbol").orderBy("_c")
    carried = sum((F.coalesce(F.lag("_e", i + 1).over(order), F.lit(0.0)) * decay ** (chunk * i) for i in range(1, back)), F.coalesce(F.lag("_e", 1).over(order), F.lit(0.0)))
    df = df.join(ends.select("symbol", "_c", carried.alias("_b")), ["symbol", "_c"])
    y = F.col("_y") + F.pow(F.lit(decay), F.col("_j") + 1) * F.col("_b")
    if adjust:
        y = y * alpha / (1 - F.pow(F.lit(decay), F.col("_t") + 1))
    return df.withColumn(out, F.when(F.col("_t") + 1 >= min_rows, y)).drop("_t", "_c", "_j", "_y", "_b")


def atr(df: DataFrame) -> DataFrame:
    """Average true range: Wilder's smoothing (a = 1/14), null for the first 13 bars."""
    return ewm(true_range(df), "tr", "atr", 1 / 14, min_rows=14)


def true_range(df: DataFrame) -> DataFrame:
    before = F.lag("close").over(history())
    return df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def forming_atr(base: DataFrame, big: DataFrame, ratio: int, n: int = 14) -> DataFrame:
    """Adds forming_atr to bars of a small size: the range of the larger bar that is still open, with the n closed ones before it.

    The open bar counts with its extremes so far and its last close. The mean
    of the last n - 1 closed true ranges and the open one is smoothed once
    more with the open one; null with fewer than n closed bars. The closed
    bars' part is one row for each larger bar, met by its key.
    """
    h = history()
    closed = true_range(big).withColumns({"_sum": F.sum("tr").over(h.rowsBetween(1 - n, -1)), "_before": F.lag("close").over(h), "_whole": F.lag("close", n).over(h).isNotNull()})
    closed = closed.select("symbol", "session_date", F.col("bar_no").alias("_big"), "_sum", "_before", "_whole")
    b = base.withColumn("_big", F.floor(F.col("bar_no") / ratio)).join(closed, ["symbol", "session_date", "_big"], "left")
    so_far = Window.partitionBy("symbol", "session_date", "_big").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"_high": F.max("high").over(so_far), "_low": F.min("low").over(so_far)})
    tr = F.greatest(F.col("_high") - F.col("_low"), F.abs(F.col("_high") - F.col("_before")), F.abs(F.col("_low") - F.col("_before")))
    smoothed = ((F.col("_sum") + tr) / n * (n - 1) + tr) / n
    return b.withColumn("forming_atr", F.when(F.col("_whole"), smoothed)).drop("_big", "_sum", "_before", "_whole", "_high", "_low")


def sma_rsi(df: DataFrame, n: int = 14, by: tuple[str, ...] = ()) -> DataFrame:
    """Relative strength of simple means, turned around zero: -(RSI / 50 - 1). It looks n rows back."""
    df = df.withColumn("_c", F.col("close") - F.lag("close").over(history(*by)))
    df = df.withColumns({"_up": F.greatest("_c", F.lit(0)), "_down": F.greatest(-F.col("_c"), F.lit(0))})
    df = df.withColumns({"_up": F.when(F.col("_c").isNotNull(), F.col("_up")), "_down": F.when(F.col("_c").isNotNull(), F.col("_down"))})
    w = last(n, *by)
    up, down = F.avg("_up").over(w), F.avg("_down").over(w)
    df = df.withColumns({"_u": up, "_d": down, "_n": F.count("_c").over(w)})
    rsi = F.when(F.col("_d") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_u") / F.nullif(F.col("_d"), F.lit(0.0))))
    return df.withColumn("sma_rsi", F.when(F.col("_n") == n, -(rsi / 100 * 2 - 1))).drop("_c", "_up", "_down", "_u", "_d", "_n")


def fvg(df: DataFrame) -> DataFrame:
    """Fair-value gap over three bars: +1, -1 or 0."""
    h = history()
    b1, b2 = (lambda c: F.lag(c, 2).over(h)), (lambda c: F.lag(c, 1).over(h))
    df = df.withColumns({"_h1": b1("high"), "_l1": b1("low"), "_o2": b2("open"), "_c2": b2("close"), "_r2": b2("high") - b2("low")})
    wide = (F.col("high") - F.col("low")) >= 1.5 * ((F.col("_h1") - F.col("_l1") + F.col("_r2")) / 2)
    up = (F.col("low") > F.col("_h1")) & (F.col("_c2") > F.col("_o2")) & wide
    down = (F.col("high") < F.col("_l1")) & (F.col("_c2") < F.col("_o2")) & wide
    return df.withColumn("fvg", F.when(up, 1).when(down, -1).otherwise(0)).drop("_h1", "_l1", "_o2", "_c2", "_r2")


def price_moves(df: DataFrame) -> DataFrame:
    h = history()
    return df.withColumns({n: F.col(c) > F.lag(c).over(h) for n, c in (("HO", "open"), ("HH", "high"), ("HL", "low"), ("HC", "close"))})


def sigmoid_transform(x: Column, threshold: float = 3.0, steepness: float = 2.5) -> Column:
    """An S-curve of the size that is 0 at 1 and nears 1, with the value's sign."""
    raw = lambda v: 1 / (1 + F.exp(-steepness * (v - threshold)))
    at_one = raw(F.lit(1.0))
    return (raw(F.abs(x)) - at_one) / (1 - at_one) * F.signum(x)


def inertia(df: DataFrame, n: int = 20, r: float = 0.61828) -> DataFrame:
    """Geometrically weighted mean of the last n price changes through the S-curve."""
    h = history()
    df = df.withColumn("_c", F.col("close") - F.lag("close").over(h))
    total = sum((F.lag("_c", i).over(h) * r**i for i in range(1, n)), F.col("_c") * 1.0)
    return df.withColumn("_s", total / sum(r**i for i in range(n))).withColumn("inertia", sigmoid_transform(F.col("_s"))).drop("_c", "_s")


#: Spans of the volume's z-score by bar minutes (fixed values).
ZSCORE_SPANS = {1: 40000, 15: 8000, 30: 6000, 60: 4000, 720: 1000}


def ewm_zscore(df: DataFrame, value: str, out: str, span: int, floor: float = 1e-8) -> DataFrame:
    """Distance from the exponentially weighted mean of the whole history, in bias-corrected weighted deviations.

    Null on the first bar. The sums of the weights and of their squares are
    geometric series, so two scans (of the values and their squares) do.
    """
    alpha = 2 / (span + 1)
    d = 1 - alpha
    df = df.withColumns({"_x": F.col(value).cast("double"), "_n": F.row_number().over(history())}).withColumn("_xx", F.col("_x") * F.col("_x"))
    df = ewm(ewm(df, "_x", "_mean", alpha, adjust=True), "_xx", "_square", alpha, adjust=True)
    w = (1 - F.pow(F.lit(d), F.col("_n"))) / alpha
    w2 = (1 - F.pow(F.lit(d), 2 * F.col("_n"))) / (1 - d * d)
    var = (F.col("_square") - F.col("_mean") * F.col("_mean")) * w * w / F.nullif(w * w - w2, F.lit(0.0))
    z = (F.col("_x") - F.col("_mean")) / F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(floor))
    return df.withColumn(out, F.when(F.col("_n") > 1, z)).drop("_x", "_xx", "_n", "_mean", "_square")


def session_high_low(df: DataFrame) -> DataFrame:
    """Running extremes of the current half day (720 minutes)."""
    w = Window.partitionBy("symbol", "session_date", "half").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"run_high": F.max("high").over(w), "run_low": F.min("low").over(w)})


def sma_targets(df: DataFrame, windows: tuple[int, ...] = (20, 50, 100), rth: str = "rth") -> DataFrame:
    """sma_<n>_all over all bars; sma_<n>_day over the bars outside regular hours, carried forward; targets: all of them, null until none is missing."""
    h = history()
    for n in windows:
        own = Window.partitionBy("symbol", rth).orderBy("session_date", "bar_no").rowsBetween(1 - n, 0)
        mean = F.when((F.col(rth) != 1) & (F.count("close").over(own) == n), F.avg("close").over(own))
        df = df.withColumn("_m", mean).withColumn(f"sma_{n}_day", F.last("_m", ignorenulls=True).over(h.rowsBetween(Window.unboundedPreceding, 0))).drop("_m")
        w = last(n)
        df = df.withColumn(f"sma_{n}_all", full(F.avg("close").over(w), n, F.col("close"), w))
    names = [f"sma_{n}_{k}" for n in windows for k in ("day", "all")]
    whole = F.lit(True)
    for c in names:
        whole &= F.col(c).isNotNull()
    return df.withColumn("targets", F.when(whole, F.array(*names)))


def forming(xs: Column, n: int) -> dict[str, Column]:
    """Indicators of the bar that is forming, from an array of the last n - 1 closed values and the current one, the newest last.

    std, avedev, bbands (place between the bands of two deviations) and
    sma_rsi (turned around zero, over the n - 1 changes). Null while the array
    is shorter than n, bbands also without any deviation.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = F.transform(xs, lambda x: x.cast("double"))
    mean = total(v) / n
    std = F.sqrt(total(F.transform(v, lambda x: (x - mean) * (x - mean))) / n)
    changes = F.zip_with(F.slice(v, 2, n - 1), F.slice(v, 1, n - 1), lambda a, b: a - b)
    up, down = total(F.transform(changes, lambda c: F.greatest(c, F.lit(0.0)))), total(F.transform(changes, lambda c: F.greatest(-c, F.lit(0.0))))
    rsi = F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
    flat = F.round(std, 9)
    out = {"std": std, "avedev": total(F.transform(v, lambda x: F.abs(x - mean))) / n, "bbands": (F.element_at(v, -1) - (mean - 2 * flat)) / F.nullif(4 * flat, F.lit(0.0)), "sma_rsi": -(rsi / 100 * 2 - 1)}
    return {k: F.when(F.size(xs) == n, c) for k, c in out.items()}


INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sma": sma, "std": std, "bbands": bbands, "avedev": avedev, "sma_rsi": sma_rsi, "atr": atr, "fvg": fvg, "price_moves": price_moves, "inertia": inertia,
}


def apply(df: DataFrame, names: list[str]) -> DataFrame:
    """Indicators by name, in order; an unknown name is an error."""
    unknown = [n for n in names if n not in INDICATORS]
    if unknown:
        raise ValueError(f"unknown indicators: {unknown}")
    for name in names:
        df = INDICATORS[name](df)
    return df
