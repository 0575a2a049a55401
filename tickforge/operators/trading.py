"""Signals, stops, exits, selection and costs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import KEYS, SIZES, history, with_facts
from .search import level_search

TICK_USD, COMMISSION = 12.5, 2.0
#: Bars of a block in the search for exits.
BLOCK_ROWS = 64


@dataclass(frozen=True)
class Strategy:
    """A named side column: 1 long, -1 short, 0 none."""

    name: str
    side: Column


def rsi_long(level: float, reverse: bool = False) -> Strategy:
    side = F.when(F.col("sma_rsi") > level, F.lit(-1 if reverse else 1)).otherwise(F.lit(0))
    return Strategy(f"rsi_long_{level:g}{'_r' * reverse}", side)


def rsi_short(level: float, reverse: bool = False) -> Strategy:
    side = F.when(F.col("sma_rsi") < -level, F.lit(1 if reverse else -1)).otherwise(F.lit(0))
    return Strategy(f"rsi_short_{level:g}{'_r' * reverse}", side)


def expand(factories: Iterable[tuple[Callable[..., Strategy], dict[str, list]]]) -> list[Strategy]:
    """Every combination of every factory's parameters."""
    return [make(**dict(zip(grid, values, strict=True))) for make, grid in factories for values in product(*grid.values())]


def signal_columns(bars: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """One select for all strategies; a missing side is 0."""
    return bars.select("*", *(F.coalesce(s.side, F.lit(0)).cast("int").alias(s.name) for s in strategies))


def ensemble(names: list[str], either: bool) -> Column:
    """1 or -1 where any (``either``) or every strategy says so; 0 where both sides speak."""
    join = (lambda a, b: a | b) if either else (lambda a, b: a & b)

    def says(side: int) -> Column:
        out = F.col(names[0]) == side
        for n in names[1:]:
            out = join(out, F.col(n) == side)
        return out

    return F.when(says(1) & says(-1), 0).when(says(1), 1).when(says(-1), -1).otherwise(0)


def pattern(names: list[str]) -> Column:
    """Which strategies stand behind a side, as a label: L or S and a digit for each."""
    bits = F.concat(*(F.when(F.col(n) == F.col("side"), "1").otherwise("0") for n in names))
    return F.when(F.col("side") == 1, F.concat(F.lit("L"), bits)).when(F.col("side") == -1, F.concat(F.lit("S"), bits))


def rows(bars: DataFrame) -> DataFrame:
    """A symbol's bars numbered from 0 across sessions."""
    return bars.withColumn("row", (F.row_number().over(history()) - 1).cast("long"))


def numbered(bars: DataFrame) -> DataFrame:
    """``rows`` of stored bars in two levels: the rows of earlier sessions (a row for each session, summed by symbol) plus the place in the session."""
    counts = bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*KEYS, (F.sum("_n").over(Window.partitionBy("symbol").orderBy("session_date")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("bar_no")) - 1
    return with_facts(bars.withColumn("_place", place), before).withColumn("row", (F.col("_before") + F.col("_place")).cast("long")).drop("_before", "_place")


def session_ends(df: DataFrame, bar_minutes: int, flat_minute: int) -> DataFrame:
    """flat: the session's first bar that ends after flat_minute (null after an early close); stop: the first row no trade may be in."""
    day = Window.partitionBy("symbol", "session_date")
    flat = F.min(F.when((F.col("bar_no") + 1) * bar_minutes > flat_minute, F.col("row"))).over(day)
    return df.withColumn("flat", flat).withColumn("stop", F.coalesce("flat", F.max("row").over(day) + 1))


def turns(df: DataFrame) -> DataFrame:
    """start: the side turns 1 or -1 in its session; change: the next row of the opposite side, the number of rows without one.

    Two levels: the next row inside the session, else the first one of a later
    session, from a row for each session. So no task holds a symbol's history.
    """
    day = Window.partitionBy(*KEYS).orderBy("row")
    # From the last row backwards a running minimum is one pass; a frame up to the end would start anew at each row.
    ahead = Window.partitionBy(*KEYS).orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("symbol").orderBy(F.desc("session_date")).rowsBetween(Window.unboundedPreceding, -1)
    on = lambda s: F.min(F.when(F.col("side") == s, F.col("row")))
    days = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_k"), on(1).alias("_long"), on(-1).alias("_short"))
    facts = days.select(*KEYS, F.min("_long").over(later).alias("_long"), F.min("_short").over(later).alias("_short"), F.sum("_k").over(Window.partitionBy("symbol")).alias("_n"))
    start = F.col("side") != F.coalesce(F.lag("side").over(day), F.lit(0))
    following = lambda s, c: F.coalesce(on(s).over(ahead), F.col(c))
    df = with_facts(df, facts).withColumns({"start": start, "change": F.coalesce(F.when(F.col("side") == 1, following(-1, "_short")).otherwise(following(1, "_long")), F.col("_n"))})
    return df.drop("_long", "_short", "_n")


def runs(df: DataFrame) -> DataFrame:
    """start: a new run of side in a session (the first row starts one); change: the row behind the run."""
    h = Window.partitionBy("symbol").orderBy("row")
    new = (F.col("side") != F.lag("side").over(h)) | (F.col("session_date") != F.lag("session_date").over(h))
    df = df.withColumn("start", F.coalesce(new, F.lit(True)))
    df = df.withColumn("_run", F.sum(F.col("start").cast("int")).over(h.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("change", F.max("row").over(Window.partitionBy("symbol", "_run")) + 1).drop("_run")


def signals(df: DataFrame, no_entry: str | None = None, entry_ok: Column | None = None) -> DataFrame:
    """Rows whose side starts and whose next bar may be entered: one of the same session, as stop is no later than its end."""
    h = Window.partitionBy(*KEYS).orderBy("row")
    df = df.withColumns({"entry_px": F.lead("open").over(h), "_blocked": F.coalesce(F.lead(no_entry).over(h) == 1, F.lit(False)) if no_entry else F.lit(False)})
    ok = F.lit(True) if entry_ok is None else entry_ok
    return df.filter((F.col("side") != 0) & F.col("start") & ok & ~F.col("_blocked") & (F.col("row") + 1 < F.col("stop"))).drop("_blocked")


def stop_grid(signals: DataFrame, tps: list[int], sls: list[int]) -> DataFrame:
    """Each signal with each pair of levels, as an array exploded in place: the grid is a literal."""
    pairs = F.array(*(F.struct(F.lit(float(a)).alias("tp"), F.lit(float(b)).alias("sl"), F.lit(f"{a}/{b}").alias("stops")) for a in tps for b in sls))
    return signals.select("*", F.inline(pairs))


def checked_stops(signals: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Levels of a caller's own stop function; unlabelled ones carry its name, and a level that is not above 0 raises."""
    out = signals.transform(make)
    if "stops" not in out.columns:
        out = out.withColumn("stops", F.lit(make.__name__))
    level = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double")).otherwise(F.raise_error(F.concat(F.lit(f"{c} is not above 0 in stops "), F.col("stops"))).cast("double"))
    return out.withColumns({"tp": level("tp"), "sl": level("sl")})


def vol_grid(signals: DataFrame, tps: list[float], sls: list[float], vol: str) -> DataFrame:
    """Levels of so many times the volatility, at least 1, rounded up."""
    pairs = F.array(*(F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b"), F.lit(f"{a:g}x/{b:g}x").alias("stops")) for a in tps for b in sls))
    level = lambda k: F.greatest(F.lit(1.0), F.ceil(F.round(F.col(k) * F.col(vol), 6)).cast("double"))
    return signals.select("*", F.inline(pairs)).withColumns({"tp": level("_a"), "sl": level("_b")}).drop("_a", "_b")


def find_exits(sig: DataFrame, bars: DataFrame, table: DataFrame | None, ticks: DataFrame, size: str, sizes: dict[str, int] = SIZES) -> DataFrame:
    """One trade for each signal and stops label: entry at the next bar's first tick, exit by level, opposite signal, flat bar or session end.

    sig: rows of ``signals`` with tp, sl, stops; bars: numbered rows of the
    same symbols, of the given size; table: the bars of that size and all below
    (freq), or None: those below are made for the bars in question. Where a bar holds both levels, ``level_search`` decides. The only wide join carries (symbol, session_date) and looks
    for the first block of bars that touches a level; then the bars of that
    block, and of the entry's own, are looked at. So a trade meets a session's
    blocks and two blocks' bars, however short the bars.
    """
    keys, one = ["symbol", "session_date"], ["symbol", "row", "stops"]
    s = sig.select(*keys, "row", "side", "tp", "sl", "stops", "entry_px", "flat", "stop", "change").withColumns({
        "entry_row": F.col("row") + 1, "until": F.least("stop", F.col("change") + 1),
        "upper": F.col("entry_px") + F.when(F.col("side") == 1, F.col("tp")).otherwise(F.col("sl")),
        "lower": F.col("entry_px") - F.when(F.col("side") == 1, F.col("sl")).otherwise(F.col("tp")),
    })
    reached = lambda high, low: f"({high} >= ceil(upper) or {low} <= floor(lower))"
    b = bars.select(*keys, F.col("row").alias("b_row"), "high", "low").withColumn("block", F.expr(f"b_row div {BLOCK_ROWS}"))
    # Signals and bars are as many as the history is long, however small their files: they are not broadcast.
    blocks = b.groupBy(*keys, "block").agg(F.max("high").alias("top"), F.min("low").alias("bottom")).hint("merge")
    s = s.withColumn("own", F.expr(f"entry_row div {BLOCK_ROWS}"))
    later = s.join(blocks, keys).filter(f"block > own and block <= (until - 1) div {BLOCK_ROWS} and {reached('top', 'bottom')}").groupBy(*one).agg(F.min("block").alias("later"))
    near = s.join(later, one, "left").withColumn("block", F.explode(F.array_compact(F.array("own", "later"))))
    touch = near.join(b.hint("merge"), [*keys, "block"]).filter(f"b_row >= entry_row and b_row < until and {reached('high', 'low')}").groupBy(*one).agg(F.min("b_row").alias("hit_row"))
    s = s.drop("own").join(touch, one, "left").withColumn("bar_row", F.coalesce("hit_row", F.col("until") - 1))
    at = bars.select("symbol", F.col("row").alias("bar_row"), "start_tick", F.col("close").alias("bar_close"))
    s = s.join(at.hint("merge"), ["symbol", "bar_row"]).withColumn("entry_id", F.concat_ws("|", "symbol", "row", "stops"))
    s = level_search(s, bars.withColumn("freq", F.lit(size)) if table is None else table, ticks, size, sizes, made=table is not None).drop("entry_id", "start_tick")
    opens = lambda name: bars.select("symbol", F.col("row").alias(f"{name}_row"), F.col("open").alias(f"{name}_px")).hint("merge")
    changed = (F.col("hit") == 0) & (F.col("until") < F.col("stop"))
    s = s.withColumns({"changed": changed, "change_row": F.col("until"), "flat_row": F.col("flat")})
    s = s.join(opens("change"), ["symbol", "change_row"], "left").join(opens("flat"), ["symbol", "flat_row"], "left")
    time_px = F.when(F.col("flat").isNotNull(), F.col("flat_px")).otherwise(F.col("bar_close"))
    exit_px = F.when(F.col("hit") == 1, F.ceil("upper")).when(F.col("hit") == -1, F.floor("lower")).when(F.col("changed"), F.col("change_px")).otherwise(time_px).cast("long")
    exit_row = F.when((F.col("hit") == 0) & ~F.col("changed") & F.col("flat").isNotNull(), F.col("flat")).otherwise(F.col("bar_row"))
    out = s.withColumns({"exit_px": exit_px, "exit_row": exit_row.cast("long"), "result": F.when(F.col("changed"), 2).otherwise(F.col("hit") * F.col("side")).cast("int")})
    out = out.withColumns({"pnl": (F.col("side") * (F.col("exit_px") - F.col("entry_px"))).cast("long"), "exit_ts_row": F.when(F.col("changed"), F.col("bar_row") + 1).otherwise(F.col("exit_row")).cast("long")})
    return out.select(*keys, "stops", "row", "side", "tp", "sl", "entry_row", "entry_px", "exit_row", "exit_ts_row", "exit_px", "result", "pnl")


def one_at_a_time(trades: DataFrame) -> DataFrame:
    """Greedy in signal order: a trade is kept if its row is not before the last kept trade's exit row.

    Trades never cross a session, so each (symbol, stops, session) is folded
    by itself: at most one trade for each of its bars. Whole trades are in the
    lists, so they are shuffled once and met by no join.
    """
    keys = ["symbol", "stops", "session_date"]
    trade = F.struct("row", "exit_row", *(c for c in trades.columns if c not in {*keys, "row", "exit_row"}))
    lists = trades.groupBy(*keys).agg(F.sort_array(F.collect_list(trade)).alias("_t"))
    start = F.struct(F.lit(-1).cast("long").alias("free"), F.array().cast(lists.schema["_t"].dataType).alias("kept"))
    step = lambda a, t: F.when(t["row"] >= a["free"], F.struct(t["exit_row"].alias("free"), F.array_append(a["kept"], t).alias("kept"))).otherwise(a)
    return lists.select(*keys, F.inline(F.aggregate("_t", start, step, lambda a: a["kept"]))).select(*trades.columns)


def costs(trades: DataFrame, tick_usd: float = TICK_USD, commission: float = COMMISSION) -> DataFrame:
    """gross and net dollars: one tick of slippage with a take-profit, two otherwise, and commission both ways."""
    slip = F.when(F.col("result") == 1, 1).otherwise(2)
    gross = F.col("pnl") * tick_usd
    return trades.withColumns({"gross_usd": gross, "net_usd": gross - slip * tick_usd - 2 * commission})


def vol_ok(bars: DataFrame, column: str, band: tuple[float, float] = (0.2, 0.8), sessions: int = 60) -> DataFrame:
    """Adds vol_ok: the value lies between the band's quantiles (interpolated) of the symbol's previous sessions' bars.

    False before there are so many sessions. The quantiles come from counts of
    equal values by session. A block of four times so many sessions slides over
    them with the sessions before it as its lead-in, so a count is held by two
    blocks at most, and a symbol's history is as many tasks as it has blocks.
    """
    own = Window.partitionBy("symbol").orderBy("session_date")
    n = bars.select("symbol", "session_date").distinct().withColumn("_sn", (F.row_number().over(own) - 1).cast("long"))
    b = bars.join(n, ["symbol", "session_date"])
    counts = b.filter(F.col(column).isNotNull()).groupBy("symbol", "_sn", F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    length = 4 * sessions
    block = F.floor(F.col("_sn") / length)
    led = F.when(F.col("_sn") % length >= length - sessions, block + 1)
    held = counts.withColumn("_block", F.explode(F.array_compact(F.array(block, led))))

    def slide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * length
        values = np.unique(pdf["_v"].to_numpy())
        by_session = {int(k): (np.searchsorted(values, g["_v"].to_numpy()), g["_k"].to_numpy()) for k, g in pdf.groupby("_sn")}
        inside, out = np.zeros(len(values), np.int64), []
        for k in range(first - sessions, first + length):
            if k - 1 - sessions >= first - sessions and k - 1 - sessions in by_session:
                at, m = by_session[k - 1 - sessions]
                inside[at] -= m
            if k >= max(first, sessions) and inside.any():
                upto = np.cumsum(inside)
                places = [q * (upto[-1] - 1) for q in band]
                ends = [[values[np.searchsorted(upto, r, side="right")] for r in (math.floor(x), math.ceil(x))] for x in places]
                out.append((key[0], k, *(lo + (hi - lo) * (x - math.floor(x)) for x, (lo, hi) in zip(places, ends, strict=True))))
            if k in by_session:
                at, m = by_session[k]
                inside[at] += m
        return pd.DataFrame(out, columns=["symbol", "_sn", "_lo", "_hi"])

    q = held.groupBy("symbol", "_block").applyInPandas(slide, f"symbol {bars.schema['symbol'].dataType.simpleString()}, _sn long, _lo double, _hi double")
    inside = (F.col(column) >= F.col("_lo")) & (F.col(column) <= F.col("_hi"))
    return b.join(q, ["symbol", "_sn"], "left").withColumn("vol_ok", F.coalesce(inside, F.lit(False))).drop("_sn", "_lo", "_hi")
