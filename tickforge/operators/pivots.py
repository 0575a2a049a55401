"""Zigzag levels: a state machine over a symbol's bars, walked in chunks of sessions side by side and stitched by their end states."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.folders import stored

N_PIVOTS = 5


class State(NamedTuple):
    """What the walk carries from bar to bar: its direction, the running extreme, the last pivots (the newest first)."""

    rising: bool
    level: float
    recent: tuple[float, ...] = ()


def walk(high: np.ndarray, low: np.ndarray, move: np.ndarray, state: State, begin: bool = False, n_pivots: int = N_PIVOTS):
    """(upper pivot, lower pivot, flag, last pivots) as known at each bar, and the state behind the last one.

    Going up, the top follows the highs until a low falls more than ``move``
    below it; going down, the bottom follows the lows until a high rises more
    than ``move`` above it. A missing ``move`` turns nothing. flag is 1 if the
    walk goes up when it comes to the bar, else -1. ``begin``: the first bar
    has none before it, so a turn there is no pivot.
    """
    n = len(high)
    tops, bottoms, flags = np.full(n, np.nan), np.full(n, np.nan), np.full(n, -1, np.int64)
    last = np.full((n, n_pivots), np.nan)
    rising, level, recent = state.rising, state.level, list(state.recent)
    for i in range(n):
        flags[i] = 1 if rising else -1
        if level - low[i] > move[i] if rising else high[i] - level > move[i]:
            if i or not begin:
                (tops if rising else bottoms)[i] = level
                recent = [level, *recent[: n_pivots - 1]]
            rising = not rising
            level = high[i] if rising else low[i]
        else:
            level = max(level, high[i]) if rising else min(level, low[i])
        last[i, : len(recent)] = recent
    return tops, bottoms, flags, last, State(rising, level, tuple(recent))


def zigzag(high: np.ndarray, low: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper pivot, lower pivot, flag) of a whole history, which starts going down from its first low."""
    return walk(high, low, move, State(False, low[0] if len(low) else 0.0), begin=True)[:3]


def guess(high: np.ndarray, low: np.ndarray, move: np.ndarray, rising: bool, n_pivots: int = N_PIVOTS) -> dict:
    """A chunk walked as if it were entered in a direction without any level yet, and what a true level changes.

    reach is the chunk's own extreme before its first turn. A level at entry
    that is not beyond ``limit`` turns the walk nowhere else: then the first
    pivot is the further of level and reach, and all that follows is as
    guessed. Beyond the limit the guess fails.
    """
    tops, bottoms, _, _, end = walk(high, low, move, State(rising, -math.inf if rising else math.inf), n_pivots=n_pivots)
    pivots = np.where(np.isnan(tops), bottoms, tops)
    turns = np.flatnonzero(~np.isnan(pivots))
    first = int(turns[0]) if len(turns) else len(high)
    reach, limits = (high[:first], low[:first] + move[:first]) if rising else (low[:first], high[:first] - move[:first])
    limits = limits[~np.isnan(limits)]
    limit = (limits.min() if rising else limits.max()) if len(limits) else (math.inf if rising else -math.inf)
    return {
        "reach": float(reach.max() if rising else reach.min()), "limit": float(limit), "turns": len(turns),
        "end_rising": bool(end.rising), "end_level": float(end.level), "recent": [float(x) for x in end.recent],
    }


def through(state: State, g: dict, n_pivots: int = N_PIVOTS) -> tuple[State, bool]:
    """The state behind a chunk that is entered in ``state``, from its guess in that direction; and whether it is sure."""
    room = 1e-9 * (1 + abs(g["limit"])) if math.isfinite(g["limit"]) else 0.0
    sure = state.level <= g["limit"] - room if state.rising else state.level >= g["limit"] + room
    reach = max(state.level, g["reach"]) if state.rising else min(state.level, g["reach"])
    if not g["turns"]:
        return State(state.rising, reach, state.recent), sure
    own = list(g["recent"])
    if g["turns"] <= n_pivots:
        own[g["turns"] - 1] = reach  # the chunk's first pivot
    return State(bool(g["end_rising"]), g["end_level"], tuple([*own, *state.recent][:n_pivots])), sure


_GUESS = "rising boolean, reach double, limit double, turns int, end_rising boolean, end_level double, recent array<double>, first_low double"
_ENTRY = "rising boolean, level double, recent array<double>, begin boolean, sure boolean"


def _numbers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(pdf[c].to_numpy(np.float64) for c in ("high", "low", "_move"))


def chunk_states(rows: DataFrame, n_pivots: int = N_PIVOTS) -> DataFrame:
    """symbol, _chunk and the state in which each chunk of a symbol is entered, as a walk over its whole history would have it.

    Each chunk is walked from both directions without a level. Their end
    states, a row for each chunk and direction, are stitched in order; where
    the true level was beyond what a guess stands for, the chunk is walked
    again from its state, and stitching goes on with that. A chunk so walked
    again is settled if all before it are, so each round settles one at least;
    a guess fails only where a level from before would turn the walk earlier.
    """

    def guesses(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["session_date", "bar_no"])
        both = [{"symbol": key[0], "_chunk": key[1], "rising": d, **guess(*_numbers(pdf), d, n_pivots), "first_low": float(pdf["low"].iloc[0])} for d in (False, True)]
        return pd.DataFrame(both)

    guessed = stored(rows.groupBy("symbol", "_chunk").applyInPandas(guesses, f"symbol string, _chunk long, {_GUESS}"), "zigzag-guesses")

    def stitch(key: tuple, chunks: pd.DataFrame, walked: pd.DataFrame) -> pd.DataFrame:
        known = {(w["_chunk"], bool(w["rising"]), float(w["level"])): State(bool(w["end_rising"]), float(w["end_level"]), tuple(w["end_recent"])) for w in walked.to_dict("records")}
        by_chunk: dict[int, dict[bool, dict]] = {}
        for c in chunks.to_dict("records"):
            by_chunk.setdefault(c["_chunk"], {})[bool(c["rising"])] = c
        state, out = None, []
        for number, chunk in sorted(by_chunk.items()):
            begin = state is None
            if begin:
                state = State(False, float(chunk[False]["first_low"]))
            after = known.get((number, state.rising, state.level))
            sure = after is not None
            if sure:
                # Of the last pivots only those of the chunk itself were known when it was walked.
                after = State(after.rising, after.level, tuple([*after.recent, *state.recent][:n_pivots]))
            else:
                after, sure = through(state, chunk[state.rising], n_pivots)
            out.append((key[0], number, state.rising, state.level, list(state.recent), begin, sure))
            state = after
        return pd.DataFrame(out, columns=["symbol", "_chunk", "rising", "level", "recent", "begin", "sure"])

    def again(key: tuple, entry: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        e = entry.iloc[0]
        end = walk(*_numbers(pdf.sort_values(["session_date", "bar_no"])), State(bool(e.rising), float(e.level)), bool(e.begin), n_pivots)[-1]
        row = (key[0], key[1], bool(e.rising), float(e.level), bool(end.rising), float(end.level), [float(x) for x in end.recent])
        return pd.DataFrame([row], columns=["symbol", "_chunk", "rising", "level", "end_rising", "end_level", "end_recent"])

    ends = "symbol string, _chunk long, rising boolean, level double, end_rising boolean, end_level double, end_recent array<double>"
    walked = rows.sparkSession.createDataFrame([], ends)
    while True:
        states = stored(guessed.groupBy("symbol").cogroup(walked.groupBy("symbol")).applyInPandas(stitch, f"symbol string, _chunk long, {_ENTRY}"), "zigzag-states")
        unsure = states.filter("not sure")
        if not unsure.limit(1).count():
            return states.drop("sure")
        part = rows.join(unsure.select("symbol", "_chunk"), ["symbol", "_chunk"], "left_semi")
        more = unsure.groupBy("symbol", "_chunk").cogroup(part.groupBy("symbol", "_chunk")).applyInPandas(again, ends)
        walked = walked.unionByName(stored(more, "zigzag-walked"))


def ud_levels(bars: DataFrame, move: str, n_pivots: int = N_PIVOTS, chunk_days: int = 92) -> DataFrame:
    """symbol, session_date, bar_no, u, d, flag, last1.. : levels and the last pivots, the newest first.

    A chunk is ``chunk_days`` days of one symbol's bars: choose them so that a
    task may hold a chunk (92 days of five-minute bars are some 18,000 rows; of
    one-second bars take a day). A symbol's history takes as many tasks as it
    has chunks.
    """
    names = [f"last{i + 1}" for i in range(n_pivots)]
    day = F.unix_date("session_date").cast("long")
    rows = bars.select("symbol", "session_date", "bar_no", "high", "low", F.expr(f"cast({move} as double)").alias("_move"), F.floor(day / chunk_days).alias("_chunk"))
    rows = stored(rows, "zigzag-bars")

    def run(key: tuple, entry: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        e = entry.iloc[0]
        pdf = pdf.sort_values(["session_date", "bar_no"])
        u, d, flag, last, _ = walk(*_numbers(pdf), State(bool(e.rising), float(e.level), tuple(e.recent)), bool(e.begin), n_pivots)
        out = pdf[["symbol", "session_date", "bar_no"]].copy()
        out["u"], out["d"], out["flag"] = u, d, flag
        out[names] = last
        return out.astype(object).where(out.notna(), None)

    schema = "symbol string, session_date date, bar_no long, u double, d double, flag long, " + ", ".join(f"{n} double" for n in names)
    return chunk_states(rows, n_pivots).groupBy("symbol", "_chunk").cogroup(rows.groupBy("symbol", "_chunk")).applyInPandas(run, schema)
