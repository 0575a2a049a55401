"""Trailing trade cycles over a stream of bars: state by symbol and session, ended by a timer at the session's end."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickforge.functions.clock import SESSION_SECONDS

OUT = "symbol string, session_date date, kind string, bar_no long, cycle int, exited boolean, realised double, floating double, ended long"
#: Side held, its entry and best price, cycles so far, those that ended, and what they made.
STATE = "held int, entry long, mark long, cycle int, ended long, total double"


def cycle_step(held: int, entry: int, mark: int, high: int, low: int, close: int, side: int, stop: int) -> tuple[int, int, int, bool, int | None]:
    """The held side, entry and best price behind a bar; whether its low (high) came back by the stop from the best; and the exit price."""
    reach = max(mark, high) if held == 1 else min(mark, low) if held == -1 else mark
    hit = held == 1 and reach - low >= stop or held == -1 and high - reach >= stop
    exit_px = reach - held * stop if hit else None
    return (side, close, close, hit, exit_px) if hit or not held else (held, entry, reach, hit, exit_px)


def cycles(bars: DataFrame, stop: int, tick_usd: float, late: str = "10 minutes") -> DataFrame:
    """A row (kind bar) for each bar of a stream (symbol, session_date, bar_no, clock, high, low, close, side) and one (kind end) for each session.

    clock is the bar's first second on the session clock, as a TIMESTAMP; bars
    of a session come in order from batch to batch, in any order inside one.
    The state is a few numbers for each open session of a symbol. A timer at
    the session's end, which fires once the watermark has passed it, gives the
    session's number of cycles, how many ended, and the realised total, and
    drops the state.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol, day = key
        if state.hasTimedOut:
            _, _, _, cycle, ended, total = state.get
            state.remove()
            yield pd.DataFrame([(symbol, day, "end", None, int(cycle), None, float(total), None, int(ended))], columns=_NAMES)
            return
        held, entry, mark, cycle, ended, total = state.get if state.exists else (0, 0, 0, 0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("bar_no")
        out = []
        for bar_no, high, low, close, side in rows[["bar_no", "high", "low", "close", "side"]].itertuples(index=False):
            was, at = held, entry
            held, entry, mark, hit, exit_px = cycle_step(int(held), int(entry), int(mark), int(high), int(low), int(close), int(side), stop)
            free = hit or not was
            cycle += int(free and side != 0)
            realised = tick_usd * was * (exit_px - at) if hit else 0.0
            floating = tick_usd * was * (int(close) - at) if was and not hit else 0.0
            ended, total = ended + int(hit), total + realised
            out.append((symbol, day, "bar", int(bar_no), int(cycle), bool(hit), float(realised), float(floating), None))
        state.update((int(held), int(entry), int(mark), int(cycle), int(ended), float(total)))
        end = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() + SESSION_SECONDS) * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_NAMES)

    watched = bars.withWatermark("clock", late)
    return watched.groupBy("symbol", "session_date").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


_NAMES = [c.split()[0] for c in OUT.split(", ")]


def bar_stream(spark, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Sided bars from a folder of Parquet files as a stream."""
    schema = "symbol string, session_date date, bar_no long, high long, low long, close long, side int, at long"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.withColumn("clock", F.timestamp_seconds("at")).drop("at")
