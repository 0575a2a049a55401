"""Appends that carry their state on: new sessions become tick rows, bars and indicators without a look at the old ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.clock import is_open
from tickforge.functions.folders import stored

from .bars import KEYS, bars
from .pivots import N_PIVOTS, State, walk

WINDOW, ATR_ROWS = 20, 14
LASTS = [f"last{i + 1}" for i in range(N_PIVOTS)]
#: What a symbol's next session needs of all before it.
STATE = """symbol string, last_session date, ticks long, bars long, closes array<double>, true_range double,
  rising boolean, level double, recent array<double>"""
_ROWS = f"""symbol string, session_date date, bar_no long, open long, high long, low long, close long, volume long, start_ind long, next_ind long,
  sma double, std double, atr double, u double, d double, flag long, {', '.join(f'{n} double' for n in LASTS)}, state struct<bars: long, closes: array<double>,
  true_range: double, rising: boolean, level: double, recent: array<double>>"""


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders below ``path``: those that a write has marked as whole."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    whole = sc._jvm.org.apache.hadoop.fs.Path
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if fs.exists(whole(f.getPath(), "_SUCCESS")))


def committed(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The number of appends so far, and the state behind the last one: the commit record, written after all else."""
    versions = _folders(spark, f"{path}/state")
    if not versions:
        return 0, spark.createDataFrame([], STATE)
    return int(versions[-1].partition("=")[2]), spark.read.schema(STATE).parquet(f"{path}/state/{versions[-1]}")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of ``ticks`` or ``bars`` that the commit record accounts for: those of an append that was cut off are left out."""
    _, state = committed(spark, path)
    rows = spark.read.parquet(f"{path}/{table}")
    # A row for each symbol: whether it is small enough to send is left to Spark, which sees its size.
    return rows.join(state.select("symbol", "last_session"), "symbol").filter("session_date <= last_session").drop("last_session")


def _step():
    """The bars of one symbol's new sessions with their indicators, from its state (or none)."""

    def run(key: tuple, before: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if new.empty:
            return pd.DataFrame()
        new = new.sort_values(["session_date", "bar_no"]).reset_index(drop=True)
        high, low, close = (new[c].to_numpy(np.float64) for c in ("high", "low", "close"))
        old = None if before.empty or before["closes"].iloc[0] is None else before.iloc[0]
        tail = np.array([] if old is None else old.closes, np.float64)
        seen = 0 if old is None else int(old.bars)
        held = np.concatenate([tail, close])
        n, at = len(close), len(tail)
        sma, std, atr = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
        y = math.nan if old is None else float(old.true_range)
        for i in range(n):
            if at + i + 1 >= WINDOW:
                w = held[at + i + 1 - WINDOW : at + i + 1]
                sma[i], std[i] = w.mean(), w.std()
            previous = held[at + i - 1] if at + i else math.nan
            x = high[i] - low[i] if math.isnan(previous) else max(high[i] - low[i], abs(high[i] - previous), abs(low[i] - previous))
            y = x if math.isnan(y) else y * (1 - 1 / ATR_ROWS) + x / ATR_ROWS
            if seen + i + 1 >= ATR_ROWS:
                atr[i] = y
        entry = State(False, low[0]) if old is None else State(bool(old.rising), float(old.level), tuple(old.recent))
        u, d, flag, last, end = walk(high, low, np.round(3 * std, 6), entry, begin=old is None)
        out = new[["symbol", "session_date", "bar_no", "open", "high", "low", "close", "volume", "start_ind", "next_ind"]].copy()
        out["sma"], out["std"], out["atr"], out["u"], out["d"], out["flag"] = sma, std, atr, u, d, flag
        out[LASTS] = last
        out = out.astype(object).where(out.notna(), None)
        state = {"bars": seen + n, "closes": held[-WINDOW:].tolist(), "true_range": y, "rising": end.rising, "level": float(end.level), "recent": list(map(float, end.recent))}
        out["state"] = [None] * (n - 1) + [state]
        return out

    return run


def append(ticks: DataFrame, path: str, seconds: int = 300, now_utc: str | None = None) -> list[str]:
    """Appends the sessions of ``ticks`` (as ``ticks.merge`` gives them) that are newer than the stored ones; returns their dates.

    Stored below ``path``: ticks (tick_ind, price, ...) and bars of one size
    with row pointers and indicators, by session; and the state. Nothing old
    is read but the state: rows so far, the last closes, the smoothed range,
    the zigzag's direction, level and last pivots of each symbol. Results are
    those of a full build. Sessions that are stored already are left out, so a
    repeated append changes nothing; the state is written last, so an append
    that is cut off changes nothing either and may be run again. One symbol's
    new bars are one task: append a long history some months at a time. With
    ``now_utc`` sessions that have not closed by then are left out too.
    """
    spark = ticks.sparkSession
    version, state = committed(spark, path)
    state = stored(state, "append-state")
    new = ticks.join(state.select("symbol", "last_session", F.col("ticks").alias("_before")), "symbol", "left")
    new = new.filter(F.col("last_session").isNull() | (F.col("session_date") > F.col("last_session"))).drop("last_session")
    if now_utc is not None:
        new = new.filter(~is_open(F.col("session_date"), F.lit(now_utc).cast("timestamp_ntz")))
    new = stored(new, "append-ticks")
    days = new.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n"))
    dates = sorted(str(r.session_date) for r in days.select("session_date").distinct().collect())
    if not dates:
        return []
    before = days.alias("x").join(days.alias("y"), (F.col("x.symbol") == F.col("y.symbol")) & (F.col("y.session_date") < F.col("x.session_date")), "left")
    before = before.groupBy("x.symbol", "x.session_date").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("_days"))
    offset = F.coalesce("_before", F.lit(0)) + F.col("_days")
    numbered = new.join(before, list(KEYS)).withColumn("tick_ind", offset + F.col("tick_no"))
    base = numbered.groupBy(*KEYS).agg(F.min(offset).alias("_base"))
    built = bars(new, seconds).join(base, list(KEYS))
    built = built.withColumns({"start_ind": F.col("_base") + F.col("start_tick"), "next_ind": F.col("_base") + F.col("last_tick") + 1})
    out = stored(state.groupBy("symbol").cogroup(built.groupBy("symbol")).applyInPandas(_step(), _ROWS), "append-bars")
    for table, rows in (("ticks", numbered.drop("_before", "_days")), ("bars", out.drop("state"))):
        files = rows.hint("rebalance", "session_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        files.partitionBy("session_date").parquet(f"{path}/{table}")
    counts = days.groupBy("symbol").agg(F.max("session_date").alias("last_session"), F.sum("n").alias("_n"))
    ends = out.filter("state is not null").select("symbol", "state.*")
    moved = ends.join(counts, "symbol").join(state.select("symbol", F.col("ticks").alias("_before")), "symbol", "left").withColumn("ticks", F.coalesce("_before", F.lit(0)) + F.col("_n"))
    names = [f.name for f in state.schema.fields]
    moved = moved.select(names).unionByName(state.join(ends.select("symbol"), "symbol", "left_anti").select(names))
    moved.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/version={version + 1:08d}")
    return dates
