"""Steps whose parts grow with the table: what one task holds does not."""

import datetime
import os
import random

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tickforge.catalog import QUERIES
from tickforge.functions import folders
from tickforge.functions.folders import shared_folder
from tickforge.operators import bars as B
from tickforge.operators import indicators as I
from tickforge.operators import search as SE
from tickforge.operators import trading as X
from tickforge.sources.events import trades
from tickforge.streaming import bars as SB


def test_trades_are_dealt_over_parts_that_grow_with_the_table(spark, sf_dir, monkeypatch):
    size = os.path.getsize(f"{sf_dir}/events.parquet")
    for n in (1, 7):
        monkeypatch.setattr(folders, "PART_BYTES", -(-size // n))
        t = trades(spark, sf_dir)
        assert t.rdd.getNumPartitions() == folders.parts(spark, f"{sf_dir}/events.parquet") == n
        held = t.select("symbol", "session_date", F.spark_partition_id().alias("part")).distinct()
        assert held.count() == held.select("symbol", "session_date").distinct().count()


def test_as_of_sizes_build_bars_from_ticks_once(spark, sf_dir, monkeypatch):
    built = []
    real = B.bars
    monkeypatch.setattr(B, "bars", lambda ticks, seconds, *how: built.append(seconds) or real(ticks, seconds, *how))
    for name, smallest in (("asof_all", 300), ("asof_bars", 300), ("forming_bar", 60)):
        built.clear()
        QUERIES[name](spark, sf_dir)
        assert built == [smallest]


def _batches(spark, folder, files):
    """The event ids of each micro-batch of so many files."""
    seen = []
    stream = SB.trade_stream(spark, folder, files_per_batch=files)
    q = stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.event_id for r in b.select("event_id").collect()))).option("checkpointLocation", shared_folder(spark, "batches")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [s for s in seen if s]


def test_steps_of_several_files_stay_in_order_from_batch_to_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id < 90")
    folder = shared_folder(spark, "steps")
    SB.write_in_order(events, folder, "event_id", 3, files=4)
    assert len(spark.read.parquet(folder).inputFiles()) == 12
    got = _batches(spark, folder, 4)
    assert len(got) == 3 and sum(got, []) == list(range(90))


def test_empty_files_stand_in_for_empty_partitions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = shared_folder(spark, "padded")
    for part in ("event_id < 2", "event_id between 10 and 40", "event_id < 0"):
        SB.write_files(events.filter(part).repartition(3, "event_type"), folder, 3)
    assert len(spark.read.parquet(folder).inputFiles()) == 9
    assert _batches(spark, folder, 3) == [[0, 1], list(range(10, 41))]


def test_late_stream_comes_in_files_that_grow_with_the_table(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, QUERIES["stream_late"](spark, sf_dir).collect()))
    monkeypatch.setattr(folders, "PART_BYTES", -(-os.path.getsize(f"{sf_dir}/events.parquet") // 5))
    files = []
    real = SB.write_files
    monkeypatch.setattr(SB, "write_files", lambda rows, folder, n: files.append((n, rows.rdd.getNumPartitions())) or real(rows, folder, n))
    assert sorted(map(tuple, QUERIES["stream_late"](spark, sf_dir).collect())) == want
    assert files == [(5, 5), (5, 5)]


def test_each_bar_is_written_once_and_trades_are_parsed_once(spark, sf_dir, monkeypatch):
    written = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: written.append(path) or real(self, path, *a, **k))
    QUERIES["stream_all_sizes"](spark, sf_dir)
    for batch in range(3):
        own = [p.split("/stream-sizes-")[1].split("/", 1)[1].split("/batch=")[0] for p in written if "/stream-sizes-" in p and f"batch={batch:08d}" in p]
        assert sorted(own) == sorted(["trades", "late", "state", *(f"bars/freq={n}" for n in B.SIZES)])


def test_by_month_holds_no_symbols_history_in_one_task_and_makes_no_bars_beside_those_in_question(spark, sf_dir, monkeypatch):
    """Every window over bars is parted by session or block, and small bars are made only where an entry is open."""
    want = sorted(map(tuple, QUERIES["by_month"](spark, sf_dir).collect()))
    monkeypatch.setattr(folders, "_KEPT", {})
    whole, made, real, write = [], [], B.history, B.write_sizes
    for module in (B, X, I):
        monkeypatch.setattr(module, "history", lambda *by: whole.extend([] if by else ["history"]) or real(*by))
    monkeypatch.setattr(B, "write_sizes", lambda *a, **k: made.append("sizes") or write(*a, **k))
    assert sorted(map(tuple, QUERIES["by_month"](spark, sf_dir).collect())) == want
    assert whole == [] and made == []


def _sessions(spark):
    """Bars of two symbols in sessions of one to forty bars, dealt at random; sides change now and then, some sessions have none."""
    rng, out = random.Random(5), []
    for symbol in ("a", "b", None):
        for k in range(25):
            quiet, price = k % 5 == 2, 20000
            for bar_no in sorted(rng.sample(range(276), rng.choice([1, 2, 15, 40]))):
                price += rng.randint(-3, 3)
                out.append((symbol, datetime.date(2024, 1, 1) + datetime.timedelta(k), bar_no, price + rng.randint(-1, 1), price, 0 if quiet else rng.choice([0, 0, 0, 1, -1])))
    rng.shuffle(out)
    return spark.createDataFrame(out, "symbol string, session_date date, bar_no long, open long, close long, side int")


def test_numbers_and_indicators_by_parts_are_those_of_the_whole_history(spark, monkeypatch):
    bars = _sessions(spark)
    number = lambda df: sorted(map(repr, df.select("symbol", "session_date", "bar_no", "row").collect()))
    assert number(X.numbered(bars)) == number(X.rows(bars))
    look = lambda df: sorted(map(repr, df.select("symbol", "row", "session_date", "close", "sma_rsi").collect()))
    for block in (14, 16, 4096):
        monkeypatch.setattr(I, "BLOCK_ROWS", block)
        assert look(I.in_blocks(X.numbered(bars), lambda b, p: I.sma_rsi(b, by=(p,)), 14)) == look(X.rows(I.sma_rsi(bars)))


def test_next_opposite_row_and_entries_across_sessions(spark):
    df = X.rows(_sessions(spark))
    by = {}
    for r in df.orderBy("row").collect():
        by.setdefault(r.symbol, []).append(r)
    got = {(r.symbol, r.row): r for r in X.turns(df).collect()}
    assert len(got) == sum(map(len, by.values()))
    for symbol, rows in by.items():
        for k, r in enumerate(rows):
            asked = -1 if r.side == 1 else 1
            assert got[symbol, k].change == next((m for m in range(k + 1, len(rows)) if rows[m].side == asked), len(rows))
    sig = X.signals(X.turns(X.session_ends(df, 5, 1320))).collect()
    assert sig and all(by[r.symbol][r.row + 1].open == r.entry_px and by[r.symbol][r.row + 1].session_date == r.session_date for r in sig)


def test_level_search_makes_tiles_of_open_bars_alone(spark, monkeypatch):
    rng, day, price, rows = random.Random(7), datetime.date(2024, 1, 2), 20000, []
    for k, sod in enumerate(sorted(rng.randrange(6000) for _ in range(4000))):
        price += rng.randint(-2, 2)
        rows.append(("a", day, sod, k, price, 1))
    ticks = spark.createDataFrame(rows, "symbol string, session_date date, sod long, tick_no long, price long, volume long")
    bars = B.bars(ticks, 300).withColumn("freq", F.lit("5"))
    entries = bars.select("symbol", "session_date", "start_tick", F.col("bar_no").cast("string").alias("entry_id"), (F.col("open") + F.when(F.col("bar_no") % 4 == 0, 6.0).otherwise(500.0)).alias("upper"), (F.col("open") - 6.0).alias("lower"))
    held = []
    real = SE.inside_open
    monkeypatch.setattr(SE, "inside_open", lambda *a: held.append(real(*a)) or held[0])
    got = {int(r.entry_id): r.hit for r in SE.level_search(entries, bars, ticks, "5", made=False).collect()}
    want, opened = {}, {}
    for _, _, sod, _, p, _ in rows:
        b = sod // 300
        first = opened.setdefault(b, p)
        upper = first + (6 if b % 4 == 0 else 500)
        if not want.get(b):
            want[b] = 1 if p >= upper else -1 if p <= first - 6 else 0
    assert got == want
    asked = {r.b for r in held[0].select(F.floor(F.col("sod") / 300).alias("b")).distinct().collect()}
    assert asked and all(b % 4 == 0 for b in asked)


def test_one_position_at_a_time_keeps_whole_trades(spark):
    rng = random.Random(3)
    rows = [(s, st, d, r, r + rng.randint(1, 9), r * 10) for s in "ab" for st in ("x", "y") for d in (1, 2) for r in sorted(rng.sample(range(d * 100, d * 100 + 60), 25))]
    df = spark.createDataFrame(rows, "symbol string, stops string, session_date int, row long, exit_row long, pnl long").repartition(3)
    want, free = [], {}
    for s, st, d, r, e, p in rows:
        if r >= free.get((s, st, d), -1):
            free[s, st, d] = e
            want.append((s, st, d, r, e, p))
    kept = X.one_at_a_time(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(want)
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
