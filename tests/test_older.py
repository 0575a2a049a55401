"""The older generation's forms by hand, sinks and refusals."""

import datetime
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tickforge.functions.folders import shared_folder, stored_once
from tickforge.operators import features as FT
from tickforge.operators import older as OL
from tickforge.operators import trading as X
from tickforge.sources import sessions as SS
from tickforge.sources import trades as TR

DAY = datetime.date(2024, 1, 2)
BARS = [(0, 10, 14, 9, 12, True), (1, 12, 13, 8, 9, False), (2, 9, 15, 9, 15, True)]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([("a", DAY, *r) for r in BARS], "symbol string, session_date date, bar_no long, open long, high long, low long, close long, hl boolean")


def test_moves_and_windows_by_hand(bars):
    moved = OL.ordered_moves(bars)
    rows = moved.orderBy("bar_no").collect()
    assert [r.moves for r in rows] == [None, [2, -1, -1, -3], [-3, 2, 1, 6]]
    raw = OL.raw_windows(bars, 1).orderBy("bar_no").collect()
    assert [r.closes for r in raw] == [[12], [12, 9], [9, 15]] and raw[2].highs == [13, 15] and raw[2].lows == [8, 9]
    v = OL.vector_windows(moved.withColumn("ref_px", F.col("open")), 1, norm=2.0).orderBy("bar_no").collect()
    assert v[0].pre_vec is None and v[1].pre_vec == [10, 14, 9, 12, 12, 8, 13, 9]
    assert v[1].movement == [[0.0, None], [2.0, None], [-0.5, None], [1.0, None], [0.0, 1.0], [-2.0, -0.5], [0.5, -0.5], [-1.5, -1.5]]
    assert len(v[2].movement) == 8


def test_resampled_tie_takes_the_bars_own_order(bars):
    b = bars.withColumns({"volume": F.col("bar_no") + 1, "avg_px": F.col("close").cast("double")})
    r = OL.resampled(b, F.lit("w"), "g").first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.hl, r.vec) == (10, 15, 8, 15, 6, False, [10, 8, 15, 15])
    assert r.avg_px == pytest.approx((12 + 18 + 45) / 6) and (r.bar_range, r.bar_diff) == (7, 5)
    one = OL.resampled(b.filter("bar_no = 0"), F.lit("w"), "g").first()
    assert one.hl is True and one.vec == [10, 14, 9, 12]


def test_bands_scales_pads(spark, bars):
    df = bars.withColumns({"20_sma": F.when(F.col("bar_no") > 0, F.lit(10.0)), "20_std": F.lit(2.0)})
    rows = OL.wide_bands(df).orderBy("bar_no").collect()
    assert rows[0].targets is None and rows[1].targets == [10.0, 18.0, 2.0]
    s = OL.scaled(OL.wide_bands(df), ["20_sma"], ["20_std"], ["targets"], norm=4.0).orderBy("bar_no").collect()[1]
    assert s["20_sma"] == 0.25 and s["20_std"] == 0.5 and s.targets == [0.25, 2.25, -1.75]
    xs = spark.createDataFrame([(1.0, None, 3.0)], "a double, b double, c double")
    got = xs.select(OL.padded(OL.stacked(["a", "b", "c"]), 4).alias("p"), OL.padded(OL.stacked(["a", "c"]), 1).alias("q")).first()
    assert got.p == [1.0, 3.0, 0.0, 0.0] and got.q == [1.0]


def test_merged_sizes_show_before_the_next_bar(spark):
    base = spark.createDataFrame([("a", DAY, k, k) for k in range(8)], "symbol string, session_date date, at long, x long")
    big = spark.createDataFrame([("a", DAY, 0, 1), ("a", DAY, 2, 2), ("a", DAY, 5, 3), ("a", DAY, 9, 4)], "symbol string, session_date date, at long, v long")
    got = {r["at"]: (r.x, r.v) for r in OL.merged_sizes(base, big, ["v"]).collect()}
    assert {k: v for k, (_, v) in got.items() if v is not None} == {4: 2, 7: 3} and got[9] == (None, None) and len(got) == 9


def test_burn_in_and_first_rows(spark, bars):
    rows = spark.createDataFrame([("a", k, k >= 2) for k in range(5)] + [("b", k, False) for k in range(3)], "symbol string, row long, ok boolean")
    keep = lambda **how: [(r.symbol, r.row) for r in OL.from_ready(rows, F.col("ok"), **how).orderBy("symbol", "row").collect()]
    assert keep() == [("a", 2), ("a", 3)] and keep(drop_last=False) == [("a", 2), ("a", 3), ("a", 4)]
    double = bars.withColumn("n", F.lit(2)).unionByName(bars.withColumn("n", F.lit(1)))
    assert [r.n for r in OL.after(double, "2024-01-01", ["n"]).collect()] == [1, 1, 1] and OL.after(double, "2024-01-03", ["n"]).count() == 0


def test_stops_must_be_above_zero(spark):
    df = spark.createDataFrame([(1, 2.0)], "row long, x double")

    def body(d):
        return d.withColumns({"tp": F.col("x"), "sl": F.lit(3)})

    assert X.checked_stops(df, body).first().asDict() == {"row": 1, "x": 2.0, "tp": 2.0, "sl": 3.0, "stops": "body"}
    for bad in (0.0, -1.0, None):
        with pytest.raises(Exception, match="sl is not above 0 in stops body"):
            X.checked_stops(df, lambda d: body(d).withColumns({"sl": F.lit(bad).cast("double"), "stops": F.lit("body")})).collect()


def test_trades_are_written_and_read_typed(spark):
    path = shared_folder(spark, "trades")
    rows = [("rsi", "a", "6/6", DAY, 1, 1, 12), ("rsi", "a", "6/6", DAY, 2, -1, -7), ("sma", "a", "6/6", DAY, 3, 1, 0)]
    t = spark.createDataFrame(rows, "strategy string, symbol string, stops string, session_date date, row int, side int, net_usd int")
    TR.write_trades(t, path)
    TR.write_trades(t.filter("strategy = 'sma'"), path)
    got = TR.read_trades(spark, path)
    assert dict(got.dtypes) == {"symbol": "string", "stops": "string", "session_date": "date", "row": "bigint", "side": "bigint", "net_usd": "double", "year": "bigint", "month": "bigint", "strategy": "string"}
    assert sorted((r.strategy, r.row, r.net_usd, r.year, r.month) for r in got.collect()) == [("rsi", 1, 12.0, 2024, 1), ("rsi", 2, -7.0, 2024, 1), ("sma", 3, 0.0, 2024, 1)]


def test_stored_once_follows_the_source(spark, tmp_path):
    source, made = str(tmp_path / "t.parquet"), []
    make = lambda: made.append(1) or spark.read.parquet(source)
    spark.range(3).write.parquet(source)
    assert stored_once(spark, "x", source, make).count() == 3 == stored_once(spark, "x", source, make).count() and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    again = stored_once(spark, "x", source, make)
    assert again.count() == 5 and len(made) == 2
    shutil.rmtree(os.path.dirname(again.inputFiles()[0].removeprefix("file://")))
    assert stored_once(spark, "x", source, make).count() == 5 and len(made) == 3


def test_a_session_with_another_schema_is_named(spark, tmp_path):
    folder = str(tmp_path / "raw")
    for k in range(5):
        df = spark.range(2).withColumn("price", F.lit(1.0))
        (df.withColumn("more", F.lit(1)) if k == 3 else df).coalesce(1).write.parquet(f"{folder}/A_trades_2024-01-0{k + 1}.parquet")
    files = SS.session_files(spark, folder)
    assert SS.read_sessions(spark, files.filter("session_date < date '2024-01-04'")).count() == 6
    with pytest.raises(ValueError, match="A_trades_2024-01-04 differs"):
        SS.read_sessions(spark, files)


def test_warm_up_starts_where_all_sizes_are_ready(spark):
    day = lambda k: DAY + datetime.timedelta(days=k)
    rows = [("a", day(0), 0, None, 1.0), ("a", day(0), 1, 1.0, 1.0), ("a", day(1), 0, 1.0, 2.0), ("a", day(1), 1, None, None), ("a", day(2), 0, None, None), ("b", day(0), 0, 1.0, None)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, bar_no long, x double, y double")
    assert sorted((r.symbol, r.session_date, r.bar_no) for r in FT.warm_up(df, ["x", "y"]).collect()) == [("a", day(1), 0), ("a", day(1), 1), ("a", day(2), 0)]
    with pytest.raises(ValueError, match="no session starts with x, y"):
        FT.warm_up(df.filter("symbol = 'b'"), ["x", "y"])
