"""Level search, cascades, chunked zigzags, appends with state, streams and splices against plain loops, and their refusals."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.functions import clock
from tickforge.functions.folders import shared_folder, stored
from tickforge.operators import append as AP
from tickforge.operators import bars as B
from tickforge.operators import indicators as I
from tickforge.operators import pivots as PV
from tickforge.operators import scores as SC
from tickforge.operators import search as SE
from tickforge.operators import stats as ST
from tickforge.operators import ticks as T
from tickforge.operators import trading as X
from tickforge.streaming import bars as SB
from tickforge.streaming import cycles as CY
from tickforge.streaming import sizes as SZ

DAY = datetime.date(2024, 1, 2)


@pytest.fixture(scope="module")
def walked(spark):
    """Ticks of one session: bursts and quiet, a random walk."""
    rng = np.random.default_rng(8)
    sod = np.cumsum(rng.exponential(np.repeat(rng.choice([0.05, 1, 20], 60), 100))).astype(int)
    sod = sod[sod < 82800]
    price = 20000 + np.cumsum(rng.integers(-1, 2, len(sod)))
    rows = [("a", DAY, int(s), k, int(p), 1) for k, (s, p) in enumerate(zip(sod, price))]
    ticks = stored(spark.createDataFrame(rows, "symbol string, session_date date, sod long, tick_no long, price long, volume long"), "walked")
    return sod, price, ticks, B.write_sizes(ticks, shared_folder(spark, "sizes"))


def _entries(spark, walked, size, levels):
    sod, price, _, _ = walked
    bar = sod // B.SIZES[size]
    starts = np.flatnonzero(np.diff(bar, prepend=-1))
    rows = []
    for k, s in enumerate(starts):
        u, v = levels[k % len(levels)]
        rows.append((f"{size}{s}", "a", DAY, int(s), float(price[s] + u), float(price[s] - v)))
    return rows, spark.createDataFrame(rows, "entry_id string, symbol string, session_date date, start_tick long, upper double, lower double")


def _scan(walked, size, start, upper, lower):
    sod, price, _, _ = walked
    end = start
    while end < len(sod) and sod[end] // B.SIZES[size] == sod[start] // B.SIZES[size]:
        if price[end] >= upper:
            return 1
        if price[end] <= lower:
            return -1
        end += 1
    return 0


LEVELS = [(1, 1), (2.5, 3.25), (8, 5), (math.inf, 4), (6, math.inf), (math.inf, math.inf), (-1, 50), (20, 20)]


@pytest.mark.parametrize("size", ["day", "60", "15", "5", "1", "15s", "1s"])
@pytest.mark.parametrize("few", [True, False])
def test_level_search_equals_a_scan_of_ticks(spark, walked, monkeypatch, size, few):
    if not few:
        monkeypatch.setattr(SE, "OPEN_ROWS", -1)
    rows, entries = _entries(spark, walked, size, LEVELS)
    got = {r.entry_id: r.hit for r in SE.level_search(entries, walked[3], walked[2], size).collect()}
    assert got == {r[0]: _scan(walked, size, r[3], r[4], r[5]) for r in rows}


def test_level_search_meets_ticks_of_undecided_seconds_only(spark, walked, monkeypatch):
    rows, entries = _entries(spark, walked, "15s", [(1, 1), (2, 1)])
    met = []
    plain = SE.descend

    def counted(frontier, inside, n, size, leaf):
        keys = [*B.KEYS, "_bar"]
        met.append((size, n, inside.join(frontier.select(keys).distinct(), keys, "left_semi").count()))
        return plain(frontier, inside, n, size, leaf)

    monkeypatch.setattr(SE, "descend", counted)
    SE.level_search(entries, walked[3], walked[2], "15s").count()
    assert [m[0] for m in met] == ["15s", "5s", "1s"] and [m[1] for m in met] == sorted((m[1] for m in met), reverse=True)
    sod, _, _, _ = walked
    busiest = int(np.bincount(sod).max())
    assert met[-1][2] <= met[-1][1] * busiest and met[-1][2] < len(sod) / 2


def test_level_search_refuses(spark, walked):
    _, _, ticks, table = walked
    entry = lambda start, u, v: spark.createDataFrame([("e", "a", DAY, start, u, v)], "entry_id string, symbol string, session_date date, start_tick long, upper double, lower double")
    run = lambda e, t=table: SE.level_search(e, t, ticks, "day").collect()
    with pytest.raises(Exception, match="NaN"):
        run(entry(0, math.nan, 1.0))
    with pytest.raises(Exception, match="not the first tick of a bar of size day"):
        run(entry(1, 20001.0, 19999.0))
    assert run(entry(0, None, None))[0].hit == 0
    hidden = table.withColumns({c: F.when(F.col("freq") == "60", F.lit(20000)).otherwise(F.col(c)) for c in ("high", "low")})
    with pytest.raises(Exception, match="a bar of size day is broken"):
        run(entry(0, 20002.0, 19998.0), hidden)


# ---- cascade


def test_cascade_equals_bars_from_ticks_and_shuffles_ticks_once(spark, walked, monkeypatch):
    _, _, ticks, table = walked
    cols = ["symbol", "session_date", "bar_no", "open", "high", "low", "close", "volume", "n_ticks", "start_tick", "last_tick", "hi_tick", "lo_tick"]
    for name, seconds in B.SIZES.items():
        a, b = table.filter(F.col("freq") == name).select(cols), B.bars(ticks, seconds).select(cols)
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    calls = []
    plain = B.bars
    monkeypatch.setattr(B, "bars", lambda *a: calls.append(a[1]) or plain(*a))
    B.write_sizes(ticks, shared_folder(spark, "sizes"), {"1": 60, "5": 300, "day": 86400})
    assert calls == [60]  # larger sizes never see a tick
    assert B.child("day") == "60" and B.child("15") == "5" and B.child("1s") is None
    plan = plain(ticks, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


# ---- zigzag


@pytest.mark.parametrize("days", [1, 3, 40])
def test_chunked_zigzag_equals_one_walk(spark, days):
    rng = np.random.default_rng(days)
    rows, whole = [], {}
    for name, drift in (("flat", 0), ("up", 1), ("down", -1)):
        n = 900
        close = np.cumsum(rng.integers(-3, 4, n) + (rng.random(n) < 0.2) * drift).astype(float)
        high, low = close + rng.integers(0, 3, n), close - rng.integers(0, 3, n)
        move = np.where(np.arange(n) < 19, np.nan, rng.choice([6.0, 9.0, 25.0], n))
        u, d, flag, last, _ = PV.walk(high, low, move, PV.State(False, low[0]), begin=True)
        for i in range(n):
            day, bar = DAY + datetime.timedelta(days=i // 30), i % 30
            rows.append((name, day, bar, int(high[i]), int(low[i]), None if np.isnan(move[i]) else float(move[i])))
            whole[name, day, bar] = [None if np.isnan(x) else x for x in (u[i], d[i], flag[i], *last[i])]
    bars = spark.createDataFrame(rows, "symbol string, session_date date, bar_no long, high long, low long, m double")
    got = {(r.symbol, r.session_date, r.bar_no): [r.u, r.d, r.flag, *(r[f"last{k}"] for k in range(1, 6))] for r in PV.ud_levels(bars, "m", chunk_days=days).collect()}
    assert got == whole
    numbered = bars.withColumn("_chunk", F.floor(F.unix_date("session_date") / days)).withColumn("_move", F.col("m"))
    assert PV.chunk_states(numbered).filter("symbol = 'flat'").count() == len({(DAY.toordinal() - 719163 + k) // days for k in range(30)})


def test_guesses_say_when_they_hold():
    rng = np.random.default_rng(0)
    sure = 0
    for _ in range(400):
        n = int(rng.integers(5, 90))
        close = np.cumsum(rng.integers(-3, 4, n)).astype(float)
        high, low, move = close + rng.integers(0, 3, n), close - rng.integers(0, 3, n), rng.choice([3.0, 6.0, np.nan], n)
        cut = int(rng.integers(1, n))
        *_, before = PV.walk(high[:cut], low[:cut], move[:cut], PV.State(False, low[0]), begin=True)
        *_, end = PV.walk(high[cut:], low[cut:], move[cut:], before)
        after, holds = PV.through(before, PV.guess(high[cut:], low[cut:], move[cut:], before.rising))
        assert not holds or after == end
        sure += holds
    assert sure > 150


# ---- appends


def _ticks(spark, days, symbols=("a", "b")):
    rng = np.random.default_rng(5)
    rows = []
    for s in symbols:
        for k in range(days):
            for i in range(60):
                rows.append((s, DAY + datetime.timedelta(days=k), int(i * 700 + rng.integers(0, 600)), i, int(20000 + rng.integers(-9, 10) * 3), 1))
    return spark.createDataFrame(rows, "symbol string, session_date date, sod long, tick_no long, price long, volume long")


def test_appends_of_single_sessions_equal_one(spark, monkeypatch):
    ticks = stored(_ticks(spark, 6), "six-days")
    whole, parts = shared_folder(spark, "whole"), shared_folder(spark, "parts")
    assert AP.append(ticks, whole) == [str(DAY + datetime.timedelta(days=k)) for k in range(6)]
    for k in range(6):
        # Only the new session's ticks are there to be read.
        assert AP.append(ticks.filter(F.datediff("session_date", F.lit(DAY)) == k), parts) == [str(DAY + datetime.timedelta(days=k))]
    assert AP.append(ticks, parts) == []
    for table in ("bars", "ticks"):
        a, b = AP.read(spark, whole, table), AP.read(spark, parts, table)
        a = a.select(sorted(a.columns))
        assert a.count() == b.count() > 0 and a.exceptAll(b.select(a.columns)).count() == 0
    bars = AP.read(spark, parts, "bars")
    full = I.atr(I.std(I.sma(B.pointers(B.bars(ticks, 300)))))
    full = full.join(PV.ud_levels(full.withColumn("m", F.round(3 * F.col("20_std"), 6)), "m"), ["symbol", "session_date", "bar_no"])
    names = {"20_sma": "sma", "20_std": "std"}
    r = lambda df, cols: {(x.symbol, x.session_date, x.bar_no): tuple(None if x[c] is None else round(float(x[c]), 6) for c in cols) for x in df.collect()}
    cols = ["start_ind", "next_ind", "20_sma", "20_std", "atr", "u", "d", "flag", "last1", "last5"]
    assert r(full, cols) == r(bars, [names.get(c, c) for c in cols])
    rows = AP.read(spark, parts, "ticks").filter("symbol = 'a'").orderBy("tick_ind").collect()
    assert [x.tick_ind for x in rows] == list(range(360))


def test_a_cut_off_append_changes_nothing(spark, monkeypatch):
    ticks, path = stored(_ticks(spark, 3, ("a",)), "three-days"), shared_folder(spark, "cut")
    AP.append(ticks.filter(F.datediff("session_date", F.lit(DAY)) == 0), path)
    before = AP.read(spark, path, "bars").count()
    kept = type(ticks).coalesce

    def fail(self, n):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(ticks), "coalesce", fail)  # the state's write
    with pytest.raises(RuntimeError):
        AP.append(ticks, path)
    monkeypatch.setattr(type(ticks), "coalesce", kept)
    assert AP.read(spark, path, "bars").count() == before and AP.committed(spark, path)[0] == 1
    AP.append(ticks, path, now_utc="2024-01-04 21:59:00")  # the third session closes at 22:00
    assert AP.committed(spark, path)[1].first().last_session == DAY + datetime.timedelta(days=1)
    AP.append(ticks, path, now_utc="2024-01-04 22:00:00")
    assert AP.read(spark, path, "ticks").count() == 180


def test_last_closed_session_by_hand(spark):
    cases = {"2024-01-03 21:59:59": "2024-01-02", "2024-01-03 22:00:00": "2024-01-03", "2024-01-06 12:00:00": "2024-01-05", "2024-01-07 23:30:00": "2024-01-05", "2024-01-08 22:00:00": "2024-01-08",
             "2024-07-03 20:59:59": "2024-07-02", "2024-07-03 21:00:00": "2024-07-03"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = df.select(F.col("t").cast("string").alias("t"), clock.last_closed_session(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in got} == cases


# ---- streams


def test_late_trades_change_no_bar_and_sizes_tile(spark):
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    t0 = 1704153600
    parts = [[(k, t0 + 10 * k) for k in range(200)], [(500, t0 + 3), (501, t0 + 1995)], [(600, t0 + 5000)]]
    for part in parts:
        rows = [(i, datetime.datetime.fromtimestamp(s - 3600, datetime.timezone.utc).replace(tzinfo=None), 1, "a", 0.0, '{"k": %d}' % (i % 7)) for i, s in part]
        spark.createDataFrame(rows, SB.STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    sizes = {"1s": 1, "5s": 5, "1": 60, "5": 300}
    bars, late = SZ.run(SB.trade_stream(spark, folder), out, sizes=sizes)
    assert [r.event_id for r in late.collect()] == [500]
    bars = bars.collect()
    n = {f: sum(r.n for r in bars if r.freq == f) for f in sizes}
    assert n == {"1s": 201, "5s": 201, "1": 201, "5": 201}  # all but the late one and the last, whose second is open
    minute = {r.start: r for r in bars if r.freq == "1"}
    for r in (r for r in bars if r.freq == "5"):
        own = [minute[s] for s in range(r.start, r.start + 300, 60) if s in minute]
        assert (r.high, r.low, r.volume, r.open, r.close) == (max(m.high for m in own), min(m.low for m in own), sum(m.volume for m in own), own[0].open, own[-1].close)


def test_cycle_step_by_hand():
    assert CY.cycle_step(0, 0, 0, 12, 8, 10, 1, 6) == (1, 10, 10, False, None)
    assert CY.cycle_step(1, 10, 10, 15, 10, 14, 1, 6) == (1, 10, 15, False, None)
    assert CY.cycle_step(1, 10, 15, 16, 10, 11, -1, 6) == (-1, 11, 11, True, 10)
    assert CY.cycle_step(-1, 11, 11, 11, 4, 5, 0, 6) == (0, 5, 5, True, 10)


# ---- splices, slices, percentiles, episodes


def test_splice_refuses(spark):
    schema = "symbol string, session_date date, instrument_id int, at long"
    make = lambda rows: spark.createDataFrame([("a", DAY, i, t) for i, t in rows], schema)
    run = lambda block, main: sorted((r.instrument_id, r["at"]) for r in T.splice_roll(block, main, ["symbol", "session_date"], "at").collect())
    assert run(make([(2, 1), (2, 2)]), make([(1, 1), (1, 5), (2, 3), (2, 4)])) == [(2, 1), (2, 2), (2, 3), (2, 4)]
    with pytest.raises(Exception, match="several contracts"):
        run(make([(2, 1), (3, 2)]), make([(2, 3)]))
    with pytest.raises(Exception, match="overlaps"):
        run(make([(2, 1), (2, 3)]), make([(2, 3)]))
    with pytest.raises(Exception, match="lacks the block's contract"):
        run(make([(2, 1)]), make([(1, 3)]))
    with pytest.raises(ValueError, match="columns differ"):
        T.splice_roll(make([(2, 1)]).withColumn("x", F.lit(1)), make([(2, 2)]), ["symbol"], "at")
    codes = spark.createDataFrame([("H", 2, DAY, DAY), ("M", 2, DAY, DAY), ("U", 3, DAY, DAY)], "code string, instrument_id int, first date, last date")
    assert T.contract_codes(make([(3, 1)]), codes).first().code == "U"
    for i in (2, 9):
        with pytest.raises(Exception, match="contracts have id"):
            T.contract_codes(make([(i, 1)]), codes).collect()


def test_slices_by_hand(spark):
    rows = [("x", "a", 1, "L1", 9, 2023, 12, "2023-12-29", 10.0, 6.0), ("x", "a", 1, "L1", 9, 2024, 1, "2024-01-02", 10.0, 2.0), ("x", "a", -1, "S1", 9, 2024, 1, "2024-01-03", -3.0, -5.0), ("y", "a", 1, "L1", 9, 2024, 1, "2024-01-03", 8.0, 4.0)]
    t = spark.createDataFrame(rows, "strategy string, stops string, side int, signals string, hour int, year int, month int, session_date string, gross_usd double, net_usd double").withColumn("session_date", F.to_date("session_date"))
    got = {(r.strategy, r.label, r.value): r for r in ST.slices(t, ["hour", "year", "month", "side"], "2024-01-01").collect()}
    h = got["x", "hour", "9"]
    assert (h.trades, h.net_usd, h.years, h.years_positive, h.trades_before, h.net_before, h.trades_after, h.net_after) == (3, 3.0, 2, 1, 1, 6.0, 2, -3.0)
    assert h.t_net == pytest.approx(1 / np.std([6, 2, -5], ddof=1) * 3**0.5) and h.win_rate == pytest.approx(2 / 3)
    assert got["x", "signals", "L1"].trades == 2 and got["x", "year x side", "2024 / -1"].net_usd == -5.0
    both = got[ST.ALL, "hour x year x side x signals", "9 / 2024 / 1 / L1"]
    assert (both.trades, both.net_usd, both.years) == (2, 6.0, 1) and both.t_net == pytest.approx(3 / 2**0.5 * 2**0.5)
    assert len(got) == len(ST.slices(t, ["hour", "year", "month", "side"], "2024-01-01").collect())
    with pytest.raises(ValueError, match="no trades"):
        ST.final_run(t, ["strategy", "stops"], ("z", "a"))


@pytest.mark.parametrize("parts", [1, 6])
def test_group_percentiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(3)
    groups = {"one": [4.0], "ties": [1.0] * 50 + [2.0] * 3, "hot": rng.normal(size=4000).round(2).tolist(), "two": [1.0, 9.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("none", None)], "g string, x double").repartition(parts)
    q = (1, 5, 50, 75, 99)
    got = {r.g: [r.n, *(r[f"p{p:02d}"] for p in q)] for r in ST.group_percentiles(df, ["g"], "x", q).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx([len(xs), *np.percentile(xs, q)])


def test_episodes_by_hand(spark):
    days = [("a", DAY + datetime.timedelta(days=k), n, a, a + n - 1) for k, (n, a) in enumerate([(40, 0), (30, 40), (70, 70), (20, 140), (65, 160), (10, 225)])]
    df = spark.createDataFrame(days, "symbol string, session_date date, n long, a long, b long")
    rows = lambda **how: [(r.episode, r.first_row, r.last_row, r.days, r.split) for r in SC.episodes(df, 60, held_out=1, **how).orderBy("episode").collect()]
    assert rows() == [(0, 0, 69, 2, "train"), (1, 10, 139, 1, "train"), (2, 80, 224, 2, "validation"), (3, 165, 234, 1, "test")]
    assert rows(min_steps=80, max_steps=100) == [(0, 10, 109, 1, "validation"), (1, 80, 179, 2, "test")]


def test_forming_atr_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    rows = []
    for day in range(2):
        price = 20000 + np.cumsum(rng.integers(-4, 5, 1380))
        rows += [("a", DAY + datetime.timedelta(days=day), k, int(p), int(p + rng.integers(0, 4)), int(p - rng.integers(0, 4)), int(p)) for k, p in enumerate(price) if rng.random() < 0.4]
    base = spark.createDataFrame(rows, "symbol string, session_date date, bar_no long, open long, high long, low long, close long")
    big = base.groupBy("symbol", "session_date", F.floor(F.col("bar_no") / 60).alias("bar_no")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_no").alias("close"))
    got = {(r.session_date, r.bar_no): r.forming_atr for r in I.forming_atr(base, big, 60).collect()}
    closed, at = [], None
    for _, day, k, _, high, low, close in rows:
        if at is not None and at[0] != (day, k // 60):
            closed.append(at[1])
            at = None
        h, l = (high, low) if at is None else (max(at[1][0], high), min(at[1][1], low))
        at = ((day, k // 60), (h, l, close))
        want = None
        if len(closed) >= 14:
            bars = [*closed[-14:], at[1]]
            tr = [max(b[0] - b[1], abs(b[0] - a[2]), abs(b[1] - a[2])) for a, b in zip(bars, bars[1:])]
            want = (sum(tr) / 14 * 13 + tr[-1]) / 14
        assert got[day, k] == (None if want is None else pytest.approx(want))


def test_holding_runs_by_hand(spark):
    rows = [(0, 10, 11, 1), (1, 12, 13, 1), (2, 15, 9, -1), (3, 11, 12, 0), (4, 12, 14, 0), (5, 13, 13, 1)]
    df = spark.createDataFrame([("a", DAY, 0, *r) for r in rows], "symbol string, session_date date, half long, bar_no long, open long, close long, direction int")
    got = {r.direction: (r.runs, r.mean_length, r.mean_reward, r.reward, r.flat_reward) for r in SC.holding_runs(df).collect()}
    assert got[1][:4] == (2, 1.5, 2.5, 5) and got[-1][:4] == (1, 1.0, 4.0, 4) and got[0][:4] == (1, 2.0, None, None)
    way = lambda b, c, d, net: max(c - b, b - d) - 2 * min(c - b, b - d) + abs(net)
    assert got[0][4] == way(11, 14, 12, 2)
    assert got[1][4] == got[-1][4] == pytest.approx((way(10, 13, 11, 5) + way(15, 9, 9, 4) + way(13, 13, 13, 0)) / 3)


def test_ewm_of_large_alpha(spark):
    x = np.random.default_rng(5).normal(size=900)
    df = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)], "symbol string, session_date int, bar_no int, x double")
    for alpha in (0.97, 0.5, 1.0):
        want, y = [], None
        for v in x:
            y = v if y is None else y * (1 - alpha) + v * alpha
            want.append(y)
        got = [r.y for r in I.ewm(df, "x", "y", alpha).orderBy("bar_no").collect()]
        np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("sessions", [1, 3, 7])
def test_volatility_band_equals_a_plain_window(spark, sessions):
    rng = np.random.default_rng(sessions)
    rows = [(s, DAY + datetime.timedelta(days=k), i, float(rng.integers(0, 9)) if rng.random() < 0.9 else None) for s in "ab" for k in range(34) for i in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, "symbol string, session_date date, bar_no int, v double")
    got = {(r.symbol, r.session_date, r.bar_no): r.vol_ok for r in X.vol_ok(df, "v", (0.2, 0.8), sessions).collect()}
    for s, day, i, v in rows:
        back = (day - DAY).days
        xs = [x for t, d, _, x in rows if t == s and back - sessions <= (d - DAY).days < back and x is not None]
        want = back >= sessions and v is not None and len(xs) > 0 and np.percentile(xs, 20) <= v <= np.percentile(xs, 80)
        assert got[s, day, i] == want
