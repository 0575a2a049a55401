"""Scores against hand-computed cases and plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.operators import bars as B
from tickforge.operators import features as FT
from tickforge.operators import indicators as I
from tickforge.operators import scores as SC
from tickforge.operators import stats as ST
from tickforge.operators import trading as X
from tickforge.sources.calendars import holidays
from tickforge.sources.events import json_trades


def test_bar_patterns_by_hand(spark):
    rows = [(0, 20, 22, 4, 21, 4.0), (1, 20, 36, 18, 19, 4.0), (2, 20, 22, 4, 21, 20.0), (3, 20, 22, 4, 21, None)]
    df = spark.createDataFrame(rows, "bar_no int, open long, high long, low long, close long, `20_std` double")
    got = SC.bar_patterns(df).orderBy("bar_no").select("bar_score", "needle", "large_candle").collect()
    assert [tuple(r) for r in got] == [(13 / 320, 0.875, 0.0), (13 / 320, -0.875, 0.0), (13 / 320, 0.0, 0.0), (13 / 320, 0.0, 0.0)]


def test_rsi_stretch_by_hand(spark):
    xs = [0.5, -0.5, 0.005, 0.0, 1.0, None]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(SC.rsi_stretch(F.col("x")).alias("y")).collect()]

    def want(x):
        sign = math.tanh(x / 0.01) if abs(x) < 0.01 else math.copysign(1, x)
        return 1.6128 * math.tanh(1.6128 * sign * (abs(x) + 1e-8) ** 1.6128 / 1.6128)

    assert got[5] is None and got[:5] == pytest.approx([want(x) for x in xs[:5]]) and got[0] == pytest.approx(0.5093, abs=1e-4)


def test_inertia_of_even_steps(spark):
    df = spark.createDataFrame([("a", 0, i, 2 * i) for i in range(22)], "symbol string, session_date int, bar_no int, close long")
    got = [r.inertia for r in I.inertia(df).orderBy("bar_no").collect()]
    raw = lambda v: 1 / (1 + math.exp(-2.5 * (v - 3)))
    assert got[:20] == [None] * 20 and got[20:] == pytest.approx([(raw(2) - raw(1)) / (1 - raw(1))] * 2)


def test_zscore_equals_the_weighted_definition(spark):
    x = np.random.default_rng(7).integers(1, 90, 700).astype(float)
    df = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)], "symbol string, session_date int, bar_no int, v double")
    for span in (20, 4000):
        got = np.array([np.nan if r.z is None else r.z for r in I.ewm_zscore(df, "v", "z", span).orderBy("bar_no").collect()])
        s = pd.Series(x)
        want = (s - s.ewm(span=span).mean()) / s.ewm(span=span).std().clip(lower=1e-8)
        np.testing.assert_allclose(got, want.to_numpy(), atol=1e-6)


def test_kelly_and_account_value(spark):
    rng = np.random.default_rng(2)
    runs = {"few": [50.0] * 29, "some": [*map(float, rng.integers(-200, 260, 60))], "many": [*map(float, rng.integers(-40, 400, 150))], "loss": [-10.0] * 40}
    rows = [(n, k, x) for n, xs in runs.items() for k, x in enumerate(xs)]
    t = spark.createDataFrame(rows, "run string, k int, net_usd double")
    got = {r.run: r for r in SC.ewm_kelly(t, ["run"], [F.desc("k")]).collect()}
    for name, xs in runs.items():
        r, n = np.array(xs) / 320, len(xs)
        w = (1 - 2 / 1001) ** np.arange(n)[::-1]
        mu, sigma, win = (w * r).sum() / w.sum(), ((w * np.minimum(r, 0) ** 2).sum() / w.sum()) ** 0.5, w[r > 0].sum() / w.sum()
        if n < 30:
            mu = sigma = win = 0.0
        f = min(mu / sigma**2, 2) * 0.5 if mu > 0 and sigma > 0 else 0.0
        sure = 0.3 if n < 30 else 0.3 + (n - 30) / 70 * f if n < 100 else f
        assert (got[name].n_trades, got[name].mu, got[name].sigma, got[name].win_rate, got[name].kelly_f, got[name].confidence) == pytest.approx((n, mu, sigma, win, f, sure))
    v = spark.createDataFrame([(1, 100.0, 0.0), (2, -1.0, 5.0), (3, 20.0, 300.0)], "i int, mu double, sigma double")
    one, two, three = SC.account_value(v).orderBy("i").collect()
    assert (one.p_pass, one.p_activation, one.cost_per_success, one.ev_per_attempt, one.payout) == (1, 1, 198, 1602, 1800)
    assert (two.p_pass, two.cost_per_success, two.ev_per_attempt) == (0, None, -49)
    p = (1 - math.exp(-2 * 20 * 2000 / (300**2 * 5))) / (1 - math.exp(-2 * 20 * 5000 / (300**2 * 5)))
    assert three.p_pass == pytest.approx(p, abs=1e-4)


def test_direction_is_held(spark):
    rows = [("a", 0, 0, i, o, c) for i, (o, c) in enumerate([(10, 10), (10, 20), (12, 20), (20, 20)])] + [("a", 0, 1, 9, 10, 30)]
    df = spark.createDataFrame(rows, "symbol string, session_date int, half int, bar_no int, open long, close long")
    got = SC.direction_labels(df, expected=4, ahead=2).orderBy("bar_no").collect()
    assert [r.direction for r in got] == [0, 1, 1, 1, 0]


def _plain_board(side, close):
    """One variant by a loop over its bars."""
    position, entry, closed, out = 0, 0.0, [], []
    for j, c in enumerate(close):
        target = side[j + 1] if j + 1 < len(side) else 0
        if position != target:
            if position:
                closed.append((c - entry) * position * 12.5 - 29)
            position, entry = target, c
        n, last = len(closed), np.array(closed[-100:])
        row = [position, ((c - entry) * position * 12.5 - 29) / 320 if position else 0.0, 0.0, 0.0, 0.0]
        if n >= 2:
            w = (1 - 2 / 201) ** np.arange(len(last))[::-1]
            mu = (w * last).sum() / w.sum()
            sigma = ((w * (last - mu) ** 2).sum() / w.sum()) ** 0.5
            sure = min(n / 30, 1)
            row[2:] = [mu / sigma * sure if sigma > 1e-8 else 0.0, w[last > 0].sum() / w.sum() * sure, mu / 320 * sure]
        out.append(row)
    return out


@pytest.fixture(scope="module")
def board(spark):
    rng = np.random.default_rng(4)
    close = np.cumsum(rng.integers(-6, 7, 420)) + 20000
    sides = {(f, v): rng.choice([-1, 0, 1], 420, p=[0.3, 0.2, 0.5]) for f in ("long", "short") for v in range(1, 8)}
    rows = [("a", f, v, 0, j, j, int(close[j]), int(s)) for (f, v), xs in sides.items() for j, s in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, fam string, variant int, session_date int, bar_no int, row int, close long, side int")
    want = {(f, v): _plain_board(xs.tolist(), close.tolist()) for (f, v), xs in sides.items()}
    return SC.variant_scores(df).cache(), want


def test_variant_scores_equal_a_loop(board):
    df, want = board
    for r in df.collect():
        assert [r.position, r.floating, r.sharpe, r.win_rate, r.realised] == pytest.approx(want[r.fam, r.variant][r.row], abs=1e-9)


def _top(scores, n=5):
    return sorted(scores, key=lambda v: (-round(scores[v], 9), v))[:n]


def test_consensus_and_kalman_equal_loops(board):
    df, want = board
    got = {r.bar_no: r.consensus for r in SC.consensus(df, {"long": 0.6, "short": 0.05}).collect()}
    for j in range(420):  # the short family is below the least confidence
        best = _top({v: want["long", v][j][2] for v in range(1, 8)})
        k = {v: (1 if round(m, 9) >= 0.01 else 0.1) * (1 if f >= 0 else 0.5) * (1 if round(s, 9) >= 0.01 else 0.7) for v in best for _, f, s, _, m in [want["long", v][j]]}
        assert got[j] == pytest.approx(sum(k[v] * want["long", v][j][0] for v in best) / sum(k.values()), abs=1e-9)
    ranked = {}
    for r in SC.kalman_rank(df).collect():
        ranked.setdefault((r.fam, r.row), {})[r.place] = r.variant
    for fam in ("long", "short"):
        mean, var = dict.fromkeys(range(1, 8), 0.0), 1.0
        for j in range(420):
            var += 0.1
            gain = var / (var + 1)
            mean = {v: m + gain * (want[fam, v][j][2] - m) for v, m in mean.items()}
            var *= 1 - gain
            best = _top({v: m / (var + 1e-8) ** 0.5 for v, m in mean.items()})
            assert [ranked[fam, j][p] for p in range(1, 6)] == best


def test_regime_equals_padded_buffers(spark, board):
    df, want = board
    vol = np.random.default_rng(6).random(420) * 5
    v = spark.createDataFrame([("a", j, float(x)) for j, x in enumerate(vol)], "symbol string, row int, vol double")
    pad = np.zeros(200)
    for r in SC.regime(df, v).filter("fam = 'long'").collect():
        j = r.bar_no + 200
        m = np.concatenate([pad, np.mean([[x[4] for x in want["long", k]] for k in range(1, 8)], axis=0)])
        s = np.concatenate([pad, np.mean([[x[2] for x in want["long", k]] for k in range(1, 8)], axis=0)])
        w = np.concatenate([pad, vol])
        out = [m[j] - m[j - h] for h in (20, 60, 120, 200)] + [np.polyfit(np.arange(20), s[j - 19 : j + 1], 1)[0], math.log((w[j] + 1e-3) / (w[j - 20] + 1e-3))]
        assert [r.d20, r.d60, r.d120, r.d200, r.slope, r.log_vol] == pytest.approx(np.clip(out, -3, 3).tolist(), abs=1e-7)


def test_order_is_checked(spark, tmp_path):
    rows = [("a", "2024-01-02", i, s, x) for i, (s, x) in enumerate([(0, None), (5, 1.0), (5, 2.0), (9, 3.0)])] + [("a", "2024-01-03", 0, 12, 4.0)]
    f = spark.createDataFrame(rows, "symbol string, d string, bar_no int, start_ind long, x double").withColumn("session_date", F.to_date("d")).drop("d")
    r = B.order_violations(f).first()
    assert (r.bars, r.violations, r.last_start) == (5, 1, 12)
    FT.write_features(f, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="start_ind"):
        FT.read_features(spark, str(tmp_path / "f"), ["x"])
    FT.write_features(f.filter("bar_no <> 2"), str(tmp_path / "g"))
    got = FT.read_features(spark, str(tmp_path / "g"), ["x"], ready="x").collect()
    assert [(r.bar_no, r.start_ind, r.x) for r in got] == [(0, 12, 4.0)]


def test_recorders_and_calendars(spark, tmp_path):
    def read(line, fields, unit):
        return json_trades(spark.createDataFrame([(line,)], "value string"), fields, unit).select("id", "size", F.col("ts_utc").cast("string").alias("t")).first()

    names = {"id": "_id", "time": "t", "size": "q"}
    assert tuple(read('{"_id": 1, "t": 1704067261, "q": 3, "more": {}}', names, "s")) == (1, 3, "2024-01-01 00:01:01")
    assert tuple(read('{"_id": 1, "t": 1704067261250, "q": 3}', names, "ms")) == (1, 3, "2024-01-01 00:01:01.25")
    assert tuple(read('{"_id": 1, "t": {"$date": "2024-01-01T00:01:01.250Z"}, "q": 3}', names, "$date")) == (1, 3, "2024-01-01 00:01:01.25")
    assert tuple(read("no json", names, "s")) == (None, None, None)
    with pytest.raises(ValueError):
        read("{}", names, "h")
    (tmp_path / "h.json").write_text('{"2024-01-01": "New Year"}')
    assert [str(r.session_date) for r in holidays(spark, str(tmp_path / "h.json")).collect()] == ["2024-01-01"]
    assert holidays(spark, ["2024-01-01", "2024-01-01", "2024-01-15"]).count() == 2
    stops = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 3.0, 2.0)], "stops string, tp double, sl double")
    assert sorted((r.stops, r.fixed) for r in ST.fixed_pairs(stops).collect()) == [("a", 1), ("b", 0)]


def test_next_opposite_row(spark):
    side = [1, 0, -1, 1, 1, -1, 0, 1]
    df = spark.createDataFrame([("a", 0, i, s) for i, s in enumerate(side)], "symbol string, session_date int, row int, side int")
    got = [r.change for r in X.turns(df).orderBy("row").collect()]
    assert got == [next((j for j in range(i + 1, 8) if side[j] == (-1 if s == 1 else 1)), 8) for i, s in enumerate(side)]


def test_buckets_are_nearest_rank(spark):
    xs = [float(x) for x in np.random.default_rng(1).integers(0, 12, 100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(100, None)], "i int, x double")
    got = {r.i: r.bucket for r in ST.buckets(df, "x", {"low": 1 / 3, "mid": 2 / 3}, "high").collect()}
    lo, hi = (sorted(xs)[int(99 * q + 0.5)] for q in (1 / 3, 2 / 3))
    assert got == {i: "low" if x <= lo else "mid" if x <= hi else "high" for i, x in enumerate(xs)} | {100: None}
