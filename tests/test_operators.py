"""Properties that hold beyond the oracles."""

import numpy as np
from pyspark.sql import functions as F

from tickforge.operators import bars as B
from tickforge.operators import indicators as I
from tickforge.operators import ticks as T
from tickforge.operators.pivots import zigzag
from tickforge.sources.events import fills, trades


def test_roll_up_equals_direct(spark, sf_dir):
    t = T.merge(fills(trades(spark, sf_dir)))
    cols = ["symbol", "session_date", "bar_no", "open", "high", "low", "close", "volume", "hi_tick", "lo_tick"]
    a = B.bars(t, 3600).select(cols)
    b = B.roll_up(B.roll_up(B.bars(t, 1), 60), 60).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_merge_keeps_volume(spark, sf_dir):
    f = T.in_session(fills(trades(spark, sf_dir)))
    merged = T.merge(fills(trades(spark, sf_dir)))
    assert f.agg(F.sum("size")).first()[0] == merged.agg(F.sum("volume")).first()[0]


def test_zigzag_has_no_look_ahead():
    rng = np.random.default_rng(3)
    close = np.cumsum(rng.integers(-3, 4, 400)).astype(float)
    high, low, move = close + 1, close - 1, np.full(400, 6.0)
    whole = zigzag(high, low, move)
    for cut in (1, 17, 200, 399):
        part = zigzag(high[:cut], low[:cut], move[:cut])
        for a, b in zip(whole, part, strict=True):
            np.testing.assert_array_equal(a[:cut], b)


def test_ewm_over_many_chunks(spark):
    n = 1200
    x = np.random.default_rng(5).normal(size=n)
    df = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)], "symbol string, session_date int, bar_no int, x double")
    got = [r.y for r in I.ewm(df, "x", "y", 1 / 14).orderBy("bar_no").collect()]
    want, y = [], None
    for v in x:
        y = v if y is None else y * (13 / 14) + v / 14
        want.append(y)
    np.testing.assert_allclose(got, want, atol=1e-9)
