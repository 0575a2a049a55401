"""Queries over ticks, bars and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.clock import epoch_s, epoch_us, is_open, last_closed_session, session_clock
from tickforge.functions.folders import shared_folder, stored
from tickforge.operators import bars as B
from tickforge.operators import indicators as I
from tickforge.operators import ticks as T
from tickforge.operators import scores as SC
from tickforge.operators.pivots import ud_levels
from tickforge.sources import calendars as C
from tickforge.sources.events import events, fills, json_trades, pull, trades

from . import sql as S
from .registry import query

W = S.W


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return T.merge(fills(trades(spark, d)))


def bars5(spark: SparkSession, d: str) -> DataFrame:
    return B.bars(ticks(spark, d), 300)


KEY = ["symbol", "session_date", "bar_no"]
DAY = "strftime(session_date, '%Y-%m-%d') as session_date"


def day(df: DataFrame) -> DataFrame:
    """Session dates as text, for comparison."""
    return df.withColumn("session_date", F.date_format("session_date", "yyyy-MM-dd"))


def r6(c: str, name: str | None = None):
    return (F.round(F.col(c).cast("double"), 6) + 0.0).alias(name or c)


@query("session_clock", f"with {S.TRADES} select arrival_id, epoch_us(ts_clock) as us, {DAY} from trades")
def session_clock_q(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("arrival_id"), session_clock(F.col("ts")).alias("c"))
    return e.select("arrival_id", epoch_us(F.col("c")).alias("us"), F.date_format("c", "yyyy-MM-dd").alias("session_date"))


@query("out_of_session", f"with {S.TRADES} select arrival_id, symbol, {DAY} from trades where sod >= 82800")
def out_of_session_q(spark, d):
    return day(T.out_of_session(trades(spark, d)).select("arrival_id", "symbol", "session_date"))


@query("price_ticks", f"with {S.TRADES} select arrival_id, price_ticks / 4.0::double as price, cast(price_ticks as int) as ticks from trades")
def price_ticks_q(spark, d):
    return trades(spark, d).select("arrival_id", "price", (F.col("price") * 4).cast("int").alias("ticks"))


@query("off_grid", "select l_orderkey, l_linenumber, l_extendedprice as price from lineitem where abs(round(l_extendedprice * 4) - l_extendedprice * 4) > 1e-6")
def off_grid_q(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return li.filter(F.abs(F.rint(F.col("price") * 4) - F.col("price") * 4) > 1e-6)


@query("tick_labels", f"with {S.TICKS} select symbol, {DAY}, tick_no, cast(sod >= 55800 and sod < 79200 as int) as rth, cast(sod // 28800 + 1 as int) as session, cast(sod // 3600 as int) as hour from ticks")
def tick_labels_q(spark, d):
    return day(T.labelled(ticks(spark, d)).select("symbol", "session_date", "tick_no", "rth", "session", "hour"))


@query("epoch", "select event_id, epoch_us(ts) // 1000000 as s from events")
def epoch_q(spark, d):
    return events(spark, d).select("event_id", epoch_s(F.col("ts")).alias("s"))


@query("multi_contract", f"with {S.TRADES} select {DAY}, count(distinct instrument_id) as n from trades group by session_date having count(distinct instrument_id) > 1")
def multi_contract_q(spark, d):
    n = trades(spark, d).groupBy("session_date").agg(F.countDistinct("instrument_id").alias("n"))
    return day(n.filter("n > 1"))


@query("market_closed", "select event_id from events where (dayofweek(ts) = 6 and hour(ts) >= 6) or (dayofweek(ts) = 0 and hour(ts) < 21)")
def market_closed_q(spark, d):
    dow, h = F.dayofweek("ts"), F.hour("ts")
    return events(spark, d).filter(((dow == 7) & (h >= 6)) | ((dow == 1) & (h < 21))).select("event_id")


@query("json_trades", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as size, (case event_id % 3 when 0 then epoch_us(ts) // 1000000 * 1000000 else epoch_us(ts) // 1000 * 1000 end)::bigint as us from events")
def json_trades_q(spark, d):
    """Trades as JSON lines of three recorders, with fields and times of their own, parsed into one table."""
    e = events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", epoch_us(F.col("ts")).alias("us"))
    size, px = F.col("k").alias("qty"), F.col("k").alias("size")
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    kinds = [
        ({"id": "_id", "time": "t", "size": "qty"}, "s", F.struct(F.col("event_id").alias("_id"), F.floor(F.col("us") / 1_000_000).alias("t"), size)),
        ({"id": "n", "time": "at", "size": "size"}, "ms", F.struct(F.col("event_id").alias("n"), F.floor(F.col("us") / 1000).alias("at"), px)),
        ({"id": "_id", "time": "time", "size": "qty"}, "$date", F.struct(F.col("event_id").alias("_id"), F.struct(iso.alias("$date")).alias("time"), size)),
    ]
    lines = [e.filter(F.col("event_id") % 3 == k).select(F.to_json(doc).alias("value")) for k, (_, _, doc) in enumerate(kinds)]
    out = [json_trades(part, fields, unit) for part, (fields, unit, _) in zip(lines, kinds, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select(F.col("id").alias("event_id"), "size", epoch_us(F.col("ts_utc")).alias("us"))


@query("session_pull", f"with {S.TRADES} select arrival_id, price_ticks from trades where symbol = 'click' and session_date = date '2024-01-10' and sod < 82800")
def session_pull_q(spark, d):
    return pull(trades(spark, d), "click", "2024-01-10").select("arrival_id", "price_ticks")


@query("ticks_since", f"with {S.TICKS} select symbol, {DAY}, tick_no, price from ticks where session_date >= date '2024-01-20'")
def ticks_since_q(spark, d):
    return day(T.merge(fills(trades(spark, d, since="2024-01-20"))).select("symbol", "session_date", "tick_no", "price"))


@query("last_session", f"with {S.TICKS} select symbol, strftime(max(session_date), '%Y-%m-%d') as session_date, arg_max(price, arrival_id) as price from ticks group by symbol")
def last_session_q(spark, d):
    return day(ticks(spark, d).groupBy("symbol").agg(F.max("session_date").alias("session_date"), F.max_by("price", "arrival_id").alias("price")))


@query("first_sessions", f"with {S.TICKS}, r as (select *, dense_rank() over (partition by symbol order by session_date) as n from ticks) select symbol, {DAY}, count(*) as n_ticks from r where n <= 5 group by symbol, session_date")
def first_sessions_q(spark, d):
    n = ticks(spark, d).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n_ticks"))
    return day(n.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy("session_date"))).filter("_r <= 5").drop("_r"))


@query("sessions", f"with {S.TICKS} select distinct {DAY} from ticks")
def sessions_q(spark, d):
    return day(ticks(spark, d).select("session_date").distinct())


@query("sample_10h", "select event_id from events where ts <= (select min(ts) + interval 10 hour from events)")
def sample_10h_q(spark, d):
    e = events(spark, d)
    first = e.agg((F.min("ts") + F.expr("INTERVAL '10' HOUR")).alias("until"))
    return e.join(F.broadcast(first), F.col("ts") <= F.col("until")).select("event_id")


@query("ticks", f"with {S.TICKS} select symbol, {DAY}, tick_no, epoch_us(ts_clock) as us, price, volume, arrival_id from ticks")
def ticks_q(spark, d):
    return day(ticks(spark, d).select("symbol", "session_date", "tick_no", epoch_us(F.col("ts_clock")).alias("us"), "price", "volume", "arrival_id"))


_INDEXED = f"""with {S.TICKS}, {', '.join(S.bars(x, f'b{n}', False) for n, x in B.SIZES.items())}, i as (select *, row_number() over (partition by symbol order by session_date, tick_no) - 1 as tick_ind from ticks)
select i.symbol, strftime(i.session_date, '%Y-%m-%d') as session_date, tick_ind, i.price""" + "".join(f", sod // {x} as bar_{n}, coalesce(b{n}.high, 0) as high_{n}, coalesce(b{n}.low, 0) as low_{n}, coalesce(tick_ind - tick_no + b{n}.last_tick + 1, 0) as next_{n}" for n, x in B.SIZES.items()) + " from i" + "".join(f" left join b{n} on b{n}.symbol = i.symbol and b{n}.session_date = i.session_date and b{n}.start_tick = i.tick_no" for n in B.SIZES)


@query("ticks_indexed", _INDEXED)
def ticks_indexed_q(spark, d):
    """Written and read back: every tick with its global row, its bars of ten sizes, and on a bar's first row that bar's high, low and past-last row (else 0)."""
    t = stored(ticks(spark, d), "ticks")
    table = B.write_sizes(t, shared_folder(spark, "sizes"))
    columns = ["symbol", "session_date", "tick_ind", "price", *(f"{c}_{n}" for n in B.SIZES for c in ("bar", "high", "low", "next"))]
    out = B.index_ticks(T.with_tick_ind(t), table).select(columns)
    path = shared_folder(spark, "indexed")
    out.hint("rebalance", "session_date").write.option("compression", "zstd").partitionBy("session_date").parquet(path)
    return day(spark.read.schema(out.schema).parquet(path).select(columns))


def _bars_sql(seconds: int) -> str:
    return f"with {S.TICKS}, {S.bars(seconds, row=False)} select symbol, {DAY}, bar_no, open, high, low, close, volume, n_ticks from bars"


def _bars_q(seconds: int):
    def run(spark, d):
        # One size is one aggregation of the ticks; a table of all sizes is a cascade (bars_all).
        return day(B.bars(ticks(spark, d), seconds).select(*KEY, "open", "high", "low", "close", "volume", "n_ticks"))

    return run


for _name, _seconds in (("bars_5s", 5), ("bars_1m", 60), ("bars_5m", 300), ("bars_15m", 900), ("bars_60m", 3600), ("bars_day", 86400)):
    query(_name, _bars_sql(_seconds))(_bars_q(_seconds))


@query("bar_hl", f"with {S.BARS5} select symbol, {DAY}, bar_no, cast(hi_tick < lo_tick as int) as hl from bars")
def bar_hl_q(spark, d):
    return day(B.with_hl(bars5(spark, d)).select(*KEY, F.col("hl").cast("int").alias("hl")))


@query("bar_pointers", f"with {S.BARS5} select symbol, {DAY}, bar_no, cast(sum(n_ticks) over ({W}) - n_ticks as bigint) as start_ind, cast(sum(n_ticks) over ({W}) as bigint) as next_ind from bars")
def bar_pointers_q(spark, d):
    return day(B.pointers(bars5(spark, d)).select(*KEY, "start_ind", "next_ind"))


@query("bar_starts", f"with {S.BARS5} select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, t.price, epoch_us(t.ts_clock) as us from bars b join ticks t on b.symbol = t.symbol and b.session_date = t.session_date and b.start_tick = t.tick_no")
def bar_starts_q(spark, d):
    t = ticks(spark, d).select("symbol", "session_date", F.col("tick_no").alias("start_tick"), "price", epoch_us(F.col("ts_clock")).alias("us"))
    return day(bars5(spark, d).select(*KEY, "start_tick").join(t, ["symbol", "session_date", "start_tick"]).drop("start_tick"))


@query("bar_tiling", f"with {S.TICKS}, {S.bars(300, 'a', False)}, {S.bars(3600, 'b', False)} select symbol, {DAY}, bar_no, high, low, volume from b where (symbol, session_date, bar_no, high, low, volume) in (select symbol, session_date, bar_no // 12, max(high), min(low), cast(sum(volume) as bigint) from a group by 1, 2, 3)")
def bar_tiling_q(spark, d):
    t = ticks(spark, d)
    parents, tiled = B.bars(t, 3600), B.roll_up(B.bars(t, 300), 12)
    cols = [*KEY, "high", "low", "volume"]
    return day(parents.select(cols).join(tiled.select(cols), cols, "left_semi"))


@query("dedup_bars", f"with {S.BARS5}, u as (select * from bars union all select * from bars) select symbol, {DAY}, bar_no, open from (select *, row_number() over (partition by symbol, session_date, bar_no order by start_tick) as r from u) where r = 1")
def dedup_bars_q(spark, d):
    b = bars5(spark, d)
    u = b.unionByName(b).withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy("start_tick")))
    return day(u.filter("_r = 1").select(*KEY, "open"))


@query("bar_shape", f"with {S.BARS5} select symbol, {DAY}, bar_no, high - low as bar_range, close - open as bar_diff, close - lag(close) over ({W}) as px_diff, round((open + high + low + close) / 4.0, 6) as avg_px, cast(abs(open - high) < abs(open - low) as int) as hl from bars")
def bar_shape_q(spark, d):
    b = bars5(spark, d)
    return day(b.select(*KEY, (F.col("high") - F.col("low")).alias("bar_range"), (F.col("close") - F.col("open")).alias("bar_diff"), (F.col("close") - F.lag("close").over(B.history())).alias("px_diff"),
                        F.round((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / F.lit(4.0), 6).alias("avg_px"), (F.abs(F.col("open") - F.col("high")) < F.abs(F.col("open") - F.col("low"))).cast("int").alias("hl")))


@query("bar_patterns", f"""with {S.BARS5}, p as (select *, high - open as u, open - low as l, round(case when count(close) over ({W} rows 19 preceding) = 20 then stddev_pop(close) over ({W} rows 19 preceding) end, 9) as sd,
  greatest(least(open - low, close - low)::double, 0.01) as dn, greatest(high - open, high - close) as dfar, greatest(least(high - open, high - close)::double, 0.01) as un, greatest(open - low, close - low) as ufar from bars)
select symbol, {DAY}, bar_no, round((greatest(u, l) - 2 * least(u, l) + abs(close - open)) / 320.0::double, 6) + 0 as bar_score,
  round(case when ufar / un < 0.25 and un > sd then ufar / un - 1 when dfar / dn < 0.25 and dn > sd then 1 - dfar / dn else 0 end, 6) + 0 as needle, 0::double as large_candle from p""")
def bar_patterns_q(spark, d):
    b = SC.bar_patterns(I.std(bars5(spark, d)))
    return day(b.select(*KEY, *((F.round(c, 6) + 0.0).alias(c) for c in ("bar_score", "needle", "large_candle"))))


_SIGMOID_SQL = "(1 / (1 + exp(-2.5 * (abs({0}) - 3))) - 1 / (1 + exp(5::double))) / (1 - 1 / (1 + exp(5::double))) * sign({0})"


@query("scalar_math", f"select l_orderkey, l_linenumber, round(sign(x) * ln(1 + abs(x)), 6) as symlog, round({_SIGMOID_SQL.format('(x / 5.0::double)')}, 6) + 0 as sigmoid from (select *, l_quantity - 25 as x from lineitem)")
def scalar_math_q(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("x", F.col("l_quantity") - 25)
    sigmoid = I.sigmoid_transform(F.col("x") / F.lit(5.0))
    return li.select("l_orderkey", "l_linenumber", F.round(F.signum("x") * F.log1p(F.abs("x")), 6).alias("symlog"), (F.round(sigmoid, 6) + 0.0).alias("sigmoid"))


@query("normalise", f"with {S.BARS5} select symbol, {DAY}, bar_no, round((open - close) / 40.0, 6) as open_n, round((high - close) / 40.0, 6) as high_n, round((low - close) / 40.0, 6) as low_n from bars")
def normalise_q(spark, d):
    return day(bars5(spark, d).select(*KEY, *(F.round((F.col(c) - F.col("close")) / F.lit(40.0), 6).alias(f"{c}_n") for c in ("open", "high", "low"))))


def _indicator(name: str, sql: str):
    return query(name, f"with {S.BARS5}{sql}")


_GUARD = "case when count(close) over (%s rows 19 preceding) = 20 then %%s end" % W


@_indicator("sma", f" select symbol, {DAY}, bar_no, round({_GUARD % f'avg(close) over ({W} rows 19 preceding)'}, 6) as sma from bars")
def sma_q(spark, d):
    return day(I.sma(bars5(spark, d)).select(*KEY, r6("20_sma", "sma")))


@_indicator("rolling_std", f" select symbol, {DAY}, bar_no, round({_GUARD % f'stddev_pop(close) over ({W} rows 19 preceding)'}, 6) as std from bars")
def std_q(spark, d):
    return day(I.std(bars5(spark, d)).select(*KEY, r6("20_std", "std")))


@_indicator("bbands", f", s as (select *, {_GUARD % f'avg(close) over ({W} rows 19 preceding)'} as m, {_GUARD % f'stddev_pop(close) over ({W} rows 19 preceding)'} as sd from bars) select symbol, {DAY}, bar_no, round((close - m) / nullif(2 * round(sd, 9), 0), 6) as bbands from s")
def bbands_q(spark, d):
    return day(I.bbands(bars5(spark, d)).select(*KEY, r6("20_bbands", "bbands")))


@_indicator("avedev", f", x as (select a.symbol, a.session_date, a.bar_no, a.row, b.close, avg(b.close) over (partition by a.symbol, a.row) as m, count(*) over (partition by a.symbol, a.row) as n from bars a join bars b on a.symbol = b.symbol and b.row between a.row - 19 and a.row) select symbol, {DAY}, bar_no, case when any_value(n) = 20 then round(avg(abs(close - m)), 6) end as avedev from x group by symbol, session_date, bar_no")
def avedev_q(spark, d):
    return day(I.avedev(bars5(spark, d)).select(*KEY, r6("avedev")))


_RECURSE = """, tr as (select *, {x} as x from bars), e as (
  select symbol, row, cast({first} as double) as s, cast(1 as double) as w from tr where row = 0
  union all select t.symbol, t.row, {step}, e.w * (1 - {a}) + 1 from e join tr t on t.symbol = e.symbol and t.row = e.row + 1)"""


def _rec(sql: str, tail: str) -> str:
    return "with recursive " + S.BARS5 + sql + tail


@query("atr", _rec(_RECURSE.format(x=f"greatest(high - low, abs(high - lag(close) over ({W})), abs(low - lag(close) over ({W})))", first="x", step="e.s * (1 - 1 / 14.0::double) + t.x * (1 / 14.0::double)", a="0"), f" select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, case when b.row >= 13 then round(e.s, 6) end as atr from e join bars b using (symbol, row)"))
def atr_q(spark, d):
    return day(I.atr(bars5(spark, d)).select(*KEY, r6("atr")))


@query("ema_volume", _rec(_RECURSE.format(x="volume", first="x", step="e.s * (1 - 2 / 29.0::double) + t.x", a="2 / 29.0::double"), f" select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, round(e.s / e.w, 6) as ema from e join bars b using (symbol, row)"))
def ema_volume_q(spark, d):
    return day(I.ewm(bars5(spark, d), "volume", "ema", 2 / 29, adjust=True).select(*KEY, r6("ema")))


@query("sma_rsi", f"with {S.RSI} select symbol, {DAY}, bar_no, round(sma_rsi, 6) + 0 as sma_rsi from rsi")
def sma_rsi_q(spark, d):
    return day(I.sma_rsi(bars5(spark, d)).select(*KEY, r6("sma_rsi")))


@_indicator("fvg", f""", p as (select *, lag(high, 2) over ({W}) as h1, lag(low, 2) over ({W}) as l1, lag(open) over ({W}) as o2, lag(close) over ({W}) as c2, lag(high) over ({W}) - lag(low) over ({W}) as r2 from bars)
 select symbol, {DAY}, bar_no, case when low > h1 and c2 > o2 and high - low >= 0.75 * (h1 - l1 + r2) then 1 when high < l1 and c2 < o2 and high - low >= 0.75 * (h1 - l1 + r2) then -1 else 0 end as fvg from p""")
def fvg_q(spark, d):
    return day(I.fvg(bars5(spark, d)).select(*KEY, "fvg"))


@_indicator("price_moves", " select symbol, " + DAY + ", bar_no, " + ", ".join(f"cast({c} > lag({c}) over ({W}) as int) as {n}" for n, c in (("HO", "open"), ("HH", "high"), ("HL", "low"), ("HC", "close"))) + " from bars")
def price_moves_q(spark, d):
    return day(I.price_moves(bars5(spark, d)).select(*KEY, *(F.col(c).cast("int").alias(c) for c in ("HO", "HH", "HL", "HC"))))


@_indicator("inertia", f", c as (select *, close - lag(close) over ({W}) as c from bars), s as (select *, (" + " + ".join(f"lag(c, {i}) over ({W}) * {0.61828**i!r}::double" for i in range(20)) + f") / {sum(0.61828**i for i in range(20))!r} as s from c) select symbol, {DAY}, bar_no, round({_SIGMOID_SQL.format('s')}, 6) + 0 as inertia from s")
def inertia_q(spark, d):
    return day(I.inertia(bars5(spark, d)).select(*KEY, r6("inertia")))


@_indicator("session_hl", f" select symbol, {DAY}, bar_no, max(high) over h as run_high, min(low) over h as run_low from bars window h as (partition by symbol, session_date, bar_no // 144 order by bar_no)")
def session_hl_q(spark, d):
    return day(I.session_high_low(bars5(spark, d).withColumn("half", F.floor(F.col("bar_no") / 144))).select(*KEY, "run_high", "run_low"))


@_indicator("ref_px", f", f as (select *, first(open) over (partition by symbol, session_date, bar_no // 144 order by bar_no) as f from bars) select symbol, {DAY}, bar_no, coalesce(lead(f) over ({W}), f) as ref_px from f")
def ref_px_q(spark, d):
    half = Window.partitionBy("symbol", "session_date", "half").orderBy("bar_no")
    b = bars5(spark, d).withColumn("half", F.floor(F.col("bar_no") / 144)).withColumn("_f", F.first("open").over(half))
    return day(b.select(*KEY, F.coalesce(F.lead("_f").over(B.history()), "_f").alias("ref_px")))


@_indicator("rolling_arrays", f", l as (select *, list(close) over ({W} rows 4 preceding) as xs from bars) select symbol, {DAY}, bar_no, array_to_string(xs, ',') as closes, list_max(xs) as top from l")
def rolling_arrays_q(spark, d):
    xs = F.collect_list("close").over(I.last(5))
    b = bars5(spark, d).withColumn("_xs", xs)
    return day(b.select(*KEY, F.array_join(F.transform("_xs", lambda x: x.cast("string")), ",").alias("closes"), F.array_max("_xs").alias("top")))


@_indicator("forward_extremes", f" select symbol, {DAY}, bar_no, max(close) over w as up, min(close) over w as down from bars window w as (partition by symbol, session_date, bar_no // 144 order by bar_no rows between current row and 59 following)")
def forward_extremes_q(spark, d):
    w = Window.partitionBy("symbol", "session_date", "half").orderBy("bar_no").rowsBetween(0, 59)
    b = bars5(spark, d).withColumn("half", F.floor(F.col("bar_no") / 144))
    return day(b.select(*KEY, F.max("close").over(w).alias("up"), F.min("close").over(w).alias("down")))


@query("indicators", f"with {S.RSI}, m as (select *, {_GUARD % f'avg(close) over ({W} rows 19 preceding)'} as m from rsi) select symbol, {DAY}, bar_no, round(m, 6) as sma, round(sma_rsi, 6) + 0 as sma_rsi from m")
def indicators_q(spark, d):
    return day(I.apply(bars5(spark, d), ["sma", "sma_rsi"]).select(*KEY, r6("20_sma", "sma"), r6("sma_rsi")))


_ASOF = f"""with {S.BARS5}, {S.bars(3600, 'big', False)},
shown as (select symbol, session_date, least((bar_no + 1) * 3600, 82800) - 300 as pos, bar_no as big_no, close as close_60 from big),
base as (select *, bar_no * 300 as pos from bars)
select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, s.close_60, s.big_no
from base b asof left join (select *, epoch(session_date)::bigint + pos as k from shown) s on b.symbol = s.symbol and epoch(b.session_date)::bigint + b.pos >= s.k"""


@query("asof_bars", _ASOF)
def asof_bars_q(spark, d):
    """Larger bars on the base row in which they close, by one union and one running last value."""
    table = B.write_sizes(ticks(spark, d), shared_folder(spark, "sizes"), {n: B.SIZES[n] for n in ("5", "60")})
    base, big = table.filter("freq = '5'"), table.filter("freq = '60'")
    left = base.select(*KEY, F.lit(None).cast("struct<close_60:bigint,big_no:bigint>").alias("v"), (F.col("bar_no") * 300).alias("at"), F.lit(1).alias("src"))
    right = big.select("symbol", "session_date", F.lit(None).cast("long").alias("bar_no"), F.struct(F.col("close").alias("close_60"), F.col("bar_no").alias("big_no")).alias("v"), (F.least((F.col("bar_no") + 1) * 3600, F.lit(82800)) - 300).alias("at"), F.lit(0).alias("src"))
    w = Window.partitionBy("symbol").orderBy("session_date", "at", "src").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("x", F.last("v", ignorenulls=True).over(w))
    return day(both.filter("src = 1").select(*KEY, "x.close_60", "x.big_no"))


_UD = S.BARS5 + f""", kv1 as (select *, {_GUARD % f'stddev_pop(close) over ({W} rows 19 preceding)'} * 3 as kv0 from bars), kv as (select *, round(kv0, 6) as kv from kv1),
z as (
  select symbol, row, coalesce(high - low > kv, false) as rising, case when coalesce(high - low > kv, false) then high else low end::double as level, null::double as top, null::double as bottom,
         case when coalesce(high - low > kv, false) then 1 else -1 end as flag from kv where row = 0
  union all
  select k.symbol, k.row,
    case when z.rising then not coalesce(z.level - k.low > k.kv, false) else coalesce(k.high - z.level > k.kv, false) end,
    case when z.rising then case when coalesce(z.level - k.low > k.kv, false) then k.low else greatest(z.level, k.high) end
         else case when coalesce(k.high - z.level > k.kv, false) then k.high else least(z.level, k.low) end end,
    case when z.rising and coalesce(z.level - k.low > k.kv, false) then z.level end, case when not z.rising and coalesce(k.high - z.level > k.kv, false) then z.level end,
    case when z.rising then case when coalesce(z.level - k.low > k.kv, false) then -1 else 1 end else case when coalesce(k.high - z.level > k.kv, false) then 1 else -1 end end
  from z join kv k on k.symbol = z.symbol and k.row = z.row + 1
)"""


def _zigzag(spark, d):
    return ud_levels(I.std(bars5(spark, d)).withColumn("move", F.round(3 * F.col("20_std"), 6)), "move")


@query("ud_levels", f"with recursive {_UD} select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, z.top as u, z.bottom as d, coalesce(f.flag, -1) as flag from bars b left join z on z.symbol = b.symbol and z.row = b.row left join z f on f.symbol = b.symbol and f.row = b.row - 1")
def ud_levels_q(spark, d):
    return day(_zigzag(spark, d).select(*KEY, "u", "d", "flag"))


@query("last_pivots", f"with recursive {_UD}, p as (select symbol, row, coalesce(top, bottom) as v, row_number() over (partition by symbol order by row) as i from z where coalesce(top, bottom) is not null), c as (select b.*, (select count(*) from p where p.symbol = b.symbol and p.row <= b.row) as n from bars b) select c.symbol, strftime(c.session_date, '%Y-%m-%d') as session_date, c.bar_no, p1.v as last1, p2.v as last2 from c left join p p1 on p1.symbol = c.symbol and p1.i = c.n left join p p2 on p2.symbol = c.symbol and p2.i = c.n - 1")
def last_pivots_q(spark, d):
    return day(_zigzag(spark, d).select(*KEY, "last1", "last2"))


@query("resample_legacy", f"with {S.TICKS} select symbol, strftime(date_trunc('week', session_date), '%Y-%m-%d') as week, arg_min(price, arrival_id) as open, max(price) as high, min(price) as low, arg_max(price, arrival_id) as close, round(sum(price * volume)::double / sum(volume), 6) as avg_px from ticks group by 1, 2")
def resample_legacy_q(spark, d):
    week = F.date_format(F.date_trunc("week", "session_date"), "yyyy-MM-dd").alias("week")
    vwap = F.round(F.sum(F.col("price") * F.col("volume")).cast("double") / F.sum("volume"), 6)
    return ticks(spark, d).groupBy("symbol", week).agg(F.min_by("price", "arrival_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "arrival_id").alias("close"), vwap.alias("avg_px"))


@query("chunk_info", f"with {S.BARS5} select symbol, {DAY}, count(*) as n, min(row) as first_row, max(row) as last_row from bars group by symbol, session_date")
def chunk_info_q(spark, d):
    b = bars5(spark, d).withColumn("row", (F.row_number().over(B.history()) - 1).cast("long"))
    return day(b.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row")))


@query("skip_night", f"with {S.BARS5}, n as (select symbol, session_date, min(row) as a, max(row) as b from bars where bar_no < 186 group by symbol, session_date) select symbol, {DAY}, b as from_row, lead(a) over (partition by symbol order by session_date) - 1 as to_row from n")
def skip_night_q(spark, d):
    b = bars5(spark, d).withColumn("row", (F.row_number().over(B.history()) - 1).cast("long")).filter("bar_no < 186")
    n = b.groupBy("symbol", "session_date").agg(F.min("row").alias("a"), F.max("row").alias("b"))
    return day(n.select("symbol", "session_date", F.col("b").alias("from_row"), (F.lead("a").over(Window.partitionBy("symbol").orderBy("session_date")) - 1).alias("to_row")))


#: News calendar of the tests: days by kind, and times other than the usual (New York).
NEWS = {"fomc": ["2024-01-10", "2024-01-17"], "nfp": ["2024-01-05", "2024-01-11"], "cpi": ["2024-01-11", "2024-01-24"], "ppi": ["2024-01-12"], "gdp": ["2024-01-25"]}
NEWS_AT = {("fomc", "2024-01-17"): "16:57", ("cpi", "2024-01-24"): "10:00"}
_NEWS_SQL = "news as (select kind, cast(t + interval 6 hour as date) as session_date, epoch_us(t + interval 6 hour) - 300000000 as lo, epoch_us(t + interval 6 hour) + 300000000 as hi from (values " + ", ".join(f"('{k}', timestamp '{day_} {NEWS_AT.get((k, day_), '14:00' if k == 'fomc' else '08:30')}:00')" for k, days in NEWS.items() for day_ in days) + ") v(kind, t))"


def news_windows(spark: SparkSession) -> DataFrame:
    return C.news_windows(spark, NEWS, NEWS_AT)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Ticks with labels and news flags."""
    return T.news_flags(T.labelled(ticks(spark, d)), news_windows(spark))


_IN_NEWS = lambda k: f"exists (select 1 from news n where n.kind = '{k}' and n.session_date = t.session_date and epoch_us(t.ts_clock) >= n.lo and epoch_us(t.ts_clock) < n.hi)"
_SIZED = "(values " + ", ".join(f"('{n}', {x})" for n, x in B.SIZES.items()) + ") z(freq, secs)"


@query("bars_all", f"""with {S.TICKS}, {_NEWS_SQL}, l as (select t.*, (sod >= 55800 and sod < 79200)::int as rth, sod // 28800 + 1 as session, sod // 3600 as hour, {', '.join(f"({_IN_NEWS(k)})::int as news_{k}" for k in T.NEWS)} from ticks t)
select freq, symbol, {DAY}, sod // secs as bar_no, arg_min(price, tick_no) as open, max(price) as high, min(price) as low, arg_max(price, tick_no) as close, cast(sum(volume) as bigint) as volume,
  max(rth) as rth, cast(arg_min(session, tick_no) as int) as session, cast(arg_min(hour, tick_no) as int) as hour, {', '.join(f"max(news_{k}) as news_{k}" for k in T.NEWS)} from l, {_SIZED} group by freq, symbol, session_date, sod // secs""")
def bars_all_q(spark, d):
    """All ten sizes with labels and news, written by a cascade and read back as one table."""
    news = tuple(f"news_{k}" for k in T.NEWS)
    table = B.write_sizes(labelled(spark, d), shared_folder(spark, "sizes"), flags=("rth", *news), firsts=("session", "hour"))
    return day(table.select("freq", *KEY, "open", "high", "low", "close", "volume", "rth", "session", "hour", *news))


def _asof_all_sql() -> str:
    joins, cols = "", ""
    for m in (15, 30, 60, 1440):
        joins += f" asof left join (select symbol, close as c, volume as v, epoch(session_date)::bigint + least((bar_no + 1) * {m * 60}, 82800) - 300 as k from b{m}) s{m} on b.symbol = s{m}.symbol and epoch(b.session_date)::bigint + b.bar_no * 300 >= s{m}.k"
        cols += f", s{m}.c as close_{m}, s{m}.v as volume_{m}"
    return f"with {S.BARS5}, {', '.join(S.bars(m * 60, f'b{m}', False) for m in (15, 30, 60, 1440))} select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, b.close, b.volume{cols} from bars b{joins}"


@query("asof_all", _asof_all_sql())
def asof_all_q(spark, d):
    """Four larger sizes on five-minute bars, none of them before it has closed."""
    table = B.write_sizes(ticks(spark, d), shared_folder(spark, "sizes"), {n: B.SIZES[n] for n in ("5", "15", "30", "60", "day")})
    return day(B.asof_sizes({m: table.filter(F.col("freq") == n) for n, m in (("5", 5), ("15", 15), ("30", 30), ("60", 60), ("day", 1440))}, 5, ["close", "volume"]))


@query("news_flags", f"with {S.TICKS}, {_NEWS_SQL} select symbol, strftime(t.session_date, '%Y-%m-%d') as session_date, tick_no, " + ", ".join(f"cast(exists (select 1 from news n where n.kind = '{k}' and n.session_date = t.session_date and epoch_us(t.ts_clock) >= n.lo and epoch_us(t.ts_clock) < n.hi) as int) as news_{k}" for k in T.NEWS) + " from ticks t")
def news_flags_q(spark, d):
    return day(T.news_flags(ticks(spark, d), news_windows(spark)).select("symbol", "session_date", "tick_no", *(f"news_{k}" for k in T.NEWS)))


@query("news_any", f"with {S.TICKS}, {_NEWS_SQL} select symbol, strftime(t.session_date, '%Y-%m-%d') as session_date, sod // 300 as bar_no, max(cast(exists (select 1 from news n where n.session_date = t.session_date and epoch_us(t.ts_clock) >= n.lo and epoch_us(t.ts_clock) < n.hi) as int)) as news from ticks t group by 1, 2, 3")
def news_any_q(spark, d):
    t = T.news_flags(ticks(spark, d), news_windows(spark))
    return day(t.groupBy("symbol", "session_date", F.floor(F.col("sod") / 300).cast("long").alias("bar_no")).agg(F.max(F.greatest(*(f"news_{k}" for k in T.NEWS))).alias("news")))


@query("missing_sessions", f"with {S.TICKS} select strftime(day, '%Y-%m-%d') as session_date from (select unnest(generate_series(date '2023-12-20', date '2024-02-09', interval 1 day))::date as day) where dayofweek(day) between 1 and 5 and day not in (date '2024-01-01', date '2024-01-15') and day not in (select session_date from ticks)")
def missing_sessions_q(spark, d):
    days = spark.sql("select explode(sequence(date '2023-12-20', date '2024-02-09')) as session_date").filter(F.weekday("session_date") < 5)
    days = days.filter(~F.col("session_date").cast("string").isin("2024-01-01", "2024-01-15"))
    return day(days.join(ticks(spark, d).select("session_date").distinct(), "session_date", "left_anti"))


@query("contract_lookup", f"with {S.TICKS}, c(id, code, a, b) as (values (17001, 'H', date '2024-01-01', date '2024-01-15'), (17001, 'M', date '2024-01-16', date '2024-12-31'), (17002, 'U', date '2024-01-01', date '2024-12-31'), (17003, 'Z', date '2024-01-01', date '2024-12-31')) select symbol, strftime(s.session_date, '%Y-%m-%d') as session_date, code from (select distinct symbol, session_date, instrument_id from ticks) s left join c on c.id = s.instrument_id and s.session_date between c.a and c.b")
def contract_lookup_q(spark, d):
    rows = [("H", 17001, "2024-01-01", "2024-01-15"), ("M", 17001, "2024-01-16", "2024-12-31"), ("U", 17002, "2024-01-01", "2024-12-31"), ("Z", 17003, "2024-01-01", "2024-12-31")]
    path = shared_folder(spark, "contracts")
    spark.createDataFrame(rows, "code string, instrument_id int, first string, last string").write.option("header", True).csv(path)
    c = C.contracts(spark, path)
    s = ticks(spark, d).select("symbol", "session_date", "instrument_id").distinct()
    s = s.join(F.broadcast(c), (s["instrument_id"] == c["instrument_id"]) & s["session_date"].between(c["first"], c["last"]), "left")
    return day(s.select("symbol", "session_date", "code"))


@query("order_violations", f"with {S.BARS5}, d as (select symbol, session_date, sum(n_ticks) as n from bars group by 1, 2), b as (select symbol, session_date, coalesce(sum(n) over (partition by symbol order by session_date rows between unbounded preceding and 1 preceding), 0) as before from d), p as (select bars.*, before + start_tick as start_ind from bars join b using (symbol, session_date)), q as (select *, lag(start_ind) over ({W}) as last from p) select symbol, count(*) as bars, count(*) filter (start_ind <= last) as violations, cast(max(start_ind) as bigint) as last_start from q group by symbol")
def order_violations_q(spark, d):
    """Bars whose first tick's row does not come after that of the bar before."""
    return B.order_violations(B.pointers(bars5(spark, d)))


@query("arrival_order", "select event_id, row_number() over (partition by date_trunc('hour', ts) order by ts, event_id) as n from events")
def arrival_order_q(spark, d):
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return events(spark, d).select("event_id", F.row_number().over(w).cast("long").alias("n"))


@query("last_closed", "select event_id, strftime(c - cast(case when dayofweek(c) = 6 then 1 when dayofweek(c) = 0 then 2 else 0 end as integer), '%Y-%m-%d') as session_date from (select event_id, cast(ts - interval 22 hour as date) as c from events)")
def last_closed_q(spark, d):
    """The last session whose 17:00 New York end (22:00 UTC in winter) has passed; weekends fall back to Friday."""
    return events(spark, d).select("event_id", F.date_format(last_closed_session(F.col("ts")), "yyyy-MM-dd").alias("session_date"))


@query("open_sessions", f"with {S.TRADES}, n as (select max(ts_utc) as now from trades) select distinct symbol, {DAY} from trades, n where session_date > cast(now + interval 1 hour - interval 23 hour as date)")
def open_sessions_q(spark, d):
    """Sessions that a run at the newest trade's time must refuse: those that have not closed by then."""
    t = trades(spark, d)
    now = t.agg(F.max("ts_utc").alias("now"))
    return day(t.join(F.broadcast(now), is_open(F.col("session_date"), F.col("now"))).select("symbol", "session_date").distinct())


del _name, _seconds
