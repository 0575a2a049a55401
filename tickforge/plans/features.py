"""Queries over calendars, feature rows and scores."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickforge.functions.clock import epoch_us
from tickforge.functions.folders import shared_folder, stored
from tickforge.operators import bars as B
from tickforge.operators import features as FT
from tickforge.operators import indicators as I
from tickforge.operators import scores as SC
from tickforge.operators import stats as ST
from tickforge.operators import ticks as T
from tickforge.operators.pivots import ud_levels
from tickforge.sources import sessions as FS
from tickforge.sources.calendars import contracts, holidays
from tickforge.sources.events import trades

from . import sql as S
from .backtests import NEWEST_SQL, RUN, _days, _run, newest
from .market import _NEWS_SQL, _UD, DAY, KEY, _GUARD, _zigzag, bars5, day, news_windows, r6, ticks
from .registry import query

W = S.W


def _session_folder(spark, d):
    """The trades as one table for each session; some of them partial, one session twice."""
    folder = shared_folder(spark, "raw-sessions")
    t = trades(spark, d).select("arrival_id", "symbol", "size", "session_date")
    name = lambda prefix, tail: F.concat(F.lit(f"{prefix}_trades_"), F.date_format("session_date", "yyyy-MM-dd"), tail, F.lit(".parquet"))
    partial = F.when(F.dayofmonth("session_date") % 7 == 3, F.lit("_partial")).otherwise(F.lit(""))
    twice = t.filter(F.col("session_date") == F.lit("2024-01-12").cast("date")).withColumn("table", name("B", F.lit("")))
    t.withColumn("table", name("A", partial)).unionByName(twice).drop("session_date").write.partitionBy("table").parquet(folder)
    return folder


@query("scan_sessions", f"with {S.TRADES} select {DAY}, count(*) as n, cast(sum(size) as bigint) as size from trades where session_date between date '2024-01-13' and date '2024-01-22' and day(session_date) % 7 <> 3 group by session_date")
def scan_sessions_q(spark, d):
    """Rows of the raw session tables in a range of dates; partial ones are not read."""
    files = FS.session_files(spark, _session_folder(spark, d), "2024-01-13", "2024-01-22")
    return day(FS.read_sessions(spark, files).groupBy("session_date").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))


@query("check_sessions", f"with {S.TRADES} select {DAY}, case when session_date = date '2024-01-12' then 2 else 1 end as files, case when session_date = date '2024-01-12' then 1 else 0 end as doubled from (select distinct session_date from trades) where day(session_date) % 7 <> 3")
def check_sessions_q(spark, d):
    """How many tables claim each session."""
    return day(FS.check_files(FS.session_files(spark, _session_folder(spark, d))))


@query("news_windows", f"with {_NEWS_SQL} select n.kind, count(e.event_id) as n from news n left join events e on epoch_us(e.ts + interval 1 hour) >= n.lo and epoch_us(e.ts + interval 1 hour) < n.hi group by n.kind")
def news_windows_q(spark, d):
    """Events inside each kind of window; the join goes by session date, then by time."""
    t = trades(spark, d).select("session_date", "arrival_id", epoch_us(F.col("ts_clock")).alias("us"))
    w = F.broadcast(news_windows(spark))
    hit = t.join(w, "session_date").filter("us >= lo and us < hi").groupBy("kind").agg(F.count(F.lit(1)).alias("k"))
    return news_windows(spark).select("kind").distinct().join(hit, "kind", "left").select("kind", F.coalesce("k", F.lit(0)).alias("n"))


_ROLL = "2024-01-16"
#: Contracts of the roll: the block trades the later one, by the table's ids.
_CODES = [("OLD", 17001, "2024-01-01", "2024-12-31"), ("NEW", 17901, "2024-01-16", "2024-12-31")]


@query("roll_splice", f"with {S.TICKS} select symbol, {DAY}, 'NEW' as code, tick_no, price from ticks where session_date = date '{_ROLL}'")
def roll_splice_q(spark, d):
    """A roll day: a block of the new contract up to 08:20, and a main table that holds both contracts from there on."""
    t = ticks(spark, d).filter(F.col("session_date") == F.lit(_ROLL).cast("date")).select("symbol", "session_date", "sod", "tick_no", "price")
    new, old = t.withColumn("instrument_id", F.lit(17901)), t.withColumn("instrument_id", F.lit(17001))
    block, main = new.filter("sod < 30000"), new.filter("sod >= 30000").unionByName(old)
    one = T.splice_roll(block, main, by=["symbol", "session_date"], order="sod")
    path = shared_folder(spark, "contracts")
    spark.createDataFrame(_CODES, "code string, instrument_id int, first string, last string").write.option("header", True).csv(path)
    coded = T.contract_codes(one, contracts(spark, path))
    return day(coded.select("symbol", "session_date", "code", "tick_no", "price"))


@query("training_rows", f"with {S.RSI} select symbol, {DAY}, bar_no, close, round(sma_rsi, 6) + 0 as sma_rsi from rsi where session_date between date '2024-01-10' and date '2024-01-20' and sma_rsi is not null")
def training_rows_q(spark, d):
    f = I.sma_rsi(bars5(spark, d))
    f = f.filter(F.col("session_date").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")) & F.col("sma_rsi").isNotNull())
    return day(f.select(*KEY, "close", r6("sma_rsi")))


_PIV = f"{_UD}, p as (select symbol, row, coalesce(top, bottom) as v, row_number() over (partition by symbol order by row) as i from z where coalesce(top, bottom) is not null), c as (select b.*, (select count(*) from p where p.symbol = b.symbol and p.row <= b.row) as n from bars b)"


@query("warmup_start", f"with recursive {_PIV}, f as (select symbol, session_date, arg_min(n, row) as n from c group by symbol, session_date) select symbol, strftime(min(session_date), '%Y-%m-%d') as session_date from f where n >= 5 group by symbol")
def warmup_start_q(spark, d):
    """The first session whose first row already has five pivots."""
    first = _zigzag(spark, d).groupBy("symbol", "session_date").agg(F.min_by("last5", "bar_no").alias("p"))
    return day(first.filter("p is not null").groupBy("symbol").agg(F.min("session_date").alias("session_date")))


def _sized_pivots() -> str:
    """Zigzags and counts of pivots of five- and sixty-minute bars, the larger ones shown on the bar in which they close."""
    tail = re.sub(r"\b(kv1|kv|z|bars)\b", r"\1_60", _UD[len(S.BARS5) :])
    count = lambda z, b, k: f"""p{k} as (select symbol, row, row_number() over (partition by symbol order by row) as i from {z} where coalesce(top, bottom) is not null),
 c{k} as (select b.symbol, b.session_date, b.bar_no, b.row, count(p.row) as n from {b} b left join p{k} p on p.symbol = b.symbol and p.row <= b.row group by all)"""  # noqa: E731
    return f"""with recursive {_UD}, {S.bars(3600, 'bars_60')}{tail}, {count('z', 'bars', 5)}, {count('z_60', 'bars_60', 60)},
s60 as (select symbol, n, epoch(session_date)::bigint + least((bar_no + 1) * 3600, 82800) - 300 as k from c60), j as (select c.*, coalesce(s.n, 0) as n60 from c5 c asof left join s60 s on c.symbol = s.symbol and epoch(c.session_date)::bigint + c.bar_no * 300 >= s.k),
f as (select symbol, session_date, arg_min(n, row) as n, arg_min(n60, row) as n60 from j group by symbol, session_date), w as (select symbol, min(session_date) as first from f where n >= 5 and n60 >= 5 group by symbol)"""


@query("warm_up", f"{_sized_pivots()} select symbol, {DAY}, bar_no from j join w using (symbol) where session_date >= first")
def warm_up_q(spark, d):
    """Rows from the first session on whose first row has the last pivots of both sizes."""
    t = stored(ticks(spark, d), "ticks")
    sized = {}
    for minutes in (5, 60):
        b = I.std(B.bars(t, minutes * 60)).withColumn("move", F.round(3 * F.col("20_std"), 6))
        sized[minutes] = ud_levels(b, "move").select(*KEY, "last5")
    return day(FT.warm_up(B.asof_sizes(sized, 5, ["last5"]), ["last5", "last5_60"]).select(*KEY))


@query("burn_in", f"with recursive {_PIV}, f as (select symbol, session_date, arg_min(n, row) as n5 from c group by symbol, session_date) select c.symbol, strftime(c.session_date, '%Y-%m-%d') as session_date, c.bar_no from c join f using (symbol, session_date) where f.n5 >= 5")
def burn_in_q(spark, d):
    z = _zigzag(spark, d)
    ready = F.first("last5").over(Window.partitionBy("symbol", "session_date").orderBy("bar_no"))
    return day(z.withColumn("_r", ready).filter("_r is not null").select(*KEY))


@query("freq_bars", f"with {S.BARS5}, {S.bars(3600, 'big', False)}, f as (select symbol, session_date, bar_no // 12 as big_no, min(start_tick) as start_tick, min(bar_no) as bar_no from bars group by 1, 2, 3) select f.symbol, strftime(f.session_date, '%Y-%m-%d') as session_date, f.bar_no, b.open, b.close from f join big b on f.symbol = b.symbol and f.session_date = b.session_date and f.big_no = b.bar_no and f.start_tick = b.start_tick")
def freq_bars_q(spark, d):
    """Each larger bar once, at its first smaller bar, with the larger bar's own columns."""
    t = ticks(spark, d)
    small = B.bars(t, 300).withColumn("big_no", F.floor(F.col("bar_no") / 12))
    first = small.withColumn("_r", F.row_number().over(Window.partitionBy("symbol", "session_date", "big_no").orderBy("bar_no"))).filter("_r = 1")
    big = B.bars(t, 3600).select("symbol", "session_date", "start_tick", "open", "close")
    return day(first.select(*KEY, "start_tick").join(big, ["symbol", "session_date", "start_tick"]).drop("start_tick"))


@query("rsi_stretch", f"with {S.RSI} select symbol, {DAY}, bar_no, round(1.6128 * tanh(case when abs(sma_rsi) < 0.01 then tanh(sma_rsi / 0.01) else sign(sma_rsi) end * pow(abs(sma_rsi) + 1e-8, 1.6128)), 6) + 0 as stretched from rsi")
def rsi_stretch_q(spark, d):
    return day(I.sma_rsi(bars5(spark, d)).select(*KEY, (F.round(SC.rsi_stretch(F.col("sma_rsi")), 6) + 0.0).alias("stretched")))


@query("nearest_target", f"with {S.BARS5}, l as (select *, list(close) over ({W} rows between 10 preceding and 1 preceding) as xs from bars) select symbol, {DAY}, bar_no, list_min(list_filter(xs, lambda x: x > close and x - close <= 5)) as above, list_max(list_filter(xs, lambda x: x < close and close - x <= 5)) as below from l")
def nearest_target_q(spark, d):
    b = bars5(spark, d).withColumn("_xs", F.collect_list("close").over(B.history().rowsBetween(-10, -1)))
    above = F.array_min(F.filter("_xs", lambda x: (x > F.col("close")) & (x - F.col("close") <= 5)))
    below = F.array_max(F.filter("_xs", lambda x: (x < F.col("close")) & (F.col("close") - x <= 5)))
    return day(b.select(*KEY, above.alias("above"), below.alias("below")))


@query("feature_vectors", f"with {S.BARS5}, v as (select *, [open - close, high - close, low - close] as v, lag([open - close, high - close, low - close]) over ({W}) as p from bars) select symbol, {DAY}, bar_no, array_to_string(coalesce(p, []) || v, ',') as v from v")
def feature_vectors_q(spark, d):
    v = F.array(*(F.col(c) - F.col("close") for c in ("open", "high", "low")))
    b = bars5(spark, d).withColumn("_v", v).withColumn("_p", F.lag("_v").over(B.history()))
    both = F.concat(F.coalesce("_p", F.array().cast("array<bigint>")), "_v")
    return day(b.select(*KEY, F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("v")))


@query("live_std", f"with {S.BARS5}, m as (select *, avg(close) over w as mean, var_pop(close) over w * 19 as m2, count(*) over w as n from bars window w as ({W} rows between 19 preceding and 1 preceding)) select symbol, {DAY}, bar_no, case when n = 19 then round(sqrt(greatest((m2 + pow(close - mean, 2) * 19 / 20) / 20, 0)), 6) + 0 end as live from m")
def live_std_q(spark, d):
    """Standard deviation of 19 closed bars and the current close, from mean and squared distance of the closed ones."""
    w = B.history().rowsBetween(-19, -1)
    b = bars5(spark, d).withColumns({"_m": F.avg("close").over(w), "_q": F.var_pop("close").over(w) * 19, "_n": F.count(F.lit(1)).over(w)})
    live = F.sqrt(F.greatest((F.col("_q") + F.pow(F.col("close") - F.col("_m"), 2) * 19 / 20) / 20, F.lit(0.0)))
    return day(b.select(*KEY, F.when(F.col("_n") == 19, F.round(live, 6) + 0.0).alias("live")))


@query("drawdown", f"with recursive {S.DAILY} select symbol, stops, round(cast(min(drawdown_usd) as double), 6) + 0 as worst, round(cast(max(cum_net_usd) as double), 6) + 0 as best from daily group by symbol, stops")
def drawdown_q(spark, d):
    days = ST.daily(_run(spark, d), _days(spark, d), RUN)
    return days.groupBy(*RUN).agg((F.round(F.min("drawdown_usd"), 6) + 0.0).alias("worst"), (F.round(F.max("cum_net_usd"), 6) + 0.0).alias("best"))


@query("longest_run", f"with {S.BARS5}, u as (select *, coalesce(close > lag(close) over ({W}), false) as up from bars), g as (select *, sum(case when up then 0 else 1 end) over ({W}) as g from u) select symbol, cast(max(n) as bigint) as longest from (select symbol, g, sum(up::int) as n from g group by symbol, g) group by symbol")
def longest_run_q(spark, d):
    b = bars5(spark, d).withColumn("up", F.coalesce(F.col("close") > F.lag("close").over(B.history()), F.lit(False)))
    return ST.longest_run(b, ["symbol"], ["session_date", "bar_no"], F.col("up"), "longest")


@query("load_trades", f"with recursive {S.KEPT} select symbol, stops, cast(row as int) as row, cast(side as varchar) as side, cast(pnl as double) as pnl from run")
def load_trades_q(spark, d):
    return _run(spark, d).select("symbol", "stops", F.col("row").cast("int").alias("row"), F.col("side").cast("string").alias("side"), F.col("pnl").cast("double").alias("pnl"))


@query("custom_stop", f"with {S.SIDES} select symbol, row, greatest(1, abs(close - open))::double as tp, 8::double as sl, 'body' as stops from sig")
def custom_stop_q(spark, d):
    """A stop function of the caller's own: the bar's body as target; an unnamed one is labelled by its name."""
    from .backtests import _signals

    def body(sig):
        return sig.withColumns({"tp": F.greatest(F.lit(1), F.abs(F.col("close") - F.col("open"))).cast("double"), "sl": F.lit(8.0)})

    from tickforge.operators.trading import checked_stops

    return checked_stops(_signals(spark, d), body).select("symbol", "row", "tp", "sl", "stops")


@query("stability", f"with recursive {S.KEPT}, n as (select symbol, stops, sum(net_usd) as n from run group by symbol, stops), best as (select symbol, stops from (select *, row_number() over (partition by symbol order by n desc, stops) as r from n) where r = 1) select symbol, stops, strftime(date_trunc('week', session_date), '%Y-%m-%d') as week, sum(net_usd)::double as net_usd from run join best using (symbol, stops) group by 1, 2, 3")
def stability_q(spark, d):
    """Net by week of each symbol's best stops."""
    run = _run(spark, d)
    n = run.groupBy(*RUN).agg(F.sum("net_usd").alias("n"))
    best = n.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "stops"))).filter("_r = 1").select(*RUN)
    week = F.date_format(F.date_trunc("week", "session_date"), "yyyy-MM-dd").alias("week")
    return run.join(best, RUN).groupBy(*RUN, week).agg(F.sum("net_usd").alias("net_usd"))


_RUIN = f"""with recursive {S.KEPT}, o as (select symbol, stops, net_usd::double as x, row_number() over ({NEWEST_SQL}) - 1 as i, count(*) over (partition by symbol, stops) as n from run),
w as (select *, pow(1 - 2 / (greatest(10, n // 3) + 1)::double, i) as w from o), m as (select symbol, stops, sum(w * x) / sum(w) as mu from w group by symbol, stops),
v as (select symbol, stops, any_value(mu) as mu, sqrt(round(sum(w * (x - mu) * (x - mu)) / sum(w), 6)) as sigma from w join m using (symbol, stops) group by symbol, stops),
p as (select *, {{pass}} as p, {{activation}} as q from v)
select symbol, stops, round(mu, 6) + 0 as mu, round(sigma, 6) + 0 as sigma, '50k' as best_account, round(p, 4) as p_pass, round(q, 4) as p_activation, 1800::double as payout,
 case when p > 0 and q > 0 then round(49 / (p * q) + 149 / q, 2) end as cost_per_success, round(p * q * 1800 - p * 149 - 49, 2) as ev_per_attempt from p"""


def _reach_sql(target: int, contracts: int) -> str:
    e = lambda x: f"least(2 * mu * {x} / (nullif(sigma, 0) * sigma * {contracts}), 500)"
    return f"case when mu <= 0 then 0 when sigma = 0 then 1 else (1 - exp(-{e(2000)})) / (1 - exp(-{e(target + 2000)})) end"


@query("ruin_probability", _RUIN.replace("{pass}", _reach_sql(3000, 5)).replace("{activation}", _reach_sql(4000, 2)))
def ruin_probability_q(spark, d):
    """What an evaluation account is worth to each run, from its trades' weighted mean and deviation."""
    v = SC.account_value(SC.weighted_mean_std(_run(spark, d), RUN, newest()))
    return v.withColumns({c: F.round(c, 6) + 0.0 for c in ("mu", "sigma")})


_Z = """, {0}m as (select row, symbol, s / w as m, w from {0}e), {0}x as (select b.symbol, b.row, {1} as x from bars b), {0}q as (
  select symbol, row, cast(x * x as double) as s, cast(1 as double) as w2 from {0}x where row = 0
  union all select x.symbol, x.row, q.s * {2} + x.x * x.x, q.w2 * {2} * {2} + 1 from {0}q q join {0}x x on x.symbol = q.symbol and x.row = q.row + 1),
{0}z as (select x.symbol, x.row, case when x.row > 0 then round((x - m) / greatest(sqrt(greatest((q.s / w - m * m) * w * w / (w * w - w2), 0)), 1e-8), 4) + 0 end as z from {0}x x join {0}m using (symbol, row) join {0}q q using (symbol, row))"""


def _z_sql(name: str, x: str, span: int) -> str:
    """A recursion over the bars for the weighted sum and the weights, and one for squares."""
    d = f"(1 - 2 / {span + 1}.0::double)"
    e = f""", {name}e as (select symbol, row, cast({x} as double) as s, cast(1 as double) as w from bars b where row = 0
  union all select b.symbol, b.row, e.s * {d} + {x}, e.w * {d} + 1 from {name}e e join bars b on b.symbol = e.symbol and b.row = e.row + 1)"""
    return e + _Z.format(name, x, d)


@query("ewm_zscore", f"with recursive {S.TICKS}, {S.bars(3600)}{_z_sql('v', 'volume', 4000)}{_z_sql('l', 'ln(close / 20000.0::double)', 34000)} select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, vz.z as z_volume, lz.z as z_log from bars b join vz using (symbol, row) join lz using (symbol, row)")
def ewm_zscore_q(spark, d):
    """Volume with its size's span, and the logarithm of the price with the long span, over 60-minute bars."""
    b = B.bars(ticks(spark, d), 3600).withColumn("_log", F.log(F.col("close") / F.lit(20000.0)))
    b = I.ewm_zscore(I.ewm_zscore(b, "volume", "z_volume", I.ZSCORE_SPANS[60]), "_log", "z_log", 34000)
    return day(b.select(*KEY, *((F.round(c, 4) + 0.0).alias(c) for c in ("z_volume", "z_log"))))


@query("holiday_trades", f"with {S.TRADES} select symbol, {DAY}, count(*) as n from trades where session_date in (date '2024-01-01', date '2024-01-15') group by symbol, session_date")
def holiday_trades_q(spark, d):
    """Trades on days that the calendar calls holidays."""
    h = holidays(spark, {"2024-01-01": "New Year", "2024-01-15": "King Day"})
    return day(trades(spark, d).join(F.broadcast(h), "session_date", "left_semi").groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n")))


@query("stops_check", f"with {S.EXITS}, g as (select stops, tp, sl from trades_all union all select 'vol' as stops, greatest(1, abs(close - open))::double, 8 from sig) select stops, count(distinct tp) as tps, count(distinct sl) as sls, cast(count(distinct tp) = 1 and count(distinct sl) = 1 as int) as fixed from g group by stops")
def stops_check_q(spark, d):
    """Whether each stops label stands for one pair of levels."""
    from .backtests import _exits, _signals

    sig = _signals(spark, d).select(F.lit("vol").alias("stops"), F.greatest(F.lit(1), F.abs(F.col("close") - F.col("open"))).cast("double").alias("tp"), F.lit(8.0).alias("sl"))
    return ST.fixed_pairs(_exits(spark, d).select("stops", "tp", "sl").unionByName(sig))


_FORMING = f"""with {S.TICKS}, {S.bars(60, 'base', False)}, {S.bars(3600, 'big', False)}, h as (select *, list(close) over (partition by symbol order by session_date, bar_no rows 3 preceding) as xs from big), s as (select symbol, epoch(session_date)::bigint + least((bar_no + 1) * 3600, 82800) as k, xs from h),
j as (select b.symbol, b.session_date, b.bar_no, b.close, s.xs || [b.close] as xs from base b asof left join s on b.symbol = s.symbol and epoch(b.session_date)::bigint + b.bar_no * 60 >= s.k),
m as (select *, list_avg(xs) as m, list_transform(range(2, 6), lambda i: xs[i] - xs[i - 1]) as c from j), v as (select *, sqrt(list_sum(list_transform(xs, lambda x: (x - m) * (x - m))) / 5) as sd, list_sum(list_transform(c, lambda x: greatest(x, 0))) as u, list_sum(list_transform(c, lambda x: greatest(-x, 0))) as dn from m)
select symbol, {DAY}, bar_no, case when len(xs) = 5 then round(m, 6) end as mean, case when len(xs) = 5 then round(sd, 6) + 0 end as std, case when len(xs) = 5 then round(list_sum(list_transform(xs, lambda x: abs(x - m))) / 5, 6) + 0 end as avedev,
 case when len(xs) = 5 then round((close - (m - 2 * round(sd, 9))) / nullif(4 * round(sd, 9), 0), 6) + 0 end as bbands, case when len(xs) = 5 then round(-((case when dn = 0 then 100 else 100 - 100 / (1 + u / dn::double) end) / 100 * 2 - 1), 6) + 0 end as sma_rsi from v"""


@query("forming_bar", _FORMING)
def forming_bar_q(spark, d):
    """Indicators over the last four closed 60-minute closes and the current minute's close."""
    table = B.write_sizes(ticks(spark, d), shared_folder(spark, "sizes"), {n: B.SIZES[n] for n in ("1", "60")})
    big = table.filter("freq = '60'").withColumn("xs", F.collect_list("close").over(B.history().rowsBetween(-3, 0)))
    shown = big.select("symbol", "session_date", F.lit(None).cast("long").alias("bar_no"), F.lit(None).cast("long").alias("close"), "xs", F.least((F.col("bar_no") + 1) * 3600, F.lit(82800)).alias("at"), F.lit(0).alias("src"))
    base = table.filter("freq = '1'").select("symbol", "session_date", "bar_no", "close", F.lit(None).cast("array<bigint>").alias("xs"), (F.col("bar_no") * 60).alias("at"), F.lit(1).alias("src"))
    w = Window.partitionBy("symbol").orderBy("session_date", "at", "src").rowsBetween(Window.unboundedPreceding, 0)
    both = base.unionByName(shown).withColumn("xs", F.last("xs", ignorenulls=True).over(w)).filter("src = 1")
    xs = F.array_append("xs", F.col("close"))
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / 5
    named = {"mean": F.when(F.size(xs) == 5, mean)} | I.forming(xs, 5)
    return day(both.select(*KEY, *((F.round(c, 6) + 0.0).alias(n) for n, c in named.items())))


@query("forming_atr", f"""with {S.TICKS}, {S.bars(60, 'base', False)}, {S.bars(3600, 'big')}, tr as (select *, greatest(high - low, abs(high - lag(close) over ({W})), abs(low - lag(close) over ({W}))) as tr from big),
c as (select symbol, session_date, bar_no as big_no, sum(tr) over ({W} rows between 13 preceding and 1 preceding) as s, lag(close) over ({W}) as before, lag(close, 14) over ({W}) is not null as whole from tr),
r as (select b.*, s, before, whole, max(high) over k as h, min(low) over k as l from base b join c on c.symbol = b.symbol and c.session_date = b.session_date and c.big_no = b.bar_no // 60 window k as (partition by b.symbol, b.session_date, b.bar_no // 60 order by b.bar_no)),
f as (select *, greatest(h - l, abs(h - before), abs(l - before)) as t from r)
select symbol, {DAY}, bar_no, case when whole then round(((s + t) / 14.0::double * 13 + t) / 14, 6) end as atr from f""")
def forming_atr_q(spark, d):
    """The average true range of 60-minute bars at each minute, with the bar that is still open."""
    one = stored(B.bars(ticks(spark, d), 60), "minutes")
    return day(I.forming_atr(one, B.roll_up(one, 60), 60).select(*KEY, r6("forming_atr", "atr")))
