"""Queries over signals, exits, trades and their statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickforge.operators import bars as B
from tickforge.operators import indicators as I
from tickforge.operators import scores as SC
from tickforge.operators import stats as ST
from tickforge.operators import ticks as T
from tickforge.operators import trading as X
from tickforge.operators.search import level_search

from tickforge.functions.folders import parts, shared_folder, stored, stored_once

from . import sql as S
from .market import _NEWS_SQL, DAY, _GUARD, bars5, day, labelled, ticks
from .registry import query

RUN = ["symbol", "stops"]
SPLIT = "2024-01-16"
NEWEST_SQL = "partition by symbol, stops order by session_date desc, exit_ts_row desc, entry_row desc, row desc"


def newest():
    """The order of a run's trades, the last one first."""
    return [F.desc(c) for c in ("session_date", "exit_ts_row", "entry_row", "row")]


#: Sizes up to the trading bar's.
SMALL = {n: s for n, s in B.SIZES.items() if s <= 300}


def _ticks(spark, d):
    """The ticks, stored once for all backtest queries."""
    return stored_once(spark, "ticks", f"{d}/events.parquet", lambda: ticks(spark, d))


def _table(spark, d):
    """Bars of the trading size and all below it, by a cascade from the stored ticks."""
    return stored_once(spark, "small-bars", f"{d}/events.parquet", lambda: B.write_sizes(_ticks(spark, d), shared_folder(spark, "sizes"), SMALL))


def _rsi(spark, d):
    """Numbered bars of the trading size with their sma_rsi, stored once: by sessions and blocks of rows, so no task holds a symbol's history."""
    def make():
        return I.in_blocks(X.numbered(stored(B.bars(_ticks(spark, d), SMALL["5"]), "bars-5")), lambda b, block: I.sma_rsi(b, by=(block,)), back=14)

    return stored_once(spark, "rsi-5", f"{d}/events.parquet", make)


def _rows(spark, d):
    return _rsi(spark, d).drop("sma_rsi")


def _bars5(spark, d):
    return _rows(spark, d).drop("row")


def _sided(spark, d, level=0.2):
    b = _rsi(spark, d).repartition(parts(spark, f"{d}/events.parquet"), *B.KEYS)
    side = F.when(F.col("sma_rsi") > level, 1).when(F.col("sma_rsi") < -level, -1).otherwise(0)
    return X.session_ends(b.withColumn("side", side), 5, 1320)


def _signals(spark, d, level=0.2):
    """The signals: stored once, as every step of the exits reads them."""
    return stored_once(spark, f"signals-{level}", f"{d}/events.parquet", lambda: X.signals(X.turns(_sided(spark, d, level))))


def _exits(spark, d, level=0.2):
    """Every signal's exits: stored once, as the run and all that checks it read them."""
    sig = lambda: X.stop_grid(_signals(spark, d, level), [6, 12], [6, 12])
    return stored_once(spark, f"exits-{level}", f"{d}/events.parquet", lambda: X.find_exits(sig(), _rows(spark, d), None, _ticks(spark, d), "5", SMALL))


def _run(spark, d, level=0.2):
    """The run's trades: stored once, as all statistics read them."""
    return stored_once(spark, f"run-{level}", f"{d}/events.parquet", lambda: X.costs(X.one_at_a_time(_exits(spark, d, level))))


#: The strategies that leaderboards and slices compare, by their level.
STRATEGIES = (0.2, 0.4)


def _runs(spark, d):
    """The trades of both strategies."""
    parts = [_run(spark, d, x).withColumn("strategy", F.lit(f"rsi_{x}")) for x in STRATEGIES]
    return parts[0].unionByName(parts[1])


def both(sql: str) -> str:
    """A run's SQL for both strategies at once: each symbol stands once for each level, which is the second part of its name."""
    out = sql.replace("select event_id as arrival_id, event_type as symbol,", "select event_id as arrival_id, event_type || '|' || lvl as symbol,", 1)
    out = out.replace("from events\n), trades as", f"from events, (values {', '.join(f'({x!r})' for x in map(str, STRATEGIES))}) l(lvl)\n), trades as", 1).replace("event_type) % 5", "split_part(event_type, '|', 1)) % 5")
    level = "split_part(symbol, '|', 2)::double"
    return out.replace("sma_rsi > 0.2 then 1 when sma_rsi < -0.2", f"sma_rsi > {level} then 1 when sma_rsi < -{level}", 1)


NAMED = "'rsi_' || split_part(symbol, '|', 2) as strategy, split_part(symbol, '|', 1) as symbol"


_stored_run = _run


def _days(spark, d):
    return _bars5(spark, d).select("session_date").distinct()


def _round(df, names: list[str]):
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + 0.0 for n in names})


@query("rsi_signals", f"with {S.RSI} select symbol, {DAY}, bar_no, case when sma_rsi > 0.2 then 1 else 0 end as \"rsi_long_0.2\", case when sma_rsi > 0.4 then 1 else 0 end as \"rsi_long_0.4\", case when sma_rsi < -0.2 then -1 else 0 end as \"rsi_short_0.2\", case when sma_rsi < -0.4 then -1 else 0 end as \"rsi_short_0.4\" from rsi")
def rsi_signals_q(spark, d):
    many = X.expand([(X.rsi_long, {"level": [0.2, 0.4]}), (X.rsi_short, {"level": [0.2, 0.4]})])
    return day(X.signal_columns(I.sma_rsi(bars5(spark, d)), many).select("symbol", "session_date", "bar_no", *(F.col(f"`{s.name}`") for s in many)))


_ENS = f"with {S.RSI}, m as (select *, {_GUARD % f'avg(close) over ({S.W} rows 19 preceding)'} as m from rsi), v as (select *, case when sma_rsi > 0.2 then 1 when sma_rsi < -0.2 then -1 else 0 end as a, coalesce(case when close < m then 1 when close > m then -1 end, 0) as b from m)"


def _votes(spark, d):
    b = I.sma(I.sma_rsi(bars5(spark, d)))
    side = F.when(F.col("sma_rsi") > 0.2, 1).when(F.col("sma_rsi") < -0.2, -1).otherwise(0)
    mean = F.coalesce(F.when(F.col("close") < F.col("20_sma"), 1).when(F.col("close") > F.col("20_sma"), -1), F.lit(0))
    return b.withColumns({"a": side, "b": mean})


@query("ensemble", f"{_ENS} select symbol, {DAY}, bar_no, case when (a = 1 or b = 1) and (a = -1 or b = -1) then 0 when a = 1 or b = 1 then 1 when a = -1 or b = -1 then -1 else 0 end as any_side, case when a = 1 and b = 1 then 1 when a = -1 and b = -1 then -1 else 0 end as every_side from v")
def ensemble_q(spark, d):
    return day(_votes(spark, d).select("symbol", "session_date", "bar_no", X.ensemble(["a", "b"], True).alias("any_side"), X.ensemble(["a", "b"], False).alias("every_side")))


@query("signal_pattern", f"{_ENS}, w as (select *, case when (a = 1 or b = 1) and (a = -1 or b = -1) then 0 when a = 1 or b = 1 then 1 when a = -1 or b = -1 then -1 else 0 end as side from v) select symbol, {DAY}, bar_no, case when side = 1 then 'L' when side = -1 then 'S' end || (a = side)::int || (b = side)::int as pattern from w")
def signal_pattern_q(spark, d):
    v = _votes(spark, d).withColumn("side", X.ensemble(["a", "b"], True))
    return day(v.select("symbol", "session_date", "bar_no", X.pattern(["a", "b"]).alias("pattern")))


@query("flat_bar", f"with {S.SIDES} select distinct symbol, {DAY}, flat, stop from stops")
def flat_bar_q(spark, d):
    return day(_sided(spark, d).select("symbol", "session_date", "flat", "stop").distinct())


@query("signal_turns", f"with {S.SIDES} select symbol, {DAY}, row, side, change from turned where side <> 0 and start")
def signal_turns_q(spark, d):
    return day(X.turns(_sided(spark, d)).filter("side <> 0 and start").select("symbol", "session_date", "row", "side", "change"))


@query("signal_runs", f"with {S.SIDES}, r as (select *, coalesce(side <> lag(side) over ({S.W}) or session_date <> lag(session_date) over ({S.W}), true) as new from stops), g as (select *, sum(new::int) over ({S.W}) as run from r) select symbol, {DAY}, row, side, max(row) over (partition by symbol, run) + 1 as change, new::int as start from g")
def signal_runs_q(spark, d):
    return day(X.runs(_sided(spark, d)).select("symbol", "session_date", "row", "side", "change", F.col("start").cast("int").alias("start")))


@query("entry_filter", f"with {S.SIDES} select symbol, {DAY}, row, side, entry_px from sig")
def entry_filter_q(spark, d):
    return day(_signals(spark, d).select("symbol", "session_date", "row", "side", "entry_px"))


@query("entry_filter_news", f"with {S.SIDES}, {_NEWS_SQL}, nb as (select t.symbol, t.session_date, sod // 300 as bar_no, max(exists (select 1 from news n where n.session_date = t.session_date and epoch_us(t.ts_clock) >= n.lo and epoch_us(t.ts_clock) < n.hi)::int) as news from ticks t group by 1, 2, 3), w as (select turned.*, lead(news) over ({S.W}) as next_news from turned join nb using (symbol, session_date, bar_no)) select symbol, {DAY}, row, side from w where side <> 0 and start and row + 1 < stop and coalesce(next_news, 0) = 0 and side * (close - open) >= 0")
def entry_filter_news_q(spark, d):
    """Signals whose bar does not go against them and whose entry bar is free of news."""
    t = labelled(spark, d)
    news = t.groupBy("symbol", "session_date", F.floor(F.col("sod") / 300).cast("long").alias("bar_no")).agg(F.max(F.greatest(*(f"news_{k}" for k in T.NEWS))).alias("news"))
    turned = X.turns(_sided(spark, d)).join(news, ["symbol", "session_date", "bar_no"])
    out = X.signals(turned, no_entry="news", entry_ok=F.col("side") * (F.col("close") - F.col("open")) >= 0)
    return day(out.select("symbol", "session_date", "row", "side"))


@query("entry_mismatch", f"with {S.BARS5} select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no from bars b join ticks t on b.symbol = t.symbol and b.session_date = t.session_date and b.start_tick = t.tick_no where t.price <> b.open")
def entry_mismatch_q(spark, d):
    t = ticks(spark, d).select("symbol", "session_date", F.col("tick_no").alias("start_tick"), "price")
    b = bars5(spark, d).join(t, ["symbol", "session_date", "start_tick"])
    return day(b.filter("price <> open").select("symbol", "session_date", "bar_no"))


@query("stop_grid", f"with {S.SIDES}, grid(tp, sl) as (values (6::double, 6::double), (6, 12), (12, 6), (12, 12)) select symbol, row, tp, sl, cast(tp as int) || '/' || cast(sl as int) as stops from sig, grid")
def stop_grid_q(spark, d):
    return X.stop_grid(_signals(spark, d), [6, 12], [6, 12]).select("symbol", "row", "tp", "sl", "stops")


@query("vol_grid", f"with {S.SIDES}, sd as (select symbol, row, {_GUARD % f'stddev_pop(close) over ({S.W} rows 19 preceding)'} as sd from bars), g(a, b) as (values (1.5::double, 2::double), (1.5, 0.75), (3, 2), (3, 0.75)) select symbol, row, a::decimal(4,2)::varchar as k, greatest(1, ceil(round(a * sd, 6))) as tp, greatest(1, ceil(round(b * sd, 6))) as sl from sig join sd using (symbol, row), g where sd is not null")
def vol_grid_q(spark, d):
    b = X.rows(I.std(_bars5(spark, d))).select("symbol", "row", F.col("20_std").alias("vol"))
    sig = _signals(spark, d).join(b, ["symbol", "row"]).filter("vol is not null")
    out = X.vol_grid(sig, [1.5, 3.0], [2.0, 0.75], "vol")
    return out.select("symbol", "row", F.split("stops", "x")[0].cast("decimal(4,2)").cast("string").alias("k"), "tp", "sl")


def _entries(spark, d):
    b = _rows(spark, d)
    return b.select("symbol", "session_date", "bar_no", "start_tick", "row", (F.col("open") + 2.0).alias("upper"), (F.col("open") - 2.0).alias("lower"), F.concat_ws("|", "symbol", "row").alias("entry_id"))


_FIRST = f"with {S.BARS5} select b.symbol, b.row, coalesce(arg_min(case when t.price >= b.open + 2 then 1 else -1 end, t.tick_no) filter (t.price >= b.open + 2 or t.price <= b.open - 2), 0) as hit from bars b join ticks t on b.symbol = t.symbol and b.session_date = t.session_date and t.sod // 300 = b.bar_no group by b.symbol, b.row"


@query("first_hit", _FIRST)
def first_hit_q(spark, d):
    """Which of two levels each five-minute bar touches first, by descent to one-second bars and their ticks."""
    return level_search(_entries(spark, d), _table(spark, d), _ticks(spark, d), "5", SMALL).select("symbol", "row", "hit")


_LEVELS = f"""with {S.TICKS}, {S.bars(86400, 'b', False)}, e as (select symbol, session_date, open + u as upper, open - l as lower, u || '/' || l as levels, unnest(['day', '60', '15']) as freq, unnest([86400, 3600, 900]) as secs from b, (values (2.0, 2.0), (5.5, 3.5), (12.0, 'inf'::double)) g(u, l)),
s as (select e.*, t.sod // secs as n, t.price, t.tick_no from e join ticks t on e.symbol = t.symbol and e.session_date = t.session_date)
select symbol, {DAY}, freq, levels, n as bar_no, coalesce(arg_min(case when price >= upper then 1 else -1 end, tick_no) filter (price >= upper or price <= lower), 0) as hit from s group by all"""


@query("level_search", _LEVELS)
def level_search_q(spark, d):
    """Fractional, near, far and missing levels around each session's open, for day, 60-minute and 15-minute bars: the whole descent."""
    t = _ticks(spark, d)
    table = B.write_sizes(t, shared_folder(spark, "sizes"))
    open_ = table.filter("freq = 'day'").select("symbol", "session_date", F.col("open").alias("_open"))
    pairs = F.array(*(F.struct(F.lit(u).alias("_u"), F.lit(v).alias("_l"), F.lit(n).alias("levels")) for u, v, n in ((2.0, 2.0, "2.0/2.0"), (5.5, 3.5, "5.5/3.5"), (12.0, float("inf"), "12.0/inf"))))
    out = []
    for size in ("day", "60", "15"):
        e = table.filter(F.col("freq") == size).join(open_, ["symbol", "session_date"]).select("symbol", "session_date", "freq", "bar_no", "start_tick", "_open", F.inline(pairs))
        e = e.withColumns({"upper": F.col("_open") + F.col("_u"), "lower": F.col("_open") - F.col("_l"), "entry_id": F.concat_ws("|", "symbol", "session_date", "bar_no", "levels")})
        out.append(level_search(e, table, t, size).select("symbol", "session_date", "freq", "levels", "bar_no", "hit"))
    return day(out[0].unionByName(out[1]).unionByName(out[2]))


@query("first_hit_brute", _FIRST)
def first_hit_brute_q(spark, d):
    """The plain form: every tick of every entry's bar."""
    t = ticks(spark, d).select("symbol", "session_date", F.floor(F.col("sod") / 300).cast("long").alias("bar_no"), "tick_no", "price")
    touch = (F.col("price") >= F.col("upper")) | (F.col("price") <= F.col("lower"))
    both = _entries(spark, d).join(t, ["symbol", "session_date", "bar_no"])
    side = F.when(touch, F.when(F.col("price") >= F.col("upper"), 1).otherwise(-1))
    return both.groupBy("symbol", "row").agg(F.coalesce(F.min_by(side, F.when(touch, F.col("tick_no"))), F.lit(0)).alias("hit"))


_TRADE = f"symbol, stops, {DAY}, row, side, entry_row, exit_row, exit_ts_row, entry_px, exit_px, result, pnl"
_COLS = ["symbol", "stops", "session_date", "row", "side", "entry_row", "exit_row", "exit_ts_row", "entry_px", "exit_px", "result", "pnl"]


@query("find_exits", f"with {S.EXITS} select {_TRADE} from trades_all")
def find_exits_q(spark, d):
    return day(_exits(spark, d).select(_COLS))


@query("one_at_a_time", f"with recursive {S.KEPT} select {_TRADE} from kept")
def one_at_a_time_q(spark, d):
    return day(X.one_at_a_time(_exits(spark, d)).select(_COLS))


@query("costs", f"with recursive {S.KEPT} select symbol, stops, row, cast(gross_usd as double) as gross_usd, cast(net_usd as double) as net_usd from run")
def costs_q(spark, d):
    return _run(spark, d).select("symbol", "stops", "row", "gross_usd", "net_usd")


@query("backtest", f"with recursive {S.KEPT} select 'rsi_0.2' as strategy, 'normal' as mode, 12.5::double as tick_usd, 2.0::double as commission, symbol, stops, {DAY}, row, result, cast(net_usd as double) as net_usd from run")
def backtest_q(spark, d):
    """A run's trades with the parameters that made them."""
    stamp = {"strategy": "rsi_0.2", "mode": "normal", "tick_usd": X.TICK_USD, "commission": X.COMMISSION}
    return day(_run(spark, d).select(*(F.lit(v).alias(k) for k, v in stamp.items()), "symbol", "stops", "session_date", "row", "result", "net_usd"))


_MONEY = ["gross_usd", "net_usd", "cum_gross_usd", "cum_net_usd", "drawdown_usd"]


def _dbl(names, prefix=""):
    return ", ".join(f"round(cast({prefix}{n} as double), 6) + 0 as {n}" for n in names)


@query("daily", f"with recursive {S.DAILY} select symbol, stops, {DAY}, trades, wins, {_dbl(_MONEY)} from daily")
def daily_q(spark, d):
    return day(_round(ST.daily(_stored_run(spark, d), _days(spark, d), RUN), _MONEY))


_ROLL = f"""rolled as (select *, sum(gross_usd) over w as g, sum(net_usd) over w as n, avg(net_usd) over w / nullif(stddev_samp(net_usd) over w, 0) * sqrt(252) as s, sum(wins) over w / nullif(sum(trades) over w, 0)::double as wr, count(*) over w as c
  from daily window w as (partition by symbol, stops order by session_date rows 20 preceding))"""


@query("rolling_month", f"with recursive {S.DAILY}, {_ROLL} select symbol, stops, {DAY}, case when c = 21 then round(g, 6) + 0 end::double as gross_roll, case when c = 21 then round(n, 6) + 0 end::double as net_roll, case when c = 21 then round(s, 6) + 0 end::double as sharpe_roll, case when c = 21 then round(wr, 6) + 0 end::double as win_rate_roll from rolled")
def rolling_month_q(spark, d):
    return day(_round(ST.rolling(ST.daily(_stored_run(spark, d), _days(spark, d), RUN), RUN), ["gross_roll", "net_roll", "sharpe_roll", "win_rate_roll"]))


_STAT = ["win_rate", "tp_share", "sl_share", "end_share", "avg_win_usd", "avg_loss_usd", "avg_gross_usd", "avg_net_usd", "total_gross_usd", "total_cost_usd", "total_net_usd", "gross_long_usd", "gross_short_usd",
         "net_long_usd", "net_short_usd", "profit_factor", "max_drawdown_usd", "avg_hold_bars", "sharpe", "sortino", "pct_positive_sessions", "worst_month_usd", "pct_positive_months"]
_SUMMARY = f"""{S.DAILY}, {_ROLL}, ord as (select *, row_number() over o as i, sum(net_usd) over o as cum from run window o as (partition by symbol, stops order by session_date, exit_ts_row, entry_row, symbol, row)),
dd as (select *, cum - greatest(max(cum) over (partition by symbol, stops order by i), 0) as dd from ord),
lose as (select symbol, stops, max(n) as longest_losing_streak from (select symbol, stops, g, sum((net_usd < 0)::int)::bigint as n from (select *, sum(case when net_usd < 0 then 0 else 1 end) over (partition by symbol, stops order by i) as g from dd) group by symbol, stops, g) group by symbol, stops),
under as (select symbol, stops, max(n) as max_drawdown_sessions from (select symbol, stops, g, sum((drawdown_usd < 0)::int)::bigint as n from (select *, sum(case when drawdown_usd < 0 then 0 else 1 end) over (partition by symbol, stops order by session_date) as g from daily) group by symbol, stops, g) group by symbol, stops),
main as (select symbol, stops, count(*) as trades, count(*) filter (side = 1) as longs, count(*) filter (side = -1) as shorts, avg((net_usd > 0)::int) as win_rate, avg((result = 1)::int) as tp_share, avg((result = -1)::int) as sl_share, avg((result = 0)::int) as end_share,
  avg(net_usd) filter (net_usd > 0) as avg_win_usd, avg(net_usd) filter (net_usd < 0) as avg_loss_usd, avg(gross_usd) as avg_gross_usd, avg(net_usd) as avg_net_usd, sum(gross_usd) as total_gross_usd, sum(gross_usd) - sum(net_usd) as total_cost_usd, sum(net_usd) as total_net_usd,
  coalesce(sum(gross_usd) filter (side = 1), 0) as gross_long_usd, coalesce(sum(gross_usd) filter (side = -1), 0) as gross_short_usd, coalesce(sum(net_usd) filter (side = 1), 0) as net_long_usd, coalesce(sum(net_usd) filter (side = -1), 0) as net_short_usd,
  coalesce(sum(net_usd) filter (net_usd > 0), 0)::double / nullif(-coalesce(sum(net_usd) filter (net_usd < 0), 0)::double, 0) as profit_factor, min(dd) as max_drawdown_usd, avg(exit_ts_row - entry_row) as avg_hold_bars from dd group by symbol, stops),
dayst as (select symbol, stops, avg(net_usd) / nullif(stddev_samp(net_usd), 0) * sqrt(252) as sharpe, avg(net_usd) / nullif(sqrt(avg(pow(least(net_usd, 0), 2))), 0) * sqrt(252) as sortino, avg((net_usd > 0)::int) as pct_positive_sessions from daily group by symbol, stops),
mon as (select symbol, stops, min(n) as worst_month_usd, avg((n > 0)::int) as pct_positive_months from rolled where c = 21 group by symbol, stops),
summary as (select * from main join dayst using (symbol, stops) left join mon using (symbol, stops) join under using (symbol, stops) join lose using (symbol, stops))"""
_STATSQL = f"trades, longs, shorts, max_drawdown_sessions, longest_losing_streak, {_dbl(_STAT)}"


@query("summary", f"with recursive {_SUMMARY} select symbol, stops, {_STATSQL} from summary")
def summary_q(spark, d):
    return _round(ST.summary(_stored_run(spark, d), _days(spark, d), RUN), _STAT)


_WHO = "), run as (select * exclude (stops), stops || '|' || who as stops from run0, (values ('all'), ('long'), ('short')) w(who) where who = 'all' or (who = 'long') = (side = 1)), days as ("
_SIDED_SUMMARY = _SUMMARY.replace("run as (\n", "run0 as (\n", 1).replace("), days as (", _WHO, 1)


@query("summary_by_side", f"with recursive {_SIDED_SUMMARY} select symbol, stops, {_STATSQL} from summary")
def summary_by_side_q(spark, d):
    """Every measure for all trades, the long ones and the short ones of each run."""
    return _round(ST.summary(ST.by_sides(_stored_run(spark, d), "stops"), _days(spark, d), RUN), _STAT)


@query("leaderboard", f"with recursive {both(_SUMMARY)}, named as (select {NAMED}, stops, trades, total_net_usd from summary) select *  exclude (total_net_usd), round(cast(total_net_usd as double), 6) + 0 as total_net_usd, row_number() over (order by total_net_usd desc, strategy, symbol, stops) as place from named")
def leaderboard_q(spark, d):
    """Every strategy's runs, the one with most net first: one row for each run of the grid, the report itself."""
    run = ["strategy", *RUN]
    s = ST.summary(_runs(spark, d), _days(spark, d), run).select(*run, "trades", F.round("total_net_usd", 6).alias("total_net_usd"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total_net_usd"), *run)).cast("long"))


@query("final_run", f"with recursive {_SUMMARY}, best as (select symbol, stops from summary order by total_net_usd desc, symbol, stops limit 1) select r.symbol, r.stops, r.row, cast(r.net_usd as double) as net_usd from run r join best using (symbol, stops)")
def final_run_q(spark, d):
    return ST.final_run(_run(spark, d), RUN).select(*RUN, "row", "net_usd")


@query("final_run_chosen", f"with recursive {both(S.KEPT)}, named as (select {NAMED}, stops, row, net_usd from run) select strategy, symbol, stops, row, cast(net_usd as double) as net_usd from named where strategy = 'rsi_0.2' and stops = '12/6'")
def final_run_chosen_q(spark, d):
    """The configured run instead of the best one."""
    return ST.final_run(_runs(spark, d), ["strategy", "stops"], ("rsi_0.2", "12/6")).select("strategy", *RUN, "row", "net_usd")


def _period_sql(unit: str) -> str:
    return f"""with recursive {S.KEPT}, p as (select *, date_trunc('{unit}', session_date) as period from run), c as (select *, row_number() over o as i, sum(net_usd) over o as cum from p window o as (partition by symbol, stops, period order by session_date, exit_ts_row, entry_row, symbol, row)),
 q as (select *, cum - greatest(max(cum) over (partition by symbol, stops, period order by i), 0) as dd from c)
 select symbol, stops, strftime(period, '%Y-%m-%d') as period, count(*) as trades, round(avg((net_usd > 0)::int), 6) as win_rate, sum(gross_usd)::double as gross_usd, sum(net_usd)::double as net_usd, min(dd)::double as max_drawdown_usd from q group by symbol, stops, period"""


def _period_q(unit: str):
    def run(spark, d):
        p = ST.by_period(_run(spark, d), unit, RUN)
        return _round(p.withColumn("period", F.date_format("period", "yyyy-MM-dd")), ["win_rate"])

    return run


for _unit in ("month", "year", "week"):
    query(f"by_{_unit}", _period_sql(_unit))(_period_q(_unit))


@query("by_side", f"with recursive {S.KEPT} select symbol, stops, coalesce(cast(side as varchar), 'all') as side, count(*) as trades, round(avg((net_usd > 0)::int), 6) as win_rate, sum(net_usd)::double as net_usd from run group by grouping sets ((symbol, stops), (symbol, stops, side))")
def by_side_q(spark, d):
    g = _run(spark, d).groupingSets([[F.col(c) for c in RUN], [F.col(c) for c in [*RUN, "side"]]], *[F.col(c) for c in [*RUN, "side"]])
    out = g.agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg((F.col("net_usd") > 0).cast("double")), 6).alias("win_rate"), F.sum("net_usd").alias("net_usd"))
    return out.withColumn("side", F.coalesce(F.col("side").cast("string"), F.lit("all")))


def _labelled(spark, d):
    b = _rows(spark, d).select("symbol", F.col("row").alias("entry_row"), F.floor(F.col("bar_no") / 12).cast("int").alias("hour"))
    return _run(spark, d).join(b, ["symbol", "entry_row"])


_LABELLED = S.KEPT + ", lab as (select r.*, cast(b.bar_no // 12 as int) as hour from run r join bars b on b.symbol = r.symbol and b.row = r.entry_row)"


@query("by_label", f"with recursive {_LABELLED} select stops, hour, count(*) as trades, round(avg((net_usd > 0)::int), 6) as win_rate, sum(gross_usd)::double as gross_usd, sum(net_usd)::double as net_usd, coalesce(sum(gross_usd) filter (side = 1), 0)::double as gross_long_usd, coalesce(sum(gross_usd) filter (side <> 1), 0)::double as gross_short_usd, coalesce(sum(net_usd) filter (side = 1), 0)::double as net_long_usd, coalesce(sum(net_usd) filter (side <> 1), 0)::double as net_short_usd, round(avg(net_usd), 6)::double as avg_net_usd from lab group by stops, hour")
def by_label_q(spark, d):
    return _round(ST.by_label(_labelled(spark, d), F.col("hour"), "hour", ["stops"]), ["win_rate", "avg_net_usd"])


LABELS = ["hour", "year", "month", "side"]


def _pattern_sql() -> str:
    return "case side when 1 then 'L' || (sma_rsi > 0.2)::int || (sma_rsi > 0.4)::int else 'S' || (sma_rsi < -0.2)::int || (sma_rsi < -0.4)::int end"


def _slices_sql() -> str:
    combined = ["hour", "year", "side", "signals"]
    combos = [[c] for c in LABELS] + [[c, "side"] for c in LABELS if c != "side"] + [["signals"], combined]
    parts = []
    for c in combos:
        value = " || ' / ' || ".join(f"{x}::varchar" for x in c)
        who = f"'{ST.ALL}'" if c == combined else "strategy"
        parts.append(f"""select {who} as strategy, stops, '{' x '.join(c)}' as label, {value} as value, count(*) as trades, avg(gross_usd) as gross_per_trade, avg(net_usd) as net_per_trade, avg((net_usd > 0)::int) as win_rate, sum(net_usd) as net_usd,
 avg(net_usd) / nullif(stddev_samp(net_usd), 0) * sqrt(count(*)) as t_net, count(*) filter (session_date < date '{SPLIT}') as trades_before, coalesce(sum(net_usd) filter (session_date < date '{SPLIT}'), 0) as net_before,
 count(*) filter (session_date >= date '{SPLIT}') as trades_after, coalesce(sum(net_usd) filter (session_date >= date '{SPLIT}'), 0) as net_after, count(distinct year) as years,
 (select count(*) from (select 1 from lab y where y.stops = lab.stops {'' if c == combined else 'and y.strategy = lab.strategy'} {' '.join(f'and y.{x} = lab.{x}' for x in c)} group by y.year having sum(y.net_usd) > 0)) as years_positive
 from lab group by {'' if c == combined else 'strategy, '}stops, {', '.join(c)}""")
    return f"""with recursive {both(S.KEPT)}, lab as (
 select 'rsi_' || split_part(r.symbol, '|', 2) as strategy, r.stops, r.session_date, r.side, r.gross_usd::double as gross_usd, r.net_usd::double as net_usd, cast(b.bar_no // 12 as int) as hour, year(r.session_date)::int as year, month(r.session_date)::int as month,
  {_pattern_sql().replace('side', 'r.side').replace('sma_rsi', 's.sma_rsi')} as signals
 from run r join bars b on b.symbol = r.symbol and b.row = r.entry_row join rsi s on s.symbol = r.symbol and s.row = r.row
), slices as ({' union all '.join(parts)})"""


_SLICES = _slices_sql()
_SLICE_NUMBERS = ["gross_per_trade", "net_per_trade", "win_rate", "net_usd", "t_net", "net_before", "net_after"]


def _slices(spark, d):
    """Slices of both strategies' trades, labelled by hour of entry, year, month, side, and the pattern of signals on the signal bar."""
    b = _rsi(spark, d)
    hour = b.select("symbol", F.col("row").alias("entry_row"), F.floor(F.col("bar_no") / 12).cast("int").alias("hour"))
    many = [X.rsi_long(0.2), X.rsi_long(0.4), X.rsi_short(0.2), X.rsi_short(0.4)]
    at = X.signal_columns(b, many).select("symbol", "row", *(F.col(f"`{s.name}`").alias(f"s{k}") for k, s in enumerate(many)))
    t = _runs(spark, d).join(hour, ["symbol", "entry_row"]).join(at, ["symbol", "row"])
    bits = lambda names: F.concat(*(F.when(F.col(n) == F.col("side"), "1").otherwise("0") for n in names))
    t = t.withColumns({
        "signals": F.when(F.col("side") == 1, F.concat(F.lit("L"), bits(["s0", "s1"]))).otherwise(F.concat(F.lit("S"), bits(["s2", "s3"]))),
        "year": F.year("session_date"), "month": F.month("session_date"),
    })
    return ST.slices(t, LABELS, SPLIT)


@query("slices", f"{_SLICES} select strategy, stops, label, value, trades, trades_before, trades_after, years, years_positive, {_dbl(_SLICE_NUMBERS)} from slices")
def slices_q(spark, d):
    return _round(_slices(spark, d), _SLICE_NUMBERS)


@query("top_slices", f"""{_SLICES}, a as (select *, row_number() over (order by net_usd desc, strategy, stops, label, value) as place from slices where strategy <> '{ST.ALL}' and trades_before >= 5 and trades_after >= 5 and net_before > 0 and net_after > 0),
b as (select *, row_number() over (order by t_net desc nulls last, strategy, stops, label, value) as place from slices where strategy = '{ST.ALL}' and net_usd > 0)
select 'net' as list, place, strategy, stops, label, value, trades, {_dbl(['net_usd', 't_net'])} from a where place <= 15 union all select 't', place, strategy, stops, label, value, trades, {_dbl(['net_usd', 't_net'])} from b where place <= 15""")
def top_slices_q(spark, d):
    """The slices to look at: those that gain in both halves by net, and the combined ones by t-stat."""
    found = stored(_slices(spark, d), "slices").withColumn("t_net", F.round("t_net", 9))
    return _round(ST.best_slices(found, 5), ["net_usd", "t_net"]).select("list", "place", "strategy", "stops", "label", "value", "trades", "net_usd", "t_net")


@query("pooled", f"with recursive {_LABELLED} select hour, count(*) as trades, round(avg(net_usd), 6)::double as avg_net_usd, round(avg((net_usd > 0)::int), 6) as win_rate, round(avg(net_usd) filter (session_date < date '{SPLIT}'), 6)::double as avg_before, round(avg(net_usd) filter (session_date >= date '{SPLIT}'), 6)::double as avg_after from lab group by hour")
def pooled_q(spark, d):
    """Each hour over all stops, and on both sides of the split."""
    early, mean = F.col("session_date") < F.lit(SPLIT).cast("date"), lambda c: F.round(F.avg(c), 6)
    return _labelled(spark, d).groupBy("hour").agg(
        F.count(F.lit(1)).alias("trades"), mean("net_usd").alias("avg_net_usd"), mean((F.col("net_usd") > 0).cast("double")).alias("win_rate"),
        mean(F.when(early, F.col("net_usd"))).alias("avg_before"), mean(F.when(~early, F.col("net_usd"))).alias("avg_after"))


@query("chance_check", f"with recursive {_LABELLED}, cc as (select stops, hour, sum(net_usd) filter (session_date < date '{SPLIT}') as a, sum(net_usd) filter (session_date >= date '{SPLIT}') as b from lab group by stops, hour) select stops, count(*) as n, count(*) filter (a > 0) as before_pos, count(*) filter (b > 0) as after_pos, count(*) filter (a > 0 and b > 0) as both_pos, round(count(*) filter (a > 0) * count(*) filter (b > 0) / count(*)::double, 6) as expected from cc group by stops")
def chance_check_q(spark, d):
    half = F.col("session_date") < F.lit(SPLIT).cast("date")
    s = _labelled(spark, d).groupBy("stops", "hour").agg(F.sum(F.when(half, F.col("net_usd"))).alias("a"), F.sum(F.when(~half, F.col("net_usd"))).alias("b"))
    n, up = F.count(F.lit(1)), (lambda c: F.count(F.when(c, 1)))
    a, b = F.col("a") > 0, F.col("b") > 0
    return s.groupBy("stops").agg(n.alias("n"), up(a).alias("before_pos"), up(b).alias("after_pos"), up(a & b).alias("both_pos"), F.round(up(a) * up(b) / n.cast("double"), 6).alias("expected"))


@query("feature_buckets", f"with {S.RSI}, r as (select *, row_number() over (order by sma_rsi, symbol, row) - 1 as i, count(*) over () as n from rsi where sma_rsi is not null), c as (select max(sma_rsi) filter (i = cast(round((n - 1) / 3.0) as bigint)) as lo, max(sma_rsi) filter (i = cast(round((n - 1) * 2 / 3.0) as bigint)) as hi from r) select symbol, row, case when sma_rsi <= lo then 'low' when sma_rsi <= hi then 'mid' else 'high' end as bucket from r, c")
def feature_buckets_q(spark, d):
    """Nearest-rank thirds: the value at rank round((n - 1) q)."""
    r = X.rows(I.sma_rsi(bars5(spark, d))).filter("sma_rsi is not null").select("symbol", "row", "sma_rsi")
    return ST.buckets(r, "sma_rsi", {"low": 1 / 3, "mid": 2 / 3}, "high").select("symbol", "row", "bucket")


@query("pnl_histogram", f"with recursive {S.KEPT}, m as (select min(pnl) as lo, max(pnl) as hi from run) select result, least(cast(floor((pnl - lo) * 40 / nullif(hi - lo, 0)::double) as bigint), 39) as bin, count(*) as n from run, m group by 1, 2")
def pnl_histogram_q(spark, d):
    run = _stored_run(spark, d)
    m = run.agg(F.min("pnl").alias("lo"), F.max("pnl").alias("hi"))
    b = F.least(F.floor((F.col("pnl") - F.col("lo")) * 40 / F.nullif((F.col("hi") - F.col("lo")).cast("double"), F.lit(0.0))), F.lit(39)).cast("long")
    return run.join(F.broadcast(m), F.lit(True)).groupBy("result", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("grid_matrix", f"with recursive {S.KEPT} select cast(tp as int) as tp, sum(net_usd) filter (sl = 6)::double as sl_6, sum(net_usd) filter (sl = 12)::double as sl_12 from run group by tp")
def grid_matrix_q(spark, d):
    p = _run(spark, d).withColumns({"tp": F.col("tp").cast("int"), "sl": F.col("sl").cast("int")}).groupBy("tp").pivot("sl", [6, 12]).agg(F.sum("net_usd"))
    return p.select("tp", F.col("6").alias("sl_6"), F.col("12").alias("sl_12"))


@query("hour_matrix", f"with recursive {_LABELLED} select hour, sum(net_usd) filter (side = 1)::double as rsi_long, sum(net_usd) filter (side = -1)::double as rsi_short from lab group by hour")
def hour_matrix_q(spark, d):
    """Net of each strategy by hour of entry."""
    t = _labelled(spark, d).withColumn("strategy", F.when(F.col("side") == 1, "rsi_long").otherwise("rsi_short"))
    return ST.hour_matrix(t, ["rsi_long", "rsi_short"])


@query("stable_years", f"with recursive {_LABELLED}, halves as (select stops, hour, sum(net_usd) as n, coalesce(sum(net_usd) filter (session_date < date '{SPLIT}'), 0) as a, coalesce(sum(net_usd) filter (session_date >= date '{SPLIT}'), 0) as b from lab group by stops, hour), best as (select stops, hour from halves where a > 0 and b > 0 order by n desc, stops, hour limit 15) select stops, hour, year(session_date)::int as year, sum(net_usd)::double as net_usd from lab join best using (stops, hour) group by all")
def stable_years_q(spark, d):
    """Net by year of the fifteen best slices that earn before and after the split."""
    return ST.stable_years(stored(_labelled(spark, d), "labelled"), ["stops", "hour"], SPLIT, n=15)


@query("exit_order", f"with recursive {S.KEPT} select symbol, stops, row, row_number() over (partition by symbol, stops order by session_date, exit_ts_row, entry_row, row) as place from run")
def exit_order_q(spark, d):
    w = Window.partitionBy(*RUN).orderBy("session_date", "exit_ts_row", "entry_row", "row")
    return _run(spark, d).select(*RUN, "row", F.row_number().over(w).cast("long").alias("place"))


@query("long_short_union", f"with recursive {S.KEPT} select symbol, row, stops, cast(net_usd as double) as long_net, null::double as short_net from run where side = 1 union all select symbol, row, stops, null, cast(net_usd as double) from run where side = -1")
def long_short_union_q(spark, d):
    run = _stored_run(spark, d)
    a = run.filter("side = 1").select("symbol", "row", "stops", F.col("net_usd").alias("long_net"))
    b = run.filter("side = -1").select("symbol", "row", "stops", F.col("net_usd").alias("short_net"))
    return a.unionByName(b, allowMissingColumns=True)


@query("vol_band", f"with {S.BARS5}, v as (select *, high - low as v, dense_rank() over (partition by symbol order by session_date) as sn from bars), q as (select a.symbol, a.sn, quantile_cont(b.v::double, 0.2) as lo, quantile_cont(b.v::double, 0.8) as hi from (select distinct symbol, sn from v) a join v b on a.symbol = b.symbol and b.sn between a.sn - 10 and a.sn - 1 group by a.symbol, a.sn) select v.symbol, {DAY}, bar_no, cast(coalesce(v.sn > 10 and v.v >= lo and v.v <= hi, false) as int) as ok from v left join q on v.symbol = q.symbol and v.sn = q.sn")
def vol_band_q(spark, d):
    """Inside the 20 to 80 % band of the previous ten sessions' bars; false before there are ten."""
    b = bars5(spark, d).withColumn("v", F.col("high") - F.col("low"))
    return day(X.vol_ok(b, "v", (0.2, 0.8), sessions=10).select("symbol", "session_date", "bar_no", F.col("vol_ok").cast("int").alias("ok")))


@query("ewm_kelly", f"""with recursive {S.KEPT}, o as (select symbol, stops, net_usd / 320.0::double as r, row_number() over ({NEWEST_SQL}) - 1 as i from run), w as (select *, pow(1 - 2 / 1001.0::double, i) as w from o where i < 1000),
m as (select symbol, stops, count(*) as n, sum(w * r) / sum(w) as mu, sqrt(sum(w * pow(least(r, 0), 2)) / sum(w)) as sigma, coalesce(sum(w) filter (r > 0), 0) / sum(w) as win from w group by symbol, stops),
k as (select symbol, stops, n, case when n >= 30 then mu else 0 end as mu, case when n >= 30 then sigma else 0 end as sigma, case when n >= 30 then win else 0 end as win, case when n >= 30 and mu > 0 and sigma > 0 then least(mu / (sigma * sigma), 2) * 0.5 else 0 end as f from m)
select symbol, stops, n as n_trades, round(mu, 6) + 0 as mu, round(sigma, 6) as sigma, round(win, 6) as win_rate, round(f, 6) as kelly_f, round(case when n < 30 then 0.3 when n < 100 then 0.3 + (n - 30) / 70.0::double * f else f end, 6) as confidence from k""")
def ewm_kelly_q(spark, d):
    return _round(SC.ewm_kelly(_run(spark, d), RUN, newest()), ["mu", "sigma", "win_rate", "kelly_f", "confidence"])


del _unit
