"""Queries over the older generation's feature forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickforge.functions.folders import shared_folder, stored
from tickforge.operators import bars as B
from tickforge.operators import indicators as I
from tickforge.operators import older as OL
from tickforge.operators import ticks as T
from tickforge.operators import trading as X
from tickforge.sources import trades as TR
from tickforge.sources.events import events

from . import sql as S
from .backtests import NAMED, _run, _runs, both
from .market import _GUARD, _IN_NEWS, _NEWS_SQL, _UD, DAY, KEY, _zigzag, bars5, day, labelled, ticks
from .registry import query

W = S.W
_B = f"with {S.BARS5}, h as (select *, hi_tick < lo_tick as hl from bars)"
_JOIN = "array_to_string({}, ',')"


def _text(xs):
    return F.array_join(F.transform(xs, lambda x: x.cast("long").cast("string")), ",", "null")


def _hl(spark, d):
    return B.with_hl(bars5(spark, d))


@query("wide_bands", f"with {S.BARS5}, s as (select *, {_GUARD % f'avg(close) over ({W} rows 19 preceding)'} as m, {_GUARD % f'stddev_pop(close) over ({W} rows 19 preceding)'} as sd from bars) select symbol, {DAY}, bar_no, round(m + 4 * sd, 6) as upper, round(m - 4 * sd, 6) as lower, case when m is not null then 3 else 0 end as targets from s")
def wide_bands_q(spark, d):
    """Bands at four deviations, and the vector of mean and bands."""
    b = OL.wide_bands(I.std(I.sma(bars5(spark, d))))
    return day(b.select(*KEY, F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"), F.coalesce(F.size(F.coalesce("targets", F.array().cast("array<double>"))), F.lit(0)).alias("targets")))


_MOVES = f"m as (select *, open - lag(open) over ({W}) as o, high - lag(high) over ({W}) as u, low - lag(low) over ({W}) as l, close - lag(close) over ({W}) as c from h), v as (select *, case when o is not null then case when hl then [o, u, l, c] else [o, l, u, c] end end as moves, case when hl then [open, high, low, close] else [open, low, high, close] end as vec from m)"


@query("ordered_moves", f"{_B}, {_MOVES} select symbol, {DAY}, bar_no, {_JOIN.format('moves')} as moves from v")
def ordered_moves_q(spark, d):
    """Differences to the bar before, in the order in which the bar met its prices."""
    return day(OL.ordered_moves(_hl(spark, d)).select(*KEY, _text("moves").alias("moves")))


@query("raw_windows", f"{_B} select symbol, {DAY}, bar_no, " + ", ".join(f"{_JOIN.format(f'list({c}) over ({W} rows 20 preceding)')} as {c}s" for c in ("close", "high", "low")) + " from h")
def raw_windows_q(spark, d):
    """A bar's close, high and low with those of the twenty bars before it."""
    return day(OL.raw_windows(bars5(spark, d), 20).select(*KEY, *(_text(f"{c}s").alias(f"{c}s") for c in ("close", "high", "low"))))


@query("vector_windows", f"""{_B}, {_MOVES}, p as (select *, list_concat(lag(vec) over ({W}), vec) as pre, lag(vec) over ({W}) is null as head, list_transform(vec, lambda x: (x - open) / 320.0::double) as n, list_transform(coalesce(moves, [null, null, null, null]::bigint[]), lambda x: x / 320.0::double) as k from v),
q as (select *, list(n) over ({W} rows 3 preceding) as ns, list(k) over ({W} rows 3 preceding) as ks from p)
select symbol, {DAY}, bar_no, case when not head then {_JOIN.format('pre')} end as pre_vec, len(ns) * 4 as pairs, round(list_sum(flatten(ns)), 6) + 0 as prices, round(coalesce(list_sum(flatten(ks)), 0), 6) + 0 as moves from q""")
def vector_windows_q(spark, d):
    """Four bars' prices less their open and their moves, as pairs; and the bar before with the bar."""
    b = OL.vector_windows(OL.ordered_moves(_hl(spark, d)).withColumn("ref_px", F.col("open")), 3)
    total = lambda k: F.round(F.aggregate("movement", F.lit(0.0), lambda a, x: a + F.coalesce(F.get(x, F.lit(k)), F.lit(0.0))), 6) + 0.0
    return day(b.select(*KEY, _text("pre_vec").alias("pre_vec"), F.size("movement").cast("long").alias("pairs"), total(0).alias("prices"), total(1).alias("moves")))


@query("scaled_features", f"with {S.BARS5}, s as (select *, {_GUARD % f'avg(close) over ({W} rows 19 preceding)'} as m, {_GUARD % f'stddev_pop(close) over ({W} rows 19 preceding)'} as sd from bars) select symbol, {DAY}, bar_no, round((m - close) / 320.0::double, 9) + 0 as near, round(sd / 320.0::double, 9) + 0 as size, round((high - low) / 320.0::double, 9) + 0 as span, round((m + 4 * sd - close) / 320.0::double, 9) + 0 as top from s")
def scaled_features_q(spark, d):
    """Means, bands, deviations and ranges over the norm, prices as distances from the close."""
    b = OL.wide_bands(I.std(I.sma(bars5(spark, d)))).withColumn("bar_range", F.col("high") - F.col("low"))
    b = OL.scaled(b, ["20_sma"], ["20_std", "bar_range"], ["targets"])
    n = lambda c: F.round(c, 9) + 0.0
    return day(b.select(*KEY, n(F.col("20_sma")).alias("near"), n(F.col("20_std")).alias("size"), n(F.col("bar_range")).alias("span"), n(F.get("targets", F.lit(1))).alias("top")))


def _resampled_sql(group: str) -> str:
    return f"""{_B}, a as (select *, {group} as g, (open + high + low + close) / 4.0::double as avg_px from h), t as (select symbol, g, arg_min(open, row) as open, max(high) as high, min(low) as low, arg_max(close, row) as close, sum(volume)::bigint as volume, sum(avg_px * volume) / sum(volume) as avg_px, arg_min(row, -high * 10000000 + row) as top, arg_min(row, low * 10000000 + row) as bottom from a group by symbol, g),
u as (select t.*, case when top = bottom then b.hl else top < bottom end as hl from t join h b on b.symbol = t.symbol and b.row = t.top)
select symbol, g, open, high, low, close, volume, round(avg_px, 6) as avg_px, hl::int as hl, {_JOIN.format('case when hl then [open, high, low, close] else [open, low, high, close] end')} as vec from u"""


def _resampled_q(group):
    def run(spark, d):
        b = _hl(spark, d).withColumn("avg_px", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / F.lit(4.0))
        out = OL.resampled(b, group(), "g")
        return out.select("symbol", "g", "open", "high", "low", "close", "volume", F.round("avg_px", 6).alias("avg_px"), F.col("hl").cast("int").alias("hl"), _text("vec").alias("vec"))

    return run


query("resample_720", _resampled_sql("strftime(session_date, '%Y-%m-%d') || '/' || (bar_no // 144)::int"))(_resampled_q(lambda: F.concat(F.date_format("session_date", "yyyy-MM-dd"), F.lit("/"), F.floor(F.col("bar_no") / 144).cast("string"))))
query("resample_week", _resampled_sql("strftime(date_trunc('week', session_date), '%Y-%m-%d')"))(_resampled_q(lambda: F.date_format(F.date_trunc("week", "session_date"), "yyyy-MM-dd")))


@query("merge_sizes_legacy", f"""with {S.BARS5}, {S.bars(3600, 'big', False)}, g as (select b.symbol, b.session_date, min(b.bar_no) as place, any_value(g.close) as close_60 from bars b join big g on g.symbol = b.symbol and g.session_date = b.session_date and g.bar_no = b.bar_no // 12 where b.bar_no // 12 % 7 <> 3 group by b.symbol, b.session_date, b.bar_no // 12
  union all select symbol, session_date, 500, 7 from (select distinct symbol, session_date from bars where day(session_date) = 9)),
j as (select symbol, session_date, place, b.close, g.close_60 as v from (select symbol, session_date, bar_no as place, close from bars) b full join g using (symbol, session_date, place)),
k as (select *, last_value(v ignore nulls) over (partition by symbol order by session_date, place) as kept, count(v) over (partition by symbol order by session_date, place) as nth, lead(v) over (partition by symbol order by session_date, place) is not null as follows from j)
select symbol, {DAY}, place, close, case when follows and nth >= 2 then kept end as close_60 from k""")
def merge_sizes_legacy_q(spark, d):
    """Larger bars outer-merged on times and shown before the next one; some are missing, some stand at times of their own."""
    five = stored(bars5(spark, d).withColumn("big_no", F.floor(F.col("bar_no") / 12).cast("long")), "five")
    big = B.roll_up(five.drop("big_no"), 12).select("symbol", "session_date", F.col("bar_no").alias("big_no"), F.col("close").alias("close_60"))
    starts = five.groupBy("symbol", "session_date", "big_no").agg(F.min("bar_no").alias("at")).filter("big_no % 7 <> 3")
    odd = five.filter(F.dayofmonth("session_date") == 9).select("symbol", "session_date", F.lit(500).cast("long").alias("at"), F.lit(7).cast("long").alias("close_60")).distinct()
    shown = starts.join(big, ["symbol", "session_date", "big_no"]).select("symbol", "session_date", "at", "close_60").unionByName(odd)
    return day(OL.merged_sizes(five.select("symbol", "session_date", F.col("bar_no").alias("at"), "close"), shown, ["close_60"]).withColumnRenamed("at", "place"))


@query("burn_in_pivots", f"with recursive {_UD}, p as (select symbol, row, row_number() over (partition by symbol order by row) as i from z where coalesce(top, bottom) is not null), f as (select symbol, row as first from p where i = 5) select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no from bars b join f using (symbol) where b.row >= f.first")
def burn_in_pivots_q(spark, d):
    """Rows from the first with five pivots on."""
    z = X.rows(_zigzag(spark, d))
    ready = F.size(F.filter(OL.padded(OL.stacked([f"last{k}" for k in range(1, 6)]), 5), lambda x: x != 0)) == 5
    return day(OL.from_ready(z, ready, drop_last=False).select(*KEY))


@query("burn_in_atr", f"with {S.BARS5} select symbol, {DAY}, bar_no from (select *, max(row) over (partition by symbol) as z from bars) where row >= 13 and row < z")
def burn_in_atr_q(spark, d):
    """Rows from the first range on, without the last one."""
    return day(OL.from_ready(X.rows(I.atr(bars5(spark, d))), F.col("atr").isNotNull()).select(*KEY))


@query("padded_pivots", f"with recursive {_UD}, p as (select symbol, row, coalesce(top, bottom) as v, row_number() over (partition by symbol order by row) as i from z where coalesce(top, bottom) is not null), c as (select b.symbol, b.session_date, b.bar_no, count(p.row) as n from bars b left join p on p.symbol = b.symbol and p.row <= b.row group by all) select c.symbol, {DAY}, bar_no, concat_ws(',', " + ", ".join(f"coalesce(p{k}.v, 0)::bigint" for k in range(1, 6)) + ") as pivots from c " + " ".join(f"left join p p{k} on p{k}.symbol = c.symbol and p{k}.i = c.n - {k - 1}" for k in range(1, 6)))
def padded_pivots_q(spark, d):
    """The last five pivots as one vector, the newest first, filled up with zeros."""
    return day(_zigzag(spark, d).select(*KEY, _text(OL.padded(OL.stacked([f"last{k}" for k in range(1, 6)]), 5)).alias("pivots")))


@query("news_columns", f"with {S.TICKS}, {_NEWS_SQL} select symbol, {DAY}, sod // 300 as bar_no, {', '.join(f'max(({_IN_NEWS(k)})::int) as {k}' for k in T.NEWS)}, " + " || ".join(f"max(({_IN_NEWS(k)})::int)" for k in T.NEWS) + " as stacked from ticks t group by symbol, session_date, sod // 300")
def news_columns_q(spark, d):
    """A bar's news flags as one array, taken apart by kind and stacked again."""
    each = labelled(spark, d).groupBy("symbol", "session_date", F.floor(F.col("sod") / 300).cast("long").alias("bar_no")).agg(F.array(*(F.max(f"news_{k}") for k in T.NEWS)).alias("is_news"))
    out = each.withColumns(OL.named_entries("is_news", T.NEWS)).withColumn("_v", OL.stacked(list(T.NEWS)))
    return day(out.select(*KEY, *T.NEWS, F.array_join(F.transform("_v", lambda x: x.cast("int").cast("string")), "").alias("stacked")))


@query("dedup_after", f"with {S.BARS5} select symbol, {DAY}, bar_no, open from bars where session_date >= date '2024-01-11'")
def dedup_after_q(spark, d):
    """Doubled bars: the first of each, from a date on."""
    b = bars5(spark, d)
    return day(OL.after(b.unionByName(b.withColumn("start_tick", F.col("start_tick") + 1)), "2024-01-11", ["start_tick"]).select(*KEY, "open"))


@query("strategy_names", f"with recursive {both(S.KEPT)} select distinct 'rsi_' || split_part(symbol, '|', 2) as strategy from run")
def strategy_names_q(spark, d):
    return _runs(spark, d).select("strategy").distinct()


@query("trades_sink", f"with recursive {both(S.KEPT)}, n as (select {NAMED}, stops, session_date, row, side, result, pnl, net_usd from run) select strategy, symbol, stops, {DAY}, row, side, result, pnl, net_usd::double as net_usd, year(session_date) as year, month(session_date) as month from n")
def trades_sink_q(spark, d):
    """The trades of both strategies written by strategy and read back with the types that statistics expect."""
    path = shared_folder(spark, "trades")
    TR.write_trades(_runs(spark, d), path)
    return day(TR.read_trades(spark, path).select("strategy", "symbol", "stops", "session_date", "row", "side", "result", "pnl", "net_usd", "year", "month"))


@query("sample_rows", "select event_id, event_type, user_id from (select * from events order by ts, event_id limit 250)")
def sample_rows_q(spark, d):
    """The first rows in time order as a CSV file, read back."""
    path = shared_folder(spark, "sample")
    TR.export_sample(events(spark, d).select("event_id", "event_type", "user_id", "ts"), path, ["ts", "event_id"], 250)
    return spark.read.option("header", True).schema("event_id long, event_type string, user_id long, ts string").csv(path).select("event_id", "event_type", "user_id")
