"""Queries over sinks, appends and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.folders import parts, shared_folder, stored
from tickforge.operators import append as AP
from tickforge.operators import bars as B
from tickforge.operators import features as FT
from tickforge.operators import indicators as I
from tickforge.sources.calendars import holidays
from tickforge.streaming import bars as ST
from tickforge.streaming import cycles as CY
from tickforge.streaming import sizes as SZ

from . import sql as S
from .backtests import _sided
from .cycles import _CYCLES, STOP, TICK_USD
from .market import _UD, DAY, bars5, day, ticks
from .registry import query


@query("write_ticks", f"with {S.TICKS} select symbol, {DAY}, tick_no, price, volume from ticks")
def write_ticks_q(spark, d):
    path = shared_folder(spark, "ticks")
    t = ticks(spark, d).select("symbol", "session_date", "tick_no", "price", "volume")
    t.hint("rebalance", "session_date").write.option("compression", "zstd").partitionBy("session_date").parquet(path)
    return day(spark.read.parquet(path).select("symbol", "session_date", "tick_no", "price", "volume"))


_WRITTEN = f"with {S.TICKS}, {', '.join(S.bars(x, f'b{n}', False) for n, x in B.SIZES.items())} " + " union all ".join(f"select '{n}' as freq, symbol, {DAY}, bar_no, open, high, low, close, volume, (hi_tick < lo_tick)::int as hl, start_tick, last_tick from b{n}" for n in B.SIZES)


@query("write_bars", _WRITTEN)
def write_bars_q(spark, d):
    """Bars of all ten sizes, written by size and session."""
    table = B.with_hl(B.write_sizes(ticks(spark, d), shared_folder(spark, "bars"), by=("freq", "session_date")))
    return day(table.select("freq", "symbol", "session_date", "bar_no", "open", "high", "low", "close", "volume", F.col("hl").cast("int").alias("hl"), "start_tick", "last_tick"))


_HALF = "2024-01-15"


@query("append_sessions", f"with {S.BARS5} select symbol, {DAY}, bar_no, close from bars where session_date > date '{_HALF}'")
def append_sessions_q(spark, d):
    """Sessions newer than the stored ones are appended; the others are refused."""
    b, path = bars5(spark, d).select("symbol", "session_date", "bar_no", "close"), shared_folder(spark, "sessions")
    old = F.col("session_date") <= F.lit(_HALF).cast("date")
    stored = ST.append_sessions(b.filter(old), path)
    newest = stored.agg(F.max("session_date").alias("newest"))
    return day(b.join(F.broadcast(newest), F.col("session_date") > F.col("newest")).drop("newest"))


@query("append_equals_full", f"with {S.BARS5} select symbol, {DAY}, bar_no, close from bars")
def append_equals_full_q(spark, d):
    """Two appends, the second one run twice, give what one full build gives."""
    b, path = bars5(spark, d).select("symbol", "session_date", "bar_no", "close"), shared_folder(spark, "appends")
    old = F.col("session_date") <= F.lit(_HALF).cast("date")
    ST.append_sessions(b.filter(old), path)
    for _ in range(2):
        out = ST.append_sessions(b.filter(~old), path)
    return day(out.select("symbol", "session_date", "bar_no", "close"))


_FULL = f"""with recursive {_UD}, p as (select symbol, row, coalesce(top, bottom) as v, row_number() over (partition by symbol order by row) as i from z where coalesce(top, bottom) is not null),
c as (select b.symbol, b.row, count(p.row) as n from bars b left join p on p.symbol = b.symbol and p.row <= b.row group by b.symbol, b.row),
tr as (select symbol, row, greatest(high - low, abs(high - lag(close) over ({S.W})), abs(low - lag(close) over ({S.W})))::double as x from bars),
e as (select symbol, row, x as y from tr where row = 0 union all select t.symbol, t.row, e.y * (1 - 1 / 14.0::double) + t.x / 14.0::double from e join tr t on t.symbol = e.symbol and t.row = e.row + 1)
select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, b.close, cast(sum(b.n_ticks) over (partition by b.symbol order by b.row) - b.n_ticks as bigint) as start_ind, cast(sum(b.n_ticks) over (partition by b.symbol order by b.row) as bigint) as next_ind,
 round(kv.kv0 / 3, 6) + 0 as std, case when b.row >= 13 then round(e.y, 6) + 0 end as atr, z.top as u, z.bottom as d, coalesce(f.flag, -1) as flag, p1.v as last1, p5.v as last5
from bars b join kv using (symbol, row) join e using (symbol, row) join c using (symbol, row) left join z on z.symbol = b.symbol and z.row = b.row left join z f on f.symbol = b.symbol and f.row = b.row - 1
left join p p1 on p1.symbol = b.symbol and p1.i = c.n left join p p5 on p5.symbol = b.symbol and p5.i = c.n - 4"""


@query("append_with_state", _FULL)
def append_with_state_q(spark, d):
    """Three appends, each given its own sessions' ticks alone and the last one twice, make the table that a full build makes."""
    t, path = stored(ticks(spark, d), "ticks"), shared_folder(spark, "market")
    day_ = F.col("session_date")
    cuts = [day_ <= F.lit(_HALF).cast("date"), (day_ > F.lit(_HALF).cast("date")) & (day_ <= F.lit("2024-01-22").cast("date")), day_ > F.lit("2024-01-22").cast("date")]
    for cut in [*cuts, cuts[-1]]:
        AP.append(t.filter(cut), path)
    rows = AP.read(spark, path, "bars")
    return day(rows.select("symbol", "session_date", "bar_no", "close", "start_ind", "next_ind", *((F.round(c, 6) + 0.0).alias(c) for c in ("std", "atr")), "u", "d", "flag", "last1", "last5"))


@query("uncommitted", f"with {S.BARS5} select symbol, {DAY}, case when session_date = date '{_HALF}' then count(*) filter (bar_no % 2 = 0) else count(*) end as stored, case when session_date = date '{_HALF}' then count(*) else 0 end as recorded from bars where session_date >= date '{_HALF}' group by symbol, session_date having case when session_date = date '{_HALF}' then count(*) filter (bar_no % 2 = 0) else count(*) end > 0")
def uncommitted_q(spark, d):
    """After a full append with its record, one session is written again by half and newer ones without a record, as a cut-off run leaves them."""
    b, path = bars5(spark, d).select("symbol", "session_date", "bar_no", "close"), shared_folder(spark, "commits")
    half = F.lit(_HALF).cast("date")
    ST.record_commit(ST.append_sessions(b.filter(F.col("session_date") <= half), path), path)
    ST.append_sessions(b.filter((F.col("session_date") > half) | ((F.col("session_date") == half) & (F.col("bar_no") % 2 == 0))), path)
    return day(ST.uncommitted(spark, path))


@query("resume_appends", f"with {S.BARS5}, days as (select unnest(generate_series(date '2024-01-06', date '2024-02-09', interval 1 day))::date as session_date), w as (select session_date from days where dayofweek(session_date) between 1 and 5 and session_date not in (date '2024-01-15')), have as (select distinct session_date from bars), gap as (select coalesce(min(session_date), date '2999-01-01') as first from w where session_date not in (select session_date from have)), last as (select max(session_date) as last from have) select symbol, {DAY}, count(*) as n from bars, gap, last where session_date > date '2024-01-05' and session_date < first and session_date < last group by symbol, session_date")
def resume_appends_q(spark, d):
    """What a run may append after 5 January: sessions up to the first missing weekday that is no holiday, without the one still open."""
    b = bars5(spark, d)
    last = b.agg(F.max("session_date").alias("open_from"))
    ready = ST.appendable(b, after="2024-01-05", until="2024-02-09", holidays=holidays(spark, ["2024-01-15"]), open_from=last)
    return day(ready.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n")))


@query("feature_sink", f"with {S.RSI}, b as (select *, row_number() over ({S.W}) - 1 as r from rsi), f as (select symbol, session_date, first(sma_rsi order by bar_no) is not null as ready from b group by symbol, session_date) select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, bar_no, close, round(sma_rsi, 6) + 0 as sma_rsi from b join f using (symbol, session_date) where ready and b.session_date between date '2024-01-03' and date '2024-01-24'")
def feature_sink_q(spark, d):
    """The feature table written by session and read back as training rows: columns and dates by pushdown, burned in, order checked."""
    path = shared_folder(spark, "features")
    features = B.pointers(I.sma_rsi(bars5(spark, d)))
    FT.write_features(features, path)
    rows = FT.read_features(spark, path, ["close", "sma_rsi"], start="2024-01-03", end="2024-01-24", ready="sma_rsi")
    return day(rows.select("symbol", "session_date", "bar_no", "close", (F.round("sma_rsi", 6) + 0.0).alias("sma_rsi")))


_STREAM = "select symbol, epoch_us(start)::bigint // 1000000 as start, open, high, low, close, volume, n from (select event_type as symbol, time_bucket(interval '{0}', ts + interval 1 hour) as start, arg_min(k, event_id) as open, max(k) as high, min(k) as low, arg_max(k, event_id) as close, cast(sum(1 + user_id % 9) as bigint) as volume, count(*) as n from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1, 2) where start + interval '{0}' <= (select max(ts) + interval 1 hour - interval 10 minute from events)"


#: Steps of the test stream; three micro-batches, so state is carried.
STREAM_STEPS, STREAM_BATCHES = 6, 3


def _stream_source(spark, d):
    """The stream's folder: the events in event order, in files that micro-batches take a few at a time."""
    folder = shared_folder(spark, "stream-in")
    files = -(-parts(spark, f"{d}/events.parquet") // STREAM_STEPS)
    ST.write_in_order(spark.read.parquet(f"{d}/events.parquet"), folder, "event_id", STREAM_STEPS, files)
    return ST.trade_stream(spark, folder, files_per_batch=files * STREAM_STEPS // STREAM_BATCHES)


@query("stream_bars", _STREAM.format("1 hour"))
def stream_bars_q(spark, d):
    out = ST.run_to_end(ST.tumbling(ST.deduplicated(_stream_source(spark, d)), "1 hour", late=None), shared_folder(spark, "stream-bars"))
    return out.withColumn("start", F.unix_seconds("start"))


@query("stream_day_bars", _STREAM.format("1 day"))
def stream_day_bars_q(spark, d):
    out = ST.run_to_end(ST.tumbling(_stream_source(spark, d), "1 day"), shared_folder(spark, "stream-days"))
    return out.withColumn("start", F.unix_seconds("start"))


_TURNS = """with recursive t as (select event_type as symbol, event_id, cast(json_extract_string(props, '$.k') as double) as price, row_number() over (partition by event_type order by event_id) as i from events),
z as (select symbol, event_id, i, false as rising, price as level, null::double as hit, 0 as turn from t where i = 1
  union all
  select t.symbol, t.event_id, t.i, case when f then not z.rising else z.rising end, case when f then t.price when z.rising then greatest(z.level, t.price) else least(z.level, t.price) end, case when f then z.level end, z.turn + f::int
  from z join (select * from t) t on t.symbol = z.symbol and t.i = z.i + 1, lateral (select case when z.rising then z.level - t.price > 40 else t.price - z.level > 40 end as f))
select symbol, event_id, hit as level, cast(turn as bigint) as turn from z where hit is not null"""


@query("stream_ud", _TURNS)
def stream_ud_q(spark, d):
    return ST.run_to_end(ST.zigzag(_stream_source(spark, d)), shared_folder(spark, "stream-ud"))


def _closed_sql(name: str, seconds: int) -> str:
    return f"""select '{name}' as freq, symbol, start, arg_min(k, event_id) as open, max(k) as high, min(k) as low, arg_max(k, event_id) as close, cast(sum(1 + user_id % 9) as bigint) as volume, count(*) as n
  from (select *, second // {seconds} * {seconds} as start from e) group by symbol, start having start + {seconds} <= (select max(second) - 600 from e)"""


_STREAM_ALL = "with e as (select event_type as symbol, event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts + interval 1 hour) // 1000000 as second from events) " + " union all ".join(_closed_sql(n, s) for n, s in B.SIZES.items())


@query("stream_all_sizes", _STREAM_ALL)
def stream_all_sizes_q(spark, d):
    """Ten sizes from one stream in three micro-batches: each closed bar feeds the next larger size."""
    out, _ = SZ.run(_stream_source(spark, d), shared_folder(spark, "stream-sizes"))
    return out.select("freq", "symbol", "start", "open", "high", "low", "close", "volume", "n")


@query("stream_late", "with e as (select event_type as symbol, event_id, epoch_us(ts + interval 1 hour) // 1000000 as second from events), m as (select max(second) as m from e where event_id % 10 <> 0) select symbol, event_id from e, m where event_id % 10 = 0 and second + 1 <= m - 600")
def stream_late_q(spark, d):
    """Every tenth trade is delivered behind all the others: those whose second has closed are kept apart, the rest still count."""
    folder = shared_folder(spark, "late-in")
    events = spark.read.parquet(f"{d}/events.parquet")
    files = parts(spark, f"{d}/events.parquet")
    for part in (F.col("event_id") % 10 != 0, F.col("event_id") % 10 == 0):
        ST.write_files(events.filter(part).repartition(files), folder, files)
    out = shared_folder(spark, "late-out")
    _, late = SZ.run(ST.trade_stream(spark, folder, files_per_batch=files), out, sizes={"1s": 1, "1": 60})
    return late.select("symbol", "event_id")


def _cycle_stream(spark, d):
    """Sided bars as a stream that is stopped after the first files and taken up again from its checkpoint."""
    folder, out = shared_folder(spark, "cycles-in"), shared_folder(spark, "cycles-out")
    at = F.unix_date("session_date").cast("long") * 86400 + F.col("bar_no") * 300
    bars = stored(_sided(spark, d).select("symbol", "session_date", "bar_no", *(F.col(c).cast("long").alias(c) for c in ("high", "low", "close")), F.col("side").cast("int").alias("side"), at.alias("at")), "cycle-bars")
    middle = bars.agg(F.expr("percentile_approx(at, 0.4)")).first()[0]
    files = -(-parts(spark, f"{d}/events.parquet") // 4)
    for part in (F.col("at") <= middle, F.col("at") > middle):
        ST.write_in_order(bars.filter(part), folder, "at", 2, files)
        rows = ST.run_to_end(CY.cycles(CY.bar_stream(spark, folder, files_per_batch=files), STOP, TICK_USD), out)
    return rows


@query("stream_cycles", f"with recursive {_CYCLES} select symbol, {DAY}, bar_no, cycle, exited::int as exited, realised + 0 as realised, floating + 0 as floating from z")
def stream_cycles_q(spark, d):
    """The trailing cycles of a stream of bars, stopped and restarted: those of the whole table."""
    rows = _cycle_stream(spark, d).filter("kind = 'bar'")
    return day(rows.select("symbol", "session_date", "bar_no", "cycle", F.col("exited").cast("int").alias("exited"), (F.col("realised") + 0.0).alias("realised"), (F.col("floating") + 0.0).alias("floating")))


@query("stream_cycle_totals", f"with recursive {_CYCLES} select symbol, {DAY}, max(cycle) as cycles, count(*) filter (exited) as ended, sum(realised) + 0 as total_usd from z group by symbol, session_date having epoch(session_date)::bigint + 82800 <= (select max(epoch(session_date)::bigint + bar_no * 300) from z) - 600")
def stream_cycle_totals_q(spark, d):
    """What the timer at a session's end gives: cycles, those that ended, and the realised total of each session that has closed."""
    rows = _cycle_stream(spark, d).filter("kind = 'end'")
    return day(rows.select("symbol", "session_date", F.col("cycle").alias("cycles"), "ended", (F.col("realised") + 0.0).alias("total_usd")))
