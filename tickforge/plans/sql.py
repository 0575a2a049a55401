"""Building blocks of the DuckDB oracles: the same tables, derived in SQL on their own."""

from __future__ import annotations

TRADES = """t0 as (
  select event_id as arrival_id, event_type as symbol, ts as ts_utc, ts + interval 1 hour as ts_clock, cast(ts + interval 1 hour as date) as session_date,
         cast(json_extract_string(props, '$.k') as int) as k, cast(1 + user_id % 9 as bigint) as size, 17001 + length(event_type) % 5 as instrument_id
  from events
), trades as (
  select *, cast(20000 + sum(k % 5 - 2) over (partition by symbol, session_date order by arrival_id) as bigint) as price_ticks,
         cast(epoch_us(ts_clock) // 1000000 as bigint) % 86400 as sod
  from t0
)"""

TICKS = TRADES + """, ticks as (
  select symbol, session_date, date_trunc('second', ts_clock) as ts_clock, price_ticks as price, cast(sum(size) as bigint) as volume, min(arrival_id) as arrival_id, min(instrument_id) as instrument_id, min(sod) as sod,
         row_number() over (partition by symbol, session_date order by min(arrival_id)) - 1 as tick_no
  from (select *, unnest(range(0, 1 + k % 3)) as fill from trades where sod < 82800) x group by symbol, session_date, x.ts_clock, price_ticks
)"""


def bars(seconds: int, name: str = "bars", row: bool = True) -> str:
    rows = ", row_number() over (partition by symbol order by session_date, bar_no) - 1 as row" if row else ""
    return f"""{name} as (
  select *{rows} from (
    select symbol, session_date, sod // {seconds} as bar_no, arg_min(price, tick_no) as open, max(price) as high, min(price) as low, arg_max(price, tick_no) as close,
           cast(sum(volume) as bigint) as volume, count(*) as n_ticks, min(tick_no) as start_tick, max(tick_no) as last_tick,
           arg_min(tick_no, -price * 10000000 + tick_no) as hi_tick, arg_min(tick_no, price * 10000000 + tick_no) as lo_tick
    from ticks group by symbol, session_date, sod // {seconds})
)"""


BARS5 = TICKS + ", " + bars(300)
W = "partition by symbol order by row"

RSI_OF_BARS = f""", chg as (select *, close - lag(close) over ({W}) as c from bars),
rsi0 as (select *, avg(greatest(c, 0)) filter (c is not null) over ({W} rows 13 preceding) as u, avg(greatest(-c, 0)) filter (c is not null) over ({W} rows 13 preceding) as d,
         count(c) over ({W} rows 13 preceding) as nc from chg),
rsi as (select *, case when nc = 14 then -((case when d = 0 then 100 else 100 - 100 / (1 + u / nullif(d, 0)) end) / 100 * 2 - 1) end as sma_rsi from rsi0)"""
RSI = BARS5 + RSI_OF_BARS
#: The same over 60-minute bars.
RSI60 = TICKS + ", " + bars(3600) + RSI_OF_BARS

#: The strategy of the backtest queries: long above 0.2, short below -0.2.
SIDES = RSI + """, sided as (select *, case when sma_rsi > 0.2 then 1 when sma_rsi < -0.2 then -1 else 0 end as side from rsi),
ends as (select *, min(case when (bar_no + 1) * 5 > 1320 then row end) over (partition by symbol, session_date) as flat from sided),
stops as (select *, coalesce(flat, max(row) over (partition by symbol, session_date) + 1) as stop from ends),
turned as (
  select *, side <> coalesce(lag(side) over (partition by symbol, session_date order by row), 0) as start,
         coalesce(case when side = 1 then min(case when side = -1 then row end) over w else min(case when side = 1 then row end) over w end, count(*) over (partition by symbol)) as change,
         lead(open) over (partition by symbol order by row) as entry_px
  from stops window w as (partition by symbol order by row rows between 1 following and unbounded following)
), sig as (select * from turned where side <> 0 and start and row + 1 < stop)"""

GRID = ((6, 6), (6, 12), (12, 6), (12, 12))

#: Exits by a scan of the ticks themselves, without bars' extremes.
EXITS = SIDES + ", grid(tp, sl) as (values " + ", ".join(f"({a}::double, {b}::double)" for a, b in GRID) + """), s as (
  select sig.*, tp, sl, cast(tp as int) || '/' || cast(sl as int) as stops, row + 1 as entry_row, least(stop, change + 1) as until,
         entry_px + case when side = 1 then tp else sl end as upper, entry_px - case when side = 1 then sl else tp end as lower
  from sig, grid
), tb as (select t.symbol, t.session_date, t.tick_no, t.price, b.row as b_row from ticks t join bars b on t.symbol = b.symbol and t.session_date = b.session_date and t.sod // 300 = b.bar_no),
h as (
  select s.symbol, s.row, s.stops, arg_min(case when price >= upper then 1 else -1 end, tick_no) as hit, arg_min(b_row, tick_no) as hit_row
  from s join tb on s.symbol = tb.symbol and s.session_date = tb.session_date and b_row >= entry_row and b_row < until and (price >= upper or price <= lower)
  group by s.symbol, s.row, s.stops
), x as (
  select s.*, coalesce(hit, 0) as hit, coalesce(hit_row, until - 1) as bar_row, hit is null and until < stop as changed
  from s left join h on s.symbol = h.symbol and s.row = h.row and s.stops = h.stops
), exits as (
  select x.symbol, x.session_date, x.stops, x.row, x.side, x.tp, x.sl, x.entry_row, x.entry_px,
         case when x.hit = 0 and not changed and x.flat is not null then x.flat else bar_row end as exit_row,
         case when changed then bar_row + 1 when x.hit = 0 and x.flat is not null then x.flat else bar_row end as exit_ts_row,
         cast(case when x.hit = 1 then upper when x.hit = -1 then lower when changed then nb.open when x.flat is not null then fb.open else lb.close end as bigint) as exit_px,
         case when changed then 2 else x.hit * x.side end as result
  from x join bars lb on lb.symbol = x.symbol and lb.row = x.bar_row
  left join bars nb on nb.symbol = x.symbol and nb.row = x.until left join bars fb on fb.symbol = x.symbol and fb.row = x.flat
), trades_all as (select *, side * (exit_px - entry_px) as pnl from exits)"""

#: One position at a time, by recursion over each session's trades.
KEPT = EXITS.replace("with ", "") + """, numbered as (
  select *, row_number() over (partition by symbol, stops, session_date order by row) as i from trades_all
), walk as (
  select symbol, stops, session_date, i, row, exit_row as free, true as kept from numbered where i = 1
  union all
  select n.symbol, n.stops, n.session_date, n.i, n.row, case when n.row >= w.free then n.exit_row else w.free end, n.row >= w.free
  from walk w join numbered n on n.symbol = w.symbol and n.stops = w.stops and n.session_date = w.session_date and n.i = w.i + 1
), kept as (
  select n.* exclude (i) from numbered n join walk w on n.symbol = w.symbol and n.stops = w.stops and n.session_date = w.session_date and n.i = w.i where w.kept
), run as (
  select *, pnl * 12.5 as gross_usd, pnl * 12.5 - case when result = 1 then 1 else 2 end * 12.5 - 4 as net_usd from kept
), days as (select distinct session_date from bars)"""

DAILY = KEPT + """, daily0 as (
  select r.symbol, r.stops, d.session_date, count(k.row) as trades, cast(count(*) filter (k.net_usd > 0) as bigint) as wins,
         coalesce(sum(k.gross_usd), 0) as gross_usd, coalesce(sum(k.net_usd), 0) as net_usd
  from (select distinct symbol, stops from run) r cross join days d left join run k on k.symbol = r.symbol and k.stops = r.stops and k.session_date = d.session_date
  group by r.symbol, r.stops, d.session_date
), daily1 as (
  select *, sum(gross_usd) over w as cum_gross_usd, sum(net_usd) over w as cum_net_usd from daily0 window w as (partition by symbol, stops order by session_date)
), daily as (
  select *, cum_net_usd - greatest(max(cum_net_usd) over (partition by symbol, stops order by session_date), 0) as drawdown_usd from daily1
)"""
