"""Queries over labels, chunks and variant scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickforge.functions.folders import stored
from tickforge.operators import bars as B
from tickforge.operators import indicators as I
from tickforge.operators import scores as SC
from tickforge.operators import stats as ST
from tickforge.operators import trading as X

from . import sql as S
from .backtests import _run
from .market import _RECURSE, DAY, KEY, bars5, day, ticks
from .registry import query

W = S.W
HALF = "partition by symbol, session_date, bar_no // 144 order by bar_no"


_DIRECTION = f"""with recursive {S.BARS5}, m as (
  select *, (max(close) over ({HALF} rows between current row and 59 following) - open) - (open - min(close) over ({HALF} rows between current row and 59 following)) as t,
         row_number() over ({HALF}) as i, count(*) over (partition by symbol, session_date, bar_no // 144) as n from bars
), s as (select *, case when i = n then 0 when t > 4 then 1 when t < -4 then -1 else 0 end as d0 from m),
r as (select symbol, session_date, bar_no, bar_no // 144 as half, i, 0 as d from s where i = 1
  union all select s.symbol, s.session_date, s.bar_no, s.bar_no // 144, s.i, case when r.d = -1 and s.t <= 0 then -1 when r.d = 1 and s.t >= 0 then 1 else s.d0 end
  from r join s on s.symbol = r.symbol and s.session_date = r.session_date and s.bar_no // 144 = r.half and s.i = r.i + 1)"""


@query("direction_label", f"{_DIRECTION} select symbol, {DAY}, bar_no, d as direction from r")
def direction_label_q(spark, d):
    return day(_directed(spark, d).select(*KEY, "direction"))


def _directed(spark, d):
    b = bars5(spark, d).withColumn("half", F.floor(F.col("bar_no") / 144))
    return SC.direction_labels(b, expected=4)


@query("holding_runs", f"""{_DIRECTION}, x as (select b.symbol, b.session_date, b.bar_no, b.bar_no // 144 as half, b.row, open, close, d, open - lead(open) over (partition by b.symbol order by b.row) as diff, d is distinct from lag(d) over (partition by b.symbol order by b.row) as new from bars b join r on b.symbol = r.symbol and b.session_date = r.session_date and b.bar_no = r.bar_no),
g as (select *, sum(new::int) over (partition by symbol order by row) as run from x), p as (select symbol, d, run, session_date, half, count(*) as n, sum(diff) as diff, arg_min(open, row) as b, max(close) as c, min(close) as e from g group by all),
q as (select *, greatest(c - b, b - e) - 2 * least(c - b, b - e) + abs(coalesce(diff, 0)) as flat from p), f as (select symbol, d <> 0 as has, avg(flat) as flat_reward from q group by 1, 2), u as (select symbol, d, run, sum(n) as n, coalesce(sum(diff), 0) as diff from p group by all)
select u.symbol, d as direction, count(*) as runs, round(avg(n), 6) as mean_length, case when d <> 0 then round(avg(-d * u.diff), 6) + 0 end as mean_reward, case when d <> 0 then sum(-d * u.diff)::bigint end as reward, round(any_value(flat_reward), 6) as flat_reward
from u join f on f.symbol = u.symbol and f.has = (d <> 0) group by u.symbol, d""")
def holding_runs_q(spark, d):
    """Runs of the direction label: how many, how long, what they make from open to next open, and what a flat stance would."""
    labelled = stored(_directed(spark, d), "directions")
    bars = bars5(spark, d).withColumn("half", F.floor(F.col("bar_no") / 144))
    out = SC.holding_runs(bars.join(labelled.select(*KEY, "direction"), KEY))
    return out.select("symbol", "direction", "runs", F.round("mean_length", 6).alias("mean_length"), (F.round("mean_reward", 6) + 0.0).alias("mean_reward"), "reward", F.round("flat_reward", 6).alias("flat_reward"))


@query("episodes", f"""with recursive {S.BARS5}, d as (select symbol, session_date, count(*) as n, min(row) as a, max(row) as b, row_number() over (partition by symbol order by session_date) as i from bars group by symbol, session_date having count(*) > 5),
e as (select symbol, i, n as held, 0 as ep from d where i = 1 union all select d.symbol, d.i, case when e.held >= 60 then d.n else e.held + d.n end, case when e.held >= 60 then e.ep + 1 else e.ep end from e join d on d.symbol = e.symbol and d.i = e.i + 1),
p as (select symbol, ep, greatest(min(a) - 60, 0) as first_row, max(b) as last_row, count(*) as days from e join d using (symbol, i) group by symbol, ep),
q as (select symbol, ep, first_row, least(last_row, first_row + 399) as last_row, days from p where last_row - first_row + 1 >= 100), r as (select *, row_number() over (partition by symbol order by ep) - 1 as episode, row_number() over (partition by symbol order by ep desc) as back from q)
select symbol, episode::int as episode, first_row, last_row, last_row - first_row + 1 as rows, days, case when back <= 3 then 'test' when back <= 6 then 'validation' else 'train' end as split from r""")
def episodes_q(spark, d):
    """Days of more than five bars, packed greedily until an episode holds 60 bars, with 60 rows of lead-in, of 100 to 400 rows, the last six held out."""
    days = X.rows(bars5(spark, d)).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("a"), F.max("row").alias("b")).filter("n > 5")
    return SC.episodes(days, 60, min_steps=100, max_steps=400)


_RTH = "(bar_no * 300 >= 55800 and bar_no * 300 < 79200)"
_SMAS = ", ".join(f"last_value(m{n} ignore nulls) over ({W}) as sma_{n}_day, case when count(*) over ({W} rows {n - 1} preceding) = {n} then avg(close) over ({W} rows {n - 1} preceding) end as sma_{n}_all" for n in (20, 50, 100))
_SMA_NAMES = [f"sma_{n}_{k}" for n in (20, 50, 100) for k in ("day", "all")]


@query("sma_targets", f"with {S.BARS5}, o as (select symbol, row, " + ", ".join(f"case when count(*) over (partition by symbol order by row rows {n - 1} preceding) = {n} then avg(close) over (partition by symbol order by row rows {n - 1} preceding) end as m{n}" for n in (20, 50, 100)) + f" from bars where not {_RTH}), j as (select b.*, m20, m50, m100 from bars b left join o using (symbol, row)), k as (select symbol, session_date, bar_no, {_SMAS} from j) select symbol, {DAY}, bar_no, " + ", ".join(f"round({c}, 6) as {c}" for c in _SMA_NAMES) + ", cast(" + " and ".join(f"{c} is not null" for c in _SMA_NAMES) + " as int) as whole from k")
def sma_targets_q(spark, d):
    """Means over the bars outside regular hours, carried forward, and over all bars."""
    second = F.col("bar_no") * 300
    b = bars5(spark, d).withColumn("rth", ((second >= 55800) & (second < 79200)).cast("int"))
    return day(I.sma_targets(b).select(*KEY, *(F.round(c, 6).alias(c) for c in _SMA_NAMES), F.col("targets").isNotNull().cast("int").alias("whole")))


@query("ema_std", "with recursive " + S.BARS5 + _RECURSE.format(x="close - 20000", first="x", step="e.s * (1 - 2 / 29.0::double) + t.x", a="2 / 29.0::double") + """, e2 as (
  select symbol, row, cast(x * x as double) as s from tr where row = 0 union all select t.symbol, t.row, e2.s * (1 - 2 / 29.0::double) + t.x * t.x from e2 join tr t on t.symbol = e2.symbol and t.row = e2.row + 1)
select b.symbol, strftime(b.session_date, '%Y-%m-%d') as session_date, b.bar_no, round(sqrt(greatest(e2.s / e.w - pow(e.s / e.w, 2), 0)), 4) + 0 as std from e join e2 using (symbol, row) join bars b using (symbol, row)""")
def ema_std_q(spark, d):
    b = bars5(spark, d).withColumn("_x", (F.col("close") - 20000).cast("double")).withColumn("_xx", F.col("_x") * F.col("_x"))
    b = I.ewm(I.ewm(b, "_x", "_m", 2 / 29, adjust=True), "_xx", "_q", 2 / 29, adjust=True)
    return day(b.select(*KEY, (F.round(F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))), 4) + 0.0).alias("std")))


@query("run_grid", f"with recursive {S.KEPT} select stops, tp, sl, count(*) as trades, sum(net_usd)::double as net_usd from run group by stops, tp, sl")
def run_grid_q(spark, d):
    """Every pair of levels over the same signals, in one plan."""
    return _run(spark, d).groupBy("stops", "tp", "sl").agg(F.count(F.lit(1)).alias("trades"), F.sum("net_usd").alias("net_usd"))


@query("burn_in_legacy", f"with {S.BARS5} select symbol, {DAY}, bar_no from (select *, max(row) over (partition by symbol) as z from bars) where row >= 19 and row < z")
def burn_in_legacy_q(spark, d):
    """Rows from the first full window on, without the last row."""
    b = X.rows(I.sma(bars5(spark, d)))
    own = Window.partitionBy("symbol")
    b = b.withColumns({"_a": F.min(F.when(F.col("20_sma").isNotNull(), F.col("row"))).over(own), "_z": F.max("row").over(own)})
    return day(b.filter("row >= _a and row < _z").select(*KEY))


#: Levels of the 72 variants of a family, and what the families are trusted.
LEVELS = tuple(i / 100 for i in range(1, 73))
CONFIDENCE = {"long": 0.5, "short": 0.3}
_V = "partition by symbol, fam, variant"
_BOARD = f"""{S.RSI60}, lv as (select i::int as variant, i / 100.0::double as level from range(1, 73) t(i)), f as (
  select symbol, session_date, bar_no, row, close, fam, variant, case when fam = 'long' and sma_rsi > level then 1 when fam = 'short' and sma_rsi < -level then -1 else 0 end as side
  from rsi, lv, (values ('long'), ('short')) t(fam)
), p0 as (select *, coalesce(lead(side) over ({_V} order by row), 0) as position from f),
p1 as (select *, coalesce(lag(position) over ({_V} order by row), 0) as before from p0),
p2 as (select *, sum((position <> before)::int) over ({_V} order by row) as stretch from p1),
p3 as (select *, first_value(close) over ({_V}, stretch order by row) as entry from p2),
p4 as (select *, case when position <> before and before <> 0 then (close - lag(entry) over ({_V} order by row)) * before * 12.5::double - 29 end as closed from p3),
tr as (select symbol, fam, variant, row, row_number() over ({_V} order by row) as n, list(closed) over ({_V} order by row rows 99 preceding) as xs from p4 where closed is not null),
w as (select *, list_transform(xs, lambda x, k: pow(199 / 201.0::double, len(xs) - k)) as ws from tr),
mu as (select *, list_sum(ws) as sw, list_sum(list_transform(xs, lambda x, k: x * ws[k])) / list_sum(ws) as mu, case when n >= 2 then least(n / 30.0::double, 1) else 0 end as sure from w),
sg as (select *, sqrt(list_sum(list_transform(xs, lambda x, k: (x - mu) * (x - mu) * ws[k])) / sw) as sigma, list_sum(list_transform(xs, lambda x, k: case when x > 0 then ws[k] else 0 end)) / sw as win from mu),
board as (select p4.symbol, p4.fam, p4.variant, session_date, bar_no, p4.row, position, case when position <> 0 then ((close - entry) * position * 12.5::double - 29) / 320 else 0 end as floating,
  coalesce(case when sigma > 1e-8 then mu / sigma else 0 end * sure, 0) as sharpe, coalesce(win * sure, 0) as win_rate, coalesce(mu / 320 * sure, 0) as realised
  from p4 asof left join sg on p4.symbol = sg.symbol and p4.fam = sg.fam and p4.variant = sg.variant and p4.row >= sg.row)"""


def _board(spark, d):
    """The scoreboard of 60-minute bars, written once: it is ranked and averaged several times."""
    b = X.rows(I.sma_rsi(B.bars(ticks(spark, d), 3600)))
    return stored(SC.variant_scores(SC.threshold_variants(b, LEVELS)), "variant-scores")


@query("variant_scores", f"with {_BOARD} select symbol, {DAY}, bar_no, fam, variant, position, round(floating, 8) + 0 as floating, round(sharpe, 8) + 0 as sharpe, round(win_rate, 8) + 0 as win_rate, round(realised, 8) + 0 as realised from board")
def variant_scores_q(spark, d):
    out = _board(spark, d)
    return day(out.select(*KEY, "fam", "variant", "position", *((F.round(c, 8) + 0.0).alias(c) for c in ("floating", "sharpe", "win_rate", "realised"))))


@query("consensus", f"""with {_BOARD}, k as (select *, row_number() over (partition by symbol, row, fam order by round(sharpe, 9) desc, variant) as r from board),
m as (select *, case when round(realised, 9) >= 0.01 then 1 else 0.1 end * case when round(floating, 9) >= 0 then 1 else 0.5 end * case when round(sharpe, 9) >= 0.01 then 1 else 0.7 end::double as k from k where r <= 5),
s as (select symbol, session_date, bar_no, fam, sum(position * k) / sum(k) as signal from m group by all)
select symbol, {DAY}, bar_no, round(sum(signal * case fam when 'long' then 0.5 else 0.3 end) / 0.8::double, 6) + 0 as consensus from s group by symbol, session_date, bar_no""")
def consensus_q(spark, d):
    return day(SC.consensus(_board(spark, d), CONFIDENCE).withColumn("consensus", F.round("consensus", 6) + 0.0))


@query("kalman_rank", f"""with recursive {_BOARD}, g as (select 0::bigint as row, 1.1::double / 2.1 as gain, 1.1::double / 2.1 as var
  union all select row + 1, (var + 0.1) / (var + 1.1), (var + 0.1) / (var + 1.1) from g where row < (select max(row) from bars)),
z as (select symbol, fam, variant, session_date, bar_no, board.row, gain * sharpe as mean, var from board join g on g.row = 0 and board.row = 0
  union all select b.symbol, b.fam, b.variant, b.session_date, b.bar_no, b.row, z.mean + g.gain * (b.sharpe - z.mean), g.var from z join board b on b.symbol = z.symbol and b.fam = z.fam and b.variant = z.variant and b.row = z.row + 1 join g on g.row = b.row),
k as (select *, mean / sqrt(var + 1e-8) as score from z), r as (select *, row_number() over (partition by symbol, row, fam order by round(score, 9) desc, variant) as place from k)
select symbol, {DAY}, bar_no, fam, variant, place, round(score, 6) + 0 as score from r where place <= 5""")
def kalman_rank_q(spark, d):
    return day(SC.kalman_rank(_board(spark, d)).select(*KEY, "fam", "variant", F.col("place").cast("long").alias("place"), (F.round("score", 6) + 0.0).alias("score")))


_BACK = lambda c, k: f"coalesce(lag({c}, {k}) over (partition by symbol, fam order by row), 0)"
_CLIP = lambda x, n: f"round(greatest(least({x}, 3), -3), 8) + 0 as {n}"
_REGIME = f"""with {_BOARD}, {S.bars(60, 'one', False)}, vol as (select b.symbol, b.row, avg((o.high - o.low)::double) as vol from bars b join one o on o.symbol = b.symbol and o.session_date = b.session_date and o.bar_no // 60 = b.bar_no group by 1, 2),
m as (select symbol, session_date, bar_no, row, fam, avg(realised) as m, avg(sharpe) as s from board group by all), j as (select m.*, vol from m join vol using (symbol, row))
select symbol, {DAY}, bar_no, fam, {', '.join(_CLIP(f"m - {_BACK('m', h)}", f'd{h}') for h in SC.HORIZONS)},
 {_CLIP('(s * 9.5 + ' + ' + '.join(f"{_BACK('s', k)} * {9.5 - k}::double" for k in range(1, 20)) + ') / 665', 'slope')}, {_CLIP(f"ln((vol + 1e-3) / ({_BACK('vol', 20)} + 1e-3))", 'log_vol')} from j"""


@query("regime", _REGIME)
def regime_q(spark, d):
    one = B.bars(ticks(spark, d), 60).groupBy("symbol", "session_date", F.floor(F.col("bar_no") / 60).alias("bar_no")).agg(F.avg((F.col("high") - F.col("low")).cast("double")).alias("vol"))
    vol = X.rows(one).select("symbol", "row", "vol")
    out = SC.regime(_board(spark, d), vol)
    return day(out.select(*KEY, "fam", *((F.round(c, 8) + 0.0).alias(c) for c in (*(f"d{h}" for h in SC.HORIZONS), "slope", "log_vol"))))


_PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)
_MEASURES = ("floating", "realised", "sharpe")
_PCT = ", ".join(f"round(quantile_cont(x, {q / 100!r}::double), 12) + 0 as p{q:02d}" for q in _PERCENTS)


@query("family_percentiles", f"""with {_BOARD}, m as ({' union all '.join(f"select symbol, fam, '{m}' as measure, position, round({m}, 8) as x from board" for m in _MEASURES)}),
k as (select *, 'all' as who from m union all select *, 'active' from m where position <> 0), t as (select symbol, fam, measure, count(*) as total from m group by all)
select symbol, fam, measure, who, count(*) as n, round(count(*) / any_value(total)::double, 6) as rate, {_PCT} from k join t using (symbol, fam, measure) group by symbol, fam, measure, who""")
def family_percentiles_q(spark, d):
    """Percentiles of each measure over all 72 variants of a family, for all rows and for those in a position."""
    long = F.array(*(F.struct(F.lit(m).alias("measure"), F.round(m, 8).alias("x")) for m in _MEASURES))
    who = F.when(F.col("position") != 0, F.array(F.lit("all"), F.lit("active"))).otherwise(F.array(F.lit("all")))
    rows = _board(spark, d).select("symbol", "fam", "position", F.inline(long)).withColumn("who", F.explode(who))
    out = ST.group_percentiles(rows, ["symbol", "fam", "measure", "who"], "x", _PERCENTS)
    total = F.max("n").over(Window.partitionBy("symbol", "fam", "measure"))
    return out.withColumn("rate", F.round(F.col("n") / total, 6)).withColumns({f"p{q:02d}": F.round(f"p{q:02d}", 12) + 0.0 for q in _PERCENTS})
