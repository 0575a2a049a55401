"""Queries over trailing trade cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sql as S
from .backtests import _sided
from .market import DAY, day
from .registry import query

#: Ticks from the watermark to the stop, and dollars a tick (5 a point).
STOP, TICK_USD = 6, 1.25
GROUP = ["symbol", "session_date"]

_CYCLES = f"""{S.SIDES}, b as (select symbol, session_date, bar_no, high, low, close, side as target, row_number() over (partition by symbol, session_date order by bar_no) as i from sided),
z as (
  select symbol, session_date, bar_no, i, target as side, close as entry, close as mark, cast(target <> 0 as int) as cycle, false as exited, 0::double as realised, 0::double as floating from b where i = 1
  union all
  select symbol, session_date, bar_no, i, case when held = 0 or hit then target else held end, case when held = 0 or hit then close else entry end, case when held = 0 or hit then close else reach end,
         cycle + cast((held = 0 or hit) and target <> 0 as int), hit, case when hit then {TICK_USD} * held * (reach - held * {STOP} - entry) else 0 end::double, case when held <> 0 and not hit then {TICK_USD} * held * (close - entry) else 0 end::double
  from (select *, case when held = 1 then reach - low >= {STOP} when held = -1 then high - reach >= {STOP} else false end as hit
        from (select b.*, z.side as held, z.entry, z.cycle, case when z.side = 1 then greatest(z.mark, b.high) when z.side = -1 then least(z.mark, b.low) else z.mark end as reach
              from z join b on b.symbol = z.symbol and b.session_date = z.session_date and b.i = z.i + 1))
)"""


def _cycles(spark, d):
    """Each bar's cycle state: cycle number, whether it ended here, realised and floating profit.

    A cycle starts at the close of a bar with a side and ends where price comes
    back by the stop from its best level; if the side holds, the next starts at
    that bar's close. The fold runs over one session of one symbol (276 bars at
    most). Sessions without a side have cycle 0 throughout.
    """
    bar = F.struct("bar_no", *(F.col(c).cast("long").alias(c) for c in ("high", "low", "close")), F.col("side").cast("int").alias("side"))
    sessions = _sided(spark, d).groupBy(*GROUP).agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    zero = F.lit(0).cast("long")
    state = "array<struct<bar_no:bigint,cycle:int,exited:boolean,realised:double,floating:double>>"
    start = F.struct(F.lit(0).alias("side"), zero.alias("entry"), zero.alias("mark"), F.lit(0).alias("cycle"), F.array().cast(state).alias("out"))

    def step(s, b):
        held, entry = s["side"], s["entry"]
        reach = F.when(held == 1, F.greatest(s["mark"], b["high"])).when(held == -1, F.least(s["mark"], b["low"])).otherwise(s["mark"])
        hit = F.when(held == 1, reach - b["low"] >= STOP).when(held == -1, b["high"] - reach >= STOP).otherwise(False)
        free = (held == 0) | hit
        cycle = s["cycle"] + (free & (b["side"] != 0)).cast("int")
        realised = F.when(hit, TICK_USD * held * (reach - held * STOP - entry)).otherwise(0.0)
        floating = F.when((held != 0) & ~hit, TICK_USD * held * (b["close"] - entry)).otherwise(0.0)
        row = F.struct(b["bar_no"].alias("bar_no"), cycle.alias("cycle"), hit.alias("exited"), realised.alias("realised"), floating.alias("floating"))
        return F.struct(
            F.when(free, b["side"]).otherwise(held).alias("side"), F.when(free, b["close"]).otherwise(entry).alias("entry"), F.when(free, b["close"]).otherwise(reach).alias("mark"),
            cycle.alias("cycle"), F.array_append(s["out"], row).alias("out"))

    return sessions.select(*GROUP, F.inline(F.aggregate("bars", start, step, lambda s: s["out"])))


@query("trailing_cycles", f"with recursive {_CYCLES} select symbol, {DAY}, bar_no, cycle, exited::int as exited, realised + 0 as realised, floating + 0 as floating from z")
def trailing_cycles_q(spark, d):
    c = _cycles(spark, d)
    return day(c.select(*GROUP, "bar_no", "cycle", F.col("exited").cast("int").alias("exited"), (F.col("realised") + 0.0).alias("realised"), (F.col("floating") + 0.0).alias("floating")))


@query("counterfactual", f"with recursive {_CYCLES} select symbol, {DAY}, max(cycle) as cycles, count(*) filter (exited) as ended, sum(realised) + 0 as total_usd from z group by symbol, session_date")
def counterfactual_q(spark, d):
    """What a session's cycles would have earned: their number, how many ended, and the realised total."""
    g = _cycles(spark, d).groupBy(*GROUP)
    return day(g.agg(F.max("cycle").alias("cycles"), F.count(F.when(F.col("exited"), 1)).alias("ended"), (F.sum("realised") + 0.0).alias("total_usd")))
