"""Scores of bars, of trades and of strategy variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Divisor that brings prices and profits to the order of 1 (fixed value).
NORM = 320.0


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


# Bars


def bar_patterns(df: DataFrame, std: str = "20_std", threshold: float = 0.25, norm: float = NORM) -> DataFrame:
    """Adds bar_score, needle and large_candle.

    bar_score: how much the longer way from the open exceeds twice the shorter
    one, plus the body. needle: 1 minus the ratio of body and far side to the
    wick, positive for a lower wick and negative for an upper one, where the
    wick is longer than the closes' deviation and the ratio below threshold.
    large_candle is 0 for every bar: its rule asks for a value that it has not
    set yet, and no bar meets it.
    """
    up, down = F.col("high") - F.col("open"), F.col("open") - F.col("low")
    score = (F.greatest(up, down) - 2 * F.least(up, down) + F.abs(F.col("close") - F.col("open"))) / F.lit(norm)
    wide = F.round(F.col(std), 9)

    def wick(near: list[Column], far: list[Column]) -> tuple[Column, Column]:
        length = F.greatest(F.least(*near).cast("double"), F.lit(0.01))
        ratio = F.greatest(*far) / length
        return F.coalesce((ratio < threshold) & (length > wide), F.lit(False)), 1 - ratio

    above, below = [up, F.col("high") - F.col("close")], [down, F.col("close") - F.col("low")]
    low, low_size = wick(below, above)
    high, high_size = wick(above, below)
    return df.withColumns({"bar_score": score, "needle": F.when(high, -high_size).when(low, low_size).otherwise(0.0), "large_candle": F.lit(0.0)})


def rsi_stretch(x: Column, clip: float = 0.6128, k: float = 1.6128, small: float = 0.01) -> Column:
    """Stretches (-1, 1) by a power, with a smooth sign near 0, and clips softly at 1 + clip."""
    most = 1 + clip
    sign = F.when(F.abs(x) < small, F.tanh(x / small)).otherwise(F.signum(x))
    return F.when(x.isNotNull(), most * F.tanh(sign * F.pow(F.abs(x) + 1e-8, F.lit(k))))


def direction_labels(df: DataFrame, expected: float, stop: float = 0.0, ahead: int = 60) -> DataFrame:
    """Adds direction: 1 or -1 where the next closes (the bar's own included) promise it, held while not contradicted.

    The promise is what the highest close gains on the open less what the
    lowest loses. df has symbol, session_date, half, bar_no; each half day
    starts anew, and its fold holds a half day's bars.
    """
    group = ["symbol", "session_date", "half"]
    w = Window.partitionBy(*group).orderBy("bar_no")
    frame = w.rowsBetween(0, ahead - 1)
    promise = (F.max("close").over(frame) - F.col("open")) - (F.col("open") - F.min("close").over(frame))
    df = df.withColumns({"_t": promise, "_end": F.lead("bar_no").over(w).isNull()})
    df = df.withColumn("_d", F.when(F.col("_end"), 0).when(F.col("_t") > expected, 1).when(F.col("_t") < -expected, -1).otherwise(0))
    rows = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("bar_no", "_t", "_d"))).alias("rows"))

    def step(a: Column, r: Column) -> Column:
        before = F.get(a, F.size(a) - 1)
        held = F.when((before == -1) & (r["_t"] <= stop), -1).when((before == 1) & (r["_t"] >= stop), 1).otherwise(r["_d"])
        return F.array_append(a, F.when(F.size(a) == 0, F.lit(0)).otherwise(held).cast("int"))

    labelled = rows.withColumn("d", F.aggregate("rows", F.array().cast("array<int>"), step))
    out = labelled.select(*group, F.explode(F.arrays_zip("rows", "d")).alias("e"))
    return out.select(*group, F.col("e.rows.bar_no").alias("bar_no"), F.col("e.d").alias("direction"))


def holding_runs(df: DataFrame) -> DataFrame:
    """symbol, direction, runs, mean_length, mean_reward, reward, flat_reward of the runs of equal direction.

    df: symbol, session_date, half, bar_no, open, close, direction. A run goes
    on over sessions. Its reward is what its direction makes from its first
    open to the next run's (a symbol's last run: to its last open); none for
    direction 0. flat_reward, for each run's part in one half day: the longer
    way of the closes from the first open less twice the shorter, plus the way
    from open to next open in size; its mean over runs without direction, or
    over all that have one.
    """
    h = Window.partitionBy("symbol").orderBy("session_date", "bar_no")
    new = F.col("direction") != F.coalesce(F.lag("direction").over(h), F.lit(9))
    df = df.withColumns({"_diff": F.col("open") - F.lead("open").over(h), "_run": new.cast("int")})
    df = df.withColumn("_run", F.sum("_run").over(h.rowsBetween(Window.unboundedPreceding, 0)))
    first_open = F.min_by("open", F.struct("session_date", "bar_no"))
    parts = df.groupBy("symbol", "direction", "_run", "session_date", "half").agg(F.count(F.lit(1)).alias("_n"), F.sum("_diff").alias("_diff"), first_open.alias("_b"), F.max("close").alias("_c"), F.min("close").alias("_d"))
    up, down = F.col("_c") - F.col("_b"), F.col("_b") - F.col("_d")
    parts = parts.withColumn("_flat", F.greatest(up, down) - 2 * F.least(up, down) + F.abs(F.coalesce("_diff", F.lit(0))))
    has = (F.col("direction") != 0).alias("_has")
    flat = parts.groupBy("symbol", has).agg(F.avg("_flat").alias("flat_reward"))
    runs = parts.groupBy("symbol", "direction", "_run").agg(F.sum("_n").alias("_n"), F.coalesce(F.sum("_diff"), F.lit(0)).alias("_diff"))
    gain = F.when(F.col("direction") != 0, -F.col("direction") * F.col("_diff"))
    out = runs.groupBy("symbol", "direction").agg(F.count(F.lit(1)).alias("runs"), F.avg("_n").alias("mean_length"), F.avg(gain).alias("mean_reward"), F.sum(gain).alias("reward"))
    return out.withColumn("_has", F.col("direction") != 0).join(flat, ["symbol", "_has"]).drop("_has")


def episodes(days: DataFrame, steps: int, min_steps: int = 0, max_steps: int | None = None, lead: int = 60, held_out: int = 3) -> DataFrame:
    """symbol, episode, first_row, last_row, rows, days, split: days packed until an episode holds ``steps`` bars, with rows of lead-in.

    days: symbol, session_date, n, a, b (bars, first and last row). Episodes
    with fewer than min_steps rows (the lead-in counts) are left out, longer
    ones cut at max_steps; of those that stay the last ``held_out`` are for
    tests, as many before them for validation, the rest for training. The fold
    runs over a symbol's days, one number for each session.
    """
    lists = days.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("session_date", "n", "a", "b"))).alias("days"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("ep"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        full = s["held"] >= steps
        ep = F.when(full, s["ep"] + 1).otherwise(s["ep"])
        return F.struct(F.when(full, x["n"]).otherwise(s["held"] + x["n"]).alias("held"), ep.alias("ep"), F.array_append(s["out"], ep).alias("out"))

    packed = lists.withColumn("ep", F.aggregate("days", start, step, lambda s: s["out"]))
    each = packed.select("symbol", F.explode(F.arrays_zip("days", "ep")).alias("e")).select("symbol", F.col("e.ep").alias("_ep"), F.col("e.days.a").alias("a"), F.col("e.days.b").alias("b"))
    out = each.groupBy("symbol", "_ep").agg(F.greatest(F.min("a") - lead, F.lit(0)).alias("first_row"), F.max("b").alias("last_row"), F.count(F.lit(1)).alias("days"))
    out = out.filter(F.col("last_row") - F.col("first_row") + 1 >= min_steps)
    if max_steps is not None:
        out = out.withColumn("last_row", F.least("last_row", F.col("first_row") + max_steps - 1))
    w = Window.partitionBy("symbol")
    back = F.row_number().over(w.orderBy(F.desc("_ep")))
    out = out.withColumns({"_back": back, "episode": F.row_number().over(w.orderBy("_ep")) - 1, "rows": F.col("last_row") - F.col("first_row") + 1})
    split = F.when(F.col("_back") <= held_out, "test").when(F.col("_back") <= 2 * held_out, "validation").otherwise("train")
    return out.select("symbol", "episode", "first_row", "last_row", "rows", "days", split.alias("split"))


# Runs of trades


def _aged(trades: DataFrame, by: list[str], newest_first: list[Column]) -> DataFrame:
    """i: how many trades of the run are newer; n: trades of the run."""
    own = Window.partitionBy(*by)
    return trades.withColumns({"i": F.row_number().over(own.orderBy(*newest_first)) - 1, "n": F.count(F.lit(1)).over(own)})


def ewm_kelly(trades: DataFrame, by: list[str], newest_first: list[Column], pnl: str = "net_usd", span: int = 1000, keep: int = 1000, norm: float = NORM) -> DataFrame:
    """Half-Kelly fraction of each run from weighted mean, downside semi-deviation and win rate of its last trades.

    n_trades, mu, sigma, win_rate, kelly_f, confidence. Below 30 trades all
    are 0 and confidence 0.3; from 100 on confidence is the fraction.
    """
    o = _aged(trades, by, newest_first).filter(F.col("i") < keep)
    w, r = F.pow(F.lit(1 - 2 / (span + 1)), F.col("i")), F.col(pnl) / norm
    s = o.groupBy(*by).agg(
        F.least(F.max("n"), F.lit(keep)).cast("long").alias("n_trades"), F.sum(w).alias("_w"), F.sum(w * r).alias("_x"),
        F.sum(w * F.pow(F.least(r, F.lit(0.0)), 2)).alias("_d"), F.sum(F.when(r > 0, w).otherwise(0.0)).alias("_v"))
    told = lambda c: F.when(F.col("n_trades") >= 30, F.col(c) / F.col("_w")).otherwise(0.0)
    s = s.withColumns({"mu": told("_x"), "sigma": F.sqrt(told("_d")), "win_rate": told("_v")})
    s = s.withColumn("kelly_f", F.when((F.col("mu") > 0) & (F.col("sigma") > 0), F.least(F.col("mu") / F.pow("sigma", F.lit(2)), F.lit(2.0)) * 0.5).otherwise(0.0))
    sure = F.when(F.col("n_trades") < 30, 0.3).when(F.col("n_trades") < 100, 0.3 + (F.col("n_trades") - 30) / 70 * F.col("kelly_f")).otherwise(F.col("kelly_f"))
    return s.withColumn("confidence", sure).drop("_w", "_x", "_d", "_v")


@dataclass(frozen=True)
class Account:
    """An evaluation account: fees, targets and sizes."""

    exam_fee: float
    activation_fee: float
    target: float
    drawdown: float
    max_contracts: int
    first_contracts: int
    discount: float = 0.9


#: Accounts by name (fixed values).
ACCOUNTS = {"50k": Account(49, 149, 3000, 2000, 5, 2)}


def weighted_mean_std(trades: DataFrame, by: list[str], newest_first: list[Column], pnl: str = "net_usd") -> DataFrame:
    """mu and sigma of each run, weights falling with a span of a third of the run (10 at least)."""
    o = _aged(trades, by, newest_first)
    span = F.greatest(F.lit(10), F.floor(F.col("n") / 3))
    w, x = F.pow(1 - 2 / (span + 1), F.col("i")), F.col(pnl)
    m = o.groupBy(*by).agg((F.sum(w * x) / F.sum(w)).alias("mu"), (F.sum(w * x * x) / F.sum(w)).alias("_q"))
    return m.withColumn("sigma", F.sqrt(F.greatest(F.round(F.col("_q") - F.col("mu") * F.col("mu"), 6), F.lit(0.0)))).drop("_q")


def reach(mu: Column, sigma: Column, target: float, limit: float, contracts: int) -> Column:
    """Chance that a walk with this drift and deviation reaches the target before it loses the limit."""
    e = lambda x: F.least(2 * mu * x / (F.nullif(sigma, F.lit(0.0)) * sigma * contracts), F.lit(500.0))
    return F.when(mu <= 0, 0.0).when(sigma == 0, 1.0).otherwise((1 - F.exp(-e(limit))) / (1 - F.exp(-e(target + limit))))


def account_value(runs: DataFrame, accounts: Mapping[str, Account] = ACCOUNTS) -> DataFrame:
    """What an attempt is worth to runs with mu and sigma, for the best account: best_account, p_pass, p_activation, payout, cost_per_success, ev_per_attempt.

    cost_per_success is null where none can be expected. Of equal values the
    first account by name is best.
    """
    each = []
    for name, a in sorted(accounts.items()):
        goal = 2 * a.drawdown
        p, q = reach(F.col("mu"), F.col("sigma"), a.target, a.drawdown, a.max_contracts), reach(F.col("mu"), F.col("sigma"), goal, a.drawdown, a.first_contracts)
        payout = goal / 2 * a.discount
        cost = F.when((p > 0) & (q > 0), a.exam_fee / (p * q) + a.activation_fee / q)
        value = p * q * payout - p * a.activation_fee - a.exam_fee
        each.append(F.struct(
            F.round(value, 2).alias("ev_per_attempt"), F.lit(name).alias("best_account"), F.round(p, 4).alias("p_pass"), F.round(q, 4).alias("p_activation"),
            F.lit(payout).alias("payout"), F.round(cost, 2).alias("cost_per_success")))
    best = F.aggregate(F.slice("_each", 2, len(each)), F.get("_each", F.lit(0)), lambda a, x: F.when(x["ev_per_attempt"] > a["ev_per_attempt"], x).otherwise(a))
    return runs.withColumn("_each", F.array(*each)).withColumn("_best", best).select(*runs.columns, "_best.*")


# Strategy variants

FAMILY = ["symbol", "fam", "variant"]


def threshold_variants(bars: DataFrame, levels: Sequence[float], value: str = "sma_rsi") -> DataFrame:
    """Each numbered bar for each variant of two families: long above a level, short below its negative."""
    kinds = F.array(*(F.struct(F.lit(fam).alias("fam"), F.lit(i).alias("variant"), F.lit(x).alias("_level")) for fam in ("long", "short") for i, x in enumerate(levels, 1)))
    f = bars.select("symbol", "session_date", "bar_no", "row", "close", F.col(value).alias("_v"), F.inline(kinds))
    side = F.when((F.col("fam") == "long") & (F.col("_v") > F.col("_level")), 1).when((F.col("fam") == "short") & (F.col("_v") < -F.col("_level")), -1).otherwise(0)
    return f.withColumn("side", side).drop("_v", "_level")


def variant_scores(variants: DataFrame, tick_usd: float = 12.5, round_trip: float = 29.0, keep: int = 100, alpha: float = 2 / 201, norm: float = NORM) -> DataFrame:
    """The scoreboard: each variant's position at each bar's close and the record of its last closed trades.

    Adds position, floating (open profit), sharpe, win_rate and realised (each
    weighted by age and scaled by trades / 30 up to 1; 0 before two trades).
    A bar's side is taken at the close before it; trades are the stretches of
    one position; each bar sees the trades closed up to it.
    """
    w = Window.partitionBy(*FAMILY).orderBy("row")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    s = variants.withColumn("position", F.coalesce(F.lead("side").over(w), F.lit(0)))
    s = s.withColumn("_before", F.coalesce(F.lag("position").over(w), F.lit(0)))
    s = s.withColumn("_entry", F.last(F.when(F.col("position") != F.col("_before"), F.col("close")), ignorenulls=True).over(so_far))
    gain = lambda entry, side: (F.col("close") - entry) * side * tick_usd - round_trip
    s = s.withColumn("_pnl", F.when((F.col("position") != F.col("_before")) & (F.col("_before") != 0), gain(F.lag("_entry").over(w), F.col("_before"))))

    closed = s.filter("_pnl is not null").select(*FAMILY, "row", "_pnl", F.row_number().over(w).alias("_n"), F.collect_list("_pnl").over(w.rowsBetween(1 - keep, 0)).alias("_xs"))
    fold = lambda f: F.aggregate("_xs", F.lit(0.0), lambda a, x: a * (1 - alpha) + f(x))
    closed = closed.withColumn("_w", fold(lambda x: F.lit(1.0)))
    closed = closed.withColumn("_mu", fold(lambda x: x) / F.col("_w"))
    sigma = F.sqrt(fold(lambda x: (x - F.col("_mu")) * (x - F.col("_mu"))) / F.col("_w"))
    sure = F.when(F.col("_n") >= 2, F.least(F.col("_n") / F.lit(30.0), F.lit(1.0))).otherwise(0.0)
    closed = closed.withColumns({"_sigma": sigma, "_sure": sure})
    record = F.struct(
        (F.when(F.col("_sigma") > 1e-8, F.col("_mu") / F.col("_sigma")).otherwise(0.0) * F.col("_sure")).alias("sharpe"),
        (fold(lambda x: (x > 0).cast("double")) / F.col("_w") * F.col("_sure")).alias("win_rate"), (F.col("_mu") / norm * F.col("_sure")).alias("realised"))
    s = s.join(closed.select(*FAMILY, "row", record.alias("_r")), [*FAMILY, "row"], "left").withColumn("_r", F.last("_r", ignorenulls=True).over(so_far))
    floating = F.when(F.col("position") != 0, gain(F.col("_entry"), F.col("position")) / norm).otherwise(0.0)
    own = [*FAMILY, "session_date", "bar_no", "row", "position"]
    return s.select(*own, floating.alias("floating"), *(_zero(F.col(f"_r.{c}")).alias(c) for c in ("sharpe", "win_rate", "realised")))


def _top(scores: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n best variants of each family at each bar; of equal scores the first variants."""
    best = Window.partitionBy("symbol", "row", "fam").orderBy(F.desc(F.round(by, 9)), "variant")
    return scores.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def consensus(scores: DataFrame, confidence: Mapping[str, float], least: float = 0.1) -> DataFrame:
    """One signal for each bar: families' five best variants by Sharpe, damped where their record is weak, by confidence.

    A variant counts a tenth if its realised mean is below 0.01, half if its
    open profit is negative, 0.7 if its Sharpe is below 0.01; a family below
    the least confidence counts nothing.
    """
    damp = lambda c, low, part: F.when(F.round(c, 9) >= low, 1.0).otherwise(part)
    top = _top(scores, "sharpe").withColumn("_k", damp("realised", 0.01, 0.1) * damp("floating", 0.0, 0.5) * damp("sharpe", 0.01, 0.7))
    fam = top.groupBy("symbol", "session_date", "bar_no", "fam").agg((F.sum(F.col("position") * F.col("_k")) / F.sum("_k")).alias("signal"))
    table = F.create_map(*(F.lit(x) for f, c in confidence.items() for x in (f, float(c) if c >= least else 0.0)))
    fam = fam.withColumn("_c", _zero(F.try_element_at(table, F.col("fam"))))
    total = F.sum("_c")
    return fam.groupBy("symbol", "session_date", "bar_no").agg(F.when(total > 0, F.sum(F.col("signal") * F.col("_c")) / total).otherwise(0.0).alias("consensus"))


def kalman_rank(scores: DataFrame, q: float = 0.1, r: float = 1.0) -> DataFrame:
    """The five best variants of each family at each bar by a Kalman-smoothed Sharpe (scalar, constant noise): adds score and place.

    The filter runs over one variant's bars of one symbol, whose number the
    calendar bounds.
    """

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        mean, var, out = 0.0, 1.0, []
        for x in rows["sharpe"]:
            var += q
            gain = var / (var + r)
            mean, var = mean + gain * (x - mean), (1 - gain) * var
            out.append(mean / (var + 1e-8) ** 0.5)
        return rows.drop(columns="sharpe").assign(score=out)

    thin = scores.select(*FAMILY, "session_date", "bar_no", "row", "sharpe")
    kept = [f for f in thin.schema.fields if f.name != "sharpe"]
    schema = type(thin.schema)(kept).add("score", "double")
    return _top(thin.groupBy(*FAMILY).applyInPandas(smooth, schema), "score")


HORIZONS = (20, 60, 120, 200)


def regime(scores: DataFrame, volatility: DataFrame, clip: float = 3.0) -> DataFrame:
    """Each family's means over its variants, as differences and slope, and the volatility's log ratio; all within +-clip.

    d20 .. d200: the realised mean less that of so many bars ago; slope: of
    the mean Sharpe over 20 bars; log_vol: against 20 bars ago. What lies
    before the first bar is 0. volatility: symbol, row, vol.
    """
    m = scores.groupBy("symbol", "session_date", "bar_no", "row", "fam").agg(F.avg("realised").alias("_m"), F.avg("sharpe").alias("_s"))
    m = m.join(volatility, ["symbol", "row"])
    w = Window.partitionBy("symbol", "fam").orderBy("row")
    back = lambda c, k: _zero(F.lag(c, k).over(w)) if k else F.col(c)
    # The slope over places 0 to 19: their mean is 9.5, their squared distances from it sum to 665.
    slope = sum((back("_s", k) * (9.5 - k) for k in range(1, 20)), F.col("_s") * 9.5) / 665
    columns = {f"d{h}": F.col("_m") - back("_m", h) for h in HORIZONS} | {"slope": slope, "log_vol": F.log((F.col("vol") + 1e-3) / (back("vol", 20) + 1e-3))}
    within = lambda c: F.greatest(F.least(c, F.lit(clip)), F.lit(-clip))
    return m.select("symbol", "session_date", "bar_no", "fam", *(within(c).alias(n) for n, c in columns.items()))
