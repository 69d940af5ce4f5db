"""Panels of series: spines, lags that keep a horizon, intermittency, momentum portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """(entity, day, qty) for every entity and every day of the whole span, zero days included."""
    n = events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(entity).alias("entity"), F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("qty"))
    span = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span["a"] is None:
        return n
    spine = n.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(span["a"]), F.lit(span["b"]))).alias("day"))
    return spine.join(n, ["entity", "day"], "left").withColumn("qty", F.coalesce("qty", F.lit(0)))


def known_lags(panel: DataFrame, horizon: int, lags: list[int], windows: list[int]) -> DataFrame:
    """Lags and trailing windows of qty that end `horizon` days before the target day: nothing later is seen."""
    w = Window.partitionBy("entity").orderBy("day")
    out = panel.withColumns({f"lag_{k}": F.lag("qty", k).over(w) for k in lags})
    for n in windows:
        frame = w.rowsBetween(-(horizon - 1 + n), -horizon)
        full = F.count("qty").over(frame) == n
        out = out.withColumns({f"mean_{n}": F.when(full, F.avg("qty").over(frame)), f"std_{n}": F.when(full, F.stddev_pop("qty").over(frame)), f"zero_{n}": F.when(full, F.avg((F.col("qty") == 0).cast("double")).over(frame))})
    return out


def intermittency(panel: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(entity, zero_share, intermittent): share of zero days from the first sale on."""
    first = panel.where("qty > 0").groupBy("entity").agg(F.min("day").alias("first_day"))
    j = panel.join(first, "entity").where(F.col("day") >= F.col("first_day"))
    share = F.avg((F.col("qty") == 0).cast("double"))
    return j.groupBy("entity").agg(F.round(share, 6).alias("zero_share"), (share >= threshold).alias("intermittent"))


def sessions(panel: DataFrame) -> DataFrame:
    """(date, session): running number of each date on which any symbol traded."""
    return panel.select("date").distinct().withColumn("session", F.row_number().over(Window.orderBy("date")))  # one row per date


def filled(panel: DataFrame) -> DataFrame:
    """(symbol, session, close): each symbol on every session from its first one, the last price carried on."""
    s = sessions(panel)
    n = s.agg(F.max("session")).first()[0] or 0
    p = panel.join(F.broadcast(s), "date").groupBy("symbol", "session").agg(F.avg("close").alias("close"))
    first = p.groupBy("symbol").agg(F.min("session").alias("f"))
    spine = first.select("symbol", F.explode(F.sequence("f", F.lit(n))).alias("session")) if n else p.select("symbol", "session")
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(p, ["symbol", "session"], "left").withColumn("raw", F.col("close")).withColumn("close", F.last("close", ignorenulls=True).over(w))


def momentum_weights(prices: DataFrame, lookback: int, every: int, top: int) -> DataFrame:
    """(session, symbol, weight): at each `every`-th session the `top` symbols by price change over `lookback` sessions.

    Both prices must be quoted on their own session; a tie goes to the smaller symbol; the future has no part.
    """
    now = prices.where(F.col("raw").isNotNull()).select("symbol", "session", F.col("raw").alias("p1"))
    then = now.select("symbol", (F.col("session") + lookback).alias("session"), F.col("p1").alias("p0"))
    m = now.where(F.col("session") % every == 0).join(then, ["symbol", "session"]).where("p0 > 0").withColumn("momentum", F.round(F.col("p1") / F.col("p0") - 1, 9))
    w = Window.partitionBy("session").orderBy(F.col("momentum").desc(), "symbol")
    picked = m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return picked.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("session"))).select("session", "symbol", "weight")


def backtest(prices: DataFrame, weights: DataFrame, cost_bp: float) -> DataFrame:
    """(session, ret, turnover) of fixed shares between rebalances.

    Within a segment the basket is held, so its value is the weighted mean of price relatives; turnover sets the new
    weights against the drifted old ones, and its cost falls on the segment's first session.
    """
    marks = weights.select("session").distinct()
    ends = marks.withColumn("stop", F.lead("session").over(Window.orderBy("session")))  # one row per rebalance
    last = prices.agg(F.max("session")).first()[0] or 0
    seg = weights.join(F.broadcast(ends), "session").withColumn("stop", F.coalesce("stop", F.lit(last))).withColumnRenamed("session", "start")
    base = prices.select("symbol", F.col("session").alias("start"), F.col("close").alias("p0"))
    held = seg.join(base, ["symbol", "start"])
    held = held.select("symbol", "start", "stop", "weight", "p0", F.explode(F.sequence("start", "stop")).alias("session"))
    v = held.join(prices.select("symbol", "session", "close"), ["symbol", "session"]).withColumn("part", F.col("weight") * F.col("close") / F.col("p0"))
    value = v.groupBy("start", "stop", "session").agg(F.sum("part").alias("v"))
    step = Window.partitionBy("start").orderBy("session")
    ret = value.withColumn("ret", F.col("v") / F.lag("v").over(step) - 1).where(F.col("session") > F.col("start"))
    drift = v.where(F.col("session") == F.col("stop")).join(value.select("start", "session", "v"), ["start", "session"]).select(F.col("stop").alias("start"), "symbol", (F.col("part") / F.col("v")).alias("old"))
    new = weights.withColumnRenamed("session", "start")
    turn = new.join(drift.join(F.broadcast(marks.withColumnRenamed("session", "start")), "start", "left_semi"), ["start", "symbol"], "full_outer")
    turn = turn.groupBy("start").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"))
    out = ret.join(F.broadcast(turn), "start")
    first = F.col("session") == F.col("start") + 1
    return out.select("session", F.when(first, (1 + F.col("ret")) * (1 - cost_bp * F.col("turnover") / 10_000) - 1).otherwise(F.col("ret")).alias("ret"), F.when(first, F.col("turnover")).otherwise(0.0).alias("turnover"))


def return_summary(returns: DataFrame, per_year: float) -> DataFrame:
    """Total return, growth rate, Sharpe ratio (sample deviation) and deepest drawdown."""
    path = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)  # one row per session
    c = returns.withColumn("level", F.exp(F.sum(F.log1p("ret")).over(path)))
    c = c.withColumn("drawdown", F.col("level") / F.greatest(F.max("level").over(path), F.lit(1.0)) - 1)
    n = F.count(F.lit(1))
    total = F.exp(F.sum(F.log1p("ret")))
    return c.agg(F.round(total - 1, 6).alias("total"), F.round(F.pow(total, per_year / n) - 1, 6).alias("cagr"), F.round(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * per_year**0.5, 6).alias("sharpe"), F.round(F.min("drawdown"), 6).alias("max_drawdown"), n.alias("n"))
