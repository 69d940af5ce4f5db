"""Treatment effects, uplift curves, off-policy estimates, co-occurrence and injected regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import ratio
from millrace.operators.ordered import with_row_number, with_running_sums


def effect(df: DataFrame, y: str, treated: str, by: list[str]) -> DataFrame:
    """Difference of outcome rates between arms with its normal interval, by group."""
    y1, y0 = F.when(F.col(treated) == 1, F.col(y)), F.when(F.col(treated) == 0, F.col(y))
    g = df.groupBy(*by).agg(F.avg(y1).alias("r1"), F.avg(y0).alias("r0"), F.count(y1).alias("n1"), F.count(y0).alias("n0"))
    se = F.sqrt(ratio(F.col("r1") * (1 - F.col("r1")), F.col("n1")) + ratio(F.col("r0") * (1 - F.col("r0")), F.col("n0")))
    d = F.col("r1") - F.col("r0")
    return g.select(*by, "n1", "n0", F.round("r1", 6).alias("rate_treated"), F.round("r0", 6).alias("rate_control"), F.round(d, 6).alias("effect"), F.round(d - 1.96 * se, 6).alias("lower"), F.round(d + 1.96 * se, 6).alias("upper"))


def qini_curve(df: DataFrame, y: str, treated: str, score: str) -> DataFrame:
    """(score, n, qini, uplift) at each distinct score, from the highest down."""
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(*[F.sum(F.when(F.col(treated) == a, F.col(y)).otherwise(0)).cast("bigint").alias(f"y{a}_") for a in (1, 0)], *[F.count_if(F.col(treated) == a).alias(f"n{a}_") for a in (1, 0)])
    c = with_running_sums(g, [F.col("s").desc()], {f"{k}{a}": F.col(f"{k}{a}_") for k in "yn" for a in (1, 0)})
    qini = F.col("y1") - F.coalesce(ratio(F.col("y0") * F.col("n1"), F.col("n0")), F.lit(0.0))
    uplift = (F.coalesce(ratio(F.col("y1"), F.col("n1")), F.lit(0.0)) - F.coalesce(ratio(F.col("y0"), F.col("n0")), F.lit(0.0))) * (F.col("n1") + F.col("n0"))
    return c.select(F.col("s").alias("score"), (F.col("n1") + F.col("n0")).alias("n"), qini.alias("qini"), uplift.alias("uplift"))


def standardised_differences(df: DataFrame, treated: str, features: list[str]) -> DataFrame:
    """(feature, smd): difference of means over the pooled deviation, one pass over all features."""
    aggs = []
    for i, f in enumerate(features):
        for a in (1, 0):
            x = F.when(F.col(treated) == a, F.col(f).cast("double"))
            aggs += [F.avg(x).alias(f"m{i}_{a}"), F.var_pop(x).alias(f"v{i}_{a}")]
    rows = df.agg(*aggs)
    cells = [F.struct(F.lit(f).alias("feature"), F.round((F.col(f"m{i}_1") - F.col(f"m{i}_0")) / F.nullif(F.sqrt((F.col(f"v{i}_1") + F.col(f"v{i}_0")) / 2), F.lit(0.0)), 6).alias("smd")) for i, f in enumerate(features)]
    return rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def segments(p1: Column, p0: Column, cut: float) -> Column:
    """Persuadable over sleeping dog over sure thing over lost cause: later rules stand over earlier ones."""
    return F.when((p1 >= cut) & (p0 < cut), "persuadable").when((p1 < cut) & (p0 >= cut), "sleeping dog").when((p1 >= cut) & (p0 >= cut), "sure thing").otherwise("lost cause")


def off_policy(log: DataFrame, position: str, reward: str, propensity: str, target: str, q_logged: str, q_target: str) -> DataFrame:
    """Direct, inverse-propensity, self-normalised and doubly robust values by position and averaged over positions.

    target: the new policy's probability of the logged action; q_*: modelled reward of the logged action and of the
    new policy. The effective sample size and the largest weight tell how far the log supports the policy.
    """
    w = ratio(F.col(target), F.col(propensity))
    r, q, v = F.col(reward).cast("double"), F.col(q_logged), F.col(q_target)
    per = log.groupBy(position).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("dm"), F.avg(w * r).alias("ips"), ratio(F.sum(w * r), F.sum(w)).alias("snips"), F.avg(v + w * (r - q)).alias("dr"), ratio(F.pow(F.sum(w), 2), F.sum(w * w)).alias("ess"), F.max(w).alias("max_weight"))
    return per.select(F.col(position).cast("string").alias("position"), "n", *[F.round(c, 6).alias(c) for c in ("dm", "ips", "snips", "dr", "ess", "max_weight")])


def cooccurrence(baskets: DataFrame, basket: str, item: str, most: int) -> DataFrame:
    """(a, b, n) of item pairs a < b that share baskets, over the distinct items of all baskets.

    A basket's pairs grow with the square of its items. One of up to `most` items is paired in its row; the items of
    a larger one are dealt into blocks of about `most`, and each pair of blocks is a row of its own, so that no task
    holds or pairs a large basket alone.
    """
    once = baskets.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("k"), F.col(item).alias("x")).distinct()
    wide = once.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most)
    sized = once.join(wide, "k", "left")
    b = sized.where(F.col("size").isNull()).groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("s"))
    pairs = b.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    dealt = sized.where(F.col("size").isNotNull()).withColumn("blocks", F.ceil(F.col("size") / F.lit(max(most, 1))))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    held = met.groupBy("k", low.alias("p"), high.alias("q")).agg(F.collect_list(F.when(F.col("block") == low, F.col("x"))).alias("l"), F.collect_list(F.when(F.col("block") == high, F.col("x"))).alias("r"))
    crossed = held.select("p", "q", F.explode("l").alias("u"), "r").select("p", "q", "u", F.explode("r").alias("v")).where((F.col("p") < F.col("q")) | (F.col("u") < F.col("v")))
    crossed = crossed.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return pairs.unionByName(crossed).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def inject_regression(df: DataFrame, segment: str, target: str, correct: str, key: list[str], drop: float) -> DataFrame:
    """df with injected: correctness after round(n_target * drop) right answers of one segment turn wrong and as many wrong ones elsewhere turn right."""
    seg = F.col(segment) == target
    n = df.agg(F.count_if(seg).alias("n")).first()[0]
    k = int(n * drop + 0.5)
    side = F.when(seg & (F.col(correct) == 1), 0).when(~seg & (F.col(correct) == 0), 1)
    rows = df.withColumns({"_side": side, "_h": F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))})
    pool = rows.where(F.col("_side").isNotNull())
    downs = pool.where("_side = 0").count()
    placed = with_row_number(pool, [F.col("_side").asc(), F.col("_h").asc(), *[F.col(c).asc() for c in key]], "_r")
    hit = (F.col("_r") - F.col("_side") * downs) <= k
    turned = placed.withColumn("injected", F.when(hit, F.col("_side")).otherwise(F.col(correct)).cast("int")).drop("_r")
    rest = rows.where(F.col("_side").isNull()).withColumn("injected", F.col(correct).cast("int"))
    return turned.unionByName(rest).drop("_side", "_h")


def net_effect(df: DataFrame, y: str, treated: str, chosen: Column, value: float, cost: float) -> DataFrame:
    """One row: the effect within a chosen set with its interval, and the value of treating the set net of its cost."""
    e = effect(df.where(chosen).withColumn("_all", F.lit(1)), y, treated, ["_all"])
    n = F.col("n1") + F.col("n0")
    return e.select("n1", "n0", "effect", "lower", "upper", F.round(F.col("effect") * n * value - n * cost, 4).alias("net_value"))


def curve_area(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the area under a curve of few points by trapezoids from (0, 0), above the straight line to its end, as a share of the end's triangle."""
    w = Window.orderBy("x")  # one row per distinct score
    step = curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumns({"x0": F.lag("x", 1, 0.0).over(w), "y0": F.lag("y", 1, 0.0).over(w)})
    t = step.agg(F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2).alias("area"), F.max("x").alias("end_x"), F.max_by("y", "x").alias("end_y"))
    return t.select(F.round("area", 6).alias("area"), F.round(F.col("area") - F.col("end_x") * F.col("end_y") / 2, 6).alias("gain"))


def off_policy_summary(per_position: DataFrame) -> DataFrame:
    """One row: each estimate averaged over positions."""
    return per_position.agg(F.count(F.lit(1)).alias("positions"), F.sum("n").alias("rows"), *[F.round(F.avg(c), 6).alias(c) for c in ("dm", "ips", "snips", "dr")], F.max("max_weight").alias("max_weight"))


def factual_rate(log: DataFrame, position: str, reward: str) -> DataFrame:
    """One row: the reward rate with every position weighing the same, and its normal interval."""
    per = log.groupBy(position).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(reward).cast("double")).alias("r"))
    t = per.agg(F.sum("n").alias("n"), F.avg("r").alias("rate"), (F.sum(F.col("r") * (1 - F.col("r")) / F.col("n")) / F.pow(F.count(F.lit(1)), F.lit(2))).alias("v"))
    half = 1.96 * F.sqrt("v")
    return t.select("n", F.round("rate", 6).alias("rate"), F.round(F.greatest(F.col("rate") - half, F.lit(0.0)), 6).alias("lower"), F.round(F.col("rate") + half, 6).alias("upper"))


def smoothed_policy(log: DataFrame, hour: Column, action: str, position: str, prior: float) -> DataFrame:
    """(hour, position, action, p): the logging policy by hour and position, each action counted `prior` times more; every action of the log has a place in each cell."""
    n = log.groupBy(hour.alias("hour"), F.col(position).alias("position"), F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"))
    actions = log.select(F.col(action).alias("action")).distinct()
    cells = n.groupBy("hour", "position").agg(F.sum("n").alias("total"))
    grid = cells.crossJoin(F.broadcast(actions)).join(n, ["hour", "position", "action"], "left")  # the catalogue of actions
    k = actions.count()
    return grid.select("hour", "position", "action", ((F.coalesce("n", F.lit(0)) + prior) / (F.col("total") + prior * k)).alias("p"))


def slate_policy(ranked: DataFrame, actions: int, explore: float) -> DataFrame:
    """(user, item, position, p): the probability of each ranked item at its position; any other item has explore / actions."""
    return ranked.select("user", "item", F.col("place").alias("position"), F.lit(1 - explore + explore / actions).alias("p"))


def total_variation(fitted: DataFrame, held: DataFrame, actions: str = "action") -> DataFrame:
    """One row: half the absolute gap between a policy (hour, position, action, p) and the frequencies of held-out rows, averaged by rows."""
    n = held.groupBy("hour", "position", actions).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("hour", "position").agg(F.sum("n").alias("total"))
    gap = fitted.join(total, ["hour", "position"]).join(n, ["hour", "position", actions], "left")
    per = gap.groupBy("hour", "position").agg((F.sum(F.abs(F.col("p") - F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)))) / 2).alias("tv"), F.first("total").alias("total"))
    return per.agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(F.col("tv") * F.col("total")) / F.sum("total"), 6).alias("weighted_tv"))


def bidding_proxy(df: DataFrame, y: str, p: str, click_value: float) -> DataFrame:
    """One row: value of predicted and of real clicks, their gap, and the mean bid."""
    e, o = click_value * F.sum(p), click_value * F.sum(F.col(y).cast("double"))
    return df.agg(F.round(e, 4).alias("estimated"), F.round(o, 4).alias("observed"), F.round(e - o, 4).alias("bias"), F.round(F.abs(e - o), 4).alias("error"), F.round(click_value * F.avg(p), 6).alias("mean_bid"))


def bid(strategy: str, p: Column, scale: float, average: float, c: float) -> Column:
    """A bid by strategy: constant, linear in p, or the optimum under a hyperbolic winning curve (ortb)."""
    if strategy == "constant":
        return F.lit(float(scale))
    if strategy == "linear":
        return scale * p / average
    if strategy == "ortb":
        return F.sqrt(c * c + c * scale * p / average) - c
    raise ValueError(f"unknown strategy {strategy}")


def fit_winning_curve(points: DataFrame) -> float:
    """The c of bid / (c + bid) nearest to points (bid, win_rate) by least squares: golden-section search on few points."""
    rows = [(r["bid"], r["win_rate"]) for r in points.select("bid", "win_rate").collect()]  # the grid of bids
    loss = lambda c: sum((b / (c + b + 1e-12) - w) ** 2 for b, w in rows)
    low, high, g = 1e-6, 10 * max((b for b, _ in rows), default=1.0) + 1.0, (5**0.5 - 1) / 2
    for _ in range(200):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return (low + high) / 2
