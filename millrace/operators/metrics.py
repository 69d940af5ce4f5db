"""Ranking, calibration, threshold, drift and interval metrics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import with_running_sums
from millrace.session import materialise


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, NULL where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    """(score, pos, n): all further steps see one row per distinct score."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("score")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: AUC by average ranks of tied scores, Gini, positives and negatives."""
    cum = with_running_sums(by_score(df, y, p), [F.col("score").asc()], {"c": F.col("n")})
    rank = F.col("c") - F.col("n") + (F.col("n") + 1) / 2.0
    t = cum.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    auc = ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q"))
    return t.select(F.round(auc, 6).alias("auc"), F.round(2 * auc - 1, 6).alias("gini"), F.col("p").alias("n_pos"), F.col("q").alias("n_neg"))


def precision_recall_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """(threshold, tp, n, precision, recall, f1) for each distinct score, all scores at or above it being taken."""
    cum = with_running_sums(by_score(df, y, p), [F.col("score").desc()], {"tp": F.col("pos"), "taken": F.col("n")})
    total = F.lit(df.where(F.col(p).isNotNull()).agg(F.sum(F.col(y).cast("bigint"))).first()[0] or 0)
    prec, rec = ratio(F.col("tp"), F.col("taken")), ratio(F.col("tp"), total)
    return cum.select(F.col("score").alias("threshold"), "pos", "tp", F.col("taken").alias("n"), prec.alias("precision"), rec.alias("recall"), ratio(2 * F.col("tp"), F.col("taken") + total).alias("f1"))


def pr_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: average precision, best F1 and the highest threshold that reaches it."""
    curve = precision_recall_curve(df, y, p)
    positives = curve.agg(F.sum("pos")).first()[0] or 0
    return curve.agg(F.round(ratio(F.sum(F.col("pos") * F.col("precision")), F.lit(positives)), 6).alias("pr_auc"), F.round(F.max("f1"), 6).alias("best_f1"), F.max_by("threshold", F.struct(F.round("f1", 9), "threshold")).alias("best_threshold"))


def log_loss_brier(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(eps)), F.lit(1 - eps))
    t = F.col(y).cast("double")
    return df.agg(F.round(F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))), 6).alias("log_loss"), F.round(F.avg(F.pow(F.col(p) - t, 2)), 6).alias("brier"), F.count(F.lit(1)).alias("n"))


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins are kept with count 0."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    got = df.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(p)).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y")


def calibration_error(binned: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return binned.agg(F.round(F.coalesce(ratio(F.sum(F.col("n") * F.coalesce(gap, F.lit(0.0))), F.sum("n")), F.lit(0.0)), 6).alias("ece"), F.round(F.max(gap), 6).alias("max_gap"), F.sum("n").alias("n"))


def confusion(df: DataFrame, y: str, p: str, grid: list[float], false_positive_cost: float = 1.0, false_negative_cost: float = 10.0) -> DataFrame:
    """Counts, rates and cost at each threshold of a grid; one pass with four counters per threshold."""
    t, s = F.col(y).cast("int"), F.col(p)
    cells = [F.struct(F.lit(g).alias("threshold"), F.count_if((s >= g) & (t == 1)).alias("tp"), F.count_if((s >= g) & (t == 0)).alias("fp"), F.count_if((s < g) & (t == 1)).alias("fn"), F.count_if((s < g) & (t == 0)).alias("tn")) for g in grid]
    rows = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    cost = F.col("fp") * false_positive_cost + F.col("fn") * false_negative_cost
    return rows.select("*", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"), cost.alias("cost"))


def cheapest(curve: DataFrame) -> DataFrame:
    """The setting of least cost, then of greatest precision, then of greatest threshold."""
    return curve.orderBy(F.col("cost").asc(), F.col("precision").desc_nulls_last(), F.col("threshold").desc()).limit(1)


def select_threshold(curve: DataFrame, least_precision: float, least_true: int, margin: float) -> DataFrame:
    """Of settings with enough precision and true hits the one of most recall, then most coverage, then lowest; moved up by a margin to the nearest one."""
    fit = curve.where((F.col("precision") >= least_precision) & (F.col("tp") >= least_true))
    best = fit.orderBy(F.col("recall").desc(), (F.col("tp") + F.col("fp")).desc(), F.col("threshold").asc()).limit(1).select("threshold").first()
    if best is None:
        return curve.limit(0)
    return curve.orderBy(F.abs(F.col("threshold") - F.lit(best[0] + margin)), "threshold").limit(1)


def equal_count_curve(df: DataFrame, y: str, p: str, key: list[str], bins: int) -> DataFrame:
    """Mean score and rate in bins of equal counts of the rows ordered by score, then key."""
    from millrace.operators.ordered import ntile

    tiled = ntile(df, [F.col(p).asc(), *[F.col(k).asc() for k in key]], bins, "bin")
    return tiled.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 6).alias("mean_y"))


def value_counts(df: DataFrame, cols: list[str], sides: dict[str, Column]) -> DataFrame:
    """(k, v, side counts): distinct values of several numeric columns (k is the place in `cols`) in one scan.

    NULL and NaN are one missing value, NULL. Counted before the shuffle; all further steps see distinct values.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), value(c).alias("v")) for i, c in enumerate(cols)])).alias("x")
    marked = df.select(*[c.alias(f"_{n}") for n, c in sides.items()], cells)
    return marked.groupBy("x.k", "x.v").agg(*[F.count_if(F.col(f"_{n}")).alias(n) for n in sides])


def quantiles_from(counts: DataFrame, cols: list[str], n: str, probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation from `value_counts`, by column; missing values are left out.

    A quantile's two neighbours are the first values whose running count passes their places.
    """
    known = counts.where(F.col("v").isNotNull() & (F.col(n) > 0))
    totals = {r["k"]: r["t"] for r in known.groupBy("k").agg(F.sum(n).alias("t")).collect()}  # one row per column
    places, before = {}, 0
    for k in sorted(totals):
        places[k] = [before + (totals[k] - 1) * q for q in probs]
        before += totals[k]
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if not places:
        return out
    cum = with_running_sums(known, [F.col("k").asc(), F.col("v").asc()], {"c": F.col(n)})
    picks = cum.agg(*[F.min(F.when((F.col("k") == k) & (F.col("c") > at), F.col("v"))) for k, hs in places.items() for h in hs for at in (math.floor(h), math.ceil(h))]).first()
    it = iter(picks)
    for k, hs in places.items():
        out[cols[k]] = [lo + (next(it) - lo) * (h - math.floor(h)) for h in hs for lo in (next(it),)]
    return out


def quantiles_of(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns with linear interpolation, NULL and NaN left out."""
    return quantiles_from(materialise(value_counts(df, cols, {"n": F.lit(True)}), "counts"), cols, "n", probs)


def quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of one column."""
    return quantiles_of(df, [col], probs)[col]


def bin_of(x: Column, edges: list[float], right: bool) -> Column:
    """How many of the sorted edges lie below x (right) or at or below it: bins (a,b] or [a,b)."""
    hits = [((x > e) if right else (x >= e)).cast("int") for e in edges]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def psi(df: DataFrame, features: list[str], reference: Column, right: bool, missing: bool, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index of each numeric feature: edges are quantiles of the reference.

    right and missing tell the two conventions apart: [a,b) bins of values only, or (a,b] bins with a bucket of their
    own for missing values, in which a feature of at most ten distinct reference values goes by value. The table is
    read once, to the counts of distinct values of all features; edges, bins and shares come from these.
    """
    counts = materialise(value_counts(df, features, {"r": reference, "s": ~reference}), "psi")
    cuts = quantiles_from(counts, features, "r", [i / bins for i in range(bins + 1)])
    distinct = {r["k"]: r["n"] for r in counts.where(F.col("v").isNotNull() & (F.col("r") > 0)).groupBy("k").count().withColumnRenamed("count", "n").collect()}  # one row per feature
    label, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, f in enumerate(features):
        edges = sorted({e for e in cuts[f] if e is not None})
        own = F.col("v").cast("string") if missing and distinct.get(k, 0) <= 10 else bin_of(F.col("v"), edges[1:-1], right).cast("string")
        label, name = F.when(F.col("k") == k, own).otherwise(label), F.when(F.col("k") == k, F.lit(f)).otherwise(name)
    binned = counts.select(name.alias("feature"), F.when(F.col("v").isNull(), "missing").otherwise(label).alias("bin"), "r", "s")
    c = (binned if missing else binned.where(F.col("bin") != "missing")).groupBy("feature", "bin").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    w = Window.partitionBy("feature")  # one row per feature and bin
    a = F.greatest(ratio(F.col("r"), F.sum("r").over(w)), F.lit(eps))
    b = F.greatest(ratio(F.col("s"), F.sum("s").over(w)), F.lit(eps))
    return c.select("feature", "bin", F.col("r").alias("n_reference"), F.col("s").alias("n_current"), ((b - a) * F.log(b / a)).alias("term"))


def psi_table(terms: DataFrame) -> DataFrame:
    """PSI of each feature, its signal and its rank."""
    t = terms.groupBy("feature").agg(F.round(F.sum("term"), 6).alias("psi"))
    signal = F.when(F.col("psi") > 0.25, "high").when(F.col("psi") >= 0.1, "watch").otherwise("stable")
    return t.withColumn("signal", signal).withColumn("place", F.row_number().over(Window.orderBy(F.col("psi").desc(), "feature")))  # one row per feature


def psi_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.round(F.avg("psi"), 6).alias("mean"), F.round(F.median("psi"), 6).alias("median"), F.round(F.percentile("psi", 0.95), 6).alias("p95"), F.round(F.max("psi"), 6).alias("max"), F.count_if(F.col("psi") > 0.25).alias("n_high"))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; NULL without trials."""
    n, share = trials.cast("double"), ratio(successes, trials)
    mid = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(trials > 0, F.greatest(mid - half, F.lit(0.0))), F.when(trials > 0, F.least(mid + half, F.lit(1.0)))


def holm(tests: DataFrame, name: str, p: str, alpha: float) -> DataFrame:
    """Adjusted p-values and rejections of a family of tests, one row per test; ties by name."""
    w = Window.orderBy(p, name)  # one row per test
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    k = tests.withColumn("_raw", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return k.select(name, p, F.max("_raw").over(run).alias("p_adjusted"), (F.max("_raw").over(run) <= alpha).alias("rejected"))


def pinball(y: Column, q: Column, level: float) -> Column:
    r = y - q
    return F.greatest(level * r, (level - 1) * r)


def hash_fraction(*keys: Column) -> Column:
    """A fraction in [0, 1) from the first 32 bits of the keys' MD5 sum: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a fraction: the bootstrap weight of a row."""
    out, cum, term = F.lit(8), 0.0, math.exp(-1.0)
    steps = []
    for k in range(8):
        cum += term
        steps.append((k, cum))
        term /= k + 1
    for k, c in reversed(steps):
        out = F.when(u < c, k).otherwise(out)
    return out


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance, over the joint counts of their labels."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows = joint.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na"))
    cols = joint.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, "k").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("e"))
    t = joint.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    e = chance.scalar() / (F.col("n") * F.col("n"))
    o = F.col("same") / F.col("n")
    return t.select(F.round(o, 6).alias("observed"), F.round(e, 6).alias("expected"), F.round((o - e) / F.nullif(1 - e, F.lit(0.0)), 6).alias("kappa"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks, which come from counts of distinct values."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    for c in ("a", "b"):
        counts = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        ranks = with_running_sums(counts, [F.col(c).asc()], {"c": F.col("n")}).select(c, (F.col("c") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))
        rows = rows.join(ranks, c)
    return rows.agg(F.round(F.corr("ra", "rb"), 6).alias("rho"), F.count(F.lit(1)).alias("n"))
