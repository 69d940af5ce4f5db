"""Resampling and tests on paired and grouped differences, link counts, slice matrices and forecasts' quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import distributions as P
from millrace.operators.metrics import hash_fraction, poisson_weight, ratio, wilson

#: Differences are rounded to so many places before a simulation draws from their counts: a bounded histogram.
PLACES = 4


def bootstrap(df: DataFrame, by: list[str], key: list[str], top: Column, bottom: Column, replicates: int, strata: list[str] | None = None) -> DataFrame:
    """(by, replicate, value): the ratio of weighted sums of each replicate; `key` names a row.

    A row's weight in a replicate is a Poisson(1) count drawn by the hash of its key and the replicate, so no row is
    moved to resample it and any engine draws alike. For a cluster bootstrap give one row per cluster. With `strata`
    the ratio is taken within each stratum first and averaged by the strata's rows. Sums are made before the shuffle:
    one row per group, stratum and replicate goes over the network.
    """
    at = [*by, *(strata or [])]
    rows = df.select(*at, *[c for c in key if c not in at], top.alias("_t"), bottom.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    w = poisson_weight(hash_fraction(*[F.col(k) for k in key], F.col("replicate")))
    sums = rows.groupBy(*at, "replicate").agg(F.sum(w * F.col("_t")).alias("t"), F.sum(w * F.col("_b")).alias("b"), F.count(F.lit(1)).alias("n"))
    value = ratio(F.col("t"), F.col("b"))
    if not strata:
        return sums.select(*by, "replicate", value.alias("value"))
    return sums.groupBy(*by, "replicate").agg(ratio(F.sum(F.col("n") * value), F.sum(F.when(value.isNotNull(), F.col("n")))).alias("value"))


def interval(replicates: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """(by, lower, upper, n_replicates): percentile interval of replicates."""
    low = (1 - level) / 2
    return replicates.groupBy(*by).agg(F.round(F.percentile("value", low), 6).alias("lower"), F.round(F.percentile("value", 1 - low), 6).alias("upper"), F.count("value").alias("n_replicates"))


def paired_tests(differences: DataFrame, by: list[str], diff: str) -> DataFrame:
    """(by, n, mean, t, p_two_sided, p_greater): paired t tests; without variance p is 1, and t is NULL."""
    g = differences.where(F.col(diff).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd"))
    g = g.withColumn("t", ratio(F.col("mean"), F.col("sd") / F.sqrt("n"))).withColumn("df", (F.col("n") - 1).cast("double"))
    return g.select(*by, "n", "mean", "t", F.coalesce(P.t_two_sided("t", "df"), F.lit(1.0)).alias("p_two_sided"), F.coalesce(P.t_upper("t", "df"), F.lit(1.0)).alias("p_greater"))


def signed_rank_test(ranks: DataFrame) -> DataFrame:
    """z and two-sided p (normal approximation with continuity) of Wilcoxon's rank sums (w_plus, w_minus, n)."""
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    gap = F.least("w_plus", "w_minus") - n * (n + 1) / 4
    z = ratio(gap + F.when(gap < 0, 0.5).otherwise(0.0), spread)
    return ranks.withColumn("z", z).withColumn("p", F.coalesce(F.least(P.normal_two_sided("z"), F.lit(1.0)), F.lit(1.0)))


def mean_intervals(df: DataFrame, by: list[str], metrics: list[str], level: float = 0.95) -> DataFrame:
    """(by, n, and for each metric mean, low and high): Student intervals of group means; NULL for a group of one row."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    g = g.withColumn("_t", P.t_critical(level, F.when(F.col("n") > 1, (F.col("n") - 1).cast("double"))))
    half = lambda m: F.col("_t") * F.col(f"{m}_sd") / F.sqrt("n")
    return g.select(*by, "n", *[c for m in metrics for c in (F.col(f"{m}_mean"), (F.col(f"{m}_mean") - half(m)).alias(f"{m}_low"), (F.col(f"{m}_mean") + half(m)).alias(f"{m}_high"))])


def _histogram(differences: DataFrame, diff: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rounded differences, their counts): bounded by the places for differences of scores within [-1, 1]."""
    rows = differences.where(F.col(diff).between(-1, 1)).groupBy(F.round(diff, PLACES).alias("v")).count().orderBy("v").collect()
    return np.array([r["v"] for r in rows], float), np.array([r["count"] for r in rows], float)


def sample_size_power(differences: DataFrame, diff: str, sizes: list[int], replicates: int, alpha: float = 0.05, seed: int = 17) -> DataFrame:
    """(size, replicates, power, lower, upper, agreement, p05, median, p95) of paired tests on samples of each size.

    Samples are drawn with replacement from the counts of rounded differences, which are few whatever the table's
    size; each size and block of replicates is a task of its own. agreement: the share of samples whose mean has the
    sign of the whole.
    """
    spark = differences.sparkSession
    values, counts = _histogram(differences, diff)
    if not len(values):
        return spark.createDataFrame([], "size int, replicates bigint, power double, lower double, upper double, agreement double, p05 double, median double, p95 double")
    share, sign = counts / counts.sum(), float(np.sign((values * counts).sum()))
    critical = {n: P.t_quantile(1 - alpha / 2, n - 1) for n in sizes if n > 1}
    block = 250

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for size, k in zip(b["size"], b["block"]):
                rng = np.random.default_rng([seed, int(size), int(k)])
                for _ in range(min(block, replicates - int(k) * block)):
                    x = rng.choice(values, int(size), p=share)
                    mean, sd = x.mean(), x.std(ddof=1) if size > 1 else 0.0
                    hit = bool(sd > 0 and abs(mean) / (sd / np.sqrt(size)) > critical[int(size)])
                    out.append((int(size), float(mean), hit, bool(np.sign(mean) == sign)))
            yield pd.DataFrame(out, columns=["size", "mean", "hit", "agrees"])

    tasks = spark.createDataFrame([(n, k) for n in sizes for k in range(-(-replicates // block))], "size int, block int")
    drawn = tasks.repartition("size", "block").mapInPandas(draw, "size int, mean double, hit boolean, agrees boolean")
    q = lambda p: F.percentile("mean", p)
    g = drawn.groupBy("size").agg(F.count(F.lit(1)).alias("replicates"), F.count_if("hit").alias("hits"), F.avg(F.col("agrees").cast("double")).alias("agreement"), q(0.05).alias("p05"), q(0.5).alias("median"), q(0.95).alias("p95"))
    low, high = wilson(F.col("hits"), F.col("replicates"))
    return g.select("size", "replicates", ratio(F.col("hits"), F.col("replicates")).alias("power"), low.alias("lower"), high.alias("upper"), "agreement", "p05", "median", "p95")


def count_bootstrap(counts: DataFrame, by: list[str], replicates: int, level: float, seed: int = 5) -> DataFrame:
    """(by, upper): percentile upper bounds of the mean of -1/0/1 differences from their counts (down, up, n).

    The mean of a resample depends on the counts alone, so two binomial draws stand for it; no row is read.
    """

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for down, up, n, *name in zip(b["down"], b["up"], b["n"], *[b[c] for c in by]):
                rng = np.random.default_rng([seed, int(down), int(up), int(n)])
                losses = rng.binomial(n, down / n, replicates)
                gains = rng.binomial(n - losses, up / (n - down) if n > down else 0.0)
                out.append((*name, float(np.quantile((gains - losses) / n, level))))
            yield pd.DataFrame(out, columns=[*by, "upper"])

    kinds = dict(counts.dtypes)
    return counts.where(F.col("n") > 0).select(*by, "down", "up", "n").mapInPandas(bound, ", ".join([*(f"{c} {kinds[c]}" for c in by), "upper double"]))


def link_scores(df: DataFrame, by: list[str], truth: Column, found: Column) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1): rates are 0 where their denominators are."""
    g = df.groupBy(*by).agg(F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn"))
    safe = lambda a, b: F.round(F.coalesce(ratio(a, b), F.lit(0.0)), 6)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return g.select(*by, "tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def transition(truth: Column, before: Column, after: Column) -> Column:
    """How an error changed between two predictions: fixed, regressed, both_missed, both_false_positive; NULL if both are right."""
    return F.when((before == truth) & (after == truth), None).when(after == truth, "fixed").when(before == truth, "regressed").when(truth, "both_missed").otherwise("both_false_positive")


def rearranged(predictions: Column) -> tuple[Column, Column]:
    """(a row's quantiles in order, whether they crossed)."""
    crossed = F.exists(F.zip_with(F.slice(predictions, 1, F.size(predictions) - 1), F.slice(predictions, 2, F.size(predictions) - 1), lambda a, b: b < a), lambda x: x)
    return F.array_sort(predictions), crossed


def with_total(df: DataFrame, by: list[str], value: str, level: str) -> DataFrame:
    """df's series and their sum as one more series; `level` tells them apart."""
    total = df.groupBy(*by).agg(F.sum(value).alias(value))
    return df.select(*by, F.col(level).cast("string").alias(level), value).unionByName(total.withColumn(level, F.lit("total")).select(*by, level, value))


def hardest_negative(left: DataFrame, right: DataFrame, group: list[str], key: str, form: str, score: Column) -> DataFrame:
    """(key, hardest): the best score of each left row with a right row of its group that has another key and form; 0 without one.

    score uses the columns l_words and r_words. Pairs exist within a group only, and only their maximum leaves a task.
    """
    a = left.select(*group, F.col(key).alias("_l"), F.col(form).alias("_lf"), F.col("words").alias("l_words"))
    b = right.select(*group, F.col(key).alias("_r"), F.col(form).alias("_rf"), F.col("words").alias("r_words"))
    met = a.join(b, group).where((F.col("_l") != F.col("_r")) & (F.col("_lf") != F.col("_rf")))
    best = met.groupBy("_l").agg(F.max(score).alias("hardest"))
    return left.select(F.col(key).alias("_l")).join(best, "_l", "left").select(F.col("_l").alias(key), F.coalesce("hardest", F.lit(0.0)).alias("hardest"))


def reuse_curve(df: DataFrame, positive: str, hardest: str, grid: list[float]) -> DataFrame:
    """Top-1 reuse at each threshold: a hit is safe if the positive beats the hardest negative, else false."""
    p, h = F.col(positive), F.col(hardest)
    cells = [F.struct(F.lit(g).alias("threshold"), F.count_if((p >= g) & (p > h)).alias("true_hits"), F.count_if((h >= g) & (h >= p)).alias("false_hits"), F.count(F.lit(1)).alias("n")) for g in grid]
    rows = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    hits = F.col("true_hits") + F.col("false_hits")
    return rows.select("threshold", "true_hits", "false_hits", F.round(F.coalesce(ratio(F.col("true_hits"), hits), F.lit(1.0)), 6).alias("precision"), F.round(F.coalesce(ratio(F.col("true_hits"), F.col("n")), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(ratio(hits, F.col("n")), F.lit(0.0)), 6).alias("coverage"))


def ranked_within(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """df with place, by falling value within the group, ties by key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc(), key)))


def layout_vector(q: str, a: str, width: Column, height: Column, same_row: float = 1.5) -> dict[str, Column]:
    """Ten relative measures of two boxes (columns `<name>_x1` .. `<name>_y2`) on a page."""
    c = lambda n, k: F.col(f"{n}_{k}").cast("double")
    mid = lambda n, k: (c(n, f"{k}1") + c(n, f"{k}2")) / 2
    extent = lambda n, k: F.greatest(c(n, f"{k}2") - c(n, f"{k}1"), F.lit(1.0))
    dx, dy = (mid(a, "x") - mid(q, "x")) / F.greatest(width, F.lit(1.0)), (mid(a, "y") - mid(q, "y")) / F.greatest(height, F.lit(1.0))
    shared = F.greatest(F.lit(0.0), F.least(c(q, "x2"), c(a, "x2")) - F.greatest(c(q, "x1"), c(a, "x1")))
    return {
        "dx": dx, "dy": dy, "abs_dx": F.abs(dx), "abs_dy": F.abs(dy), "distance": F.sqrt(dx * dx + dy * dy),
        "same_row": (F.abs(mid(q, "y") - mid(a, "y")) <= F.greatest(extent(q, "y"), extent(a, "y")) * same_row).cast("double"),
        "overlap": shared / F.greatest(F.least(extent(q, "x"), extent(a, "x")), F.lit(1.0)),
        "below": (mid(a, "y") > mid(q, "y")).cast("double"), "width_ratio": extent(a, "x") / extent(q, "x"), "height_ratio": extent(a, "y") / extent(q, "y"),
    }
