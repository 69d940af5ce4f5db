"""Deterministic samples, splits and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import hash_fraction
from millrace.operators.ordered import numbered


def hash_sample(df: DataFrame, key: str, modulus: int, offset: int) -> DataFrame:
    """Rows with crc32(key) mod modulus = offset."""
    return df.where(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == offset)


def chronological_split(df: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """df with part: train for the first floor(n * fraction) rows in order, test for the rest."""
    placed, n = numbered(df, [F.col(c).asc() for c in order], "_r")
    return placed.withColumn("part", F.when(F.col("_r") <= math.floor(n * fraction), "train").otherwise("test")).drop("_r")


def expanding_folds(df: DataFrame, month: str, months: list[str], least: int) -> DataFrame:
    """(fold, part, rows): a fold validates on one month and trains on all before it, if there are `least` of them."""
    per = df.groupBy(F.date_format(month, "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    folds = df.sparkSession.createDataFrame([(m,) for m in months], "fold string")
    j = per.join(F.broadcast(folds), F.col("m") <= F.col("fold"))  # both one row per month
    ok = j.groupBy("fold").agg(F.count_if(F.col("m") < F.col("fold")).alias("k"), F.sum(F.when(F.col("m") < F.col("fold"), F.col("n"))).alias("train"), F.sum(F.when(F.col("m") == F.col("fold"), F.col("n"))).alias("valid"))
    return ok.where(F.col("k") >= least).select("fold", F.col("train").alias("n_train"), F.coalesce("valid", F.lit(0)).alias("n_valid"))


def rolling_folds(total_days: int, horizon: int, count: int) -> list[tuple[int, int, int]]:
    """(fold, first day, last day) of `count` test windows of `horizon` days, the last one ending with the data."""
    return [(i + 1, total_days - (count - i) * horizon + 1, total_days - (count - i - 1) * horizon) for i in range(count)]


def group_split(df: DataFrame, group: str, share: float) -> DataFrame:
    """df with part: whole groups go to test by the hash of their key."""
    return df.withColumn("part", F.when(hash_fraction(F.col(group)) < share, "test").otherwise("train"))


def first_by_hash(df: DataFrame, stratum: list[str], key: list[str], limit: Column | int) -> DataFrame:
    """At most `limit` rows of each stratum, those of the smallest hash: a sample that any engine repeats."""
    w = Window.partitionBy(*stratum).orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), *key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def top_fraction(df: DataFrame, score: str, key: list[str], fraction: float) -> DataFrame:
    """The ceil(n * fraction) rows of the highest score, ties by key."""
    placed, n = numbered(df, [F.col(score).desc(), *[F.col(k).asc() for k in key]], "_r")
    return placed.where(F.col("_r") <= math.ceil(n * fraction)).drop("_r")


def evenly_spaced(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """`size` rows at places round(i (n-1) / (size-1)) of the order, halves to even."""
    placed, n = numbered(df, [F.col(c).asc() for c in order], "_r")
    at = sorted({round(i * (n - 1) / (size - 1)) + 1 for i in range(size)}) if size > 1 and n else [1]
    return placed.where(F.col("_r").isin(at)).drop("_r")


def grouped_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups by falling size are dealt to folds in turn; ties by group."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(sizes, [F.col("n").desc(), F.col(group).asc()], "_r")[0]
    return placed.select(group, "n", ((F.col("_r") - 1) % k).cast("int").alias("fold"))


def _by_hash(key: list[str]) -> list[Column]:
    return [F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), *[F.col(k) for k in key]]


def stratified_sample(df: DataFrame, stratum: str, key: list[str], size: int, anchors: Column) -> DataFrame:
    """`size` rows, as many of each stratum as of any other, with all anchors among them.

    Strata have size // k places, the first (by name) size % k of them one more. Anchors take places of their stratum
    before the rows of the smallest hash do; more anchors than places are all kept.
    """
    names = [r[0] for r in df.select(stratum).distinct().orderBy(stratum).collect()]  # one row per stratum
    quota = df.sparkSession.createDataFrame([(n, size // len(names) + (i < size % len(names))) for i, n in enumerate(names)] or [(None, 0)], f"_s {dict(df.dtypes)[stratum]}, _q bigint")
    w = Window.partitionBy(stratum).orderBy(F.coalesce(anchors, F.lit(False)).desc(), *_by_hash(key))
    ranked = df.withColumn("_r", F.row_number().over(w)).join(F.broadcast(quota), F.col(stratum).eqNullSafe(F.col("_s")))
    return ranked.where((F.col("_r") <= F.col("_q")) | F.coalesce(anchors, F.lit(False))).drop("_r", "_s", "_q")


def balanced_sample(df: DataFrame, label: str, key: list[str], most: int | None = None) -> DataFrame:
    """As many rows of each label as of the rarest, at most `most` in all: those of the smallest hash."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count"), F.count(F.lit(1))).first()  # one row per label
    each = counts[0] or 0
    each = min(each, most // max(counts[1], 1)) if most is not None else each
    return first_by_hash(df.where(F.col(label).isNotNull()), [label], key, each)


def stratified_holdout(df: DataFrame, stratum: list[str], key: list[str], share: float) -> DataFrame:
    """df with part: of each stratum floor(n * share + 0.5) rows, those of the smallest hash, are test."""
    sizes = df.groupBy(*stratum).agg(F.floor(F.count(F.lit(1)) * share + 0.5).alias("_q"))
    w = Window.partitionBy(*stratum).orderBy(*_by_hash(key))
    ranked = df.withColumn("_r", F.row_number().over(w)).join(F.broadcast(sizes), stratum)  # one row per stratum
    return ranked.withColumn("part", F.when(F.col("_r") <= F.col("_q"), "test").otherwise("train")).drop("_r", "_q")


def day_list_split(df: DataFrame, day: Column, parts: dict[str, list[str]]) -> DataFrame:
    """df with part by lists of days; the lists must not overlap and follow each other in time. Other days are left out."""
    lists = list(parts.values())
    if any(max(a) >= min(b) for a, b in zip(lists, lists[1:])):
        raise ValueError("the days of a part must lie before those of the next")
    part = F.lit(None).cast("string")
    for name, days in parts.items():
        part = F.when(day.cast("string").isin(days), name).otherwise(part)
    return df.withColumn("part", part).where(F.col("part").isNotNull())


def slice_in_order(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 .. offset+limit of the order."""
    placed = numbered(df, order, "_r")[0]
    return placed.where((F.col("_r") > offset) & (F.col("_r") <= offset + limit)).drop("_r")


def label_slice(df: DataFrame, label: str, value: object, key: list[str], offset: int, limit: int) -> DataFrame:
    """A slice of one label's rows in the order of their hash."""
    return slice_in_order(df.where(F.col(label) == value), _by_hash(key), offset, limit)
