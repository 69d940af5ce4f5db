"""Checked joins and feature building from related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: empty if the key is unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join that fails when either side repeats a key."""
    for name, side in (("left", left), ("right", right)):
        if repeated_keys(side, key).limit(1).count():
            raise ValueError(f"{name} side repeats keys of {key}")
    return left.join(right, key, "left")


def aggregate_features(df: DataFrame, key: str, numbers: list[str], prefix: str) -> DataFrame:
    """MEAN, MIN, MAX, SUM of numeric columns and the record count by key, named PREFIX_COLUMN_STAT; the sum of nothing is 0."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_COUNT")]
    for c in numbers:
        up = f"{prefix}_{c}".upper()
        aggs += [F.round(F.avg(c), 6).alias(f"{up}_MEAN"), F.min(c).alias(f"{up}_MIN"), F.max(c).alias(f"{up}_MAX"), F.round(F.coalesce(F.sum(c), F.lit(0)), 4).alias(f"{up}_SUM")]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def missing_rates(df: DataFrame) -> DataFrame:
    """(column, rate): share of NULL (or NaN) of every column, in one pass."""
    gone = lambda c, t: F.col(c).isNull() | F.isnan(c) if t in ("double", "float") else F.col(c).isNull()
    one = df.agg(*[F.avg(gone(c, t).cast("double")).alias(c) for c, t in df.dtypes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(c), 6).alias("rate")) for c in df.columns])).alias("x")).select("x.*")


def vocabulary(train: DataFrame, col: str, least: int, top: int) -> DataFrame:
    """(level, code, n): the most frequent levels of the training rows by (-count, level); others have no code."""
    n = train.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = n.orderBy(F.col("n").desc(), "level").limit(top)
    w = Window.orderBy(F.col("n").desc(), "level")  # at most `top` rows
    return kept.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def encode(df: DataFrame, col: str, vocab: DataFrame, out: str) -> DataFrame:
    """df with the level's code; a level not in the vocabulary, or NULL, gets the number of levels. The vocabulary is at most its `top` rows."""
    size = vocab.count()
    v = vocab.select(F.col("level").alias(col), F.col("code").alias(out))
    return df.join(F.broadcast(v), col, "left").withColumn(out, F.coalesce(out, F.lit(size)))
