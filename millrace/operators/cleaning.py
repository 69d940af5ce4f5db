"""Cleaning of values and columns: sentinels, infinities, time texts, spans, sparse and forbidden columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import missing_rates

# Fixed value: the token that stands for a missing category.
MISSING = "__MISSING__"


def finite(c: Column) -> Column:
    """NULL for NaN and infinite values."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def reserved(c: Column, token: str = MISSING) -> Column:
    return F.coalesce(c, F.lit(token))


def month_period(c: Column) -> Column:
    """YYYY-MM of a text such as Jan-2018; NULL for any other text."""
    return F.date_format(F.try_to_timestamp(c, F.lit("MMM-yyyy")), "yyyy-MM")


def hour_stamp(c: Column) -> dict[str, Column]:
    """Day, hour and weekday (Monday is 0) of a text YYMMDDHH; NULL for what is no such time."""
    day = F.try_to_timestamp(F.concat(F.lit("20"), F.substring(c, 1, 6)), F.lit("yyyyMMdd")).cast("date")
    hour = F.substring(c, 7, 2).try_cast("int")
    sound = (F.length(c) == 8) & hour.between(0, 23)
    return {"day": F.when(sound, day), "hour": F.when(sound, hour), "weekday": F.when(sound, F.weekday(day))}


def day_fraction(c: Column) -> Column:
    """Elapsed share of a day of a text HHMMSS."""
    part = lambda at: F.substring(c, at, 2).try_cast("double")
    return (part(1) + part(3) / 60 + part(5) / 3600) / 24


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 6e7


def joined_text(cols: list[str], most: int) -> Column:
    """The non-empty trimmed texts joined by blanks, at most `most` characters."""
    return F.substring(F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in cols]), 1, most)


def check_columns(df: DataFrame, allowed: set[str], forbidden: set[str]) -> DataFrame:
    """df, or an error that names the columns that are forbidden or not allowed."""
    wrong = sorted(c for c in df.columns if c in forbidden or c not in allowed)
    if wrong:
        raise ValueError(f"columns that may not be used: {', '.join(wrong)}")
    return df


def sparse_columns(train: DataFrame, threshold: float, at_threshold: bool) -> DataFrame:
    """(column, rate) of columns whose missing rate exceeds the threshold, or reaches it."""
    rates = missing_rates(train)
    return rates.where(F.col("rate") >= threshold if at_threshold else F.col("rate") > threshold)


def drop_sparse(train: DataFrame, others: list[DataFrame], threshold: float, at_threshold: bool = False) -> list[DataFrame]:
    """train and others without the columns that are too sparse in train: one row per column is looked at."""
    gone = [r["column"] for r in sparse_columns(train, threshold, at_threshold).collect()]
    return [df.drop(*gone) for df in (train, *others)]


def later_only(train: DataFrame, test: DataFrame, ts: str) -> DataFrame:
    """One row: last month of train, first month of test, and whether the former lies before the latter."""
    a = train.agg(F.date_format(F.max(ts), "yyyy-MM").alias("last_train"), F.lit(1).alias("k"))
    b = test.agg(F.date_format(F.min(ts), "yyyy-MM").alias("first_test"), F.lit(1).alias("k"))
    return a.join(b, "k").select("last_train", "first_test", F.coalesce(F.col("last_train") < F.col("first_test"), F.lit(False)).alias("passes"))  # one row each


def audit(df: DataFrame, rules: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, n, n_sound, and for each rule the rows that break it); a rule that is NULL is broken."""
    held = {n: F.coalesce(r, F.lit(False)) for n, r in rules.items()}
    sound = reduce(lambda a, b: a & b, held.values())
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(sound).alias("n_sound"), *[F.count_if(~r).alias(f"broke_{n}") for n, r in held.items()])


def peak_share(df: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, n, share, peak): a histogram, with the share of each bucket and whether it is the largest (ties: the first)."""
    h = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.sum("n").alias("t"), F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("top"))
    return h.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), (F.col("bucket") == F.col("top")).alias("peak"))  # one row


def order_audit(df: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """(part, n, backward): rows whose value is below that of the row before them in the part's order."""
    from pyspark.sql import Window

    w = Window.partitionBy(part).orderBy(order)
    return df.withColumn("_before", F.lag(value).over(w)).groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < F.col("_before")).alias("backward"))
