"""Joins and comparisons in time: as of an instant, as-of matches, revisions of facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, day: Column) -> DataFrame:
    """Versions that hold on a day: valid_from <= day < valid_to, valid_to NULL while open."""
    return versions.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))


def as_of_match(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, strict: bool = True) -> DataFrame:
    """left with `<value>_ts` and `<value>`: the last row of right with the same key before (or at) each left row's time.

    Of right rows at one time the greatest value counts. A key's history is cut by day: the last value of each day is
    carried over later days by a window of one row per day, and rows meet within their day only, so a hot key is
    spread over its days. Rows without key or time match nothing; left rows are all kept.
    """
    ev = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col(value).alias("_v"))
    ours = left.withColumn("_day", F.to_date(ts))
    days = ev.groupBy("_k", F.to_date("_t").alias("_day")).agg(F.max(F.struct("_t", "_v")).alias("last"))
    marks = days.unionByName(ours.where(F.col(key).isNotNull() & F.col("_day").isNotNull()).select(F.col(key).alias("_k"), "_day").distinct().withColumn("last", F.lit(None).cast(days.schema["last"].dataType)))
    marks = marks.groupBy("_k", "_day").agg(F.max("last").alias("last"))
    before = Window.partitionBy("_k").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    carried = marks.withColumn("_carry", F.last("last", ignorenulls=True).over(before)).select("_k", "_day", "_carry")
    cols = left.columns
    a = ours.select(*cols, F.col(key).alias("_k"), F.col(ts).alias("_t"), "_day", F.lit(1).alias("_side"), F.lit(None).cast(days.schema["last"].dataType).alias("_r"))
    b = ev.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], "_k", "_t", F.to_date("_t").alias("_day"), F.lit(0).alias("_side"), F.struct("_t", "_v").alias("_r"))
    both = a.unionByName(b)
    # strictly before: at equal times our rows come first
    w = Window.partitionBy("_k", "_day").orderBy("_t", F.col("_side").desc() if strict else F.col("_side").asc(), F.col("_r").asc()).rowsBetween(Window.unboundedPreceding, -1)
    local = both.withColumn("_in_day", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    met = local.join(carried, (local["_k"] == carried["_k"]) & (local["_day"] == carried["_day"]), "left")
    hit = F.coalesce("_in_day", "_carry")
    return met.select(*[local[c] for c in cols], hit["_t"].alias(f"{value}_ts"), hit["_v"].alias(value + "_before"))


def compare_facts(old: DataFrame, new: DataFrame, key: list[str], attributes: list[str], by: list[str]) -> DataFrame:
    """(by, changed, added, removed, comparable): facts of two snapshots by key; NULL equals NULL."""
    on = reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    o, n = old.withColumn("_in", F.lit(True)).alias("o"), new.withColumn("_in", F.lit(True)).alias("n")
    j = o.join(n, on, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"o.{a}").eqNullSafe(F.col(f"n.{a}")) for a in attributes])
    both = F.col("o._in").isNotNull() & F.col("n._in").isNotNull()
    return j.groupBy(*[F.coalesce(F.col(f"n.{b}"), F.col(f"o.{b}")).alias(b) for b in by]).agg(
        F.count_if(both & ~same).alias("changed"), F.count_if(F.col("o._in").isNull()).alias("added"), F.count_if(F.col("n._in").isNull()).alias("removed"), F.count_if(both).alias("comparable")
    )


def load_revision(state: DataFrame, filing: DataFrame, key: list[str], attributes: list[str], day: Column) -> DataFrame:
    """The next state of a bitemporal table: rows kept, rows closed on `day`, rows opened on `day`.

    state: key, attributes, valid_from, valid_to; filing: key, attributes, restating every fact. A filing that states
    the same again changes nothing, so loading it twice is loading it once.
    """
    open_, closed = state.where(F.col("valid_to").isNull()), state.where(F.col("valid_to").isNotNull())
    on = reduce(lambda x, y: x & y, [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key])
    j = open_.withColumn("_in", F.lit(True)).alias("s").join(filing.withColumn("_in", F.lit(True)).alias("f"), on, "full_outer")
    same = F.col("s._in").isNotNull() & F.col("f._in").isNotNull() & reduce(lambda x, y: x & y, [F.col(f"s.{a}").eqNullSafe(F.col(f"f.{a}")) for a in attributes])
    cols = [*key, *attributes]
    old = j.where(F.col("s._in").isNotNull()).select(*[F.col(f"s.{c}") for c in cols], "s.valid_from", F.when(same, F.lit(None)).otherwise(day).cast("date").alias("valid_to"))
    new = j.where(F.col("f._in").isNotNull() & ~same).select(*[F.col(f"f.{c}") for c in cols], day.cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return closed.select(*cols, "valid_from", "valid_to").unionByName(old).unionByName(new)


def latest_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what a table shows that is overwritten. A pre-aggregated maximum, no sort."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])
