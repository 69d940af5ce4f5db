"""History of changing attributes from restating snapshots, as one change log per attribute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counting_snapshots(rows: DataFrame, group: list[str], day: Column, snapshot: str) -> DataFrame:
    """(group, day, snapshot, seq, next_day): of the snapshots of a group on one day only the greatest counts.

    Partial aggregation leaves one row per group and day, so a group's window reads at most its days.
    """
    days = rows.select(*group, day.alias("day"), snapshot).where(F.col("day").isNotNull()).groupBy(*group, "day").agg(F.max(snapshot).alias(snapshot))
    by_day = Window.partitionBy(*group).orderBy("day")
    return days.select(*group, "day", snapshot, F.row_number().over(by_day).alias("seq"), F.lead("day").over(by_day).alias("next_day"))


def attribute_log(statements: DataFrame, fact: list[str], attributes: list[str]) -> DataFrame:
    """`statements` with a column `from_<a>` for each attribute: its own change log.

    The attribute's interval that a statement (one row per fact and seq) lies in began at snapshot number `from_<a>`:
    where the attribute changed (NULL equals NULL), or where the fact came back after a snapshot that left it out.
    One pass over the sorted statements of a fact; a fact has at most one row per snapshot.
    """
    w = Window.partitionBy(*fact).orderBy("seq")
    goes_on = F.coalesce(F.lag("seq").over(w) == F.col("seq") - 1, F.lit(False))
    opened = statements.withColumns({f"_new_{a}": F.when(~(goes_on & F.lag(a).over(w).eqNullSafe(F.col(a))), F.col("seq")) for a in attributes})
    logged = opened.withColumns({f"from_{a}": F.max(f"_new_{a}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for a in attributes})
    return logged.drop(*[f"_new_{a}" for a in attributes])


def history(rows: DataFrame, group: list[str], fact: list[str], snapshot: str, day: Column, attributes: list[str], row_id: str) -> DataFrame:
    """Every version of every fact: fact columns, attributes, row_id, snapshot, valid_from, valid_to, is_current.

    A snapshot of a group restates all its facts. A version starts with the snapshot that states a content (the
    attributes) which the preceding one did not state for the fact, and ends at the next one that states another or
    none; valid_to is NULL while open. row_id is the smallest one of the opening snapshot. Rows stated twice are one;
    where one snapshot states two contents of a fact, that of the smallest row_id stands. `fact` may hold NULLs,
    which name a fact like any value. Rows without a snapshot or day state nothing.

    Statements are reduced to one per fact and day before they meet the snapshots of their group. Each attribute has
    its own change log; the logs are split at the union of their boundaries by grouping on all interval starts
    together. Two neighbouring pieces always differ in an attribute, since a boundary is put only where one changes,
    so they need no further coalescing. Everything after the join is one sort by fact, linear in the statements.
    """
    names = [*group, *fact]
    f = [f"_f{i}" for i in range(len(names))]
    g = f[: len(group)]
    attrs = [f"a{i}" for i in range(len(attributes))]
    src = rows.select(*[F.col(c).alias(o) for c, o in zip(names, f)], F.col(snapshot).alias("_snap"), day.alias("_day"), F.col(row_id).alias("_id"), *[F.col(c).alias(a) for c, a in zip(attributes, attrs)])
    src = src.where(F.col("_snap").isNotNull() & F.col("_day").isNotNull())
    marks = counting_snapshots(src, g, F.col("_day"), "_snap")
    stated = src.groupBy(*f, "_day", "_snap").agg(F.min(F.struct("_id", *attrs)).alias("s"))
    on = reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in g]) & (F.col("l._day") == F.col("r.day")) & (F.col("l._snap") == F.col("r._snap"))
    met = stated.alias("l").join(marks.alias("r"), on).select(*[F.col(f"l.{c}") for c in f], "r.seq", "r.day", "r.next_day", F.col("l._snap").alias("snap"), F.col("s._id").alias("id"), *[F.col(f"s.{a}").alias(a) for a in attrs])
    logged = attribute_log(met, f, attrs)
    pieces = logged.groupBy(*f, *[f"from_{a}" for a in attrs]).agg(F.min_by(F.struct("id", "snap", "day", *attrs), "seq").alias("o"), F.max_by("next_day", "seq").alias("valid_to"))
    return pieces.select(
        *[F.col(o).alias(c) for c, o in zip(names, f)], *[F.col(f"o.{a}").alias(c) for a, c in zip(attrs, attributes)],
        F.col("o.id").alias(row_id), F.col("o.snap").alias(snapshot), F.col("o.day").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"),
    )
