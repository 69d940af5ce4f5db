"""Per-entity feature tables from events, by cumulative daily totals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import norm_id
from millrace.session import materialise_bucketed

NULL_KIND = "NULL"


def distinct_activities(events: DataFrame, entity: str, item: str, kind: str, ts: str, value: str, before: datetime | None = None) -> DataFrame:
    """(entity, kind, ts, item, value): one row for each activity.

    Rows alike in entity, item, kind and ts are one activity; its value is the greatest one that is not NULL.
    Rows without an entity or a time are no activities. A NULL kind or item is a value of its own.
    Text is compared without outer blanks and letter case. Columns besides the five named ones are ignored.
    """
    rows = events.select(
        norm_id(entity).alias("entity"),
        norm_id(kind).alias("kind"),
        F.col(ts).alias("ts"),
        norm_id(item).alias("item"),
        F.col(value).alias("value"),
    ).where(F.col("entity").isNotNull() & F.col("ts").isNotNull())
    if before is not None:
        rows = rows.where(F.col("ts") < F.lit(before).cast(events.schema[ts].dataType))
    return rows.groupBy("entity", "kind", "ts", "item").agg(F.max("value").alias("value"))


def daily_cumulative(activities: DataFrame) -> DataFrame:
    """The store: cumulative count and total, and latest activity, by entity, kind and day.

    A day holds one row per entity and kind, summed before the shuffle, so a running sum reads at most
    one row per day of history, however many events the busiest entity has.
    """
    days = activities.groupBy("entity", "kind", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.max(F.struct("ts", F.coalesce("item", F.lit("")).alias("item"))).alias("latest"),
    )
    so_far = Window.partitionBy("entity", "kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        "entity",
        "kind",
        "day",
        F.sum("n").over(so_far).alias("cum_n"),
        F.sum(F.coalesce("total", F.lit(0))).over(so_far).alias("cum_total"),
        F.max("latest").over(so_far).alias("latest"),
    )


def feature_store(activities: DataFrame) -> DataFrame:
    """The cumulative store, written once: any number of instants and windows are endpoints read from it.

    It is bucketed by entity and kind, as its running sums left it, so that reading endpoints needs no shuffle.
    """
    return materialise_bucketed(daily_cumulative(activities), "feature_store", ["entity", "kind"], ["day"])


def _endpoint(what: Column, day: Column) -> Column:
    """The stored figure of the last day before `day`; no such day: NULL."""
    return F.max_by(what, F.when(F.col("day") < day, F.col("day")))


def features_as_of(store: DataFrame, as_of: datetime, windows: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """One row per entity and kind with an activity before midnight of `as_of`.

    n and total are endpoints of the cumulative store; n_30d is the difference of two endpoints, and so on.
    last_ts and last_item are those of the latest activity (of equal times: the greatest item).
    The instant must be a midnight: the store is by day.
    """
    if as_of.time() != datetime.min.time():
        raise ValueError("as_of must be a midnight; the store holds whole days")
    end = F.lit(as_of.date())
    aggs = [
        _endpoint(F.col("cum_n"), end).alias("n"),
        _endpoint(F.col("cum_total"), end).alias("total"),
        _endpoint(F.col("latest"), end).alias("latest"),
    ]
    for days in windows:
        start = F.date_sub(end, days)
        aggs += [_endpoint(F.col("cum_n"), start).alias(f"_n{days}"), _endpoint(F.col("cum_total"), start).alias(f"_t{days}")]
    ends = store.where(F.col("day") < end).groupBy("entity", "kind").agg(*aggs)
    out = [F.col("entity"), F.col("kind"), F.col("n"), F.col("total"), F.col("latest.ts").alias("last_ts"), F.col("latest.item").alias("last_item")]
    for days in windows:
        out += [
            (F.col("n") - F.coalesce(f"_n{days}", F.lit(0))).alias(f"n_{days}d"),
            (F.col("total") - F.coalesce(f"_t{days}", F.lit(0))).alias(f"total_{days}d"),
        ]
    return ends.select(*out)


def feature_table(cells: DataFrame, as_of: datetime) -> DataFrame:
    """One row per entity: a map from kind to its count, recency in days and totals.

    A map holds hundreds of kinds without a column for each; its size is bounded by the number of kinds. The NULL kind
    has the key NULL in capitals, which no kind has: kinds are in lower case.
    """
    fields = [c for c in cells.columns if c not in ("entity", "kind", "last_ts")]
    cell = F.struct(*fields, "last_ts", F.date_diff(F.lit(as_of.date()), F.to_date("last_ts")).alias("recency_days"))
    return cells.groupBy("entity").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("kind", F.lit(NULL_KIND)).alias("key"), cell.alias("value"))))).alias("features"),
        F.sum("n").alias("n_all"),
        F.max("last_ts").alias("last_ts"),
    )
