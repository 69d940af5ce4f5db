"""Attributes as known at event time: periodic as-known snapshots and the changes since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise

#: Changes of an entity within a period that a snapshot is meant to spare: a period is shortened beyond it.
REPLAY = 64
#: Snapshots are broadcast up to this many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
_ENTRY_BYTES = 48


def _log(entries: DataFrame, entity: Column, version: str, valid_from: str, valid_to: str, recorded: str) -> DataFrame:
    """(entity, at, version, since, until, gone): an entry is known from `at` until the next one with its `since` is recorded."""
    log = entries.select(entity.alias("entity"), F.col(recorded).alias("at"), F.col(version).alias("version"), F.col(valid_from).alias("since"), F.col(valid_to).alias("until"))
    log = log.where(F.col("entity").isNotNull() & F.col("at").isNotNull() & F.col("since").isNotNull()).distinct()
    return log.withColumn("gone", F.lead("at").over(Window.partitionBy("entity", "since").orderBy("at", "version")))


def period_for(entries: DataFrame, entity: Column, recorded: str, most: int = REPLAY) -> str:
    """The longest of year, quarter and month in which no entity has more than `most` changes; else month."""
    months = entries.where(entity.isNotNull() & F.col(recorded).isNotNull()).groupBy(entity.alias("entity"), F.date_trunc("month", recorded).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    for unit in ("year", "quarter"):
        top = months.groupBy("entity", F.date_trunc(unit, "m")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if (top or 0) <= most:
            return unit
    return "month"


def snapshots(entries: DataFrame, entity: Column, version: str, valid_from: str, valid_to: str, recorded: str, period: str = "year") -> DataFrame:
    """(entity, period, next_period, snapshot, changes), for each period in which something of the entity was recorded.

    snapshot holds, for each valid_from of the entity, the entry that was known when the period began; changes holds
    the entries recorded within it. Of entries with one valid_from the one recorded last (of equal times: the
    greatest version) is known. Entries without entity, valid_from or record time never apply and are left out;
    repeated ones are one. The table is written to the shared folder, so that every use reads the same snapshots.
    """
    log = _log(entries, entity, version, valid_from, valid_to, recorded).withColumn("period", F.date_trunc(period, "at").cast("timestamp_ntz"))
    entry = F.struct("at", "version", "since", "until", "gone")
    changes = log.groupBy("entity", "period").agg(F.array_sort(F.collect_list(entry)).alias("changes"))
    following = F.lead("period").over(Window.partitionBy("entity").orderBy("period"))
    spans = changes.withColumn("next_period", following)
    # an entry stands in the snapshots of its entity's later periods that begin while it is known
    own = spans.groupBy("entity").agg(F.collect_list("period").alias("periods"))
    later = F.filter("periods", lambda p: (p > F.col("period")) & (F.col("gone").isNull() | (p <= F.col("gone"))))
    carried = log.join(own, "entity").withColumn("period", F.explode(later)).groupBy("entity", "period").agg(F.collect_list(entry).alias("snapshot"))
    empty = F.array().cast(carried.schema["snapshot"].dataType)
    return materialise(spans.join(carried, ["entity", "period"], "left").select("entity", "period", "next_period", F.coalesce("snapshot", empty).alias("snapshot"), "changes"), "snapshots")


def as_known(events: DataFrame, event_id: str, entity: Column, ts: str, snaps: DataFrame, period: str = "year", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(event_id, version) for each event whose entity has an entry that holds and was known at the event's time.

    An entry holds if since <= date of ts and until is NULL or later. Of several the one with the latest since.
    Each event meets one row, the entity's preceding snapshot, and replays only the changes recorded up to its time;
    nothing recorded later is seen. Events without entity or time have no case; repeated events come out repeatedly.

    A snapshot stands until the entity's next one: the span is unrolled to one row per period, up to the last period
    of any snapshot, to which later events are set back; so the match is an equality and the events are read once.
    The unrolled snapshots are broadcast up to `broadcast_bytes` (summed over their entries); beyond that they are
    joined by a shuffle, where adaptive skew splitting divides a hot entity.
    """
    last = snaps.agg(F.max("period").alias("p")).first()["p"]  # one row
    rows = events.select(F.col(event_id).alias("event_id"), entity.alias("entity"), F.col(ts).alias("ts")).where(F.col("ts").isNotNull() & F.col("entity").isNotNull())
    top = F.lit(last).cast("timestamp_ntz")
    step = F.expr(f"interval 1 {period}")
    spans = snaps.select("entity", "snapshot", "changes", F.explode(F.sequence("period", F.coalesce(F.col("next_period") - step, top), step)).alias("period"))
    size = spans.agg(F.sum(F.size("snapshot") + F.size("changes") + 2).alias("n")).first()["n"] or 0
    spans = F.broadcast(spans) if size * _ENTRY_BYTES <= broadcast_bytes else spans
    met = rows.withColumn("period", F.least(F.date_trunc(period, "ts").cast("timestamp_ntz"), top)).join(spans, ["entity", "period"])
    day = F.to_date("ts")
    known = lambda e: (e["at"] <= F.col("ts")) & (e["gone"].isNull() | (e["gone"] > F.col("ts")))
    holds = F.filter(F.concat("snapshot", "changes"), lambda e: known(e) & (e["since"] <= day) & (e["until"].isNull() | (e["until"] > day)))
    best = F.array_max(F.transform(holds, lambda e: F.struct(e["since"].alias("since"), e["version"].alias("version"))))
    return met.select("event_id", best["version"].alias("version")).where(F.col("version").isNotNull())
