"""References to keys that do not exist, by as-of match against contiguous runs of parent keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import norm_id
from millrace.session import shuffle_partitions

#: Rows of references and parents that a bucket is meant to hold: a task's memory. A bucket with more than HOT times
#: as many references is salted.
BUCKET_ROWS = 1 << 20
HOT = 2
NEVER = np.iinfo(np.int64).max


def key_bytes(key: Column, kind: str = "string") -> Column:
    """A key as sixteen bytes, a big-endian integer of 128 bits.

    Whole numbers keep their order and distance. 32 hexadecimal digits are read as that number; any other text
    stands as its MD5 sum, which keeps equality but makes no runs.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.unhex(F.concat(F.lit("0" * 16), F.lpad(F.hex(key.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")))
    text = norm_id(key)
    return F.unhex(F.when(text.rlike(r"^[0-9a-f]{32}\z"), text).otherwise(F.md5(text)))


def key_runs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct keys: the place of each run's first key, and the runs' lengths."""
    if not len(hi):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1] + np.uint64(1))) + 1
    starts = np.concatenate([[0], breaks])
    return starts, np.diff(np.concatenate([starts, [len(hi)]]))


def _words(keys: pa.ChunkedArray) -> np.ndarray:
    flat = b"".join(keys.to_pylist())
    return np.frombuffer(flat, ">u8").reshape(-1, 2).astype(np.uint64)


def _micros(col: pa.ChunkedArray) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NEVER).to_numpy()


def _match(refs: pa.Table, spans: pa.Table) -> np.ndarray:
    """0 held, 1 missing, 2 late, 3 deleted, for each reference of a bucket against the bucket's parent lifetimes."""
    out = np.ones(refs.num_rows, np.int8)
    if not spans.num_rows or not refs.num_rows:
        return out
    words, since, until = _words(spans["_key"]), _micros(spans["_since"]), _micros(spans["_until"])
    order = np.lexsort((since, words[:, 1], words[:, 0]))
    words, since, until = words[order], since[order], until[order]
    new = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(new)]])
    # the latest end of any lifetime that began by then, within each key
    codes, rank = np.unique(until, return_inverse=True)
    best = codes[np.maximum.accumulate((np.cumsum(new) - 1) * len(codes) + rank) % len(codes)]
    hi, lo = words[first, 0], words[first, 1]
    starts, lengths = key_runs(hi, lo)
    # as-of match: the run that starts at or before the reference
    ref, at = _words(refs["_key"]), _micros(refs["_at"])
    run_keys = np.ascontiguousarray(words[first][starts].astype(">u8")).view("S16").ravel()
    run = np.searchsorted(run_keys, np.ascontiguousarray(ref.astype(">u8")).view("S16").ravel(), side="right") - 1
    there = np.flatnonzero(run >= 0)
    run = run[there]
    beyond = ref[there, 1] - lo[starts[run]]
    there, run, beyond = (x[(ref[there, 0] == hi[starts[run]]) & (ref[there, 1] >= lo[starts[run]]) & (beyond < lengths[run].astype(np.uint64))] for x in (there, run, beyond))
    key = starts[run] + beyond.astype(np.int64)
    # the last lifetime of that key that began by the reference's time, by bisection of all references at once
    low, high, when = first[key].copy(), last[key].copy(), at[there]
    while (low < high).any():
        mid = (low + high) // 2
        begun = (since[np.minimum(mid, len(since) - 1)] <= when) & (low < high)
        low, high = np.where(begun, mid + 1, low), np.where(begun | (low >= high), high, mid)
    known = low > first[key]
    alive = known & (best[np.maximum(low - 1, 0)] > when)
    untimed = when == NEVER
    out[there] = np.where(alive | untimed, 0, np.where(known, 3, 2))
    return out


def orphan_references(
    child: DataFrame, ids: list[str], ref: str, at: str, parent: DataFrame, key: str, since: str, until: str | None = None
) -> DataFrame:
    """One row for each child whose reference does not hold: its ids, its time `at` and kind.

    Child rows with equal ids are one, at their earliest time; its reference is the earliest one that is not NULL or
    empty (of equal times: the smallest). A reference holds if a parent row with that key has since <= at and until NULL or > at. Otherwise
    kind is `missing` (no parent row has the key), `late` (every such row began after the time) or `deleted`.
    NULL and empty references are none. A child without any time is judged by existence only; a parent row without a
    begin has the key but never began. Ids that are text are trimmed and put in lower case.

    Parent rows shrink to one lifetime per key and end before they are shuffled; keys are cut into buckets, each
    bucket's sorted keys into contiguous runs. The number of buckets follows the counted rows of both sides (and is
    at least spark.sql.shuffle.partitions), so a bucket stays of one size at any scale. A bucket with many references
    is salted: its references are dealt out and its parents repeated, so a hot key is spread over tasks.
    """
    spark = child.sparkSession
    kinds = dict(child.dtypes)
    n = max(shuffle_partitions(spark), -(-(child.count() + parent.count()) // BUCKET_ROWS))

    def own(c: str) -> Column:
        return norm_id(c) if kinds[c] == "string" else F.col(c)

    bucket = F.pmod(F.crc32("_key"), F.lit(n)).cast("int").alias("_bucket")
    present = F.col(ref).isNotNull() & (F.btrim(F.col(ref).cast("string"), F.lit(" \t")) != "")
    some = child.where(present)
    counts = some.select(key_bytes(F.col(ref), kinds[ref]).alias("_key")).select(bucket).groupBy("_bucket").count()
    full = counts.where(F.col("count") > HOT * BUCKET_ROWS).collect()  # at most one row for HOT * BUCKET_ROWS references
    salts = [(r["_bucket"], -(-r["count"] // BUCKET_ROWS)) for r in full]

    # one row per child at its earliest time
    refs = child.select(*[own(c).alias(f"_{i}") for i, c in enumerate(ids)], F.when(present, key_bytes(F.col(ref), kinds[ref])).alias("_key"), F.col(at).alias("_at"))
    names = [f"_{i}" for i in range(len(ids))]
    first = F.min(F.when(F.col("_key").isNotNull(), F.struct(F.col("_at").isNull(), "_at", "_key"))).alias("_first")
    refs = refs.groupBy(*names).agg(first, F.min("_at").alias("_at")).where(F.col("_first").isNotNull()).select(*names, "_first._key", "_at")
    refs = refs.select("*", bucket)
    ends = parent.where(F.col(key).isNotNull()).select(
        key_bytes(F.col(key), dict(parent.dtypes)[key]).alias("_key"), F.col(since).alias("_since"), (F.col(until) if until else F.lit(None).cast(dict(parent.dtypes)[since])).alias("_until")
    )
    # of lifetimes with one end only the longest counts; one that never began is kept apart by its NULL
    ends = ends.groupBy("_key", "_until").agg(F.min("_since").alias("_since")).select("_key", "_since", "_until", bucket)
    if salts:
        hot = F.broadcast(spark.createDataFrame(salts, "_bucket int, _salts bigint"))  # the hot buckets
        refs = refs.join(hot, "_bucket", "left").withColumn("_salt", F.pmod(F.hash(*names), F.coalesce("_salts", F.lit(1)))).drop("_salts")
        ends = ends.join(hot, "_bucket", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    else:
        refs, ends = refs.withColumn("_salt", F.lit(0)), ends.withColumn("_salt", F.lit(0))
    fields = [f"{nm} {t}" for nm, t in refs.select(*names, "_at").dtypes]
    labels = pa.array(["", "missing", "late", "deleted"])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        verdict = _match(left, right)
        keep = np.flatnonzero(verdict)
        kept = left.select([*names, "_at"]).take(pa.array(keep))
        return kept.append_column("kind", labels.take(pa.array(verdict[keep].astype(np.int64))))

    found = refs.groupBy("_bucket", "_salt").cogroup(ends.groupBy("_bucket", "_salt")).applyInArrow(judge, ", ".join([*fields, "kind string"]))
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(ids)], F.col("_at").alias(at), "kind")
