"""Global order without a single task: range-sorted parts and per-part totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise


def _whole(kind: str) -> bool:
    return kind in ("int", "bigint", "smallint", "tinyint")


def _placed(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, dict[str, float]]:
    """(df with running sums, the sums over all rows)."""
    spark = df.sparkSession
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    rows = df.withColumns({f"_s_{n}": c for n, c in sums.items()})
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kept = materialise(placed, "ordered")
    kinds = dict(kept.dtypes)
    totals = kept.groupBy("_part").agg(*[F.sum(f"_s_{n}").alias(n) for n in sums]).orderBy("_part").collect()
    exact = {n: _whole(kinds[f"_s_{n}"]) for n in sums}
    offsets, so_far = [], [0] * len(sums)
    for r in totals:
        offsets.append((r["_part"], *[x if exact[n] else float(x) for n, x in zip(sums, so_far)]))
        so_far = [a + (b or 0) for a, b in zip(so_far, r[1:])]
    schema = "_part int, " + ", ".join(f"_o_{n} {'bigint' if exact[n] else 'double'}" for n in sums)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = kept.withColumns({n: F.sum(f"_s_{n}").over(w) for n in sums})
    out = local.join(F.broadcast(spark.createDataFrame(offsets, schema)), "_part")  # one row per range
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_part", *[f"_s_{n}" for n in sums], *[f"_o_{n}" for n in sums], *keys), dict(zip(sums, so_far))


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with one more column for each of `sums`: the running sum in the global order, its own row included.

    `order` should be total; among equals the running sum follows no settled order. Rows are range-partitioned, so
    each task sums one range; the totals of the ranges, one row each, give the offsets. An empty df stays empty. The
    plan of df runs twice, for the bounds of the ranges and for the rows: materialise a costly one before.
    """
    return _placed(df, order, sums)[0]


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """(df with its place, from 1, in the global order; the number of rows, from the totals of the ranges)."""
    out, totals = _placed(df, order, {name: F.lit(1).cast("bigint")})
    return out, int(totals[name])


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with its place, from 1, in the global order."""
    return numbered(df, order, name)[0]


def ntile(df: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """df with its tile 1..n of equal counts in the global order; the first tiles get one row more where counts differ."""
    placed, rows = numbered(df, order, "_r")
    small, more = divmod(rows, n)
    head = F.lit(more * (small + 1))
    r = F.col("_r") - 1
    tile = F.when(r < head, F.floor(r / F.lit(small + 1))).otherwise(F.lit(more) + F.floor((r - head) / F.lit(max(small, 1)))) + 1
    return placed.withColumn(name, tile.cast("int")).drop("_r")
