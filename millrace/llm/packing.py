"""Filling containers of fixed capacity: first-fit decreasing within random groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise

#: Items that are packed together. More fill little better; the packing of a group is one task's work.
GROUP_ITEMS = 20_000


class BinTree:
    """Tournament tree of the free space of bins: finds the first bin with enough of it in log(bins) steps."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1
        while self.width < bins:
            self.width *= 2
        self.free = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """Put an item into the first bin that can hold it, and return that bin's number."""
        free, node = self.free, 1
        while node < self.width:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        leaf, node = node - self.width, node // 2
        while node:
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
            node //= 2
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes are at most the capacity. Equal sizes keep their order."""
    out = np.zeros(len(sizes), np.int64)
    tree = BinTree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = tree.place(int(sizes[i]))
    return out


def pack(items: DataFrame, item_id: str, size: str, capacity: int, seed: int = 7, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(item_id, piece, start, size, container): where each item, or each piece of a longer one, is put.

    No item is split unless it exceeds the capacity; such an item gives full pieces, each a container of its own, and
    a rest that is packed like an item. An empty item (size 0 or NULL) takes part with size 0. Repeated rows are items
    of their own. Containers are numbered by group and bin. The items are written to the shared folder, counted, and
    dealt into groups by a seeded hash of the row's place there, so that equal rows are dealt out like any others and a
    task that is run again deals as before. A group's first-fit decreasing runs in one task; the number of groups
    follows the number of items, so a task's work stays the same at any size.
    """
    kind = dict(items.dtypes)[item_id]
    rows = materialise(items.select(F.col(item_id).alias("id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size")), "sizes")
    groups = max(1, -(-rows.count() // group_items))
    place = F.xxhash64(F.lit(seed), F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    rows = rows.select("id", "size", F.pmod(place, F.lit(groups)).cast("int").alias("grp"))

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        table = table.sort_by([("id", "ascending"), ("size", "descending")])
        sizes = table["size"].to_numpy()
        full = np.where(sizes > capacity, (sizes - 1) // capacity, 0)
        rest = sizes - full * capacity
        bins = first_fit_decreasing(rest, capacity)
        own = int(bins.max(initial=-1)) + 1
        row = np.repeat(np.arange(len(sizes)), full + 1)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
        last = piece == full[row]
        numbers = np.where(last, bins[row], own + np.cumsum(~last) - 1)
        return pa.table({
            "id": table["id"].take(pa.array(row)),
            "piece": pa.array(piece.astype(np.int32)),
            "start": pa.array(piece * capacity),
            "size": pa.array(np.where(last, rest[row], capacity)),
            "container": pa.array((grp << 32) + numbers),
        })

    packed = rows.groupBy("grp").applyInArrow(fill, f"id {kind}, piece int, start bigint, size bigint, container bigint")
    return packed.select(F.col("id").alias(item_id), "piece", "start", "size", "container")
