"""Top N items within every group: sorted runs, merged by a loser tree that stops after N outputs of a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one sorted run, runs that one merge holds, and rows of one group that are held: a task's memory.
RUN_ROWS = 1 << 19
FAN_IN = 64
HELD_ROWS = 1 << 16


class LoserTree:
    """Merge of sorted runs. Each inner node keeps the loser of its match, so the next output costs one path.

    A run is any sequence of keys; of each only what comes out, and the head after it, is looked at.
    """

    def __init__(self, runs: list[Sequence[tuple]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        self.width = max(1, len(runs))
        self.heads = [(0, r[0]) if len(r) else (1,) for r in runs] or [(1,)]
        self.losers = [-1] * self.width
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self.heads[left] <= self.heads[right] else (right, left)
        self.losers[node] = lost
        return won

    def pop(self) -> tuple | None:
        """The smallest head, or None when all runs are empty."""
        run = self.winner
        if self.heads[run][0]:
            return None
        value = self.heads[run][1]
        self.at[run] = k = self.at[run] + 1
        head = self.heads[run] = (0, self.runs[run][k]) if k < len(self.runs[run]) else (1,)
        node = (run + self.width) // 2
        while node >= 1:
            other = self.losers[node]
            if self.heads[other] < head:
                self.losers[node], run, head = run, other, self.heads[other]
            node //= 2
        self.winner = run
        return value


def merge_first(runs: list[Sequence[tuple]], n: int) -> list[tuple]:
    """The n first (key, item, ...) of the runs, each item once; what follows in the runs is not looked at."""
    if len(runs) == 1:
        return list(runs[0][:n])
    tree, out, seen = LoserTree(runs), [], set()
    while len(out) < n and (x := tree.pop()) is not None:
        if x[1] not in seen:
            seen.add(x[1])
            out.append(x)
    return out


class Run(Sequence):
    """A run as rows start..stop of columns: keys (-score, item, row), made when they are asked for."""

    def __init__(self, scores: list[float], items: list[str], start: int, stop: int) -> None:
        self.scores, self.items, self.start, self.stop = scores, items, start, stop

    def __len__(self) -> int:
        return self.stop - self.start

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        row = self.start + i
        return -self.scores[row], self.items[row], row


def _first_rows(table: pa.Table, groups: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the n first of each group of a table that is ordered by group, run and place.

    A group of one run is cut by its place; a group of several is merged, and the merge seeks to the next group after
    n outputs, whatever is left in the runs.
    """
    new = _changes(table, groups)
    run = new | _changes(table, ["run"])
    begins, runs = np.flatnonzero(new), np.flatnonzero(run)
    ends = np.append(begins[1:], table.num_rows)
    per = np.diff(np.append(np.searchsorted(runs, begins), len(runs)))
    at = np.arange(table.num_rows) - np.repeat(begins, ends - begins)
    alone = np.flatnonzero(np.repeat(per == 1, ends - begins) & (at < n))
    rows, places = [alone], [at[alone] + 1]
    if (per > 1).any():
        scores, items = table["score"].to_pylist(), table["item"].to_pylist()
        stops = np.append(runs[1:], table.num_rows).tolist()
        starts, first = runs.tolist(), np.searchsorted(runs, begins)
        for g in np.flatnonzero(per > 1).tolist():
            left = [Run(scores, items, starts[k], stops[k]) for k in range(first[g], first[g] + per[g])]
            while len(left) > FAN_IN:
                left = [merge_first(left[k : k + FAN_IN], n) for k in range(0, len(left), FAN_IN)]
            best = merge_first(left, n)
            rows.append(np.array([x[2] for x in best], np.int64))
            places.append(np.arange(1, len(best) + 1))
    return np.concatenate(rows), np.concatenate(places)


def _changes(table: pa.Table, cols: list[str]) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in cols:
        col = table[c].combine_chunks()
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return new


def _run(batches: list[pa.RecordBatch], groups: list[str], n: int, run: int) -> pa.RecordBatch:
    """One sorted run: each item once with its best score, the first n of each group."""
    best = pa.Table.from_batches(batches).group_by([*groups, "item"], use_threads=False).aggregate([("score", "max")]).rename_columns([*groups, "item", "score"])
    order = pc.sort_indices(best, sort_keys=[*((g, "ascending") for g in groups), ("score", "descending"), ("item", "ascending")])
    best = best.take(order)
    first = _changes(best, groups)
    at = np.arange(best.num_rows)
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    keep = place < n
    best = best.filter(pa.array(keep)).append_column("run", pa.array(np.full(int(keep.sum()), run))).append_column("place", pa.array(place[keep].astype(np.int32)))
    return best.combine_chunks().to_batches()[0] if best.num_rows else best.schema.empty_table().to_batches(max_chunksize=1)


def top_n_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """group columns, item, score, place (1 is best): the n items of each group with the highest scores.

    An item's score in a group is its highest; of equal scores the smaller item, by bytes, goes first. Rows with a
    NULL group column, item or score, or a NaN score, do not count; -0.0 equals 0.0. The item is text. Groups with
    fewer items come out whole. Other columns of df are ignored, whatever their names.

    Each task sorts what it reads into runs and keeps the n first items of each group in a run, so that a group sends
    at most n rows a run over the network, however large it is. An item left out of a run is beaten there by n others
    and can't be among the n of the whole group. The runs meet in buckets by hash of the group, ordered by group and
    run; a loser tree merges the runs of a group, at most FAN_IN at a time, and seeks to the next group after n
    outputs. Spark sorts a bucket by group and run, as its shuffle does not keep the order in which runs were written.
    """
    names = [f"g{i}" for i in range(len(groups))]
    kinds = dict(df.dtypes)
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    for g in groups:
        rows = rows.where(F.col(g).isNotNull())
    rows = rows.select(*[F.col(g).alias(a) for g, a in zip(groups, names)], F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    key = ", ".join(f"{a} {kinds[g]}" for g, a in zip(groups, names))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, made = 0, 0
        part = TaskContext.get().partitionId()  # the same for a task that is run again
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= RUN_ROWS:
                yield _run(held, names, n, (part << 20) + made)
                held, count, made = [], 0, made + 1
        if count:
            yield _run(held, names, n, (part << 20) + made)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that goes on in the next batch

        def cut(table: pa.Table) -> pa.RecordBatch:
            rows, places = _first_rows(table, names, n)
            out = table.select([*names, "item", "score"]).take(pa.array(rows)).append_column("place", pa.array(places.astype(np.int32)))
            return out.combine_chunks().to_batches(max_chunksize=max(1, out.num_rows))[0] if out.num_rows else out.schema.empty_table().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*held, b]).combine_chunks()
            last = int(np.flatnonzero(_changes(table, names))[-1])
            if last:
                yield cut(table.slice(0, last))
            rest = table.slice(last).combine_chunks()
            if rest.num_rows > max(HELD_ROWS, 2 * n):  # a group of very many runs: what was read of it becomes one
                best, places = _first_rows(rest, names, n)
                rest = rest.take(pa.array(best)).set_column(rest.schema.get_field_index("run"), "run", pa.array(np.full(len(best), rest["run"][0].as_py())))
                rest = rest.set_column(rest.schema.get_field_index("place"), "place", pa.array((places - 1).astype(np.int32)))
            held = rest.to_batches()
        if held:
            yield cut(pa.Table.from_batches(held))

    sorted_runs = rows.mapInArrow(runs, f"{key}, item string, score double, run bigint, place int")
    buckets = sorted_runs.repartition(*names).sortWithinPartitions(*names, "run", "place")
    merged = buckets.mapInArrow(merge, f"{key}, item string, score double, place int")
    return merged.select(*[F.col(a).alias(g) for g, a in zip(groups, names)], F.col("item").alias(item), F.col("score").alias(score), "place")
