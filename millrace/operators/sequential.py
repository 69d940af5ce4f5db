"""State machines over ordered rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], init: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, tuple]], out: str) -> DataFrame:
    """df's keys and order with the columns `out` that `step` gives for each row in order.

    Rows are sorted within their partition and streamed, one state at a time in memory: a key may be of any length.
    step(state, row) returns the next state and the row's output.
    """
    cols = df.columns
    names = [x.split()[0] for x in out.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            rows = b.to_pylist()
            outs = []
            for r in rows:
                k = tuple(r[c] for c in keys)
                if k != key:
                    key, state = k, init()
                state, o = step(state, r)
                outs.append(o)
            arrays = [pa.array(c, t) for c, t in zip(zip(*outs) if outs else [[] for _ in types], types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *names])

    schema = ", ".join([*(f"{c} {t}" for c, t in df.dtypes), out])
    return df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def token_bucket(df: DataFrame, key: str, ts: str, row_id: str, capacity: float, per_second: float) -> DataFrame:
    """df's rows with allowed and tokens left. A bucket starts full, refills by time and gives one token a row."""

    def step(state: tuple[float, float] | None, row: dict) -> tuple[tuple[float, float], tuple]:
        now = row["_s"]
        left = capacity if state is None else min(capacity, state[0] + (now - state[1]) * per_second)
        ok = left >= 1.0 - 1e-9
        left -= ok
        return (left, now), (bool(ok), float(left))

    rows = df.where(F.col(ts).isNotNull()).select(F.col(key), F.col(row_id), F.col(ts).cast("timestamp").cast("double").alias("_s"))
    return fold_in_order(rows, [key], ["_s", row_id], lambda: None, step, "allowed boolean, tokens double").drop("_s")


def circuit_breaker(df: DataFrame, key: str, ts: str, row_id: str, failed: Column, failures: int = 3, open_seconds: float = 2.0) -> DataFrame:
    """df's rows with the breaker's state when each call came: CLOSED, OPEN (rejected) or HALF_OPEN (a probe)."""

    def step(state: tuple[str, int, float], row: dict) -> tuple[tuple[str, int, float], tuple]:
        name, count, since = state
        if name == "OPEN":
            if row["_s"] - since < open_seconds:
                return state, ("OPEN",)
            return (("OPEN", failures, row["_s"]) if row["_bad"] else ("CLOSED", 0, 0.0)), ("HALF_OPEN",)
        count = count + 1 if row["_bad"] else 0
        return (("OPEN", count, row["_s"]) if count >= failures else ("CLOSED", count, 0.0)), ("CLOSED",)

    rows = df.where(F.col(ts).isNotNull()).select(F.col(key), F.col(row_id), F.col(ts).cast("timestamp").cast("double").alias("_s"), F.coalesce(failed, F.lit(False)).alias("_bad"))
    return fold_in_order(rows, [key], ["_s", row_id], lambda: ("CLOSED", 0, 0.0), step, "state string").drop("_s", "_bad")


def budget_replay(df: DataFrame, key: str, order: list[str], price: str, budget: float) -> DataFrame:
    """df's rows with taken and spent: a row is taken if its price still fits the budget; dearer ones are skipped, later cheaper ones may follow."""

    def step(spent: float, row: dict) -> tuple[float, tuple]:
        p = row[price]
        ok = p is not None and spent + p <= budget + 1e-9
        spent += p if ok else 0.0
        return spent, (bool(ok), float(spent))

    return fold_in_order(df, [key], order, lambda: 0.0, step, "taken boolean, spent double")


def cache_replay(df: DataFrame, scope: list[str], prefix_scope: list[str], ts: str, row_id: str, request: str, vector: str | None, ttl_seconds: float, threshold: float = 0.95) -> DataFrame:
    """(row_id, level, matched, similarity) of requests against a cache of three tiers.

    exact: the same request (case and spacing apart) is alive in the scope. semantic: the nearest alive vector of the
    scope reaches the cosine threshold; matched is the row that stored it. prefix: something of the prefix scope is
    alive. Else miss. A prefix hit and a miss are answered anew and stored in all tiers, each for its time to live; a
    hit stores nothing. A version in the scopes isolates answers of another version: to invalidate one is to leave its
    scope (`alive_entries` counts what is dropped). Rows without time are left out; a NULL vector has no semantic tier.

    The prefix scope must be part of the scope: rows meet in its order. A scope's requests are inherently sequential,
    since hits depend on earlier misses; its state is what is alive, dropped from a queue by time, and the prefix
    scope is one task's stream.
    """
    from collections import OrderedDict

    wide = [c for c in scope if c not in prefix_scope]

    def init() -> dict:
        return {"warm": float("-inf"), "exact": OrderedDict(), "near": {}}

    def step(state: dict, row: dict) -> tuple[dict, tuple]:
        now, key = row["_s"], tuple(row[c] for c in wide)
        exact = state["exact"]
        while exact:  # the first stored ends first
            first = next(iter(exact))
            if exact[first][0] > now:
                break
            del exact[first]
        asked = (key, " ".join((row[request] or "").casefold().split()))
        if asked in exact:
            return state, ("exact", exact[asked][1], 1.0)
        mine = None
        if vector and row[vector] is not None:
            v = np.asarray(row[vector], np.float64)
            norm = float(np.linalg.norm(v))
            mine = v / norm if norm > 0 else None
        held = state["near"].setdefault(key, [])
        while held and held[0][0] <= now:
            held.pop(0)
        if mine is not None and held:
            near = np.stack([h[2] for h in held]) @ mine
            best = int(near.argmax())
            if near[best] >= threshold:
                return state, ("semantic", held[best][1], float(near[best]))
        level = "prefix" if state["warm"] > now else "miss"
        until = now + ttl_seconds
        exact.pop(asked, None)
        exact[asked] = (until, row[row_id])
        if mine is not None:
            held.append((until, row[row_id], mine))
        state["warm"] = until
        return state, (level, None, None)

    extra = [vector] if vector else []
    rows = df.where(F.col(ts).isNotNull()).select(*prefix_scope, *wide, row_id, request, *extra, F.col(ts).cast("timestamp").cast("double").alias("_s"))
    out = fold_in_order(rows, prefix_scope, ["_s", row_id], init, step, "level string, matched bigint, similarity double")
    return out.select(row_id, "level", "matched", "similarity")


def alive_entries(replayed: DataFrame, version: Column, ts: str, ttl_seconds: float, at: Column) -> DataFrame:
    """(version, n): what invalidating each version drops at an instant: stored answers that are still alive."""
    stored = replayed.where(F.col("level").isin("miss", "prefix") & (F.col(ts) <= at) & (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 + ttl_seconds > F.unix_micros(at.cast("timestamp")) / 1e6))
    return stored.groupBy(version.alias("version")).agg(F.count(F.lit(1)).alias("n"))


def replay_cost(replayed: DataFrame, tokens_in: Column, tokens_out: Column, jitter: Column, price: tuple[float, float], discount: float, delays: dict[str, float]) -> DataFrame:
    """replayed with base and actual cost and delay: a hit costs nothing, a prefix hit has cheaper input and a head start.

    delays: base, per_token, exact, semantic, prefix_saving, cache_jitter (milliseconds).
    """
    made = lambda share: (tokens_in * share * price[0] + tokens_out * price[1]) / 1e6
    base_ms = delays["base"] + tokens_out * delays["per_token"] + jitter
    hit, warm = F.col("level").isin("exact", "semantic"), F.col("level") == "prefix"
    quick = F.when(F.col("level") == "exact", delays["exact"]).otherwise(delays["semantic"]) + jitter % delays["cache_jitter"]
    return replayed.withColumns({
        "base_cost": made(1.0), "cost": F.when(hit, 0.0).when(warm, made(1.0 - discount)).otherwise(made(1.0)),
        "base_ms": base_ms, "ms": F.when(hit, quick).when(warm, base_ms - delays["prefix_saving"]).otherwise(base_ms),
    })


def replay_summary(costed: DataFrame, false_hit: Column) -> DataFrame:
    """One row: hits by tier, false semantic hits, cost and delay saved."""
    n, of = F.count(F.lit(1)), lambda *levels: F.count_if(F.col("level").isin(*levels))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    semantic, false = of("semantic"), F.count_if((F.col("level") == "semantic") & false_hit)
    q = lambda c, p: F.round(F.percentile(c, p), 4)
    return costed.agg(
        n.alias("n"), *[of(x).alias(f"n_{x}") for x in ("exact", "semantic", "prefix", "miss")], share(of("exact", "semantic"), n).alias("hit_rate"), share(of("exact", "semantic", "prefix"), n).alias("assist_rate"),
        false.alias("n_false"), F.coalesce(share(semantic - false, semantic), F.lit(1.0)).alias("precision"), F.round(F.sum("base_cost"), 6).alias("base_cost"), F.round(F.sum("cost"), 6).alias("cost"),
        F.round(1 - F.sum("cost") / F.nullif(F.sum("base_cost"), F.lit(0.0)), 6).alias("cost_saved"), q("base_ms", 0.5).alias("base_p50"), q("ms", 0.5).alias("p50"), q("base_ms", 0.95).alias("base_p95"), q("ms", 0.95).alias("p95"),
    )


def waiting_queue(df: DataFrame, key: str, ts: str, row_id: str, capacity: float, per_second: float, patience: float) -> DataFrame:
    """df's rows with allowed, waited (seconds) and tokens left: a token bucket with a queue, first come, first served.

    A request waits for its token behind all that wait before it; one that cannot get it within `patience` seconds
    leaves when they are over and takes none. Closed form on the bucket's level: a granted wait lets it go below zero.
    """

    def step(state: tuple[float, float] | None, row: dict) -> tuple[tuple[float, float], tuple]:
        now = row["_s"]
        level = capacity if state is None else min(capacity, state[0] + (now - state[1]) * per_second)
        wait = max(0.0, (1.0 - level) / per_second)
        ok = wait < patience or wait == 0.0
        level -= ok
        return (level, now), (bool(ok), float(wait if ok else patience), float(level))

    rows = df.where(F.col(ts).isNotNull()).select(F.col(key), F.col(row_id), F.col(ts).cast("timestamp").cast("double").alias("_s"))
    return fold_in_order(rows, [key], ["_s", row_id], lambda: None, step, "allowed boolean, waited double, tokens double").drop("_s")


def failover(df: DataFrame, key: list[str], ts: str, row_id: str, outcomes: str, providers: list[str], attempts: int = 2, failures: int = 3, open_seconds: float = 2.0) -> DataFrame:
    """(row_id, provider, tries, failed_over): each request goes to the providers in order until one answers.

    outcomes: an array of status codes, one per provider. 200 answers; 5xx, or NULL for none, is tried again up to
    `attempts` times and counts against the provider's breaker, which opens after `failures` in a row and lets one
    call through after `open_seconds`; 4xx goes on to the next provider at once. provider is NULL where none answers.
    """

    def step(state: dict, row: dict) -> tuple[dict, tuple]:
        now, tries = row["_s"], 0
        for i, name in enumerate(providers):
            count, since = state.get(name, (0, 0.0))
            if count >= failures and now - since < open_seconds:
                continue
            code = row[outcomes][i] if row[outcomes] and i < len(row[outcomes]) else None
            for _ in range(attempts):
                tries += 1
                if code == 200:
                    state[name] = (0, 0.0)
                    return state, (name, tries, i > 0)
                if code is not None and 400 <= code < 500:
                    break
                count += 1
                state[name] = (count, now)
                if count >= failures:
                    break
        return state, (None, tries, False)

    rows = df.where(F.col(ts).isNotNull()).select(*key, row_id, outcomes, F.col(ts).cast("timestamp").cast("double").alias("_s"))
    out = fold_in_order(rows, key, ["_s", row_id], dict, step, "provider string, tries int, failed_over boolean")
    return out.select(row_id, "provider", "tries", "failed_over")


def checked_order(order: list[str], providers: list[str]) -> list[str]:
    """The order, if it names every provider exactly once."""
    if sorted(order) != sorted(providers):
        raise ValueError("a route order must name every provider exactly once")
    return list(order)


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, measures: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, side, and both sums of each measure, matches): two ledgers by key; side tells where a key is missing."""
    a = ours.groupBy(key).agg(*[F.sum(m).alias(f"{m}_ours") for m in measures], F.lit(True).alias("_a"))
    b = theirs.groupBy(key).agg(*[F.sum(m).alias(f"{m}_theirs") for m in measures], F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    side = F.when(F.col("_b").isNull(), "ours").when(F.col("_a").isNull(), "theirs").otherwise("both")
    same = F.lit(True)
    for m in measures:
        same = same & (F.abs(F.coalesce(f"{m}_ours", F.lit(0)) - F.coalesce(f"{m}_theirs", F.lit(0))) <= tolerance)
    return j.select(key, side.alias("side"), *[c for m in measures for c in (f"{m}_ours", f"{m}_theirs")], ((side == "both") & same).alias("matches"))


def paced_replay(df: DataFrame, key: str, ts: str, row_id: str, bid: str, price: str, budget: float, gain: float = 1.25, bounds: tuple[float, float] = (0.05, 3.0)) -> DataFrame:
    """(row_id, multiplier, taken, spent): bids follow the spend through the day.

    A bid is multiplied by 1 + gain * (even spend so far - spend) / (budget / 24), within bounds; a row is taken if its
    bid reaches the price and the price still fits the budget. Each key's day starts anew.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        day, spent = state if state and state[0] == row["_day"] else (row["_day"], 0.0)
        error = (budget * row["_part"] - spent) / max(budget / 24, 1e-12)
        m = min(max(1 + gain * error, bounds[0]), bounds[1])
        p, b = row[price], row[bid]
        ok = p is not None and b is not None and b * m >= p and spent + p <= budget + 1e-9
        spent += p if ok else 0.0
        return (day, spent), (float(m), bool(ok), float(spent))

    t = F.col(ts).cast("timestamp_ntz")
    part = (F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600) / 24
    rows = df.where(F.col(ts).isNotNull()).select(key, row_id, F.col(bid).cast("double").alias(bid), F.col(price).cast("double").alias(price), F.to_date(ts).cast("string").alias("_day"), part.cast("double").alias("_part"), F.col(ts).cast("timestamp").cast("double").alias("_s"))
    out = fold_in_order(rows, [key], ["_s", row_id], tuple, step, "multiplier double, taken boolean, spent double")
    return out.select(row_id, "multiplier", "taken", "spent")


def reservations(df: DataFrame, key: str, order: list[str], row_id: str, cost: str, limit: float) -> DataFrame:
    """(row_id, granted, reserved): a running reservation before each call; one that would pass the limit is refused and takes nothing."""
    taken = budget_replay(df.select(key, *order, F.col(cost).cast("double").alias(cost), *([row_id] if row_id not in order else [])), key, order, cost, limit)
    return taken.select(row_id, F.col("taken").alias("granted"), F.col("spent").alias("reserved"))


def state_machine(df: DataFrame, key: str, order: list[str], row_id: str, event: str, moves: dict[tuple[str, str], str], start: str, most_steps: int, costs: tuple[str, float] | None = None, halted: str = "HALTED") -> DataFrame:
    """(row_id, state, accepted, steps): the state of each key after each event.

    moves: (state, event) to the next state; any other event is refused and changes nothing. A key that has taken
    `most_steps` steps, or whose accepted costs (column, ceiling) would pass their ceiling, halts for good.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        at, steps, spent = state
        to = moves.get((at, row[event]))
        if at == halted or to is None:
            return state, (at, False, steps)
        price = float(row[costs[0]] or 0.0) if costs else 0.0
        if steps >= most_steps or (costs and spent + price > costs[1] + 1e-9):
            return (halted, steps, spent), (halted, False, steps)
        return (to, steps + 1, spent + price), (to, True, steps + 1)

    extra = [costs[0]] if costs else []
    rows = df.select(key, *order, *[c for c in (row_id, event, *extra) if c not in order])
    return fold_in_order(rows, [key], order, lambda: (start, 0, 0.0), step, "state string, accepted boolean, steps bigint").select(row_id, "state", "accepted", "steps")


def compare_and_swap(df: DataFrame, key: str, order: list[str], row_id: str, expected: str, command: str) -> DataFrame:
    """(row_id, outcome, revision): writes that name the revision they saw.

    stored: it is the current one, which goes up by one; repeated: the same command was stored before, nothing happens
    (so a retry is harmless); conflict: any other.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, tuple]:
        revision, done = state
        if row[command] in done:
            return state, ("repeated", revision)
        if row[expected] != revision:
            return state, ("conflict", revision)
        return (revision + 1, done | {row[command]}), ("stored", revision + 1)

    rows = df.select(key, *order, *[c for c in (row_id, expected, command) if c not in order])
    return fold_in_order(rows, [key], order, lambda: (0, frozenset()), step, "outcome string, revision bigint").select(row_id, "outcome", "revision")


def single_use(uses: DataFrame, tickets: DataFrame, order: list[str]) -> DataFrame:
    """uses with valid: a ticket counts once, for the exact action that it was issued for, and not before it was issued.

    uses: ticket, action, and the columns of order, the first a time; tickets: ticket (unique), action, issued. Of the
    uses that fit, the first in order takes the ticket.
    """
    from pyspark.sql import Window

    t = tickets.select("ticket", F.col("action").alias("_action"), F.col("issued").alias("_issued"))
    met = uses.join(t, "ticket", "left").withColumn("_fits", F.coalesce((F.col("action") == F.col("_action")) & (F.col(order[0]) >= F.col("_issued")), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("ticket", "_fits").orderBy(*order))
    return met.withColumn("valid", F.col("_fits") & (first == 1)).drop("_action", "_issued", "_fits")
