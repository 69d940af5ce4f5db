"""Learned scores: boosted trees, ranking by gains, uplift learners, scorecards with fit and transform; greedy routes and assignments."""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.metrics import bin_of, quantiles_of
from millrace.operators.models import weight_of_evidence
from millrace.operators.splits import balanced_sample

SEED = 7
#: Pairs of a zone that are held at once where riders meet orders.
ASSIGN_PAIRS = 1 << 21


def _ready(df: DataFrame, features: list[str]) -> DataFrame:
    """NULL and NaN as 0: trees and lines need numbers."""
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})


def fit_probability(train: DataFrame, features: list[str], y: str, trees: int = 10, depth: int = 3):
    """A model of P(y = 1): boosted trees, or a line for trees = 0. Training is distributed and reads all rows."""
    rows = _ready(train.where(F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("double")), features)
    learner = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=SEED) if trees else LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50)
    learner = learner.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), learner]).fit(rows)


def probability(model, df: DataFrame, features: list[str], name: str) -> DataFrame:
    """df with the model's probability; the features themselves stay as they are."""
    own = {f: f"_in_{f}" for f in features}
    rows = _ready(df.withColumns({k: F.col(f) for f, k in own.items()}), features)
    out = model.transform(rows).withColumn(name, vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_c")
    return out.withColumns({f: F.col(k) for f, k in own.items()}).drop(*own.values())


def importance_share(model, features: list[str]) -> dict[str, float]:
    """Each feature's share of the trees' total importance."""
    values = model.stages[-1].featureImportances.toArray()
    return dict(zip(features, (values / max(values.sum(), 1e-12)).tolist()))


def fit_gains(train: DataFrame, features: list[str], grade: str, trees: int = 10, depth: int = 3):
    """A stand-in for a listwise ranker: boosted trees on the gain 2^grade - 1."""
    rows = _ready(train.withColumn("_y", F.pow(F.lit(2.0), F.col(grade).cast("double")) - 1), features)
    learner = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_s", maxIter=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), learner]).fit(rows)


def gain_scores(model, df: DataFrame, features: list[str], name: str) -> DataFrame:
    return model.transform(_ready(df, features)).withColumnRenamed("_s", name).drop("_x")


def uplift_scores(df: DataFrame, features: list[str], y: str, treated: str, key: list[str], trees: int = 0) -> DataFrame:
    """df with the uplift of each row by four learners: u_two (a model for each arm), u_one (one model with the arm and
    its products as features), u_class (class transformation on balanced arms) and u_x (effects imputed by the other
    arm's model, then modelled and weighted by the share of the treated). Rows without arm or outcome are not learned from.
    """
    seen = df.where(F.col(y).isNotNull() & F.col(treated).isNotNull())
    arm = {a: seen.where(F.col(treated) == a) for a in (0, 1)}
    models = {a: fit_probability(arm[a], features, y, trees) for a in (0, 1)}
    out = df
    for a in (0, 1):
        out = probability(models[a], out, features, f"_p{a}")
    out = out.withColumn("u_two", F.col("_p1") - F.col("_p0"))
    # one model: the arm and its products with the features
    wide = [*features, "_arm", *[f"_arm_{f}" for f in features]]
    with_arm = lambda x, a: x.withColumns({"_arm": a, **{f"_arm_{f}": a * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}})
    one = fit_probability(with_arm(seen, F.col(treated).cast("double")), wide, y, trees)
    for a in (0, 1):
        out = probability(one, with_arm(out, F.lit(float(a))), wide, f"_s{a}")
    out = out.withColumn("u_one", F.col("_s1") - F.col("_s0")).drop("_arm", *[f"_arm_{f}" for f in features])
    # class transformation: the outcome agrees with the arm
    even = balanced_sample(seen, treated, key).withColumn("_z", (F.col(y) == F.col(treated)).cast("int"))
    out = probability(fit_probability(even, features, "_z", trees), out, features, "_zp").withColumn("u_class", 2 * F.col("_zp") - 1)
    # imputed effects, each arm by the other arm's model
    effect = {}
    for a in (0, 1):
        rows = probability(models[1 - a], arm[a], features, "_q").withColumn("_e", (F.col(y) - F.col("_q")) * (1 if a else -1))
        learner = GBTRegressor(featuresCol="_x", labelCol="_e", predictionCol=f"_e{a}", maxIter=max(trees, 5), maxDepth=3, seed=SEED)
        effect[a] = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), learner]).fit(_ready(rows, features))
    share = seen.agg(F.avg(F.col(treated).cast("double"))).first()[0] or 0.5
    plain = _ready(out.withColumns({f"_in_{f}": F.col(f) for f in features}), features)
    for a in (0, 1):
        plain = effect[a].transform(plain).drop("_x")
    plain = plain.withColumn("u_x", share * F.col("_e0") + (1 - share) * F.col("_e1")).withColumns({f: F.col(f"_in_{f}") for f in features})
    return plain.drop("_p0", "_p1", "_s0", "_s1", "_zp", "_e0", "_e1", *[f"_in_{f}" for f in features])


@dataclass(frozen=True)
class Scorecard:
    """Edges of each feature's bins and the weight of evidence of each bin, fitted on training rows."""

    edges: dict[str, list[float]]
    woe: dict[str, dict[int, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with woe_<feature>; a missing value, or a bin that training did not have, weighs 0."""
        out = df
        for f, edges in self.edges.items():
            b = F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), -1).otherwise(bin_of(F.col(f).cast("double"), edges, True))
            w = F.lit(0.0)
            for k, v in self.woe[f].items():
                w = F.when(b == k, v).otherwise(w)
            out = out.withColumn(f"woe_{f}", w)
        return out


def fit_scorecard(train: DataFrame, features: list[str], y: str, bins: int = 5) -> Scorecard:
    """Bins by the training rows' quantiles; one row per feature and bin comes to the driver."""
    cuts = quantiles_of(train, features, [k / bins for k in range(1, bins)])
    edges = {f: sorted({e for e in cuts[f] if e is not None}) for f in features}
    woe = {}
    for f in features:
        b = F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), -1).otherwise(bin_of(F.col(f).cast("double"), edges[f], True))
        woe[f] = {r["bin"]: r["woe"] for r in weight_of_evidence(train, b, y).collect()}
    return Scorecard(edges, woe)


def ngrams(words: Column) -> Column:
    """Words and neighbouring pairs of words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def pair_cosine(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of stated pairs of documents by their unit weights (doc, word, weight); 0 without a common word."""
    a = weights.select(F.col("doc").alias("a"), "word", F.col("weight").alias("wa"))
    b = weights.select(F.col("doc").alias("b"), "word", F.col("weight").alias("wb"))
    met = pairs.join(a, "a").join(b, ["b", "word"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(met, ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def greedy_routes(stops: DataFrame, capacity: float, vehicles: int, horizon: float) -> DataFrame:
    """(instance, vehicle, stop_no, id, start): routes from a depot at (0, 0), always on to the nearest stop that is feasible.

    stops: instance, id, x, y, demand, ready, due, service. Feasible: the load fits, service starts by the due time, and
    the vehicle is back within the horizon. Ties go to the earlier start, then the smaller id; what no vehicle can serve
    is left out. An instance is one task's work, as each step depends on the last.
    """

    def solve(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        left = {int(r.id): r for r in table.itertuples(index=False)}
        out = []
        for vehicle in range(1, vehicles + 1):
            x = y = now = load = 0.0
            place = 0
            while left:
                ids = np.fromiter(left, np.int64)
                rows = [left[int(i)] for i in ids]
                col = lambda n: np.array([getattr(r, n) for r in rows], float)  # noqa: E731, B023
                away = np.hypot(col("x") - x, col("y") - y)
                start = np.maximum(now + away, col("ready"))
                back = start + col("service") + np.hypot(col("x"), col("y"))
                fit = (load + col("demand") <= capacity) & (start <= col("due") + 1e-7) & (back <= horizon + 1e-7)
                if not fit.any():
                    break
                k = min(np.flatnonzero(fit).tolist(), key=lambda i: (away[i], start[i], ids[i]))
                r, place = left.pop(int(ids[k])), place + 1
                out.append((key[0], vehicle, place, int(r.id), float(start[k])))
                x, y, now, load = r.x, r.y, float(start[k]) + r.service, load + r.demand
            if not place:
                break
        return pd.DataFrame(out, columns=["instance", "vehicle", "stop_no", "id", "start"])

    kind = dict(stops.dtypes)["instance"]
    return stops.groupBy("instance").applyInPandas(solve, f"instance {kind}, vehicle int, stop_no int, id bigint, start double")


def nearest_assignments(riders: DataFrame, orders: DataFrame) -> DataFrame:
    """(zone, rider, order, distance): within each zone the closest pair left is joined, until one side is used up.

    Both sides: zone, id, x, y. Ties go to the smaller rider, then order. A zone is one task's work: distances are
    computed for one item at a time, and no more than ASSIGN_PAIRS pairs, or one for each item, are held.
    """

    def match(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("id").reset_index(drop=True), right.sort_values("id").reset_index(drop=True)
        pairs = [(key[0], int(left["id"][i]), int(right["id"][j]), d) for i, j, d in _closest_pairs(*(t[c].to_numpy(np.float64) for t in (left, right) for c in ("x", "y")))]
        return pd.DataFrame(pairs, columns=["zone", "rider", "order", "distance"])

    kind = dict(riders.dtypes)["zone"]
    return riders.groupBy("zone").cogroup(orders.groupBy("zone")).applyInPandas(match, f"zone {kind}, rider bigint, order bigint, distance double")


def _closest_pairs(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> list[tuple[int, int, float]]:
    """(left, right, distance) by place, in the order in which they are joined: the least distance, left, right of what is left.

    Each item of the smaller side has a list of its nearest of the other side; a heap holds the first of each list
    that is free. A list that is used up is made anew from what is free. NaN is beyond all distances.
    """
    turned = len(lx) > len(rx)
    ax, ay, bx, by = (rx, ry, lx, ly) if turned else (lx, ly, rx, ry)
    free, taken = np.arange(len(bx)), np.zeros(len(bx), bool)

    def nearest(a: int) -> tuple[np.ndarray, np.ndarray]:
        """The distances' bits, which order as distances do, and the places of what is nearest; ties by place."""
        nonlocal free
        if 2 * (len(bx) - len(out)) <= len(free):
            free = free[~taken[free]]
        d = np.abs(np.hypot(ax[a] - bx[free], ay[a] - by[free]))
        d[np.isnan(d)] = np.nan
        d = d.view(np.int64)
        d[taken[free]] = np.iinfo(np.int64).max
        at, size = np.arange(len(d)), max(1, ASSIGN_PAIRS // (len(ax) - len(out)))
        if size < len(d):
            last = np.partition(d, size - 1)[size - 1]
            under = np.flatnonzero(d < last)
            at = np.concatenate([under, np.flatnonzero(d == last)[: size - len(under)]])
        at = at[np.argsort(d[at], kind="stable")]
        return d[at], free[at]

    def entries(a: int) -> Iterator[tuple[int, int, int]]:
        while True:
            for k, b in zip(*nearest(a)):
                if not taken[b]:
                    yield (int(k), int(b), a) if turned else (int(k), a, int(b))

    out: list[tuple[int, int, float]] = []
    lists = [entries(a) for a in range(len(ax) if len(bx) else 0)]
    heap = [next(x) for x in lists]
    heapq.heapify(heap)
    while heap:
        k, i, j = heap[0]
        a, b = (j, i) if turned else (i, j)
        if taken[b]:
            heapq.heapreplace(heap, next(lists[a]))
            continue
        heapq.heappop(heap)
        taken[b] = True
        lists[a].close()
        out.append((i, j, float(np.int64(k).view(np.float64))))
    return out


def scoring_latency(model, df: DataFrame, features: list[str], singles: int = 20) -> dict[str, float]:
    """Milliseconds a row in one batch, and the median and 95 % point of single rows: a harness, not a query."""
    n = df.count()
    began = time.perf_counter()
    probability(model, df, features, "p").agg(F.sum("p")).collect()
    batch = 1000 * (time.perf_counter() - began)
    each = []
    for r in df.limit(singles).collect():
        one = df.sparkSession.createDataFrame([r], df.schema)
        began = time.perf_counter()
        probability(model, one, features, "p").collect()
        each.append(1000 * (time.perf_counter() - began))
    return {"rows": n, "ms_a_row": batch / max(n, 1), "p50_ms": float(np.percentile(each, 50)), "p95_ms": float(np.percentile(each, 95))}

