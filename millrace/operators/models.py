"""Scorecards, calibration models, term weights, signed ranks and cost curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import ratio
from millrace.operators.ordered import with_running_sums


def weight_of_evidence(df: DataFrame, label: Column, y: str, smooth: float = 0.5) -> DataFrame:
    """(bin, n, bad, woe, iv) by bin label; counts are smoothed so that an empty class has a finite weight."""
    g = df.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("bad"))
    w = Window.partitionBy(F.lit(1))  # one row per bin
    bad = (F.col("bad") + smooth) / (F.sum("bad").over(w) + smooth)
    good = (F.col("n") - F.col("bad") + smooth) / (F.sum(F.col("n") - F.col("bad")).over(w) + smooth)
    return g.select("bin", "n", "bad", F.log(good / bad).alias("woe"), ((good - bad) * F.log(good / bad)).alias("iv"))


def points(probability: Column, base: float = 600.0, odds: float = 50.0, double: float = 20.0) -> Column:
    """Score points of a default probability: `base` at good:bad `odds`, `double` more points at twice the odds."""
    import math

    factor = double / math.log(2)
    return F.lit(base - factor * math.log(odds)) + factor * F.log((1 - probability) / probability)


def platt(df: DataFrame, y: str, p: str) -> DataFrame:
    """df with platt: a logistic regression of y on the log odds of p."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = VectorAssembler(inputCols=["_z"], outputCol="_x").transform(df.withColumns({"_z": F.log(q / (1 - q)), "_y": F.col(y).cast("double")}))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=50, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(rows)
    return model.transform(rows).withColumn("platt", vector_to_array("_p")[1]).drop("_z", "_y", "_x", "_p", "_r", "_c")


def isotonic(df: DataFrame, y: str, p: str) -> DataFrame:
    """df with isotonic: the monotone step function of p that fits y best, fitted on one row per distinct score."""
    from pyspark.ml.regression import IsotonicRegression

    per = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("_x")).agg(F.avg(F.col(y).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="isotonic").fit(per)
    return model.transform(df.withColumn("_x", F.col(p).cast("double"))).drop("_x")


def tfidf(docs: DataFrame) -> DataFrame:
    """(doc, word, weight): 1 + ln tf times smoothed idf, of unit length by document. docs: doc, words."""
    n = docs.count()
    tf = docs.select("doc", F.explode("words").alias("word")).groupBy("doc", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "word").select("doc", "word", ((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc").select("doc", "word", (F.col("w") / F.col("norm")).alias("weight"))


def signed_ranks(df: DataFrame, diff: str) -> DataFrame:
    """One row: Wilcoxon's sums of average ranks of positive and negative differences, zeros left out."""
    x = df.where(F.col(diff) != 0).groupBy(F.round(F.abs(F.col(diff)), 9).alias("a")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(diff) > 0).alias("p"))
    c = with_running_sums(x, [F.col("a").asc()], {"c": F.col("n")})
    rank = F.col("c") - (F.col("n") - 1) / 2.0
    return c.agg(F.coalesce(F.sum(F.col("p") * rank), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("n") - F.col("p")) * rank), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def tune_scale(df: DataFrame, break_even: Column, price: str, key: str, target: float) -> DataFrame:
    """One row: the greatest scale whose won auctions together cost no more than the target, and that cost.

    An auction is won from its break-even scale on, so the cost at a scale is a running sum in that order.
    """
    x = df.where(F.col(price).isNotNull()).groupBy(break_even.alias("scale")).agg(F.sum(price).alias("_c"))
    c = with_running_sums(x, [F.col("scale").asc()], {"cost": F.col("_c")})
    return c.where(F.col("cost") <= target).agg(F.max("scale").alias("scale"), F.max("cost").alias("cost"))


def cutoff_curve(df: DataFrame, p: str, quality: tuple[str, str], cost: tuple[float, float], grid: list[float]) -> DataFrame:
    """(cutoff, share, quality, cost): rows with p at or above the cutoff go to the second option."""
    up = lambda g: F.col(p) >= g
    cells = [F.struct(F.lit(g).alias("cutoff"), F.avg(up(g).cast("double")).alias("share"), F.avg(F.when(up(g), F.col(quality[1])).otherwise(F.col(quality[0]))).alias("quality"), F.sum(F.when(up(g), cost[1]).otherwise(cost[0])).alias("cost")) for g in grid]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def check_routes(stops: DataFrame, speed: float, capacity: float) -> DataFrame:
    """(route, load, lateness, feasible): each route's stops in order with travel, waiting and service.

    stops: route, stop_no, x, y, demand, ready, due, service. Arrival is a fold along the route's stops.
    """
    s = F.array_sort(F.collect_list(F.struct("stop_no", "x", "y", "demand", "ready", "due", "service")))
    g = stops.groupBy("route").agg(s.alias("s"), F.sum("demand").alias("load"))
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("late"))

    def step(a: Column, b: Column) -> Column:
        arrive = a["t"] + F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)) / speed
        begin = F.greatest(arrive, b["ready"].cast("double"))
        return F.struct((begin + b["service"]).alias("t"), b["x"].cast("double").alias("x"), b["y"].cast("double").alias("y"), (a["late"] + F.greatest(begin - b["due"], F.lit(0.0))).alias("late"))

    end = F.aggregate("s", start, step)
    return g.select("route", "load", F.round(end["late"], 6).alias("lateness"), F.round(end["t"], 6).alias("finish")).withColumn("feasible", (F.col("lateness") == 0) & (F.col("load") <= capacity))


def routing_rates(rows: DataFrame) -> DataFrame:
    """Failure attribution in order of precedence: nothing relevant found, answer wrong, success. rows: found, right."""
    kind = F.when(~F.col("found"), "retrieval").when(~F.col("right"), "generation").otherwise("success")
    return rows.groupBy(kind.alias("cause")).agg(F.count(F.lit(1)).alias("n"))
