"""Queries of metrics, drift and statistics and their SQL.

Truth and score come from lineitem: a line is positive if it was returned, its score a mix of quantity and tax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.sources.tables import table

GRID = [round(0.05 * i, 2) for i in range(1, 20)]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def scored(s: SparkSession, d: str) -> DataFrame:
    p = F.round(0.8 * F.col("l_quantity") / 50 + F.col("l_tax"), 4)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), p.alias("p"))


def roc_auc(s, d):
    return M.roc_auc(scored(s, d), "y", "p")


def pr_auc(s, d):
    return M.pr_auc(scored(s, d), "y", "p")


def log_loss_brier(s, d):
    return M.log_loss_brier(scored(s, d), "y", "p")


def calibration_bins(s, d):
    b = M.calibration_bins(scored(s, d), "y", "p")
    return b.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


def calibration_error(s, d):
    return M.calibration_error(M.calibration_bins(scored(s, d), "y", "p"))


def equal_count_curve(s, d):
    return M.equal_count_curve(scored(s, d), "y", "p", ["l_orderkey", "l_linenumber"], 7)


def threshold_curve(s, d):
    return M.confusion(scored(s, d), "y", "p", GRID)


def cost_threshold(s, d):
    return M.cheapest(threshold_curve(s, d))


def select_threshold(s, d):
    return M.select_threshold(threshold_curve(s, d), 0.3, 50, 0.003)


def _early(s, d):
    last = table(s, d, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0
    return F.col("l_orderkey") <= int(last * 0.8)


def psi_hist(s, d):
    return M.psi_table(M.psi(table(s, d, "lineitem"), FEATURES, _early(s, d), right=False, missing=False))


def psi_missing(s, d):
    gaps = table(s, d, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    return M.psi_table(M.psi(gaps, FEATURES, _early(s, d), right=True, missing=True))


def psi_summary(s, d):
    return M.psi_summary(psi_hist(s, d))


def wilson_by_status(s, d):
    g = scored(s, d).groupBy("l_linestatus").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return g.select("l_linestatus", "k", "n", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


def holm_by_line(s, d):
    """One-sided normal tests of each line number's rate against the whole, Holm-adjusted."""
    x = scored(s, d)
    share = x.agg(F.avg("y")).first()[0] or 0.0
    t = x.groupBy("l_linenumber").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    z = (F.col("m") - share) / F.sqrt(F.lit(share * (1 - share)) / F.col("n"))
    # a logistic stand-in for the normal tail, the same in SQL
    p = F.round(1 / (1 + F.exp(F.abs(z) * 1.702)) * 2, 6)
    h = M.holm(t.select(F.col("l_linenumber").alias("test"), p.alias("p")), "test", "p", 0.05)
    return h.select("test", "p", F.round("p_adjusted", 6).alias("p_adjusted"), "rejected")


def pinball_coverage(s, d):
    l = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = l.groupBy("p_brand").agg(*[F.percentile("l_quantity", F.lit(x)).alias(f"q{int(x * 100)}") for x in (0.1, 0.5, 0.9)])
    j = l.join(q, "p_brand")
    y = F.col("l_quantity")
    return j.groupBy("p_brand").agg(*[F.round(F.avg(M.pinball(y, F.col(f"q{int(x * 100)}"), x)), 6).alias(f"pinball_{int(x * 100)}") for x in (0.1, 0.5, 0.9)], F.round(F.avg(y.between(F.col("q10"), F.col("q90")).cast("int")), 6).alias("coverage"), F.round(F.sqrt(F.avg(F.pow(y - F.col("q50"), 2))), 6).alias("rmse"))


def poisson_bootstrap(s, d):
    """Twenty bootstrap means of the returned share, each row weighted by a hash of row and replicate."""
    x = scored(s, d).select("l_orderkey", "l_linenumber", "y", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("replicate"))
    w = M.poisson_weight(M.hash_fraction(F.col("l_orderkey"), F.col("l_linenumber"), F.col("replicate")))
    return x.groupBy("replicate").agg(F.sum(w).alias("weight"), F.round(M.ratio(F.sum(w * F.col("y")), F.sum(w)), 6).alias("mean"))


def segment_accuracy(s, d):
    x = scored(s, d).withColumn("right", ((F.col("p") >= 0.4).cast("int") == F.col("y")).cast("int"))
    g = x.rollup("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))
    return g.select(F.coalesce("l_linestatus", F.lit("all")).alias("segment"), "n", "accuracy")


def cohen_kappa(s, d):
    return M.cohen_kappa(scored(s, d).withColumn("z", (F.col("p") >= 0.4).cast("int")), "y", "z")


def spearman(s, d):
    return M.spearman(table(s, d, "lineitem"), "l_quantity", "l_extendedprice")


def exact_quantiles(s, d):
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    values = M.quantiles(table(s, d, "orders"), "o_totalprice", probs)
    return s.createDataFrame([(p, None if v is None else round(v, 4)) for p, v in zip(probs, values)], "prob double, value double")


QUERIES = {f.__name__: f for f in (roc_auc, pr_auc, log_loss_brier, calibration_bins, calibration_error, equal_count_curve, threshold_curve, cost_threshold, select_threshold, psi_hist, psi_missing, psi_summary, wilson_by_status, holm_by_line, pinball_coverage, poisson_bootstrap, segment_accuracy, cohen_kappa, spearman, exact_quantiles)}

_S = "x AS (SELECT l_orderkey, l_linenumber, l_linestatus, CAST(l_returnflag = 'R' AS integer) AS y, round(0.8 * l_quantity / 50 + l_tax, 4) AS p FROM lineitem)"
_CURVE = f"""{_S}, g AS (SELECT unnest([{', '.join(map(str, GRID))}]) AS t),
c AS (SELECT CAST(t AS double) AS threshold, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn, count(*) FILTER (WHERE p < t AND y = 0) AS tn FROM g, x GROUP BY 1),
curve AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, CAST(fp * 1.0 + fn * 10.0 AS double) AS cost FROM c)"""


def _psi_sql(gaps: bool) -> str:
    tax = "CASE WHEN l_linenumber <> 3 THEN l_tax END" if gaps else "l_tax"
    by_value = "count(DISTINCT v) FILTER (WHERE early) <= 10" if gaps else "false"
    op = ">" if gaps else ">="
    keep = "" if gaps else "WHERE v IS NOT NULL"
    return f"""raw AS (SELECT *, l_orderkey <= (SELECT CAST(floor(max(l_orderkey) * 0.8) AS bigint) FROM lineitem) AS early FROM lineitem),
long AS (SELECT early, 'l_quantity' AS feature, CAST(l_quantity AS double) AS v FROM raw UNION ALL SELECT early, 'l_extendedprice', l_extendedprice FROM raw UNION ALL SELECT early, 'l_discount', l_discount FROM raw UNION ALL SELECT early, 'l_tax', {tax} FROM raw),
e AS (SELECT feature, {by_value} AS by_value, list_sort(list_distinct(quantile_cont(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) FILTER (WHERE early))) AS edges FROM long GROUP BY 1),
b AS (SELECT l.feature, early, CASE WHEN v IS NULL THEN 'missing' WHEN by_value THEN CAST(v AS varchar) ELSE CAST(len(list_filter(edges[2:-2], lambda x: v {op} x)) AS varchar) END AS bin FROM long l JOIN e USING (feature) {keep}),
n AS (SELECT feature, bin, count(*) FILTER (WHERE early) AS r, count(*) FILTER (WHERE NOT early) AS s FROM b GROUP BY 1, 2),
sh AS (SELECT feature, greatest(r / sum(r) OVER w, 1e-6) AS a, greatest(s / sum(s) OVER w, 1e-6) AS c FROM n WINDOW w AS (PARTITION BY feature)),
psi AS (SELECT feature, round(sum((c - a) * ln(c / a)), 6) AS psi FROM sh GROUP BY 1),
tab AS (SELECT feature, psi, CASE WHEN psi > 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END AS signal, row_number() OVER (ORDER BY psi DESC, feature) AS place FROM psi)"""


_POISSON = " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(__import__("itertools").accumulate(__import__("math").exp(-1.0) / __import__("math").factorial(k) for k in range(8))))

SQL = {
    "roc_auc": f"""WITH {_S}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM x),
      t AS (SELECT sum(rk) FILTER (WHERE y = 1) AS r, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM r)
      SELECT round((r - p * (p + 1) / 2) / (p * q), 6) AS auc, round(2 * (r - p * (p + 1) / 2) / (p * q) - 1, 6) AS gini, p AS n_pos, q AS n_neg FROM t""",
    "pr_auc": f"""WITH {_S}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM x GROUP BY 1), c AS (SELECT p, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER () AS total FROM g WINDOW w AS (ORDER BY p DESC))
      SELECT round(sum(pos * tp / k) / max(total), 6) AS pr_auc, round(max(2 * tp / (k + total)), 6) AS best_f1, arg_max(p, (round(2 * tp / (k + total), 9), p)) AS best_threshold FROM c""",
    "log_loss_brier": f"WITH {_S}, q AS (SELECT y, p, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM x) SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM q",
    "calibration_bins": f"WITH {_S}, g AS (SELECT CAST(least(floor(p * 10), 9) AS integer) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS b FROM x GROUP BY 1) SELECT s.bin, coalesce(n, 0) AS n, round(a, 6) AS mean_p, round(b, 6) AS mean_y FROM (SELECT CAST(range AS integer) AS bin FROM range(10)) s LEFT JOIN g USING (bin)",
    "calibration_error": f"WITH {_S}, g AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS a, avg(y) AS b FROM x GROUP BY 1) SELECT round(sum(n * abs(a - b)) / sum(n), 6) AS ece, round(max(abs(a - b)), 6) AS max_gap, CAST(sum(n) AS bigint) AS n FROM g",
    "equal_count_curve": f"WITH {_S}, t AS (SELECT y, p, CAST(ntile(7) OVER (ORDER BY p, l_orderkey, l_linenumber) AS integer) AS bin FROM x) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM t GROUP BY 1",
    "threshold_curve": f"WITH {_CURVE} SELECT * FROM curve",
    "cost_threshold": f"WITH {_CURVE} SELECT * FROM curve ORDER BY cost, precision DESC NULLS LAST, threshold DESC LIMIT 1",
    "select_threshold": f"WITH {_CURVE}, best AS (SELECT threshold FROM curve WHERE precision >= 0.3 AND tp >= 50 ORDER BY recall DESC, tp + fp DESC, threshold LIMIT 1) SELECT curve.* FROM curve, best ORDER BY abs(curve.threshold - (best.threshold + 0.003)), curve.threshold LIMIT 1",
    "psi_hist": f"WITH {_psi_sql(False)} SELECT * FROM tab",
    "psi_missing": f"WITH {_psi_sql(True)} SELECT * FROM tab",
    "psi_summary": f"WITH {_psi_sql(False)} SELECT round(avg(psi), 6) AS mean, round(median(psi), 6) AS median, round(quantile_cont(psi, 0.95), 6) AS p95, round(max(psi), 6) AS max, count(*) FILTER (WHERE psi > 0.25) AS n_high FROM tab",
    "wilson_by_status": f"""WITH {_S}, g AS (SELECT l_linestatus, sum(y) AS k, count(*) AS n, avg(y) AS s, pow(1.959963984540054, 2) AS zz FROM x GROUP BY 1)
      SELECT l_linestatus, k, n, round(greatest((s + zz / (2*n)) / (1 + zz/n) - sqrt(zz) * sqrt(s*(1-s)/n + zz/(4.0*n*n)) / (1 + zz/n), 0), 6) AS lower, round(least((s + zz / (2*n)) / (1 + zz/n) + sqrt(zz) * sqrt(s*(1-s)/n + zz/(4.0*n*n)) / (1 + zz/n), 1), 6) AS upper FROM g""",
    "holm_by_line": f"""WITH {_S}, a AS (SELECT avg(y) AS s FROM x), t AS (SELECT l_linenumber AS test, round(2 / (1 + exp(abs((avg(y) - any_value(s)) / sqrt(any_value(s) * (1 - any_value(s)) / count(*))) * 1.702)), 6) AS p FROM x, a GROUP BY 1),
      r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS raw FROM t)
      SELECT test, p, round(max(raw) OVER w, 6) AS p_adjusted, max(raw) OVER w <= 0.05 AS rejected FROM r WINDOW w AS (ORDER BY p, test ROWS UNBOUNDED PRECEDING)""",
    "pinball_coverage": """WITH l AS (SELECT p_brand, l_quantity AS y FROM lineitem JOIN part ON l_partkey = p_partkey), q AS (SELECT p_brand, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.9) AS q90 FROM l GROUP BY 1)
      SELECT p_brand, round(avg(greatest(0.1 * (y - q10), -0.9 * (y - q10))), 6) AS pinball_10, round(avg(greatest(0.5 * (y - q50), -0.5 * (y - q50))), 6) AS pinball_50, round(avg(greatest(0.9 * (y - q90), -0.1 * (y - q90))), 6) AS pinball_90,
      round(avg(CAST(y BETWEEN q10 AND q90 AS integer)), 6) AS coverage, round(sqrt(avg(pow(y - q50, 2))), 6) AS rmse FROM l JOIN q USING (p_brand) GROUP BY 1""",
    "poisson_bootstrap": f"""WITH {_S}, r AS (SELECT y, range AS replicate, CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || range), 1, 8) AS bigint) / 4294967296.0 AS u FROM x, range(20)),
      w AS (SELECT replicate, y, CASE {_POISSON} ELSE 8 END AS w FROM r) SELECT CAST(replicate AS integer) AS replicate, CAST(sum(w) AS bigint) AS weight, round(sum(w * y) / sum(w), 6) AS mean FROM w GROUP BY 1""",
    "segment_accuracy": f"WITH {_S} SELECT coalesce(l_linestatus, 'all') AS segment, count(*) AS n, round(avg(CAST((p >= 0.4) = (y = 1) AS integer)), 6) AS accuracy FROM x GROUP BY ROLLUP (l_linestatus)",
    "cohen_kappa": f"""WITH {_S}, t AS (SELECT avg(CAST((p >= 0.4) = (y = 1) AS integer)) AS o, avg(y) * avg(CAST(p >= 0.4 AS integer)) + (1 - avg(y)) * (1 - avg(CAST(p >= 0.4 AS integer))) AS e FROM x)
      SELECT round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM t""",
    "spearman": "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r",
    "exact_quantiles": "SELECT CAST(q AS double) AS prob, round(v, 4) AS value FROM (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS q, unnest((SELECT quantile_cont(o_totalprice, [0.01, 0.25, 0.5, 0.75, 0.99]) FROM orders)) AS v)",
}
