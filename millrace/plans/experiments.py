"""Queries of splits, features, uplift, off-policy estimates and guards, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import guard as G
from millrace.operators import joins as J
from millrace.operators import metrics as M
from millrace.operators import policy as P
from millrace.operators import splits as S
from millrace.plans.metrics import _S, scored
from millrace.sources.tables import table


def hash_sample(s, d):
    return S.hash_sample(table(s, d, "orders"), "o_orderkey", 40, 17).select("o_orderkey", "o_custkey")


def chronological_split(s, d):
    x = S.chronological_split(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 0.8)
    return x.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


def expanding_folds(s, d):
    return S.expanding_folds(table(s, d, "orders"), "o_orderdate", ["1996-01", "1997-06", "1999-12"], 12)


def rolling_folds(s, d):
    days = table(s, d, "events").agg(F.count_distinct(F.to_date("ts"))).first()[0]
    return s.createDataFrame(S.rolling_folds(days, 5, 3), "fold int, first_day int, last_day int")


def group_split(s, d):
    x = S.group_split(table(s, d, "events").select("user_id"), "user_id", 0.25)
    return x.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("groups"))


def grouped_folds(s, d):
    return S.grouped_folds(table(s, d, "events"), "user_id", 5)


def monthly_cap(s, d):
    o = table(s, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return S.first_by_hash(o, ["month"], ["o_orderkey"], 20).select("month", "o_orderkey")


def top_fraction(s, d):
    return S.top_fraction(table(s, d, "customer"), "c_acctbal", ["c_custkey"], 0.1).select("c_custkey", "c_acctbal")


def evenly_spaced(s, d):
    return S.evenly_spaced(table(s, d, "customer"), ["c_custkey"], 40).select("c_custkey")


def agg_join_features(s, d):
    o, l = table(s, d, "orders"), table(s, d, "lineitem")
    f = J.aggregate_features(l, "l_orderkey", ["l_quantity", "l_extendedprice"], "LINE")
    return J.one_to_one(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), f, ["l_orderkey"])


def missing_rates(s, d):
    return J.missing_rates(table(s, d, "customer_orders"))


def vocabulary(s, d):
    e = table(s, d, "customer_orders").withColumn("kind", F.lower(F.btrim("event_type", F.lit(" \t"))))
    return J.vocabulary(e.where(F.col("purchase_ts") < F.lit("2018-01-01").cast("timestamp_ntz")), "kind", 5, 100)


def encoded(s, d):
    e = table(s, d, "customer_orders").withColumn("kind", F.lower(F.btrim("event_type", F.lit(" \t"))))
    return J.encode(e.select("kind"), "kind", vocabulary(s, d), "code").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _trial(s: SparkSession, d: str) -> DataFrame:
    """Customers: treated by the parity of a hash, outcome an order in status F, score their balance."""
    c = table(s, d, "customer")
    done = table(s, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("y", F.lit(1))
    t = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 2), 16, 10).cast("int") % 2
    return c.join(done, "c_custkey", "left").select("c_custkey", "c_mktsegment", "c_nationkey", F.coalesce("y", F.lit(0)).alias("y"), t.alias("t"), F.col("c_acctbal").alias("score"))


def uplift_effect(s, d):
    return P.effect(_trial(s, d), "y", "t", ["c_mktsegment"])


def qini_curve(s, d):
    return P.qini_curve(_trial(s, d), "y", "t", "score").select("score", "n", F.round("qini", 6).alias("qini"), F.round("uplift", 6).alias("uplift"))


def standardised_differences(s, d):
    return P.standardised_differences(_trial(s, d), "t", ["score", "c_nationkey"])


def uplift_segments(s, d):
    g = _trial(s, d).groupBy("c_nationkey").agg(F.avg(F.when(F.col("t") == 1, F.col("y"))).alias("p1"), F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("p0"))
    return g.select("c_nationkey", P.segments(F.coalesce("p1", F.lit(0.0)), F.coalesce("p0", F.lit(0.0)), 0.95).alias("segment"))


def off_policy(s, d):
    """Logged action: event type; the new policy doubles the share of purchases."""
    e = table(s, d, "events").select(F.pmod("event_id", F.lit(3)).alias("position"), "event_type", (F.col("value") > 50).cast("int").alias("reward"))
    per = e.groupBy("position", "event_type").agg(F.count(F.lit(1)).alias("k"), F.avg("reward").alias("q"))
    tot = per.groupBy("position").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.col("k")).otherwise(0)).alias("b"))
    pol = per.join(F.broadcast(tot), "position").withColumn("prop", F.col("k") / F.col("n"))
    pol = pol.withColumn("target", F.col("k") * F.when(F.col("event_type") == "purchase", 2).otherwise(1) / (F.col("n") + F.col("b")))
    value = pol.groupBy("position").agg(F.sum(F.col("target") * F.col("q")).alias("v"))
    log = e.join(F.broadcast(pol.select("position", "event_type", "prop", "target", "q")), ["position", "event_type"]).join(F.broadcast(value), "position")  # one row per position and event type
    return P.off_policy(log, "position", "reward", "prop", "target", "q", "v")


def cooccurrence(s, d):
    o = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return P.cooccurrence(o, "l_orderkey", "p_brand", 50)


def regression_injection(s, d):
    x = scored(s, d).withColumn("right", ((F.col("p") >= 0.4).cast("int") == F.col("y")).cast("int"))
    i = P.inject_regression(x, "l_linestatus", "O", "right", ["l_orderkey", "l_linenumber"], 0.05)
    return i.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("before"), F.sum("injected").alias("after"))


def guard_rates(s, d):
    g = G.guard_text(table(s, d, "documents"), "doc_id", "text").join(table(s, d, "documents").select("doc_id", "doc_type"), "doc_id")
    return g.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked"))


QUERIES = {f.__name__: f for f in (hash_sample, chronological_split, expanding_folds, rolling_folds, group_split, grouped_folds, monthly_cap, top_fraction, evenly_spaced, agg_join_features, missing_rates, vocabulary, encoded, uplift_effect, qini_curve, standardised_differences, uplift_segments, off_policy, cooccurrence, regression_injection, guard_rates)}

_FRACTION = "CAST('0x' || substr(md5(CAST({} AS varchar)), 1, 8) AS bigint) / 4294967296.0"
_T = "trial AS (SELECT c_custkey, c_mktsegment, c_nationkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS integer) AS y, CAST('0x' || substr(md5(CAST(c_custkey AS varchar)), 1, 2) AS integer) % 2 AS t, c_acctbal AS score FROM customer)"
_KIND = r"kinds AS (SELECT *, lower(trim(event_type, ' ' || chr(9))) AS kind FROM customer_orders), vocab AS (SELECT kind AS level, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, kind) - 1 AS integer) AS code FROM kinds WHERE kind IS NOT NULL AND purchase_ts < TIMESTAMP '2018-01-01' GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, level LIMIT 100)"

SQL = {
    "chronological_split": "WITH r AS (SELECT o_orderdate, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM orders) SELECT part, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM r GROUP BY 1",
    "expanding_folds": "WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT unnest(['1996-01', '1997-06', '1999-12']) AS fold) SELECT fold, CAST(sum(n) FILTER (WHERE m < fold) AS bigint) AS n_train, CAST(coalesce(sum(n) FILTER (WHERE m = fold), 0) AS bigint) AS n_valid FROM f JOIN p ON m <= fold GROUP BY 1 HAVING count(*) FILTER (WHERE m < fold) >= 12",
    "rolling_folds": "SELECT CAST(i + 1 AS integer) AS fold, CAST(n - (3 - i) * 5 + 1 AS integer) AS first_day, CAST(n - (2 - i) * 5 AS integer) AS last_day FROM (SELECT unnest(range(3)) AS i), (SELECT count(DISTINCT CAST(ts AS date)) AS n FROM events)",
    "group_split": f"SELECT CASE WHEN {_FRACTION.format('user_id')} < 0.25 THEN 'test' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT user_id) AS groups FROM events GROUP BY 1",
    "grouped_folds": "SELECT user_id, count(*) AS n, CAST((row_number() OVER (ORDER BY count(*) DESC, user_id) - 1) % 5 AS integer) AS fold FROM events GROUP BY 1",
    "monthly_cap": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY md5(CAST(o_orderkey AS varchar)), o_orderkey) <= 20",
    "top_fraction": "SELECT c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= (SELECT ceil(count(*) * 0.1) FROM customer)",
    "evenly_spaced": "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), p AS (SELECT unnest(range(40)) * ((SELECT count(*) FROM customer) - 1) / 39.0 AS x) SELECT DISTINCT c_custkey FROM r JOIN p ON r = round_even(x, 0) + 1",
    "agg_join_features": 'SELECT o_orderkey AS l_orderkey, o_custkey, n AS "LINE_COUNT", a AS "LINE_L_QUANTITY_MEAN", b AS "LINE_L_QUANTITY_MIN", c AS "LINE_L_QUANTITY_MAX", e AS "LINE_L_QUANTITY_SUM", f AS "LINE_L_EXTENDEDPRICE_MEAN", g AS "LINE_L_EXTENDEDPRICE_MIN", h AS "LINE_L_EXTENDEDPRICE_MAX", i AS "LINE_L_EXTENDEDPRICE_SUM" FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 6) AS a, min(l_quantity) AS b, max(l_quantity) AS c, round(sum(l_quantity), 4) AS e, round(avg(l_extendedprice), 6) AS f, min(l_extendedprice) AS g, max(l_extendedprice) AS h, round(sum(l_extendedprice), 4) AS i FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey',
    "missing_rates": "SELECT unnest(['customer_unique_id','order_id','event_type','purchase_ts','delivered_ts','estimated_delivery_ts','paid_value','loaded_at']) AS \"column\", unnest([round(1 - count(customer_unique_id) / count(*), 6), round(1 - count(order_id) / count(*), 6), round(1 - count(event_type) / count(*), 6), round(1 - count(purchase_ts) / count(*), 6), round(1 - count(delivered_ts) / count(*), 6), round(1 - count(estimated_delivery_ts) / count(*), 6), round(1 - count(paid_value) / count(*), 6), round(1 - count(loaded_at) / count(*), 6)]) AS rate FROM customer_orders",
    "vocabulary": f"WITH {_KIND} SELECT level, n, code FROM vocab",
    "encoded": f"WITH {_KIND} SELECT coalesce(code, (SELECT CAST(count(*) AS integer) FROM vocab)) AS code, count(*) AS n FROM kinds LEFT JOIN vocab ON level = kind GROUP BY 1",
    "uplift_effect": f"""WITH {_T}, g AS (SELECT c_mktsegment, avg(y) FILTER (WHERE t = 1) AS r1, avg(y) FILTER (WHERE t = 0) AS r0, count(*) FILTER (WHERE t = 1) AS n1, count(*) FILTER (WHERE t = 0) AS n0 FROM trial GROUP BY 1), s AS (SELECT *, sqrt(r1*(1-r1)/n1 + r0*(1-r0)/n0) AS se FROM g)
      SELECT c_mktsegment, n1, n0, round(r1, 6) AS rate_treated, round(r0, 6) AS rate_control, round(r1 - r0, 6) AS effect, round(r1 - r0 - 1.96 * se, 6) AS lower, round(r1 - r0 + 1.96 * se, 6) AS upper FROM s""",
    "qini_curve": f"""WITH {_T}, g AS (SELECT score, sum(y) FILTER (WHERE t = 1) AS a, sum(y) FILTER (WHERE t = 0) AS b, count(*) FILTER (WHERE t = 1) AS c, count(*) FILTER (WHERE t = 0) AS e FROM trial GROUP BY 1),
      k AS (SELECT score, sum(coalesce(a, 0)) OVER w AS y1, sum(coalesce(b, 0)) OVER w AS y0, sum(c) OVER w AS n1, sum(e) OVER w AS n0 FROM g WINDOW w AS (ORDER BY score DESC))
      SELECT score, CAST(n1 + n0 AS bigint) AS n, round(y1 - coalesce(y0 * n1 / nullif(n0, 0), 0), 6) AS qini, round((coalesce(y1 / nullif(n1, 0), 0) - coalesce(y0 / nullif(n0, 0), 0)) * (n1 + n0), 6) AS uplift FROM k""",
    "standardised_differences": f"WITH {_T} SELECT 'score' AS feature, round((avg(score) FILTER (WHERE t = 1) - avg(score) FILTER (WHERE t = 0)) / sqrt((var_pop(score) FILTER (WHERE t = 1) + var_pop(score) FILTER (WHERE t = 0)) / 2), 6) AS smd FROM trial UNION ALL SELECT 'c_nationkey', round((avg(c_nationkey) FILTER (WHERE t = 1) - avg(c_nationkey) FILTER (WHERE t = 0)) / sqrt((var_pop(c_nationkey) FILTER (WHERE t = 1) + var_pop(c_nationkey) FILTER (WHERE t = 0)) / 2), 6) FROM trial",
    "uplift_segments": f"WITH {_T}, g AS (SELECT c_nationkey, coalesce(avg(y) FILTER (WHERE t = 1), 0) AS a, coalesce(avg(y) FILTER (WHERE t = 0), 0) AS b FROM trial GROUP BY 1) SELECT c_nationkey, CASE WHEN a >= 0.95 AND b < 0.95 THEN 'persuadable' WHEN a < 0.95 AND b >= 0.95 THEN 'sleeping dog' WHEN a >= 0.95 THEN 'sure thing' ELSE 'lost cause' END AS segment FROM g",
    "off_policy": """WITH e AS (SELECT event_id % 3 AS position, event_type, CAST(value > 50 AS integer) AS r FROM events), p AS (SELECT position, event_type, count(*) AS k, avg(r) AS q FROM e GROUP BY 1, 2), t AS (SELECT position, sum(k) AS n, sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS b FROM p GROUP BY 1),
      x AS (SELECT position, event_type, q, k / n AS prop, k * CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END / (n + b) AS target FROM p JOIN t USING (position)), v AS (SELECT position, sum(target * q) AS v FROM x GROUP BY 1), l AS (SELECT e.position, r, q, v, target / prop AS w FROM e JOIN x USING (position, event_type) JOIN v USING (position))
      SELECT CAST(position AS varchar) AS position, count(*) AS n, round(avg(v), 6) AS dm, round(avg(w * r), 6) AS ips, round(sum(w * r) / sum(w), 6) AS snips, round(avg(v + w * (r - q)), 6) AS dr, round(pow(sum(w), 2) / sum(w * w), 6) AS ess, round(max(w), 6) AS max_weight FROM l GROUP BY 1""",
    "cooccurrence": "WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2",
    "regression_injection": f"""WITH {_S}, z AS (SELECT *, CAST((p >= 0.4) = (y = 1) AS integer) AS c FROM x), k AS (SELECT floor(count(*) FILTER (WHERE l_linestatus = 'O') * 0.05 + 0.5) AS k FROM z)
      SELECT l_linestatus, count(*) AS n, CAST(sum(c) AS bigint) AS before, CAST(sum(c) AS bigint) + CASE WHEN l_linestatus = 'O' THEN -least(any_value(k), sum(c)) ELSE least(any_value(k), count(*) - sum(c)) END AS after FROM z, k GROUP BY 1""",
    "guard_rates": "SELECT doc_type, count(*) AS n, count(*) FILTER (WHERE " + " OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for p in G.RULES.values()) + ") AS blocked FROM documents GROUP BY 1",
}
