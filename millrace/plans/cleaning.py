"""Queries of cleaning, sampling and audits, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import cleaning as C
from millrace.operators import splits as S
from millrace.sources.tables import table



def time_slices(s, d):
    """Events by day, hour and weekday of a YYMMDDHH stamp, with the elapsed share of the day and reserved tokens."""
    e = table(s, d, "events").withColumn("stamp", F.date_format("ts", "yyMMddHH")).withColumns(C.hour_stamp(F.col("stamp")))
    share = C.day_fraction(F.date_format("ts", "HHmmss"))
    return e.select("event_id", "day", "hour", "weekday", F.round(24 * share, 4).alias("elapsed"), C.reserved(F.nullif("event_type", F.lit("error"))).alias("kind"), F.nullif("value", F.lit(0.0)).alias("value"))


def month_periods(s, d):
    text = F.concat_ws("-", F.date_format("o_orderdate", "MMM"), F.date_format("o_orderdate", "yyyy"))
    odd = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("?"), text)).otherwise(text)
    return table(s, d, "orders").groupBy(C.month_period(odd).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def finite_ratios(s, d):
    """Means of finite values by line status: NaN and infinities are left out."""
    v = F.when(F.col("l_quantity") > 49, F.lit(float("inf"))).when(F.col("l_quantity") < 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    x = table(s, d, "lineitem").withColumn("v", C.finite(v))
    return x.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_finite"), F.round(F.avg("v"), 6).alias("mean"))


def _spans(s, d):
    o = table(s, d, "raw_orders")
    bought, came = (F.nullif(c, F.lit("")).try_cast("timestamp_ntz") for c in ("order_purchase_timestamp", "order_delivered_customer_date"))
    return o.withColumns({"bought": bought, "minutes": C.minutes_between(bought, came)})


def valid_spans(s, d):
    """Orders whose way took one hour to thirty days, in a known state, by month of purchase: what broke which rule."""
    rules = {"span": F.col("minutes").between(60, 30 * 1440), "state": F.col("order_status").isin("delivered", "shipped", "invoiced")}
    return C.audit(_spans(s, d).where(F.col("bought").isNotNull()), rules, [F.date_format("bought", "yyyy-MM").alias("month")])


def hour_profile(s, d):
    return C.peak_share(_spans(s, d).where(F.col("minutes").between(60, 30 * 1440)), F.hour("bought"))


def sparse_columns(s, d):
    return C.sparse_columns(table(s, d, "raw_orders"), 0.02, at_threshold=False)


def product_texts(s, d):
    return table(s, d, "part").select("p_partkey", C.joined_text(["p_name", "p_brand", "p_type"], 30).alias("text"))


def temporal_gap(s, d):
    o = table(s, d, "orders")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return C.later_only(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_orderdate")


def line_order(s, d):
    """Order check of each file's lines: a line whose text sorts below the one before it."""
    return C.order_audit(table(s, d, "raw_lines").where(F.col("line").isNotNull()), "source_file", "line_no", "line")


def stratified_anchors(s, d):
    o = table(s, d, "orders")
    return S.stratified_sample(o, "o_orderpriority", ["o_orderkey"], 203, F.col("o_orderkey").isin(1, 2, 3, 4, 5)).select("o_orderkey", "o_orderpriority")


def balanced_sample(s, d):
    return S.balanced_sample(table(s, d, "qa_examples").where(F.col("question_id").isNotNull()).dropDuplicates(["question_id"]), "impossible", ["question_id"], 100).select("question_id", "impossible")


def treated_balance(s, d):
    c = table(s, d, "customer").withColumn("t", (F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 2), 16, 10).cast("int") < 80).cast("int"))
    return S.balanced_sample(c, "t", ["c_custkey"]).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def stratified_holdout(s, d):
    h = S.stratified_holdout(table(s, d, "customer"), ["c_mktsegment"], ["c_custkey"], 0.2)
    return h.groupBy("c_mktsegment", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def day_split(s, d):
    days = [f"2024-01-{k:02d}" for k in range(1, 31)]
    x = S.day_list_split(table(s, d, "events"), F.to_date("ts"), {"train": days[:20], "calibrate": days[20:25], "test": days[26:]})
    return x.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def label_slice(s, d):
    return S.label_slice(table(s, d, "embeddings"), "label", 3, ["vec_id"], 5, 20).select("vec_id")


def first_demonstrations(s, d):
    """The first rows of the source order, as demonstrations."""
    return S.slice_in_order(table(s, d, "eval_items"), [F.col("item_id").asc()], 0, 4).select("item_id", "item_text")


def two_way_rates(s, d):
    """Rates by event type and by user, in one table."""
    e = table(s, d, "events")
    sets = e.groupingSets([["event_type"], ["user_id"]], "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"), F.grouping("user_id").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "event_type").otherwise("user_id").alias("field"), F.coalesce("event_type", F.col("user_id").cast("string")).alias("key"), "n", "rate")


def category_shares(s, d):
    """Records, share of one category and distinct categories of each user."""
    return table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") == "purchase").cast("double")), 6).alias("share"), F.count_distinct("event_type").alias("kinds"))


def nearest_rank(s, d):
    """Nearest-rank percentiles and medians by segment."""
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY c_acctbal)")
    return table(s, d, "customer").groupBy("c_mktsegment").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.round(F.median("c_acctbal"), 6).alias("median"))


def monthly_means(s, d):
    """Sums by month, then their mean by priority."""
    m = table(s, d, "orders").groupBy("o_orderpriority", F.last_day("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return m.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("months"), F.round(F.avg("v"), 4).alias("mean"))


def series_coverage(s, d):
    """Of the symbols of each market, those that have prices."""
    six = lambda c: F.lpad(F.lower(F.btrim(c, F.lit(" \t"))), 6, "0")
    listed = table(s, d, "universe_manifest").where(F.col("symbol").isNotNull()).select("market", six("symbol").alias("k")).distinct()
    seen = table(s, d, "krx_panel").where(F.col("symbol").isNotNull() & F.col("close").isNotNull()).select(six("symbol").alias("k"), F.lit(1).alias("there")).distinct()
    return listed.join(seen, "k", "left").groupBy("market").agg(F.count(F.lit(1)).alias("listed"), F.count("there").alias("available"), F.round(F.count("there") / F.count(F.lit(1)), 6).alias("coverage"))


def rebalance_dates(s, d):
    """The last session of each month, and every third one."""
    from pyspark.sql import Window

    last = table(s, d, "krx_panel").where(F.col("trade_ts").isNotNull()).groupBy(F.trunc("trade_ts", "month").alias("month")).agg(F.max(F.to_date("trade_ts")).alias("session"))
    return last.select("session", (F.row_number().over(Window.orderBy("month")) % 3 == 0).alias("quarterly"))  # one row per month


QUERIES = {f.__name__: f for f in (
    time_slices, month_periods, finite_ratios, valid_spans, hour_profile, sparse_columns, product_texts, temporal_gap, line_order, stratified_anchors, balanced_sample, treated_balance,
    stratified_holdout, day_split, label_slice, first_demonstrations, two_way_rates, category_shares, nearest_rank, monthly_means, series_coverage, rebalance_dates,
)}

_SPANS = "spans AS (SELECT *, try_cast(nullif(order_purchase_timestamp, '') AS timestamp) AS bought, date_diff('microsecond', try_cast(nullif(order_purchase_timestamp, '') AS timestamp), try_cast(nullif(order_delivered_customer_date, '') AS timestamp)) / 6e7 AS minutes FROM raw_orders)"
_H = "md5(CAST({} AS varchar))"

SQL = {
    "time_slices": "SELECT event_id, CAST(ts AS date) AS day, CAST(hour(ts) AS integer) AS hour, CAST((dayofweek(ts) + 6) % 7 AS integer) AS weekday, round(hour(ts) + minute(ts) / 60 + CAST(strftime(ts, '%S') AS double) / 3600, 4) AS elapsed, CASE WHEN event_type = 'error' THEN '__MISSING__' ELSE event_type END AS kind, nullif(value, 0) AS value FROM events",
    "month_periods": "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS period, count(*) AS n FROM orders GROUP BY 1",
    "finite_ratios": "SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity BETWEEN 2 AND 49) AS n_finite, round(avg(l_quantity) FILTER (WHERE l_quantity BETWEEN 2 AND 49), 6) AS mean FROM lineitem GROUP BY 1",
    "valid_spans": f"""WITH {_SPANS}, r AS (SELECT strftime(bought, '%Y-%m') AS month, coalesce(minutes BETWEEN 60 AND 43200, false) AS a, coalesce(order_status IN ('delivered', 'shipped', 'invoiced'), false) AS b FROM spans WHERE bought IS NOT NULL)
      SELECT month, count(*) AS n, count(*) FILTER (WHERE a AND b) AS n_sound, count(*) FILTER (WHERE NOT a) AS broke_span, count(*) FILTER (WHERE NOT b) AS broke_state FROM r GROUP BY 1""",
    "hour_profile": f"WITH {_SPANS}, h AS (SELECT CAST(hour(bought) AS integer) AS bucket, count(*) AS n FROM spans WHERE minutes BETWEEN 60 AND 43200 GROUP BY 1) SELECT bucket, n, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, bucket) = 1 AS peak FROM h",
    "sparse_columns": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS integer)), 6) AS rate FROM raw_orders" for c in ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date", "loaded_at", "deleted_at")) + ") WHERE rate > 0.02",
    "product_texts": "SELECT p_partkey, substr(concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), nullif(trim(p_type), '')), 1, 30) AS text FROM part",
    "temporal_gap": "SELECT strftime(max(o_orderdate) FILTER (WHERE o_orderdate < DATE '1997-01-01'), '%Y-%m') AS last_train, strftime(min(o_orderdate) FILTER (WHERE o_orderdate >= DATE '1997-01-01'), '%Y-%m') AS first_test, last_train < first_test AS passes FROM orders",
    "line_order": "WITH b AS (SELECT *, lag(line) OVER (PARTITION BY source_file ORDER BY line_no) AS before FROM raw_lines WHERE line IS NOT NULL) SELECT source_file, count(*) AS n, count(*) FILTER (WHERE line < before) AS backward FROM b GROUP BY 1",
    "stratified_anchors": f"""WITH k AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT o_orderpriority FROM orders)),
      r AS (SELECT o_orderkey, o_orderpriority, o_orderkey IN (1, 2, 3, 4, 5) AS anchor, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey IN (1, 2, 3, 4, 5) DESC, {_H.format('o_orderkey')}, o_orderkey) AS r FROM orders)
      SELECT o_orderkey, o_orderpriority FROM r JOIN k USING (o_orderpriority) WHERE anchor OR r <= 203 // k + CAST(i <= 203 % k AS integer)""",
    "balanced_sample": f"""WITH q AS (SELECT DISTINCT question_id, impossible FROM qa_examples WHERE question_id IS NOT NULL AND impossible IS NOT NULL), m AS (SELECT least(min(n), 100 // count(*)) AS m FROM (SELECT count(*) AS n FROM q GROUP BY impossible))
      SELECT question_id, impossible FROM q QUALIFY row_number() OVER (PARTITION BY impossible ORDER BY {_H.format('question_id')}, question_id) <= (SELECT m FROM m)""",
    "treated_balance": f"""WITH c AS (SELECT c_custkey, CAST(CAST('0x' || substr({_H.format('c_custkey')}, 1, 2) AS integer) < 80 AS integer) AS t FROM customer), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM c GROUP BY t)),
      k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY {_H.format('c_custkey')}, c_custkey) <= (SELECT m FROM m)) SELECT t, count(*) AS n, CAST(sum(c_custkey) AS bigint) AS keys FROM k GROUP BY 1""",
    "stratified_holdout": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_H.format('c_custkey')}, c_custkey) AS r, floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.2 + 0.5) AS q FROM customer)
      SELECT c_mktsegment, CASE WHEN r <= q THEN 'test' ELSE 'train' END AS part, count(*) AS n, CAST(sum(c_custkey) AS bigint) AS keys FROM r GROUP BY 1, 2""",
    "day_split": "SELECT CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) <= 25 THEN 'calibrate' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-01-31' AND day(ts) <> 26 GROUP BY 1",
    "label_slice": f"SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY {_H.format('vec_id')}, vec_id LIMIT 20 OFFSET 5",
    "first_demonstrations": "SELECT item_id, item_text FROM eval_items ORDER BY item_id LIMIT 4",
    "two_way_rates": "SELECT 'event_type' AS field, event_type AS key, count(*) AS n, round(avg(CAST(value > 50 AS integer)), 6) AS rate FROM events GROUP BY event_type UNION ALL SELECT 'user_id', CAST(user_id AS varchar), count(*), round(avg(CAST(value > 50 AS integer)), 6) FROM events GROUP BY user_id",
    "category_shares": "SELECT user_id, count(*) AS n, round(avg(CAST(event_type = 'purchase' AS integer)), 6) AS share, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1",
    "nearest_rank": "SELECT c_mktsegment, quantile_disc(c_acctbal, 0.5) AS p50, quantile_disc(c_acctbal, 0.95) AS p95, round(median(c_acctbal), 6) AS median FROM customer GROUP BY 1",
    "monthly_means": "WITH m AS (SELECT o_orderpriority, last_day(o_orderdate) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o_orderpriority, count(*) AS months, round(avg(v), 4) AS mean FROM m GROUP BY 1",
    "series_coverage": """WITH l AS (SELECT DISTINCT market, lpad(lower(trim(symbol, ' ' || chr(9))), 6, '0') AS k FROM universe_manifest WHERE symbol IS NOT NULL), s AS (SELECT DISTINCT lpad(lower(trim(symbol, ' ' || chr(9))), 6, '0') AS k FROM krx_panel WHERE symbol IS NOT NULL AND close IS NOT NULL)
      SELECT market, count(*) AS listed, count(s.k) AS available, round(count(s.k) / count(*), 6) AS coverage FROM l LEFT JOIN s USING (k) GROUP BY 1""",
    "rebalance_dates": "WITH m AS (SELECT date_trunc('month', trade_ts) AS month, max(CAST(trade_ts AS date)) AS session FROM krx_panel WHERE trade_ts IS NOT NULL GROUP BY 1) SELECT session, row_number() OVER (ORDER BY month) % 3 = 0 AS quarterly FROM m",
}
