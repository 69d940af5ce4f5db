"""Queries of customer analysis and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import distributions as P
from millrace.operators import cohorts as C
from millrace.sources.tables import table


def _delivered(s: SparkSession, d: str) -> DataFrame:
    return C.delivered_orders(table(s, d, "raw_orders"), table(s, d, "raw_customers"))


def _buys(s: SparkSession, d: str) -> DataFrame:
    return C.customer_orders(_delivered(s, d), C.order_value(table(s, d, "raw_order_payments")))


def delivered_orders(s, d):
    return _delivered(s, d)


def order_value(s, d):
    return C.order_value(table(s, d, "raw_order_payments"))


def customer_orders_view(s, d):
    return _buys(s, d)


def customer_id_effect(s, d):
    every = table(s, d, "raw_orders").join(table(s, d, "raw_customers").select("customer_id", "customer_unique_id"), "customer_id")
    return C.identifier_effect({"all_orders": every, "delivered_orders": _delivered(s, d)}, {"customer_id": "customer_id", "customer_unique_id": "customer_unique_id"})


def cohort_retention(s, d):
    return C.retention_grid(_buys(s, d), "customer_unique_id", "order_id", "purchase_ts")


def monthly_metric_tree(s, d):
    t = C.metric_tree(_buys(s, d), "customer_unique_id", "order_id", "purchase_ts", "paid_value")
    change = F.col("revenue") / F.nullif("prev_revenue", F.lit(0.0)) - 1
    rounded = ("revenue", "orders_per_customer", "value_per_order", "prev_revenue", "prev_orders_per_customer", "prev_value_per_order")
    return t.select("month", "prev_month", "customers", "prev_customers", "orders", *[F.round(c, 6).alias(c) for c in rounded], F.round(change, 6).alias("change_rate"))


def revenue_decomposition(s, d):
    t = C.revenue_decomposition(C.metric_tree(_buys(s, d), "customer_unique_id", "order_id", "purchase_ts", "paid_value"), complete_months(s, d))
    return t.select("month", *[F.round(c, 6).alias(c) for c in t.columns if c not in ("month", "reconciles")], "reconciles")


def complete_months(s, d):
    counts = _buys(s, d).groupBy(C.month("purchase_ts").alias("month")).agg(F.count_distinct("order_id").alias("n"))
    return C.complete_months(counts, 50)


def rfm_customer(s, d):
    return C.rfm(_buys(s, d), "customer_unique_id", "order_id", "purchase_ts", "paid_value")


def rfm_profile(s, d):
    return C.rfm_profile(rfm_customer(s, d))


def survival_input(s, d):
    return C.survival_input(_buys(s, d), "customer_unique_id", "order_id", "purchase_ts")


def kaplan_meier(s, d):
    return C.kaplan_meier(survival_input(s, d), "duration_days", "event")


def survival_summary(s, d):
    return C.survival_summary(kaplan_meier(s, d), [90, 180])


def _experience(s: SparkSession, d: str) -> DataFrame:
    # the tables have no reviews; the instalments of a payment, text with blanks, stand in for their scores
    reviews = table(s, d, "raw_order_payments").select("order_id", F.col("payment_installments").alias("review_score"))
    return C.first_order_experience(_buys(s, d), reviews)


def first_order_experience(s, d):
    return _experience(s, d)


def experience_chi2(s, d):
    """Repeat purchase by late delivery: the 2 x 2 statistic with Yates' correction, and the rates."""
    n = lambda late, rep: F.count_if((F.col("delivery_delayed") == late) & (F.col("repurchased") == rep)).cast("double")
    t = _experience(s, d).agg(n(False, False).alias("a"), n(False, True).alias("b"), n(True, False).alias("c"), n(True, True).alias("d"))
    total, gap = F.expr("a + b + c + d"), F.abs(F.expr("a * d - b * c"))
    chi = total * F.pow(F.greatest(gap - F.least(total / 2, gap), F.lit(0.0)), 2) / F.nullif(F.expr("(a + b) * (c + d) * (a + c) * (b + d)"), F.lit(0.0))
    rate = lambda late, rest: F.round(F.expr(f"{late} / nullif({late} + {rest}, 0)"), 6)
    return t.select("a", "b", "c", "d", F.round(chi, 6).alias("chi2"), rate("c", "a").alias("late_single"), rate("d", "b").alias("late_repeat"))


def experience_welch(s, d):
    """Review scores of customers with one and with more orders: means, Welch's t and its degrees of freedom."""
    e = _experience(s, d)
    m = e.agg(*[f(F.when(F.col("repurchased") == r, F.col("review_score"))).alias(f"{n}{int(r)}") for r in (False, True) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    se = lambda r: F.col(f"v{r}") / F.nullif(f"n{r}", F.lit(0))
    t = (F.col("m0") - F.col("m1")) / F.nullif(F.sqrt(se(0) + se(1)), F.lit(0.0))
    df = F.pow(se(0) + se(1), 2) / F.nullif(F.pow(se(0), 2) / F.nullif(F.col("n0") - 1, F.lit(0)) + F.pow(se(1), 2) / F.nullif(F.col("n1") - 1, F.lit(0)), F.lit(0.0))
    return m.select(F.round("m0", 6).alias("mean_single"), F.round("m1", 6).alias("mean_repeat"), F.round(t, 6).alias("t"), F.round(df, 4).alias("df"))


def experience_p_values(s, d):
    """p-values of the two tests, two-sided; NULL where a statistic is."""
    one = experience_welch(s, d).withColumn("k", F.lit(1)).join(experience_chi2(s, d).select("chi2", F.lit(1).alias("k")), "k")  # one row each
    return one.select("t", "df", P.t_two_sided("t", "df").alias("p_review"), "chi2", P.chi2_upper("chi2", F.lit(1.0)).alias("p_delay"))


def category_repeat_profile(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer").select("c_custkey")
    orders = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.col("o_orderdate").alias("ts"))
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("product"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    parts = table(s, d, "part")
    names = parts.where(F.col("p_type").startswith("PROMO")).select(F.col("p_type").alias("category"), F.lower("p_type").alias("name")).distinct()
    return C.category_profile(orders, items, parts.select(F.col("p_partkey").alias("product"), F.col("p_type").alias("category")), names, 5)


QUERIES = {f.__name__: f for f in (delivered_orders, order_value, customer_orders_view, customer_id_effect, cohort_retention, monthly_metric_tree, revenue_decomposition, complete_months, rfm_customer, rfm_profile, survival_input, kaplan_meier, survival_summary, first_order_experience, experience_chi2, experience_welch, experience_p_values, category_repeat_profile)}

_V = """
delivered AS (
  SELECT o.order_id, o.customer_id, try_cast(nullif(order_purchase_timestamp, '') AS timestamp) AS purchase_ts, try_cast(nullif(order_delivered_customer_date, '') AS timestamp) AS delivered_ts,
         try_cast(nullif(order_estimated_delivery_date, '') AS timestamp) AS estimated_delivery_ts, c.customer_unique_id
  FROM raw_orders o JOIN raw_customers c USING (customer_id)
  WHERE order_status = 'delivered' AND customer_unique_id IS NOT NULL AND try_cast(nullif(order_purchase_timestamp, '') AS timestamp) IS NOT NULL),
value AS (SELECT order_id, CAST(sum(try_cast(nullif(payment_value, '') AS decimal(14,2))) AS decimal(24,2)) AS paid_value FROM raw_order_payments GROUP BY 1),
buys AS (SELECT d.*, CAST(coalesce(v.paid_value, 0) AS decimal(24,2)) AS paid_value FROM delivered d LEFT JOIN value v USING (order_id)),
per AS (SELECT customer_unique_id AS customer, max(purchase_ts) AS last_ts, count(DISTINCT order_id) AS frequency, CAST(sum(paid_value) AS double) AS monetary FROM buys WHERE customer_unique_id IS NOT NULL GROUP BY 1),
tree AS (
  SELECT *, lag(customers) OVER w AS prev_customers, lag(orders_per_customer) OVER w AS prev_orders_per_customer, lag(value_per_order) OVER w AS prev_value_per_order, lag(revenue) OVER w AS prev_revenue, lag(month) OVER w AS prev_month
  FROM (SELECT *, CAST(orders AS double) / customers AS orders_per_customer, revenue / orders AS value_per_order FROM (
    SELECT CAST(date_trunc('month', purchase_ts) AS date) AS month, count(DISTINCT customer_unique_id) AS customers, count(DISTINCT order_id) AS orders, CAST(sum(paid_value) AS double) AS revenue FROM buys GROUP BY 1))
  WINDOW w AS (ORDER BY month)),
scored AS (
  SELECT customer, date_diff('day', CAST(last_ts AS date), (SELECT CAST(max(last_ts) AS date) + 1 FROM per)) AS recency_days, frequency, monetary FROM per),
rfm AS (
  SELECT customer, recency_days, frequency, round(monetary, 2) AS monetary, CAST(ntile(5) OVER (ORDER BY recency_days DESC, customer) AS integer) AS r_score,
         CASE frequency WHEN 1 THEN 1 ELSE 5 END AS f_score, CAST(ntile(5) OVER (ORDER BY scored.monetary, customer) AS integer) AS m_score FROM scored),
ord AS (SELECT customer_unique_id AS customer, order_id, purchase_ts AS ts FROM buys),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts, order_id) AS r FROM ord),
surv AS (
  SELECT customer, greatest(date_diff('day', CAST(min(ts) FILTER (WHERE r = 1) AS date), CAST(coalesce(min(ts) FILTER (WHERE r = 2), (SELECT max(ts) FROM ord)) AS date)), 1) AS duration_days,
         count(*) FILTER (WHERE r = 2) > 0 AS event FROM ranked GROUP BY 1),
risk AS (SELECT day, d, sum(leaving) OVER (ORDER BY day DESC) AS at_risk FROM (SELECT duration_days AS day, count(*) FILTER (WHERE event) AS d, count(*) AS leaving FROM surv GROUP BY 1)),
reviews AS (SELECT order_id, avg(try_cast(nullif(payment_installments, '') AS double)) AS review_score FROM raw_order_payments GROUP BY 1),
firsts AS (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY purchase_ts, order_id, delivered_ts NULLS FIRST, estimated_delivery_ts NULLS FIRST) AS r FROM buys),
repeats AS (SELECT customer_unique_id, count(DISTINCT order_id) > 1 AS repurchased FROM buys GROUP BY 1),
experience AS (
  SELECT f.customer_unique_id, repurchased, round(review_score, 6) AS review_score, delivered_ts > estimated_delivery_ts AS delivery_delayed
  FROM firsts f JOIN repeats USING (customer_unique_id) LEFT JOIN reviews USING (order_id) WHERE r = 1 AND delivered_ts IS NOT NULL AND estimated_delivery_ts IS NOT NULL),
months AS (SELECT CAST(date_trunc('month', purchase_ts) AS date) AS month, count(DISTINCT order_id) AS n, any_value(year(purchase_ts) * 12 + month(purchase_ts)) AS k FROM buys GROUP BY 1),
whole AS (SELECT * FROM months WHERE k < (SELECT max(k) FROM months)),
starts AS (SELECT *, n >= 50 AND lead(n) OVER w >= 50 AND lead(n, 2) OVER w >= 50 AND lead(k) OVER w = k + 1 AND lead(k, 2) OVER w = k + 2 AS starts FROM whole WINDOW w AS (ORDER BY k)),
complete AS (SELECT month, n FROM starts WHERE k >= (SELECT min(k) FROM starts WHERE starts)),
km AS (SELECT day, d, at_risk, round(CASE WHEN min(at_risk - d) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END, 6) AS survival FROM risk
  WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING) QUALIFY d > 0)
"""

SQL = {
    "delivered_orders": f"WITH {_V} SELECT * FROM delivered",
    "order_value": f"WITH {_V} SELECT * FROM value",
    "customer_orders_view": f"WITH {_V} SELECT * FROM buys",
    "customer_id_effect": f"""WITH {_V}, every AS (SELECT order_id, customer_id, customer_unique_id FROM raw_orders JOIN raw_customers USING (customer_id)),
      ids AS (SELECT 'all_orders' AS population, 'customer_id' AS identifier, customer_id AS id, order_id FROM every UNION ALL SELECT 'all_orders', 'customer_unique_id', customer_unique_id, order_id FROM every
        UNION ALL SELECT 'delivered_orders', 'customer_id', customer_id, order_id FROM delivered UNION ALL SELECT 'delivered_orders', 'customer_unique_id', customer_unique_id, order_id FROM delivered),
      per_id AS (SELECT population, identifier, id, count(DISTINCT order_id) AS n FROM ids GROUP BY 1, 2, 3)
      SELECT population, identifier, count(*) AS n_customers, count(*) FILTER (WHERE n > 1) AS n_repeat, round(count(*) FILTER (WHERE n > 1) / count(*), 6) AS repeat_rate FROM per_id GROUP BY 1, 2""",
    "cohort_retention": f"""WITH {_V}, active AS (SELECT DISTINCT customer_unique_id AS customer, CAST(date_trunc('month', purchase_ts) AS date) AS month FROM buys WHERE customer_unique_id IS NOT NULL),
      coh AS (SELECT *, min(month) OVER (PARTITION BY customer) AS cohort FROM active), cells AS (SELECT cohort, month, count(*) AS n FROM coh GROUP BY 1, 2),
      spine AS (SELECT cohort, n AS cohort_size, CAST(unnest(generate_series(cohort, (SELECT max(month) FROM cells), INTERVAL 1 MONTH)) AS date) AS month FROM cells WHERE cohort = month)
      SELECT s.cohort, s.month, (year(s.month) - year(s.cohort)) * 12 + month(s.month) - month(s.cohort) AS month_no, cohort_size, coalesce(n, 0) AS n_active, round(coalesce(n, 0) / cohort_size, 6) AS retention
      FROM spine s LEFT JOIN cells c ON c.cohort = s.cohort AND c.month = s.month""",
    "monthly_metric_tree": f"""WITH {_V} SELECT month, prev_month, customers, prev_customers, orders, round(revenue, 6) AS revenue, round(orders_per_customer, 6) AS orders_per_customer, round(value_per_order, 6) AS value_per_order, round(prev_revenue, 6) AS prev_revenue,
      round(prev_orders_per_customer, 6) AS prev_orders_per_customer, round(prev_value_per_order, 6) AS prev_value_per_order, round(revenue / nullif(prev_revenue, 0) - 1, 6) AS change_rate FROM tree""",
    "revenue_decomposition": f"""WITH {_V}, t AS (SELECT month, revenue, customers, orders_per_customer, value_per_order, lag(revenue) OVER w AS prev_revenue, lag(customers) OVER w AS prev_customers, lag(orders_per_customer) OVER w AS prev_orders_per_customer,
        lag(value_per_order) OVER w AS prev_value_per_order FROM tree JOIN complete USING (month) WINDOW w AS (ORDER BY month))
      SELECT month, round(revenue / prev_revenue - 1, 6) AS change_rate, round(ln(revenue / prev_revenue), 6) AS log_revenue, round(ln(customers / prev_customers), 6) AS log_customers, round(ln(orders_per_customer / prev_orders_per_customer), 6) AS log_orders_per_customer,
      round(ln(value_per_order / prev_value_per_order), 6) AS log_value_per_order, true AS reconciles FROM t WHERE prev_revenue IS NOT NULL""",
    "complete_months": f"WITH {_V} SELECT * FROM complete",
    "rfm_customer": f"WITH {_V} SELECT *, CAST(r_score AS varchar) || CAST(f_score AS varchar) || CAST(m_score AS varchar) AS code FROM rfm",
    "rfm_profile": f"""WITH {_V} SELECT CAST(r_score AS varchar) || CAST(f_score AS varchar) || CAST(m_score AS varchar) AS code, r_score, f_score, m_score, count(*) AS customers, round(avg(recency_days), 6) AS avg_recency, round(avg(frequency), 6) AS avg_frequency,
      round(avg(monetary), 4) AS avg_monetary, round(count(*) FILTER (WHERE frequency > 1) / count(*), 6) AS repeat_rate FROM rfm GROUP BY ALL""",
    "survival_input": f"WITH {_V} SELECT * FROM surv",
    "kaplan_meier": f"WITH {_V} SELECT * FROM km",
    "survival_summary": f"WITH {_V} SELECT coalesce(max_by(survival, day) FILTER (WHERE day <= 90), 1) AS survival_90, coalesce(max_by(survival, day) FILTER (WHERE day <= 180), 1) AS survival_180, min(day) FILTER (WHERE survival <= 0.5) AS median_day FROM km",
    "first_order_experience": f"WITH {_V} SELECT * FROM experience",
    "experience_chi2": f"""WITH {_V}, n AS (SELECT repurchased AS r, delivery_delayed AS l, CAST(count(*) AS double) AS n FROM experience GROUP BY 1, 2),
      t AS (SELECT coalesce(sum(n) FILTER (WHERE NOT l AND NOT r), 0) AS a, coalesce(sum(n) FILTER (WHERE NOT l AND r), 0) AS b, coalesce(sum(n) FILTER (WHERE l AND NOT r), 0) AS c, coalesce(sum(n) FILTER (WHERE l AND r), 0) AS d FROM n)
      SELECT a, b, c, d, round((a+b+c+d) * pow(abs(a*d-b*c) - least((a+b+c+d)/2, abs(a*d-b*c)), 2) / nullif((a+b)*(c+d)*(a+c)*(b+d), 0), 6) AS chi2, round(c / nullif(a + c, 0), 6) AS late_single, round(d / nullif(b + d, 0), 6) AS late_repeat FROM t""",
    "experience_welch": f"""WITH {_V}, m AS (SELECT avg(review_score) FILTER (WHERE NOT repurchased) AS m0, avg(review_score) FILTER (WHERE repurchased) AS m1, var_samp(review_score) FILTER (WHERE NOT repurchased) / nullif(count(review_score) FILTER (WHERE NOT repurchased), 0) AS s0,
      var_samp(review_score) FILTER (WHERE repurchased) / nullif(count(review_score) FILTER (WHERE repurchased), 0) AS s1, count(review_score) FILTER (WHERE NOT repurchased) AS n0, count(review_score) FILTER (WHERE repurchased) AS n1 FROM experience)
      SELECT round(m0, 6) AS mean_single, round(m1, 6) AS mean_repeat, round((m0 - m1) / nullif(sqrt(s0 + s1), 0), 6) AS t, round(pow(s0 + s1, 2) / nullif(s0*s0/nullif(n0-1, 0) + s1*s1/nullif(n1-1, 0), 0), 4) AS df FROM m""",
    "category_repeat_profile": """WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN p_type LIKE 'PROMO%' THEN lower(p_type) ELSE coalesce(p_type, 'unknown') END AS category, sum(CAST(l_extendedprice AS decimal(18,2))) AS value
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
      f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, value DESC, category) AS r FROM v),
      n AS (SELECT o_custkey, count(DISTINCT o_orderkey) > 1 AS rep FROM orders GROUP BY 1)
      SELECT category, count(*) AS customers, count(*) FILTER (WHERE rep) AS repeaters, round(count(*) FILTER (WHERE rep) / count(*), 6) AS repeat_rate FROM f JOIN n USING (o_custkey) WHERE r = 1 GROUP BY 1 HAVING count(*) >= 5""",
}
