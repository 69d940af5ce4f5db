"""Customer analysis: typed views of raw orders, cohorts, retention, RFM, survival and the metric tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import ntile
from millrace.session import materialise


def moment(c: str) -> Column:
    """Text as a time; empty and senseless text is NULL."""
    return F.nullif(F.col(c), F.lit("")).try_cast("timestamp_ntz")


def delivered_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Delivered orders with a purchase time and a known person, the one who bought. Keys are compared as they stand."""
    people = customers.where(F.col("customer_unique_id").isNotNull()).select("customer_id", "customer_unique_id")
    typed = orders.where(F.col("order_status") == "delivered").select(
        "order_id", "customer_id", moment("order_purchase_timestamp").alias("purchase_ts"), moment("order_delivered_customer_date").alias("delivered_ts"), moment("order_estimated_delivery_date").alias("estimated_delivery_ts")
    )
    return typed.where(F.col("purchase_ts").isNotNull()).join(people, "customer_id")


def order_value(payments: DataFrame) -> DataFrame:
    """Paid sum of each order; NULL where no payment has a value."""
    return payments.groupBy("order_id").agg(F.sum(F.nullif("payment_value", F.lit("")).try_cast("decimal(14,2)")).cast("decimal(24,2)").alias("paid_value"))


def customer_orders(delivered: DataFrame, value: DataFrame) -> DataFrame:
    """Delivered orders with their paid sum, 0 where there is none."""
    return delivered.join(value, "order_id", "left").withColumn("paid_value", F.coalesce("paid_value", F.lit(0)).cast("decimal(24,2)"))


def month(c: str) -> Column:
    return F.trunc(c, "month")


def months_between(a: Column, b: Column) -> Column:
    """Calendar months from a to b."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def identifier_effect(populations: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """How the repeat rate depends on what is taken for the customer: a row per population of orders and key column.

    A NULL key is a customer like any other.
    """
    every = reduce(DataFrame.unionByName, [rows.select(F.lit(p).alias("population"), F.lit(name).alias("identifier"), F.col(c).cast("string").alias("id"), "order_id") for p, rows in populations.items() for name, c in keys.items()])
    per = every.groupBy("population", "identifier", "id").agg(F.count_distinct("order_id").alias("n"))
    repeat = F.count_if(F.col("n") > 1)
    return per.groupBy("population", "identifier").agg(F.count(F.lit(1)).alias("n_customers"), repeat.alias("n_repeat"), F.round(repeat / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("repeat_rate"))


def retention_grid(buys: DataFrame, customer: str, order: str, ts: str) -> DataFrame:
    """Active customers of each cohort (month of the first purchase) in each later month, with zero rows kept.

    Distinct (customer, month) pairs are made first; all further steps see at most one row per customer and month.
    """
    active = buys.select(F.col(customer).alias("customer"), month(ts).alias("month")).where(F.col("customer").isNotNull() & F.col("month").isNotNull()).distinct()
    first = Window.partitionBy("customer")
    active = active.withColumn("cohort", F.min("month").over(first))
    counts = active.groupBy("cohort", "month").agg(F.count(F.lit(1)).alias("n"))
    last = counts.agg(F.max("month").alias("m")).scalar()
    sizes = counts.where(F.col("cohort") == F.col("month")).select("cohort", F.col("n").alias("cohort_size"))
    spine = sizes.select("cohort", "cohort_size", F.explode(F.sequence("cohort", last, F.expr("interval 1 month"))).alias("month"))
    grid = spine.join(counts, ["cohort", "month"], "left").withColumn("n_active", F.coalesce("n", F.lit(0)))
    return grid.select("cohort", "month", months_between(F.col("cohort"), F.col("month")).alias("month_no"), "cohort_size", "n_active", F.round(F.col("n_active") / F.nullif("cohort_size", F.lit(0)), 6).alias("retention"))


def metric_tree(buys: DataFrame, customer: str, order: str, ts: str, value: str) -> DataFrame:
    """Monthly revenue as customers x orders per customer x value per order, with each factor's month before."""
    m = buys.groupBy(month(ts).alias("month")).agg(F.count_distinct(customer).alias("customers"), F.count_distinct(order).alias("orders"), F.sum(value).cast("double").alias("revenue"))
    m = m.where(F.col("month").isNotNull()).withColumns({"orders_per_customer": F.col("orders") / F.nullif("customers", F.lit(0)), "value_per_order": F.col("revenue") / F.nullif("orders", F.lit(0))})
    w = Window.orderBy("month")  # one row per month
    parts = ["customers", "orders_per_customer", "value_per_order", "revenue"]
    return m.withColumns({f"prev_{p}": F.lag(p).over(w) for p in ["month", *parts]})


def revenue_decomposition(tree: DataFrame, months: DataFrame) -> DataFrame:
    """Log changes of revenue and of its three factors, which add up to it, over the given months (of `complete_months`)."""
    parts = ("revenue", "customers", "orders_per_customer", "value_per_order")
    w = Window.orderBy("month")  # one row per month
    rows = tree.join(F.broadcast(months.select("month")), "month").withColumns({f"prev_{p}": F.lag(p).over(w) for p in parts})
    logs = {f"log_{p}": F.when((F.col(p) > 0) & (F.col(f"prev_{p}") > 0), F.log(F.col(p) / F.col(f"prev_{p}"))) for p in parts}
    out = rows.where(F.col("prev_revenue").isNotNull()).select("month", (F.col("revenue") / F.nullif("prev_revenue", F.lit(0.0)) - 1).alias("change_rate"), *[c.alias(n) for n, c in logs.items()])
    gap = F.abs(F.col("log_revenue") - F.col("log_customers") - F.col("log_orders_per_customer") - F.col("log_value_per_order"))
    return out.withColumn("reconciles", gap < 1e-8)


def complete_months(counts: DataFrame, least: int, run: int = 3) -> DataFrame:
    """Months from the first of `run` consecutive calendar months with at least `least` orders on.

    The last month of all may not be over: it is left out before runs are looked for.
    """
    w = Window.orderBy("month_no")  # one row per month
    whole = Window.partitionBy(F.lit(1))
    m = counts.withColumn("month_no", F.year("month") * 12 + F.month("month")).withColumn("_last", F.max("month_no").over(whole)).where(F.col("month_no") < F.col("_last"))
    ok = F.col("n") >= least
    for k in range(1, run):
        ok = ok & (F.lead("n", k).over(w) >= least) & (F.lead("month_no", k).over(w) == F.col("month_no") + k)
    m = m.withColumn("_starts", ok).withColumn("_first", F.min(F.when(F.col("_starts"), F.col("month_no"))).over(whole))
    return m.where(F.col("month_no") >= F.col("_first")).select("month", "n")


def rfm(buys: DataFrame, customer: str, order: str, ts: str, value: str) -> DataFrame:
    """Recency, frequency and monetary value of each customer, their scores 1..5 and the joined code.

    Recency counts from the day after the last purchase of all. Ties between customers go by customer key.
    """
    per = buys.where(F.col(customer).isNotNull()).groupBy(F.col(customer).alias("customer")).agg(F.max(ts).alias("last_ts"), F.count_distinct(order).alias("frequency"), F.sum(value).cast("double").alias("monetary"))
    per = materialise(per, "rfm")  # it is read for the anchor and ordered twice
    anchor = per.agg(F.date_add(F.to_date(F.max("last_ts")), 1).alias("a")).scalar()
    per = per.withColumn("recency_days", F.date_diff(anchor, F.to_date("last_ts")))
    per = ntile(per, [F.col("recency_days").desc(), F.col("customer")], 5, "r_score")
    per = ntile(per, [F.col("monetary").asc(), F.col("customer")], 5, "m_score")
    f_score = F.when(F.col("frequency") == 1, 1).otherwise(5)
    per = per.withColumn("f_score", f_score.cast("int"))
    return per.select("customer", "recency_days", "frequency", F.round("monetary", 2).alias("monetary"), "r_score", "f_score", "m_score", F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]).alias("code"))


def rfm_profile(scored: DataFrame) -> DataFrame:
    """Customers, averages and repeat rate of each code."""
    n = F.count(F.lit(1))
    return scored.groupBy("code", "r_score", "f_score", "m_score").agg(n.alias("customers"), F.round(F.avg("recency_days"), 6).alias("avg_recency"), F.round(F.avg("frequency"), 6).alias("avg_frequency"), F.round(F.avg("monetary"), 4).alias("avg_monetary"), F.round(F.count_if(F.col("frequency") > 1) / n, 6).alias("repeat_rate"))


def survival_input(buys: DataFrame, customer: str, order: str, ts: str) -> DataFrame:
    """Days from first to second purchase of each customer, or to the last purchase of all without one; at least 1.

    Rows count, so an order that is stated twice is two purchases. The two earliest are picked by a ranking that stops
    at two per customer before the shuffle, so a customer with any number of orders is no burden.
    """
    rows = buys.where(F.col(customer).isNotNull() & F.col(ts).isNotNull()).select(F.col(customer).alias("customer"), F.col(order).alias("order"), F.col(ts).alias("ts"))
    w = Window.partitionBy("customer").orderBy("ts", "order")
    two = rows.withColumn("k", F.row_number().over(w)).where("k <= 2")
    both = two.groupBy("customer").agg(F.min(F.when(F.col("k") == 1, F.col("ts"))).alias("first_ts"), F.min(F.when(F.col("k") == 2, F.col("ts"))).alias("second_ts"))
    stop = F.coalesce("second_ts", rows.agg(F.max("ts").alias("e")).scalar())
    return both.select("customer", F.greatest(F.date_diff(F.to_date(stop), F.to_date("first_ts")), F.lit(1)).alias("duration_days"), F.col("second_ts").isNotNull().alias("event"))


def kaplan_meier(times: DataFrame, duration: str, event: str) -> DataFrame:
    """Survival by day: events, at risk, and the product of 1 - d/n; 0 once all at risk have the event."""
    per = times.groupBy(F.col(duration).alias("day")).agg(F.count_if(event).alias("d"), F.count(F.lit(1)).alias("leaving"))
    rest = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    at = per.withColumn("at_risk", F.sum("leaving").over(rest))
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    dead = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(past)
    return at.withColumn("survival", F.round(F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(step).over(past))), 6)).where("d > 0").select("day", "d", "at_risk", "survival")


def survival_summary(curve: DataFrame, days: list[int]) -> DataFrame:
    """One row: survival at each of some days (1 before the first event) and the first day at or below one half."""
    at = [F.coalesce(F.max_by("survival", F.when(F.col("day") <= d, F.col("day"))), F.lit(1.0)).alias(f"survival_{d}") for d in days]
    return curve.agg(*at, F.min(F.when(F.col("survival") <= 0.5, F.col("day"))).alias("median_day"))


def first_order_experience(buys: DataFrame, reviews: DataFrame) -> DataFrame:
    """(customer_unique_id, repurchased, review_score, delivery_delayed) of each customer's first order.

    The first order by time, then id; orders without a delivery or an estimate are left out after that. review_score
    is the mean of the order's reviews (order_id, review_score as text), NULL without any.
    """
    rows = buys.where(F.col("customer_unique_id").isNotNull())
    first = F.min(F.struct("purchase_ts", "order_id", "delivered_ts", "estimated_delivery_ts")).alias("f")
    per = rows.groupBy("customer_unique_id").agg(first, (F.count_distinct("order_id") > 1).alias("repurchased"))
    per = per.select("customer_unique_id", "repurchased", "f.order_id", "f.delivered_ts", "f.estimated_delivery_ts").where(F.col("delivered_ts").isNotNull() & F.col("estimated_delivery_ts").isNotNull())
    mean = reviews.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.avg(F.nullif("review_score", F.lit("")).try_cast("double")).alias("review_score"))
    return per.join(mean, "order_id", "left").select("customer_unique_id", "repurchased", F.round("review_score", 6).alias("review_score"), (F.col("delivered_ts") > F.col("estimated_delivery_ts")).alias("delivery_delayed"))


def category_profile(orders: DataFrame, items: DataFrame, products: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """Customers and repeat rate by the category that they spent most on in their first order, categories of at least `least` customers.

    orders: customer, order, ts; items: order, product, price; products: product, category; names: category, name. A
    category goes by its name if it has one, else as it stands, else as unknown. Prices are summed by order and
    category; of equal sums the smaller category counts.
    """
    named = products.join(names, "category", "left").select("product", F.coalesce("name", "category", F.lit("unknown")).alias("category"))
    spent = items.join(named, "product").groupBy("order", "category").agg(F.sum("price").alias("value"))
    mine = orders.join(spent, "order").groupBy("customer", "order", "ts", "category").agg(F.sum("value").alias("value"))
    first = mine.groupBy("customer").agg(F.min(F.struct("ts", (-F.col("value")).alias("v"), "category")).alias("f"))
    repeat = orders.groupBy("customer").agg((F.count_distinct("order") > 1).alias("repurchased"))
    out = first.join(repeat, "customer").groupBy(F.col("f.category").alias("category")).agg(F.count(F.lit(1)).alias("customers"), F.count_if("repurchased").alias("repeaters"))
    return out.where(F.col("customers") >= least).withColumn("repeat_rate", F.round(F.col("repeaters") / F.col("customers"), 6))
