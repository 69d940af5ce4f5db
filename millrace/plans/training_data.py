"""Queries of the general training-data operators (problems 2, 3, 5, 6 and 7) and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import norm_id
from millrace.operators.features import distinct_activities, feature_store, feature_table, features_as_of
from millrace.operators.history import history
from millrace.operators.known_at import as_known, period_for, snapshots
from millrace.operators.orphans import orphan_references
from millrace.sources.lines import Layout, classify_lines
from millrace.sources.tables import table

AS_OF = datetime(2018, 6, 1)

# The column order of the two kinds of file.
ORDERS = Layout(
    ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"),
    {"order_purchase_timestamp": "moment", "order_delivered_customer_date": "moment?"},
)
PAYMENTS = Layout(("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"), {"payment_value": "amount"})


def _cells(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "customer_orders")
    acts = distinct_activities(events, "customer_unique_id", "order_id", "event_type", "purchase_ts", "paid_value")
    return features_as_of(feature_store(acts), AS_OF)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select(F.col("entity").alias("customer_unique_id"), F.col("kind").alias("event_type"), F.col("last_item").alias("last_order_id"))


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return c.select(
        F.col("entity").alias("customer_unique_id"), F.col("kind").alias("event_type"), F.col("n").alias("n_events"), F.col("total").cast("decimal(38,2)").alias("total_paid"),
        "last_ts", "n_30d", F.col("total_90d").cast("decimal(38,2)").alias("total_90d"),
    )


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    t = feature_table(_cells(spark, d), AS_OF)
    cell = lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string"), F.lit("@"), e["value"]["recency_days"].cast("string"))
    listed = F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("features"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), cell), ";")
    return t.select(F.col("entity").alias("customer_unique_id"), F.size("features").alias("n_types"), "n_all", "last_ts", listed.alias("features"))


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, d, "raw_lines")
    paid = F.coalesce(F.col("source_file").contains("order_payments_"), F.lit(False))
    return classify_lines(raw.where(~paid), "line", ORDERS), classify_lines(raw.where(paid), "line", PAYMENTS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    orders, payments = _lines(spark, d)
    return orders.select("line_id", "reason").unionByName(payments.select("line_id", "reason")).where(F.col("reason").isNotNull())


def _moment(c: str) -> Column:
    return F.btrim(F.col(f"record.{c}"), F.lit(" \t")).try_cast("timestamp_ntz")


def _unread(typed: dict[str, Column]) -> Column:
    """Fields of a sound record that hold text but no value of their type, as `name=text`: no field is lost silently."""
    lost = [F.when((_field(c) != "") & v.isNull(), F.concat(F.lit(f"{c}="), _field(c))) for c, v in typed.items()]
    return F.concat_ws(";", *lost).alias("unread")


def _field(c: str) -> Column:
    return F.btrim(F.col(f"record.{c}"), F.lit(" \t"))


def p3_orders(spark: SparkSession, d: str) -> DataFrame:
    orders, _ = _lines(spark, d)
    typed = {c: _moment(c) for c in ORDERS.fields[3:]}
    return orders.where(F.col("reason").isNull()).select("line_id", *[_field(c).alias(c) for c in ORDERS.fields[:3]], *[v.alias(c) for c, v in typed.items()], _unread(typed))


def p3_payments(spark: SparkSession, d: str) -> DataFrame:
    _, payments = _lines(spark, d)
    typed = {c: _field(c).try_cast("int") for c in ("payment_sequential", "payment_installments")} | {"payment_value": _field("payment_value").try_cast("decimal(18,4)")}
    return payments.where(F.col("reason").isNull()).select("line_id", _field("order_id").alias("order_id"), F.col("record.payment_type").alias("payment_type"), *[v.alias(c) for c, v in typed.items()], _unread(typed))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    orders, payments = _lines(spark, d)
    both = orders.select("source_file", "reason").unionByName(payments.select("source_file", "reason"))
    return both.groupBy("source_file", F.coalesce("reason", F.lit("sound")).alias("state")).agg(F.count(F.lit(1)).alias("n_lines"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = table(spark, d, "raw_orders"), table(spark, d, "raw_customers")
    parts = [orphan_references(orders, ["order_id"], "customer_id", "loaded_at", customers, "customer_id", "loaded_at", "deleted_at").select(F.lit("raw_orders").alias("child_table"), "order_id", F.lit(0).cast("bigint").alias("line_no"), "loaded_at", "kind")]
    for name, line in (("raw_order_items", "order_item_id"), ("raw_order_payments", "payment_sequential")):
        child = table(spark, d, name).select("order_id", F.col("order_id").alias("ref"), F.btrim(line).try_cast("bigint").alias("line_no"), "loaded_at")
        found = orphan_references(child, ["order_id", "line_no"], "ref", "loaded_at", orders, "order_id", "loaded_at", "deleted_at")
        parts.append(found.select(F.lit(name).alias("child_table"), "order_id", "line_no", "loaded_at", "kind"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("child_table", F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("")).alias("period"), "order_id", "line_no", "kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("child_table", "period", "kind").agg(F.count(F.lit(1)).alias("n_references"))


def symbol6(c: str) -> Column:
    s = norm_id(c)
    return F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "universe_manifest")
    period = period_for(entries, symbol6("symbol"), "recorded_at")
    snaps = snapshots(entries, symbol6("symbol"), "manifest_id", "listing_date", "delisting_date", "recorded_at", period)
    found = as_known(table(spark, d, "krx_panel"), "price_id", symbol6("symbol"), "trade_ts", snaps, period)
    return found.select(F.col("event_id").alias("price_id"), F.col("version").alias("manifest_id"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "disclosure_fact")
    day = F.to_date(F.try_to_timestamp(F.substring("receipt_no", 1, 8), F.lit("yyyyMMdd")))
    return history(facts, ["corp_code", "report_year", "report_code"], ["concept", "context_key", "unit"], "receipt_no", day, ["value", "value_text"], "fact_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("fact_id", F.col("valid_from").cast("string").alias("valid_from"), F.coalesce(F.col("valid_to").cast("string"), F.lit("")).alias("valid_to"))


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)


QUERIES = {f.__name__: f for f in (p2_found, p2_cells, p2_features, p3_found, p3_orders, p3_payments, p3_report, p5_found, p5_report, p6_found, p7_found, p7_history)}

_ACTS = r"""
acts AS (
  SELECT lower(trim(customer_unique_id, ' ' || chr(9))) AS customer_unique_id, lower(trim(event_type, ' ' || chr(9))) AS event_type,
         lower(trim(order_id, ' ' || chr(9))) AS order_id, purchase_ts, max(paid_value) AS paid_value
  FROM customer_orders
  WHERE customer_unique_id IS NOT NULL AND purchase_ts < TIMESTAMP '2018-06-01'
  GROUP BY 1, 2, 3, 4)
"""

_CLASSED = r"""
fields AS (
  SELECT line_id, source_file, coalesce(line, '') AS line, source_file LIKE '%order_payments_%' AS paid FROM raw_lines),
parsed AS (
  SELECT *, regexp_full_match(line, '(?s)(("([^"]|"")*"|[^",]*),)*("([^"]|"")*"|[^",]*)') AS well_quoted,
         regexp_extract_all(line || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1) AS f FROM fields),
vals AS (
  SELECT *, list_transform(f, lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) AS v FROM parsed),
judged AS (
  SELECT *, CASE WHEN NOT well_quoted THEN 'quoting'
    WHEN len(v) <> CASE WHEN paid THEN 5 ELSE 8 END THEN 'column_count'
    WHEN paid AND NOT regexp_full_match(v[5], '[0-9]+(\.[0-9]+)?') THEN 'invalid_value'
    WHEN NOT paid AND NOT (regexp_full_match(v[4], '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AND v[4] NOT LIKE '% 24:%' AND try_cast(v[4] AS timestamp) IS NOT NULL) THEN 'invalid_value'
    WHEN NOT paid AND v[7] <> '' AND NOT (regexp_full_match(v[7], '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') AND v[7] NOT LIKE '% 24:%' AND try_cast(v[7] AS timestamp) IS NOT NULL) THEN 'invalid_value'
  END AS reason FROM vals)
"""

_ORPHANS = r"""
o AS (SELECT lower(trim(order_id, ' ' || chr(9))) AS order_id, lower(trim(customer_id, ' ' || chr(9))) AS customer_id, loaded_at, deleted_at FROM raw_orders),
children AS (
  SELECT 'raw_orders' AS child_table, order_id, CAST(0 AS bigint) AS line_no, min(loaded_at) AS l,
         arg_min(customer_id, loaded_at) FILTER (WHERE customer_id <> '') AS ref FROM o GROUP BY ALL
  UNION ALL
  SELECT 'raw_order_items', lower(trim(order_id, ' ' || chr(9))) AS k, CAST(order_item_id AS bigint) AS n, min(loaded_at), k FROM raw_order_items GROUP BY k, n
  UNION ALL
  SELECT 'raw_order_payments', lower(trim(order_id, ' ' || chr(9))) AS k, CAST(payment_sequential AS bigint) AS n, min(loaded_at), k FROM raw_order_payments GROUP BY k, n),
parents AS (
  SELECT 'raw_orders' AS of, lower(trim(customer_id, ' ' || chr(9))) AS key, loaded_at, deleted_at FROM raw_customers
  UNION ALL SELECT t.of, order_id, loaded_at, deleted_at FROM o, (VALUES ('raw_order_items'), ('raw_order_payments')) t(of)),
verdicts AS (
  SELECT c.child_table, strftime(c.l, '%Y-%m') AS period, c.order_id, c.line_no,
         CASE WHEN count(p.key) = 0 THEN 'missing' WHEN bool_or(p.loaded_at <= c.l AND (p.deleted_at IS NULL OR p.deleted_at > c.l)) THEN NULL
              WHEN bool_and(p.loaded_at > c.l) THEN 'late' ELSE 'deleted' END AS kind
  FROM children c LEFT JOIN parents p ON p.of = c.child_table AND p.key = c.ref
  WHERE c.ref <> '' GROUP BY ALL)
"""
_ORPHANS = _ORPHANS.replace("GROUP BY ALL)\n", "GROUP BY c.child_table, c.l, c.order_id, c.line_no)\n")

_HISTORY = r"""
f AS (SELECT *, CAST(strptime(substr(receipt_no, 1, 8), '%Y%m%d') AS date) AS day FROM disclosure_fact WHERE receipt_no IS NOT NULL),
days AS (SELECT corp_code, report_year, report_code, day, max(receipt_no) AS receipt_no FROM f GROUP BY ALL),
marks AS (SELECT *, row_number() OVER w AS seq FROM days WINDOW w AS (PARTITION BY corp_code, report_year, report_code ORDER BY day)),
stated AS (
  SELECT f.corp_code, f.report_year, f.report_code, concept, context_key, unit, m.seq, m.day, m.receipt_no,
         min(fact_id) AS fact_id, arg_min(row(value, value_text), fact_id) AS content
  FROM f JOIN marks m USING (corp_code, report_year, report_code, day, receipt_no) GROUP BY ALL),
steps AS (
  SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(content) OVER w IS NOT DISTINCT FROM content THEN 0 ELSE 1 END AS opens
  FROM stated WINDOW w AS (PARTITION BY corp_code, report_year, report_code, concept, context_key, unit ORDER BY seq)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY corp_code, report_year, report_code, concept, context_key, unit ORDER BY seq) AS run FROM steps),
versions AS (
  SELECT corp_code, report_year, report_code, concept, context_key, unit, run, min(fact_id) FILTER (WHERE opens = 1) AS fact_id,
         min(day) AS valid_from, max(seq) + 1 AS stop, arg_min(content, seq) AS content, arg_min(receipt_no, seq) AS receipt_no FROM runs GROUP BY ALL),
closed AS (
  SELECT v.*, m.day AS valid_to FROM versions v
  LEFT JOIN marks m ON m.corp_code = v.corp_code AND m.report_year = v.report_year AND m.report_code = v.report_code AND m.seq = v.stop)
"""

SQL = {
    "p2_found": f"WITH {_ACTS} SELECT customer_unique_id, event_type, arg_max(order_id, (purchase_ts, order_id)) AS last_order_id FROM acts GROUP BY 1, 2",
    "p2_cells": f"""WITH {_ACTS} SELECT customer_unique_id, event_type, count(*) AS n_events, CAST(coalesce(sum(paid_value), 0) AS decimal(38,2)) AS total_paid, max(purchase_ts) AS last_ts,
      count(*) FILTER (WHERE purchase_ts >= TIMESTAMP '2018-06-01' - INTERVAL 30 DAY) AS n_30d,
      CAST(coalesce(sum(paid_value) FILTER (WHERE purchase_ts >= TIMESTAMP '2018-06-01' - INTERVAL 90 DAY), 0) AS decimal(38,2)) AS total_90d FROM acts GROUP BY 1, 2""",
    "p2_features": f"""WITH {_ACTS}, c AS (SELECT customer_unique_id, coalesce(event_type, 'NULL') AS k, count(*) AS n, max(purchase_ts) AS last_ts FROM acts GROUP BY 1, 2)
      SELECT customer_unique_id, CAST(count(*) AS integer) AS n_types, CAST(sum(n) AS bigint) AS n_all, max(last_ts) AS last_ts, string_agg(k || '=' || n || '@' || date_diff('day', CAST(last_ts AS date), DATE '2018-06-01'), ';' ORDER BY k) AS features FROM c GROUP BY 1""",
    "p3_found": f"WITH {_CLASSED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_orders": f"""WITH {_CLASSED} SELECT line_id, nullif(v[1], '') AS order_id, nullif(v[2], '') AS customer_id, nullif(v[3], '') AS order_status, try_cast(v[4] AS timestamp) AS order_purchase_timestamp,
      try_cast(v[5] AS timestamp) AS order_approved_at, try_cast(v[6] AS timestamp) AS order_delivered_carrier_date, try_cast(v[7] AS timestamp) AS order_delivered_customer_date,
      try_cast(v[8] AS timestamp) AS order_estimated_delivery_date, coalesce((SELECT string_agg(n || '=' || x, ';' ORDER BY i) FROM (
        SELECT unnest([4, 5, 6, 7, 8]) AS i, unnest(['order_purchase_timestamp', 'order_approved_at', 'order_delivered_carrier_date', 'order_delivered_customer_date', 'order_estimated_delivery_date']) AS n, unnest(v[4:8]) AS x)
        WHERE x <> '' AND try_cast(x AS timestamp) IS NULL), '') AS unread FROM judged WHERE reason IS NULL AND NOT paid""",
    "p3_payments": f"WITH {_CLASSED} SELECT line_id, CASE WHEN f[3] LIKE '\"%' THEN replace(f[3][2:-2], '\"\"', '\"') ELSE nullif(f[3], '') END AS payment_type, CAST(v[5] AS decimal(18,4)) AS payment_value, nullif(v[1], '') AS order_id, CASE WHEN regexp_full_match(v[2], '[+-]?[0-9]+') THEN try_cast(v[2] AS integer) END AS payment_sequential, CASE WHEN regexp_full_match(v[4], '[+-]?[0-9]+') THEN try_cast(v[4] AS integer) END AS payment_installments, concat_ws(';', CASE WHEN v[2] <> '' AND NOT coalesce(regexp_full_match(v[2], '[+-]?[0-9]+') AND try_cast(v[2] AS integer) IS NOT NULL, false) THEN 'payment_sequential=' || v[2] END, CASE WHEN v[4] <> '' AND NOT coalesce(regexp_full_match(v[4], '[+-]?[0-9]+') AND try_cast(v[4] AS integer) IS NOT NULL, false) THEN 'payment_installments=' || v[4] END) AS unread FROM judged WHERE reason IS NULL AND paid",
    "p3_report": f"WITH {_CLASSED} SELECT source_file, coalesce(reason, 'sound') AS state, count(*) AS n_lines FROM judged GROUP BY 1, 2",
    "p5_found": f"WITH {_ORPHANS} SELECT child_table, period, order_id, line_no, kind FROM verdicts WHERE kind IS NOT NULL",
    "p5_report": f"WITH {_ORPHANS} SELECT child_table, period, kind, count(*) AS n_references FROM verdicts WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
    "p6_found": r"""
WITH m AS (SELECT *, lpad(lower(trim(symbol, ' ' || chr(9))), 6, '0') AS s FROM universe_manifest),
k AS (SELECT price_id, trade_ts, lpad(lower(trim(symbol, ' ' || chr(9))), 6, '0') AS s FROM krx_panel),
known AS (
  SELECT k.price_id, k.trade_ts, m.manifest_id, m.listing_date, m.delisting_date,
         row_number() OVER (PARTITION BY k.price_id, m.listing_date ORDER BY m.recorded_at DESC, m.manifest_id DESC) AS r
  FROM k JOIN m ON m.s = k.s AND m.recorded_at <= k.trade_ts)
SELECT price_id, arg_max(manifest_id, listing_date) AS manifest_id FROM known
WHERE r = 1 AND listing_date <= CAST(trade_ts AS date) AND (delisting_date IS NULL OR delisting_date > CAST(trade_ts AS date)) GROUP BY 1""",
    "p7_found": f"WITH {_HISTORY} SELECT fact_id, CAST(valid_from AS varchar) AS valid_from, coalesce(CAST(valid_to AS varchar), '') AS valid_to FROM closed",
    "p7_history": f"""WITH {_HISTORY} SELECT corp_code, report_year, report_code, concept, context_key, unit, content[1] AS value, content[2] AS value_text, fact_id, receipt_no, valid_from, valid_to, valid_to IS NULL AS is_current FROM closed""",
}
