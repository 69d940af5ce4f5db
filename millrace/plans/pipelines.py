"""Queries that go through sources, sinks and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace import sinks
from millrace.functions import answers as A
from millrace.operators import joins as J
from millrace.session import work_dir
from millrace.sources import files
from millrace.sources.tables import table
from millrace.streaming import windows as W


def _place(s: SparkSession, name: str) -> str:
    return f"{work_dir(s)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(s, d):
    """Raw orders written as CSV and loaded again as text; empty text comes back as NULL."""
    t = table(s, d, "raw_orders").drop("loaded_at", "deleted_at")
    path = _place(s, "csv")
    sinks.write_csv(t, path)
    return files.read_text_table(s, path, t.columns)


def jsonl_round_trip(s, d):
    path = _place(s, "jsonl")
    sinks.append_jsonl(table(s, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_jsonl(s, path, "event_id bigint, user_id bigint, event_type string, value double")


def log_parse(s, d):
    """Events as a tab-separated log, cut into fields again and counted by soundness."""
    path = _place(s, "log")
    e = table(s, d, "events")
    bad = F.when(F.col("event_id") % 10 == 0, F.concat_ws("\t", F.col("event_id").cast("string"), "event_type"))
    e.select(F.coalesce(bad, F.concat_ws("\t", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")).alias("line")).write.text(path)
    return files.read_log(s, path, ["event_id", "user_id", "event_type"]).groupBy("sound").agg(F.count(F.lit(1)).alias("n"))


def nested_flatten(s, d):
    """Questions nested by title and context, written as JSON and flattened again."""
    qa = table(s, d, "qa_examples").where(F.col("question_id").isNotNull() & F.col("title").isNotNull()).dropDuplicates(["question_id"])
    text = F.transform(F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: a.isNotNull()), lambda a: F.struct(a.alias("text")))
    q = qa.select("title", F.coalesce("context", F.lit("")).alias("context"), F.struct(F.col("question_id").alias("id"), "question", text.alias("answers"), F.coalesce("impossible", F.lit(False)).alias("is_impossible")).alias("q"))
    p = q.groupBy("title", "context").agg(F.collect_list("q").alias("qas")).groupBy("title").agg(F.collect_list(F.struct("context", "qas")).alias("paragraphs"))
    path = _place(s, "nested")
    p.write.json(path)
    flat = files.flatten_questions(s.read.schema(p.schema).json(path))
    return flat.select("title", F.col("id").alias("question_id"), F.size("answers").alias("n_answers"), "impossible")


def parquet_audit(s, d):
    return files.audit_table(table(s, d, "customer_orders")).select("column", "n", "n_null")


def parquet_prefix(s, d):
    return files.read_prefix(s, f"{d}/nation.parquet", 10).select("n_nationkey", "n_name")


def partitioned_write(s, d):
    path = _place(s, "orders")
    sinks.write_table(table(s, d, "orders"), path, ["o_orderstatus"])
    return s.read.parquet(path).where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


def key_violations(s, d):
    return J.repeated_keys(table(s, d, "raw_customers").where(F.col("customer_id").isNotNull()), ["customer_id"])


def amounts(s, d):
    """Payment values as strict whole amounts in hundredths."""
    p = table(s, d, "raw_order_payments").where(F.col("payment_value").isNotNull())
    cents = F.replace("payment_value", F.lit("."), F.lit(""))
    return p.groupBy("payment_type").agg(F.sum(A.amount(cents, F.lit(1))).cast("decimal(38,0)").alias("total"), F.count_if(A.amount(cents, F.lit(1)).isNull()).alias("n_bad"))


def question_forms(s, d):
    qa = table(s, d, "qa_examples").where(F.col("question").isNotNull())
    return qa.select(A.normalize_question(F.col("question")).alias("normal"), A.canonical_question(F.col("question")).alias("canonical")).distinct()


def csv_projection(s, d):
    """Two columns of a table written as CSV, for large parts: projection and filter at the scan."""
    path = _place(s, "csv")
    sinks.write_csv(table(s, d, "part"), path)
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return files.read_columns(s, path, schema, ["p_partkey", "p_size"]).where(F.col("p_size") > 40)


def gzip_audit(s, d):
    """Orders as compressed CSV, read with types: rows, NULLs, order of keys, and a sample by the key's hash."""
    path = _place(s, "gz")
    o = table(s, d, "orders")
    o.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")).write.csv(path, header=True, compression="gzip")
    x = s.read.csv(path, header=True, schema="o_orderkey bigint, o_orderstatus string, o_totalprice double")
    sampled = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("bigint") % 40 == 17
    return x.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice").isNull()).alias("n_null"), F.count_if(sampled).alias("n_sampled"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def bzip2_lines(s, d):
    """Lines of a bzip2 log by day."""
    path = _place(s, "bz2")
    table(s, d, "events").select(F.concat_ws("\t", F.date_format("ts", "yyyyMMdd"), "event_type").alias("line")).write.text(path, compression="bzip2")
    return s.read.text(path).groupBy(F.substring("value", 1, 8).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def log_audit(s, d):
    """Impressions as tab-separated lines: malformed ones, and those whose price is above the bid or no number."""
    path = _place(s, "log")
    e = table(s, d, "events")
    line = F.when(F.col("event_id") % 9 == 0, "cut").otherwise(F.concat_ws("\t", F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("value").cast("string")), F.lit("60")))
    e.select(line.alias("line")).write.text(path)
    log = files.read_log(s, path, ["event_id", "price", "bid"])
    price = F.col("price").try_cast("double")
    return files.audit_log(log, {"number": price.isNotNull(), "price": (price >= 0) & (price <= F.col("bid").try_cast("double"))})


def judgements_tsv(s, d):
    """Judgements as a tab-separated file: positive grades, and only queries that have one."""
    path = _place(s, "qrels")
    v = table(s, d, "embeddings")
    v.select((F.col("vec_id") % 20).alias("qid"), F.col("vec_id").alias("doc"), F.when(F.col("vec_id") % 20 < 15, F.col("label") % 3).otherwise(0).alias("grade")).write.csv(path, sep="\t", header=True)
    asked = s.range(30).select(F.col("id").cast("string").alias("qid"))
    rows, kept = files.read_judgements(s, path, asked)
    return kept.join(rows, "qid").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("grades"))


def form_links(s, d):
    """Order lines as nested forms, cut into entities and links again."""
    l = table(s, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "question").when(F.col("l_returnflag") == "N", "answer").otherwise("other")
    links = F.array(F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1), F.array(F.col("l_linenumber"), F.col("l_linenumber") + 2))
    box = F.array(*[F.lit(0.0)] * 4)
    forms = l.groupBy(F.col("l_orderkey").alias("document")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), label.alias("label"), F.lit("t").alias("text"), box.alias("box"), links.alias("linking"))).alias("form"))
    path = _place(s, "forms")
    forms.write.json(path)
    return files.form_entities(s.read.schema(forms.schema).json(path))[1]


def several_days(s, d):
    """Two days of a table that is kept by day, as one."""
    path = _place(s, "days")
    sinks.write_table(table(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), path, ["day"])
    return files.read_days(s, path, ["2024-01-03", "2024-01-17"]).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def nested_csv(s, d):
    """A nested column as JSON within CSV, and back."""
    path = _place(s, "csv")
    qa = table(s, d, "qa_examples").where(F.col("question_id").isNotNull()).select("question_id", F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("answers")).distinct()
    sinks.write_csv(qa, path)
    back = files.read_text_table(s, path, ["question_id", "answers"])
    return back.select("question_id", F.size(F.from_json("answers", "array<string>")).alias("n"))


def replaced_table(s, d):
    """A table made anew in the catalogue with its statistics, added to, and read back through a view."""
    name = f"millrace_orders_{uuid.uuid4().hex}"
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = sinks.replace_table(s, name, o.where("o_orderkey % 2 = 0"), _place(s, "made"))
    sinks.insert_rows(s, name, o.where("o_orderkey % 2 = 1"))
    s.catalog.refreshTable(name)
    s.table(name).where("o_totalprice > 100000").createOrReplaceTempView("dear_orders")
    del t
    return s.table("dear_orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def resumed_append(s, d):
    """Records appended in two runs that overlap: each comes once."""
    path = _place(s, "resumed")
    e = table(s, d, "events").select("event_id", "event_type")
    for part in ("event_id < 600", "event_id < 1000"):
        sinks.append_once(e.where(part), path, "event_id", "event_id bigint, event_type string")
    return files.read_jsonl(s, path, "event_id bigint, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_tumbling(s, d):
    return W.run_available(W.tumbling(W.event_stream(s, d, "events"), "ts", "event_type", "value", "1 day"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(s, d):
    return W.run_available(W.sliding(W.event_stream(s, d, "events"), "ts", "12 hours", "6 hours"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_sessions(s, d):
    return W.run_available(W.user_sessions(W.event_stream(s, d, "events"), "ts", "user_id", "30 minutes"), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def stream_token_bucket(s, d):
    return W.run_available(W.token_bucket_stream(W.event_stream(s, d, "events"), "user_id", "ts", "event_id", 2.0, 1 / 21_600))


QUERIES = {f.__name__: f for f in (csv_round_trip, jsonl_round_trip, log_parse, nested_flatten, parquet_audit, parquet_prefix, partitioned_write, key_violations, amounts, question_forms, csv_projection, gzip_audit, bzip2_lines, log_audit, judgements_tsv, form_links, several_days, nested_csv, replaced_table, resumed_append, stream_tumbling, stream_sliding, stream_sessions, stream_token_bucket)}

SQL = {
    "csv_projection": "SELECT p_partkey, p_size FROM part WHERE p_size > 40",
    "gzip_audit": "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NULL) AS n_null, count(*) FILTER (WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS varchar)), 1, 8) AS bigint) % 40 = 17) AS n_sampled, round(avg(round(o_totalprice, 2)), 4) AS mean FROM orders GROUP BY 1",
    "bzip2_lines": "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "log_audit": "SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS malformed, count(*) FILTER (WHERE event_id % 9 <> 0 AND event_id % 7 = 0) AS invalid_number, count(*) FILTER (WHERE event_id % 9 <> 0 AND (event_id % 7 = 0 OR NOT value BETWEEN 0 AND 60)) AS invalid_price FROM events",
    "judgements_tsv": "SELECT CAST(vec_id % 20 AS varchar) AS qid, count(*) AS n, CAST(sum(label % 3) AS bigint) AS grades FROM embeddings WHERE vec_id % 20 < 15 AND label % 3 > 0 GROUP BY 1",
    "form_links": "WITH p AS (SELECT DISTINCT l_orderkey AS document, l_linenumber AS question, unnest([l_linenumber + 1, l_linenumber + 2]) AS answer FROM lineitem) SELECT * FROM p WHERE (document, question) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R') AND (document, answer) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'N')",
    "several_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(event_id) AS last FROM events WHERE strftime(ts, '%Y-%m-%d') IN ('2024-01-03', '2024-01-17') GROUP BY 1",
    "nested_csv": "SELECT DISTINCT question_id, CAST(len(list_filter(coalesce(answers, []), lambda a: a IS NOT NULL)) AS integer) AS n FROM qa_examples WHERE question_id IS NOT NULL",
    "replaced_table": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1",
    "resumed_append": "SELECT event_type, count(*) AS n FROM events WHERE event_id < 1000 GROUP BY 1",
    "csv_round_trip": "SELECT nullif(order_id, '') AS order_id, nullif(customer_id, '') AS customer_id, nullif(order_status, '') AS order_status, nullif(order_purchase_timestamp, '') AS order_purchase_timestamp, nullif(order_approved_at, '') AS order_approved_at, nullif(order_delivered_carrier_date, '') AS order_delivered_carrier_date, nullif(order_delivered_customer_date, '') AS order_delivered_customer_date, nullif(order_estimated_delivery_date, '') AS order_estimated_delivery_date FROM raw_orders",
    "jsonl_round_trip": "SELECT event_id, user_id, event_type, value FROM events",
    "log_parse": "SELECT event_id % 10 <> 0 AS sound, count(*) AS n FROM events GROUP BY 1",
    "nested_flatten": "WITH o AS (SELECT any_value(title) AS title, question_id, any_value(answers) AS answers, any_value(impossible) AS impossible FROM qa_examples WHERE question_id IS NOT NULL AND title IS NOT NULL GROUP BY 2) SELECT title, question_id, CAST(len(list_distinct(coalesce(answers, []))) AS integer) AS n_answers, coalesce(impossible, false) AS impossible FROM o",
    "parquet_audit": "SELECT unnest(['customer_unique_id','order_id','event_type','purchase_ts','delivered_ts','estimated_delivery_ts','paid_value','loaded_at']) AS \"column\", count(*) AS n, unnest([count(*) - count(customer_unique_id), count(*) - count(order_id), count(*) - count(event_type), count(*) - count(purchase_ts), count(*) - count(delivered_ts), count(*) - count(estimated_delivery_ts), count(*) - count(paid_value), count(*) - count(loaded_at)]) AS n_null FROM customer_orders",
    "parquet_prefix": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10",
    "partitioned_write": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "key_violations": "SELECT customer_id, count(*) AS n FROM raw_customers WHERE customer_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "amounts": "WITH p AS (SELECT payment_type, trim(replace(payment_value, '.', '')) AS v FROM raw_order_payments WHERE payment_value IS NOT NULL), a AS (SELECT payment_type, CASE WHEN regexp_full_match(v, '-?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)') AND length(replace(replace(v, ',', ''), '-', '')) <= 18 THEN CAST(replace(v, ',', '') AS decimal(38,0)) END AS a FROM p) SELECT payment_type, sum(a) AS total, count(*) - count(a) AS n_bad FROM a GROUP BY 1",
    "question_forms": r"SELECT DISTINCT trim(regexp_replace(lower(question), '[ \t\n\r\f\v]+', ' ', 'g')) AS normal, regexp_replace(lower(question), '[^a-z0-9]', '', 'g') AS canonical FROM qa_examples WHERE question IS NOT NULL",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM k GROUP BY user_id, s",
}
