"""Queries of SQL evaluation, message contracts and text captures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import contracts as C
from millrace.functions import sql_guard as G
from millrace.sources.tables import table

TABLES = ("region", "nation", "customer", "orders", "part")
# Statements to audit with what is to come of them.
STATEMENTS = {
    "DROP TABLE orders": "select_only", "DELETE FROM orders": "select_only", "UPDATE orders SET o_orderkey = 1": "select_only", "INSERT INTO orders VALUES (1)": "select_only", "CREATE TABLE t AS SELECT 1 AS a": "select_only",
    "ALTER TABLE orders ADD COLUMN x int": "select_only", "TRUNCATE TABLE orders": "select_only", "SET spark.x=1": "select_only", "SELECT 1; DROP TABLE orders": "exactly_one_statement_required", "": "exactly_one_statement_required",
    "SELECT load_extension('/tmp/unsafe')": "denied_function", "SELECT reflect('java.lang.System', 'exit', 0)": "denied_function", "SELECT * FROM range(1000000000000)": "denied_function", "SELECT * FROM csv.`/etc/passwd`": "unknown_relation",
    "SELECT * FROM orders WHERE o_orderkey IN (SELECT _c0 FROM csv.`/etc/passwd`)": "unknown_relation", "SELECT * FROM secrets": "unknown_relation", "SELECT (1": "syntax_error",
    "SELECT 1": "allowed", "WITH x AS (SELECT 1 AS n) SELECT n FROM x": "allowed", "SELECT 1 LIMIT 5": "allowed", "SELECT count(*) FROM orders": "allowed", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1 ORDER BY 1 LIMIT 99999": "allowed",
}
# Difficulty, gold statement and candidate.
CASES = (
    ("simple", "SELECT count(*) FROM orders", "SELECT count(o_orderkey) AS n FROM orders"),
    ("simple", "SELECT r_name FROM region", "SELECT r_name FROM region ORDER BY r_name DESC"),
    ("simple", "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation"),
    ("simple", "SELECT max(o_totalprice) FROM orders", "SELECT max(total) FROM orders"),
    ("moderate", "SELECT o_orderstatus, count(*) FROM orders GROUP BY 1", "SELECT o_orderstatus, count(*) + 1 FROM orders GROUP BY 1"),
    ("moderate", "SELECT c_mktsegment, avg(c_acctbal) FROM customer GROUP BY 1", "SELECT c_mktsegment, sum(c_acctbal) / count(*) FROM customer GROUP BY 1"),
    ("moderate", "SELECT missing FROM nowhere", "SELECT 1"),
    ("challenging", "SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "SELECT n_name, count(*) FROM customer JOIN nation ON c_custkey = n_nationkey GROUP BY 1"),
    ("challenging", "SELECT count(*) FROM part", "DROP TABLE part"),
    ("challenging", "SELECT p_brand FROM part WHERE p_size > 40", "SELECT p_brand FROM part WHERE p_size > 40 AND p_size > 30"),
)
STAGES = {"no guard": False, "guarded": True}


def _register(s, d):
    for t in TABLES:
        table(s, d, t).createOrReplaceTempView(t)
    return set(TABLES)


def sql_guard_audit(s, d):
    known = _register(s, d)
    rows = [(q, G.check_sql(s, q, known).reason) for q in STATEMENTS]
    return s.createDataFrame(rows, "statement string, verdict string")


def _results(s, d):
    """Each case at each stage; without a guard only statements that read are run."""
    known = _register(s, d)
    rows = []
    for stage, guarded in STAGES.items():
        for level, gold, candidate in CASES:
            r = G.evaluate(s, gold, candidate, known, guarded or G.check_sql(s, candidate, known).reason in ("select_only", "denied_function"))
            rows.append((stage, level, candidate, r["correct"], r["executed"], r["blocked"], r["gold_executable"], r["reason"]))
    return s.createDataFrame(rows, "stage string, difficulty string, statement string, correct boolean, executed boolean, blocked boolean, gold_executable boolean, reason string")


def sql_accuracy_by_stage(s, d):
    return G.execution_accuracy(_results(s, d), ["stage"])


def sql_accuracy_by_difficulty(s, d):
    return G.execution_accuracy(_results(s, d).where("stage = 'guarded'"), ["difficulty"]).select("difficulty", "n", "n_gold", "n_correct", "accuracy")


def sql_failure_kinds(s, d):
    r = _results(s, d).where("stage = 'guarded' and not correct")
    return r.groupBy(G.failure_kind(F.col("reason"), F.col("statement"), F.col("executed")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def schema_listing(s, d):
    _register(s, d)
    return G.all_columns(s, list(TABLES))


def judge_scores(s, d):
    """Scores out of judges' prose; some are fractions, booleans, texts or out of range."""
    k = F.pmod("event_id", F.lit(8))
    x = F.when(k == 5, "2.5").when(k == 6, "true").when(k == 7, '"3"').otherwise(k.cast("string"))
    text = F.when(F.pmod("event_id", F.lit(11)) == 0, "no scores").otherwise(F.concat(F.lit('My verdict:\n{"score_x": '), x, F.lit(', "score_y": 4} as said')))
    return table(s, d, "events").select("event_id", C.two_scores(text).alias("v")).select("event_id", F.col("v.x").alias("x"), F.col("v.y").alias("y"))


def handoff_errors(s, d):
    """Messages against their contract: {"k": whole number, "note": optional text}."""
    k = F.pmod("event_id", F.lit(6))
    text = F.when(k == 0, F.col("props")).when(k == 1, '{"note": "x"}').when(k == 2, '{"k": "7", "note": 1}').when(k == 3, '{"k": 7, "b": 1, "a": 2}').when(k == 4, '{"k": 7').otherwise('{"k": 7, "note": "fine"}')
    e = C.contract_errors(text, {"k": ("BIGINT", True), "note": ("STRING", False)})
    return table(s, d, "events").groupBy(F.array_join(e, ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def filing_periods(s, d):
    month = F.element_at(F.create_map(*[F.lit(x) for m, c in C.REPORT_CODES.items() for x in (c, m)]), F.col("report_code"))
    name = F.concat(F.when(F.col("fact_id") % 5 == 0, "[기재정정]").otherwise(""), F.lit("report ("), F.col("report_year").cast("string"), F.lit("."), F.coalesce(month, F.lit("13")), F.lit(")"))
    p = table(s, d, "disclosure_fact").select(C.report_period(name).alias("p"))
    return p.groupBy("p.year", "p.code", "p.corrected").agg(F.count(F.lit(1)).alias("n"))


def token_rules(s, d):
    x = table(s, d, "documents").where(F.col("text").isNotNull())
    return x.select("doc_id", *[F.size(C.tokens_by(F.col("text"), r)).alias(r) for r in C.TOKEN_RULES])


def digests(s, d):
    x = table(s, d, "customer")
    return x.select("c_custkey", C.digest("c_mktsegment", "c_nationkey").alias("scope"), F.round(C.sha_fraction(F.col("c_name")), 9).alias("fraction"))


def term_scores(s, d):
    x = table(s, d, "documents").where(F.col("text").isNotNull())
    return x.select("doc_id", C.term_score(F.col("text"), ["price", "order", "model", "the", "entrega"], 40, 15, 85).alias("score"))


def captured_numbers(s, d):
    """Quantity and unit out of questions' answers."""
    c = C.captures(F.coalesce("answer_a", F.lit("")), r"([0-9]+) (euros|days|months|years)\b", ["amount", "unit"])
    return table(s, d, "qa_examples").where(F.col("question_id").isNotNull()).select("question_id", c.alias("c")).where(F.col("c").isNotNull()).select("question_id", "c.amount", "c.unit").distinct()


def role_texts(s, d):
    x = table(s, d, "qa_examples").where(F.col("question_id").isNotNull())
    return x.select("question_id", C.with_roles({"QUESTION": F.col("question"), "ANSWER": F.col("answer_b")}).alias("t")).select("question_id", F.length("t").alias("length"), F.octet_length("t").alias("bytes")).distinct()


QUERIES = {f.__name__: f for f in (sql_guard_audit, sql_accuracy_by_stage, sql_accuracy_by_difficulty, sql_failure_kinds, schema_listing, judge_scores, handoff_errors, filing_periods, token_rules, digests, term_scores, captured_numbers, role_texts)}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TERMS = " + ".join(f"CAST(regexp_matches(text, '(?i)(^|[^\\pL\\pN_]){t}($|[^\\pL\\pN_])') AS integer)" for t in ("price", "order", "model", "the", "entrega"))
SQL = {
    "sql_guard_audit": "SELECT * FROM (VALUES " + ", ".join(f"({_text(q)}, '{v}')" for q, v in STATEMENTS.items()) + ") t(statement, verdict)",
    "sql_accuracy_by_difficulty": "SELECT difficulty, n, n_gold, n_correct, round(n_correct / n_gold, 6) AS accuracy FROM (VALUES ('simple', 4::bigint, 4::bigint, 2::bigint), ('moderate', 3, 2, 1), ('challenging', 3, 3, 1)) t(difficulty, n, n_gold, n_correct)",
    "schema_listing": 'SELECT table_name AS "table", column_name AS "column", CAST(ordinal_position AS integer) AS place FROM information_schema.columns WHERE table_name IN (' + ", ".join(f"'{t}'" for t in TABLES) + ")",
    "judge_scores": "SELECT event_id, CASE WHEN event_id % 11 <> 0 AND event_id % 8 BETWEEN 1 AND 4 THEN CAST(event_id % 8 AS integer) END AS x, CASE WHEN event_id % 11 <> 0 AND event_id % 8 BETWEEN 1 AND 4 THEN 4 END AS y FROM events",
    "handoff_errors": "SELECT CASE event_id % 6 WHEN 1 THEN 'missing:k' WHEN 2 THEN 'type:k,type:note' WHEN 3 THEN 'unknown:a,unknown:b' WHEN 4 THEN 'malformed' ELSE '' END AS errors, count(*) AS n FROM events GROUP BY 1",
    "filing_periods": "WITH p AS (SELECT report_code IN ('11013', '11012', '11014', '11011') AS k, report_year, report_code, fact_id FROM disclosure_fact) SELECT CASE WHEN k THEN report_year END AS year, CASE WHEN k THEN report_code END AS code, CASE WHEN k THEN fact_id % 5 = 0 END AS corrected, count(*) AS n FROM p GROUP BY 1, 2, 3",
    "token_rules": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS integer) AS mixed, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS integer) AS lower, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?')) AS integer) AS decimal FROM documents WHERE text IS NOT NULL",
    "digests": "SELECT c_custkey, substr(sha256(CAST(json_object('c_mktsegment', c_mktsegment, 'c_nationkey', c_nationkey) AS varchar)), 1, 24) AS scope, round(CAST(CAST('0x' || substr(sha256(c_name), 1, 16) AS ubigint) AS double) / 18446744073709551616.0, 9) AS fraction FROM customer",
    "term_scores": f"SELECT doc_id, CAST(least(85, 40 + 15 * ({_TERMS})) AS integer) AS score FROM documents WHERE text IS NOT NULL",
    "captured_numbers": "SELECT DISTINCT question_id, regexp_extract(answer_a, '([0-9]+) (euros|days|months|years)\\b', 1) AS amount, regexp_extract(answer_a, '([0-9]+) (euros|days|months|years)\\b', 2) AS unit FROM qa_examples WHERE question_id IS NOT NULL AND regexp_matches(answer_a, '([0-9]+) (euros|days|months|years)\\b')",
    "role_texts": "WITH t AS (SELECT question_id, 'QUESTION ' || coalesce(question, '') || ' ANSWER ' || coalesce(answer_b, '') AS t FROM qa_examples WHERE question_id IS NOT NULL) SELECT DISTINCT question_id, CAST(length(t) AS integer) AS length, CAST(strlen(t) AS integer) AS bytes FROM t",
}
