"""SQL that is to be run read-only: static rules, schema check, bounded execution, comparison and error kinds."""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ROWS = 10_000
# Plan nodes that only read, and functions that reach outside a query or run without a bound.
READ_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Join UnresolvedRelation SubqueryAlias Distinct Union Intersect Except OneRowRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithCTE With Window Generate "
    "UnresolvedHaving LateralJoin UnresolvedInlineTable Offset Pivot UnresolvedHint Sample".split()
)
DENIED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length read_files version current_user session_user load_extension range sequence repeat sleep".split())
_LIMIT = re.compile(r"(?is)\blimit\s+(\d+)(\s+offset\s+\d+)?\s*$")


@dataclass(frozen=True)
class Verdict:
    """reason is allowed, or why a statement is refused; statement is bounded; warnings are for review."""

    reason: str
    statement: str | None
    warnings: tuple[str, ...] = ()


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan) -> list:
    """All nodes of a parsed plan, those of subqueries and common tables too."""
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += _each(node.children()) + _each(node.subqueries())
        todo += [k for k in _each(node.innerChildren()) if hasattr(k, "nodeName")]
        if node.nodeName() == "UnresolvedWith":
            todo += [pair._2() for pair in _each(node.cteRelations())]
    return out


def check_sql(spark: SparkSession, sql: str, known: set[str], most: int = MOST_ROWS) -> Verdict:
    """One statement, only nodes that read, known relations, no denied functions; its limit is added, or lowered in place.

    Judged on the plan that Spark's own parser makes. A relation is known by its plain name, or is a common table of
    the statement; names with a part before them (files by path, other catalogues) and table functions are refused.
    """
    text = sql.strip().rstrip(";").strip()
    if not text:
        return Verdict("exactly_one_statement_required", None)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001  the JVM's parse error
        several = ";" in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", "", text)
        return Verdict("exactly_one_statement_required" if several and "syntax" in str(e).lower() else "syntax_error", None)
    nodes = _walk(plan)
    if {n.nodeName() for n in nodes} - READ_NODES - {"UnresolvedTableValuedFunction"}:
        return Verdict("select_only", None)
    tree = "\n".join(n.toString().lower() for n in nodes)
    denied = sorted(f for f in DENIED if re.search(rf"(?<![\w.]){f}\(", tree) or f"'{f}(" in tree or f"unresolvedfunction {f}" in tree)
    if denied or any(n.nodeName() == "UnresolvedTableValuedFunction" for n in nodes):
        return Verdict("denied_function", None)
    common = {pair._1().lower() for n in nodes if n.nodeName() == "UnresolvedWith" for pair in _each(n.cteRelations())}
    names = {".".join(map(str, _each(n.multipartIdentifier()))).lower() for n in nodes if n.nodeName() == "UnresolvedRelation"}
    if names - {k.lower() for k in known} - common:
        return Verdict("unknown_relation", None)
    warnings = []
    if plan.nodeName() not in ("GlobalLimit",):
        text += f"\nLIMIT {most}"
        warnings.append(f"limit_added:{most}")
    elif (found := _LIMIT.search(text)) is None:
        warnings.append("non_literal_limit_review")
    elif int(found[1]) > most:
        warnings.append(f"limit_capped:{found[1]}->{most}")
        text = text[: found.start(1)] + str(most) + text[found.end(1) :]
    if not any(n.nodeName() in ("Filter", "UnresolvedHaving") for n in nodes):
        warnings.append("no_where_clause_possible_full_scan")
    return Verdict("allowed", text, tuple(warnings))


def schema_error(spark: SparkSession, statement: str) -> str | None:
    """What analysis says of unknown tables, columns and types; None for a sound statement. Nothing is run."""
    try:
        spark.sql(statement).schema  # noqa: B018
    except PySparkException as e:
        return e.getCondition() or "ANALYSIS_ERROR"
    return None


def scan_warnings(spark: SparkSession, statement: str) -> list[str]:
    """full_scan:<columns> for each scan of the optimised plan that no filter reaches."""
    plan = spark.sql(statement)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    return [f"full_scan:{m[1]}" for line in scans if "PushedFilters: []" in line and "PartitionFilters: []" in line and (m := re.search(r"ReadSchema: struct<([^>]*)>", line))]


def run_bounded(spark: SparkSession, statement: str, most: int = MOST_ROWS, seconds: float = 60.0) -> list:
    """The rows of a checked statement; an error for more than `most`, and a cancelled job after `seconds`."""
    group = f"bounded-{id(statement)}"
    sc = spark.sparkContext
    sc.setJobGroup(group, "bounded statement", interruptOnCancel=True)
    timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
    timer.start()
    try:
        rows = spark.sql(statement).limit(most + 1).collect()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if len(rows) > most:
        raise ValueError(f"result_row_cap_exceeded:{most}")
    return rows


def canonical(df: DataFrame) -> DataFrame:
    """df with columns by place, fractions rounded to two places (half to even) and nested values as JSON."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`") if df.columns.count(f.name) == 1 else df[f.name]
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.bround(c.cast("double"), 2)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        out.append(c.alias(f"c{i}"))
    return df.select(*out)


def rows_equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two results have the same set of rows, whatever their order, repeats and column names."""
    a, b = canonical(left), canonical(right)
    if len(a.columns) != len(b.columns):
        return False
    marked = a.distinct().withColumn("_l", F.lit(1)).unionByName(b.distinct().withColumn("_l", F.lit(2)))
    odd = marked.groupBy(*a.columns).agg(F.sum("_l").alias("s")).where(F.col("s") != 3)
    return odd.limit(1).count() == 0


def evaluate(spark: SparkSession, gold: str, candidate: str, known: set[str], guarded: bool) -> dict:
    """correct, executed, blocked, gold_executable and reason of a candidate statement against the gold one."""
    try:
        want = spark.sql(gold)
        want.schema  # noqa: B018
    except PySparkException as e:
        return {"correct": False, "executed": False, "blocked": False, "gold_executable": False, "reason": f"gold_execution_error: {e.getCondition()}"}
    statement, reason = candidate, ""
    if guarded:
        verdict = check_sql(spark, candidate, known)
        if verdict.statement is None:
            return {"correct": False, "executed": False, "blocked": True, "gold_executable": True, "reason": verdict.reason}
        statement, reason = verdict.statement, "; ".join(verdict.warnings)
    try:
        return {"correct": rows_equal(spark.sql(statement), want), "executed": True, "blocked": False, "gold_executable": True, "reason": reason}
    except PySparkException as e:
        return {"correct": False, "executed": False, "blocked": False, "gold_executable": True, "reason": f"execution_error: {e.getCondition()}"}


def failure_kind(reason: Column, statement: Column, executed: Column) -> Column:
    """The kind of a failure by its error text, then by the statement's shape; the first that applies."""
    r, q = F.lower(reason), F.upper(statement)
    return (
        F.when(r.contains("gold_execution_error"), "gold_execution_error")
        .when(r.rlike("table_or_view_not_found|unresolved_column|unknown_relation"), "schema_misunderstanding")
        .when(r.rlike("syntax|parse"), "syntax_error")
        .when(r.contains("ambiguous") | (q.contains("JOIN") & executed), "join_error")
        .when(r.rlike("select_only|denied_function|exactly_one"), "guardrail_rejection")
        .when(q.rlike(r"GROUP BY|HAVING|COUNT\(|SUM\(|AVG\(|MIN\(|MAX\("), "aggregation_error")
        .when(executed, "denotation_mismatch")
        .otherwise("other_execution_error")
    )


def execution_accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, gold_executable, correct, accuracy, executed, blocked, errors): accuracy over what the gold could run."""
    count = lambda c: F.count_if(c)
    sound = F.col("gold_executable")
    g = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count(sound).alias("n_gold"), count(sound & F.col("correct")).alias("n_correct"), count(F.col("executed")).alias("n_executed"), count(F.col("blocked")).alias("n_blocked"), count(~F.col("executed") & ~F.col("blocked")).alias("n_errors"))
    return g.withColumn("accuracy", F.round(F.col("n_correct") / F.nullif("n_gold", F.lit(0)), 6))


def all_columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, column, place) of views or tables, as the catalogue has them."""
    rows = [(t, c.name, i) for t in names for i, c in enumerate(spark.catalog.listColumns(t), 1)]
    return spark.createDataFrame(rows, "table string, column string, place int")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
