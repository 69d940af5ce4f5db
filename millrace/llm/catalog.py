"""Queries of the operators on text and model training data (problems 1, 4, 8, 9 and 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.defects import answer_defects
from millrace.llm.garbling import repair_texts
from millrace.llm.leakage import EDITED, leaked_items
from millrace.llm.packing import pack
from millrace.llm.tokens import count_tokens
from millrace.llm.top_n import top_n_per_group
from millrace.sources.tables import table

CONTAINER = 2048


def _top(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "shopping_queries_dataset_examples"), ["query_id"], "product_id", "score", 10)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("query_id", "product_id")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_examples")
    return answer_defects(qa, "question_id", "question", "title", [("answer_a", "output_tokens_a"), ("answer_b", "output_tokens_b")], "answers", "impossible")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("field", "defect").agg(F.count(F.lit(1)).alias("n"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CONTAINER)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    bins = p8_pack(spark, d).groupBy("container").agg(F.sum("size").alias("used"))
    fill = F.sum("used") / (F.count(F.lit(1)) * CONTAINER)
    least = F.ceil(F.sum("used") / CONTAINER)  # no packing has fewer
    return bins.agg(F.count(F.lit(1)).alias("n_containers"), least.alias("least_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), fill.alias("fill"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(2 * F.col("covered") >= F.col("item_words")).select("doc_id", "item_id")


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Whole items that stand in a document with few edits, whether or not their unbroken runs make p9_found's case."""
    return _leaks(spark, d).where(F.col("edits") <= EDITED * F.col("item_words")).select("doc_id", "item_id", "edits", "item_words")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    found = _leaks(spark, d)
    part = F.col("covered") / F.col("item_words")
    return found.groupBy("item_id").agg(F.count_if(part >= 0.5).alias("n_documents"), F.max(part).alias("most_covered"), F.count_if(F.col("edits") == 0).alias("n_whole"), F.count_if((F.col("edits") > 0) & (F.col("edits") <= EDITED * F.col("item_words"))).alias("n_edited"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_texts(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_top, p4_found, p4_report, p8_pack, p8_report, p9_found, p9_edited, p9_report, p10_found, p10_repaired)}

_BEST = """
best AS (
  SELECT query_id, product_id, max(score) + 0.0 AS score FROM shopping_queries_dataset_examples
  WHERE query_id IS NOT NULL AND product_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS integer) AS place FROM best)
"""

SQL = {
    "p1_found": f"WITH {_BEST} SELECT query_id, product_id FROM placed WHERE place <= 10",
    "p1_top": f"WITH {_BEST} SELECT query_id, product_id, score, place FROM placed WHERE place <= 10",
}
