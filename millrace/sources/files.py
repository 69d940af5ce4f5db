"""Readers of files: text tables, logs, JSON, prefixes of Parquet, XML facts and route instances."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_table(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A delimited file with a header, all columns text; empty fields are NULL. Compressed files are read as they are."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, sep=sep, quote='"', escape='"', multiLine=True)


def read_log(spark: SparkSession, path: str, fields: list[str], sep: str = "\t") -> DataFrame:
    """Lines of a log cut into named fields; `sound` tells whether a line has as many as it should."""
    parts = spark.read.text(path).select(F.split("value", sep, -1).alias("p"))
    return parts.select(*[F.try_element_at("p", F.lit(i + 1)).alias(f) for i, f in enumerate(fields)], (F.size("p") == len(fields)).alias("sound"))


def read_prefix(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The first rows of each Parquet file, by place in the file."""
    return spark.read.parquet(path).where(F.col("_metadata.row_index") < rows)


def audit_table(df: DataFrame) -> DataFrame:
    """(column, type, n, n_null, n_distinct) of every column, in one pass; distinct counts are approximate."""
    aggs = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.approx_count_distinct(c).alias("n_distinct")) for c, t in df.dtypes]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken line is allowed only as a file's last one (a write that was cut), and left out."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_no"))
    bad = F.col("x._corrupt").isNotNull() | F.col("x").isNull()
    parsed = lines.withColumn("x", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    last = lines.groupBy("_file").agg(F.max("_no").alias("_last"))
    wrong = parsed.where(bad).join(F.broadcast(last), "_file").where(F.col("_no") < F.col("_last"))  # one row per file
    if wrong.limit(1).count():
        raise ValueError(f"{path}: a broken line that is not the last one")
    return parsed.where(~bad).select("x.*").drop("_corrupt")


def flatten_questions(articles: DataFrame) -> DataFrame:
    """(title, context, id, question, answers, impossible) from nested articles, paragraphs and questions."""
    p = articles.select("title", F.explode("paragraphs").alias("p"))
    q = p.select("title", "p.context", F.explode("p.qas").alias("q"))
    return q.select("title", "context", "q.id", "q.question", F.array_distinct(F.transform("q.answers", lambda a: a["text"])).alias("answers"), F.col("q.is_impossible").alias("impossible"))


def _facts(blob: bytes) -> list[tuple]:
    """Facts of the instance documents in a zip: concept, context, unit, value; a repeated fact once, a conflict is an error."""
    seen: dict[tuple, tuple] = {}
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        for name in sorted(n for n in z.namelist() if n.endswith((".xbrl", ".xml"))):
            for e in ET.fromstring(z.read(name)):
                context = e.get("contextRef")
                if context is None:
                    continue
                text = (e.text or "").strip()
                nil = e.get("{http://www.w3.org/2001/XMLSchema-instance}nil") == "true"
                value = None
                if e.get("unitRef") and text and not nil:
                    value = Decimal(text.replace(",", "")).scaleb(int(e.get("scale") or 0))
                    value = -value if e.get("sign") == "-" else value
                key = (e.tag.rpartition("}")[2], context, e.get("unitRef") or "")
                content = (value, None if value is not None or nil else text)
                if seen.setdefault(key, content) != content:
                    raise ValueError(f"conflicting facts for {key}")
    return [(*k, *v) for k, v in seen.items()]


def read_fact_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, concept, context_key, unit, value, value_text) of zipped instance documents, one file a row of a task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *f) for p, blob in zip(b["path"], b["content"]) for f in _facts(blob)]
            yield pd.DataFrame(rows, columns=["file", "concept", "context_key", "unit", "value", "value_text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, concept string, context_key string, unit string, value decimal(38,6), value_text string")


def read_route_instance(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, demand, ready, due, service): lines of seven numbers of a vehicle-routing instance."""
    nums = F.regexp_extract_all("value", F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    rows = spark.read.text(path).select(nums.alias("n"), "value").where((F.size("n") == 7) & F.col("value").rlike(r"^[\s\d.\-]+\z"))
    names = ["id", "x", "y", "demand", "ready", "due", "service"]
    return rows.select(*[F.element_at("n", i + 1).cast("int" if c == "id" else "double").alias(c) for i, c in enumerate(names)])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_columns(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Some columns of a delimited file: the parser skips the others."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"').select(*columns)


def read_days(spark: SparkSession, folder: str, days: list[str]) -> DataFrame:
    """The tables of several days as one, with the day as a column; a day without a folder is an error."""
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/day={d}" for d in days])


def read_judgements(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(judgements with a positive grade, the queries that have one) of a tab-separated file: qid, doc, grade."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="qid string, doc string, grade int").where(F.col("grade") > 0)
    return rows, queries.join(rows.select("qid").distinct(), "qid", "left_semi")


def read_truncated_bz2(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the whole lines that a bzip2 file cut short still gives; a broken last line is left out.

    A compressed member can only be read from its start, so a file is one task's stream; whole files are better read
    by `spark.read.text`, which splits them.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bz2

        for b in batches:
            for name, blob in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                unpack, text, data = bz2.BZ2Decompressor(), b"", blob
                while data:
                    text += unpack.decompress(data)
                    data = unpack.unused_data if unpack.eof else b""
                    unpack = bz2.BZ2Decompressor() if data else unpack
                whole = text.decode("utf-8", "replace").split("\n")[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(whole), pa.string()), pa.array(range(1, len(whole) + 1), pa.int64()), pa.array(whole, pa.string())], names=["file", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "file string, line_no bigint, line string")


def audit_log(log: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: lines, those with a wrong number of fields, and of the rest those that break each rule."""
    broken = {n: F.col("sound") & ~F.coalesce(r, F.lit(False)) for n, r in rules.items()}
    return log.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sound")).alias("malformed"), *[F.count_if(b).alias(f"invalid_{n}") for n, b in broken.items()])


def form_entities(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links) of nested forms (document, form: id, label, text, box, linking): links from questions to answers of the document only."""
    e = forms.select("document", F.explode("form").alias("e")).select("document", "e.*")
    pairs = e.select("document", F.explode("linking").alias("l")).select("document", F.col("l")[0].alias("question"), F.col("l")[1].alias("answer")).distinct()
    role = lambda label, name: e.where(F.col("label") == label).select("document", F.col("id").alias(name))
    links = pairs.join(role("question", "question"), ["document", "question"], "left_semi").join(role("answer", "answer"), ["document", "answer"], "left_semi")
    return e.drop("linking"), links
