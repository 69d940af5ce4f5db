"""Writers of results."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text, for files that hold plain fields."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """A header and plain fields, nested ones as JSON; what was there is replaced."""
    flat(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replaced as a whole, with partition folders if asked for."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as a JSON file that appears whole or not at all."""
    got = row.limit(2).collect()
    if len(got) != 1:
        raise ValueError("a report has one row")
    folder = os.path.dirname(path) or "."
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(got[0].asDict(recursive=True), f, default=str, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def replace_table(spark: SparkSession, name: str, df: DataFrame, path: str) -> DataFrame:
    """A table of the catalogue made anew from df, whatever was there under the name; its statistics are gathered."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.option("path", path).saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.table(name)


def statistics(spark: SparkSession, name: str, column: str) -> dict[str, str]:
    """What the optimiser knows of a column: distinct values, NULLs, bounds."""
    return {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {name} {column}").collect()}


def insert_rows(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Rows added to a table by one write of many parts."""
    df.write.insertInto(name)


def append_once(df: DataFrame, path: str, key: str, schema: str) -> int:
    """Rows whose key the JSON-lines file has not yet, appended; how many. A file cut in its last line is continued."""
    from millrace.session import materialise
    from millrace.sources.files import read_jsonl

    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    fresh = materialise(df.join(read_jsonl(spark, path, schema).select(key), key, "left_anti") if there else df, "fresh")
    n = fresh.count()
    if n:
        append_jsonl(fresh, path)
    return n
