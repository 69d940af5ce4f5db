"""Structured Streaming: event-time windows and keyed state, run to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import work_dir


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with its times as instants, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all data that is there: written exactly once to the shared folder, and read."""
    spark = stream.sparkSession
    at = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        # each batch replaces the last result
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def tumbling(stream: DataFrame, ts: str, kind: str, value: str, width: str) -> DataFrame:
    return stream.withWatermark(ts, "1 hour").groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sliding(stream: DataFrame, ts: str, width: str, slide: str) -> DataFrame:
    return stream.withWatermark(ts, "1 hour").groupBy(F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def user_sessions(stream: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    return stream.withWatermark(ts, "1 hour").groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def token_bucket_stream(stream: DataFrame, key: str, ts: str, row_id: str, capacity: float, per_second: float) -> DataFrame:
    """(key, row_id, allowed): a bucket for each key, kept as state between batches."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, then = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(parts)).sort_values(["s", row_id])
        allowed = []
        for now in rows["s"]:
            if then is not None:
                left = min(capacity, left + (now - then) * per_second)
            ok = left >= 1.0 - 1e-9
            left, then = left - ok, now
            allowed.append(bool(ok))
        state.update((float(left), float(then)))
        yield pd.DataFrame({key: k[0], row_id: rows[row_id].values, "allowed": allowed})

    rows = stream.select(key, row_id, F.col(ts).cast("double").alias("s"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, allowed boolean", "left double, then double", "append", GroupStateTimeout.NoTimeout)
