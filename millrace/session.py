"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def local_session(cpus: int | str = 8, app: str = "millrace") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    tmp = tempfile.gettempdir()
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", f"{tmp}/millrace-warehouse")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/millrace-work"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The files survive a lost executor, unlike cached or locally checkpointed blocks. Results are lazy and read them
    when they run, so they stay until `drop_work`, which the end of the driver calls too.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_work, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, keys: list[str], order: list[str]) -> DataFrame:
    """`materialise`, with rows of equal keys in one bucket and in order there: what groups by the keys needs no shuffle.

    Write a df that is already partitioned by the keys, else each task writes a file for each bucket.
    """
    spark = df.sparkSession
    at = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{work_dir(spark)}/{at}"
    if not _written:
        atexit.register(drop_work, spark)
    _written.append(path)
    df.write.bucketBy(shuffle_partitions(spark), *keys).sortBy(*keys, *order).option("path", path).saveAsTable(f"millrace_{at}")
    return spark.table(f"millrace_{at}")


def drop_work(spark: SparkSession) -> None:
    """Delete the work tables written so far. Results that were made from them can no longer be run."""
    paths, _written[:] = list(_written), []
    try:
        jvm = spark.sparkContext._jvm
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone already
        return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if its files give work to less than half of them: a few files with few row groups.

    For costly work on each row. Larger inputs have parts enough and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
