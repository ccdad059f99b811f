"""A session with the settings that the library's results rely on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app_name: str = "wayfare", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def written_once(df: DataFrame) -> DataFrame:
    """df with one fixed content: written to the checkpoint folder where the cluster names one, else held by the executors."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block; afterwards they are what they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go when the action that made them is done.
BRIEF_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, where the cluster names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def stored(df: DataFrame) -> DataFrame:
    """df written once as a compressed table in the checkpoint folder and read back: shuffle files of the write go when it is done,
    and nothing of it stays in memory. Where the cluster names no such folder it is held by the executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
    with settings(spark, BRIEF_SHUFFLES):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard_stored(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; others stay what they are."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            context = table.sparkSession.sparkContext
            found = context._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row: an explode of one element, so that no projection folds them into what
    reads them (into a lambda, say, where they would be computed again for each element)."""
    one = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("evaluated_")
    return df.select("*", one).select(*(c for c in df.columns if c not in columns), *(f"evaluated_.{name}" for name in columns))
