"""Dense ids of users, POIs and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import written_once

def dense_ids(values: DataFrame, offset: int = 0) -> DataFrame:
    """value, id: distinct values in order, ids without gaps from offset. Ranges of values are numbered side by side and moved
    by the sizes of the ranges before them."""
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = values.select("value").filter(F.col("value").isNotNull()).distinct().repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    # ranges come from a sample: both branches below have to see the same ones
    ranged = written_once(ranged)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("value").alias("first"))
    before = sizes.select(F.col("first"), (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("before"))  # a row for each partition
    within = Window.partitionBy("part").orderBy("value")
    numbered = ranged.withColumn("nth", F.row_number().over(within)).withColumn("first", F.min("value").over(Window.partitionBy("part")))
    return numbered.join(F.broadcast(before), "first").select("value", (F.col("before") + F.col("nth") - 1 + offset).cast("long").alias("id"))


def fit_encoder(train: DataFrame, categories: DataFrame, offset: int = 0) -> DataFrame:
    """mapping, value, id: POIs and users of the training rows, categories of the whole taxonomy."""
    tables = {"poi": train.select(F.col("raw_poi_id").alias("value")), "user": train.select(F.col("raw_user_id").alias("value")), "category": categories.select(F.col("category").alias("value"))}
    out = None
    for name, values in tables.items():
        part = dense_ids(values, offset).select(F.lit(name).alias("mapping"), "value", "id")
        out = part if out is None else out.unionAll(part)
    return out


#: Ids of one mapping that go to all tasks; more are joined by shuffle, where adaptive execution splits hot values.
BROADCAST_IDS = 1_000_000


def encode(events: DataFrame, encoder: DataFrame) -> DataFrame:
    """The events with poi_code, user_code and category_code; null for what the encoder doesn't know. Mappings of a checked size
    are broadcast, so that neither the events nor their hot places are dealt."""
    sizes = {r["mapping"]: r["count"] for r in encoder.groupBy("mapping").count().collect()}
    for name, column in (("poi", "raw_poi_id"), ("user", "raw_user_id"), ("category", "category")):
        codes = encoder.filter(F.col("mapping") == name).select(F.col("value").alias(column), F.col("id").alias(f"{name}_code"))
        events = events.join(F.broadcast(codes) if sizes.get(name, 0) <= BROADCAST_IDS else codes, column, "left")
    return events


def check_ids(encoder: DataFrame, offset: int = 0) -> DataFrame:
    """mapping, n, contiguous."""
    ends = encoder.groupBy("mapping").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids"))
    return ends.select("mapping", "n", ((F.col("low") == offset) & (F.col("high") == offset + F.col("n") - 1) & (F.col("ids") == F.col("n"))).alias("contiguous"))


def unseen_values(train: DataFrame, other: DataFrame, column: str) -> DataFrame:
    return other.select(column).distinct().join(train.select(column).distinct(), column, "left_anti")
