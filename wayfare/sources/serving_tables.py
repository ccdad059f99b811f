"""Serving lists as bucketed tables: what scores requests batch by batch joins them without moving them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wayfare.operators.serving import TABLES, Lists

#: The keys by which requests meet each list; base and whole are a few rows and are broadcast.
KEYS = {"singles": ["bucket", "category"], "first": ["bucket", "category"], "several": ["bucket", "category"], "targets": ["src"], "places": ["poi_id"], "pairs": ["bucket", "category", "other"]}


def save_lists(lists: Lists, name: str, buckets: int | None = None) -> None:
    """Write the lists of one version as tables name_base, name_singles and so on. Each bucket is one file, sorted by its keys.
    Joins use the buckets as they are if there are at least as many as shuffle partitions, which is the default. The table
    name_lists comes last: without it the version isn't complete, and a version is never written twice."""
    spark = lists.targets.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.catalog.tableExists(f"{name}_lists"):
        raise ValueError(f"the lists {name} exist")
    for table, df in lists.tables().items():
        keys = KEYS.get(table)
        writer = (df.repartition(buckets, *keys).write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:]) if keys else df.coalesce(1).write)
        writer.format("parquet").mode("overwrite").saveAsTable(f"{name}_{table}")  # parts of an attempt that failed are replaced
    spark.range(1).select(F.lit(lists.depth).alias("depth"), F.lit(",".join(lists.tables())).alias("tables")).write.format("parquet").mode("error").saveAsTable(f"{name}_lists")


def load_lists(spark: SparkSession, name: str) -> Lists:
    if not spark.catalog.tableExists(f"{name}_lists"):
        raise ValueError(f"there are no complete lists {name}")
    row = spark.table(f"{name}_lists").first()
    there = row["tables"].split(",")
    return Lists(row["depth"], *(spark.table(f"{name}_{t}") if t in there else None for t in TABLES))
