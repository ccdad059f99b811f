"""History and target examples of sessions, without the target in the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.contracts import MAX_HISTORY
from wayfare.functions.scalars import sample_id
from wayfare.operators.skew import spread_sessions


def build_examples(events: DataFrame, protocol: str, min_history: int = 1, top_k: int = 10, coordinates: bool = False) -> DataFrame:
    """A row for every event that has min_history events before it in its session: request fields and label fields. A session
    that holds a large share of all rows is worked off in ranges of its order."""
    session = ["dataset", "split", "raw_user_id", "session_id"]
    in_order = [F.col("timestamp_utc"), F.col("raw_poi_id"), F.col("category"), F.coalesce("model_poi_id", F.lit(-1))]
    events = spread_sessions(events, session, in_order, MAX_HISTORY)
    order = Window.partitionBy(*session, "part").orderBy(*in_order, F.col("halo").desc())
    visit = [F.col("timestamp_utc").alias("timestamp"), F.col("raw_poi_id").alias("poi_id"), F.col("category").alias("category_name")]
    if coordinates:
        visit += [F.col("model_poi_id"), F.col("latitude"), F.col("longitude")]
    rows = events.withColumn("history", F.collect_list(F.struct(*visit)).over(order.rowsBetween(-MAX_HISTORY, -1))).withColumn("before", F.col("earlier") + F.count_if(~F.col("halo")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.filter(~F.col("halo") & (F.col("before") >= min_history)).select(
        sample_id(F.col("dataset"), F.lit(protocol), F.col("raw_user_id"), F.col("session_id"), F.col("timestamp_utc"), F.col("raw_poi_id")).alias("sample_id"),
        "dataset", "history", F.col("timestamp_utc").alias("target_time"), F.lit(top_k).alias("top_k"), F.lit("smoke").alias("profile"),
        "split", F.col("raw_poi_id").alias("target_poi_id"), F.col("model_poi_id").alias("target_model_poi_id"), F.col("category").alias("target_category"),
    )


def requests_of(examples: DataFrame) -> DataFrame:
    return examples.select("sample_id", "dataset", "history", "target_time", "top_k", "profile")


def labels_of(examples: DataFrame) -> DataFrame:
    return examples.select("sample_id", "split", "target_poi_id", "target_model_poi_id", "target_category")


def duplicate_samples(examples: DataFrame) -> DataFrame:
    return examples.groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(examples: DataFrame) -> DataFrame:
    n = duplicate_samples(examples).count()
    if n:
        raise ValueError(f"{n} sample identities come more than once")
    return examples
