"""Check-in views of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

E_BOUNDS = ("2024-01-24", "2024-01-27")
L_BOUNDS = ("1999-12-01", "2000-09-01")


def _event(dataset: str, bounds: tuple[str, str], user: Column, session: Column, ts: Column, poi: Column, category: Column) -> list[Column]:
    first, second = (F.lit(b).cast("timestamp") for b in bounds)
    split = F.when(ts < first, "train").when(ts < second, "validation").otherwise("test")
    none = lambda t: F.lit(None).cast(t)
    return [
        F.lit(dataset).alias("dataset"), split.alias("split"), user.alias("raw_user_id"), session.alias("session_id"), ts.alias("timestamp_utc"), poi.alias("raw_poi_id"),
        none("long").alias("model_poi_id"), category.alias("category"), none("double").alias("latitude"), none("double").alias("longitude"),
    ]


def e_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits from events: real hours, and every place has every category."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts, user = F.col("ts").cast("timestamp"), F.col("user_id").cast("string")
    poi = F.concat(F.lit("poi-"), F.lpad(F.get_json_object("props", "$.k"), 3, "0"))
    return e.select(*_event("synthetic", E_BOUNDS, user, F.concat(user, F.lit("-"), F.date_format(ts, "yyyy-MM-dd")), ts, poi, F.col("event_type")))


def order_lines(spark: SparkSession, sf_dir: str, several: bool = False) -> DataFrame:
    """What visits are made of, in narrow rows: o_custkey, l_partkey, l_shipdate, category. Each place has one category, with several two."""
    table = lambda name, *c: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c)
    lines = table("lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_linenumber").join(table("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.join(table("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    second = F.concat(F.lit("kind-"), (F.col("l_partkey") % 40).cast("string"))
    category = F.when(F.col("l_linenumber") > 2, second).otherwise(F.col("p_brand")) if several else F.col("p_brand")
    return rows.select("o_custkey", "l_partkey", "l_shipdate", category.alias("category"))


def line_visits(lines: DataFrame) -> DataFrame:
    """The visits of order_lines()."""
    ts, user = F.col("l_shipdate").cast("timestamp"), F.col("o_custkey").cast("string")
    session = F.concat(user, F.lit("-"), F.year(ts).cast("string"))
    return lines.select(*_event("synthetic", L_BOUNDS, user, session, ts, F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.col("category")))


def l_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits from order lines: many places of one category each, and sessions that straddle splits."""
    return line_visits(order_lines(spark, sf_dir))
