"""Check-in CSV files with explicit splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.contracts import SPLITS, enforce, event_rules
from wayfare.functions.scalars import blank_to_null, parse_timestamp

# The columns that may hold each field, in order of preference.
PLAIN = {
    "raw_user_id": ["raw_user_id"],
    "session_id": ["session_id"],
    "timestamp_utc": ["timestamp", "timestamp_utc"],
    "raw_poi_id": ["raw_poi_id"],
    "category": ["category"],
    "model_poi_id": ["model_poi_id"],
    "latitude": ["latitude"],
    "longitude": ["longitude"],
    "split": ["split", "SplitTag"],
}
CITY = {
    "raw_user_id": ["raw_user_id", "UserId", "user_id"],
    "session_id": ["session_id", "pseudo_session_trajectory_id", "trajectory_id"],
    "timestamp_utc": ["timestamp", "timestamp_utc", "UTCTime"],
    "raw_poi_id": ["raw_poi_id", "PoiId", "poi_id"],
    "category": ["category", "PoiCategoryName", "poi_category_name", "PoiCategoryId"],
    "model_poi_id": ["model_poi_id", "ModelPoiId"],
    "latitude": ["latitude", "Latitude"],
    "longitude": ["longitude", "Longitude"],
    "split": ["split", "SplitTag"],
}


def _read(spark: SparkSession, path: str, split: str, dataset: str, aliases: dict[str, list[str]], coordinates: bool, mode: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    # with line feeds inside quotes a file can't be split, so that has to be asked for
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line).csv(path)
    # names that differ by case only are one name to Spark: take columns by position
    names = raw.columns
    raw = raw.select("*", F.col("_metadata.file_name").alias("_file"))
    raw = raw.toDF(*(f"c{i}" for i in range(len(names))), "source_file")
    as_read = F.to_json(F.struct(*(F.col(f"c{i}").alias(f"{i}_{n}") for i, n in enumerate(names))))
    place = {name: f"c{i}" for i, name in enumerate(names)}
    text = lambda field: F.coalesce(*([blank_to_null(F.col(place[a])) for a in aliases[field] if a in place] or [F.lit(None).cast("string")]))
    declared = F.when(text("split") == "val", "validation").otherwise(text("split"))
    given = {c: text(c) for c in ("model_poi_id", "latitude", "longitude", "timestamp_utc")}
    rows = raw.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), text("raw_user_id").alias("raw_user_id"), text("session_id").alias("session_id"),
        parse_timestamp(given["timestamp_utc"]).alias("timestamp_utc"), text("raw_poi_id").alias("raw_poi_id"),
        given["model_poi_id"].try_cast("long").alias("model_poi_id"), text("category").alias("category"),
        given["latitude"].try_cast("double").alias("latitude"), given["longitude"].try_cast("double").alias("longitude"),
        declared.alias("declared"), *(given[c].isNotNull().alias(f"given_{c}") for c in ("model_poi_id", "latitude", "longitude")), "source_file", as_read.alias("source_row"),
    )
    rules = {
        **event_rules(),
        "declared_split": F.col("declared").isNotNull() & (F.col("declared") != split),
        **{f"{c}_number": F.col(f"given_{c}") & F.col(c).isNull() for c in ("model_poi_id", "latitude", "longitude")},
    }
    if not coordinates:
        rules["no_coordinates"] = F.col("given_latitude") | F.col("given_longitude")
    valid, invalid = enforce(rows, rules, mode, ("source_file", "source_row"))
    keep = ["dataset", "split", "raw_user_id", "session_id", "timestamp_utc", "raw_poi_id", "model_poi_id", "category", "latitude", "longitude"]
    return valid.select(*keep), invalid.drop("source_row")


def read_synthetic_split(spark: SparkSession, path: str, split: str, mode: str = "strict", multi_line: bool = False) -> DataFrame:
    """The plain layout, which has no coordinates."""
    return _read(spark, path, split, "synthetic", PLAIN, False, mode, multi_line)[0]


def read_city_split(spark: SparkSession, path: str, split: str, dataset: str = "nyc", mode: str = "strict", multi_line: bool = False) -> DataFrame:
    """The layouts of city files with their many column names."""
    return _read(spark, path, split, dataset, CITY, True, mode, multi_line)[0]


def quarantine_split(spark: SparkSession, path: str, split: str, dataset: str = "synthetic") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows; invalid ones name the rules they break and their file."""
    plain = dataset == "synthetic"
    return _read(spark, path, split, dataset, PLAIN if plain else CITY, not plain, "quarantine")


def read_splits(spark: SparkSession, paths: dict[str, str], dataset: str = "synthetic", mode: str = "strict", multi_line: bool = False) -> DataFrame:
    """All three splits, as given: rows never change their split."""
    if set(paths) != set(SPLITS):
        raise ValueError(f"paths must be given for exactly {SPLITS}")
    read = read_synthetic_split if dataset == "synthetic" else lambda s, p, n, mode, multi: read_city_split(s, p, n, dataset, mode, multi)
    first, *rest = (read(spark, paths[s], s, mode, multi_line) for s in SPLITS)
    for df in rest:
        first = first.unionByName(df)
    return first
