"""Monitoring events as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.contracts import enforce, monitoring_rules, undeclared_fields
from wayfare.schemas import MONITORING, MONITORING_FIELDS


def parse_events(lines: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) events of a frame with the column value; blank lines are skipped. A column file, where there is one, is
    named in errors."""
    read = lines.filter(F.trim("value") != "").withColumn("e", F.from_json("value", f"{MONITORING}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    extra = undeclared_fields(F.col("value"))
    missing = F.size(F.array_except(F.array(*(F.lit(f) for f in MONITORING_FIELDS if f != "error_code")), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))) > 0
    where = F.col("file") if "file" in lines.columns else F.lit(None).cast("string")
    flat = read.select(where.alias("file"), "value", F.col("e._corrupt_record").isNotNull().alias("corrupt"), (F.size(extra) > 0).alias("extra"), missing.alias("missing"), *(F.col(f"e.{f}").alias(f) for f in MONITORING_FIELDS))
    rules = {"json": F.col("corrupt"), "undeclared_field": F.col("extra"), "missing_field": F.col("missing"), **monitoring_rules()}
    valid, invalid = enforce(flat, rules, mode, ("file", "value"))
    return valid.select(*MONITORING_FIELDS), invalid


def read_events(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """A window of events; a path that isn't there is an empty window."""
    try:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MONITORING)
    return parse_events(lines, mode)[0]


def append_events(events: DataFrame, path: str) -> None:
    """One line of JSON for each event, checked once more. Keys are sorted at every level, so equal events are equal lines."""
    valid, _ = enforce(events.select(*MONITORING_FIELDS), monitoring_rules(), "strict", ("request_id",))
    maps = {f.name for f in valid.schema if f.dataType.typeName() == "map"}
    field = lambda c: F.map_from_entries(F.array_sort(F.map_entries(c))).alias(c) if c in maps else F.col(c)
    ordered = F.struct(*(field(c) for c in sorted(MONITORING_FIELDS) if c != "versions"), F.struct("versions.data", "versions.model", "versions.release").alias("versions"))
    valid.select(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
