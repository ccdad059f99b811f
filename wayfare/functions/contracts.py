"""Row rules as arrays of violation names, and what to do with rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wayfare.functions.scalars import HISTORY_BUCKETS
from wayfare.schemas import MONITORING_FIELDS
from wayfare.session import written_once

# Admissible datasets, splits and request bounds.
DATASETS = ("nyc", "tky", "ca", "synthetic")
SPLITS = ("train", "validation", "test")
MAX_HISTORY, MAX_TOP_K = 128, 100
LABEL_WORDS = ("target_poi", "label", "result", "answer")
PROFILES = ("smoke",)
TOKEN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
CATEGORY_KEY = r"^category_[0-9a-f]{16}$"
#: Characters of each column that an error shows of a row.
SHOWN = 500


class ContractError(ValueError):
    """Rows break a rule in strict mode."""


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that are true; a rule that is null counts as broken."""
    return F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())


def enforce(df: DataFrame, rules: dict[str, Column], mode: str = "strict", detail: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows; invalid ones carry violations. Strict mode raises if there is an invalid row, and names for each
    rule the number of rows and the columns of detail of the least of them. It reads df once: the valid rows are written where
    the cluster keeps its checkpoints while the rules are counted, and are given out only if no rule was broken."""
    marked = df.withColumn("violations", violations(rules))
    if mode != "strict":
        return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)
    seen = Observation()
    broken = {f"r{i}": F.array_contains("violations", name) for i, name in enumerate(rules)}
    shown = F.concat_ws(": ", *(F.substring(F.col(c).cast("string"), 1, SHOWN) for c in detail)) if detail else F.lit("")
    counts = [F.count_if(test).alias(f"{c}_n") for c, test in broken.items()] + [F.min(F.when(test, shown)).alias(f"{c}_e") for c, test in broken.items()]
    good = written_once(marked.observe(seen, *counts).filter(F.size("violations") == 0).drop("violations"))
    good.count()
    found = seen.get
    faults = [f"{name}: {found[f'r{i}_n']} rows" + (f", as {found[f'r{i}_e']}" if found[f"r{i}_e"] else "") for i, name in enumerate(rules) if found[f"r{i}_n"]]
    if faults:
        raise ContractError("; ".join(faults))
    return good, marked.filter(F.size("violations") > 0)


def event_rules() -> dict[str, Column]:
    missing = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    known = lambda c: F.col(c).isNotNull()
    return {
        "dataset": ~F.coalesce(F.col("dataset").isin(*DATASETS), F.lit(False)),
        "split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        **{c: missing(c) for c in ("raw_user_id", "session_id", "raw_poi_id", "category")},
        "timestamp_utc": F.col("timestamp_utc").isNull(),
        "model_poi_id": known("model_poi_id") & (F.col("model_poi_id") < 0),
        "coordinates_paired": known("latitude") != known("longitude"),
        "latitude": known("latitude") & ~F.col("latitude").between(-90, 90),
        "longitude": known("longitude") & ~F.col("longitude").between(-180, 180),
    }


def request_rules() -> dict[str, Column]:
    size = F.coalesce(F.size("history"), F.lit(0))
    latest = F.array_max(F.transform("history", lambda h: h["timestamp"]))
    among = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    return {
        "dataset": among("dataset", DATASETS),
        "profile": among("profile", PROFILES),
        "history_size": ~size.between(1, MAX_HISTORY),
        "top_k": ~F.col("top_k").between(1, MAX_TOP_K),
        "target_time": F.col("target_time") < latest,
        "history_values": F.exists("history", lambda h: F.coalesce(F.trim(h["poi_id"]), F.lit("")) == ""),
    }


def assert_target_blind(requests: DataFrame) -> DataFrame:
    told = [c for c in requests.columns if any(word in c.lower() for word in LABEL_WORDS)]
    if told:
        raise ContractError(f"requests hold label fields: {', '.join(told)}")
    return requests


def recommendation_rules() -> dict[str, Column]:
    sources = F.col("candidate_sources")
    return {
        "place": F.coalesce(F.trim("poi_id"), F.lit("")) == "",
        "score_finite": F.isnan("score") | (F.abs("score") == float("inf")),
        "sources": (F.size(sources) == 0) | (F.size(F.array_distinct(sources)) != F.size(sources)) | F.exists(sources, lambda s: F.coalesce(s, F.lit("")) == ""),
    }


def check_recommendations(recommendations: DataFrame) -> DataFrame:
    """The recommendations, if they keep the output contract: row by row, and for each variant and sample ranks from 1 without
    gaps or repeats and different places. One pass, dealt by sample."""
    marked = recommendations.withColumn("violations", violations(recommendation_rules()))
    lists = marked.groupBy("variant", "sample_id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last"), F.min("rank").alias("first"), F.count_distinct("rank").alias("ranks"), F.count_distinct("poi_id").alias("places"),
        F.array_distinct(F.flatten(F.collect_list("violations"))).alias("violations"),
    )
    gaps = (F.col("first") != 1) | (F.col("last") != F.col("n")) | (F.col("ranks") != F.col("n"))
    whole = F.concat("violations", violations({"ranks": gaps, "places": F.col("places") != F.col("n")}))
    bad = lists.select("variant", "sample_id", F.explode(whole).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", "variant", "sample_id")).alias("example")).orderBy("rule").collect()
    if bad:
        raise ContractError("; ".join(f"{r['rule']}: {r['n']} lists, as {r['example']}" for r in bad))
    return recommendations


def monitoring_rules() -> dict[str, Column]:
    token = lambda c: ~F.coalesce(F.col(c).rlike(TOKEN), F.lit(False))
    counts = lambda c: F.exists(F.map_values(c), lambda v: v < 0)
    return {
        "request_id": token("request_id"),
        **{f"versions_{v}": token(f"versions.{v}") for v in ("release", "data", "model")},
        "history_length_bucket": ~F.coalesce(F.col("history_length_bucket").isin(*HISTORY_BUCKETS), F.lit(False)),
        "counts": (F.col("unknown_count") < 0) | (F.col("candidate_count") < 0) | counts("candidate_source_histogram") | counts("category_histogram"),
        "category_keys": F.exists(F.map_keys("category_histogram"), lambda k: ~k.rlike(CATEGORY_KEY)),
        "entropy": (F.col("score_entropy") < 0) | F.isnan("score_entropy"),
        "latency": (F.col("total_latency_ms") < 0) | F.exists(F.map_values("stage_latency_ms"), lambda v: v < 0),
        "status": ~F.coalesce(F.col("status").isin("ok", "error"), F.lit(False)),
        "error_code": (F.col("status") == "error") != F.col("error_code").isNotNull(),
        "error_code_token": F.col("error_code").isNotNull() & ~F.col("error_code").rlike(TOKEN),
    }


def undeclared_fields(value: Column) -> Column:
    """Of a monitoring event's JSON text: keys that the schema doesn't know."""
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    inner = F.coalesce(F.json_object_keys(F.get_json_object(value, "$.versions")), F.array().cast("array<string>"))
    extra = F.filter(keys, lambda k: ~k.isin(*MONITORING_FIELDS))
    return F.concat(extra, F.filter(inner, lambda k: ~k.isin("release", "data", "model")))
