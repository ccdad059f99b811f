"""Versioned tables: model bundles, encoders, reports and the ledger of runs."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.scalars import TIME_BUCKETS
from wayfare.operators.audit import fingerprint
from wayfare.operators.encoder import check_ids
from wayfare.operators.index import Index
from wayfare.operators.scoring import VARIANTS, WEIGHTS

CONFIG = {"weights": WEIGHTS, "variants": VARIANTS, "time_buckets": TIME_BUCKETS, "version": "1"}
RESERVED = ("run_id", "variant", "lineage", "metric", "value", "config_fingerprint", "sample_set", "data_fingerprint", "core_sha256")


def _facts(df: DataFrame) -> tuple[int, str]:
    row = fingerprint(df, sorted(df.columns)).first()
    return df.count(), row["fingerprint"] if row else ""


def save_bundle(index: Index, path: str, variant: str, mode: str = "errorifexists") -> None:
    """The index's tables, and a manifest with their sizes and fingerprints, which comes last; an existing bundle isn't
    overwritten, unless by a job that replaces the parts of an attempt that failed (mode "overwrite")."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    tables = index.tables()
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
    spark = index.poi_stats.sparkSession
    rows = [(name, *_facts(spark.read.parquet(f"{path}/{name}"))) for name in tables]
    manifest = spark.createDataFrame(rows, "name string, n long, fingerprint string")
    manifest.withColumn("variant", F.lit(variant)).withColumn("dataset", F.lit(index.dataset)).withColumn("config", F.lit(json.dumps(CONFIG, sort_keys=True))).coalesce(1).write.mode(mode).parquet(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[Index, str]:
    """The index and the variant; every table is checked against the manifest before it is used."""
    rows = spark.read.parquet(f"{path}/manifest").collect()
    tables = {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in rows}
    for r in rows:
        if _facts(tables[r["name"]]) != (r["n"], r["fingerprint"]):
            raise ValueError(f"table {r['name']} isn't what the manifest says")
        if r["config"] != json.dumps(CONFIG, sort_keys=True) or r["variant"] not in VARIANTS:
            raise ValueError("the bundle was made with another configuration")
    return Index(rows[0]["dataset"], **tables), rows[0]["variant"]


ENCODER_VERSION, REPORT_VERSION, LINEAGE = "1", "1", "production_current"


def save_encoder(encoder: DataFrame, path: str, dataset: str, offset: int = 0, mode: str = "errorifexists") -> None:
    """The ids, and what they were made of."""
    if not dataset or offset < 0:
        raise ValueError("an encoder has a dataset and an offset of at least 0")
    encoder.repartitionByRange("mapping", "value").sortWithinPartitions("mapping", "value").write.mode(mode).parquet(f"{path}/ids")
    facts = [(ENCODER_VERSION, dataset, "train", offset)]
    encoder.sparkSession.createDataFrame(facts, "version string, dataset string, fitted_split string, id_offset long").coalesce(1).write.mode(mode).parquet(f"{path}/facts")


def load_encoder(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The ids of an encoder of this dataset, checked."""
    facts = spark.read.parquet(f"{path}/facts").first()
    if facts["version"] != ENCODER_VERSION or facts["fitted_split"] != "train" or facts["dataset"] != dataset:
        raise ValueError(f"an encoder of version {ENCODER_VERSION}, fitted on train of {dataset}, was wanted: {facts.asDict()}")
    encoder = spark.read.parquet(f"{path}/ids")
    if not encoder.filter(~F.col("mapping").isin("poi", "user", "category") | (F.coalesce("value", F.lit("")) == "")).isEmpty():
        raise ValueError("an unknown mapping or an empty value")
    if not check_ids(encoder, facts["id_offset"]).filter(~F.col("contiguous")).isEmpty():
        raise ValueError("ids have gaps")
    return encoder


def config_fingerprint() -> str:
    return hashlib.sha256(json.dumps(CONFIG, sort_keys=True).encode()).hexdigest()


def report(summary: DataFrame, title: str) -> tuple[str, str]:
    """JSON (sorted keys) and Markdown of a small summary table, one row for each variant."""
    rows = sorted((r.asDict() for r in summary.collect()), key=lambda r: r["variant"])
    names = [c for c in summary.columns if c not in ("variant", "dimension", "value")]
    lines = [f"# {title}", "", "| variant | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    lines += ["| " + " | ".join([r["variant"], *(f"{r[n]:.6f}" if isinstance(r[n], float) else str(r[n]) for n in names)]) + " |" for r in rows]
    return json.dumps({r["variant"]: {n: r[n] for n in names} for r in rows}, sort_keys=True), "\n".join(lines) + "\n"


def report_core(summary: DataFrame, slices: DataFrame, failures: DataFrame, examples: DataFrame, dataset: str, release: str, data_fingerprint: str) -> dict:
    """What a report says of a result, without times: it and its hash are the same in every run. Samples and failures, which grow
    with the input, are in it by the fingerprints of their tables."""
    print_of = lambda df: getattr(fingerprint(df, sorted(df.columns)).first(), "fingerprint", "")
    by_slice: dict = {}
    for r in slices.collect():  # some rows for each variant
        by_slice.setdefault(r["variant"], {}).setdefault(r["dimension"], {})[r["value"]] = {k: v for k, v in r.asDict().items() if k not in ("variant", "dimension", "value")}
    core = {
        "schema_version": REPORT_VERSION, "result_lineage": LINEAGE, "dataset": dataset, "model_version": release, "data_fingerprint": data_fingerprint, "config_fingerprint": config_fingerprint(),
        "sample_set": print_of(examples.select("sample_id")), "failures": print_of(failures), "metrics": json.loads(report(summary, "")[0]), "slices": by_slice,
    }
    return {**core, "core_sha256": hashlib.sha256(json.dumps(core, sort_keys=True).encode()).hexdigest()}


def append_runs(summary: DataFrame, path: str, run_id: str, params: dict[str, str], core: dict | None = None) -> None:
    """Ledger rows (run_id, variant, params, metric, value, and the fingerprints of configuration, samples, data and core). The
    ledger is partitioned by run and variant, and writing one again replaces it: each (run, variant, metric) is there once,
    however often a job is run."""
    taken = sorted(set(params) & set(RESERVED))
    if taken:
        raise ValueError(f"reserved keys: {', '.join(taken)}")
    names = [c for c, t in summary.dtypes if t in ("double", "bigint")]
    entries = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")
    rows = summary.select(F.lit(run_id).alias("run_id"), "variant", F.lit(json.dumps(params, sort_keys=True)).alias("params"), entries)
    known = {"lineage": LINEAGE, "config_fingerprint": config_fingerprint(), **{k: (core or {}).get(k) for k in ("sample_set", "data_fingerprint", "core_sha256")}}
    rows.select("run_id", "variant", "params", "m.metric", "m.value", *(F.lit(v).cast("string").alias(k) for k, v in known.items())).write.mode("overwrite").partitionBy("run_id", "variant").option("partitionOverwriteMode", "dynamic").parquet(path)


def is_published(spark: SparkSession, output: str) -> bool:
    try:
        return not spark.read.parquet(f"{output}/published").isEmpty()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def publish(spark: SparkSession, output: str, facts: dict[str, str]) -> None:
    """The mark that all tables of an output are complete, written after them."""
    spark.createDataFrame(list(facts.items()), "fact string, value string").coalesce(1).write.mode("overwrite").parquet(f"{output}/published")
