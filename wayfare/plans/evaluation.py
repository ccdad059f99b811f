"""The evaluation job: read three splits, audit, fit, score, judge and write."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.contracts import check_recommendations
from wayfare.operators.audit import EVENT_COLUMNS, fingerprint, manifest, overlap_counts, split_summary, temporal_boundaries, temporal_order
from wayfare.operators.encoder import fit_encoder
from wayfare.operators.examples import build_examples, requests_of, require_unique
from wayfare.operators.index import Index, fit_index, taxonomy
from wayfare.operators.metrics import failures, observations, summarise
from wayfare.operators.scoring import VARIANTS, check_variants, recommendations, score_requests
from wayfare.session import get_session
from wayfare.sources import tables
from wayfare.sources.checkins import read_splits


def evaluate(events: DataFrame, protocol: str, variants: list[str], top_k: int = 10) -> tuple[Index, DataFrame, DataFrame, DataFrame]:
    """(index, examples, scored rows, observations) for the validation and test rows of events."""
    index = fit_index(events.filter(F.col("split") == "train"))
    examples = require_unique(build_examples(events.filter(F.col("split") != "train"), protocol, top_k=top_k))
    rows = score_requests(requests_of(examples), index, variants)
    return index, examples, rows, observations(rows, examples, index)


def run_evaluation(spark: SparkSession, dataset: str, paths: dict[str, str], output: str, protocol: str, variants: list[str], release: str = "dev", top_k: int = 10, ledger: str | None = None) -> DataFrame:
    """Writes manifest, overlaps, encoder, bundle, recommendations, summary, slices and failures under output, its rows of the
    ledger (output/runs by default), and last the mark that output is published. A published output is never written again;
    one that isn't comes from an attempt that failed, and its parts are replaced. Returns the summary."""
    began = time.time()
    check_variants(variants)
    if tables.is_published(spark, output):
        raise ValueError(f"{output} exists and is published")
    events = read_splits(spark, paths, dataset)
    categories = taxonomy(events)
    tables.save_encoder(fit_encoder(events.filter(F.col("split") == "train"), categories), f"{output}/encoder", dataset, mode="overwrite")
    encoder = tables.load_encoder(spark, f"{output}/encoder", dataset)
    manifest(events, protocol, encoder, categories).withColumn("release", F.lit(release)).write.mode("overwrite").parquet(f"{output}/manifest")
    overlap_counts(events).write.mode("overwrite").parquet(f"{output}/overlaps")
    temporal_order(temporal_boundaries(split_summary(events))).write.mode("overwrite").parquet(f"{output}/order")
    tables.save_bundle(fit_index(events.filter(F.col("split") == "train")), f"{output}/bundle", variants[0], "overwrite")
    index, _ = tables.load_bundle(spark, f"{output}/bundle")
    # examples and scored rows are written once and read by all that follows
    require_unique(build_examples(events.filter(F.col("split") != "train"), protocol, top_k=top_k)).write.mode("overwrite").parquet(f"{output}/examples")
    examples = spark.read.parquet(f"{output}/examples")
    score_requests(requests_of(examples), index, variants).write.mode("overwrite").parquet(f"{output}/scored")
    rows = spark.read.parquet(f"{output}/scored")
    by_sample = lambda df, *more: df.repartitionByRange("sample_id").sortWithinPartitions("sample_id", "variant", *more)
    by_sample(recommendations(rows), "rank").write.mode("overwrite").parquet(f"{output}/recommendations")
    check_recommendations(spark.read.parquet(f"{output}/recommendations"))
    by_sample(observations(rows, examples, index)).write.mode("overwrite").parquet(f"{output}/observations")
    obs = spark.read.parquet(f"{output}/observations")
    summarise(obs, index.poi_stats).write.mode("overwrite").parquet(f"{output}/summary")
    summarise(obs, index.poi_stats, slices=True).write.mode("overwrite").parquet(f"{output}/slices")
    by_sample(failures(obs, index.poi_stats)).write.mode("overwrite").parquet(f"{output}/failures")
    summary = spark.read.parquet(f"{output}/summary")
    data = fingerprint(events, EVENT_COLUMNS).first()["fingerprint"]
    core = tables.report_core(summary, spark.read.parquet(f"{output}/slices"), spark.read.parquet(f"{output}/failures"), examples, dataset, release, data)
    tables.append_runs(summary, ledger or f"{output}/runs", f"{dataset}-{release}", {"protocol": protocol, "dataset": dataset}, core)
    texts = {"core": json.dumps(core, sort_keys=True), "markdown": tables.report(summary, f"Evaluation of {dataset}")[1], "runtime": json.dumps({"seconds": time.time() - began})}
    text = spark.createDataFrame(list(texts.items()), "format string, text string")
    text.coalesce(1).write.mode("overwrite").json(f"{output}/report")
    tables.publish(spark, output, {"release": release, "core_sha256": core["core_sha256"]})
    return summary


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Evaluate next-visit variants on explicit splits.")
    for name in ("dataset", "train", "validation", "test", "output", "split-protocol"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--variant", action="append", choices=sorted(VARIANTS))
    p.add_argument("--release-version", default="dev")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--ledger")
    a = p.parse_args(args)
    paths = {s: getattr(a, s) for s in ("train", "validation", "test")}
    run_evaluation(get_session("evaluation"), a.dataset, paths, a.output, a.split_protocol, a.variant or list(VARIANTS), a.release_version, a.top_k, a.ledger).show()


if __name__ == "__main__":
    main()
