"""Strict reads, the output contract, jobs that are run again, and the order of files."""

import json

import pytest
from pyspark.sql import functions as F

from tests.data import EVENT, write_csv
from wayfare.functions import contracts
from wayfare.operators import audit
from wayfare.plans import evaluation
from wayfare.schemas import MONITORING
from wayfare.sources import checkins, monitoring_log, tables


def test_strict_errors_show_file_and_row(spark, tmp_path):
    row = ("u", "s", "2026-01-01T08:00:00Z", "p", "c")
    path = write_csv(tmp_path, "bad", [row, ("", *row[1:]), ("", "s", "2026-01-01", "p", "c")])
    with pytest.raises(contracts.ContractError) as error:
        checkins.read_synthetic_split(spark, path, "train")
    told = str(error.value)
    assert "raw_user_id: 2 rows, as bad.csv: " in told and "timestamp_utc: 1 rows" in told and "2026-01-01" in told and "category" not in told.split("rows")[0]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "day.jsonl").write_text("\n".join(json.dumps(e) for e in (EVENT, EVENT | {"status": "gone"})) + "\n")
    with pytest.raises(contracts.ContractError, match="status: 1 rows, as day.jsonl: .*gone"):
        monitoring_log.read_events(spark, str(tmp_path / "log"))


def test_strict_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).repartition(3).mapInArrow(count, "id long")
    good, _ = contracts.enforce(df, {"negative": F.col("id") < 0}, "strict", ("id",))
    assert good.count() == 100 and good.agg(F.sum("id")).first()[0] == 4950 and seen.value == 100
    with pytest.raises(contracts.ContractError, match="odd: 50 rows, as 1$"):
        contracts.enforce(df, {"negative": F.col("id") < 0, "odd": F.col("id") % 2 == 1}, "strict", ("id",))


def test_output_contract(spark):
    kind = "variant string, sample_id string, rank int, poi_id string, score double, candidate_sources array<string>"
    made = lambda *rows: spark.createDataFrame([("b0", *r) for r in rows], kind)
    good = [("s1", 1, "a", 2.0, ["g"]), ("s1", 2, "b", 1.0, ["g", "t"]), ("s2", 1, "a", 0.5, ["g"])]
    assert contracts.check_recommendations(made(*good)).count() == 3
    bad = {
        "ranks": [("s3", 1, "a", 1.0, ["g"]), ("s3", 3, "b", 1.0, ["g"])], "places": [("s3", 1, "a", 1.0, ["g"]), ("s3", 2, "a", 1.0, ["g"])],
        "sources": [("s3", 1, "a", 1.0, ["g", "g"])], "score_finite": [("s3", 1, "a", float("nan"), ["g"])], "place": [("s3", 1, None, 1.0, ["g"])],
    }
    for rule, rows in bad.items():
        with pytest.raises(contracts.ContractError, match=f"{rule}: 1 lists, as b0 s3"):
            contracts.check_recommendations(made(*good, *rows))


def test_lines_are_the_same_for_equal_events(spark, tmp_path):
    one = EVENT | {"candidate_source_histogram": {"b": 1, "a": 2}, "stage_latency_ms": {"y": 1.0, "x": 2.0}}
    two = one | {"candidate_source_histogram": {"a": 2, "b": 1}, "stage_latency_ms": {"x": 2.0, "y": 1.0}}
    monitoring_log.append_events(spark.createDataFrame([one, two], MONITORING), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).distinct().count() == 1


def test_ledger_has_each_metric_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    summary = spark.createDataFrame([("b0", 3, 0.5), ("b1", 3, 0.25)], "variant string, samples long, mrr double")
    for run in ("r1", "r2", "r1"):
        tables.append_runs(summary, path, run, {"note": run})
    rows = spark.read.parquet(path)
    assert rows.count() == 8 and rows.groupBy("run_id", "variant", "metric").count().filter("count > 1").isEmpty()


def test_a_failed_job_can_be_run_again(spark, tmp_path, monkeypatch):
    paths = {s: write_csv(tmp_path, s) for s in contracts.SPLITS}
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    run = lambda release: evaluation.run_evaluation(spark, "synthetic", paths, out, "p", ["b0"], release, ledger=ledger)

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(evaluation, "summarise", broken)
        with pytest.raises(RuntimeError, match="lost"):
            run("r1")
    assert not tables.is_published(spark, out)
    assert run("r1").count() == 1 and tables.is_published(spark, out)
    with pytest.raises(ValueError, match="exists"):
        run("r2")
    assert {r["run_id"] for r in spark.read.parquet(ledger).collect()} == {"synthetic-r1"}


def test_order_of_files_and_of_any_column(spark, tmp_path):
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name, turned in (("ordered", None), ("within", 700), ("border", "last")):
            lines = [f"train,2026-01-01 00:{i // 60:02d}:{i % 60:02d},{i:05d}" for i in range(3000)]
            if turned == "last":
                lines = lines[1500:] + lines[:1500]
            elif turned:
                lines[turned], lines[turned + 1] = lines[turned + 1], lines[turned]
            (tmp_path / f"{name}.csv").write_text("split,timestamp_utc,key\n" + "\n".join(lines) + "\n")
            df = spark.read.option("header", True).schema("split string, timestamp_utc timestamp, key string").csv(str(tmp_path / f"{name}.csv"))
            assert df.rdd.getNumPartitions() > 10
            assert audit.input_ordered(audit.with_file_order(df), "file_order").first()["input_time_ordered"] == (turned is None)
            assert audit.input_ordered(df, "key").first()["input_time_ordered"] and audit.input_ordered(df, "timestamp_utc").first()["input_time_ordered"]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
