"""Rolling histories of visits out of order against the batch examples."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import examples
from wayfare.streaming.histories import rolling_histories

VISITS = "dataset string, split string, raw_user_id string, session_id string, timestamp_utc timestamp, raw_poi_id string, model_poi_id long, category string, latitude double, longitude double"
START = dt.datetime(2026, 1, 5, 8, tzinfo=dt.timezone.utc)


def visit(user, minute, poi, category="c"):
    return ("synthetic", "test", user, "s", START + dt.timedelta(minutes=minute), poi, None, category, None, None)


def run(spark, tmp_path, files, **how):
    """Each list of rows is a file and a batch of its own."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, VISITS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(VISITS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = rolling_histories(stream, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_out_of_order_equals_the_batch_job(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [visit("a", m, f"p{m % 37}", "cd"[m % 2]) for m in range(300)] + [visit("b", 3 * m, f"q{m}") for m in range(20)]
    rows += [visit("a", 40, "same"), visit("a", 40, "same"), visit("a", 40, "other")]  # ties and a repeated row
    arrival = sorted(range(len(rows)), key=lambda i: rows[i][4].timestamp() / 60 + rng.uniform(0, 50))
    files = [[rows[i] for i in part] for part in np.array_split(arrival, 4)]
    flush = [visit("z", 5000, "end")]
    late = [visit("a", 17, "too late"), visit("z", 5001, "end")]
    got = run(spark, tmp_path, [*files, flush, late], lateness="1 hour", idle="30 days")
    want = examples.build_examples(spark.createDataFrame(rows, VISITS), "p").collect()
    expected = sorted((r["target_time"], r["target_poi_id"], r["target_category"], [h["poi_id"] for h in r["history"]]) for r in want)
    on_time = [r for r in got if not r["late"]]
    assert sorted((r["timestamp_utc"], r["raw_poi_id"], r["category"], r["history"]) for r in on_time if r["history_size"]) == expected
    assert max(r["history_size"] for r in on_time) == 128 and len(on_time) == len(rows)
    assert [(r["raw_poi_id"], r["history"], r["history_size"]) for r in got if r["late"]] == [("too late", None, None)]


def test_idle_sessions_are_forgotten(spark, tmp_path):
    files = [[visit("a", 0, "p"), visit("a", 1, "q")], [visit("z", 60 * 30, "x")], [visit("z", 60 * 31, "x")], [visit("a", 60 * 40, "r")], [visit("z", 60 * 60, "y")], [visit("z", 60 * 61, "y")]]
    got = {r["raw_poi_id"]: r["history"] for r in run(spark, tmp_path, files, lateness="1 minute", idle="1 hour") if r["raw_user_id"] == "a"}
    assert got == {"p": [], "q": ["p"], "r": []}
