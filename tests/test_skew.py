"""Heavy sessions in many tasks, against plain windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators import examples, index, skew

VISITS = "dataset string, split string, raw_user_id string, session_id string, timestamp_utc timestamp, raw_poi_id string, model_poi_id long, category string, latitude double, longitude double"


@pytest.fixture
def visits(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        user = "hub" if i % 2 else f"u{rng.integers(300)}"
        rows.append((user, f"s{user}", int(rng.integers(0, 900)), f"p{rng.integers(0, 5)}", None if rng.random() < 0.3 else int(rng.integers(0, 3)), f"c{rng.integers(2)}"))
    rows += [("second", None, int(m), "p1", None, "c0") for m in rng.integers(0, 40, 700)] + [rows[1]] * 200  # a null session, ties, repeated rows
    df = spark.createDataFrame(rows, "raw_user_id string, session_id string, m int, raw_poi_id string, model_poi_id long, category string")
    none = F.lit(None).cast("double")
    return df.select(
        F.lit("synthetic").alias("dataset"), F.lit("train").alias("split"), "raw_user_id", "session_id", F.timestamp_seconds(F.col("m") * 60 + 1_750_000_000).alias("timestamp_utc"),
        "raw_poi_id", "model_poi_id", "category", none.alias("latitude"), none.alias("longitude"),
    ).cache()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, -5).otherwise(F.col("id") + 100).cast("long").alias("k"))
    assert skew.heavy_keys(df, F.col("k")) == [-5, 7]
    assert skew.heavy_keys(df.limit(0), F.col("k")) == []


@pytest.mark.parametrize("reach", [1, 128])
def test_parts_of_a_heavy_session(visits, monkeypatch, reach):
    monkeypatch.setattr(skew, "LEAST", 500)
    monkeypatch.setattr(skew, "SHARE", 1 / 20)
    order = [F.col("timestamp_utc"), F.col("raw_poi_id"), F.col("category")]
    spread = skew.spread_sessions(visits, ["raw_user_id", "session_id"], order, reach).cache()
    parts = {(r["raw_user_id"], r["part"]): r for r in spread.groupBy("raw_user_id", "part").agg(F.count_if(~F.col("halo")).alias("n"), F.count_if("halo").alias("h")).collect()}
    hub = [r for (u, p), r in parts.items() if u == "hub"]
    assert len(hub) >= 4 and max(r["n"] for r in hub) < 0.6 * sum(r["n"] for r in hub) and max(r["h"] for r in hub) <= reach
    assert {p for (u, p) in parts if u not in ("hub", "second")} == {-1}
    assert spread.filter(~F.col("halo")).count() == visits.count()


def test_pairs_and_examples_equal_plain_windows(visits, monkeypatch):
    plain_pairs, plain_examples = rows_of(index.consecutive_pairs(visits)), {n: rows_of(examples.build_examples(visits, "p", n)) for n in (1, 200)}
    order = Window.partitionBy("raw_user_id", "session_id").orderBy("timestamp_utc", "raw_poi_id", "category")
    assert plain_pairs == rows_of(visits.select(F.col("raw_poi_id").alias("src"), F.lead("raw_poi_id").over(order).alias("dst")).filter("dst IS NOT NULL"))
    assert len(plain_examples[200]) > 1000
    monkeypatch.setattr(skew, "LEAST", 500)
    monkeypatch.setattr(skew, "SHARE", 1 / 20)
    assert rows_of(index.consecutive_pairs(visits)) == plain_pairs
    for n, want in plain_examples.items():
        assert rows_of(examples.build_examples(visits, "p", n)) == want
