"""Percentiles of many different values, and fingerprints that add up."""

import math

import numpy as np
from pyspark.sql import functions as F

from wayfare.operators import audit, metrics
from wayfare.operators.percentiles import of_key, order_key, percentiles


def interpolated(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low if low == high else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))


def test_keys_order_as_doubles(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 1.0000000000000002, float("inf"), float("-inf"), 1e308, -1e308, 3.25]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_key(F.col("x")).alias("k")).withColumn("y", of_key(F.col("k"))).collect()
    assert [r["x"] for r in sorted(rows, key=lambda r: (r["k"], r["x"]))] == sorted(values) and all(r["x"] == r["y"] for r in rows)


def test_percentiles_of_a_million_different_values(spark):
    df = spark.range(1_000_000).select(F.lit("a").alias("name"), ((F.col("id") * 7919 % 1_000_003) / 7 - 50_000).alias("x"))
    values = [(i * 7919 % 1_000_003) / 7 - 50_000 for i in range(1_000_000)]
    got = percentiles(df, ["name"], "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}).first()
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p0", 0.0), ("p100", 1.0)):
        assert got[name] == interpolated(values, q)


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(["a", "b", None, "c"][i % 4 if i < 200 else 0], float(v)) for i, v in enumerate(np.concatenate((rng.normal(size=100), np.round(rng.normal(size=100)), [3.5] * 300)))]
    rows += [("one", 2.5), ("none", None), ("two", -1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "n string, latency double").repartition(5)
    by = {}
    for k, v in rows:
        by.setdefault(k, []).extend([] if v is None else [v])
    got = {r["n"]: r for r in metrics.latency_summary(df, "latency", ["n"]).collect()}
    assert set(got) == set(by) and got["none"]["count"] == 0 and got["none"]["p50"] is None
    for k, v in by.items():
        if v:
            assert abs(got[k]["p50"] - interpolated(v, 0.5)) < 1e-12 and abs(got[k]["p95"] - interpolated(v, 0.95)) < 1e-12 and got[k]["max"] == max(v)
    whole = metrics.latency_summary(df, "latency").first()
    assert abs(whole["p95"] - interpolated([v for _, v in rows if v is not None], 0.95)) < 1e-12
    assert metrics.latency_summary(df.limit(0), "latency").first()["p50"] is None


def test_fingerprints_add_up(spark):
    rows = [(i % 3, i, f"row {i % 40}", None if i % 7 else float(i)) for i in range(300)]
    frame = lambda r: spark.createDataFrame(r, "day int, id long, text string, x double")
    columns = ["id", "text", "x"]
    one = lambda df: audit.fingerprint(df, columns).first()["fingerprint"]
    whole = one(frame(rows))
    assert whole == one(frame(rows[::-1]).repartition(7))
    days = audit.fingerprint_state(frame(rows), columns, ["day"])
    assert days.agg(F.max(F.size("limbs"))).first()[0] == audit.LIMBS
    merged = audit.merge_states(days).select(audit.state_digest(F.col("rows"), F.col("limbs")).alias("d"), "rows").first()
    assert (merged["d"], merged["rows"]) == (whole, 300)
    changed = [(*rows[0][:2], "other", rows[0][3]), *rows[1:]]
    swapped = [(*r[:2], r[2], None if r[3] is not None else 0.0) for r in rows[:1]] + rows[1:]
    assert len({whole, one(frame(changed)), one(frame(swapped)), one(frame(rows[1:])), one(frame(rows + rows[:1])), one(frame(rows * 2)), one(frame([]))}) == 7


def test_sum_of_digests_is_modulo_two_to_the_256(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("t"))
    digests = [int(r["h"], 16) for r in df.select(audit.row_digest(df, ["t"]).alias("h")).collect()]
    state = audit.fingerprint_state(df, ["t"]).first()
    assert sum(v << 16 * i for i, v in enumerate(state["limbs"])) == sum(digests)


def test_days_merge_into_the_audit_of_all(spark, tmp_path):
    path = str(tmp_path / "days")
    day = F.expr("timestamp'2026-03-01 00:00:00'") + F.make_interval(days=(F.col("id") % 5).cast("int"), mins=(F.col("id") % 700).cast("int"))
    none = F.lit(None).cast("double")
    events = spark.range(4000).select(
        F.lit("synthetic").alias("dataset"), F.when(F.col("id") % 5 < 3, "train").otherwise("test").alias("split"), (F.col("id") % 900).cast("string").alias("raw_user_id"), F.lit("s").alias("session_id"),
        day.alias("timestamp_utc"), (F.col("id") % 77).cast("string").alias("raw_poi_id"), F.lit(None).cast("long").alias("model_poi_id"), F.lit("c").alias("category"), none.alias("latitude"), none.alias("longitude"),
    ).cache()
    for d in (0, 1, 2, 3, 4, 2):  # a day comes twice
        audit.add_days(events.filter(F.dayofmonth("timestamp_utc") == d + 1), path)
    got = {r["split"]: r for r in audit.merged_days(spark.read.parquet(path)).collect()}
    prints = {r["split"]: r["fingerprint"] for r in audit.fingerprint(events, audit.EVENT_COLUMNS, ["split"]).collect()}
    for r in audit.split_summary(events).collect():
        m = got[r["split"]]
        assert (m["events"], m["first_ts"], m["last_ts"], m["fingerprint"]) == (r["events"], r["first_ts"], r["last_ts"], prints[r["split"]])
        assert abs(m["approximate_sessions"] - r["sessions"]) <= 0.04 * r["sessions"]
    # an audit of one day more reads that day alone: what is merged are rows of the table of states
    assert spark.read.parquet(path).count() == 5
