import hashlib
import json
import math
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tests.data import EVENT, visits, write_csv
from wayfare.functions import contracts, scalars
from wayfare.operators import audit, encoder, examples, index, metrics, monitoring, scoring
from wayfare.plans import replay as replay_job
from wayfare.plans.evaluation import run_evaluation
from wayfare.schemas import EVENT as EVENT_SCHEMA
from wayfare.schemas import HISTORY, MONITORING
from wayfare.sources import checkins, monitoring_log, tables
from wayfare.streaming import jobs


@pytest.fixture(scope="module")
def events(spark):
    rows = [("synthetic", s, u, n, p, c, t) for s, u, n, t, p, c in visits()]
    df = spark.createDataFrame(rows, "dataset string, split string, raw_user_id string, session_id string, raw_poi_id string, category string, t string")
    none = lambda t: F.lit(None).cast(t)
    df = df.withColumn("timestamp_utc", scalars.parse_timestamp(F.col("t"))).withColumn("model_poi_id", none("long")).withColumn("latitude", none("double")).withColumn("longitude", none("double"))
    return df.select(*[c.split()[0] for c in EVENT_SCHEMA.split(", ")]).cache()


@pytest.fixture(scope="module")
def idx(events):
    return index.fit_index(events.filter("split = 'train'"))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_timestamps_need_an_offset(spark):
    parse = lambda t: one(spark, scalars.canonical_timestamp(scalars.parse_timestamp(F.lit(t))))
    assert parse(" 2026-01-01T09:00:00Z ") == "2026-01-01T09:00:00.000000Z"
    assert parse("2026-01-01 11:30:00.5+02:00") == "2026-01-01T09:30:00.500000Z"
    assert parse("Tue Apr 03 18:00:09 +0000 2012") == "2012-04-03T18:00:09.000000Z"
    assert [parse(t) for t in ("2026-01-01T09:00:00", "2026", "", "soon")] == [None] * 4


def test_golden_sample_id(spark):
    c = [F.lit(x) for x in ("synthetic", "fixture-v1", "synthetic-user-aurora", "synthetic-session-train-aurora")]
    ts = scalars.parse_timestamp(F.lit("2026-01-01T09:00:00Z"))
    assert one(spark, scalars.sample_id(*c, ts, F.lit("synthetic-poi-cafe"))) == "d887ca3d1fdb80f37f548ef185c70405cadbbf6a80939076401f669c5b9ff3c3"
    assert one(spark, scalars.sample_id(*c, ts, F.lit(" "))) is None


def test_entropy_and_history_lines(spark):
    assert one(spark, scalars.softmax_entropy(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.log(2))
    assert one(spark, scalars.softmax_entropy(F.array(F.lit(3.0)))) == 0.0
    rows = one(spark, scalars.parse_history_lines(F.lit("a | Cafe | 2026-01-01T09:00:00Z\n\nb | Park\n | x | y")))
    assert [(r["poi_id"], r["valid"]) for r in rows] == [("a", True), (None, False), ("", False)]


def test_readers(spark, tmp_path):
    paths = {s: write_csv(tmp_path, s) for s in contracts.SPLITS}
    df = checkins.read_splits(spark, paths)
    assert {r["split"]: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 19, "validation": 6, "test": 9}
    with pytest.raises(ValueError):
        checkins.read_splits(spark, {"train": paths["train"]})
    row = ("u", "s", "2026-01-01T08:00:00Z", "p", "c")
    bad = [(*row, "", ""), (*row, "1.0", "2.0"), ("", "s", "2026-01-01", "p", "c", "", "")]
    path = write_csv(tmp_path, "bad", bad, "raw_user_id,session_id,timestamp,raw_poi_id,category,latitude,longitude")
    with pytest.raises(contracts.ContractError, match="no_coordinates: 1"):
        checkins.read_synthetic_split(spark, path, "train")
    valid, invalid = checkins.quarantine_split(spark, path, "train")
    assert valid.count() == 1 and sorted(tuple(r["violations"]) for r in invalid.collect()) == [("no_coordinates",), ("raw_user_id", "timestamp_utc")]
    declared = write_csv(tmp_path, "declared", [(*row, "val")], "raw_user_id,session_id,timestamp,raw_poi_id,category,SplitTag")
    assert checkins.read_synthetic_split(spark, declared, "validation").count() == 1
    with pytest.raises(contracts.ContractError, match="declared_split"):
        checkins.read_synthetic_split(spark, declared, "train")
    city = write_csv(tmp_path, "city", [("u", "p", "Cafe", 40.5, -73.5, "2026-02-01 04:00:00+00:00", "t"), ("u", "p", "Cafe", 95, -73.5, "2026-02-01 04:00:00+00:00", "t")], "UserId,PoiId,PoiCategoryName,Latitude,Longitude,UTCTime,pseudo_session_trajectory_id")
    valid, invalid = checkins.quarantine_split(spark, city, "test", "nyc")
    assert valid.first()["latitude"] == 40.5 and invalid.first()["violations"] == ["latitude"]


def test_examples(spark, events):
    rest = events.filter("split != 'train'")
    rows = examples.build_examples(rest, "p")
    assert rows.count() == 10 and examples.build_examples(events, "p").count() == 24
    again = examples.build_examples(rest.repartition(7).orderBy(F.rand(3)), "p")
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))
    minute = F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)")
    long = spark.range(130).select(
        F.lit("synthetic").alias("dataset"), F.lit("test").alias("split"), F.lit("u").alias("raw_user_id"), F.lit("s").alias("session_id"), minute.alias("timestamp_utc"),
        F.format_string("%03d", "id").alias("raw_poi_id"), F.lit(None).cast("long").alias("model_poi_id"), F.lit("c").alias("category"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
    )
    last = examples.build_examples(long, "p").orderBy(F.desc("target_time")).first()
    assert [h["poi_id"] for h in last["history"]] == [f"{k:03d}" for k in range(1, 129)]
    with pytest.raises(ValueError):
        examples.require_unique(rows.unionAll(rows))


def dense(requests, idx, variant):
    """Plain Python over the whole catalog."""
    g = {r["poi_id"]: r for r in idx.poi_stats.collect()}
    t = {(r["bucket"], r["poi_id"]): r["n"] for r in idx.time_counts.collect()}
    c = {(r["category"], r["poi_id"]): r["n"] for r in idx.category_counts.collect()}
    m = {(r["src"], r["dst"]): r["n"] for r in idx.transition_counts.collect()}
    out = {}
    for r in requests.withColumn("bucket", scalars.time_bucket(F.col("target_time"))).collect():
        h = sorted((x["timestamp"], x["poi_id"], x["category_name"]) for x in r["history"])
        back = [p for _, p, _ in reversed(h)]
        scores = []
        for p in g:
            parts = {
                "global_popularity": math.log1p(g[p]["n"]), "time_popularity": 1.25 * math.log1p(t.get((r["bucket"], p), 0)), "transition": 2.0 * math.log1p(m.get((back[0], p), 0)),
                "recent_revisit": 1.5 / (back.index(p) + 1) if p in back else 0.0, "history_category": 0.75 * math.log1p(sum(c.get((k, p), 0) for k in {k for _, _, k in h[-10:]})),
            }
            scores.append((-round(sum(parts[s] for s in scoring.VARIANTS[variant]), 9), p))
        out[r["sample_id"]] = sorted(scores)
    return out


def test_pool_is_exact_for_every_variant(spark, events, idx):
    requests = examples.requests_of(examples.build_examples(events.filter("split != 'train'"), "p"))
    rows = scoring.score_requests(requests, idx, list(scoring.VARIANTS), depth=2).cache()
    for variant in scoring.VARIANTS:
        want = dense(requests, idx, variant)
        for r in scoring.ranked(rows.filter(F.col("variant") == variant), 2).collect():
            assert (-round(r["score"], 9), r["poi_id"]) == want[r["sample_id"]][r["rank"] - 1]
    prefix = {(r["variant"], r["sample_id"], r["rank"]): r["poi_id"] for r in scoring.ranked(rows, 1).collect()}
    assert all(prefix.get((r["variant"], r["sample_id"], r["rank"]), r["poi_id"]) == r["poi_id"] for r in scoring.ranked(rows, 2).collect())


def asked(spark, back, at, dataset="harbour"):
    """One request whose history is back (place, category), oldest first, an hour apart before at."""
    start = f"timestamp'{at}'"
    visit = [F.struct(F.expr(f"{start} - interval {len(back) - k} hours").alias("timestamp"), F.lit(p).alias("poi_id"), F.lit(c).alias("category_name")) for k, (p, c) in enumerate(back)]
    return spark.range(1).select(F.lit("r").alias("sample_id"), F.lit(dataset).alias("dataset"), F.array(*visit).alias("history"), F.expr(start).alias("target_time"), F.lit(3).alias("top_k"), F.lit("full").alias("profile"))


@pytest.fixture(scope="module")
def harbour(spark):
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return index.Index(
        "harbour",
        table([("pier", "Dock", 41, 30), ("mill", "Work", None, 12), ("cave", "Deep", 7, 1)], "poi_id string, category string, model_poi_id long, n long"),
        table([("weekend:evening", "mill", 9), ("weekend:evening", "pier", 4), ("weekday:night", "cave", 1), ("weekday:night", "pier", 26), ("weekday:night", "mill", 3)], "bucket string, poi_id string, n long"),
        table([("Dock", "pier", 28), ("Work", "pier", 2), ("Work", "mill", 12), ("Deep", "cave", 1)], "category string, poi_id string, n long"),
        table([("mill", "cave", 1), ("mill", "pier", 6), ("pier", "mill", 5)], "src string, dst string, n long"),
    )


def test_scores_term_by_term(spark, harbour):
    log = math.log1p
    # a Saturday evening after pier, mill, mill: the mill is the latest place, the pier the third from the end
    requests = asked(spark, [("pier", "Dock"), ("mill", "Work"), ("mill", "Work")], "2025-06-14 20:00:00")
    rows = {(r["variant"], r["poi_id"]): r["score"] for r in scoring.score_requests(requests, harbour, list(scoring.VARIANTS)).collect()}
    pier = {"popularity": log(30), "time": 1.25 * log(4), "move": 2 * log(6), "revisit": 1.5 / 3, "category": 0.75 * log(28 + 2)}
    mill = {"popularity": log(12), "time": 1.25 * log(9), "move": 0.0, "revisit": 1.5, "category": 0.75 * log(12)}
    cave = {"popularity": log(1), "time": 0.0, "move": 2 * log(1), "revisit": 0.0, "category": 0.0}
    without = {"b0": {"time", "move", "revisit", "category"}, "b1": {"move", "revisit", "category"}, "b2": {"revisit", "category"}, "b3": set(), "b3_no_time": {"time"}, "b3_no_transition": {"move"}, "b3_no_history": {"revisit", "category"}}
    for variant, left_out in without.items():
        for name, parts in (("pier", pier), ("mill", mill), ("cave", cave)):
            assert rows[variant, name] == pytest.approx(sum(x for k, x in parts.items() if k not in left_out)), (variant, name)
    top = {r["poi_id"]: r for r in scoring.recommendations(scoring.score_requests(requests, harbour, ["b3", "b1"])).filter("variant = 'b3'").collect()}
    assert {p: r["rank"] for p, r in top.items()} == {"pier": 1, "mill": 2, "cave": 3} and top["pier"]["model_poi_id"] == 41
    assert top["pier"]["candidate_sources"] == list(scoring.WEIGHTS) and top["cave"]["candidate_sources"] == ["global_popularity", "transition"]
    assert top["mill"]["candidate_sources"] == ["global_popularity", "time_popularity", "recent_revisit", "history_category"]


def test_requests_that_are_refused(spark, harbour):
    requests = asked(spark, [("pier", "Dock")], "2025-06-14 20:00:00")
    for column in ("target_poi_id", "label"):
        with pytest.raises(contracts.ContractError):
            scoring.score_requests(requests.withColumn(column, F.lit("pier")), harbour, ["b3"])
    for variants in (["b9"], [], ["b0", "b0"]):
        with pytest.raises(ValueError):
            scoring.score_requests(requests, harbour, variants)
    for dataset in ("lagoon", None):
        with pytest.raises(Exception, match="the index is of harbour"):
            scoring.score_requests(asked(spark, [("pier", "Dock")], "2025-06-14 20:00:00", dataset), harbour, ["b3"]).collect()


def test_rates_and_reasons(spark):
    """Four samples over a catalog of five places, against counts by hand."""
    made = [
        ("hits", "fig", ["fig", "elm", "oak"], 1), ("second", "elm", ["oak", "elm", "oak"], 2),
        ("strange", "ash", ["reef", "oak", "reef", "elm"], None), ("nothing", "oak", [], None),
    ]
    obs = spark.createDataFrame([("b0", *r) for r in made], "variant string, sample_id string, target_poi_id string, predictions array<string>, top_rank int")
    obs = obs.select("*", F.col("top_rank").alias("trace_rank"), F.lit(2).alias("macro_rank"), F.array().cast("array<string>").alias("target_sources"), *(F.lit("x").alias(s) for s in metrics.SLICES))
    catalog = spark.createDataFrame([(p,) for p in ("fig", "elm", "oak", "ash", "yew")], "poi_id string")
    row = metrics.summarise(obs, catalog).first()
    assert (row["hit_at_1"], row["hit_at_5"], row["mrr"]) == (0.25, 0.5, 0.375) and (row["macro_hit_at_1"], row["macro_hit_at_3"], row["macro_mrr"]) == (0.0, 1.0, 0.5)
    assert row["ndcg_at_5"] == pytest.approx((1 + 1 / math.log2(3)) / 4)
    assert (row["invalid_rate"], row["duplicate_rate"]) == (0.2, 0.2)  # 2 and 2 of 10 predicted
    assert (row["validity_rate"], row["empty_rate"], row["coverage"]) == (0.25, 0.25, 0.6)
    reasons = {r["sample_id"]: r["reasons"] for r in metrics.failures(obs, catalog).collect()}
    assert reasons == {"second": ["duplicate"], "strange": ["duplicate", "invalid", "target_miss_at_10"], "nothing": ["empty", "target_miss_at_10"]}
    assert metrics.summarise(obs.limit(0), catalog).count() == 0 and set(metrics.empty_summary().values()) == {0.0}
    by_slice = metrics.summarise(obs.withColumn("day_type", F.col("sample_id")), catalog, slices=True).filter("dimension = 'day_type' and value = 'strange'").first()
    assert (by_slice["samples"], by_slice["invalid_rate"], by_slice["coverage"]) == (1, 0.5, 0.4)


def test_overlaps_and_audit(spark, events, idx):
    moved = events.filter("split = 'train'").limit(1).withColumn("split", F.lit("validation"))
    both = events.unionByName(moved.withColumn("session_id", F.lit("other")))
    counts = {(r["kind"], r["left_split"], r["right_split"]): r["overlap"] for r in audit.overlap_counts(both).collect()}
    assert counts["event", "train", "validation"] == 1 and sum(counts.values()) == 1
    assert audit.overlap_counts(events.unionByName(moved)).filter("kind = 'session' and overlap = 1").count() == 1
    assert [r["ordered"] for r in audit.temporal_boundaries(audit.split_summary(events)).collect()] == [True, True]
    assert [r["ordered"] for r in audit.temporal_boundaries(audit.split_summary(events.filter("split != 'test'"))).collect()] == [True, None]
    assert index.audit_index(idx, index.taxonomy(events)).agg(F.sum("violations")).first()[0] == 0
    broken = index.Index(idx.dataset, idx.poi_stats.withColumn("n", F.col("n") + 1), idx.time_counts, idx.category_counts, idx.transition_counts)
    assert index.audit_index(broken, index.taxonomy(events)).filter("rule = 'time_sum'").first()["violations"] == 7
    first, second = (audit.fingerprint(df, audit.EVENT_COLUMNS).first()[0] for df in (events, events.repartition(5)))
    assert first == second != audit.fingerprint(both, audit.EVENT_COLUMNS).first()[0]
    with pytest.raises(ValueError):
        index.fit_index(events)


def test_encoder(spark, events):
    train = events.filter("split = 'train' and category != 'Deep'")
    e = encoder.fit_encoder(train, index.taxonomy(events), 3)
    assert [r["contiguous"] for r in encoder.check_ids(e, 3).collect()] == [True] * 3
    coded = encoder.encode(events.filter("category = 'Deep'"), e).first()
    assert coded["poi_code"] is None and coded["category_code"] is not None
    assert encoder.unseen_values(train, events, "raw_poi_id").first()[0] == "cave"


def test_requests_contract(spark):
    visit = "timestamp'2026-01-01 08:00:00'"
    h = F.expr(f"array(struct({visit} as timestamp, 'p' as poi_id, 'c' as category_name, 1L as model_poi_id, 1D as latitude, 1D as longitude))").cast(HISTORY)
    base = spark.range(1).select(h.alias("history"), F.expr("timestamp'2026-01-01 09:00:00'").alias("target_time"), F.lit(10).alias("top_k"), F.lit("nyc").alias("dataset"), F.lit("smoke").alias("profile"))
    broken = base.withColumn("target_time", F.expr("timestamp'2026-01-01 07:00:00'")).withColumn("top_k", F.lit(0))
    assert base.select(contracts.violations(contracts.request_rules())).first()[0] == []
    assert broken.select(contracts.violations(contracts.request_rules())).first()[0] == ["top_k", "target_time"]
    other = base.withColumn("dataset", F.lit("oslo")).withColumn("profile", F.lit(None).cast("string"))
    assert other.select(contracts.violations(contracts.request_rules())).first()[0] == ["dataset", "profile"]


def window(spark, n=20, **changes):
    return spark.createDataFrame([EVENT | {"request_id": f"smoke-{i}"} | changes for i in range(n)], MONITORING)


def test_drift(spark):
    a = window(spark)
    assert monitoring.overall_alert(monitoring.replay(a, a)).first()["dimensions"] == ""
    assert monitoring.overall_alert(monitoring.replay(a, a, inject=True)).first()["dimensions"] == "category,history_length"
    with pytest.raises(ValueError):
        monitoring.drift(a, a.limit(0))
    numbers = {r["name"]: r for r in monitoring.numeric_summaries(a).collect()}
    assert numbers["stage_latency_ms.rank"]["p95"] == 1.5 and numbers["unknown_count"]["count"] == 20


def test_monitoring_log(spark, tmp_path):
    path = str(tmp_path / "log")
    monitoring_log.append_events(window(spark, 3), path)
    monitoring_log.append_events(window(spark, 2), path)
    assert monitoring_log.read_events(spark, path).count() == 5
    assert monitoring_log.read_events(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    lines = [EVENT | {"user_id": "u"}, EVENT | {"versions": EVENT["versions"] | {"x": "y"}}, EVENT | {"status": "error"}, EVENT | {"category_histogram": {"Cafe": 1}}, EVENT]
    (tmp_path / "bad" / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "{nope"]) + "\n")
    with pytest.raises(contracts.ContractError):
        monitoring_log.read_events(spark, str(tmp_path / "bad"))
    valid, invalid = monitoring_log.parse_events(spark.read.text(str(tmp_path / "bad")), "quarantine")
    broken = reduce(set.union, (set(r["violations"]) for r in invalid.collect()))
    assert valid.count() == 1 and {"undeclared_field", "error_code", "category_keys", "json"} <= broken


def test_replay_job(spark, tmp_path):
    for name in ("reference", "current"):
        monitoring_log.append_events(window(spark), str(tmp_path / name))
    for inject in (False, True):
        out = str(tmp_path / f"out-{inject}")
        replay_job.main(["--reference", str(tmp_path / "reference"), "--current", str(tmp_path / "current"), "--output", out, *(["--inject-drift"] if inject else [])])
        found = {r["dimension"] for r in spark.read.parquet(f"{out}/drift").filter("alert").collect()}
        assert found == ({"category", "history_length"} if inject else set())
        assert spark.read.parquet(f"{out}/distributions").count() >= 6


def test_manifest_and_encoder_checks(spark, events, tmp_path):
    train, kinds = events.filter("split = 'train'"), index.taxonomy(events)
    made = encoder.fit_encoder(train, kinds, 3)
    assert audit.manifest(events, "p", made, kinds).select("encoder_fingerprint").distinct().count() == 1
    with pytest.raises(ValueError, match="aren't the taxonomy"):
        audit.manifest(events, "p", made.filter("value != 'Deep'"), kinds)
    with pytest.raises(ValueError, match="outside the taxonomy: Deep"):
        audit.manifest(events, "p", made.filter("value != 'Deep'"), kinds.filter("category != 'Deep'"))
    tables.save_encoder(made, str(tmp_path / "e"), "synthetic", 3)
    assert tables.load_encoder(spark, str(tmp_path / "e"), "synthetic").count() == made.count()
    with pytest.raises(ValueError, match="of nyc"):
        tables.load_encoder(spark, str(tmp_path / "e"), "nyc")
    tables.save_encoder(made.filter("id != 4"), str(tmp_path / "gap"), "synthetic", 3)
    with pytest.raises(ValueError, match="gaps"):
        tables.load_encoder(spark, str(tmp_path / "gap"), "synthetic")
    ordered = audit.temporal_order(audit.temporal_boundaries(audit.split_summary(events)))
    assert ordered.first()[0] is True and audit.temporal_order(audit.temporal_boundaries(audit.split_summary(train))).first()[0] is None


def test_report_core_is_the_same_in_every_run(spark):
    summary = spark.createDataFrame([("b0", 3, 0.5)], "variant string, samples long, mrr double")
    slices = spark.createDataFrame([("b0", "day_type", "weekday", 2, 0.25)], "variant string, dimension string, value string, samples long, mrr double")
    bad = spark.createDataFrame([("b0", "s1")], "variant string, sample_id string")
    ids = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    core = tables.report_core(summary, slices, bad, ids, "synthetic", "r1", "d")
    assert core == tables.report_core(summary, slices, bad, ids.repartition(3), "synthetic", "r1", "d") and core["slices"]["b0"]["day_type"]["weekday"]["mrr"] == 0.25
    assert core["core_sha256"] != tables.report_core(summary, slices, bad, ids.limit(2), "synthetic", "r1", "d")["core_sha256"]


def test_bundle(spark, idx, tmp_path):
    path = str(tmp_path / "bundle")
    tables.save_bundle(idx, path, "b3")
    loaded, variant = tables.load_bundle(spark, path)
    assert variant == "b3" and loaded.poi_stats.count() == 7
    with pytest.raises(Exception, match="(?i)exist"):
        tables.save_bundle(idx, path, "b3")
    idx.poi_stats.withColumn("n", F.col("n") + 1).write.mode("overwrite").parquet(f"{path}/poi_stats")
    with pytest.raises(ValueError, match="poi_stats"):
        tables.load_bundle(spark, path)


def test_evaluation_job(spark, events, idx, tmp_path):
    paths = {s: write_csv(tmp_path, s) for s in contracts.SPLITS}
    out = str(tmp_path / "out")
    summary = {r["variant"]: r for r in run_evaluation(spark, "synthetic", paths, out, "p", list(scoring.VARIANTS)).collect()}
    rows = examples.build_examples(events.filter("split != 'train'"), "p").select("sample_id", "target_poi_id", "target_category").collect()
    requests = examples.requests_of(examples.build_examples(events.filter("split != 'train'"), "p"))
    kind = {r["poi_id"]: r["category"] for r in idx.poi_stats.collect()}
    assert set(summary) == set(scoring.VARIANTS) and len(rows) == 10
    for variant, got in summary.items():
        order = {s: [p for _, p in found] for s, found in dense(requests, idx, variant).items()}
        places = [order[r["sample_id"]].index(r["target_poi_id"]) + 1 for r in rows]
        kinds = [list(dict.fromkeys(kind[p] for p in order[r["sample_id"]]))[:3] for r in rows]
        first = [ks.index(r["target_category"]) + 1 if r["target_category"] in ks else None for ks, r in zip(kinds, rows)]
        want = {f"hit_at_{k}": sum(p <= k for p in places) / 10 for k in (1, 5, 10)} | {f"ndcg_at_{k}": sum(1 / math.log2(p + 1) for p in places if p <= k) / 10 for k in (5, 10)}
        want |= {"mrr": sum(1 / p for p in places) / 10, "macro_hit_at_1": first.count(1) / 10, "macro_hit_at_3": sum(f is not None for f in first) / 10, "macro_mrr": sum(1 / f for f in first if f) / 10}
        want |= {"candidate_recall_at_100": 1.0, "validity_rate": 1.0, "coverage": 1.0, "samples": 10}
        assert {k: got[k] for k in want} == pytest.approx(want), variant
    assert spark.read.parquet(f"{out}/slices").count() > 7 and spark.read.parquet(f"{out}/runs").filter("metric = 'mrr'").count() == 7
    with pytest.raises(Exception, match="(?i)exist"):
        run_evaluation(spark, "synthetic", paths, out, "p", ["b0"])


def test_streams(spark, events, idx, tmp_path):
    rest = events.filter("split != 'train'")
    requests = examples.requests_of(examples.build_examples(rest, "p"))
    requests.write.parquet(str(tmp_path / "requests"))
    jobs.score_stream(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "requests")), idx, ["b3"], str(tmp_path / "scored"), str(tmp_path / "c2")).awaitTermination()
    batch = scoring.recommendations(scoring.score_requests(requests, idx, ["b3"])).select("sample_id", "rank", "poi_id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "scored/recommendations")).select("sample_id", "rank", "poi_id").collect())) == sorted(map(tuple, batch.collect()))
    monitoring_log.append_events(monitoring.inject_drift(window(spark)), str(tmp_path / "lines"))
    jobs.drift_stream(spark.readStream.text(str(tmp_path / "lines")), window(spark), str(tmp_path / "drift"), str(tmp_path / "c3")).awaitTermination()
    assert {r["dimension"] for r in spark.read.parquet(str(tmp_path / "drift")).filter("alert").collect()} == {"category", "history_length"}


def test_hash_forms(spark):
    assert one(spark, scalars.category_key(F.lit("Cafe"))) == "category_" + hashlib.sha256(b"Cafe").hexdigest()[:16]
