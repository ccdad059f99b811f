"""Best places of profiles from lists with bounds, against scores of every place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_library import dense
from wayfare.functions.scalars import TIME_BUCKETS
from wayfare.operators import scoring, serving
from wayfare.operators.index import Index
from wayfare.sources import serving_tables


@pytest.fixture(autouse=True)
def lists_for_small_catalogs(monkeypatch):
    monkeypatch.setattr(serving, "WHOLE", 0)


def catalog(spark, n, seed=0, kinds=20, most=4, hub=0):
    """An index of n places with up to `most` categories each; with a hub, a place that has moves to so many places."""
    rng = np.random.default_rng(seed)
    pois, times, cats, moves = [], [], [], []
    for p in range(n):
        name = f"p{p:05d}"
        counts = {f"k{k:02d}": int(1 + rng.pareto(1.2) * 3) for k in rng.choice(kinds, rng.integers(1, most + 1), replace=False)}
        whole = sum(counts.values())
        in_time = rng.multinomial(whole, [1 / 8] * 8)
        pois.append((name, min(counts, key=lambda c: (-counts[c], c)), p, whole))
        times += [(b, name, int(t)) for b, t in zip(TIME_BUCKETS, in_time, strict=True) if t]
        cats += [(c, name, v) for c, v in counts.items()]
        moves += [(name, f"p{d:05d}", int(rng.integers(1, 4))) for d in rng.choice(n, 2, replace=False)]
    moves += [("p00000", f"p{d:05d}", int(1 + rng.pareto(1.0))) for d in range(1, hub)]
    moves = list({(a, b): (a, b, v) for a, b, v in moves}.values())
    frames = (
        spark.createDataFrame(pois, "poi_id string, category string, model_poi_id long, n long"), spark.createDataFrame(times, "bucket string, poi_id string, n long"),
        spark.createDataFrame(cats, "category string, poi_id string, n long"), spark.createDataFrame(moves, "src string, dst string, n long"),
    )
    return Index("synthetic", *(f.cache() for f in frames))


def requests(spark, n_places, count, seed=1, known=True, kinds=20, latest=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        back = [(f"2026-01-{1 + i % 28:02d} {h:02d}:00:00", f"p{rng.integers(n_places):05d}" if known else "elsewhere", f"k{rng.integers(kinds):02d}") for h in range(rng.integers(1, 14))]
        if latest:
            back[-1] = (back[-1][0], latest, back[-1][2])
        rows.append((f"r{i:03d}", "synthetic", back, f"2026-01-{1 + i % 28:02d} {14 + i % 10:02d}:00:00", 10, "smoke"))
    raw = spark.createDataFrame(rows, "sample_id string, dataset string, h array<struct<timestamp:string,poi_id:string,category_name:string>>, target_time string, top_k int, profile string")
    visit = lambda x: F.struct(x["timestamp"].cast("timestamp").alias("timestamp"), x["poi_id"].alias("poi_id"), x["category_name"].alias("category_name"))
    return raw.select("sample_id", "dataset", F.transform("h", visit).alias("history"), F.col("target_time").cast("timestamp").alias("target_time"), "top_k", "profile").cache()


@pytest.mark.parametrize(("most", "hub", "block"), [(1, 0, 256), (4, 0, 8), (4, 250, 4)])
def test_equals_scores_of_every_place(spark, monkeypatch, most, hub, block):
    monkeypatch.setattr(serving, "BLOCK", block)
    idx = catalog(spark, 300, most=most, hub=hub)
    asked = requests(spark, 300, 25, latest="p00000" if hub else None)
    voted = {r["poi_id"]: r["category"] for r in idx.poi_stats.collect()}
    rows = scoring.score_requests(asked, idx, list(scoring.VARIANTS), depth=12).cache()
    for variant in scoring.VARIANTS:
        own = rows.filter(F.col("variant") == variant)
        got, macro = {}, {}
        for r in scoring.ranked(own, 12).orderBy("rank").collect():
            got.setdefault(r["sample_id"], []).append((-round(r["score"], 9), r["poi_id"]))
        for r in scoring.macro_categories(own).orderBy("rank").collect():
            macro.setdefault(r["sample_id"], []).append(r["category"])
        for sample, want in dense(asked, idx, variant).items():
            assert got[sample] == want[:12]
            assert macro[sample] == list(dict.fromkeys(voted[p] for _, p in want))[:3]


def test_few_voted_categories(spark):
    """The third voted category comes far below the depth, and a catalog has fewer than three."""
    for kinds in (2, 5):
        idx = catalog(spark, 80, kinds=kinds, most=2)
        stats = idx.poi_stats.withColumn("category", F.when(F.col("poi_id") < "p00075", "k00").otherwise(F.col("category")))
        rare = Index("synthetic", stats.cache(), idx.time_counts, idx.category_counts, idx.transition_counts)
        asked = requests(spark, 80, 12, kinds=kinds)
        voted = {r["poi_id"]: r["category"] for r in stats.collect()}
        rows = scoring.score_requests(asked, rare, ["b3", "b1"], depth=4).cache()
        for variant in ("b3", "b1"):
            macro = {}
            for r in scoring.macro_categories(rows.filter(F.col("variant") == variant)).orderBy("rank").collect():
                macro.setdefault(r["sample_id"], []).append(r["category"])
            for sample, want in dense(asked, rare, variant).items():
                assert macro[sample] == list(dict.fromkeys(voted[p] for _, p in want))[:3]


def test_pool_does_not_grow_with_the_catalog(spark):
    """Ten times the places, all with several categories: as many rows for each request; far fewer targets of a hub."""
    depth, most, kept = 10, {}, {}
    for n in (300, 3000):
        idx = catalog(spark, n, hub=n)
        lists = serving.build_lists(idx, depth)
        facts = scoring.request_facts(requests(spark, n, 40, known=False))
        pool = scoring.candidate_pool(facts, lists, ["b3"]).groupBy("sample_id").count()
        most[n] = pool.agg(F.max("count")).first()[0]
        hub = scoring.request_facts(requests(spark, n, 10, known=False, latest="p00000"))
        kept[n] = scoring.candidate_pool(hub, lists, ["b3"]).groupBy("sample_id").count().agg(F.max("count")).first()[0]
    assert most[3000] <= depth + serving.HEADS + 1 and most[300] <= depth + serving.HEADS + 1  # one is the history's place
    assert kept[3000] < 600  # of 3,000 targets


def test_blocks_are_of_bounded_size(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").cast("string").alias("poi_id"), F.when(F.col("id") < 19_000, 1.0).otherwise(F.col("id") / 1000).alias("b"))
    blocks = serving.in_blocks(rows, ["k"], F.col("b"), "poi_id", F.col("poi_id")).select("bound", F.size("entries").alias("n"), F.array_max("entries").alias("x")).collect()
    assert sum(r["n"] for r in blocks) == 20_000 and max(r["n"] for r in blocks) < 2 * serving.BLOCK


def moved_scans(plan, name):
    """Scans of name's tables in the lines of a plan, with whether an Exchange lies between each and the first join above it."""
    lines = [(len(line) - len(line.lstrip(" :+-|")), line.strip(" :+-|")) for line in plan.splitlines() if line.strip()]
    out = []
    for i, (depth, text) in enumerate(lines):
        table = text.partition(f"spark_catalog.default.{name}_")[2].partition("[")[0]
        if not table:
            continue
        at, moved = depth, False
        for d, t in reversed(lines[:i]):
            if d < at:
                at = d
                if "Join" in t:
                    break
                moved |= "Exchange" in t and "Broadcast" not in t
        out.append((table, moved))
    return out


def test_saved_lists_are_joined_where_they_lie(spark):
    idx, asked, name = catalog(spark, 200), requests(spark, 200, 15), "lists_v1"
    lists = serving.build_lists(idx, 10)
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        serving_tables.save_lists(lists, name)
        with pytest.raises(ValueError, match="exist"):
            serving_tables.save_lists(lists, name)
        for c, v in zip(before, ("-1", "false")):
            spark.conf.set(c, v)
        loaded = serving_tables.load_lists(spark, name)
        facts = scoring.request_facts(asked).withColumn("recent", F.sort_array("recent"))
        best = serving.best_places(facts.select("bucket", "recent").distinct(), loaded, {(True, True)})
        rows = scoring.score_requests(asked, idx, ["b3"], lists=loaded)
        scans = moved_scans(best._jdf.queryExecution().executedPlan().toString(), name) + moved_scans(rows._jdf.queryExecution().executedPlan().toString(), name)
        assert {t for t, _ in scans} >= {"singles", "first", "several", "targets", "places"} and not any(moved for t, moved in scans if t in serving_tables.KEYS)
        top = lambda df: sorted(map(tuple, scoring.ranked(df, 10).select("sample_id", "rank", "poi_id").collect()))
        got = top(rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
        for t in ("lists", *lists.tables()):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")
    assert got == top(scoring.score_requests(asked, idx, ["b3"], depth=10))
    with pytest.raises(ValueError, match="no complete"):
        serving_tables.load_lists(spark, name)
