"""Rankings of a large catalog in stored steps: lines are joined once, shuffle files and tables go when they have been read."""

import pytest
from pyspark.sql import functions as F

from tests.test_serving import catalog, requests
from wayfare import session
from wayfare.functions import scalars
from wayfare.operators import scoring, serving
from wayfare.operators.index import Index
from wayfare.plans.queries import QUERIES
from wayfare.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    return tmp_path


def shuffled_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle"))


def test_stored_leaves_no_shuffle_files(spark, folder):
    before = shuffled_bytes(spark)
    assert stored(spark.range(200_000).repartition(8, "id")).count() == 200_000
    assert shuffled_bytes(spark) <= before + 10_000  # the count's own


@pytest.mark.parametrize("name", ["g4_rank_b3_places", "g4_rank_b3_several"])
def test_last_step_reads_stored_tables_only(spark, folder, monkeypatch, name):
    whole = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    before = set(folder.iterdir())
    monkeypatch.setattr(serving, "WHOLE", 0)
    top = QUERIES[name](spark, SF)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "InMemoryRelation" not in plan
    # the counts of the index, requests, profiles, visited places and targets that reach a floor
    assert len(set(folder.iterdir()) - before) == 5
    assert sorted(map(tuple, top.collect())) == whole


def test_same_where_no_folder_is_named(spark, folder, monkeypatch):
    monkeypatch.setattr(serving, "WHOLE", 0)
    idx, asked = catalog(spark, 60), requests(spark, 60, 12)
    want = sorted(map(str, scoring.scored_lists(asked, idx, ["b3"], 10).selectExpr("sample_id", "slice(best, 1, 10)").collect()))
    monkeypatch.setattr(session, "shared_folder", lambda _: None)
    assert sorted(map(str, scoring.scored_lists(asked, idx, ["b3"], 10).selectExpr("sample_id", "slice(best, 1, 10)").collect())) == want


def test_rounded_equals_round(spark):
    x = F.col("x")
    of = lambda x: [scalars.rounded(x, d).eqNullSafe(F.round(x, d)) for d in (6, 12)]
    some = spark.range(300_000).select(F.explode(F.array(F.rand(1) * 220, F.col("id") / 2_000_000, F.col("id") / 128, F.log1p("id") * 1.25, F.log1p("id") + 0.75 * F.log1p(F.col("id") % 97))).alias("x"))
    assert some.filter(~(of(x)[0] & of(x)[1])).isEmpty()


def test_without_heads_fewer_places_come_back(spark, folder, monkeypatch):
    """The best depth are the same; a floor that only a third category's first place sets isn't asked for."""
    monkeypatch.setattr(serving, "WHOLE", 0)
    idx, asked = catalog(spark, 80, kinds=5, most=2), requests(spark, 80, 12, kinds=5)
    stats = idx.poi_stats.withColumn("category", F.when(F.col("poi_id") < "p00075", "k00").otherwise(F.col("category")))
    rare = Index("synthetic", stats.cache(), idx.time_counts, idx.category_counts, idx.transition_counts)
    with_heads, without = ({r["sample_id"]: r["best"] for r in scoring.scored_lists(asked, rare, ["b3"], 4, heads=h).collect()} for h in (True, False))
    assert all(without[k][:4] == best[:4] for k, best in with_heads.items())
    assert sum(map(len, without.values())) < sum(map(len, with_heads.values()))
