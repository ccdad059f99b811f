"""A catalog that is larger than its pools: what a request gives meets the places in narrow rows, the rest comes with its profile."""

import pytest
from pyspark.sql import functions as F

from tests.test_library import dense
from tests.test_serving import catalog, lists_for_small_catalogs, requests  # noqa: F401
from wayfare.operators import scoring, serving
from wayfare.plans.queries import QUERIES


@pytest.mark.parametrize(("most", "hub", "block"), [(1, 0, 256), (2, 0, 256), (4, 250, 4)])
def test_equals_scores_of_every_place(spark, monkeypatch, most, hub, block):
    monkeypatch.setattr(serving, "BLOCK", block)
    idx = catalog(spark, 300, most=most, hub=hub)
    asked = requests(spark, 300, 25, latest="p00000" if hub else None)
    voted = {r["poi_id"]: r["category"] for r in idx.poi_stats.collect()}
    for variants in (list(scoring.VARIANTS), ["b3"], ["b1"]):
        lists = {(r["variant"], r["sample_id"]): r["best"] for r in scoring.scored_lists(asked, idx, variants, depth=12).collect()}
        for variant in variants:
            for sample, want in dense(asked, idx, variant).items():
                best = lists[variant, sample]
                assert [(-round(e["score"], 9), e["poi_id"]) for e in best[:12]] == want[:12]
                assert list(dict.fromkeys(e["category"] for e in best))[:3] == list(dict.fromkeys(voted[p] for _, p in want))[:3]


def test_places_of_two_categories_need_no_blocks(spark):
    """Their lists hold a bounded number of entries for each set of categories, whatever the catalog."""
    most = {}
    for n in (300, 3000):
        lists = serving.build_lists(catalog(spark, n, kinds=4, most=2), 10)
        assert lists.several is None and lists.first is None
        most[n] = lists.pairs.agg(F.max(F.size("entries"))).first()[0]
    assert most[3000] <= 10 + serving.HEADS and most[300] <= 10 + serving.HEADS


@pytest.mark.parametrize("name", ["g4_rank_b3_places", "g4_rank_b3_several"])
def test_pool_is_not_dealt(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" not in plan and "hashpartitioning(variant" not in plan
