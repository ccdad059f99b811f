"""A catalog that is its own pool: requests are scored, judged and monitored where they are, with the rows' results."""

import pytest
from pyspark.sql import functions as F

from tests.test_serving import catalog, requests
from wayfare.operators import metrics, monitoring, scoring
from wayfare.plans.queries import QUERIES


def rows_of(df):
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    return sorted(map(repr, df.select(*rounded).collect()))


def test_equals_rows(spark):
    idx, asked, variants = catalog(spark, 30), requests(spark, 40, 25), list(scoring.VARIANTS)
    labels = F.lit("p00003").alias("target_poi_id"), F.lit("k03").alias("target_category")
    rows = scoring.score_requests(asked, idx, variants).cache()
    beside = {"history_size": F.size("history"), "digest": monitoring.request_digest(), "visited": F.col("history.poi_id")}
    lists = scoring.scored_lists(asked.select("*", *(c.alias(n) for n, c in beside.items()), *labels), idx, variants, beside=(*beside, "target_poi_id", "target_category", "target_time")).cache()
    top = ["variant", "sample_id", "rank", "poi_id", "model_poi_id", "category", "score", "candidate_sources"]
    assert rows_of(scoring.recommended(lists).select(*top)) == rows_of(scoring.recommendations(rows).select(*top))
    old, new = metrics.observations(rows, asked.select("*", *labels), idx).cache(), metrics.observed(lists, idx).cache()
    assert rows_of(new) == rows_of(old)
    for slices in (False, True):
        few = idx.poi_stats.filter("poi_id < 'p00020'")
        want = metrics.summarise(old, few, slices)
        assert rows_of(metrics.summarise_once(new, few, slices).select(*want.columns)) == rows_of(want)
    events = [f(x) for f, x in ((lambda r: monitoring.events_of(asked, r, idx, ("r", "d", "m")), rows), (lambda r: monitoring.events_of_lists(r, idx, ("r", "d", "m")), lists))]
    assert rows_of(events[1]) == rows_of(events[0])


@pytest.mark.parametrize("name", ["g1_rank_b0", "d12_d27_variant_matrix", "d14_slices", "e8_macro_categories", "g10_batch_scoring"])
def test_no_row_of_a_request_and_a_place_is_dealt(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" not in plan


@pytest.mark.parametrize("name", ["g2_rank_b1", "g3_rank_b2", "g5_rank_b3_no_time", "g6_rank_b3_no_transition", "g7_rank_b3_no_history", "d13_validity", "d16_distributions", "d17_numeric_summaries"])
def test_nor_in_the_queries_that_share_the_step(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" not in plan


def test_a_request_meets_only_what_its_variant_counts(spark):
    plan = QUERIES["g1_rank_b0"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "AS moves#" not in plan and "array_position(back" not in plan


def test_many_categories_equal_few(spark, monkeypatch):
    idx, asked = catalog(spark, 30), requests(spark, 12, 25)
    few = rows_of(scoring.scored_lists(asked, idx, ["b3", "b3_no_time"]))
    monkeypatch.setattr(scoring, "CATEGORIES", 0)
    assert rows_of(scoring.scored_lists(asked, idx, ["b3", "b3_no_time"])) == few
