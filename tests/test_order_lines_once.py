"""Encoders read the joined order lines several times: lines, orders and parts are read and joined once."""

import pytest

from wayfare.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c1_e5_encode", "d26_id_check"])
def test_tables_are_read_once(spark, name):
    spark.catalog.clearCache()
    sc = spark.sparkContext
    want = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("lineitem", "orders", "part"))
    sc.setJobGroup(f"once_{name}", name)
    try:
        QUERIES[name](spark, SF).collect()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        store, jobs = sc._jsc.sc().statusStore(), sc.statusTracker().getJobIdsForGroup(f"once_{name}")
        stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
        read = sum(store.lastStageAttempt(s).inputRecords() for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # the held rows count as a few batches
    assert want <= read < 1.1 * want
