"""Streams: scoring of arriving requests and drift of arriving windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.functions.contracts import check_recommendations, enforce, request_rules
from wayfare.operators.index import Index
from wayfare.operators.monitoring import distributions, drift_of_shares
from wayfare.operators.scoring import TRACE, recommendations, score_requests
from wayfare.operators.serving import Lists, build_lists
from wayfare.session import written_once
from wayfare.sources.monitoring_log import parse_events


def score_stream(requests: DataFrame, index: Index, variants: list[str], output: str, checkpoint: str, trigger: dict | None = None, lists: Lists | None = None) -> StreamingQuery:
    """Appends the recommendations of each arriving batch to output, under its batch id: a batch that is run again after a
    failure replaces its own files. Requests that break the contract go to output/rejected. trigger is the one of writeStream; by
    default what is there is worked off and the query ends. lists are those of load_lists(): bucketed tables that no batch moves; by
    default they are built once and held by the executors."""
    lists = lists or build_lists(index.kept(), TRACE).kept()

    def batch(df: DataFrame, batch_id: int) -> None:
        valid, invalid = enforce(df, request_rules(), "quarantine")
        path = f"{output}/recommendations/batch={batch_id}"
        recommendations(score_requests(valid, index, variants, lists=lists)).write.mode("overwrite").parquet(path)
        check_recommendations(df.sparkSession.read.parquet(path))
        invalid.select("sample_id", "violations").write.mode("overwrite").parquet(f"{output}/rejected/batch={batch_id}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drift_stream(lines: DataFrame, reference: DataFrame, output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Drift of each arriving batch of monitoring lines against a fixed window; the batch is the window. The reference is summed
    once: a few shares for each dimension."""
    fixed = written_once(distributions(reference))
    if fixed.isEmpty():
        raise ValueError("the reference window is empty")

    def batch(df: DataFrame, batch_id: int) -> None:
        events, _ = parse_events(df.select("value"), "quarantine")
        if not events.isEmpty():
            drift_of_shares(fixed, distributions(events)).withColumn("window", F.lit(batch_id)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
