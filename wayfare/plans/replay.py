"""The replay job: drift between two windows of monitoring events."""

from __future__ import annotations

import argparse

from wayfare.operators.monitoring import JS_LIMIT, PSI_LIMIT, compare_distributions, inject_drift, numeric_summaries, overall_alert, replay
from wayfare.session import get_session
from wayfare.sources.monitoring_log import read_events


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Compare two windows of monitoring events.")
    for name in ("reference", "current", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--js-threshold", type=float, default=JS_LIMIT)
    p.add_argument("--psi-threshold", type=float, default=PSI_LIMIT)
    p.add_argument("--inject-drift", action="store_true")
    a = p.parse_args(args)
    spark = get_session("replay")
    reference, current = read_events(spark, a.reference), read_events(spark, a.current)
    rows = replay(reference, current, a.inject_drift, a.js_threshold, a.psi_threshold)
    rows.write.mode("errorifexists").parquet(f"{a.output}/drift")
    compare_distributions(reference, inject_drift(current) if a.inject_drift else current).write.parquet(f"{a.output}/distributions")
    numeric_summaries(current).write.parquet(f"{a.output}/numbers")
    overall_alert(spark.read.parquet(f"{a.output}/drift")).show(truncate=False)


if __name__ == "__main__":
    main()
