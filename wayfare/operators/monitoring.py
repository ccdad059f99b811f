"""Monitoring events of scored requests, and drift between two windows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.scalars import (
    HISTORY_BUCKETS,
    candidate_count_bucket,
    category_key,
    monitoring_history_bucket,
    request_id,
    small_count_bucket,
    softmax_entropy,
)
from wayfare.operators.index import Index
from wayfare.operators.percentiles import with_percentiles
from wayfare.operators.scoring import TRACE, VARIANTS, ranked
from wayfare.operators.serving import WEIGHTS, is_whole
from wayfare.schemas import MONITORING_FIELDS
from wayfare.session import evaluated, written_once

# Alert thresholds and the floor of a share in PSI.
JS_LIMIT, PSI_LIMIT, PSI_FLOOR = 0.10, 0.20, 1e-6
#: Names that are tried for a category that no event has.
FRESH_KEYS = 1000


def unknown_history(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """sample_id, unknown_count: visits of the history, each counted, whose place isn't in the catalog."""
    visits = requests.select("sample_id", F.explode("history.poi_id").alias("poi_id"))
    unknown = visits.join(catalog.select("poi_id"), "poi_id", "left_anti").groupBy("sample_id").agg(F.count("*").alias("unknown_count"))
    return requests.select("sample_id").distinct().join(unknown, "sample_id", "left").fillna(0, ["unknown_count"])


def events_of(requests: DataFrame, rows: DataFrame, index: Index, versions: tuple[str, str, str], latency_ms: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """A monitoring event for each request and variant of scored rows. Latency is a column of the caller's log, or 0. Columns
    of the requests that are named as extra stay beside the event."""
    keys = ["variant", "sample_id"]
    # one grouping of the ranked rows, dealt by sample like the ranking itself
    lists = ranked(rows, TRACE).groupBy(*keys).agg(
        F.flatten(F.collect_list("candidate_sources")).alias("sources"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= F.col("top_k"), F.struct("rank", "score", category_key(F.col("category")).alias("kind"))))).alias("top"),
    )
    histogram = lambda c: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(c)), lambda k: F.struct(k, F.size(F.filter(c, lambda x: x == k)).cast("long"))))
    counted = lists.select(
        *keys, histogram(F.col("sources")).alias("candidate_source_histogram"), histogram(F.transform("top", lambda x: x["kind"])).alias("category_histogram"),
        softmax_entropy(F.transform("top", lambda x: x["score"])).alias("score_entropy"),
    )
    size = index.poi_stats.agg(F.count("*").alias("candidate_count"))
    facts = requests.select("sample_id", *extra, F.size("history").alias("h"), request_digest().alias("digest"))
    joined = counted.join(facts, "sample_id").join(unknown_history(requests, index.poi_stats), "sample_id").join(F.broadcast(size), F.lit(True))
    return _formed(joined, versions, latency_ms, extra)


def _formed(joined: DataFrame, versions: tuple[str, str, str], latency_ms: Column | None, extra: tuple[str, ...]) -> DataFrame:
    latency = latency_ms if latency_ms is not None else F.lit(0.0)
    version = F.struct(*(F.lit(v).alias(n) for n, v in zip(("release", "data", "model"), versions)))
    return joined.select(
        request_id(F.col("digest"), F.col("variant")).alias("request_id"), version.alias("versions"), monitoring_history_bucket(F.col("h")).alias("history_length_bucket"),
        "unknown_count", "candidate_count", "candidate_source_histogram", "category_histogram", "score_entropy",
        F.create_map(F.lit("total"), latency).alias("stage_latency_ms"), latency.alias("total_latency_ms"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_code"), *extra,
    ).select(*MONITORING_FIELDS, *extra)


def request_digest() -> Column:
    return F.sha2(F.to_json(F.struct("dataset", "history", "target_time", "top_k")), 256)


def events_of_lists(lists: DataFrame, index: Index, versions: tuple[str, str, str], latency_ms: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """events_of() of scored_lists() that have history_size, digest (request_digest of the request), visited (the places of its
    history) and extra beside them. Against a catalog of at most serving.WHOLE places nothing is dealt."""
    size = index.poi_stats.agg(F.count("*").alias("candidate_count"))
    if is_whole(index):
        known = index.poi_stats.agg(F.count("*").alias("candidate_count"), F.collect_set("poi_id").alias("known"))
        joined = lists.join(F.broadcast(known), F.lit(True))
        joined = joined.withColumn("unknown_count", F.size(F.filter("visited", lambda p: ~F.coalesce(F.array_contains("known", p), F.lit(False)))).cast("long")).drop("known")
    else:
        requests = lists.select("sample_id", F.transform("visited", lambda p: F.struct(p.alias("poi_id"))).alias("history"))
        joined = lists.join(unknown_history(requests, index.poi_stats), "sample_id").join(F.broadcast(size), F.lit(True))
    top = evaluated(joined, trace=F.transform(F.slice("best", 1, TRACE), lambda e: e["gives"]), top=F.slice("best", 1, F.col("top_k")))
    # a signal is a source only in the variants that have it; popularity always is one
    order, in_variant = list(WEIGHTS), lambda s: F.col("variant").isin(*(v for v, names in VARIANTS.items() if s in names))
    count = lambda s: F.when(in_variant(s), F.size(F.filter("trace", lambda g: g.bitwiseAND(F.lit(1 << order.index(s))) > 0))).otherwise(0).cast("long")
    sources = F.filter(F.array(*(F.struct(F.lit(s).alias("key"), count(s).alias("n")) for s in sorted(WEIGHTS))), lambda x: x["n"] > 0)
    kinds = evaluated(top, kinds=F.transform("top", lambda e: e["category"]))
    # each category is hashed once
    of_kind = F.transform(F.array_distinct("kinds"), lambda k: F.struct(category_key(k).alias("key"), F.size(F.filter("kinds", lambda x: x.eqNullSafe(k))).cast("long").alias("n")))
    counted = kinds.withColumn("candidate_source_histogram", F.map_from_entries(sources)).withColumn("category_histogram", F.map_from_entries(F.array_sort(of_kind)))
    scored = evaluated(counted, scores=F.transform("top", lambda e: e["score"])).withColumn("score_entropy", softmax_entropy(F.col("scores"))).withColumnRenamed("history_size", "h")
    return _formed(scored, versions, latency_ms, extra)


def distributions(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """dimension, key, weight, share: the six distributions of a window (or of each window of by). Keys of weight 0 stay."""
    one = lambda d, key: F.struct(F.lit(d).alias("dimension"), key.alias("key"), F.lit(1).cast("long").alias("weight"))
    of_map = lambda d, m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,bigint>"))), lambda e: F.struct(F.lit(d).alias("dimension"), e["key"].alias("key"), e["value"].alias("weight")))
    plain = F.array(
        one("history_length", F.col("history_length_bucket")), one("unknown_count", small_count_bucket(F.col("unknown_count"))),
        one("candidate_count", candidate_count_bucket(F.col("candidate_count"))), one("status", F.col("status")),
    )
    rows = events.select(*by, F.explode(F.concat(plain, of_map("candidate_source", "candidate_source_histogram"), of_map("category", "category_histogram"))).alias("r")).select(*by, "r.*")
    sums = rows.groupBy(*by, "dimension", "key").agg(F.sum("weight").alias("weight"))
    whole = F.sum("weight").over(Window.partitionBy(*by, "dimension"))
    return sums.withColumn("share", F.coalesce(F.try_divide(F.col("weight").cast("double"), whole.cast("double")), F.lit(0.0)))


def _both(reference: DataFrame, current: DataFrame) -> DataFrame:
    return reference.select(*MONITORING_FIELDS, F.lit("reference").alias("window")).unionByName(current.select(*MONITORING_FIELDS, F.lit("current").alias("window")))


def _compared(shares: DataFrame, by: str, reference: str, current: str) -> DataFrame:
    of = lambda name: F.coalesce(F.max(F.when(F.col(by) == name, F.col("share"))), F.lit(0.0))
    return shares.groupBy("dimension", "key").agg(of(reference).alias("ref"), of(current).alias("cur"))


def compare_distributions(reference: DataFrame, current: DataFrame) -> DataFrame:
    """dimension, key, ref, cur over the keys of both windows."""
    return _compared(distributions(_both(reference, current), ("window",)), "window", "reference", "current")


def drift(reference: DataFrame, current: DataFrame, js_limit: float = JS_LIMIT, psi_limit: float = PSI_LIMIT) -> DataFrame:
    """dimension, js, psi, alert. Jensen-Shannon divergence (natural logarithm) and population stability index."""
    return drift_between(_both(reference, current), "window", "reference", "current", js_limit, psi_limit)


def drift_between(events: DataFrame, by: str, reference: str, current: str, js_limit: float = JS_LIMIT, psi_limit: float = PSI_LIMIT) -> DataFrame:
    """drift of two windows of one table, which its column by tells apart: events are read once."""
    shares = written_once(distributions(events.filter(F.col(by).isin(reference, current)), (by,)))  # a row for each key of a window
    found = {r[by] for r in shares.select(by).distinct().collect()}
    for name in (reference, current):
        if name not in found:
            raise ValueError(f"the {name} window is empty")
    return _judged(_compared(shares, by, reference, current), js_limit, psi_limit)


def drift_of_shares(reference: DataFrame, current: DataFrame, js_limit: float = JS_LIMIT, psi_limit: float = PSI_LIMIT) -> DataFrame:
    """drift of two windows of which the distributions are known."""
    columns = ["dimension", "key", "share"]
    both = reference.select(*columns, F.lit("reference").alias("window")).unionAll(current.select(*columns, F.lit("current").alias("window")))
    return _judged(_compared(both, "window", "reference", "current"), js_limit, psi_limit)


def _judged(compared: DataFrame, js_limit: float, psi_limit: float) -> DataFrame:
    ref, cur = F.col("ref"), F.col("cur")
    mid = (ref + cur) / 2
    part = lambda p: F.when(p > 0, p / 2 * F.ln(p / F.nullif(mid, F.lit(0.0)))).otherwise(0.0)
    floor = lambda p: F.greatest(p, F.lit(PSI_FLOOR))
    psi = (floor(cur) - floor(ref)) * F.ln(floor(cur) / floor(ref))
    sums = compared.groupBy("dimension").agg(F.greatest(F.lit(0.0), F.sum(part(ref) + part(cur))).alias("js"), F.sum(psi).alias("psi"))
    return sums.withColumn("alert", (F.col("js") > js_limit) | (F.col("psi") > psi_limit))


def overall_alert(drift_rows: DataFrame) -> DataFrame:
    return drift_rows.agg(F.coalesce(F.bool_or("alert"), F.lit(False)).alias("alert"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("alert"), F.col("dimension")))), ",").alias("dimensions"))


def numeric_summaries(events: DataFrame) -> DataFrame:
    """name, count, mean, min, max, p50, p95 (interpolated) of the numbers of a window."""
    plain = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in ("unknown_count", "candidate_count", "score_entropy", "total_latency_ms")))
    stages = F.transform(F.map_entries("stage_latency_ms"), lambda e: F.struct(F.concat(F.lit("stage_latency_ms."), e["key"]).alias("name"), e["value"].alias("x")))
    # a row for each number, read by the percentiles and the sums: events are read once
    rows = written_once(events.select(F.explode(F.concat(plain, stages)).alias("r")).select("r.*").filter(F.col("x").isNotNull()))
    found = with_percentiles(rows, ["name"], "x", {"p50": 0.5, "p95": 0.95}, F.count("*").alias("count"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    return found.select("name", "count", "mean", "min", "max", "p50", "p95")


def inject_drift(events: DataFrame) -> DataFrame:
    """The window with two planted drifts: the most frequent history bucket (ties: the lower one) becomes the last bucket that
    isn't it, and each category histogram becomes one key that no event has, with its weight (1 at least)."""
    top = events.groupBy("history_length_bucket").count().withColumn("place", F.array_position(F.array(*map(F.lit, HISTORY_BUCKETS)), F.col("history_length_bucket")))
    row = top.orderBy(F.desc("count"), "place").first()
    if row is None:
        return events
    longest, second = HISTORY_BUCKETS[-1], HISTORY_BUCKETS[-2]
    goal = second if row["history_length_bucket"] == longest else longest
    used = events.select(F.explode(F.map_keys("category_histogram")).alias("k")).filter(F.col("k").startswith("category_"))
    names = F.concat(F.array(F.lit("injected-drift")), F.transform(F.sequence(F.lit(1), F.lit(FRESH_KEYS)), lambda i: F.concat(F.lit("injected-drift-"), i.cast("string"))))
    fresh = events.sparkSession.range(1).select(F.posexplode(names).alias("attempt", "name")).select("attempt", category_key(F.col("name")).alias("k"))
    key = fresh.join(used.distinct(), "k", "left_anti").orderBy("attempt").first()["k"]
    total = F.aggregate(F.map_values("category_histogram"), F.lit(0).cast("long"), lambda a, x: a + x)
    bucket = F.when(F.col("history_length_bucket") == row["history_length_bucket"], goal).otherwise(F.col("history_length_bucket"))
    return events.withColumn("history_length_bucket", bucket).withColumn("category_histogram", F.create_map(F.lit(key), F.greatest(F.lit(1).cast("long"), total)))


def replay(reference: DataFrame, current: DataFrame, inject: bool = False, js_limit: float = JS_LIMIT, psi_limit: float = PSI_LIMIT) -> DataFrame:
    return drift(reference, inject_drift(current) if inject else current, js_limit, psi_limit)
