"""Ranking metrics, slices, failures and latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.scalars import day_type, evaluation_history_bucket, rarity
from wayfare.operators.index import Index
from wayfare.operators.percentiles import with_percentiles
from wayfare.operators.scoring import SCORE_DIGITS, TRACE, candidate_sources, first_categories
from wayfare.operators.serving import is_whole
from wayfare.session import evaluated

#: Categories of a sample that are judged.
MACRO = 3
SLICES = ["history_length", "target_rarity", "day_type"]


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.when(rank >= 1, F.lit(1.0) / rank).otherwise(0.0)


def gain(rank: Column, k: int) -> Column:
    return F.when(rank <= k, F.lit(1.0) / F.log2(rank + F.lit(1.0))).otherwise(0.0)


def array_rank(values: Column, wanted: Column) -> Column:
    """Place of the first match in an array; null if absent, or if what is wanted is null or blank."""
    return F.when(F.coalesce(wanted, F.lit("")) != "", F.nullif(F.array_position(values, wanted), F.lit(0)))


def _metrics() -> dict[str, Column]:
    """name -> mean of what, over samples. top: rank among the top_k, trace: in the trace, macro: of the category."""
    top, trace, macro = F.col("top_rank"), F.col("trace_rank"), F.col("macro_rank")
    return {
        **{f"hit_at_{k}": hit(top, k) for k in (1, 5, 10)}, "mrr": reciprocal(top), **{f"ndcg_at_{k}": gain(top, k) for k in (5, 10)},
        **{f"candidate_recall_at_{k}": hit(trace, k) for k in (50, 100)}, **{f"macro_hit_at_{k}": hit(macro, k) for k in (1, 3)}, "macro_mrr": reciprocal(macro),
    }


def observations(rows: DataFrame, examples: DataFrame, index: Index) -> DataFrame:
    """variant, sample_id, ranks of the target, predictions, target_sources, and the slice keys. Labels are joined by
    sample_id after all scoring is done; of the ranked rows only the top_k, the target and the first place of each category are
    pulled together."""
    counts = index.poi_stats.select(F.col("poi_id").alias("target_poi_id"), F.col("n").alias("train_count"))
    labels = examples.select("sample_id", "target_poi_id", "target_category", F.size("history").alias("history_size"), "target_time")
    order = Window.partitionBy("variant", "sample_id").orderBy(F.round("score", SCORE_DIGITS).desc(), "poi_id")
    all_ranked = rows.withColumn("rank", F.row_number().over(order)).join(labels.select("sample_id", "target_poi_id"), "sample_id")
    of_kind = all_ranked.groupBy("variant", "sample_id", "category").agg(
        F.min("rank").alias("first"),
        F.collect_list(F.when(F.col("rank") <= F.col("top_k"), F.struct("rank", "poi_id"))).alias("top"),
        F.min(F.when((F.col("rank") <= TRACE) & (F.col("poi_id") == F.col("target_poi_id")), F.struct("rank", "gives"))).alias("target"),
    )
    lists = of_kind.groupBy("variant", "sample_id").agg(
        F.transform(F.array_sort(F.flatten(F.collect_list("top"))), lambda x: x["poi_id"]).alias("predictions"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("first", "category"))), 1, MACRO), lambda x: x["category"]).alias("macro"),
        F.min("target").alias("target"),
    )
    return _judged(lists.join(labels.join(counts, "target_poi_id", "left"), "sample_id"))


def _judged(joined: DataFrame) -> DataFrame:
    wanted = F.coalesce("target_poi_id", F.lit("")) != ""
    return joined.select(
        "variant", "sample_id", "target_poi_id", "target_category", "predictions", "macro",
        array_rank(F.col("predictions"), F.col("target_poi_id")).alias("top_rank"),
        F.when(wanted, F.col("target.rank")).cast("long").alias("trace_rank"),
        array_rank(F.col("macro"), F.col("target_category")).alias("macro_rank"),
        candidate_sources(F.col("variant"), F.coalesce("target.gives", F.lit(0))).alias("target_sources"),
        evaluation_history_bucket(F.col("history_size")).alias("history_length"), rarity(F.col("train_count")).alias("target_rarity"), day_type(F.col("target_time")).alias("day_type"),
    )


#: Columns of the examples that observed() reads beside the lists.
LABELS = ("target_poi_id", "target_category", "target_time", "history_size")


def observed(lists: DataFrame, index: Index) -> DataFrame:
    """observations() of scored_lists() that have LABELS beside them: nothing is dealt, but where the catalog is too large to be
    sent to all tasks the training counts of the targets are."""
    counts = index.poi_stats.select(F.col("poi_id").alias("target_poi_id"), F.col("n").alias("train_count"))
    known = lists.join(F.broadcast(counts) if is_whole(index) else counts, "target_poi_id", "left")
    ids = evaluated(known, pois=F.transform("best", lambda e: e["poi_id"]), macro=first_categories(F.col("best"), MACRO))
    at = evaluated(ids, at=F.nullif(F.array_position(F.slice("pois", 1, TRACE), F.col("target_poi_id")), F.lit(0).cast("long")).cast("int"))
    found = F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("rank"), F.get("best", F.col("at") - 1)["gives"].alias("gives")))
    return _judged(evaluated(at, predictions=F.slice("pois", 1, F.col("top_k")), target=found))


def with_validity(obs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds n_predicted, n_invalid (not in the catalog) and n_duplicate of the predictions."""
    items = obs.select("variant", "sample_id", F.explode("predictions").alias("poi_id"))
    bad = items.join(catalog.select("poi_id"), "poi_id", "left_anti").groupBy("variant", "sample_id").agg(F.count("*").alias("n_invalid"))
    joined = obs.join(bad, ["variant", "sample_id"], "left").fillna(0, ["n_invalid"])
    return joined.withColumn("n_predicted", F.size("predictions")).withColumn("n_duplicate", F.col("n_predicted") - F.size(F.array_distinct("predictions")))


def summarise(obs: DataFrame, catalog: DataFrame, slices: bool = False) -> DataFrame:
    """A row for each variant, or with slices for each variant, dimension and value: means over samples, rates over predicted
    items, and the share of the catalog that is predicted. Observations are read three times: keep them (written, or cached) before."""
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in SLICES)) if slices else F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    v = with_validity(obs, catalog)
    wide = v.withColumn("slice", F.explode(dims)).select("slice.dimension", "slice.value", *v.columns)
    keys = ["variant", "dimension", "value"]
    share = lambda part, whole: F.coalesce(F.try_divide(F.sum(part).cast("double"), F.sum(whole).cast("double")), F.lit(0.0))
    valid = (F.col("n_predicted") > 0) & (F.col("n_invalid") == 0) & (F.col("n_duplicate") == 0)
    means = wide.groupBy(*keys).agg(
        F.count("*").alias("samples"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for n, c in _metrics().items()),
        F.avg(valid.cast("double")).alias("validity_rate"), F.avg((F.col("n_predicted") == 0).cast("double")).alias("empty_rate"),
        share("n_invalid", "n_predicted").alias("invalid_rate"), share("n_duplicate", "n_predicted").alias("duplicate_rate"),
    )
    predicted = wide.select(*keys, F.explode("predictions").alias("poi_id")).distinct().join(catalog.select("poi_id"), "poi_id").groupBy(*keys).agg(F.count("*").alias("covered"))
    size = catalog.agg(F.count("*").alias("catalog_size"))
    out = means.join(predicted, keys, "left").join(F.broadcast(size), F.lit(True))
    return out.withColumn("coverage", F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("catalog_size").cast("double")), F.lit(0.0))).drop("covered", "catalog_size")


def summarise_once(obs: DataFrame, catalog: DataFrame, slices: bool = False) -> DataFrame:
    """summarise() against a catalog of at most WHOLE places, which all tasks have as one array: observations are read once and not
    kept. Rows are grouped by predicted place too; those of no place carry the sums of the samples."""
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in SLICES)) if slices else F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    met = obs.join(F.broadcast(catalog.agg(F.collect_set("poi_id").alias("known"), F.count("*").alias("catalog_size"))), F.lit(True))
    met = evaluated(met, covers=F.filter("predictions", lambda p: F.coalesce(F.array_contains("known", p), F.lit(False))))
    n = F.size("predictions")
    met = evaluated(met, n_predicted=n, n_invalid=n - F.size("covers"), n_duplicate=n - F.size(F.array_distinct("predictions")))
    valid = (F.col("n_predicted") > 0) & (F.col("n_invalid") == 0) & (F.col("n_duplicate") == 0)
    means = {**_metrics(), "validity_rate": valid.cast("double"), "empty_rate": (F.col("n_predicted") == 0).cast("double")}
    counts = ["n_predicted", "n_invalid", "n_duplicate"]
    facts = F.struct(*(c.alias(name) for name, c in means.items()), *counts)
    keys = ["variant", "dimension", "value"]
    met = evaluated(met, x=facts, covers=F.array_distinct("covers"), dims=dims).select("variant", "catalog_size", F.explode("dims").alias("slice"), "covers", "x")
    places = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("covers"))).alias("poi_id")
    rows = met.select("variant", "catalog_size", "slice.dimension", "slice.value", "x", places).select("variant", "catalog_size", "dimension", "value", "poi_id", "x.*")
    names = [*means, *counts]
    by_place = rows.groupBy(*keys, "catalog_size", "poi_id").agg(F.count("*").alias("m"), *(F.sum(c).alias(c) for c in names))
    of_samples = lambda c: F.max(F.when(F.col("poi_id").isNull(), F.col(c)))
    sums = by_place.groupBy(*keys, "catalog_size").agg(of_samples("m").alias("samples"), F.count("poi_id").alias("covered"), *(of_samples(c).alias(c) for c in names))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))
    return sums.select(
        *keys, "samples", *(F.coalesce(F.col(c) / F.col("samples"), F.lit(0.0)).alias(c) for c in means), share("n_invalid", "n_predicted").alias("invalid_rate"),
        share("n_duplicate", "n_predicted").alias("duplicate_rate"), share("covered", "catalog_size").alias("coverage"),
    )


def empty_summary() -> dict[str, float]:
    return {**{name: 0.0 for name in _metrics()}, "validity_rate": 0.0, "empty_rate": 0.0, "invalid_rate": 0.0, "duplicate_rate": 0.0, "coverage": 0.0}


def failures(obs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples with their reasons, first ten predictions and the target's sources."""
    v = with_validity(obs, catalog)
    missed = F.coalesce(F.col("top_rank") > 10, F.lit(True))
    tests = {"empty": F.col("n_predicted") == 0, "duplicate": F.col("n_duplicate") > 0, "invalid": F.col("n_invalid") > 0, "target_miss_at_10": missed}
    reasons = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())
    return v.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select("variant", "sample_id", "reasons", F.slice("predictions", 1, 10).alias("predictions"), "target_poi_id", "target_sources")


def latency_summary(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    plain = F.count(column).alias("count"), F.avg(column).alias("mean"), F.max(column).alias("max")
    found = with_percentiles(df, by or [], column, {"p50": 0.5, "p95": 0.95}, *plain)
    return found.select(*(by or []), "count", "mean", "p50", "p95", "max")


def endpoint_metrics(log: DataFrame, endpoints: list[str]) -> DataFrame:
    """endpoint, requests, latency sum, average and largest (rounded to 3); endpoints without requests have 0."""
    spark = log.sparkSession
    known = spark.createDataFrame([(e,) for e in [*endpoints, "other"]], "endpoint string")
    named = log.withColumn("endpoint", F.when(F.col("endpoint").isin(*endpoints), F.col("endpoint")).otherwise("other"))
    sums = named.groupBy("endpoint").agg(F.count("*").alias("requests"), F.sum("latency_ms").alias("s"), F.avg("latency_ms").alias("a"), F.max("latency_ms").alias("m"))
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 3)
    return known.join(sums, "endpoint", "left").select("endpoint", F.coalesce("requests", F.lit(0).cast("long")).alias("requests"), value("s").alias("latency_sum"), value("a").alias("latency_avg"), value("m").alias("latency_max"))


def status_classes(log: DataFrame) -> DataFrame:
    known = log.sparkSession.createDataFrame([("2xx",), ("4xx",), ("5xx",)], "status_class string")
    counts = log.groupBy(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")).alias("status_class")).agg(F.count("*").alias("responses"))
    return known.join(counts, "status_class", "left").select("status_class", F.coalesce("responses", F.lit(0).cast("long")).alias("responses"))
