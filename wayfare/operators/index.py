"""Count tables fitted on the training split only, and the audit of an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.scalars import TIME_BUCKETS, time_bucket
from wayfare.operators.skew import spread_sessions
from wayfare.session import stored


@dataclass(frozen=True)
class Index:
    """poi_stats(poi_id, category, model_poi_id, n), time_counts(bucket, poi_id, n), category_counts(category, poi_id, n),
    transition_counts(src, dst, n). Row counts grow with the catalog, not with the events."""

    dataset: str
    poi_stats: DataFrame
    time_counts: DataFrame
    category_counts: DataFrame
    transition_counts: DataFrame

    def kept(self) -> Index:
        """The same tables, held by the executors, as scoring reads each of them several times."""
        return Index(self.dataset, **{k: df.persist() for k, df in self.tables().items()})

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in ("poi_stats", "time_counts", "category_counts", "transition_counts")}


def guard_training_rows(train: DataFrame) -> str:
    """The one dataset of non-empty rows that are all of the training split."""
    row = train.agg(F.count("*").alias("n"), F.count_if(F.col("split") != "train").alias("other"), F.min("dataset").alias("dataset"), F.max("dataset").alias("last")).first()
    if not row["n"] or row["other"] or row["dataset"] is None or row["dataset"] != row["last"]:
        sets = train.agg(F.count_distinct("dataset").alias("sets")).first()["sets"]
        raise ValueError(f"an index is fitted on training rows of one dataset: {row['n']} rows, {row['other']} of other splits, {sets} datasets")
    return row["dataset"]


def consecutive_pairs(events: DataFrame) -> DataFrame:
    """(src, dst): visits that follow each other in a session."""
    # visits of one place and time may come in any order: their pairs are the same
    session, in_order = ["raw_user_id", "session_id"], [F.col("timestamp_utc"), F.col("raw_poi_id")]
    rows = spread_sessions(events.select(*session, "timestamp_utc", "raw_poi_id"), session, in_order, 1)
    order = Window.partitionBy(*session, "part").orderBy(*in_order, F.col("halo").desc())
    pairs = rows.withColumn("src", F.lag("raw_poi_id").over(order)).withColumn("nth", F.row_number().over(order))
    return pairs.filter(~F.col("halo") & (F.col("nth") > 1)).select("src", F.col("raw_poi_id").alias("dst")).filter(F.col("dst").isNotNull())


def fit_index(train: DataFrame, guard: bool = True, large: bool = False) -> Index:
    """large: of so many places that hardly a pair comes twice. The counts that three tables are sums of are stored, and pairs are
    dealt once, by their target, as lists read them."""
    dataset = guard_training_rows(train) if guard else ""
    # one pass over the events; the three tables are sums of it
    cells = train.groupBy(F.col("raw_poi_id").alias("poi_id"), time_bucket(F.col("timestamp_utc")).alias("bucket"), "category", "model_poi_id").agg(F.count("*").alias("n"))
    pairs = consecutive_pairs(train)
    if large:
        cells, pairs = stored(cells), pairs.repartition("dst")
    category_counts = cells.groupBy("category", "poi_id").agg(F.sum("n").alias("n"))
    # the most frequent value; of equally frequent ones the least
    voted = category_counts.groupBy("poi_id").agg(F.sum("n").alias("n"), F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"))
    models = cells.filter(F.col("model_poi_id").isNotNull()).groupBy("poi_id", "model_poi_id").agg(F.sum("n").alias("n"))
    models = models.groupBy("poi_id").agg(F.min_by("model_poi_id", F.struct(-F.col("n"), F.col("model_poi_id"))).alias("model_poi_id"))
    return Index(
        dataset,
        voted.join(models, "poi_id", "left").select("poi_id", "category", "model_poi_id", "n"),
        cells.groupBy("bucket", "poi_id").agg(F.sum("n").alias("n")),
        category_counts,
        pairs.groupBy("src", "dst").agg(F.count("*").alias("n")),
    )


def unknown_categories(events: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Categories of events that the taxonomy doesn't have."""
    return events.select("category").distinct().join(taxonomy.select("category"), "category", "left_anti")


def taxonomy(events: DataFrame) -> DataFrame:
    return events.select("category").distinct()


def audit_index(index: Index, categories: DataFrame) -> DataFrame:
    """rule, violations: one row for each rule."""
    p, t, c, m = index.poi_stats, index.time_counts, index.category_counts, index.transition_counts

    def differs(sums: DataFrame, more_allowed: bool = False) -> DataFrame:
        joined = p.select("poi_id", F.col("n").alias("whole")).join(sums, "poi_id", "full")
        wrong = F.coalesce("part", F.lit(0)) > F.coalesce("whole", F.lit(0)) if more_allowed else ~F.col("part").eqNullSafe(F.col("whole"))
        return joined.filter(wrong)

    total = lambda df, key: df.groupBy(F.col(key).alias("poi_id")).agg(F.sum("n").alias("part"))
    vote = c.groupBy("poi_id").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("vote"))
    unknown = lambda df, key: df.select(F.col(key).alias("poi_id")).join(p, "poi_id", "left_anti")
    rules = {
        "time_sum": differs(total(t, "poi_id")),
        "category_sum": differs(total(c, "poi_id")),
        "voted_category": p.join(vote, "poi_id", "left").filter(~F.col("vote").eqNullSafe(F.col("category"))),
        "outgoing": differs(total(m, "src"), True),
        "incoming": differs(total(m, "dst"), True),
        "positive": p.select("n").unionAll(t.select("n")).unionAll(c.select("n")).unionAll(m.select("n")).filter("n <= 0"),
        "model_ids": p.filter(F.col("model_poi_id").isNotNull()).groupBy("model_poi_id").count().filter("count > 1"),
        "buckets": t.filter(~F.col("bucket").isin(*TIME_BUCKETS)),
        "time_pois": unknown(t, "poi_id"),
        "category_pois": unknown(c, "poi_id"),
        "transition_sources": unknown(m, "src"),
        "transition_targets": unknown(m, "dst"),
        "taxonomy": unknown_categories(c, categories),
    }
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionAll(row)
    return out
