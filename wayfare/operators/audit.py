"""Audits of declared splits: summaries, overlaps, order in time, fingerprints and the manifest."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.contracts import SPLITS
from wayfare.functions.scalars import canonical_timestamp, event_identity, session_identity
from wayfare.session import written_once

#: A fingerprint's sum has so many limbs of 16 bits: 256 bits.
LIMBS = 16
EVENT_COLUMNS = ["dataset", "split", "raw_user_id", "session_id", "timestamp_utc", "raw_poi_id", "model_poi_id", "category", "latitude", "longitude"]


def split_order(split: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), split)


def split_summary(events: DataFrame, approximate: bool = False) -> DataFrame:
    """split, events, sessions (distinct), first_ts, last_ts."""
    key = F.xxhash64("dataset", "raw_user_id", "session_id") if approximate else F.struct("dataset", "raw_user_id", "session_id")
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return events.groupBy("split").agg(F.count("*").alias("events"), distinct.alias("sessions"), F.min("timestamp_utc").alias("first_ts"), F.max("timestamp_utc").alias("last_ts"))


def shared_identities(events: DataFrame, kind: str) -> DataFrame:
    """left_split, right_split, identity: event or session identities that two splits have. Rows are grouped by what an identity
    is made of, and hashed only where it is shared."""
    made_of = ["dataset", "raw_user_id", "timestamp_utc", "raw_poi_id"] if kind == "event" else ["dataset", "raw_user_id", "session_id"]
    held = events.groupBy(*made_of).agg(*(F.bool_or(F.col("split") == s).alias(f"in_{s}") for s in SPLITS))
    shared = F.array(*(F.when(F.col(f"in_{a}") & F.col(f"in_{b}"), F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"))) for a, b in combinations(SPLITS, 2)))
    pairs = held.withColumn("pairs", F.filter(shared, lambda p: p.isNotNull())).filter(F.size("pairs") > 0)
    identity = event_identity() if kind == "event" else session_identity()
    return pairs.select(identity.alias("identity"), F.explode("pairs").alias("pair")).select("pair.left_split", "pair.right_split", "identity")


def overlap_counts(events: DataFrame) -> DataFrame:
    """kind, left_split, right_split, overlap: all pairs, with 0 where nothing is shared."""
    spark = events.sparkSession
    pairs = spark.createDataFrame([(k, a, b) for k in ("event", "session") for a, b in combinations(SPLITS, 2)], "kind string, left_split string, right_split string")
    found = shared_identities(events, "event").withColumn("kind", F.lit("event")).unionByName(shared_identities(events, "session").withColumn("kind", F.lit("session")))
    counts = found.groupBy("kind", "left_split", "right_split").agg(F.count("*").alias("overlap"))
    return pairs.join(counts, ["kind", "left_split", "right_split"], "left").select("kind", "left_split", "right_split", F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))


def temporal_boundaries(summary: DataFrame) -> DataFrame:
    """earlier, later, ordered: whether a split ends before the next one begins; null where one is empty."""
    s = {name: summary.filter(F.col("split") == name).agg(F.min("first_ts").alias("a"), F.max("last_ts").alias("b")) for name in SPLITS}
    first, second = (
        s[x].select(F.col("b").alias("end")).join(s[y].select(F.col("a").alias("begin")), F.lit(True)).select(F.lit(x).alias("earlier"), F.lit(y).alias("later"), (F.col("end") <= F.col("begin")).alias("ordered"))
        for x, y in zip(SPLITS, SPLITS[1:])
    )
    return first.unionAll(second)


def temporal_order(boundaries: DataFrame) -> DataFrame:
    """temporal_splits_ordered: whether all boundaries that can be judged are in order; null if none can."""
    return boundaries.agg(F.bool_and("ordered").alias("temporal_splits_ordered"))


def with_file_order(read: DataFrame) -> DataFrame:
    """What was just read from files, with file_order: file, start of the block, and the place within it. Blocks are read in one
    task each and in order, so no column of the data is needed. Use it before any other step."""
    return read.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")).alias("file_order"))


def input_ordered(events: DataFrame, order: str) -> DataFrame:
    """split, input_time_ordered: whether rows come in time order along the column order, which is file_order or any column that
    can be sorted. Blocks of files, or ranges of the order, are checked side by side and then their boundaries, so no split
    passes through one task."""
    narrow = events.select("split", F.col(order).alias("at"), "timestamp_utc")
    if dict(events.dtypes)[order].startswith("struct<file:"):
        parts = narrow.withColumn("part", F.struct("at.file", "at.start"))
    else:
        count = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # ranges come from a sample: all that follows has to see the same ones
        parts = written_once(narrow.repartitionByRange(count, "split", "at").withColumn("part", F.spark_partition_id()))
    back = F.lag("timestamp_utc").over(Window.partitionBy("split", "part").orderBy("at")) > F.col("timestamp_utc")
    ends = parts.withColumn("back", back).groupBy("split", "part").agg(F.bool_or(F.coalesce("back", F.lit(False))).alias("back"), F.min_by("timestamp_utc", "at").alias("head"), F.max_by("timestamp_utc", "at").alias("tail"))
    turn = F.lag("tail").over(Window.partitionBy("split").orderBy("part")) > F.col("head")  # a row for each part
    return ends.withColumn("turn", turn).groupBy("split").agg((~F.bool_or(F.col("back") | F.coalesce("turn", F.lit(False)))).alias("input_time_ordered"))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row as JSON, nulls included, times in their canonical form."""
    text = [canonical_timestamp(F.col(c)).alias(c) if dict(df.dtypes)[c].startswith("timestamp") else F.col(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*text), {"ignoreNullFields": "false"}), 256)


def fingerprint_state(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """by, rows, limbs: a multiset hash that adds up. Each row is a 256-bit number; limbs are the sums of its 16-bit limbs, least
    first. Sums are made where the rows are and merged, so a task holds a fixed number of longs, and states of parts (days,
    files) give the state of the whole by merge_states. It tells changed, added, doubled and lost rows; it isn't made to
    withstand someone who searches for rows of a given sum."""
    by = by or []
    word = lambda i: F.conv(F.substring("digest", 57 - 8 * i, 8), 16, 10).cast("long")
    words = df.select(*by, row_digest(df, columns).alias("digest")).select(*by, *(word(i).alias(f"w{i}") for i in range(LIMBS // 2)))
    low, high = (lambda c: c.bitwiseAND(F.lit(0xFFFF))), (lambda c: F.shiftright(c, 16))
    sums = words.groupBy(*by).agg(F.count("*").alias("rows"), *(F.sum(half(F.col(f"w{i}"))).alias(f"s{2 * i + h}") for i in range(LIMBS // 2) for h, half in enumerate((low, high))))
    return sums.select(*by, "rows", F.array(*(F.coalesce(f"s{i}", F.lit(0).cast("long")) for i in range(LIMBS))).alias("limbs"))


def merge_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The states of unions of parts."""
    by = by or []
    sums = states.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.sum(F.get("limbs", F.lit(i))).alias(f"s{i}") for i in range(LIMBS)))
    return sums.select(*by, "rows", F.array(*(F.coalesce(f"s{i}", F.lit(0).cast("long")) for i in range(LIMBS))).alias("limbs"))


def state_digest(rows: Column, limbs: Column) -> Column:
    """SHA-256 of the number of rows and of their sum modulo 2^256, in hexadecimal digits."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text"))

    def add(at: Column, limb: Column) -> Column:
        whole = at["carry"] + limb
        digits = F.lower(F.lpad(F.hex(whole.bitwiseAND(F.lit(0xFFFF))), 4, "0"))
        return F.struct(F.shiftright(whole, 16).alias("carry"), F.concat(digits, at["text"]).alias("text"))

    return F.sha2(F.concat(rows.cast("string"), F.lit(":"), F.aggregate(limbs, start, add, lambda at: at["text"])), 256)


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """fingerprint of the multiset of rows (for each group of by), whatever their order and partitioning."""
    return fingerprint_state(df, columns, by).select(*(by or []), state_digest(F.col("rows"), F.col("limbs")).alias("fingerprint"))


def taxonomy_hash(events: DataFrame) -> DataFrame:
    return events.agg(F.sha2(F.to_json(F.array_sort(F.collect_set("category"))), 256).alias("taxonomy_sha256"))


def check_declared(events: DataFrame, encoder: DataFrame, categories: DataFrame) -> None:
    """The encoder's categories are the whole taxonomy, and no event has another one."""
    coded = encoder.filter(F.col("mapping") == "category").select(F.col("value").alias("category"))
    known = categories.select("category").distinct()
    if not coded.exceptAll(known).unionAll(known.exceptAll(coded)).isEmpty():
        raise ValueError("the encoder's categories aren't the taxonomy")
    unknown = events.select("category").distinct().join(known, "category", "left_anti").orderBy("category").limit(10).collect()
    if unknown:
        raise ValueError(f"categories outside the taxonomy: {', '.join(r['category'] for r in unknown)}")


def manifest(events: DataFrame, protocol: str, encoder: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """A row per split: counts, time range, fingerprint, the hash of the taxonomy (by default the categories of the events), and
    of the encoder where one is given, which then is checked against both."""
    if not protocol:
        raise ValueError("the split protocol needs a name")
    known = categories if categories is not None else events.select("category").distinct()
    if encoder is not None:
        check_declared(events, encoder, known)
    prints = fingerprint(events, EVENT_COLUMNS, ["split"])
    out = split_summary(events).join(prints, "split").join(F.broadcast(taxonomy_hash(known)), F.lit(True)).withColumn("split_protocol", F.lit(protocol))
    if encoder is None:
        return out.withColumn("encoder_fingerprint", F.lit(None).cast("string"))
    return out.join(F.broadcast(fingerprint(encoder, ["mapping", "value", "id"]).withColumnRenamed("fingerprint", "encoder_fingerprint")), F.lit(True))


#: Log2 of the registers of the session sketches: a relative standard error of about 1.04 / sqrt(2^14), 0.8 %.
SKETCH_BITS = 14


def daily_states(events: DataFrame) -> DataFrame:
    """split, day, events, first_ts, last_ts, rows, limbs, sessions: what an audit keeps of each day. Counts, times and the sums
    of the fingerprint are exact, sessions is a sketch. A day's states are made from that day alone and added to a table of days
    (partitioned by day); audits of any number of days then read the states only."""
    by = ["split", "day"]
    dated = events.withColumn("day", F.to_date("timestamp_utc"))
    plain = dated.groupBy(*by).agg(
        F.count("*").alias("events"), F.min("timestamp_utc").alias("first_ts"), F.max("timestamp_utc").alias("last_ts"),
        F.hll_sketch_agg(F.xxhash64("dataset", "raw_user_id", "session_id"), SKETCH_BITS).alias("sessions"),
    )
    prints = fingerprint_state(dated, EVENT_COLUMNS, by)
    return plain.join(prints, by).select(*by, "events", "first_ts", "last_ts", "rows", "limbs", "sessions")


def add_days(events: DataFrame, path: str) -> None:
    """Write the states of the days of events to a table of states; days that are there already are replaced, so a day that is
    worked off again counts once."""
    daily_states(events).write.mode("overwrite").partitionBy("day").option("partitionOverwriteMode", "dynamic").parquet(path)


def merged_days(states: DataFrame) -> DataFrame:
    """split, events, first_ts, last_ts, fingerprint: as split_summary() and fingerprint() of all rows, and approximate_sessions
    from the merged sketches."""
    sums = states.groupBy("split").agg(
        F.sum("events").alias("events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("approximate_sessions")
    )
    return sums.join(merge_states(states, ["split"]), "split").select("split", "events", "first_ts", "last_ts", state_digest(F.col("rows"), F.col("limbs")).alias("fingerprint"), "approximate_sessions")
