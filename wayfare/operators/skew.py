"""Sessions and keys that hold a large share of all rows: found by a sketch, and worked off in many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import written_once

#: A key is heavy with this share of all rows, and so many rows at least; so there are 1 / SHARE heavy keys at most.
SHARE, LEAST = 1 / 500, 100_000
#: Keys that the sketch follows: far more than can be heavy, so that none is missed.
TRACKED = 16_384


def heavy_keys(df: DataFrame, key: Column) -> list[int]:
    """The values of a long key that are heavy, by a sketch of bounded size that tasks merge. Counts of the sketch are never
    too low by more than a TRACKED-th part of the rows, so keys just below SHARE may be among them."""
    row = df.agg(F.count("*").alias("n"), F.call_function("approx_top_k", key, F.lit(int(2 / SHARE)), F.lit(TRACKED)).alias("top")).first()
    least = max(LEAST, SHARE * row["n"])
    return sorted(t["item"] for t in row["top"] or [] if t["count"] + row["n"] / TRACKED >= least and t["item"] is not None)


def spread_sessions(events: DataFrame, session: list[str], order: list[Column], reach: int) -> DataFrame:
    """events with part, halo and earlier, for windows by (session, part) in the given order that look back at most reach rows.

    A heavy session is cut into ranges of its order, each a part; every part also has the rows before it that its first rows look
    back at, as halo rows, which are to be dropped after the window. earlier: rows of the session before the part. All other
    sessions are one part without halo."""
    key = F.xxhash64(*session)
    heavy = heavy_keys(events.select(key.alias("key")), F.col("key"))
    plain = lambda df: df.select("*", F.lit(-1).alias("part"), F.lit(False).alias("halo"), F.lit(0).cast("long").alias("earlier"))
    if not heavy:
        return plain(events)
    is_heavy = key.isin(heavy)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) for c in session), *order]
    # ranges come from a sample: everything below has to see the same ones
    ranged = written_once(events.filter(is_heavy).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    right = lambda df: F.broadcast(df.toDF(*(f"r_{c}" for c in df.columns)))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in session))
    by_part = Window.partitionBy(*session).orderBy("part")
    # a row for each part of a heavy session
    sizes = ranged.groupBy(*session, "part").agg(F.count("*").alias("n")).withColumn("earlier", F.sum("n").over(by_part) - F.col("n"))
    # parts before that reach into this one: each has a row at least, so reach of them are enough
    before = F.collect_list(F.struct(F.col("part").alias("source"), (F.col("earlier") + F.col("n")).alias("end"))).over(by_part.rowsBetween(-reach, -1))
    near = sizes.withColumn("before", before).select(*session, F.col("part").alias("to"), "earlier", F.explode("before").alias("b"))
    near = near.select(*session, "to", "earlier", "b.source", (F.col("earlier") - F.col("b.end")).alias("between")).filter(F.col("between") < reach)
    last = F.row_number().over(Window.partitionBy(*session, "part").orderBy(*(c.desc_nulls_last() for c in order)))
    tails = ranged.withColumn("from_end", last).filter(F.col("from_end") <= reach)
    # near and sizes have a row for each part of the heavy sessions, and reach times that at most
    sent = tails.join(right(near), same & (F.col("part") == F.col("r_source")) & (F.col("from_end") + F.col("r_between") <= reach))
    halo = sent.select(*events.columns, F.col("r_to").alias("part"), F.lit(True).alias("halo"), F.col("r_earlier").alias("earlier"))
    own = ranged.join(right(sizes), same & (F.col("part") == F.col("r_part")))
    own = own.select(*events.columns, "part", F.lit(False).alias("halo"), F.col("r_earlier").alias("earlier"))
    return plain(events.filter(~is_heavy)).unionAll(own).unionAll(halo)
