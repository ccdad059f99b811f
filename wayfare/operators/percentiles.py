"""Exact interpolated percentiles of any number of different values, with state that doesn't grow with them.

A radix selection: doubles become 64-bit keys in the same order, and the key of a wanted rank is found 16 bits at a time. Each
round counts the rows under the prefix found so far by their next 16 bits, takes the digit where the counts reach the rank, and
goes on with what is left of it. A round is one aggregation into at most 65,536 counts for each prefix (at most two prefixes for
each group and percentile), so no task holds the values of a group, however hot, and four rounds end it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import written_once

DIGIT_BITS, ROUNDS = 16, 4
DIGITS = 1 << DIGIT_BITS


def order_key(x: Column) -> Column:
    """A long that orders as the double does; -0.0 is 0.0, NaN comes last, and null stays null."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(x, F.lit(0.0)) + F.lit(0.0)).cast("long")
    bits = F.when(x.isNotNull(), bits)
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))


def of_key(key: Column) -> Column:
    """The double of an order_key."""
    bits = key.bitwiseXOR(F.shiftright(key, 63).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _prefix(key: Column, digits: int) -> Column:
    """The first digits of a key, as a number that keeps the sign; of none, 0."""
    return F.shiftright(key, 64 - DIGIT_BITS * digits) if digits else F.lit(0).cast("long")


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and one column for each percentile (name -> share), interpolated between the neighbours of (n - 1) * share. Null values
    don't count; groups without others have no row. df is read once. Columns of by may have any name that doesn't begin with p_."""
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by), F.lit(True))
    rows = written_once(df.select(*by, order_key(F.col(value).cast("double")).alias("p_key")).filter(F.col("p_key").isNotNull()))
    place = lambda q: (F.col("p_n") - 1) * F.lit(float(q))
    ends = F.array(*(F.struct(F.lit(name).alias("p_name"), F.lit(end).alias("p_end"), f(place(q)).cast("long").alias("p_left")) for name, q in wanted.items() for end, f in (("low", F.floor), ("high", F.ceil))))
    # left: the rank among the rows under the prefix
    targets = rows.groupBy(*by).agg(F.count("*").alias("p_n")).select(*by, "p_n", F.explode(ends).alias("e")).select(*by, "p_n", "e.*", F.lit(0).cast("long").alias("p_prefix"))
    for done in range(ROUNDS):
        targets = written_once(targets)
        live = targets.select(*by, "p_prefix").distinct()
        under = rows.join(live, same(rows, live) & (_prefix(rows["p_key"], done) == live["p_prefix"])) if done else rows
        counts = under.select(*(rows[c] for c in by), _prefix(rows["p_key"], done).alias("p_prefix"), _prefix(rows["p_key"], done + 1).alias("p_longer")).groupBy(*by, "p_prefix", "p_longer").agg(F.count("*").alias("p_m"))
        before = F.sum("p_m").over(Window.partitionBy(*by, "p_prefix").orderBy("p_longer")) - F.col("p_m")
        c = counts.withColumn("p_before", before)
        met = targets.join(c, same(targets, c) & (targets["p_prefix"] == c["p_prefix"]) & (c["p_before"] <= targets["p_left"]) & (targets["p_left"] < c["p_before"] + c["p_m"]))
        targets = met.select(*(targets[x] for x in by), "p_n", "p_name", "p_end", (targets["p_left"] - c["p_before"]).alias("p_left"), c["p_longer"].alias("p_prefix"))
    at = targets.withColumn("p_x", of_key(F.col("p_prefix")))
    value_at = lambda name, end: F.max(F.when((F.col("p_name") == name) & (F.col("p_end") == end), F.col("p_x")))
    found = at.groupBy(*by).agg(F.first("p_n").alias("p_n"), *(value_at(name, end).alias(f"{name}_{end}") for name in wanted for end in ("low", "high")))

    def between(name: str, q: float) -> Column:
        low, high, share = F.col(f"{name}_low"), F.col(f"{name}_high"), place(q) - F.floor(place(q))
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    return found.select(*by, *(between(name, q).alias(name) for name, q in wanted.items()))


def with_percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], *plain: Column) -> DataFrame:
    """by, the plain aggregates, and the percentiles; null where a group has no value."""
    sums = df.groupBy(*by).agg(*plain)
    p = percentiles(df, by, value, wanted)
    match = reduce(lambda x, y: x & y, (sums[c].eqNullSafe(p[c]) for c in by), F.lit(True))
    return sums.join(p, match, "left").select(*(sums[c] for c in sums.columns), *wanted)
