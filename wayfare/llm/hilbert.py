"""Shards along a Hilbert curve, so that a reader can skip files by any of several columns.

Each column becomes one of LEVELS steps, cut where the column's distribution reaches equal shares of the rows (a column of four
values of equal weight takes the steps 0, 16, 32 and 48), so every column divides the cube from its coarsest bits on. The steps'
place on the Hilbert curve is the sort key. Rows are sorted by ranges side by side, numbered through by the sizes of the ranges,
and cut into runs of equal row counts, at most one apart (the law `rows`). Ranges hold about equal bytes: they are cut from the
bytes of the curve's cells, and within a cell by a hash of the text, so neither a full cell nor long texts beside each other
fill one task. A text that many rows share, found by a sketch, is a cell of its own and cut by a hash of its rows. Each run becomes the files of one shard; manifest() has every column's smallest and largest value in each shard, and
shards_for() the shards that a condition on the columns leaves.

Only DataFrame functions: the curve is an automaton whose table curve_table() derives, walked by aggregate() over the bits.

Defined cases: a null column value takes step 0, beside the smallest; a null text counts as empty and stays null in the files;
repeated rows are rows of their own, beside each other; equal texts of equal columns are neighbours, and are parted only where a
run ends; ties are in the order of the key, equal rows in any; an empty table gives no files and an empty table; of the input
only the columns of documents are read, so others can't clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators.skew import heavy_keys

from .common import DOCUMENT_COLUMNS, discard, shared_dir, staged, text_of, wide_partitions

BITS = 6
LEVELS = 1 << BITS
DIMENSIONS = ("source", "lang", "n_chars")
#: Bytes of one task of the sort, and ranges that share it.
TASK_BYTES, RANGES = 128 << 20, 4
#: Bytes that a row counts beside its text.
ROW_BYTES = 64
#: A number of monotonically_increasing_id() is the partition, then the row in so many bits.
ROW_BITS = 33


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve in dims dimensions as an automaton: for state * 2^dims + corner the digit of the curve's index and the
    next state. A state is the entry corner and the direction of the sub-cube; state 0 is the whole cube."""
    full = (1 << dims) - 1
    left = lambda x, k: ((x << k % dims) | (x >> dims - k % dims)) & full
    right = lambda x, k: left(x, dims - k % dims)
    gray = lambda i: i ^ (i >> 1)
    digit_of = {gray(i): i for i in range(full + 1)}
    entry = lambda i: 0 if i == 0 else gray((i - 1) // 2 * 2)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  at the low end
    turn = lambda i: 0 if i == 0 else ones(i - 1 + i % 2) % dims
    states, digits, following = {(0, 0): 0}, [], []
    todo = [(0, 0)]
    for corner_in, way in todo:
        for corner in range(full + 1):
            digit = digit_of[right(corner ^ corner_in, way + 1)]
            then = (corner_in ^ left(entry(digit), way + 1), (way + turn(digit) + 1) % dims)
            if then not in states:
                states[then] = len(states)
                todo.append(then)
            digits.append(digit)
            following.append(states[then])
    return digits, following


def curve_index(steps: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a cell given by its step in each dimension."""
    dims = len(steps)
    digits, following = (F.array(*map(F.lit, x)) for x in curve_table(dims))
    corners = F.array(*(sum(((F.shiftright(s, i).bitwiseAND(F.lit(1)) * (1 << d)) for d, s in enumerate(steps)), F.lit(0)) for i in reversed(range(bits))))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def walk(at: Column, corner: Column) -> Column:
        place = at["state"] * (1 << dims) + corner
        return F.struct(F.get(following, place).alias("state"), (at["index"] * (1 << dims) + F.get(digits, place)).alias("index"))

    return F.aggregate(corners, start, walk, lambda at: at["index"])


def numbered(df: DataFrame, keys: list, parts: int, name: str) -> DataFrame:
    """df, written in the order of keys, with `range` and `nth`, its range and its place there."""
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("numbered", F.monotonically_increasing_id())
    table = staged(ranged, name)
    at = F.col("numbered")
    out = table.withColumn("range", F.shiftright(at, ROW_BITS)).withColumn("nth", at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("numbered")
    out.staged_at = table.staged_at
    return out


def steps_of(df: DataFrame, column: str, levels: int = LEVELS) -> list[tuple[int, object]]:
    """(step, its least value): a value's step is its share of the rows before it, in levels. At most levels entries come here."""
    counts = staged(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "values")
    table = numbered(counts, ["value"], wide_partitions(df.sparkSession), "values-in-order")
    running = F.sum("n").over(Window.partitionBy("range").orderBy("nth")) - F.col("n")
    sums = table.groupBy("range").agg(F.sum("n").alias("rows"))
    before = sums.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"))  # a row for each range
    total = counts.agg(F.sum("n")).first()[0] or 0
    step = F.floor((F.col("before") + F.col("smaller")) * levels / F.lit(max(total, 1))).cast("int")
    found = table.withColumn("smaller", running).join(F.broadcast(before), "range").groupBy(step.alias("step")).agg(F.min("value").alias("value")).collect()
    discard(table, counts)
    return sorted((r["step"], r["value"]) for r in found)


def step(column: str, cuts: list[tuple[int, object]], kind: T.DataType) -> Column:
    """The step of a column's value; of null, and of what is less than all that was seen, 0."""
    if not cuts:
        return F.lit(0)
    values = F.array(*(F.lit(v).cast(kind) for _, v in cuts))
    known = F.array(*(F.lit(s) for s, _ in cuts))
    return F.coalesce(F.get(known, F.size(F.filter(values, lambda v: v <= F.col(column))) - 1), F.lit(0))


def along_curve(docs: DataFrame, dimensions: tuple = DIMENSIONS, levels: int = LEVELS) -> DataFrame:
    """docs with curve, their place on the Hilbert curve."""
    kinds = {f.name: f.dataType for f in docs.schema}
    steps = [step(c, steps_of(docs, c, levels), kinds[c]) for c in dimensions]
    return docs.withColumn("curve", curve_index(steps))


def in_order(docs: DataFrame, dimensions: tuple = DIMENSIONS) -> tuple[DataFrame, DataFrame, int]:
    """The documents written in the order of the curve with `range` and `numbered`, a row for each range with `first` (its least
    number) and `before` (rows of the ranges before it), and how many documents there are."""
    d = docs.select(*DOCUMENT_COLUMNS).withColumn("text_hash", F.xxhash64(text_of())).withColumn("bytes", (F.octet_length(text_of()) + ROW_BYTES).cast("long"))
    whole = d.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    shared = heavy_keys(d, F.col("text_hash"))
    parts = max(wide_partitions(docs.sparkSession), -(-(whole["bytes"] or 0) // TASK_BYTES))
    step = max(1.0, (whole["bytes"] or 0) / (parts * RANGES))
    keyed = along_curve(d, dimensions).withColumn("row_number", F.monotonically_increasing_id())
    own = F.when(F.col("text_hash").isin(shared), F.col("text_hash")) if shared else F.lit(None).cast("long")
    keyed = keyed.withColumn("own", own)
    share = F.when(F.col("own").isNull(), F.col("text_hash")).otherwise(F.xxhash64("doc_id", "row_number")).bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(2.0**63)
    keyed = keyed.withColumn("share", share)
    # at most one row for each cell of the curve, and for each shared text in it
    cells = keyed.groupBy("curve", "own").agg(F.sum("bytes").alias("held"))
    start = (F.sum("held").over(Window.orderBy("curve", F.col("own").asc_nulls_last())) - F.col("held")).alias("start")
    cells = staged(cells.select(F.col("curve").alias("c_curve"), F.col("own").alias("c_own"), start, "held"), "cells")
    met = keyed.join(F.broadcast(cells), (F.col("curve") == F.col("c_curve")) & F.col("own").eqNullSafe(F.col("c_own")))
    ranged = met.withColumn("range", F.floor((F.col("start") + F.col("share") * F.col("held")) / step).cast("long"))
    keys = ["range", "curve", F.col("own").asc_nulls_last(), "share", "text_hash", "doc_id", "row_number"]
    sorted_rows = ranged.repartition(parts, "range").sortWithinPartitions(*keys).withColumn("numbered", F.monotonically_increasing_id())
    table = staged(sorted_rows.select(*DOCUMENT_COLUMNS, "curve", "range", "numbered"), "curve")
    sizes = table.groupBy("range").agg(F.count("*").alias("n"), F.min("numbered").alias("first"))
    before = sizes.select("range", "first", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).cast("long").alias("before"))  # parts * RANGES rows
    discard(cells)
    return table, before, whole["n"]


def write_shards(docs: DataFrame, shards: int, path: str, dimensions: tuple = DIMENSIONS) -> DataFrame:
    """Write documents into shard=0 .. shard=N-1 below path, each a run of the curve, and read them back with shard and slot."""
    table, before, n = in_order(docs, dimensions)
    position = F.col("before") + F.col("numbered") - F.col("first")
    shard = F.expr(f"cast((position * {shards}L) div {max(n, 1)}L as int)")
    begin = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")  # of the run
    placed = table.join(F.broadcast(before), "range").withColumn("position", position).withColumn("shard", shard)
    rows = placed.select(*DOCUMENT_COLUMNS, "curve", "shard", (F.col("position") - begin).alias("slot"))
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    discard(table)
    return read_shards(docs.sparkSession, path, docs)


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """What write_shards wrote of docs, whose column types they have. A filter on shard reads only its files."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in DOCUMENT_COLUMNS)
    return spark.read.schema(f"{kinds}, curve long, slot long, shard int").parquet(path)


def manifest(written: DataFrame, dimensions: tuple = DIMENSIONS) -> DataFrame:
    """shard, n, bytes, and of each dimension the least and the largest value and the number of nulls."""
    ends = [x for c in dimensions for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))]
    return written.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.octet_length(text_of())).alias("bytes"), *ends)


def shards_for(manifest: DataFrame, ranges: dict[str, tuple]) -> list[int]:
    """Shards that can hold rows whose columns lie between the two values given for each (both included)."""
    meets = [(F.col(f"{c}_min") <= F.lit(high)) & (F.col(f"{c}_max") >= F.lit(low)) for c, (low, high) in ranges.items()]
    rows = manifest
    for m in meets:
        rows = rows.filter(m)
    return sorted(r["shard"] for r in rows.select("shard").collect())


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
