"""What the training-data operators share: inputs, word counting and tables written between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import settings

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)


def text_of(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_hash() -> Column:
    """128 bits that stand for a whole row: two hashes of all columns and of which of them are null."""
    marked = [x for c in DOCUMENT_COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit(SECOND_SEED), *marked).alias("b"))


SECOND_SEED = 0x5EED
ROW_HASH = "struct<a:bigint,b:bigint>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    one of its own; on a cluster it is an error, as executors can't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows and MB of one Arrow batch, so that a batch of long texts fits a Python worker.
BATCH_ROWS, BATCH_MB = 1000, 2


def staged(df: DataFrame, name: str, rows: int = BATCH_ROWS, mb: int = BATCH_MB) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: cuts the lineage, and what comes after doesn't
    repeat the work when an executor is lost. Shuffle files of the write go when it is done. rows and mb bound the Arrow
    batches of the write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(mb << 20),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    with settings(spark, wanted):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a list of keys that goes to all tasks; a longer one is joined by shuffle.
LIST_ROWS = 500_000


def if_short(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(LIST_ROWS + 1).count() <= LIST_ROWS else rows


def sliced(batches, rows: int = BATCH_ROWS, mb: int = BATCH_MB):
    """Arrow batches in slices of at most so many rows and about so many MB."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * (mb << 20) / max(batch.nbytes, 1))))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


#: Items of an array that are summed, or spans that are redacted, in one go; an array that grows item by item is copied each time.
RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(items: Column) -> Column:
    """An array as an array of arrays of RUN items."""
    last = F.greatest(F.ceil(F.size(items) / RUN).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * RUN + 1, F.lit(RUN)))


def before_each(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each value what join makes of start and the values before it."""
    none = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, none, lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def sums_before(values: Column) -> Column:
    add = lambda a, b: a + b
    zero = F.lit(0).cast("bigint")

    def of_runs(runs: Column) -> Column:
        starts = before_each(F.transform(runs, lambda r: F.aggregate(r, zero, add)), zero, add)
        return F.flatten(F.zip_with(runs, starts, lambda r, at: before_each(r, at, add)))

    return let(values, lambda v: let(runs_of(v), of_runs))


def wide_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
