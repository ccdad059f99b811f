"""A corpus pipeline of five stages over documents, each on all that the one before kept.

Stage order: quality, near duplicates, secrets, mixing, packing. Decisions are joined back by a 128-bit hash of the whole row;
the list of rows to drop or change is broadcast while it is short (LIST_ROWS) and joined by shuffle beyond.

Defined cases, for every stage: an empty table gives an empty one of the same columns; a null text is an empty text, and stays
null where the stage doesn't change it; null ids, languages and sources are values of their own; only the columns of documents
are read, so further ones can't clash; texts are worked off whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import kneser_ney, mixing, packing, secret_scan, similar
from wayfare.llm.common import DOCUMENT_COLUMNS, documents, if_short, read_table, row_hash, staged

#: Pieces of text whose ids a packing worker keeps: fewer than by default, as after four stages executors hold more.
KEPT_PIECES = 200_000


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS).withColumn("row_hash", row_hash())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go. Equal rows go or stay together; texts without symbols
    and all texts where nothing is labelled trusted stay."""
    judged = kneser_ney.judge(docs, read_table(spark, sf_dir, "labels"))
    rejected = staged(judged.filter(~F.col("kept")).select("row_hash").distinct(), "rejected")
    return _hashed(docs).join(if_short(rejected), "row_hash", "left_anti").select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (0.8 or more alike) the one with the least doc_id stays; of equal
    rows one. Of different rows with that doc_id the one with the least hash stays; a null doc_id stays only if all have none.
    Texts without words are one group."""
    marked = staged(similar.similar_texts(docs).select("doc_id", "row_hash", "root"), "marked")
    # a group without any doc_id keeps its least row
    first = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("stays"))
    stays = first.select(F.col("stays.row_hash").alias("row_hash"))
    dropped = staged(marked.select("row_hash").distinct().join(stays, "row_hash", "left_anti"), "dropped")
    kept = _hashed(docs).join(if_short(dropped), "row_hash", "left_anti")
    repeated = marked.groupBy("row_hash").count().filter("count > 1").join(dropped, "row_hash", "left_anti")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["row_hash"])
    return kept.select(*DOCUMENT_COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live and weak credentials become [SECRET], widely copied examples [EXAMPLE]; n_chars follows. Equal rows change alike;
    overlapping spans are one mark."""
    found = secret_scan.scan(docs).filter(F.size("spans") > 0).select("row_hash", "spans").dropDuplicates(["row_hash"])
    joined = _hashed(docs).join(if_short(staged(found, "found")), "row_hash", "left")
    text = F.when(F.col("spans").isNotNull(), secret_scan.redact(F.coalesce("text", F.lit("")), F.col("spans"))).otherwise(F.col("text"))
    n_chars = F.when(F.col("spans").isNotNull(), F.length("new_text").cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumn("new_text", text).select("doc_id", F.col("new_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it. Equal rows are one kind of row with their summed number; documents
    without words go; ties within a size are broken by a seeded hash."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows, one row each; repeated rows are packed once each, a text without tokens as its end id."""
    pieces = packing.pack(docs, end_id=1, kept=KEPT_PIECES)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: The n-gram model, the seeded choice of documents and the tokenizer can't be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
