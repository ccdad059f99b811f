"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words with their counts as weights. For each sample and each word, a hash of both gives r and c (each
Gamma(2, 1)) and b (uniform); with t = floor(ln(weight) / r + b) the word's draw is ln(c) - r (t - b) - r, and the word with
the least draw is the sample, together with its t. Two documents agree in a sample as often as their generalised Jaccard
similarity (the sum of the least weights over the sum of the largest) says.

The uniforms of a draw are bits of one hash. r is the sum of two exponential quantiles and ln(c) a quantile of its own, looked
up in two tables made from their distributions, as logarithms of each draw took most of the time. A draw and what it stands for
are one long (the draw's rank above, 32 bits of word and t below), so a sample is the minimum of a long over the words and needs
one pass of a hash aggregation. A word that has the same count in a text and in the edited one is drawn once for both.

Documents are dealt into ranges of doc_id; each range also gets the last document of the range below it. One shuffle then
serves the neighbour's text, the counting of words, the samples and the neighbour's fingerprint.

Defined cases: a null text is an empty one; texts without words share one fingerprint, which agrees with itself only; a null
doc_id comes after all others; rows of one doc_id are ordered by a hash of the text; equal rows are neighbours like any
others; a single document is its own next one; an empty table gives an empty result. Columns other than doc_id and text are
ignored. A very long text is counted in the aggregation, its words never lie in one list beyond the split of the text itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settings, staged, text_of, wide_partitions

SAMPLES = 56
#: Ranges of doc_id for each shuffle partition, and how many of them a coarse step of the search for a range skips.
RANGES, STEP = 8, 64
#: Bits of a uniform that picks an exponential, and of one that picks ln(c).
EXP_BITS, LOG_BITS = 12, 16
#: What a text counts for: itself, its edited form, or both alike.
OWN, EDITED, BOTH = 0, 1, 2


def quantile_tables() -> tuple[list[float], list[float]]:
    """Quantiles in the middle of equal parts: of the exponential distribution, and the logarithms of those of Gamma(2, 1)."""
    middle = lambda bits: (np.arange(1 << bits) + 0.5) / (1 << bits)
    u = middle(LOG_BITS)
    low, high = np.zeros(len(u)), np.full(len(u), 40.0)
    for _ in range(60):  # Gamma(2, 1) is below x with 1 - (1 + x) exp(-x)
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (-np.log1p(-middle(EXP_BITS))).tolist(), np.log(low).tolist()


def with_tables(rows: DataFrame) -> DataFrame:
    """rows with the columns exponential and log_gamma, the same two arrays in each: a one-row table that is looked up by
    broadcast, so that the arrays are held once in a task."""
    table = rows.sparkSession.createDataFrame([(0, *quantile_tables())], "of bigint, exponential array<float>, log_gamma array<float>")
    return rows.withColumn("of", F.pmod("term_hash", F.lit(1))).join(F.broadcast(table), "of").drop("of")


def sample_key(term: Column, log_weight: Column, i: int) -> Column:
    """The draw of a term in sample i, in the upper bits, and what identifies term and t in the lower 32."""
    h = F.xxhash64(term.bitwiseXOR(F.lit((i + 1) * 0x9E3779B97F4A7C15 % (1 << 63))))
    bits = lambda at, n: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    r = F.get("exponential", bits(0, EXP_BITS)) + F.get("exponential", bits(EXP_BITS, EXP_BITS))
    log_c = F.get("log_gamma", bits(2 * EXP_BITS, LOG_BITS))
    b = F.shiftrightunsigned(h, 48) * (1.0 / (1 << 16))
    t = F.floor(log_weight / r + b)
    draw = log_c - r * (t - b + 1.0)
    same = term.bitwiseXOR(t * 0x9E3779B1).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.floor(draw * float(1 << 24)), 32).bitwiseOR(same)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE, -1), lambda w: w != "")


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def hex_print(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _samples(counted: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """counted: keys, term (null: no word), n. keys, sampled: the least key of each sample, null without words."""
    drawn = with_tables(counted.select(*keys, "term", F.coalesce("term", F.lit(0)).alias("term_hash"), F.ln("n").alias("log_weight")))
    least = drawn.groupBy(*keys).agg(*(F.min(sample_key(F.col("term"), F.col("log_weight"), i)).alias(f"s{i}") for i in range(samples)))
    return least.select(*keys, F.array(*(f"s{i}" for i in range(samples))).alias("sampled"))


def _identities(sampled: Column) -> Column:
    """What a fingerprint holds of the samples; a text without words has zeros."""
    return F.transform(sampled, lambda x: F.coalesce(x.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0).cast("long")))


def _terms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    words = texts.select(*keys, F.explode_outer(words_of(F.col(text))).alias("word"))
    return words.select(*keys, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"))


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint (array of long, one for each sample) of the column text. Rows of equal keys count as one document.
    If texts are partitioned by some of keys, nothing is shuffled."""
    counted = _terms(texts, keys, text).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    return _samples(counted, keys, samples).select(*keys, _identities(F.col("sampled")).alias("fingerprint"))


def pair_fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """texts: keys, kind (OWN or EDITED), text. keys, fingerprint, edited_fingerprint."""
    counted = _terms(texts, [*keys, "kind"], "text").groupBy(*keys, "term").agg(F.count_if(F.col("kind") == OWN).alias("own"), F.count_if(F.col("kind") == EDITED).alias("edited"))
    part = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"))
    apart = F.filter(F.array(part(OWN, F.col("own")), part(EDITED, F.col("edited"))), lambda x: x["n"] > 0)
    parts = F.when(F.col("own") == F.col("edited"), F.array(part(BOTH, F.col("own")))).otherwise(apart)
    split = counted.select(*keys, "term", F.explode(parts).alias("p")).select(*keys, "term", "p.kind", "p.n")
    sampled = _samples(split, [*keys, "kind"], samples)
    of = lambda kind: F.first(F.when(F.col("kind") == kind, F.col("sampled")), True)
    joined = sampled.groupBy(*keys).agg(of(OWN).alias("own"), of(EDITED).alias("edited"), of(BOTH).alias("both"))
    least = lambda c: _identities(F.coalesce(F.zip_with(c, "both", lambda x, y: F.least(x, y)), F.col(c), F.col("both")))
    return joined.select(*keys, least("own").alias("fingerprint"), least("edited").alias("edited_fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, nth, own, doc_id, text, next_text), partitioned by range: next_text is the text of the next document by
    falling doc_id. Rows that aren't own are copies of the first document of the next range; nth orders a range's rows."""
    spark = docs.sparkSession
    parts = 2 * wide_partitions(spark)
    ranges = RANGES * parts
    found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    cuts = sorted(set(found or []))
    array = lambda ids: F.from_json(F.lit(str(list(map(int, ids)))), "array<bigint>")  # noqa: E731  a constant
    below = lambda ids: F.size(F.filter(ids, lambda c: c < F.col("doc_id")))
    coarse = STEP * below(array(cuts[STEP - 1 :: STEP]))
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(coarse + below(F.slice(array(cuts), coarse + 1, F.lit(STEP))))
    # each range's first document also goes to the range above, the very first one to the lowest range
    tops = sorted((r["range"], r["top"]) for r in docs.groupBy(at.alias("range")).agg(F.max("doc_id").alias("top")).collect())
    goes = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    copies = spark.createDataFrame(goes, "top long, extra int")
    place = lambda r, own: F.struct(r.cast("int").alias("range"), F.lit(own).alias("own"))
    places = F.filter(F.array(place(at, True), F.when(F.col("extra").isNotNull(), place(F.col("extra"), False))), lambda x: x.isNotNull())
    dealt = (
        docs.select("doc_id", text_of().alias("text"))
        .join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("top")), "left")
        .select(F.explode(places).alias("place"), "doc_id", "text")
        .select("place.range", "place.own", "doc_id", "text")
        .repartition(parts, "range")
    )
    falling = Window.partitionBy("range").orderBy(F.desc("own"), F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return dealt.select("range", F.row_number().over(falling).alias("nth"), "own", "doc_id", "text", F.lead("text").over(falling).alias("next_text"))


def half_replaced(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as much of the start of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = with_next(docs).withColumn("edited", F.when(F.col("own"), half_replaced(F.col("text"), F.col("next_text"))))
    kind = lambda at, text: F.struct(F.lit(at).alias("kind"), F.col(text).alias("text"))
    kinds = F.filter(F.array(kind(OWN, "text"), kind(EDITED, "edited")), lambda k: k["text"].isNotNull())
    texts = base.select("range", "nth", F.explode(kinds).alias("k")).select("range", "nth", "k.kind", "k.text")
    facts = base.select("range", "nth", "own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    done = facts.join(pair_fingerprints(texts, ["range", "nth"], samples), ["range", "nth"])
    done = done.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("nth")))
    result = done.filter("own").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
    # rows stay in their range: the join by (range, nth) needs no shuffle if the range alone may deal the rows
    with settings(docs.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return staged(result, "weighted-minhash")
