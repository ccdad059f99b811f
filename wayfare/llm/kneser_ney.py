"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model trained on trusted text.

The model is of characters: an n-gram is ORDER UTF-16 code units of BITS bits each, one long. A code point above 0xFFFF is two
units, so no two of them are one symbol; digits are one symbol and so is white space (and U+0000 is U+0001). Every count table follows the corpus: trusted text gives the counts,
lower orders count what stands before, discounts follow from the counts of counts of each order. Totals of contexts, lower
orders and the n-grams that the corpus holds are joined by sharded equi-joins into one logarithm for each n-gram of the corpus.

Documents meet that table in a join as well, by n-gram: each sends its own counts of n-grams, and the logarithms are summed by
document. A few n-grams are in most documents and would be hot keys of that join, so the HOT most frequent ones of the corpus
(a fixed number) go to all tasks instead and are summed where the text is read; the rest is spread thinly over its keys.

One half of the trusted documents trains the model. The other half, which it hasn't seen, sets the thresholds: a document is
rejected if its perplexity, drawn to its language's average if it is short, is above a high quantile of that language's held
out documents, times a margin. Languages without any use the quantile over all of them.

Defined cases: a null or empty text has no perplexity and is kept; a null language is a language of its own; labels that are
null or of unknown documents are ignored, a document labelled twice is trusted if one label says so; without trusted documents
all are kept; where one half is empty the other stands for it; repeated rows are scored each; very long texts are counted in
slices; an empty table gives an empty result. Only named columns are read, so others can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_HASH, row_hash, sliced, staged, text_of

ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
#: N-grams that all tasks hold (12 bytes each), and different n-grams that a counting task holds before it sends them.
HOT, HELD = 1 << 16, 1_000_000
#: Symbols whose n-grams are sorted at once.
SLICE = 1 << 19
#: Labels that are broadcast at most; beyond that documents and labels are joined by shuffle.
BROADCAST_IDS = 1_000_000
QUANTILE, MARGIN = 0.99, 1.03
#: Perplexities are rounded to so many decimals where their quantiles are taken.
DECIMALS = 3
#: A text is judged as if it had so many more symbols of its language's average, so that a few words alone don't decide.
PRIOR_SYMBOLS = 160


def symbols_of(text: str) -> np.ndarray:
    """UTF-16 code units with digits and white space folded; zero stands before a text only."""
    found = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    found[(found >= 48) & (found <= 57)] = 48
    found[(found >= 9) & (found <= 13)] = 32
    return np.maximum(found, 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, one for each symbol, and how many each text has."""
    parts = [symbols_of(t) for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    pad = np.zeros(ORDER - 1, np.uint64)
    symbols = np.concatenate([x for part in parts for x in (pad, part)]) if parts else pad
    if len(symbols) < ORDER:
        return np.zeros(0, np.int64), counts
    codes = symbols[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        codes |= symbols[ORDER - 1 - k : len(symbols) - k] << np.uint64(BITS * k)
    # what ends in the padding before the next text isn't a text's n-gram
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(counts + ORDER - 1)[:-1]
    for k in range(ORDER - 1):
        keep[ends - (ORDER - 1) + k] = False
    return codes[keep].view(np.int64), counts


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, n over the texts; a task brings its n-grams together before it sends them."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def together():
            code, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

        def sent(code, n):
            for a in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(code[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], names=["gram", "n"])

        for batch in sliced(batches):
            codes, _ = grams(batch.column("text").to_pylist())
            for a in range(0, len(codes), SLICE):
                held.append(np.unique(codes[a : a + SLICE], return_counts=True))
            if sum(len(c) for c, _ in held[1:]) > HELD // 4:
                held = [together()]
                if len(held[0][0]) > HELD:
                    yield from sent(*held.pop())
        if held:
            yield from sent(*together())

    return docs.select(text_of().alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Of n-grams that were seen once, twice and more often."""
    row = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5))).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in range(1, 5))
    if not (n1 and n2 and n3):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    bounded = lambda d, most: min(max(d, 0.01), most - 0.01)
    return bounded(1 - 2 * y * n2 / n1, 1), bounded(2 - 3 * y * n3 / n2, 2), bounded(3 - 4 * y * n4 / n3, 3)


def _suffix(order: int) -> Column:
    """The last so many symbols of gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))


def model(trusted_counts: DataFrame, corpus_grams: DataFrame) -> DataFrame:
    """gram, logp for every n-gram of corpus_grams."""
    level = {ORDER: trusted_counts}
    for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before
        level[k] = level[k + 1].groupBy(_suffix(k).alias("gram")).agg(F.count("*").alias("n"))
    wanted = {ORDER: corpus_grams.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(_suffix(k).alias("gram")).distinct()
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        level[k] = staged(level[k], f"kn-counts-{k}")
        cut = discounts(level[k])
        off = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        context = F.shiftrightunsigned("gram", BITS).alias("context")
        totals = level[k].groupBy(context).agg(F.sum("n").alias("total"), F.sum(off).alias("saved"))
        own = level[k].select("gram", (F.col("n") - off).alias("kept"))
        joined = wanted[k].join(own, "gram", "left").withColumn("context", F.shiftrightunsigned("gram", BITS)).join(totals, "context", "left")
        if lower is None:
            base = joined.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            base = joined.withColumn("suffix", _suffix(k - 1)).join(lower.withColumnsRenamed({"gram": "suffix", "p": "below"}), "suffix")
        p = F.coalesce(F.col("kept") / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("saved") / F.col("total"), F.lit(1.0)) * F.col("below")
        lower = base.select("gram", p.alias("p"))
    return lower.select("gram", F.ln("p").alias("logp"))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    small = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(good) if small else good, "doc_id", "left_semi")


def _trains() -> Column:
    """One half of the documents, by doc_id."""
    return F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0


def _half(trusted: DataFrame, wanted: Column) -> DataFrame:
    half = trusted.filter(wanted)
    return trusted if half.isEmpty() else half


def document_grams(docs: DataFrame, hot: pa.Table) -> DataFrame:
    """Per document: number (of the row), doc_id, row_hash, lang, symbols, surprise (minus the logarithms of its hot n-grams) and
    rest, its other n-grams with their counts. Numbers are fixed once the table is written."""
    order = np.argsort(hot.column("gram").to_numpy())
    keys, values = hot.column("gram").to_numpy()[order], hot.column("logp").to_numpy()[order].astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((keys, values))
    schema = f"number long, doc_id long, row_hash {ROW_HASH}, lang string, symbols long, surprise double, grams array<long>, counts array<long>"

    def lookup(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = shared.value
        distinct, where = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        known = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
        logp = np.where(known, values[at] if len(keys) else 0.0, 0.0)
        return logp[where], ~known[where]

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            codes, counts = grams(batch.column("text").to_pylist())
            logp, other = np.zeros(len(codes)), np.zeros(len(codes), bool)
            for a in range(0, len(codes), SLICE):
                logp[a : a + SLICE], other[a : a + SLICE] = lookup(codes[a : a + SLICE])
            out = np.zeros(len(counts))
            full = np.flatnonzero(counts)
            if len(full):
                out[full] = -np.add.reduceat(logp, (np.cumsum(counts) - counts)[full])
            doc, gram = np.repeat(np.arange(len(counts)), counts)[other], codes[other]
            order = np.lexsort((gram, doc))
            doc, gram = doc[order], gram[order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])))) if len(doc) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(doc)))
            offsets = pa.array(np.searchsorted(doc[first], np.arange(len(counts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (gram[first], n)]
            numbers = pa.array(number + np.arange(batch.num_rows))
            number += batch.num_rows
            kept = [batch.column(c) for c in ("doc_id", "row_hash", "lang")]
            yield pa.RecordBatch.from_arrays([numbers, *kept, pa.array(counts), pa.array(out), *lists], names=["number", "doc_id", "row_hash", "lang", "symbols", "surprise", "grams", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row_hash"), "lang", text_of().alias("text"))
    return rows.mapInArrow(run, schema)


def perplexities(docs: DataFrame, trusted: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, row_hash, lang, symbols, surprise (minus the sum of the logarithms)."""
    learned = staged(count_grams(trusted), "kn-trusted")
    corpus = staged(count_grams(docs), "kn-corpus")
    table = staged(model(learned, corpus).join(corpus, "gram"), "kn-model")
    frequent = table.orderBy(F.desc("n"), "gram").limit(hot).select("gram", "logp").toArrow()  # so many rows at most
    found = staged(document_grams(docs, frequent), "kn-documents")
    each = found.select("number", F.explode(F.arrays_zip("grams", "counts")).alias("g")).select("number", F.col("g.grams").alias("gram"), F.col("g.counts").alias("times"))
    rest = each.join(table.select("gram", "logp"), "gram").groupBy("number").agg(F.sum(F.col("times") * F.col("logp")).alias("rest"))
    summed = found.join(staged(rest, "kn-rest"), "number", "left")
    return summed.select("doc_id", "row_hash", "lang", "symbols", (F.col("surprise") - F.coalesce("rest", F.lit(0.0))).alias("surprise"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, row_hash, lang, perplexity, adjusted_perplexity, threshold (its language's), kept."""
    scored = staged(perplexities(docs, _half(trusted_documents(docs, labels), _trains())), "kn-scored")
    trusted = _half(trusted_documents(scored, labels).filter("symbols > 0"), ~_trains())
    mean = F.sum("surprise") / F.sum("symbols")
    adjusted = F.exp((F.col("surprise") + PRIOR_SYMBOLS * F.col("mean")) / (F.col("symbols") + PRIOR_SYMBOLS))
    general = trusted.agg(mean.alias("mean")).first()["mean"]
    means = staged(trusted.groupBy(F.col("lang").alias("of")).agg(mean.alias("own_mean")), "kn-means")

    def with_adjusted(rows: DataFrame) -> DataFrame:
        joined = rows.join(means, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
        return joined.withColumn("mean", F.coalesce("own_mean", F.lit(general).cast("double"))).withColumn("adjusted", F.when(F.col("symbols") > 0, adjusted))

    # of rounded values: a language has few different ones, and the quantile is the same whatever the order of the tasks
    value = F.percentile(F.round("adjusted", DECIMALS), quantile) * margin
    high = with_adjusted(trusted)
    thresholds = staged(high.groupBy(F.col("lang").alias("of")).agg(value.alias("own")), "kn-thresholds")
    over_all = high.agg(value.alias("own")).first()["own"]
    joined = with_adjusted(scored).join(thresholds, F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("own", F.lit(over_all).cast("double"))
    kept = F.coalesce(F.col("adjusted") <= threshold, F.lit(True))
    perplexity = F.when(F.col("symbols") > 0, F.exp(F.col("surprise") / F.col("symbols")))
    return joined.select("doc_id", "row_hash", "lang", perplexity.alias("perplexity"), F.col("adjusted").alias("adjusted_perplexity"), threshold.alias("threshold"), kept.alias("kept"))
