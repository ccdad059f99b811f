"""Ranked lexical search: summed accumulators of short lists, then document-at-a-time skipping over the long ones.

Terms are runs of ASCII letters and digits and of all characters above 0x7F, with A-Z lower-cased. A document's score is the sum
over an item's terms of w * ((10^9 * tf) div (1000 * tf + 8 * m)), all in whole numbers: see weight() and length_norm().

Documents are read once: each becomes a narrow row of its number of terms and of the query terms that it holds (its postings).
N, L and document frequencies are sums of these. Blocks of such rows are then searched side by side; each turns its postings into
lists by term, every list with its largest impact for each window of documents. For an item,

* term at a time: its shortest lists, as far as they hold SHORT_SHARE of the documents together, are summed into accumulators;
* document at a time: the accumulators are one more list with bounds of its own among the long lists. Windows whose bounds add
  up to less than the k-th best score so far are skipped; in the others only documents of lists that can lift a document over
  it are looked at, and are given up as soon as the bounds of what is left can't.

A first round over the accumulators alone gives every item a floor, the k-th best of its partial sums over all documents: no
score of the result can be below it, so most windows of most blocks are skipped from the start. Everything at or above the
floor is exact, and ties are decided at the end.

Items come in groups of at most GROUP_TERMS terms, which bounds what tasks hold of them; each group is a round of its own.

Defined cases: a null text has no terms; items without terms, and items that no document shares a term with, have no rows; rows
of one item_id are one item with the terms of all (a null item_id is one too); each row of documents is a document, so repeated
rows are found one by one; null doc_ids come last among equal scores; columns other than those named are ignored; empty tables
give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sliced, staged

#: Bytes of text that are cut into terms at once.
RUN_BYTES = 1 << 20
#: Terms of the items of one round.
GROUP_TERMS = 200_000
#: Share of all documents that an item's short lists hold together.
SHORT_SHARE = 1 / 64
#: Postings and documents of a block, documents of a window.
BLOCK_POSTINGS, BLOCK_ROWS, WINDOW = 2_000_000, 1 << 16, 1 << 10

_LETTERS = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in runs of bounded size."""
    plain, start = text.translate(_LETTERS), 0
    while start < len(plain):
        end = plain.find(b" ", start + RUN_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_norm(terms: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    return 10 + (90 * terms * documents) // all_terms


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, terms: a row for each item that has terms."""

    def cut(batches):
        for b in sliced(batches):
            found = [list({t for run in terms_of(x or b"") for t in run}) for x in _texts(b)]
            take = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, found))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(take), pa.array([t for f in found for t in f], pa.binary())], names=["item_id", "term"])

    read = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    id_type = read.schema["item_id"].dataType.simpleString()
    return read.mapInArrow(cut, f"item_id {id_type}, term binary").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def groups_of(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in groups of at most GROUP_TERMS terms, or of one item."""
    group, held = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        if group and held + len(row["terms"]) > GROUP_TERMS:
            yield group
            group, held = [], 0
        group.append((row["item_id"], [bytes(t) for t in row["terms"]]))
        held += len(row["terms"])
    if group:
        yield group


def postings(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n, terms, tfs of every document that has terms: its number of terms, and those of the vocabulary."""

    def count(batches):
        known = vocabulary.get
        for b in sliced(batches):
            sizes, ends, terms, tfs = [], [0], [], []
            for x in _texts(b):
                n, found = 0, Counter()
                for run in terms_of(x or b""):
                    n += len(run)
                    found.update(i for i in map(known, run) if i is not None)
                sizes.append(n)
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes) > 0))

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """Documents with their postings as lists by term. A term's list is at[t] : at[t + 1] of rows and impacts, rows rising."""

    def __init__(self, table: pa.Table, weights: np.ndarray, documents: int, all_terms: int):
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        self.unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy(zero_copy_only=False))
        term, tf = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(term, kind="stable")
        term, tf, self.rows = term[order], tf[order], rows[order]
        m = length_norm(table.column("n").to_numpy().astype(np.int64), documents, all_terms)
        self.impacts = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.rows]))
        self.at = np.searchsorted(term, np.arange(len(weights) + 1))
        self.windows = -(-len(ids) // WINDOW)
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[term], self.at[term + 1])
        return self.rows[part], self.impacts[part]

    def bounds_of(self, rows: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest impact of a list in each window, and where each window begins in it."""
        cuts = np.searchsorted(rows, np.arange(self.windows + 1) * WINDOW)
        most = np.zeros(self.windows, np.int64)
        there = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(there):
            most[there] = np.maximum.reduceat(impacts, cuts[there])
        return most, cuts

    def long_list(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, impacts = self.list_of(term)
        if term not in self.bounds:
            self.bounds[term] = self.bounds_of(rows, impacts)
        return rows, impacts, *self.bounds[term]

    def accumulate(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: rows that one of the terms is in, with their summed impacts."""
        lists = [self.list_of(t) for t in terms]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, impacts = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.argsort(rows, kind="stable")
        rows, impacts = rows[order], impacts[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
        return rows[first], np.add.reduceat(impacts, first) if len(first) else impacts

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > 4 * k:  # all that reach the k-th score
            reach = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[reach], scores[reach]
        order = np.lexsort((self.ids[rows], self.unnamed[rows], -scores))[:k]
        return rows[order], scores[order]

    def search(self, short: list[int], long: list[int], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows whose score is at least the floor, best first."""
        gathered = self.accumulate(short)
        lists = [(*gathered, *self.bounds_of(*gathered))] if len(gathered[0]) else []
        lists += [self.long_list(t) for t in long if self.at[t + 1] > self.at[t]]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not lists:
            return rows, scores
        bounds = np.array([x[2] for x in lists])
        whole = bounds.sum(0)
        floor = max(floor, 1)
        for w in np.flatnonzero(whole >= floor):
            if whole[w] < floor:
                continue
            found = self._in_window(lists, bounds[:, w], int(w), floor)
            rows, scores = self.best(np.concatenate((rows, found[0])), np.concatenate((scores, found[1])), k)
            if len(rows) == k:
                floor = max(floor, int(scores[-1]))
        return rows, scores

    def _in_window(self, lists: list, bounds: np.ndarray, window: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a window whose score is at least the floor."""
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0].tolist()
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the lists from here on can add
        sums = np.zeros(WINDOW, np.int64)
        alive = None
        for nth, i in enumerate(order):
            rows, impacts, _, cuts = lists[i]
            part = slice(cuts[window], cuts[window + 1])
            local, impacts = rows[part] - window * WINDOW, impacts[part]
            if alive is None and rest[nth] < floor:  # a document that only these lists hold can't reach the floor
                alive = np.flatnonzero(sums)
            if alive is None:
                sums[local] += impacts
                continue
            alive = alive[sums[alive] + rest[nth] >= floor]
            if not len(alive):
                return alive, alive
            place = np.minimum(np.searchsorted(local, alive), len(local) - 1)
            sums[alive] += np.where(local[place] == alive, impacts[place], 0)
        alive = np.flatnonzero(sums) if alive is None else alive
        alive = alive[sums[alive] >= floor]
        return alive + window * WINDOW, sums[alive]


def _blocks(batches) -> Iterator[pa.Table]:
    held, rows, entries = [], 0, 0
    for b in sliced(batches, 4096, 8):
        more = len(b.column("terms").flatten())
        if held and (rows + b.num_rows > BLOCK_ROWS or entries + more > BLOCK_POSTINGS):
            yield pa.Table.from_batches(held)
            held, rows, entries = [], 0, 0
        held.append(b)
        rows, entries = rows + b.num_rows, entries + more
    if rows:
        yield pa.Table.from_batches(held)


FOUND = "item int, doc_id long, score long"


def _search_group(docs: DataFrame, group: list[tuple], k: int, doc_id: str, text: str) -> DataFrame:
    """item (place in the group), rank, doc_id, score."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in group for t in terms}))}
    table = staged(postings(docs, vocabulary, doc_id, text), "postings")
    whole = table.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    n, all_terms = whole["documents"], whole["terms"] or 0
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # one for each term of the group at most
        frequency[r["t"]] = r["df"]
    weights = np.array([weight(n, int(df)) for df in frequency], np.int64)
    wanted = []
    for _, terms in group:
        # terms without weight add nothing to any score
        own = sorted((vocabulary[t] for t in terms if frequency[vocabulary[t]] and weights[vocabulary[t]]), key=lambda i: (frequency[i], i))
        short = int(np.searchsorted(np.cumsum(frequency[own]), n * SHORT_SHARE, "right")) if own else 0
        wanted.append((own[:short], own[short:]))

    def rounds(floors: np.ndarray | None):
        def search(batches):
            for rows in _blocks(batches):
                block = Block(rows, weights, n, all_terms)
                for item, (short, long) in enumerate(wanted):
                    found, scores = block.best(*block.accumulate(short), k) if floors is None else block.search(short, long, int(floors[item]), k)
                    if len(found):
                        ids = pa.array(block.ids[found], mask=block.unnamed[found])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item, np.int32)), ids, pa.array(scores)], names=["item", "doc_id", "score"])

        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return table.mapInArrow(search, FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    floors = np.zeros(len(group), np.int64)
    for r in rounds(None).filter(F.col("rank") == k).select("item", "score").collect():  # one row for each item of the group
        floors[r["item"]] = r["score"]
    found = staged(rounds(floors), "ranked")
    discard(table)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of a score above 0."""
    spark = docs.sparkSession
    terms = item_terms(items, item_id, item_text)
    id_type = terms.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for group in groups_of(terms):
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(group)], f"item int, item_id {id_type}")
        found = _search_group(docs, group, k, doc_id, text).join(F.broadcast(names), "item")
        out = out.unionAll(found.select("item_id", "rank", "doc_id", "score"))
    return out
