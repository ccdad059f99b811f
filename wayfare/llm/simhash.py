"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by a binary trie within a Hamming budget.

Fingerprints are made distinct first, so exact copies cost one entry. Two fingerprints within the budget agree on one of
budget + 1 blocks of bits, so each goes to one group per block; a group that is still large is dealt out again by blocks of its
other bits, and if it is large even then, its rows are cut into chunks that are joined pair by pair; both are exact. In a group, fingerprints are a binary trie (ranges of a sorted array): node pairs are
traversed together, differing bits add up, and a pair goes once the budget is exceeded or once all below it is known to be
connected. A group gives the edges of a forest only, never all its pairs. Edges are joined into components by alternating
large-star and small-star steps on tables.

Defined cases: a null text is an empty one; a text without words has fingerprint zero, which links like any other; repeated
rows keep one row each; a null doc_id takes part, but is a component's id only if all its documents have none; an empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, discard, row_hash, sliced, staged, text_of, wide_partitions

BITS = 64
#: Fingerprints of a group that go to one task; larger groups are dealt out by further blocks.
GROUP_LIMIT = 100_000
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (seed 42) of each shingle, repeats included. bytes.lower and bytes.split know ASCII only, as wanted."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pieces = [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return list(map(xxhash.xxh64_intdigest, pieces, repeat(42)))


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts[i] hashes: a bit is 1 if it is set in over half of them; 0 for no hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    begin = np.cumsum(n) - n
    parts = -(-n // 255)  # a byte lane counts to 255
    part_begin = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(part_begin, parts)
    cuts = np.repeat(begin, parts) + 255 * within
    bits = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & LANES, cuts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), part_begin, axis=0)
        for lane in range(8):
            bits |= (2 * ones[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + j)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id") -> DataFrame:
    """key, fingerprint (long) of every whole text."""

    def run(batches):
        for batch in sliced(batches):
            hashes = [np.array(shingle_hashes(t, words), np.uint64) for t in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fold(flat, counts).view(np.int64))], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of().alias("text")).mapInArrow(run, f"{key} {kind}, fingerprint long")


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label[:] = up


def trie_components(group: np.ndarray, prints: np.ndarray, budget: int, chunk: int = 200_000) -> np.ndarray:
    """Labels: equal if linked, over pairs of one group within budget bits. (group, prints) is sorted and without repeats."""
    n = len(prints)
    label = np.arange(n)
    if n < 2:
        return label
    ones = np.zeros((BITS, n + 1), np.int32)
    for d in range(BITS):
        np.cumsum((prints >> np.uint64(BITS - 1 - d)) & np.uint64(1), out=ones[d, 1:])
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    starts, ends = starts[many], ends[many]
    # with a small budget first: most of a cluster is connected then, and the whole budget skips what is
    for most in dict.fromkeys((min(2, budget), budget)):
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
        while stack:
            d, a, ae, b, be, err = stack.pop()
            if len(a) > chunk:
                half = len(a) // 2
                stack += [(d, *(x[half:] for x in (a, ae, b, be, err))), (d, *(x[:half] for x in (a, ae, b, be, err)))]
                continue
            known = (changes[ae - 1] == changes[a]) & (changes[be - 1] == changes[b]) & (label[a] == label[b])
            few = (ae - a) * (be - b) <= 64
            leaf, deep = few & ~known, ~few & ~known
            if leaf.any():
                la, lb, na, nb = a[leaf], b[leaf], (ae - a)[leaf], (be - b)[leaf]
                pairs = na * nb
                at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                width = np.repeat(nb, pairs)
                i, j = np.repeat(la, pairs) + at // width, np.repeat(lb, pairs) + at % width
                near = (i != j) & (np.bitwise_count(prints[i] ^ prints[j]) <= most)
                if near.any():
                    _unite(label, i[near], j[near])
                    changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            if not deep.any() or d == BITS:
                continue
            a, ae, b, be, err = (x[deep] for x in (a, ae, b, be, err))
            am, bm = ae - (ones[d, ae] - ones[d, a]), be - (ones[d, be] - ones[d, b])
            same = a == b
            children = [(a, am, b, bm, err), (am, ae, bm, be, err), (a, am, bm, be, err + 1)]
            children.append(tuple(x[~same] for x in (am, ae, b, bm, err + 1)))
            a, ae, b, be, err = (np.concatenate(x) for x in zip(*children, strict=True))
            keep = (ae > a) & (be > b) & (err <= most)
            if keep.any():
                stack.append((d + 1, *(x[keep] for x in (a, ae, b, be, err))))
    return label


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _block_keys(fingerprint: Column, skip: int, blocks: int, salt: Column) -> Column:
    """A key for each block of the bits outside skip; a key holds the block's bits."""
    free = [b for b in range(BITS) if not skip >> b & 1]
    masks = [sum(1 << b for b in free[len(free) * k // blocks : len(free) * (k + 1) // blocks]) for k in range(blocks)]
    key = lambda k, mask: F.xxhash64(salt, F.lit(k), fingerprint.bitwiseAND(F.lit(_signed(mask))))
    return F.array(*(F.struct(key(k, m).alias("key"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(masks)))


def group_chunks(keyed: DataFrame, limit: int) -> DataFrame:
    """key, chunks of the groups above limit rows; two chunks together have about limit rows."""
    chunks = F.ceil(2 * F.col("count") / limit).cast("int")
    return staged(keyed.groupBy("key").count().filter(F.col("count") > limit).select("key", chunks.alias("chunks")), "simhash-chunks")


def split_groups(keyed: DataFrame, row: str, chunks: DataFrame) -> DataFrame:
    """keyed with its large groups cut into chunks by a hash of row: each pair of chunks is a group of its own, so every pair
    of rows still meets and no task holds more than about the limit, whatever the group's size."""
    if chunks.isEmpty():
        return keyed
    own = F.pmod(F.xxhash64(row), F.col("chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: F.xxhash64("key", F.least(own, d), F.greatest(own, d)))
    keys = F.when(F.col("chunks").isNull(), F.array("key")).otherwise(meets)
    columns = [c for c in keyed.columns if c != "key"]
    return keyed.join(F.broadcast(chunks), "key", "left").select(F.explode(keys).alias("key"), *columns).select(keyed.columns)


def print_groups(prints: DataFrame, budget: int, limit: int) -> DataFrame:
    """key, fingerprint: fingerprints within budget share a key, and no key has many more than limit rows."""
    keyed = prints.select("fingerprint", F.explode(_block_keys(F.col("fingerprint"), 0, budget + 1, F.lit(0))).alias("b")).select("fingerprint", "b.key", "b.mask")
    large = keyed.groupBy("key", "mask").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("key", "mask")
    masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most one for each block
    if not masks:
        return keyed.select("key", "fingerprint")
    held = keyed.join(large.withColumn("large", F.lit(True)), ["key", "mask"], "left")
    again = F.array().cast("array<struct<key:bigint,mask:bigint>>")
    for m in masks:
        again = F.when(F.col("mask") == m, _block_keys(F.col("fingerprint"), m & (1 << BITS) - 1, budget + 1, F.col("key"))).otherwise(again)
    own = F.array(F.struct("key", "mask"))
    keyed = held.select("fingerprint", F.explode(F.when(F.col("large"), again).otherwise(own)).alias("b")).select("b.key", "fingerprint")
    return split_groups(keyed, "fingerprint", group_chunks(keyed, limit))


def links(prints: DataFrame, budget: int = 4, limit: int = GROUP_LIMIT) -> DataFrame:
    """prints: distinct fingerprints. Edges (fingerprint, other) that connect the same fingerprints as all pairs within
    budget do; for each group at most one edge per fingerprint."""
    def run(batches):
        def edges(table):
            group, prints = table.column("key").to_numpy(), table.column("fingerprint").to_numpy().view(np.uint64)
            order = np.lexsort((prints, group))
            group, prints = group[order], prints[order]
            label = trie_components(group, prints, budget)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(prints[moved].view(np.int64)), pa.array(prints[label[moved]].view(np.int64))], names=["fingerprint", "other"])

        held, rows = [], 0
        for batch in batches:  # sorted by key: whole groups are worked off as soon as there are enough
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield edges(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows = table.num_rows - cut
        if held:
            yield edges(pa.Table.from_batches(held))

    parts = wide_partitions(prints.sparkSession)
    return print_groups(prints, budget, limit).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "fingerprint long, other long").distinct()


def components(edges: DataFrame, node: str = "fingerprint", other: str = "other") -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component. Alternating stars: each step
    replaces edges by edges to the least neighbour, until a step changes nothing. Every step is a written table."""
    edge = staged(edges.select(F.greatest(node, other).alias("u"), F.least(node, other).alias("v")).filter("u != v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    seen = mark(edge)
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        stale, edge = edge, staged(small, "edges")
        discard(stale)
        now = mark(edge)
        if now == seen:
            return edge.select(F.col("u").alias(node), F.col("v").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """Per document: doc_id, row_hash, fingerprint (long), component_id, the least doc_id within reach."""
    keyed = docs.select(*DOCUMENT_COLUMNS).withColumn("row_hash", row_hash()).withColumn("key", F.struct("doc_id", "row_hash"))
    marked = staged(fingerprints(keyed, words, "key").select("key.doc_id", "key.row_hash", "fingerprint"), "simhash-prints")
    prints = staged(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(prints.select("fingerprint"), budget))
    placed = prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(placed.join(ids, "root").select("fingerprint", "component_id"), "simhash-named")
    return marked.join(named, "fingerprint").select("doc_id", "row_hash", "fingerprint", "component_id")


def hex_print(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
