"""Near duplicates by word shingles: SimHash fingerprints long enough to tell a similarity, the binary trie join, exact checks.

Texts are reduced to distinct sets of shingles. A long fingerprint has 64 * LONG_WORDS bits, whose differences are near their
expected number, so pairs up to a budget above it are candidates. Blocks of bits deal the fingerprints into groups; there are
so many blocks that one brings a pair at the similarity together with BLOCK_RECALL. Every link has its shingles compared
exactly. Three rounds keep the pairs that are written in proportion to the rows, however large a cluster is:

1. In the groups of a few blocks each row is compared with the row beside it in fingerprint order; what is alike is contracted.
2. In all groups the tries are walked; of its candidates outside its part each row keeps the IN_GROUP nearest of each group and
   the NEAREST of all.
3. A pair that round 2 left out has two rows which both had more candidates than they kept. Those rows are walked once more with
   the parts that they belong to by now, and those that still have a candidate outside meet in the same groups with their sets of
   shingles: every such pair is compared within the task, and only the links that connect something come out.

Texts of SHORT shingles or fewer vary too much in their bits; they come from an exact join on their rarest shingles instead.
Groups that stay large after a second deal are cut into chunks that are joined pair by pair, which is exact and bounds a task.

Defined cases: those of simhash; columns other than those of documents are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, ROW_HASH, if_short, row_hash, sliced, staged, text_of, wide_partitions
from .simhash import GROUP_LIMIT, components, fold, group_chunks, shingle_hashes, split_groups

#: Words of 64 bits in a long fingerprint, and the part of the linked pairs that some block of bits has to bring together.
LONG_WORDS, BLOCK_RECALL = 8, 0.999
#: Blocks of the first round, and candidates that a row keeps in the second, of one group and of all.
EARLY_BLOCKS, IN_GROUP, NEAREST = 3, 2, 8
#: Up to so many shingles texts are found by an exact join, as the bits of few shingles vary too much; rows of a group of that
#: join that are compared at once.
SHORT, SHORT_ROWS = 48, 20_000
#: Rows with their sets of shingles that are compared at once in the last round.
SET_ROWS = 4_000
#: Bits that split trie nodes; below, nodes are split in the middle.
SPLIT_BITS = 128


def _unite_by(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_unite that returns the pairs (i, j) it needed, a forest."""
    used = []
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))] if len(order) else order
        label[high[first]] = low[first]
        used.append(np.stack((i[first], j[first])))
        while (label != (up := label[label])).any():
            label[:] = up
    return np.concatenate(used, axis=1) if used else np.zeros((2, 0), np.int64)


def expected_bits(similarity: float) -> tuple[float, float]:
    """Part of the bits that differ between sets of equal size with this Jaccard similarity, and its standard deviation in
    one bit: the angle of the two sets over pi."""
    part = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return part, math.sqrt(part * (1 - part))


def differing_part(n: int, m: int, shared: int) -> float:
    """Part of the bits that differ in the mean between sets of n and m hashes, ties counted as they are: a bit of the shared
    ones is set in x of them, and each set's others decide the rest on their own."""
    weights = lambda k: np.array([math.comb(k, x) / 2**k for x in range(k + 1)])
    at = np.arange(shared + 1)

    def set_bit(total: int) -> np.ndarray:
        above = np.append(np.cumsum(weights(total - shared)[::-1])[::-1], 0.0)
        return above[np.clip(total // 2 + 1 - at, 0, total - shared + 1)]

    a, b = set_bit(n), set_bit(m)
    return float((weights(shared) * (a * (1 - b) + b * (1 - a))).sum())


def long_bits(similarity: float) -> tuple[float, float]:
    """expected_bits, but of the worst pair at the similarity with more than SHORT shingles; more shingles differ less."""
    part = expected_bits(similarity)[0]
    for n in range(SHORT + 1, SHORT + 9):
        for m in range(n, int(n / similarity + 1e-9) + 1):
            shared = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            if shared <= n:
                part = max(part, differing_part(n, m, shared))
    return part, math.sqrt(part * (1 - part))


def long_fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """LONG_WORDS fingerprints for each run of hashes, each from another mixing of the hashes."""
    out = np.zeros((len(counts), LONG_WORDS), np.uint64)
    for k in range(LONG_WORDS):
        h = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = fold(h ^ (h >> np.uint64(32)), counts)
    return out


def _sets(texts: list, words: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in texts]


def long_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_hash, print (binary), size (different shingles), set_a and set_b (hashes of the shingles) of every whole text."""

    def run(batches):
        for batch in sliced(batches):
            sets = _sets(batch.column("text").to_pylist(), words)
            counts = np.fromiter(map(len, sets), np.int64, len(sets))
            prints = long_fold(np.concatenate(sets) if sets else np.zeros(0, np.uint64), counts)
            binary = pa.array([row.tobytes() for row in prints], pa.binary())
            whole = [pa.array(np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets), np.uint64, len(sets)).view(np.int64)) for seed in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), binary, pa.array(counts), *whole], names=["doc_id", "row_hash", "print", "size", "set_a", "set_b"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row_hash"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, row_hash {ROW_HASH}, print binary, size long, set_a long, set_b long")


def _print_words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LONG_WORDS)


def block_bits(width: int, similarity: float, seed: int) -> np.ndarray:
    """The bits of each block. There are so many blocks that a pair at the similarity agrees on one with BLOCK_RECALL."""
    agree = (1 - long_bits(similarity)[0]) ** width
    blocks = math.ceil(math.log(1 - BLOCK_RECALL) / math.log(1 - agree))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(64 * LONG_WORDS, width, replace=False) for _ in range(blocks)])


def _deal(rows: DataFrame, bits: np.ndarray, keys_only: bool = False) -> DataFrame:
    """Each row once for each block under a key of the block's bits (and of the key that it has already)."""
    names = [c for c in rows.columns if c != "key"]
    schema = ", ".join(["key long", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)])

    def run(batches):
        weights = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
        for batch in sliced(batches, 500, 1):
            held = np.unpackbits(_print_words(batch.column("print")).view(np.uint8), axis=1).astype(np.uint64)
            key = np.stack([held[:, b] @ weights for b in bits], axis=1) + (np.arange(len(bits), dtype=np.uint64) << np.uint64(40))
            if "key" in batch.schema.names:
                key ^= batch.column("key").to_numpy().view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            key = pa.array((key ^ (key >> np.uint64(27))).reshape(-1).view(np.int64))
            if keys_only:
                yield pa.RecordBatch.from_arrays([key], names=["key"])
                continue
            at = np.repeat(np.arange(batch.num_rows), len(bits))
            step = max(1, int(len(at) * (1 << 21) / max(batch.nbytes * len(bits), 1)))
            for a in range(0, len(at), step):
                part = pa.array(at[a : a + step])
                yield pa.RecordBatch.from_arrays([key.slice(a, step), *(batch.column(c).take(part) for c in names)], names=["key", *names])

    return rows.mapInArrow(run, "key long" if keys_only else schema)


def _pairs_within(prints: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and their differing bits; a pair goes at the word where it exceeds the budget."""
    bits = np.zeros(len(i), np.int64)
    for k in range(LONG_WORDS):
        bits = bits + np.bitwise_count(prints[i, k] ^ prints[j, k])
        near = bits <= most
        i, j, bits = i[near], j[near], bits[near]
    return i, j, bits


def trie_walk(label: np.ndarray, group: np.ndarray, prints: np.ndarray, sizes: np.ndarray, most: int, ratio: float, chunk: int = 5_000):
    """Yields all pairs (i, j, bits) of one group of up to most bits whose labels differ and whose sizes allow the ratio. Rows are
    sorted by group and print. The caller may unite labels (by lowering them in place) between the pairs it gets."""
    n = len(prints)
    ones = np.zeros((SPLIT_BITS, n + 1), np.int32)
    for d in range(SPLIT_BITS):
        np.cumsum((prints[:, d // 64] >> np.uint64(63 - d % 64)) & np.uint64(1), out=ones[d, 1:])
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], n)
    starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
    changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int16))]
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
            # a node meets itself both ways round
            apart = (label[i] != label[j]) & ((i < j) | (np.repeat(la != lb, pairs)))
            i, j, bits = _pairs_within(prints, i[apart], j[apart], most)
            if len(i):
                fits = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j]) - 1e-9
                yield np.stack((i, j, bits))[:, fits]
        if not deep.any():
            continue
        a, ae, b, be, err = (x[deep] for x in (a, ae, b, be, err))
        if d < SPLIT_BITS:
            am, bm = ae - (ones[d, ae] - ones[d, a]), be - (ones[d, be] - ones[d, b])
        else:
            am, bm = (a + ae) // 2, (b + be) // 2
        step = np.int16(d < SPLIT_BITS)
        same = (a == b) & (ae == be)
        children = [(a, am, b, bm, err), (am, ae, bm, be, err), (a, am, bm, be, err + step)]
        children.append(tuple(x[~same] for x in (am, ae, b, bm, err + step)))
        a, ae, b, be, err = (np.concatenate(x) for x in zip(*children, strict=True))
        keep = (ae > a) & (be > b) & (err <= most)
        if keep.any():
            stack.append((d + 1, *(x[keep] for x in (a, ae, b, be, err))))


def most_bits(similarity: float) -> int:
    """Bits up to which a pair is a candidate: four deviations above what a pair at the similarity differs in."""
    part, deviation = long_bits(similarity)
    total = 64 * LONG_WORDS
    return int(part * total + 4 * deviation * math.sqrt(total))


def block_width(rows: int) -> int:
    """Bits of a block: a group of random prints has about 2 ** 11 of them, however many there are."""
    return max(13, math.ceil(math.log2(max(rows, 2))) - 11)


def long_groups(prints: DataFrame, similarity: float, width: int, limit: int = GROUP_LIMIT):
    """A function that deals rows with the columns of prints (and others) into the groups of prints."""
    bits = block_bits(width, similarity, 1)
    prints = prints.select("node", "print")
    large = staged(_deal(prints, bits, keys_only=True).groupBy("key").count().filter(F.col("count") > limit).select("key"), "similar-large")
    if large.isEmpty():
        return lambda rows: _deal(rows, bits)

    def again(rows: DataFrame) -> DataFrame:
        keyed = _deal(rows, bits)
        sub = _deal(keyed.join(large, "key", "left_semi").select(keyed.columns), block_bits(width, similarity, 2))
        return keyed.join(large, "key", "left_anti").select(keyed.columns).unionByName(sub)

    chunks = group_chunks(again(prints), limit)
    return lambda rows: split_groups(again(rows), "node", chunks)


def _by_groups(dealt: DataFrame, work, rows_at_once: int, schema: str) -> DataFrame:
    """work(table of whole groups) yields record batches; groups are worked off as soon as there are enough rows."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:  # sorted by key
            held.append(batch)
            rows += batch.num_rows
            if rows >= rows_at_once:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from work(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows = table.num_rows - cut
        if held and rows:
            yield from work(pa.Table.from_batches(held))

    parts = wide_partitions(dealt.sparkSession)
    return dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def _by_print(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    words = _print_words(table.column("print"))
    order = np.lexsort((*(words[:, k] for k in reversed(range(LONG_WORDS))), table.column("key").to_numpy()))
    return table.take(pa.array(order)), words[order]


def _sized(words: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    fits = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j]) - 1e-9
    return _pairs_within(words, i[fits], j[fits], most)[:2]


def beside_pairs(dealt: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, other): within the budget, and next to each other in a group in the order of the fingerprints. Groups may be
    worked off in pieces, so their size doesn't matter."""
    most = most_bits(similarity)

    def run(batches):
        for batch in batches:
            table, words = _by_print(pa.Table.from_batches([batch]))
            key, node, sizes = (table.column(c).to_numpy() for c in ("key", "node", "size"))
            i = np.flatnonzero(key[1:] == key[:-1])
            i, j = _sized(words, sizes, i, i + 1, most, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["node", "other"])

    parts = wide_partitions(dealt.sparkSession)
    ordered = dealt.repartition(parts, "key", F.substring("print", 1, 1)).sortWithinPartitions("key", "print")
    return ordered.mapInArrow(run, "node long, other long").filter("node != other").distinct()


def _nearest(i: np.ndarray, j: np.ndarray, bits: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs are among the keep nearest of their row i, and the place of each in it, from 0."""
    order = np.lexsort((j, bits, i))
    rank = np.arange(len(i)) - np.searchsorted(i[order], i[order], "left")
    return order[rank < keep], rank[rank < keep]


def nearest_pairs(dealt: DataFrame, similarity: float, keep: int = IN_GROUP, limit: int = GROUP_LIMIT) -> DataFrame:
    """dealt: key, node, print, size, root. Rows (node, other, bits, more): of each row's candidates with another root the keep
    nearest of each group, and whether there are more."""
    most = most_bits(similarity)

    def work(table):
        table, words = _by_print(table)
        node, key = table.column("node").to_numpy(), table.column("key").to_numpy()
        label = _labels(table.column("root").to_numpy())
        found = np.zeros((3, 0), np.int64)
        for i, j, bits in trie_walk(label, key, words, table.column("size").to_numpy(), most, similarity):
            found = np.concatenate((found, [i, j, bits], [j, i, bits]), axis=1)
            if found.shape[1] > 1_000_000:
                found = found[:, _nearest(*found, keep + 1)[0]]
        at, rank = _nearest(*found, keep + 1)
        many = np.zeros(len(node), bool)
        many[found[0, at[rank == keep]]] = True
        i, j, bits = found[:, at[rank < keep]]
        for a in range(0, len(i), 1 << 16):
            s = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(node[i[s]]), pa.array(node[j[s]]), pa.array(bits[s]), pa.array(many[i[s]])], names=["node", "other", "bits", "more"])

    return _by_groups(dealt, work, min(limit, 20_000), "node long, other long, bits long, more boolean")


def apart_rows(dealt: DataFrame, similarity: float, limit: int = GROUP_LIMIT) -> DataFrame:
    """node of the rows that have a candidate with another root."""
    most = most_bits(similarity)

    def work(table):
        table, words = _by_print(table)
        found = np.zeros(table.num_rows, bool)
        for i, j, _ in trie_walk(_labels(table.column("root").to_numpy()), table.column("key").to_numpy(), words, table.column("size").to_numpy(), most, similarity):
            found[i], found[j] = True, True
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(table.column("node").to_numpy()[found]))], names=["node"])

    return _by_groups(dealt, work, min(limit, 20_000), "node long").distinct()


def compared_links(dealt: DataFrame, similarity: float, limit: int = SET_ROWS) -> DataFrame:
    """dealt: key, node, print, size, root, shingles. Rows (node, other) at least similarity alike, which connect what all such
    pairs of a group within the budget and between different roots connect."""
    most = most_bits(similarity)

    def work(table):
        table, words = _by_print(table)
        node, sizes = table.column("node").to_numpy(), table.column("size").to_numpy()
        label = _labels(table.column("root").to_numpy())
        column = table.column("shingles").combine_chunks()
        code = np.unique(column.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        held, used = np.zeros(len(code), bool), [np.zeros((2, 0), np.int64)]
        for i, j, _ in trie_walk(label, table.column("key").to_numpy(), words, sizes, most, similarity):
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for a, b in zip(*_runs(i), strict=True):
                x, others = i[a], j[a:b]
                others = others[label[others] != label[x]]
                if not len(others):
                    continue
                own = code[starts[x] : starts[x] + sizes[x]]
                held[own] = True
                n = sizes[others]
                ends = np.cumsum(n)
                shared = np.add.reduceat(held[code[np.repeat(starts[others] - (ends - n), n) + np.arange(ends[-1])]].astype(np.int64), ends - n)
                held[own] = False
                near = others[shared >= similarity * (sizes[x] + n - shared) - 1e-9]
                used.append(_unite_by(label, np.full(len(near), x), near))
        i, j = np.concatenate(used, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["node", "other"])

    return _by_groups(dealt, work, limit, "node long, other long").distinct()


def _labels(root: np.ndarray) -> np.ndarray:
    """For each row the first row of its root."""
    _, first, code = np.unique(root, return_index=True, return_inverse=True)
    return first[code]


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
    return cuts[:-1].tolist(), cuts[1:].tolist()


def shingle_sets(docs: DataFrame, words: int, key: str) -> DataFrame:
    """key, shingles: the different hashes of every whole text."""

    def run(batches):
        for batch in sliced(batches):
            sets = [s.view(np.int64) for s in _sets(batch.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sets, pa.list_(pa.int64()))], names=[key, "shingles"])

    return docs.select(key, text_of().alias("text")).mapInArrow(run, f"{key} long, shingles array<long>")


def sets_of(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles for wanted (node, row_hash)."""
    wanted = staged(wanted, "simhash-ends")
    texts = rows.withColumn("row_hash", row_hash()).join(if_short(wanted), "row_hash").select("node", "text")
    return staged(shingle_sets(texts, words, "node").dropDuplicates(["node"]), "simhash-sets")


def alike(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (node, other) whose shingles, compared exactly, are at least similarity alike."""
    ends = pairs.select("node").unionByName(pairs.select(F.col("other").alias("node"))).distinct()
    sets = sets_of(rows, nodes.join(ends, "node", "left_semi").select("node", "row_hash"), words)
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("shingles").alias("others")), "other")
    shared = F.size(F.array_intersect("shingles", "others"))
    return both.filter(shared >= similarity * (F.size("shingles") + F.size("others") - shared) - 1e-9).select("node", "other")


def set_forest(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Pairs (i, j) of sets at least similarity alike that connect what all such pairs connect."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    table = np.full((len(sets), sizes.max()), flat.max() + 1)
    table[np.arange(sizes.max()) < sizes[:, None]] = flat
    label, held, used = np.arange(len(sets)), np.zeros(flat.max() + 2, bool), []
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(others):
            continue
        own = table[i, : sizes[i]]
        held[own] = True
        shared = held[table[others]].sum(axis=1)
        held[own] = False
        near = others[shared >= similarity * (sizes[i] + sizes[others] - shared) - 1e-9]
        used.append(_unite_by(label, np.full(len(near), i), near))
    return np.concatenate([np.zeros((2, 0), np.int64), *used], axis=1)


def short_links(sets: DataFrame, similarity: float, limit: int = SHORT_ROWS) -> DataFrame:
    """sets: node, shingles. Rows (node, other) at least similarity alike that connect what all such pairs connect: two such
    sets share one of their rarest shingles, as many as each may lack and one more."""
    each = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    shared = each.join(each.groupBy("shingle").count().filter("count > 1"), "shingle")
    rarest = shared.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("found"))
    # shingles that no other set has come first
    lacks = F.size("found") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1
    first = rarest.filter(lacks > 0).select("node", F.explode(F.slice("found", F.lit(1), lacks)).alias("of")).select("node", F.col("of.shingle").alias("key"))
    first = staged(first, "simhash-rarest")
    dealt = split_groups(first, "node", group_chunks(first, limit)).join(sets, "node").select("key", "node", "shingles")

    def pairs(table):
        key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
        column = table.column("shingles").combine_chunks()
        values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        links = [np.zeros((2, 0), np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                begin = ends[a - 1] if a else 0
                links.append(a + set_forest(np.split(values[begin : ends[b - 1]], ends[a : b - 1] - begin), similarity))
        i, j = np.concatenate(links, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["node", "other"])

    return _by_groups(dealt, pairs, limit, "node long, other long").distinct()


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, keep: int = NEAREST, in_group: int = IN_GROUP, limit: int = GROUP_LIMIT) -> DataFrame:
    """Per document: doc_id, row_hash, root, component_id: the least doc_id within reach over links of a Jaccard similarity of
    word shingles of at least similarity. Rows of one root belong together."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    marked = staged(long_fingerprints(rows, words), "similar-prints")
    of_set = marked.groupBy("set_a", "set_b").agg(F.first("print").alias("print"), F.first("size").alias("size"), F.min("doc_id").alias("least"), F.min("row_hash").alias("row_hash"))
    nodes = staged(of_set.withColumn("node", F.monotonically_increasing_id()), "similar-nodes")
    few = nodes.filter(F.col("size") <= SHORT / similarity + 1e-9)
    short = staged(short_links(sets_of(rows, few.select("node", "row_hash"), words), similarity), "similar-short")
    many = nodes.filter(F.col("size") > SHORT).select("node", "print", "size")

    def rooted(edges: DataFrame) -> DataFrame:
        roots = components(edges, "node")
        return nodes.select("node", "print", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    width = block_width(many.count())
    early = staged(beside_pairs(_deal(many, block_bits(width, similarity, 1)[:EARLY_BLOCKS]), similarity), "similar-beside")
    edges = staged(alike(rows, nodes, early, words, similarity), "similar-early").unionByName(short)
    placed = staged(rooted(edges).filter(F.col("size") > SHORT), "similar-rooted")
    deal = long_groups(many, similarity, width, limit)
    found = nearest_pairs(deal(placed), similarity, in_group, limit).groupBy("node", "other", "bits").agg(F.bool_or("more").alias("more"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("bits", "other")))
    ranked = staged(ranked.filter((F.col("rank") <= keep + 1) | F.col("more")), "similar-ranked")
    chosen = ranked.filter(F.col("rank") <= keep).select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()
    fresh = staged(chosen.join(early, ["node", "other"], "left_anti"), "similar-fresh")
    edges = edges.unionByName(staged(alike(rows, nodes, fresh, words, similarity), "similar-near"))
    final = staged(rooted(edges).select("node", "root"), "similar-roots")
    more = ranked.filter((F.col("rank") > keep) | F.col("more")).select("node").distinct()
    left = many.join(more, "node", "left_semi").join(final, "node")
    apart = staged(apart_rows(deal(staged(left, "similar-left")), similarity, limit), "similar-apart")
    if not apart.isEmpty():
        sets = sets_of(rows, nodes.join(apart, "node", "left_semi").select("node", "row_hash"), words)
        whole = staged(many.join(final, "node").join(sets, "node"), "similar-whole")
        links = staged(compared_links(long_groups(whole, similarity, width, SET_ROWS)(whole), similarity), "similar-last")
        if not links.isEmpty():
            final = staged(rooted(edges.unionByName(links)).select("node", "root"), "similar-roots")
    ids = nodes.select("node", "least").join(final, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("node", "set_a", "set_b").join(final, "node").join(ids, "root")
    return marked.join(staged(named.select("set_a", "set_b", "root", "component_id"), "similar-named"), ["set_a", "set_b"]).select("doc_id", "row_hash", "root", "component_id")
