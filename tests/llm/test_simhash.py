import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wayfare.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, budget=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    return [min((ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None), default=None) for i in range(len(ids))]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = simhash.near_duplicates(df).select("doc_id", simhash.hex_print(F.col("fingerprint")).alias("fp"), "component_id").collect()
    return sorted(tuple(r) for r in out)


def test_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until night falls on all the hills".split()
    rng = np.random.default_rng(1)
    texts = [" ".join(base), " ".join(base).upper(), "", None, "  \t\n", "one", "one two", "ÀÉ x\x0by", "z " * 3000]
    long = [f"w{i}" for i in rng.integers(0, 400, 600)]
    for k in range(25):
        words = list(long)
        for at in rng.integers(0, 600, k % 6):
            words[at] = f"edit{k}"
        texts.append(" ".join(words))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, None, "en", "s", 0), (None, "one", None, None, None)]
    prints = [plain_print(r[1]) for r in rows]
    expected = sorted((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components([r[0] for r in rows], prints)) if r[0] is not None)
    df = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", simhash.hex_print(F.col("fingerprint")), "component_id")
    found = [tuple(r) for r in df.collect()]
    assert sorted(r for r in found if r[0] is not None) == expected
    assert [r[2] for r in found if r[0] is None] == [5]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_trie_finds_all_links_in_dense_and_sparse_groups():
    rng = np.random.default_rng(5)
    center = rng.integers(0, 2**63, 6, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for c in center for _ in range(120)]
    prints = np.unique(np.array([*near, *rng.integers(0, 2**63, 500, dtype=np.uint64)], np.uint64))
    label = simhash.trie_components(np.zeros(len(prints), np.int64), prints, 4, chunk=300)
    pairs = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, 1))
    expected = np.arange(len(prints))
    while True:
        before = expected.copy()
        for i, j in pairs:
            expected[i] = expected[j] = min(expected[i], expected[j])
        if (before == expected).all():
            break
    assert (label == expected).all()


def test_large_groups_are_dealt_out_again(spark):
    rng = np.random.default_rng(9)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 20, 400), rng.integers(0, 2**62, 200)]))
    df = spark.createDataFrame([(int(x),) for x in prints], "fingerprint long")
    small = simhash.components(simhash.links(df, 4, limit=50)).collect()
    whole = simhash.components(simhash.links(df, 4)).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, whole)) and small


def test_hash_is_sparks_xxhash64(spark):
    text = "ab cd ef gh ij"
    first, second = simhash.shingle_hashes(text, 4)
    row = spark.range(1).select(F.xxhash64(F.lit("ab cd ef gh")).alias("a"), F.xxhash64(F.lit("cd ef gh ij")).alias("b")).first()
    assert [first, second] == [row["a"] % (1 << 64), row["b"] % (1 << 64)]


def edited_texts(seed=3):
    rng = np.random.default_rng(seed)
    texts = ["", None, "one", "one two", "\t \n", "x " * 4000]
    for c in range(12):
        base = [f"w{i}" for i in rng.integers(0, 3000, 60 + 40 * c)]
        texts.append(" ".join(base).upper())
        for k in range(8):
            words = list(base)
            for at in rng.integers(0, len(base), 1 + k * len(base) // 200):
                words[at] = f"edit{rng.integers(0, 99)}"
            texts.append(" ".join(words))
    return texts


def plain_similar(ids, texts, similarity=0.8, k=5):
    """Components over pairs of a Jaccard similarity of at least similarity, and those pairs' limits: all within 0.8 exactly."""
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            shared, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if shared >= similarity * every:
                root[find(i)] = find(j)
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


def test_similar_texts_against_brute_force(spark):
    texts = edited_texts()
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, "one", None, None, None), (7, texts[7], "en", "s", 0)], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_texts(df).collect()}
    assert found.pop(None) == 2
    expected = plain_similar([r[0] for r in rows], texts)
    assert len(set(expected.values())) > 20
    assert found == expected


def test_similar_texts_of_an_empty_table_and_of_clashing_columns(spark):
    assert similar.similar_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(1, "a b", "en", "s", 3, 5, 6, 7)], SCHEMA + ", node long, size long, key long")
    assert [tuple(r)[0::3] for r in similar.similar_texts(odd).select("doc_id", "row_hash", "root", "component_id").collect()] == [(1, 1)]


def test_similar_texts_in_small_pieces_of_groups(spark, monkeypatch):
    monkeypatch.setattr(similar, "SET_ROWS", 10)
    texts = edited_texts(5)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_texts(df, keep=1, in_group=1, limit=10).collect()}
    assert found == plain_similar(range(len(texts)), texts)


def test_a_large_cluster_of_near_copies(spark):
    """Members from 0.99 to 0.3 alike; most of them have more candidates than they keep."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    texts = []
    for k in range(400):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            words[at] = f"edit{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    expected = plain_similar(range(len(texts)), texts)
    assert 1 < len(set(expected.values())) < 400
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_texts(df, keep=2, in_group=1).collect()} == expected


def test_trie_walk_against_all_pairs():
    rng = np.random.default_rng(2)
    flips = lambda p: np.packbits(rng.random((40, 64 * similar.LONG_WORDS)) < p, axis=1).view(np.uint64)
    center = rng.integers(0, 2**63, (6, similar.LONG_WORDS), dtype=np.uint64)
    prints = np.concatenate([c ^ flips(p) for c, p in zip(center, (0.01, 0.03, 0.05, 0.08, 0.1, 0.3), strict=True)])
    prints = prints[np.lexsort(prints.T[::-1])]
    n = len(prints)
    label = rng.integers(0, 200, n)
    walked = np.concatenate([np.zeros((3, 0), np.int64), *similar.trie_walk(label, np.zeros(n, np.int64), prints, np.full(n, 9), 100, 0.8, chunk=50)], axis=1)
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    expected = sorted((a, b, int(far[a, b])) for a in range(n) for b in range(a + 1, n) if far[a, b] <= 100 and label[a] != label[b])
    assert sorted((min(i, j), max(i, j), bits) for i, j, bits in walked.T.tolist()) == expected and expected


def test_a_farther_member_of_a_cluster_links_where_the_nearest_fails(spark, monkeypatch):
    base = [f"w{i}" for i in range(204)]

    def edited(*places):
        return " ".join(f"edit{i}" if i in places else w for i, w in enumerate(base))

    # 0.82 like the first text, 0.78 like the ten others, which are 0.95 like the first
    texts = [edited(), *(edited(100 + k) for k in range(10)), edited(10, 50, 150, 190)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    expected = plain_similar(range(12), texts)
    assert set(expected.values()) == {0}

    def crafted(hashes, counts):
        out = np.full((12, similar.LONG_WORDS), 2**64 - 1, np.uint64)
        out[1:, 1] ^= np.uint64(1023)  # 10 bits that the last shares with all but the first
        out[np.arange(1, 11), 2] ^= np.uint64(1) << np.arange(10, dtype=np.uint64)
        out[11, 0] = 0  # 71 bits from the others, 80 from the first
        out[11, 3] ^= np.uint64(63)
        return out

    monkeypatch.setattr(similar, "long_fold", crafted)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_texts(df).collect()} == expected


def test_near_bits_alone_are_no_link(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    # 0.75, 0.78 and 0.79 alike; the last two have equal sizes and unlike sets
    texts = [" ".join(words[a:b]) for a, b in ((0, 10), (0, 12), (12, 23), (12, 25))] + ["p q r s t u", "v w x y z u"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(similar, "long_fold", lambda hashes, counts: np.ones((len(counts), similar.LONG_WORDS), np.uint64))
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == plain_similar(range(6), texts) == {i: i for i in range(6)}


def few_words(seed=11, families=60):
    """Texts of 5 to 30 words with near copies: words added, dropped and changed."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(families):
        base = [f"w{i}" for i in rng.integers(0, 5000, rng.integers(5, 31))]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(["x", *base, "y"]), " ".join(base[1:]), " ".join(base[:-2])]
    return texts


def test_similar_texts_of_few_words_against_brute_force(spark):
    texts = few_words()
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_texts(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert found == plain_similar(range(len(texts)), texts)


def test_short_links_of_split_groups(spark):
    rng = np.random.default_rng(4)
    sets = [(n, sorted({*range(20), *rng.integers(20, 26, 3).tolist()})) for n in range(90)]
    df = spark.createDataFrame(sets, "node long, shingles array<long>").cache()
    whole = simhash.components(similar.short_links(df, 0.8), "node").collect()
    small = simhash.components(similar.short_links(df, 0.8, limit=10), "node").collect()
    assert len(whole) == 89 and sorted(map(tuple, whole)) == sorted(map(tuple, small))


def test_bits_that_differ_between_few_hashes():
    assert abs(512 * similar.differing_part(4, 5, 4) - 96) < 1e-9
    assert similar.long_bits(0.8)[0] > similar.expected_bits(0.8)[0]


def test_groups_that_stay_large_are_cut(spark):
    prints = spark.createDataFrame([(int(x),) for x in range(256)], "fingerprint long")  # all but eight bits equal
    groups = simhash.print_groups(prints, 4, 40)
    assert groups.groupBy("key").count().agg(F.max("count")).first()[0] <= 80
    whole = simhash.components(simhash.links(prints, 4)).collect()
    assert len(whole) == 255 and sorted(map(tuple, whole)) == sorted(map(tuple, simhash.components(simhash.links(prints, 4, limit=40)).collect()))
    rows = [(n, (255 << 8 * (n % 8)).to_bytes(64, "little"), 90) for n in range(200)]
    nodes = spark.createDataFrame(rows, "node long, print binary, size long")
    assert similar.long_groups(nodes, 0.8, 13, 40)(nodes).groupBy("key").count().agg(F.max("count")).first()[0] <= 80
