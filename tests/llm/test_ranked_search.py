"""Ranked search against a plain score of every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayfare.llm import ranked_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    """item -> [(doc_id, score)], by scores of all documents."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs if plain_terms(t)]
    n_docs, all_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = {}
    for item, terms in wanted.items():
        found = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((doc, score))
        out[item] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return {i: f for i, f in out.items() if f}


def found_by(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)] + ["Été", "ÉTÉ", "日本", "x1"])
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum())).title()) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [docs[5]] * 3  # copies, repeated rows
    docs += [(None, docs[7][1]), (n + 90, None), (n + 91, " -- \t"), (n + 92, "w1 " * 5000), (n + 93, "a_b-C'd")]
    items = [(i, docs[i * 7][1] + " unseen") for i in range(12)] + [(50, None), (51, "!"), (52, "unseen only"), (None, "w5 日本"), (3, "w9 w17")]
    return docs, items


@pytest.mark.parametrize("window", [4, 1024])
def test_equals_plain_scores(spark, monkeypatch, window):
    docs, items = corpus(1, 300)
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    monkeypatch.setattr(ranked_search, "RUN_BYTES", 50)
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(4)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert found_by(ranked_search.search(frame, asked, 7).collect()) == plain_search(docs, items, 7)


def test_items_in_groups(spark, monkeypatch):
    docs, items = corpus(2, 80)
    monkeypatch.setattr(ranked_search, "GROUP_TERMS", 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(ranked_search.groups_of(ranked_search.item_terms(asked, "item_id", "text")))) > 2
    assert found_by(ranked_search.search(frame, asked, 5).collect()) == plain_search(docs, items, 5)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(none, asked).count() == 0
    assert ranked_search.search(asked.selectExpr("item_id AS doc_id", "text"), asked.limit(0)).count() == 0


def block_of(seed, rows, terms):
    """A block of random postings, its dense impacts, and weights."""
    rng = np.random.default_rng(seed)
    tf = rng.poisson(0.7, (rows, terms)) * (rng.random(terms) < 0.6)
    tf[rng.integers(0, rows, 50)] = tf[0]  # ties
    weights = rng.integers(1, 4000, terms)
    lists = lambda values: pa.array([v[v > 0].tolist() for v in values], pa.list_(pa.int32()))
    table = pa.table({"doc_id": pa.array(rng.permutation(rows)), "n": pa.array(tf.sum(1) + 1), "terms": pa.array([np.flatnonzero(r).tolist() for r in tf], pa.list_(pa.int32())), "tfs": lists(tf)})
    m = ranked_search.length_norm(tf.sum(1) + 1, rows, int(tf.sum() + rows))
    dense = weights * ((10**9 * tf) // (1000 * tf + 8 * m[:, None]))
    return ranked_search.Block(table, weights, rows, int(tf.sum() + rows)), dense, table["doc_id"].to_numpy()


@pytest.mark.parametrize("seed", range(6))
def test_block_search_skips_nothing_of_the_best(monkeypatch, seed):
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    block, dense, ids = block_of(seed, 500, 30)
    for short, long in (([], list(range(30))), (list(range(12)), list(range(12, 30))), (list(range(30)), []), ([2], [5])):
        scores = dense[:, short + long].sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if scores[i] > 0]
        for floor in (0, int(np.sort(scores)[-9]), int(scores.max()) + 1):
            want = [(int(i), int(scores[i])) for i in order if scores[i] >= floor][:8]
            assert list(zip(*(x.tolist() for x in block.search(short, long, floor, 8)), strict=True)) == want


def test_windows_and_documents_are_skipped(monkeypatch):
    """One rare term decides: of the windows only those that hold it are looked at."""
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    rows = 1600
    terms = [[0, 1] if i in (100, 900) else [1] for i in range(rows)]
    table = pa.table({"doc_id": pa.array(range(rows)), "n": pa.array([2] * rows), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array([[1] * len(t) for t in terms], pa.list_(pa.int32()))})
    block = ranked_search.Block(table, np.array([5000, 1]), rows, 2 * rows)
    seen, whole = [], block._in_window
    monkeypatch.setattr(block, "_in_window", lambda lists, bounds, window, floor: seen.append(window) or whole(lists, bounds, window, floor))
    floor = int(block.accumulate([0])[1].min())
    assert block.search([0], [1], floor, 2)[0].tolist() == [100, 900] and seen == [6, 56]
