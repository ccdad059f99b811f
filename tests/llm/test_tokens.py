"""Encoding, the token store and packing against the library's own encoding of whole texts."""

import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfare.llm import packing, token_store
from wayfare.llm.tokens import Encoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["It's 12 of them, x.\nAnd y\n\n z  w", "", None, " a", "a  ", "  a", "é ü\n \nñ", "x<|endoftext|> y", "a　 b   c", "\x1c a\x85 b", "日本語 テキスト", "w\0 q", "the " * 900]
ROWS = [(i * 3, t, "en", ["a", "b", "a", None][i % 4], 0) for i, t in enumerate(TEXTS)] + [(6, None, "en", "a", 0), (None, "no id", None, None, None)]


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_vocabulary())


def plain(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t ab'.,1é\0|"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_pieces_give_the_ids_of_the_whole(texts):
    coder = test_pieces_give_the_ids_of_the_whole.__dict__.setdefault("coder", Encoder(default_vocabulary()))
    ids, counts = coder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [plain(coder, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000)), max_size=40), max_size=6))
def test_block_round_trip(docs):
    ids, counts = np.array([i for d in docs for i in d], np.uint32), np.array([len(d) for d in docs], np.int64)
    got, sizes = token_store.unpack_block(token_store.pack_block(ids, counts))
    assert got.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()


def test_many_ranks_take_more_bytes():
    ids = np.arange(70_000, dtype=np.uint32)
    got, _ = token_store.unpack_block(token_store.pack_block(ids, np.array([70_000])))
    assert (got == ids).all()


def test_store(spark, coder):
    path = token_store.new_path(spark)
    token_store.write_store(spark.createDataFrame(ROWS, SCHEMA), path, block_tokens=50)
    got = [tuple(r) for r in token_store.read_store(spark, path).orderBy("start").select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()]
    at, expected = 0, []
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain(coder, r[1]), 0]
        expected.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert got == expected


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    path = token_store.new_path(spark)
    token_store.write_store(empty, path)
    assert token_store.read_store(spark, path).count() == 0
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("lane", [1 << 20, 300])
def test_packing_holds_each_id_once(spark, coder, lane):
    rows = ROWS * 3 + [(1000 + i, f"word{i} " * (i % 50), "en", "b", 0) for i in range(60)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), window=64, lane_tokens=lane, least=8).collect()
    whole = {}
    for r in out:
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for doc_id in {r[0] for r in rows}:
        texts = [r[1] for r in rows if r[0] == doc_id]
        joined = sorted(x for t in texts for x in [*plain(coder, t), 1])
        assert sorted(i for p in whole[doc_id] for i in np.frombuffer(p[2], "<u4").tolist()) == joined
        if len(texts) == 1:
            assert b"".join(p[2] for p in sorted(whole[doc_id])) == np.array([*plain(coder, texts[0]), 1], "<u4").tobytes()
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_windows_keep_the_shares():
    counts = [100] * 60
    sources = ["a"] * 40 + ["b"] * 20
    pieces = packing.serve(sources, counts, {"a": 2, "b": 1}, {}, 128, 16)
    begin = np.cumsum(pieces[:, 2]) - pieces[:, 2]
    for w in range(0, 5800, 640):
        inside = (begin >= w) & (begin < w + 640)
        share = sum(n for i, _, n in pieces[inside] if sources[i] == "a") / pieces[inside, 2].sum()
        assert abs(share - 2 / 3) < 0.1


def plain_rounds(sources, counts, shares, owed, window, least):
    """Deficit round-robin round by round, in fractions."""
    left = {s: [[i, n] for i, n in enumerate(counts) if sources[i] == s] for s in sources}
    earned = {s: Fraction(owed.get(s, 0)) for s in left}
    out, space = [], window
    while any(left.values()):
        ring = sorted((s for s in left if left[s]), key=lambda s: (s is None, s or ""))
        whole = sum(shares[s] for s in ring)
        for s in ring:
            earned[s] += Fraction(shares[s] * window, whole)
            while left[s] and earned[s] >= least:
                i, rest = left[s][0]
                n = min(rest, space, int(earned[s]))
                out.append((i, counts[i] - rest, n))
                earned[s] -= n
                space = space - n or window
                left[s][0][1] -= n
                if not left[s][0][1]:
                    left[s].pop(0)
    return out


def test_serving_equals_plain_rounds():
    rng = np.random.default_rng(7)
    for _ in range(300):
        names = ["a", "b", "c", None][: rng.integers(1, 5)]
        shares = {s: int(rng.integers(1, 5)) for s in names}
        # a window that all sums of shares divide, so that no rounding decides who is due
        window = int(np.lcm.reduce([sum(shares[s] for k, s in enumerate(names) if m >> k & 1) for m in range(1, 1 << len(names))]))
        window *= max(1, 200 // window)
        n = rng.integers(1, 12)
        sources, counts = [names[k] for k in rng.integers(0, len(names), n)], rng.integers(1, 3 * window + 1, n).tolist()
        owed = {s: float(rng.integers(-2 * window, window)) for s in names}
        least = int(rng.choice([1, 16, window, 2 * window + 1]))
        found = packing.serve(sources, counts, shares, owed, window, least)
        assert [tuple(p) for p in found.tolist()] == plain_rounds(sources, counts, shares, owed, window, least)


def test_serving_follows_the_pieces():
    for n in (20_000, 100_000):  # sources, a document each
        sources = [f"s{i:06}" for i in range(n)]
        begin = time.process_time()
        pieces = packing.serve(sources, [50] * n, dict.fromkeys(sources, 7), {}, 2048, 128)
        assert sorted(pieces[:, 0].tolist()).count(0) >= 1 and pieces[:, 2].sum() == 50 * n
        assert len(pieces) < 1.1 * n and time.process_time() - begin < 10
    begin = time.process_time()  # debts of a million lanes
    pieces = packing.serve(["a", "b"] * 50, [1000] * 100, {"a": 1, "b": 1}, {"a": 4e11, "b": -4e11}, 2048, 128)
    assert pieces[:, 2].sum() == 100_000 and time.process_time() - begin < 1


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 3, "b": 1}, {"b": 1}])
def test_given_weights_fill_each_lanes_windows(spark, coder, weights):
    rows = [(i, "word " * 20, "en", "b" if i % 10 == 0 else "a", 0) for i in range(2000)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(1), weights, window=64, lane_tokens=4000, least=8).collect()
    assert sum(r["length"] for r in out) == sum(len(plain(coder, r[1])) + 1 for r in rows)
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], Counter())["b" if r["doc_id"] % 10 == 0 else "a"] += r["length"]
    full = [windows[k] for k in sorted(windows) if sum(windows[k].values()) == 64]
    # where both sources still have tokens, their proportions are the weights'; a debt of one window is paid first
    mixed = [w for w in full if w["a"] and w["b"]]
    if "a" in weights:
        share = sum(w["b"] for w in mixed) / sum(map(Counter.total, mixed))
        assert len(mixed) > 20 and abs(share - 1 / (1 + weights["a"])) < 0.15
    else:
        assert len(mixed) < len(full) / 5
