"""The curve, the runs and what a reader can skip."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import hilbert
from wayfare.operators import skew

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot long, curve int"


def plain_index(steps, bits):
    digits, following = hilbert.curve_table(len(steps))
    state = index = 0
    for i in reversed(range(bits)):
        corner = sum(((s >> i) & 1) << d for d, s in enumerate(steps))
        place = state * 2 ** len(steps) + corner
        state, index = following[place], index * 2 ** len(steps) + digits[place]
    return index


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 5), (3, 3), (4, 2), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = {plain_index(c, bits): c for c in product(range(1 << bits), repeat=dims)}
    assert sorted(cells) == list(range(1 << bits * dims))
    for i in range(len(cells) - 1):
        assert sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1], strict=True)) == 1
    # every aligned run of the curve is a sub-cube
    side = 1 << bits - 1
    for q in range(1 << dims):
        run = [cells[i] for i in range(q << (bits - 1) * dims, (q + 1) << (bits - 1) * dims)]
        assert all(max(c) - min(c) == side - 1 for c in zip(*run, strict=True))


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", -1, 7) for r in rows], DOCS).repartition(4)


def some_rows(n=400):
    rng = np.random.default_rng(0)
    rows = [(i, f"text {i} é" * int(rng.integers(1, 30)), ["de", "en", "fr", None][i % 4], ["hot"] * 3 and ("hot" if i % 3 else f"s{rng.integers(0, 40):02d}"), int(rng.integers(0, 500))) for i in range(n)]
    rows += [rows[5]] * 150 + [(n + i, *rows[6][1:]) for i in range(30)] + [(None, None, None, None, None), (-1, "", "", "", -5)]
    return rows


def test_curve_in_spark_equals_plain(spark):
    cells = [tuple(int(x) for x in c) for c in np.random.default_rng(1).integers(0, 64, (200, 3))]
    got = spark.createDataFrame(cells, "a int, b int, c int").select("a", "b", "c", hilbert.curve_index([F.col(x) for x in "abc"]).alias("at")).collect()
    assert all(r["at"] == plain_index((r["a"], r["b"], r["c"]), 6) for r in got)


def test_steps_are_shares_of_the_rows_before(spark):
    rows = [("b",)] * 50 + [("a",)] * 25 + [("c",)] * 25 + [(None,)] * 9
    df = spark.createDataFrame(rows, "v string")
    cuts = hilbert.steps_of(df, "v", 8)
    assert cuts == [(0, "a"), (2, "b"), (6, "c")]
    steps = {r["v"]: r["s"] for r in df.union(spark.createDataFrame([("A",), ("bb",), ("z",)], "v string")).select("v", hilbert.step("v", cuts, df.schema["v"].dataType).alias("s")).collect()}
    assert steps == {"a": 0, "b": 2, "c": 6, None: 0, "A": 0, "bb": 2, "z": 6}
    many = spark.range(10_000).select((F.col("id") * 3).alias("v")).repartition(5)
    cuts = hilbert.steps_of(many, "v", 64)
    assert [s for s, _ in cuts] == list(range(64)) and all(v == 3 * -(-s * 10_000 // 64) for s, v in cuts)


def test_shards(spark, tmp_path):
    rows = some_rows()
    written = hilbert.write_shards(docs_of(spark, rows), 24, str(tmp_path / "out"))
    got = written.collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in got) == Counter(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    in_order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in in_order] == sorted(r["curve"] for r in got)
    # equal rows and equal texts of equal columns are neighbours
    places = [i for i, r in enumerate(in_order) if r["text"] == rows[6][1] and r["source"] == rows[6][3]]
    assert places == list(range(places[0], places[0] + 31))
    # the curve from the steps of the table itself
    cuts = [hilbert.steps_of(docs_of(spark, rows), c) for c in hilbert.DIMENSIONS]
    low = lambda v, c: max((s for s, x in c if v is not None and x <= v), default=0)
    assert all(r["curve"] == plain_index([low(r[d], c) for d, c in zip(hilbert.DIMENSIONS, cuts, strict=True)], hilbert.BITS) for r in got)


def test_ranges_hold_like_bytes(spark, monkeypatch):
    """Long texts beside each other, a text and a row that many share: no range has much more than its part."""
    monkeypatch.setattr(skew, "LEAST", 100)
    rows = [(i, f"t{i} " + "x" * (3000 if i % 10 == 0 else 30), "en", "hot", 3000 if i % 10 == 0 else 30) for i in range(2000)]
    rows += [(5000 + i, "one text of many rows", "en", "hot", 7) for i in range(2000)] + [(1, "a row repeated", "fr", "hot", 9)] * 2000
    table, before, n = hilbert.in_order(docs_of(spark, rows))
    held = sorted(r["b"] for r in table.groupBy("range").agg(F.sum(F.octet_length("text") + hilbert.ROW_BYTES).alias("b")).collect())
    assert n == 6000 and len(held) >= 24 and held[-1] <= 2.5 * sum(held) / len(held)
    placed = table.join(before, "range").select("curve", "text", (F.col("before") + F.col("numbered") - F.col("first")).alias("at")).orderBy("at").collect()
    assert [r["at"] for r in placed] == list(range(6000)) and [r["curve"] for r in placed] == sorted(r["curve"] for r in placed)
    copies = [r["at"] for r in placed if r["text"] == "one text of many rows"]
    assert copies == list(range(copies[0], copies[0] + 2000))


def test_reader_skips_shards_by_any_column(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, f"t{i}", f"l{rng.integers(0, 30):02d}", f"s{rng.integers(0, 30):02d}", int(rng.integers(0, 10_000))) for i in range(4000)]
    written = hilbert.write_shards(docs_of(spark, rows), 24, str(tmp_path / "out"))
    m = hilbert.manifest(written).cache()
    for column, low, high in (("source", "s04", "s04"), ("lang", "l21", "l22"), ("n_chars", 300, 600)):
        shards = hilbert.shards_for(m, {column: (low, high)})
        assert len(shards) <= 14  # a table sorted by one column reads all 24 for the two others
        assert written.filter(F.col("shard").isin(shards) & F.col(column).between(low, high)).count() == sum(low <= dict(zip(("source", "lang", "n_chars"), (r[3], r[2], r[4]), strict=True))[column] <= high for r in rows)
    assert len(hilbert.shards_for(m, {"source": ("s04", "s04"), "lang": ("l21", "l22"), "n_chars": (300, 600)})) <= 4
    filtered = written.filter(F.col("shard") == 3)
    assert "PartitionFilters: [isnotnull(shard" in filtered._jdf.queryExecution().toString()


def test_empty_and_fewer_rows_than_shards(spark, tmp_path):
    assert hilbert.write_shards(docs_of(spark, []), 24, str(tmp_path / "none")).count() == 0
    few = hilbert.write_shards(docs_of(spark, some_rows()[:5]), 24, str(tmp_path / "few")).collect()
    assert len(few) == 5 and len({r["shard"] for r in few}) == 5 and {r["slot"] for r in few} == {0}
    assert zlib.crc32(b"") == 0
