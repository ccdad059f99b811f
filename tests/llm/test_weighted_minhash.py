import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wayfare.llm import weighted_minhash as wm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t.lower())) for t in (a, b))
    whole = sum((x | y).values())
    return sum((x & y).values()) / whole if whole else 1.0


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def test_against_plain_python(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 200), p=np.arange(60, 0, -1) / 1830)) for _ in range(70)]
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)] + [(1000, ""), (1001, None), (1002, "é ñ x"), (1003, "é ñ x"), (1003, "é ñ x"), (None, "lost"), (6, " \t ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("range", F.lit("clash"))
    out = wm.compare_with_next(df, samples=64).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited(t, n).encode()).hexdigest()))
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    by_id = {r["doc_id"]: r for r in out}
    errors = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        if i != 1003:
            errors += [by_id[i]["near_edited"] - jaccard(t, edited(t, n)), by_id[i]["near_next"] - jaccard(t, n)]
    assert np.abs(errors).max() < 0.3 and np.abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08
    assert by_id[1002]["fingerprint"] == by_id[1003]["fingerprint"] and by_id[1000]["fingerprint"] == by_id[1001]["fingerprint"] == by_id[6]["fingerprint"]


def test_one_and_no_document(spark):
    assert wm.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    one = wm.compare_with_next(spark.createDataFrame([(4, "a b c d", "en", "s", 7)], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(edited("a b c d", "a b c d").encode()).hexdigest()
