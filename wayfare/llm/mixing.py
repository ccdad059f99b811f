"""Mixing sources to target weights by fitting word budgets exactly.

Documents are counted by (source, size). Each source's budget is first spent on whole passes over the source; what is left is
a subset-sum problem over the size histogram, by a bounded-knapsack dynamic programme over sets of sums (see fit_budget).
Documents are then chosen within each size in a seeded order.

Defined cases: a null text has size 0; a document of size 0 is never taken (taken = 0); a null source is a source of its own
that comes last; repeated rows are documents of their own; an empty table gives an empty result. Input columns other than the
five of documents are ignored, so extra columns can't clash.
"""

from __future__ import annotations

import zlib
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, row_hash, staged, text_of, word_count

#: Widest set of sums, in words; it's wider only where a few documents alone need it.
WIDTH = 1 << 24
#: Words that the programme fills in its first attempt, in largest documents; each further attempt has FURTHER times as many.
FIRST, FURTHER = 2, 8
#: Rows of one (source, size) that one task ranks together; larger groups are split by hash.
GROUP_ROWS = 4096


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets by weight that add up to share of all sizes; none is above cap times its size, the excess goes to the rest."""
    targets = [0.0] * len(sizes)
    active = [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in active:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        active = [i for i in active if i not in set(full)]
    return targets


def nearest_sum(size: list[int], count: list[int], goal: int, beyond: float = 0.0) -> tuple[int, list[int]]:
    """The sum nearest to goal + beyond (less than 1 off; ties: the smaller) of at most count[i] times size[i] each, and how
    often each. What is taken or what is left out is looked for, whichever is less.

    A set of sums is one long integer, a bit for each word; sizes are added in parts of 1, 2, 4... of each. What each part adds
    to the set is kept compressed: these additions have no sum in common, so together they hold each once."""
    whole = sum(s * c for s, c in zip(size, count, strict=True))
    if not 0 <= goal < whole:
        return (whole, count) if goal > 0 else (0, [0] * len(size))
    if turned := 2 * goal > whole:
        goal, beyond = whole - goal, -beyond
    # nothing is nearer than twice the goal if it's above, and a sum that passes the goal does so by one document
    width = min(goal + max(size), 2 * goal) + 2
    reached, inside = 1, (1 << width) - 1
    steps: list[tuple[int, int, bytes]] = []
    for i in sorted(range(len(size)), key=lambda i: -size[i]):
        n, part = min(count[i], (width - 1) // size[i]), 1
        while n > 0 and not reached >> goal & 1:
            k = min(part, n)
            new = (reached << size[i] * k) & inside & ~reached
            if new:
                reached |= new
                steps.append((i, k, zlib.compress(new.to_bytes(-(-width // 8), "little"), 1)))
            n, part = n - k, part * 2
    low = (reached & ((1 << goal + 1) - 1)).bit_length() - 1
    above = reached >> goal + 1
    high = goal + (above & -above).bit_length() if above else None
    over, under = (high - goal - beyond if high is not None else width), goal - low + beyond
    at = best = high if over < under or (turned and over == under) else low
    take = [0] * len(size)
    for i, k, new in reversed(steps):
        if at and zlib.decompress(new)[at >> 3] >> (at & 7) & 1:
            take[i] += k
            at -= size[i] * k
    return (whole - best, [c - t for c, t in zip(count, take, strict=True)]) if turned else (best, take)


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up near to budget. sizes are distinct and above 0.

    All but about FIRST largest documents' words are taken evenly over the sizes, and a programme over all that is left of each
    size fills the rest. If that doesn't meet the budget (to the word, or as near as the sizes' common divisor allows), it is
    tried again with FURTHER times as many words left to it, up to all: then the sum is the nearest that any subset has. So the
    result is the nearest sum whenever it meets the budget or the budget is below WIDTH words; of larger budgets that no attempt
    meets it is the nearest sum that takes an even share of all but the last WIDTH words. Memory is a few bits for each word of
    WIDTH or of three largest documents, whichever is more."""
    order = np.argsort(sizes)  # so that the order of rows can't change the result
    out = np.zeros(len(sizes), np.int64)
    out[order] = _fit_sorted(sizes[order], counts[order], budget)
    return out


def _fit_sorted(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    unit = int(np.gcd.reduce(sizes)) if len(sizes) else 1
    size, count = [int(s) // unit for s in sizes], [int(c) for c in counts]
    total = sum(s * c for s, c in zip(size, count, strict=True))
    goal = (2 * budget + unit - 1) // (2 * unit)  # nearest multiple; of two the smaller
    beyond = (budget - goal * unit) / unit
    if goal >= total:
        return np.array(count, np.int64)
    if goal <= 0:
        return np.zeros(len(size), np.int64)
    largest, shares = max(size), np.array(count, np.int64)
    best, words = None, FIRST * largest
    while True:
        words = min(words, max(WIDTH, FIRST * largest), goal)
        take = shares * 0
        if words < goal:
            cut = [c * (goal - words) // total for c in np.cumsum(shares).tolist()]  # the rounding error of the sum is below one document
            take = np.minimum(np.diff(np.array(cut), prepend=0), shares)
        left = goal - sum(s * int(t) for s, t in zip(size, take, strict=True))
        if left >= 0:
            found, more = nearest_sum(size, (shares - take).tolist(), left, beyond)
            if best is None or abs(found - left - beyond) < best[0]:
                best = abs(found - left - beyond), found == left, take + np.array(more, np.int64)
        if (best and best[1]) or words >= min(goal, max(WIDTH, FIRST * largest)):
            return best[2] if best else take
        words *= FURTHER


def _fit_source(hist: pd.DataFrame) -> pd.DataFrame:
    target, whole = float(hist["target"].iloc[0]), int(hist["source_size"].iloc[0])
    passes = int(target // whole) if whole else 0
    sized = hist["size"].to_numpy() > 0
    take = np.zeros(len(hist), np.int64)
    if sized.any():
        take[sized] = fit_budget(hist["size"].to_numpy()[sized], hist["n"].to_numpy()[sized], round(target - passes * whole))
    return hist.assign(passes=passes, take=take)


def source_targets(sized: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, cap: float = 3.0, max_sources: int = 100_000) -> DataFrame:
    """One row per source with its size and target. Sources are the configured parts of a mixture: over max_sources of them is
    an error, so what passes through the driver is bounded."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    weight = [w for _, w in zip(totals, cycle(weights))]
    targets = water_fill([r["source_size"] for r in totals], weight, share, cap)
    rows = [(r["source"], r["source_size"], t) for r, t in zip(totals, targets, strict=True)]
    return spark.createDataFrame(rows, "source string, source_size long, target double")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.0, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, row_hash, size, source_size, target (its source's), copies, taken = copies * size."""
    sized = staged(
        docs.select(
            "doc_id", "source", row_hash().alias("row_hash"), word_count(text_of()).alias("size"),
        ).withColumn("order_hash", F.xxhash64(F.lit(seed), "doc_id", "row_hash")),
        "mix-sized",
    )
    targets = source_targets(sized, weights, share, cap)
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    fit = staged(
        hist.join(F.broadcast(targets), hist["source"].eqNullSafe(targets["source"]))
        .select(hist["source"], "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, size long, n long, source_size long, target double, passes int, take long"),
        "mix-fit",
    )
    # (source, size) may be one large group of copies: rank within hashed parts of it
    parts = F.ceil(F.col("n") / GROUP_ROWS)
    f = fit.withColumnsRenamed({"source": "f_source", "size": "f_size"})
    placed = sized.join(f, sized["source"].eqNullSafe(f["f_source"]) & (sized["size"] == f["f_size"])).withColumn(
        "part", F.pmod(F.shiftright("order_hash", 20), parts)
    )
    group = ["source", "size"]
    cut = (
        placed.filter(F.col("n") > GROUP_ROWS)
        .groupBy(*group, "part")
        .agg(F.count("*").alias("in_part"))
        .withColumn("before", F.sum("in_part").over(Window.partitionBy(*group).orderBy("part")) - F.col("in_part"))
        .select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("part").alias("c_part"), "before")
    )
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "part").orderBy("order_hash", "row_hash")))
    chosen = ranked.join(
        cut, ranked["source"].eqNullSafe(cut["c_source"]) & (ranked["size"] == cut["c_size"]) & (ranked["part"] == cut["c_part"]), "left"
    ).withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + (F.col("nth") + F.coalesce("before", F.lit(0)) <= F.col("take")).cast("int")))
    return chosen.select("doc_id", "source", "row_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken. Equal rows are brought together first, as they can't be told
    apart; that and the join use one shuffle of the texts."""
    chosen = mix(docs, **how).groupBy("row_hash").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    keyed = docs.select(*DOCUMENT_COLUMNS).withColumn("row_hash", row_hash()).dropDuplicates(["row_hash"])
    return keyed.join(chosen, "row_hash").select(*DOCUMENT_COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
