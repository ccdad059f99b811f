"""Packing documents into fixed windows with the sources' token proportions held by deficit round-robin.

Documents are dealt by hash into lanes of about LANE_TOKENS tokens; lanes are written once as rows. Each lane serves its source
queues in rounds: a source earns its share of a window per round and, once it has earned enough, spends it on the next
tokens of its queue; documents are cut where a window or a source's earnings end. What a source has earned and not spent is
its deficit; it goes on to the next window, and from lane to lane: a lane starts with what the lanes before it owe, which
follows from their token counts alone, so lanes run side by side. At most a window is carried either way: with weights that
aren't the corpus's shares a source runs dry in each lane, and what it couldn't spend would grow without end. The last window
of a lane is cut into windows whose lengths are powers of two, which need no padding.

Defined cases: a null text is an empty one and is packed as its end id; a null source is a source of its own; a source without
a weight (none given, or not above 0) has a millionth of all weights, so it comes at last; repeated rows are packed once each;
an empty table gives an empty result. Columns other than those of documents are ignored.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, sliced, staged, text_of, wide_partitions
from .tokens import KEPT, default_vocabulary, encoder, release

WINDOW = 2048
LANE_TOKENS = 1 << 20
#: Tokens that a source earns before it is served, so that windows aren't cut into crumbs.
LEAST_SERVED = 128
#: Rows (lane, source) of deficits that are broadcast at most; beyond that they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Shares are whole multiples of 2^-SHARE_BITS where a lane is served, so that sums of them are exact.
SHARE_BITS = 40
LANE = "part int, lane int, doc_ids array<long>, sources array<string>, counts array<long>, ids binary, wide boolean"


def lanes(docs: DataFrame, vocabulary: str, end_id: int, lane_tokens: int, kept: int = KEPT) -> DataFrame:
    """Rows of LANE: the documents of a lane, in a seeded order, with their ids."""

    def run(batches):
        part, lane, rows = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.bool_()]
        names = ["part", "lane", "doc_ids", "sources", "counts", "ids", "wide"]

        def flush():
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            row = (part, lane, [d for h in held for d in h[2]], [s for h in held for s in h[3]], counts.tolist(), ids.tobytes(), ids.dtype.itemsize > 2)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for batch in sliced(batches, 500, 2):
            ids, counts = encoder(vocabulary, kept).encode(batch.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end_id)
            held.append((ids, counts + 1, batch.column("doc_id").to_pylist(), batch.column("source").to_pylist()))
            rows += len(ids)
            if rows >= lane_tokens:
                yield flush()
                lane, held, rows = lane + 1, [], 0
        if held:
            yield flush()

    dealt = docs.select("doc_id", "source", text_of().alias("text"), row_hash()["a"].alias("order"))
    dealt = dealt.repartition(wide_partitions(docs.sparkSession), "order").sortWithinPartitions("order", "doc_id")
    return staged(dealt.select("doc_id", "source", "text").mapInArrow(run, LANE), "pack-lanes", 500)


def serve(sources: list, counts: list[int], shares: dict, owed: dict, window: int, least: int) -> np.ndarray:
    """Pieces (document, start, length) of a lane in the order they are served; no piece crosses a window. shares are whole
    numbers above 0, of any sum.

    In a round, a window is shared among the sources that still have tokens, and those that have earned at least so many are
    served, in order. All earn at the same pace for each unit of their shares, so the pace's sum up to now gives what each has
    earned, and a calendar holds at which sum each is due: rounds in which none is due are jumped, and a round meets only
    those that it serves. The work follows the pieces, not rounds times sources."""
    least = max(least, 1)
    queues: dict = {}
    for i, s in enumerate(sources):
        queues.setdefault(s, deque()).append(i)
    ring = sorted(queues, key=lambda s: (s is None, s or ""))
    # what each source has besides its pace: what it was owed, less what it has spent
    balance = [owed.get(s, 0.0) for s in ring]
    share = [shares[s] for s in ring]
    pace, whole = 0.0, sum(share)
    calendar = [((least - b) / w, k) for k, (b, w) in enumerate(zip(balance, share, strict=True))]
    heapify(calendar)
    done = [0] * len(counts)
    pieces: list[tuple[int, int, int]] = []
    space = window
    while calendar:
        step = window / whole
        pace += step * max(1, ceil((calendar[0][0] - pace) / step))
        due = []
        while calendar and calendar[0][0] <= pace:
            due.append(heappop(calendar)[1])
        if not due:  # the sum fell short of the first by a rounding
            due.append(heappop(calendar)[1])
        for k in sorted(due):
            queue, earned = queues[ring[k]], max(balance[k] + share[k] * pace, float(least))
            balance[k] -= earned
            while queue and earned >= least:
                i = queue[0]
                n = min(counts[i] - done[i], space, int(earned))
                pieces.append((i, done[i], n))
                done[i] += n
                earned -= n
                space = space - n or window
                if done[i] == counts[i]:
                    queue.popleft()
            balance[k] += earned
            if queue:
                heappush(calendar, ((least - balance[k]) / share[k], k))
            else:
                whole -= share[k]
    return np.array(pieces, np.int64).reshape(-1, 3)


def windows_of(total: int, window: int) -> np.ndarray:
    """Where a lane's windows begin: full ones, then one for each power of two in what is left."""
    starts = list(range(0, total - total % window, window))
    at = total - total % window
    for bit in reversed(range((total % window).bit_length())):
        if total % window >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return np.array(starts, np.int64)


def pack(docs: DataFrame, weights: dict | None = None, window: int = WINDOW, vocabulary: str | None = None, end_id: int = 1, lane_tokens: int = LANE_TOKENS, least: int = LEAST_SERVED, max_sources: int = 100_000, kept: int = KEPT) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, uint32 little-endian), doc_tokens, sequence_id, offset. weights: the
    share of each source in a window (by default its share of all tokens, so that all queues end together). window is a power
    of two. At least so many tokens (`least`) are earned before a source is served. Over max_sources sources are an error, which bounds what the driver and a lane hold of them.
    kept: pieces of text whose ids a worker keeps."""
    held = lanes(docs, vocabulary or default_vocabulary(), end_id, lane_tokens, kept)
    spent = staged(
        held.select("part", "lane", F.explode(F.arrays_zip("sources", "counts")).alias("d"))
        .groupBy("part", "lane", F.col("d.sources").alias("source")).agg(F.sum("d.counts").alias("n")),
        "pack-spent",
    )
    totals = spent.groupBy("source").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    weight = {r["source"]: float(weights.get(r["source"], 0) if weights else r["n"]) for r in totals}
    least_weight = sum(weight.values()) / 1e6 or 1.0  # a source without a weight still comes, at last
    share = {s: max(w, least_weight) for s, w in weight.items()}
    share = {s: w / sum(share.values()) for s, w in share.items()}

    # what stands before each lane: tokens, windows, and tokens of each source
    size = spent.groupBy("part", "lane").agg(F.sum("n").alias("n"))
    size = size.withColumn("windows", F.floor(F.col("n") / window) + F.bit_count(F.col("n") % window))
    parts = size.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("windows").alias("pw"))
    by_part, in_part = Window.orderBy("part"), Window.partitionBy("part").orderBy("lane")  # one row for each partition
    parts = parts.select("part", (F.sum("pn").over(by_part) - F.col("pn")).alias("pn"), (F.sum("pw").over(by_part) - F.col("pw")).alias("pw"))
    before = size.join(parts, "part").select(
        "part", "lane", (F.col("pn") + F.sum("n").over(in_part) - F.col("n")).alias("tokens"), (F.col("pw") + F.sum("windows").over(in_part) - F.col("windows")).alias("first_sequence")
    )
    shares = docs.sparkSession.createDataFrame(list(share.items()), "of string, share double") if share else docs.sparkSession.createDataFrame([], "of string, share double")
    served = F.sum("n").over(Window.partitionBy("source").orderBy("part", "lane")) - F.col("n")
    carried = F.col("share") * F.col("tokens") - F.col("served")
    owed = spent.withColumn("served", served).join(before, ["part", "lane"]).join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("of")))
    owed = owed.groupBy("part", "lane", "first_sequence").agg(F.collect_list(F.struct("source", "share", F.greatest(F.least(carried, F.lit(float(window))), F.lit(-float(window))).alias("owed"))).alias("owed"))
    owed = staged(owed, "pack-owed")
    small = owed.select(F.sum(F.size("owed"))).first()[0] or 0
    joined = held.join(F.broadcast(owed) if small <= BROADCAST_ROWS else owed, ["part", "lane"])

    def run(batches):
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        release()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = np.frombuffer(row["ids"], np.uint32 if row["wide"] else np.uint16).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                known = {o["source"]: o for o in row["owed"]}
                pieces = serve(row["sources"], row["counts"], {s: round(o["share"] * (1 << SHARE_BITS)) for s, o in known.items()}, {s: o["owed"] for s, o in known.items()}, window, least)
                begin = np.cumsum(pieces[:, 2]) - pieces[:, 2]
                first = windows_of(len(ids), window)
                cuts = np.union1d(begin, first)
                piece, sequence = np.searchsorted(begin, cuts, "right") - 1, np.searchsorted(first, cuts, "right") - 1
                doc, length = pieces[piece, 0], np.diff(np.append(cuts, len(ids)))
                start = pieces[piece, 1] + cuts - begin[piece]
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = ids.tobytes()
                data = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                doc_ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
                columns = [doc_ids, pa.array(start), pa.array(length), pa.array(data, pa.binary()), pa.array(counts[doc]), pa.array(sequence + row["first_sequence"]), pa.array(cuts - first[sequence])]
                whole = pa.RecordBatch.from_arrays(columns, names=names)
                for k in range(0, whole.num_rows, 1024):
                    yield whole.slice(k, 1024)

    return joined.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
