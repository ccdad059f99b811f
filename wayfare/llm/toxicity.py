"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so tokens are labelled first: a word, or the beginning of a word, that comes almost only in toxic
documents of the training part marks its tokens there. The field has two tags (clean, toxic) and features of the word itself,
its beginnings and ends, and the word before; it is fitted on sentences around marked tokens and as many others from a
bounded sample of labelled rows (SAMPLE_DOCS documents with the least hashes of doc_id). Forward-backward marginals give each
token's probability; their maximum, sum and share give a document's score by a logistic regression fitted on the same sample,
and tokens of SPAN_LEAST or more are the offending spans.

Words hash into BUCKETS feature numbers, so the model that goes to the tasks has one size. A sentence ends after '.', '!' or
'?', or with the text, however long it is: chains run over whole sentences. They are worked off in rows of ROW tokens that hand
the forward vector to the next row and the backward vector to the one before, so memory follows the tokens at hand.

Defined cases: a null or empty text has no tokens and gets the score of a document without toxic ones; labels that are null
or of unknown documents are ignored; a document labelled twice counts as toxic if one label says so; without labels of both
kinds every score is 0; repeated rows are scored each; rows of one doc_id all enter the sample, as far as it goes, in the order
of their texts; an empty table gives an empty result. Only named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

SAMPLE_DOCS = 4000
SAMPLE_CHARS = 20_000
#: Of the sample: sentences that the field is fitted on at most, and the part of those without a marked token that is drawn.
TRAIN_SENTENCES, CLEAN_PART = 40_000, 0.05
#: Words that a worker keeps before it starts anew.
KEPT = 400_000
STOPS = (b".", b"!", b"?")
BUCKETS = 1 << 18
#: Tokens of a row.
ROW = 48
SPAN_LEAST = 0.5
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»¡¿…“”‘’"


def held_out(doc_id: Column) -> Column:
    """Documents that lend no label to the training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(word: str) -> tuple[str, ...]:
    """Of a word without its edges, in lower case."""
    return (word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n), *((f"-{word[-3:]}",) if len(word) > 3 else ()))


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & (BUCKETS - 1)


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for raw in WORDS.findall(text):
        out[-1].append(raw.lower().strip(EDGES))
        if raw[-1] in ".!?":
            out.append([])
    return [s for s in out if s]


def telling(docs: list[tuple[str, int]], least: int = 4, part: float = 0.01, ratio: float = 25.0) -> set[str]:
    """Words and beginnings that come often enough in toxic texts (at least `least` times, and `part` times the number of
    texts) and `ratio` times as often there as elsewhere. What counts are different neighbours, so that a text's own rare
    words don't count again in each of its copies."""
    seen = [Counter(), Counter()]
    size = [1, 1]
    for label in (0, 1):
        contexts = set()
        for text in {t for t, toxic in docs if toxic == label}:
            size[label] += 1
            words = ["", *(w for s in _sentences(text) for w in s), ""]
            contexts.update((w, words[i], words[i + 2]) for i, w in enumerate(words[1:-1]))
        for word, _, _ in contexts:
            seen[label].update(f for f in features(word) if not f.startswith("-"))
    least = max(least, int(part * size[1]))
    odds = lambda f, n: (n / size[1]) / ((seen[0][f] + 0.5) / size[0])
    return {f for f, n in seen[1].items() if n >= least and odds(f, n) >= ratio}


class Field:
    """Weights of the two-tag chain: emission (per feature bucket, of tag toxic against clean), the previous word's, bias and
    transitions."""

    def __init__(self):
        self.emission = np.zeros(BUCKETS)
        self.before = np.zeros(BUCKETS)
        self.bias = -3.0
        self.transition = np.zeros((2, 2))


def _handed_over(emit: np.ndarray, move: np.ndarray, length: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a chain the vector that comes into its first token, the one that comes back to its last, and the forward
    vector that it ends with. A row's tokens are one 2x2 product; chains pass vectors on from product to product."""
    n, width = emit.shape[:2]
    into, back, end = np.ones((n, 2)), np.ones((n, 2)), np.ones((n, 2))
    chained = follows | np.append(follows[1:], False)
    rows = np.flatnonzero(chained)
    if not len(rows):
        return into, back, end
    whole = np.zeros((len(rows), 2, 2))
    whole[:, [0, 1], [0, 1]] = emit[rows, 0]
    for t in range(1, width):
        step = (whole @ move) * emit[rows, t][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        whole = np.where((t < length[rows])[:, None, None], step, whole)
    at = np.full(n, -1)  # the place of a row in whole
    at[rows] = np.arange(len(rows))
    nth = np.arange(n) - np.maximum.accumulate(np.where(follows, 0, np.arange(n)))  # place in the chain
    of_place = [np.flatnonzero(chained & (nth == k)) for k in range(int(nth[rows].max()) + 1)]
    for k, some in enumerate(of_place):
        if k:
            step = end[some - 1] @ move
            into[some] = step / step.sum(1, keepdims=True)
        step = np.einsum("ni,nij->nj", into[some], whole[at[some]])
        end[some] = step / step.sum(1, keepdims=True)
    for some in reversed(of_place[1:]):
        step = np.einsum("nij,nj->ni", whole[at[some]], back[some]) @ move.T
        back[some - 1] = step / step.sum(1, keepdims=True)
    return into, back, end


def marginals(potential: np.ndarray, transition: np.ndarray, length: np.ndarray, pairs: np.ndarray | None = None, follows: np.ndarray | None = None) -> np.ndarray:
    """Marginals of tag toxic for padded rows, by scaled forward-backward; adds expected transitions to pairs. A row that follows
    goes on with the chain of the row before it."""
    n, width = potential.shape
    follows = np.zeros(n, bool) if follows is None else follows
    move = np.exp(transition)
    emit = np.stack([np.ones_like(potential), np.exp(np.clip(potential, -30, 30))], axis=2)
    into, back, end = _handed_over(emit, move, length, follows)
    forward, backward = np.zeros((width, n, 2)), np.ones((width, n, 2))
    f = into * emit[:, 0]
    f /= f.sum(1, keepdims=True)
    forward[0] = f
    for t in range(1, width):
        f = (f @ move) * emit[:, t]
        f /= f.sum(1, keepdims=True)
        forward[t] = f
    b = back
    backward[width - 1] = b
    for t in range(width - 2, -1, -1):
        step = (b * emit[:, t + 1]) @ move.T
        b = np.where((t + 1 < length)[:, None], step / step.sum(1, keepdims=True), back)
        backward[t] = b
    both = forward * backward
    tags = (both / both.sum(2, keepdims=True))[:, :, 1].T
    if pairs is not None:
        for t in range(width - 1):
            inside = t + 1 < length
            joint = forward[t][inside][:, :, None] * move[None] * (emit[inside, t + 1] * backward[t + 1][inside])[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        joined = np.flatnonzero(follows)
        joint = end[joined - 1][:, :, None] * move[None] * (emit[joined, 0] * backward[0][joined])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return tags


def train(docs: list[tuple[str, int]], rounds: int = 60, rate: float = 0.5, seed: int = 11) -> tuple[Field, np.ndarray]:
    """The field, and the weights of the document score."""
    field, marks = Field(), telling(docs)
    rng = np.random.default_rng(seed)
    chosen: list[tuple[list[str], list[int]]] = []
    for text, toxic in docs:
        for words in _sentences(text):
            tags = [int(toxic and not marks.isdisjoint(features(w))) for w in words]
            if any(tags) or rng.random() < CLEAN_PART:
                chosen.append((words, tags))
    chosen = [chosen[i] for i in rng.permutation(len(chosen))[:TRAIN_SENTENCES]]
    if chosen and any(any(t) for _, t in chosen):
        rows, columns, numbers, previous, moved = [], [], [], [], np.zeros((2, 2))
        cut = [(words, tags, a) for words, tags in chosen for a in range(0, len(words), ROW)]
        length = np.array([min(ROW, len(words) - a) for words, _, a in cut])
        follows = np.array([a > 0 for _, _, a in cut])
        width = int(length.max())
        inside = np.arange(width) < length[:, None]
        gold = np.zeros((len(cut), width))
        for i, (words, tags, a) in enumerate(cut):
            gold[i, : length[i]] = tags[a : a + ROW]
            for t, w in enumerate(words[a : a + ROW]):
                for f in features(w):
                    rows.append(i), columns.append(t), numbers.append(bucket(f))
                if a + t:
                    previous.append((i, t, bucket(words[a + t - 1])))
        for _, tags in chosen:
            np.add.at(moved, (tags[:-1], tags[1:]), 1)
        rows, columns, numbers = map(np.array, (rows, columns, numbers))
        pi, pt, pn = np.array(previous, np.int64).reshape(-1, 3).T
        squares = [np.full(BUCKETS, 1e-8), np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
        for _ in range(rounds):
            potential = np.full(gold.shape, field.bias)
            np.add.at(potential, (rows, columns), field.emission[numbers])
            np.add.at(potential, (pi, pt), field.before[pn])
            pairs = np.zeros((2, 2))
            tags = marginals(potential, field.transition, length, pairs, follows)
            wrong = np.where(inside, gold - tags, 0.0)
            steps = [
                np.bincount(numbers, wrong[rows, columns], BUCKETS) - 1e-2 * field.emission,
                np.bincount(pn, wrong[pi, pt], BUCKETS) - 1e-1 * field.before,
                wrong.sum(),
                moved - pairs,
            ]
            for k, g in enumerate(steps):
                squares[k] = squares[k] + g * g
                step = rate * g / np.sqrt(squares[k])
                if k == 0:
                    field.emission += step
                elif k == 1:
                    field.before += step
                elif k == 2:
                    field.bias += step
                else:
                    field.transition += step
    scorer = Scorer(field, np.zeros(4))
    x = scorer.summaries([t for t, _ in docs])[0]
    y = np.array([toxic for _, toxic in docs], np.float64)
    w = np.zeros(4)
    # both labels weigh the same in the fit
    part = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (part * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(4)
        w += np.linalg.solve(hessian, x.T @ (part * (y - p)) - 1e-4 * w)
    return field, w


class Scorer:
    """A trained model at work: keeps what each word adds to the potentials."""

    def __init__(self, field: Field, weights: np.ndarray):
        self.field, self.weights = field, weights
        self.known: dict[bytes, int] = {}
        self.adds = np.zeros((0, 3))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known, self.adds = {}, np.zeros((0, 3))
        index = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        fresh = []
        emission, before = self.field.emission, self.field.before
        for i in np.flatnonzero(index < 0).tolist():
            k = self.known.get(raw := words[i])
            if k is None:
                k = self.known[raw] = len(self.adds) + len(fresh)
                word = raw.decode().lower().strip(EDGES)
                fresh.append((sum(emission[bucket(f)] for f in features(word)), before[bucket(word)], raw[-1:] in STOPS))
            index[i] = k
        if fresh:
            self.adds = np.concatenate((self.adds, np.array(fresh, np.float64)))
        return index

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of each word of all texts, and how many words each text has. bytes.split knows ASCII space only."""
        words = [t.encode("utf-8", "replace").split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        n = int(counts.sum())
        if not n:
            return np.zeros(0), counts
        own, before, stop = self.adds_of([w for ws in words for w in ws])
        begin = np.concatenate(([True], stop[:-1]))
        begin[(np.cumsum(counts) - counts)[counts > 0]] = True
        potential = self.field.bias + own + np.where(begin, 0.0, np.concatenate(([0.0], before[:-1])))
        starts = np.flatnonzero(begin)
        row_begin = begin | ((np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))) % ROW == 0)
        starts = np.flatnonzero(row_begin)
        sizes = np.diff(np.append(starts, n))
        follows = ~begin[starts]
        at = np.arange(n) - np.repeat(starts, sizes)
        out, heads = np.zeros(n), np.flatnonzero(~follows)
        # whole chains together, in parts of about so many rows
        cuts = np.unique(np.append(heads[np.searchsorted(heads, np.arange(0, heads[-1] + 1, 16_384))], len(starts)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some, size = starts[a:b], sizes[a:b]
            tokens = slice(int(some[0]), int(some[-1] + size[-1]))
            row = np.repeat(np.arange(len(some)), size)
            padded = np.zeros((len(some), int(size.max())))
            padded[row, at[tokens]] = potential[tokens]
            out[tokens] = marginals(padded, self.field.transition, size, follows=follows[a:b])[row, at[tokens]]
        return out, counts

    def adds_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = self._numbers(words)
        adds = self.adds[index]
        return adds[:, 0], adds[:, 1], adds[:, 2] > 0

    def summaries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a document's score is made of (a row for each text), and what marginals() gives."""
        tags, counts = self.marginals(texts)
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        full = np.flatnonzero(counts)
        if len(full):
            begin = (np.cumsum(counts) - counts)[full]
            sure = np.add.reduceat(np.where(tags >= 0.2, tags, 0.0), begin)
            out[full, 1] = np.maximum.reduceat(tags, begin)
            out[full, 2] = np.log1p(sure)
            out[full, 3] = np.minimum(1, 20 * sure / counts[full])
        return out, tags, counts

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def spans_of(text: str, tags: np.ndarray) -> list[dict]:
    return [{"start": w.start(), "end": w.end()} for w, p in zip(WORDS.finditer(text), tags, strict=True) if p >= SPAN_LEAST]


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> list[tuple[str, int]]:
    """Texts and labels of the training part: labelled rows of at most SAMPLE_CHARS characters, half of each label at most."""
    known = labels.filter(F.col("toxic").isin(0, 1)).filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = []
    for toxic in (0, 1):
        ids = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2)
        rows = docs.filter(F.length(text_of()) <= SAMPLE_CHARS).join(F.broadcast(ids), "doc_id").select("doc_id", text_of().alias("text"), "toxic").orderBy("doc_id", "text").limit(limit)
        picked += sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect())
    return [(text, toxic) for _, text, toxic in picked]


def score_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, held_out, score, spans (start, end in code points)."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), **how)
    both = len({toxic for _, toxic in sample}) == 2
    field, weights = train(sample) if both else (Field(), np.zeros(4))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((field, weights))  # BUCKETS numbers twice
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        scorer = Scorer(*shared.value)
        for batch in sliced(batches, 2000, 8):
            texts = batch.column("text").to_pylist()
            x, tags, counts = scorer.summaries(texts)
            scores = scorer.scores(x) if both else np.zeros(len(texts))
            ends = np.cumsum(counts)
            spans = [spans_of(t, tags[e - c : e]) if m >= SPAN_LEAST else [] for t, e, c, m in zip(texts, ends, counts, x[:, 1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(spans, schema.types[3])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, spans array<struct<start:long,end:long>>")
