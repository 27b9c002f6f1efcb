"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get the log-odds of their rate in toxic against clean documents, under Dirichlet
priors in proportion to their rate in both. A word is read as itself and as its beginnings
of four to six bytes; its score is that of the longest reading whose log-odds are
significant, else a small negative drift. One linear scan of a document finds all its
maximal segments, each of which scores more than any part or extension that does not join
another. Scores are made comparable by extreme-value statistics: lambda solves
sum(p * exp(lambda * score)) = 1 over the tokens of clean documents, and K is set so that
best segments of clean documents have the mean of their Gumbel law. A document's score is a
logistic curve over its best and its summed normalised segment scores, fitted on the sample.

Only a bounded sample of labelled rows is learned from (`SAMPLE`, lowest hash of the id);
every document is scored, by its whole text. Null and empty texts have no segments and get
the score of that. With no labelled rows of both kinds every score is 0. Repeated rows are
scored each; of labels that repeat an id, any toxic one counts. An empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import fold, texts
from lumengraph.llm.kernel import LOWER, Words, byte_sums, slices
from lumengraph.session import cut

#: Labelled documents learned from, at most.
SAMPLE = 100_000
BEGINNINGS = (4, 5, 6)
#: The Dirichlet prior: a count of its own for each token, and counts dealt in proportion to the
#: token's rate; the least z of a log-odds; and its bounds.
OWN, PRIOR, LEAST_Z, MOST = 0.5, 500.0, 3.3, 8.0
#: Lower z, tried in turn when few toxic documents are labelled: of ten, no word can reach ``LEAST_Z``.
#: The first is taken at which a toxic document holds one significant toxic token on average.
FALLBACK_Z = (2.6, 2.0)
#: Least log-odds of a toxic token; less than that is what copies of a few documents bring about.
LEAST_ODDS = 2.0
#: Score of a token without significant log-odds.
DRIFT = -0.3
#: Normalised score (in nats above chance) from which a segment is reported.
SIGNIFICANT = 3.0

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


@dataclasses.dataclass(frozen=True)
class Model:
    """Sorted token hashes with their scores, the statistics of chance, and the logistic curve."""

    tokens: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)


def _readings(data: np.ndarray, bounds: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    """The words of a slice and their hashes, longest reading first; 0 where a word is no longer."""
    data = LOWER[data]
    words = Words(data, bounds, _GAP)
    sums = byte_sums(data)
    out = [sums.of(words.start, words.end)]
    for length in sorted(BEGINNINGS, reverse=True):
        longer = words.end - words.start > length
        end = np.where(longer, words.start + length, words.end)
        out.append(np.where(longer, sums.of(words.start, end) ^ np.uint64(length), np.uint64(0)))
    return words, out


def _word_scores(model: Model, readings: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(readings[0]), DRIFT)
    if len(model.tokens):
        open_ = np.ones(len(out), bool)
        for hashes in readings:
            at = np.minimum(np.searchsorted(model.tokens, hashes), len(model.tokens) - 1)
            hit = open_ & (model.tokens[at] == hashes)
            out[hit] = model.scores[at[hit]]
            open_ &= ~hit
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, left to right, in linear time.

    A stack holds disjoint candidates with the running total before and after each. A new run
    of positive scores looks for the nearest candidate that starts lower than it; if that one
    also ends lower than it ends, the two and all between become one and the search repeats.
    """
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.diff(positive.astype(np.int8), prepend=0, append=0)
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest lower
    for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        low, high = total[start], total[end]
        nearest = len(stack) - 1
        while True:
            while nearest >= 0 and stack[nearest][2] >= low:
                nearest = stack[nearest][4]
            if nearest < 0 or stack[nearest][3] >= high:
                break
            start, _, low, _, before = stack[nearest]
            del stack[nearest:]
            nearest = before
        stack.append((start, end, low, high, nearest))
    return [(s, e, float(b - a)) for s, e, a, b, _ in stack]


def _segments(text: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray]]:
    """(number of words, segments, word scores) of each text."""
    for _, _, data, bounds in slices(text):
        words, readings = _readings(data, bounds)
        scores = _word_scores(model, readings)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            own = scores[a:b]
            yield b - a, maximal_segments(own), own


def _features(n: int, segments: list[tuple[int, int, float]], model: Model) -> tuple[float, float]:
    """The best normalised score, and the logarithm of the sum of those above 0."""
    base = model.log_k + np.log(max(n, 1))
    normal = [model.rate * s - base for _, _, s in segments]
    return max(normal, default=-base), float(np.log1p(sum(x for x in normal if x > 0)))


def sample_of(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """toxic, text of the labelled documents outside fold 0 with the lowest hashes of their ids, at most ``limit``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where((fold() > 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most limit * 16 bytes
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def token_scores(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of the significant tokens; a document counts a token once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist(), bool)
            for first, end, data, bounds in slices(batch.column("text")):
                words, readings = _readings(data, bounds)
                row = np.searchsorted(words.first, np.arange(len(words.start)), side="right") - 1
                rows, hashes = np.tile(row, len(readings)), np.concatenate(readings)
                order = np.lexsort((rows, hashes))
                rows, hashes = rows[order], hashes[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                rows, hashes = rows[new & (hashes != 0)], hashes[new & (hashes != 0)]
                kinds, place = np.unique(hashes, return_inverse=True)
                n1 = np.bincount(place, toxic[first:end][rows], len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n1), pa.array(np.bincount(place, minlength=len(kinds)) - n1)], ["token", "n1", "n0"])

    counts = cut(sample.mapInArrow(count, "token long, n1 long, n0 long").groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    total = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0")).first()
    if not total["t1"] or not total["t0"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    both = float(total["t1"] + total["t0"])
    prior = F.lit(OWN) + F.lit(PRIOR / both) * (F.col("n1") + F.col("n0"))
    odds = F.log((F.col("n1") + prior) / (F.lit(total["t1"] + PRIOR) - F.col("n1") - prior)) - F.log((F.col("n0") + prior) / (F.lit(total["t0"] + PRIOR) - F.col("n0") - prior))
    z = odds / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    rated = counts.select("token", "n1", odds.alias("odds"), z.alias("z"))
    levels = (LEAST_Z, *FALLBACK_Z)
    toxic = lambda level: (F.col("z") >= level) & (F.col("odds") >= LEAST_ODDS)
    found = rated.agg(*[F.sum(F.when(toxic(level), F.col("n1"))) for level in levels]).first()
    documents = sample.where("toxic = 1").count()
    level = next((level for level, n in zip(levels, found, strict=True) if (n or 0) >= documents), levels[-1])
    odd = rated.where(toxic(level) | (F.col("z") <= -LEAST_Z)).toPandas()
    tokens = odd["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.clip(odd["odds"].to_numpy()[order], -MOST, MOST)


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive solution of sum(shares * exp(rate * scores)) = 1."""
    if not (scores > 0).any() or scores @ shares >= 0:
        return 1.0
    low, high = 0.0, 1.0
    excess = lambda x: shares @ np.exp(x * scores) - 1
    while excess(high) < 0:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if excess(middle) > 0 else (middle, high)
    return high


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic weights by Newton's method with a small ridge; slopes are kept from falling below 0."""
    rows = np.column_stack([np.ones(len(x)), x])
    weight = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weight, -30, 30)))
        ridge = np.array([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(ridge), rows.T @ (y - p) - ridge * weight)
        weight += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(weight[0]), float(max(weight[1], 0)), float(max(weight[2], 0))


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The model of a bounded sample: token scores, chance, and the curve."""
    sample = cut(sample_of(docs, labels, limit))
    tokens, scores = token_scores(sample)
    if not len(tokens):
        return Model(tokens, scores)
    bare = Model(tokens, scores)
    shared = sample.sparkSession.sparkContext.broadcast(bare)

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = batch.filter(pa.array([not x for x in batch.column("toxic").to_pylist()]))
            found = [own for _, _, own in _segments(clean.column("text"), shared.value)]
            values, times = np.unique(np.round(np.concatenate([np.zeros(0), *found]), 2), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times)], ["score", "n"])

    law = sample.mapInArrow(chance, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    shares = law["n"].to_numpy() / max(law["n"].sum(), 1)
    rate = _rate(law["score"].to_numpy(), shares)

    def bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(int(n), [s for _, _, s in seg]) for n, seg, _ in _segments(batch.column("text"), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64()))], ["toxic", "n", "segments"])

    # at most ``limit`` rows of a bounded sample
    rows = sample.mapInArrow(bests, "toxic int, n long, segments array<double>").toPandas()
    clean = rows[(rows["toxic"] == 0) & (rows["n"] > 0)]
    gumbel = np.array([rate * max(s, default=0.0) - np.log(n) for s, n in zip(clean["segments"], clean["n"], strict=True)])
    model = Model(tokens, scores, rate, float(gumbel.mean() - np.euler_gamma) if len(gumbel) else 0.0)
    x = np.array([_features(n, [(0, 0, v) for v in s], model) for s, n in zip(rows["segments"], rows["n"], strict=True)])
    return dataclasses.replace(model, curve=_fit_curve(x, rows["toxic"].to_numpy().astype(float)))


def _share(docs: DataFrame, model: Model) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(model)


def toxic_passages(docs: DataFrame, model: Model, least: float = SIGNIFICANT) -> DataFrame:
    """doc_id, start, end (words of letters and digits), score and normalised score of each significant segment."""
    shared = _share(docs, model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, (n, segments, _) in zip(batch.column("doc_id").to_pylist(), _segments(batch.column("text"), shared.value), strict=True):
                base = shared.value.log_k + np.log(max(n, 1))
                rows += [(doc, a, b, s, shared.value.rate * s - base) for a, b, s in segments if shared.value.rate * s - base >= least]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "score", "normal"])

    return texts(docs).mapInArrow(find, "doc_id long, start long, end long, score double, normal double")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, n_passages of every document."""
    shared = _share(docs, model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [(int(n), sum(own.rate * s - own.log_k - np.log(max(n, 1)) >= SIGNIFICANT for _, _, s in seg), *_features(n, seg, own)) for n, seg, _ in _segments(batch.column("text"), own)]
            n, passages, best, total = (np.array(c) for c in (zip(*found, strict=True) if found else [[]] * 4))
            score = 1 / (1 + np.exp(-np.clip(own.curve[0] + own.curve[1] * best + own.curve[2] * total, -700, 700)))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(passages.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_words", "n_passages"])

    rows = texts(docs).withColumn("held_out", fold() == 0)
    return rows.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int, n_words long, n_passages long")
