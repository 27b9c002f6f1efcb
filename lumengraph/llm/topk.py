"""Exact top-k by inner product with MaxScore over shards.

Each component is a term: a query's impact on a candidate is the product of their
components less the least product possible in the shard, so impacts are never negative, and
the largest one is the term's bound. Terms are ordered by bound. With a threshold (the k-th
best score of a first part of the shard) the last terms, whose bounds together stay below
it, are non-essential: they alone lift nobody over it. The postings of the essential terms
are traversed for all candidates; the others are probed, a few terms at a time, only for
candidates that can still reach the threshold. The k best of each shard are merged.

Queries go to every shard, in blocks; both sides of a (shard, block) pair are bounded, and
nothing is broadcast. Rows with a null id, and vectors that are null or hold null or
non-finite components, take no part. Shorter vectors count as ending in zeros. Rows that
repeat id and vector are searched once and take a rank each as candidates; as queries they
are one. Rows that repeat an id with another vector are candidates (and queries) of their
own, and none is a candidate of a query with its id. Ties go to the
smaller id. Products are exact as long as they fit in 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.session import cut

SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: Candidates that set the first threshold; queries handled together; terms probed at a time.
FIRST, TOGETHER, STEP = 1024, 128, 8


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, vector, copies: the little-endian 64-bit floors of the scaled components, of the rows that take part, and how many share both."""

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if vec_id is None or not vector.is_valid:
                    continue
                values = vector.values
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
                if values.null_count or not np.isfinite(x).all():
                    continue
                ids.append(vec_id)
                out.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(floor, "vec_id long, vector binary").groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        values = np.frombuffer(raw, "<i8")
        out[i, : len(values)] = values
    return out


def max_score(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``rows``, scores) of the k best of each query; ``ids`` rise, and a query's own id is left out."""
    if not len(rows) or not queries.shape[1]:
        for own in query_ids:
            place = np.flatnonzero(ids != own)[:k]
            yield place, np.zeros(len(place), np.int64)
        return
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * rows.shape[1]
    kind = np.float32 if most < 1 << 22 else np.float64 if most < 1 << 51 else np.int64
    low, high = rows.min(axis=0), rows.max(axis=0)
    for at in range(0, len(queries), TOGETHER):
        part, own = queries[at : at + TOGETHER], query_ids[at : at + TOGETHER]
        least, greatest = np.minimum(part * low, part * high), np.maximum(part * low, part * high)
        order = np.argsort(-(greatest - least).sum(axis=0), kind="stable")
        q, c = part[:, order].astype(kind), rows[:, order].astype(kind)
        least, bound = least[:, order], (greatest - least)[:, order]
        after = np.concatenate([np.cumsum(bound[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), bound.dtype)], axis=1)
        base = least.sum(axis=1)

        first = (q @ c[:FIRST].T).astype(np.int64)
        first[own[:, None] == ids[None, :FIRST]] = np.iinfo(np.int64).min
        if first.shape[1] > k:
            threshold = np.partition(first, -k, axis=1)[:, -k]
        else:
            threshold = np.full(len(q), np.iinfo(np.int64).min)
        need = np.where(threshold == np.iinfo(np.int64).min, -1, threshold - base)  # in impacts
        essential = int((after >= np.maximum(need, 0)[:, None]).sum(axis=1).max())
        essential = min(max(essential, 1), q.shape[1])
        seen = (q[:, :essential] @ c[:, :essential].T).astype(np.int64) - least[:, :essential].sum(axis=1)[:, None]
        for i in range(len(q)):
            place = np.flatnonzero(seen[i] + after[i, essential] >= need[i])
            place = place[ids[place] != own[i]]
            score = seen[i, place]
            for term in range(essential, q.shape[1], STEP):
                upto = min(term + STEP, q.shape[1])
                score = score + (c[place, term:upto] @ q[i, term:upto]).astype(np.int64) - least[i, term:upto].sum()
                fit = score + after[i, upto] >= need[i]
                place, score = place[fit], score[fit]
            best = np.lexsort((place, -score))[:k]
            yield place[best], score[best] + base[i]


def search(vectors: DataFrame, is_query, k: int, scale: float) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row for which ``is_query`` holds."""
    rows = cut(whole_vectors(vectors, scale))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.length("vector")).alias("w")).first()
    shards, blocks, width = -(-size["n"] // SHARD_ROWS) or 1, -(-size["q"] // BLOCK_QUERIES) or 1, (size["w"] or 0) // 8
    number = F.xxhash64("vec_id", "vector")
    candidates = rows.select(F.pmod(number, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vector", "copies")
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(number, F.lit(blocks)).alias("block"), "vec_id", "vector")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        ids, own = (t.column("vec_id").to_numpy() for t in (right, left))
        found = list(max_score(_matrix(left.column("vector"), width), own, _matrix(right.column("vector"), width), ids, k)) if len(left) else []
        if not found:
            return pa.table({"query_id": pa.array([], pa.int64()), "query": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        query = np.repeat(np.arange(len(own)), [len(p) for p, _ in found])
        place, score = np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])
        copies = right.column("copies").to_numpy()[place]
        return pa.table({"query_id": own[query], "query": left.column("vector").take(pa.array(query)), "vec_id": ids[place], "copies": copies, "score": score.astype(np.int64)})

    keys = [F.col("shard"), F.col("block")]
    queries, candidates = (x.withColumns({c: F.col(c).cast("long") for c in ("shard", "block")}) for x in (queries, candidates))
    tops = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(best, "query_id long, query binary, vec_id long, copies long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    tops = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = tops.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))  # later copies are past rank k
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
