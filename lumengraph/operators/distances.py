"""Sums over the distances of a graph without a table of all pairs.

Searches start from a batch of sources at once. For hops a node keeps bits, one for each
source that has reached it; for weighted paths a row for each source of the batch. After a
batch a node has only sums left, so what is held is nodes times batch, never nodes times
nodes. All graphs are searched side by side; a graph of fewer nodes than a batch has sources
takes part in the first one only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions.ordered import with_rank
from lumengraph.session import cut

KEYS = ("image_id",)
#: Sources of a batch: 64 in each word for hops, and for weighted paths.
WORDS, SOURCES = 16, 1024
TIE = 1e-9
_SUMS = ("reached", "total", "farthest", "inverse")


def numbered(nodes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """``keys, node, nth`` with the nodes of a graph counted from 0, written; and the most nodes of a graph."""
    ranked = with_rank(nodes.select(*keys, "node"), keys, "node", "node", "_rank")
    found = cut(ranked.select(*keys, "node", (F.col("_rank") - 1).alias("nth")))
    return found, found.agg(F.coalesce(F.max("nth") + 1, F.lit(0))).first()[0]


def _merge(parts: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The sums of all batches."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys, "node").agg(
        F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("farthest").alias("farthest"), F.sum("inverse").alias("inverse")
    )


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def hop_sums(nodes: DataFrame, arcs: DataFrame, keys: Sequence[str] = KEYS, words: int = WORDS) -> DataFrame:
    """``keys, node, reached, total, farthest, inverse``: nodes that reach a node by arcs (``keys, u, v``), itself
    included, the sum and the largest of their hops, and the sum of 1 / hops of the others."""
    keys = list(keys)
    arcs = cut(arcs.select(*keys, F.col("u").alias("node"), F.col("v").alias("next")))
    found, most = numbered(nodes, keys)
    words = max(1, min(words, -(-most // 64)))
    seen, fresh = [f"seen{i}" for i in range(words)], [f"fresh{i}" for i in range(words)]
    parts = []
    for first in range(0, max(most, 1), 64 * words):
        place = F.col("nth") - first
        bit = [F.when((place >= 64 * i) & (place < 64 * i + 64), F.expr(f"shiftleft(1L, CAST(nth - {first + 64 * i} AS INT))")).otherwise(F.lit(0).cast("long")) for i in range(words)]
        own = (place >= 0) & (place < 64 * words)
        state = cut(found.select(
            *keys, "node", *[b.alias(n) for b, n in zip(bit, seen, strict=True)], *[b.alias(n) for b, n in zip(bit, fresh, strict=True)],
            own.cast("long").alias("reached"), F.lit(0.0).alias("total"), F.lit(0.0).alias("farthest"), F.lit(0.0).alias("inverse"),
        ))
        hops = 0
        while True:
            hops += 1
            going = state.where(_any([F.col(f) != 0 for f in fresh])).select(*keys, "node", *fresh)
            sent = going.join(arcs, [*keys, "node"]).groupBy(*keys, F.col("next").alias("node")).agg(*[F.bit_or(f).alias(f) for f in fresh])
            arrived = sent.select(*keys, "node", *[F.col(f).alias(f"_{f}") for f in fresh])
            new = [F.coalesce(F.col(f"_{f}"), F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(s)) for f, s in zip(fresh, seen, strict=True)]
            count = sum((F.bit_count(n) for n in new[1:]), F.bit_count(new[0]))
            state = cut(state.join(arrived, [*keys, "node"], "left").select(
                *keys, "node", *[F.col(s).bitwiseOR(n).alias(s) for s, n in zip(seen, new, strict=True)], *[n.alias(f) for f, n in zip(fresh, new, strict=True)],
                (F.col("reached") + count).alias("reached"), (F.col("total") + count * float(hops)).alias("total"),
                F.when(count > 0, F.lit(float(hops))).otherwise(F.col("farthest")).alias("farthest"), (F.col("inverse") + count / float(hops)).alias("inverse"),
            ))
            if state.where(_any([F.col(f) != 0 for f in fresh])).isEmpty():
                break
        parts.append(state.select(*keys, "node", *_SUMS))
    return _merge(parts, keys)


def shortest_paths(
    nodes: DataFrame, arcs: DataFrame, keys: Sequence[str] = KEYS, sources: DataFrame | None = None
) -> DataFrame:
    """Distances ``keys, s, t, d`` of all reachable pairs, the node itself included; of some ``sources`` (``keys, node``) if given.

    Only pairs that got shorter in a round are extended in the next one, by an
    equi-join on (graph, node) and a partial aggregate per pair. No group is gathered;
    the state is the answer itself. Rounds: the hops of the longest shortest path. They join by
    merge, as a broadcast in each would add up on the driver.
    """
    keys = list(keys)
    arcs = arcs.select(*keys, F.col("u").alias("t"), F.col("v").alias("next"), "cost").hint("merge")
    begin = nodes if sources is None else sources
    known = cut(begin.select(*keys, F.col("node").alias("s"), F.col("node").alias("t"), F.lit(0.0).alias("d"), F.lit(True).alias("new")))
    while True:
        step = known.where("new").join(arcs, [*keys, "t"]).select(
            *keys, "s", F.col("next").alias("t"), (F.col("d") + F.col("cost")).alias("d"), F.lit(None).cast("double").alias("old")
        )
        merged = (
            known.select(*keys, "s", "t", "d", F.col("d").alias("old"))
            .unionByName(step)
            .groupBy(*keys, "s", "t")
            .agg(F.min("d").alias("d"), F.min("old").alias("old"))
        )
        known = cut(merged.select(*keys, "s", "t", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new")))
        if known.where("new").isEmpty():
            return known.drop("new")


def _batches(nodes: DataFrame, keys: list[str], sources: int) -> Iterator[DataFrame]:
    """``keys, node`` of the sources of each batch."""
    found, most = numbered(nodes, keys)
    for first in range(0, max(most, 1), sources):
        yield found.where((F.col("nth") >= first) & (F.col("nth") < first + sources)).select(*keys, "node")


def distance_sums(nodes: DataFrame, arcs: DataFrame, keys: Sequence[str] = KEYS, sources: int = SOURCES) -> DataFrame:
    """As ``hop_sums``, for the lengths of shortest paths along arcs (``keys, u, v, cost``)."""
    keys, arcs, parts = list(keys), cut(arcs), []
    for batch in _batches(nodes, keys, sources):
        pairs = shortest_paths(nodes, arcs, keys, batch)
        parts.append(cut(pairs.groupBy(*keys, F.col("t").alias("node")).agg(
            F.count("*").alias("reached"), F.sum("d").alias("total"), F.max("d").alias("farthest"),
            F.coalesce(F.sum(F.when(F.col("d") > 0, 1.0 / F.col("d"))), F.lit(0.0)).alias("inverse"),
        )))
    return _merge(parts, keys)


def _through(nodes: DataFrame, arcs: DataFrame, keys: list[str], sources: DataFrame) -> DataFrame | None:
    """``keys, node, through`` for the paths from some sources; none if no path has an inner node.

    The arcs that lie on shortest paths from s form a DAG. Path counts flow along it
    from s, dependencies flow back; both are sums over arcs, so each round sends what
    arrived in the last one. Work is the DAG size, never node triples.
    """
    dist = shortest_paths(nodes, arcs, keys, sources)
    near = dist.select(*keys, "s", F.col("t").alias("u"), F.col("d").alias("du"))
    far = dist.select(*keys, "s", F.col("t").alias("v"), F.col("d").alias("dv"))
    dag = cut(
        near.join(arcs, [*keys, "u"])
        .join(far, [*keys, "s", "v"])
        .where(F.abs(F.col("du") + F.col("cost") - F.col("dv")) <= F.col("dv") * TIE)
        .select(*keys, "s", "u", "v")
    )
    wave = cut(sources.select(*keys, F.col("node").alias("s"), F.col("node").alias("u"), F.lit(1.0).alias("c")))
    total = wave
    while True:
        wave = cut(
            wave.join(dag, [*keys, "s", "u"]).groupBy(*keys, "s", F.col("v").alias("u")).agg(F.sum("c").alias("c"))
        )
        if wave.isEmpty():
            break
        total = total.unionByName(wave)
    paths = cut(total.groupBy(*keys, "s", "u").agg(F.sum("c").alias("c")))
    back = paths.select(*keys, "s", F.col("u").alias("v"), (F.lit(1.0) / F.col("c")).alias("g"))
    gained = None
    while True:
        back = cut(
            back.join(dag, [*keys, "s", "v"]).groupBy(*keys, "s", F.col("u").alias("v")).agg(F.sum("g").alias("g"))
        )
        if back.isEmpty():
            break
        gained = back if gained is None else gained.unionByName(back)
    if gained is None:
        return None
    return cut(
        gained.groupBy(*keys, "s", "v")
        .agg(F.sum("g").alias("g"))
        .withColumnRenamed("v", "u")
        .join(paths, [*keys, "s", "u"])
        .where("s <> u")
        .groupBy(*keys, F.col("u").alias("node"))
        .agg(F.sum(F.col("g") * F.col("c")).alias("through"))
    )


def path_shares(nodes: DataFrame, arcs: DataFrame, keys: Sequence[str] = KEYS, sources: int = SOURCES) -> DataFrame:
    """``keys, node, through``: the shares of shortest paths between other nodes that lead through a node, summed over ordered pairs."""
    keys, arcs = list(keys), cut(arcs.select(*keys, "u", "v", "cost"))
    parts = [_through(nodes, arcs, keys, batch) for batch in _batches(nodes, keys, sources)]
    whole = nodes.select(*keys, "node", F.lit(0.0).alias("through"))
    for part in parts:
        whole = whole if part is None else whole.unionByName(part)
    return whole.groupBy(*keys, "node").agg(F.sum("through").alias("through"))
