"""Region graphs: nodes, adjacency, similarity edges, components.

Nodes are ``image_id, node, l, a, b, cy, cx``; edges ``image_id, src, dst, weight``
with ``src < dst``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.operators.raster import with_neighbours
from lumengraph.session import cut

NODE = ("image_id", "node")
PAIR = ("image_id", "src", "dst")

# Weights and scales of the similarity.
COLOUR_SHARE = 0.7
POSITION_SHARE = 0.3
COLOUR_REACH = 100.0
POSITION_REACH = math.sqrt(2.0)


def normalize_positions(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Node positions as shares of the image size, for similarity on [0, 1] positions."""
    return (
        nodes.join(sizes, "image_id")
        .withColumn("cy", F.col("cy") / F.col("height"))
        .withColumn("cx", F.col("cx") / F.col("width"))
        .drop("height", "width")
    )


def region_adjacency(strips: DataFrame, seg: str = "seg") -> DataFrame:
    """Touching regions ``(image_id, src, dst, border)`` with their common border length.

    Runs of equal pairs are counted within a line first, so a line sends at most one
    row per pair of regions.
    """
    near = with_neighbours(strips, [seg], 0, 1, border="none", side=0)
    line, below = F.get(seg, F.lit(0)), F.get(seg, F.lit(1))
    none = F.array().cast("array<struct<p:int,q:int>>")
    pair = lambda p, q: F.struct(F.least(p, q).cast("int").alias("p"), F.greatest(p, q).cast("int").alias("q"))
    beside = F.when(
        F.col("width") > 1,
        F.zip_with(F.slice(line, 1, F.col("width") - 1), F.slice(line, 2, F.col("width") - 1), pair),
    ).otherwise(none)
    under = F.when(F.size(seg) > 1, F.zip_with(line, below, pair)).otherwise(none)
    touching = F.filter(F.concat(beside, under), lambda s: s["p"] != s["q"])
    return (
        near.select("image_id", F.explode(touching).alias("t"))
        .groupBy("image_id", F.col("t.p").alias("src"), F.col("t.q").alias("dst"))
        .agg(F.count("*").alias("border"))
    )


def similarity(p: str, q: str) -> Column:
    """Weighted mix of colour and position closeness of two node aliases."""
    gap = lambda names: F.sqrt(
        sum(
            ((F.col(f"{p}.{n}") - F.col(f"{q}.{n}")) * (F.col(f"{p}.{n}") - F.col(f"{q}.{n}")) for n in names[1:]),
            (F.col(f"{p}.{names[0]}") - F.col(f"{q}.{names[0]}"))
            * (F.col(f"{p}.{names[0]}") - F.col(f"{q}.{names[0]}")),
        )
    )
    near = lambda d, reach: F.lit(1.0) - F.least(d / reach, F.lit(1.0))
    return near(gap(("l", "a", "b")), COLOUR_REACH) * COLOUR_SHARE + near(gap(("cy", "cx")), POSITION_REACH) * POSITION_SHARE


def pair_similarity(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of the given pairs as ``image_id, src, dst, weight``."""
    p = nodes.withColumnRenamed("node", "src").alias("p")
    q = nodes.withColumnRenamed("node", "dst").alias("q")
    joined = pairs.select(*PAIR).join(p, ["image_id", "src"]).join(q, ["image_id", "dst"])
    return joined.select(*PAIR, similarity("p", "q").alias("weight"))


def _cell_pairs(nodes: DataFrame, axes: Sequence[str], reach: float) -> DataFrame:
    """Node pairs whose distance over ``axes`` can be within ``reach``.

    Space is cut into cells of that size; a node meets the nodes of its own and the
    adjoining cells by an equi-join, each pair once.
    """
    cells = [F.floor(F.col(a) / reach).cast("int").alias(f"_{a}") for a in axes]
    own = nodes.select("image_id", "node", *cells)
    steps = [()]
    for _ in axes:
        steps = [s + (d,) for s in steps for d in (-1, 0, 1)]
    ahead = [s for s in steps if s >= (0,) * len(axes)]
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(s)]) for s in ahead])
    sent = own.select("image_id", "node", *[f"_{a}" for a in axes], F.explode(moves).alias("m")).select(
        "image_id",
        F.col("node").alias("n1"),
        F.expr(" and ".join(f"m.d{i} = 0" for i in range(len(axes)))).alias("same"),
        *[(F.col(f"_{a}") + F.col(f"m.d{i}")).alias(f"_{a}") for i, a in enumerate(axes)],
    )
    met = sent.join(own.withColumnRenamed("node", "n2"), ["image_id", *[f"_{a}" for a in axes]])
    return met.where("NOT same OR n1 < n2").select(
        "image_id", F.least("n1", "n2").alias("src"), F.greatest("n1", "n2").alias("dst")
    )


def candidate_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """A superset of the pairs with similarity above ``threshold``, without all pairs.

    Above 0.3 the position part alone cannot reach the threshold, so the colour
    distance is bounded. Below it, a pair needs some closeness in colour or position.
    """
    if threshold < 0:
        raise ValueError("a negative threshold would link every pair of nodes")
    spare = 1.0 - (threshold - POSITION_SHARE) / COLOUR_SHARE
    if threshold > POSITION_SHARE:
        # A hair wider than needed, so that no pair is lost to rounding.
        return _cell_pairs(nodes, ("l", "a", "b"), COLOUR_REACH * max(spare, 1e-9) * (1 + 1e-9))
    by_colour = _cell_pairs(nodes, ("l", "a", "b"), COLOUR_REACH)
    return by_colour.unionByName(_cell_pairs(nodes, ("cy", "cx"), POSITION_REACH)).distinct()


def build_edges(nodes: DataFrame, threshold: float = 0.5, adjacency: DataFrame | None = None) -> DataFrame:
    """Edges between similar (strictly above the threshold) or touching regions."""
    similar = pair_similarity(nodes, candidate_pairs(nodes, threshold)).where(F.col("weight") > threshold)
    if adjacency is None:
        return similar
    touching = pair_similarity(nodes, adjacency)
    return similar.unionByName(touching).groupBy(*PAIR).agg(F.max("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Arcs ``image_id, u, v, w`` in both directions."""
    ends = F.array(
        F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
        F.struct(F.col("dst").alias("u"), F.col("src").alias("v")),
    )
    keys = [c for c in edges.columns if c not in ("src", "dst", "weight")]
    return edges.select(*keys, F.explode(ends).alias("e"), F.col("weight").alias("w")).select(*keys, "e.u", "e.v", "w")


def connected_components(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """``keys, node, component``: the smallest node of each component.

    Each round a node offers its grandparent label to its neighbours and to its own
    parent, and then jumps to its label's label, so long chains shrink quickly. Hot
    nodes cost a partial aggregate, not a list. Rounds end when no label changes.
    """
    keys = list(keys)
    arcs = edges.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v"))
    arcs = cut(arcs.unionByName(arcs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = cut(nodes.select(*keys, "node", F.col("node").alias("parent")))
    while True:
        up = state.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("grand"))
        known = state.join(up, [*keys, "parent"])
        offers = arcs.join(
            known.select(*keys, F.col("node").alias("v"), F.col("grand").alias("offer")), [*keys, "v"]
        )
        # An offer goes to the neighbour and, to pull whole trees together, to its parent.
        to_node = offers.groupBy(*keys, F.col("u").alias("node")).agg(F.min("offer").alias("offer"))
        best = known.join(to_node, [*keys, "node"], "left")
        best = best.withColumn("low", F.least("grand", F.coalesce("offer", "grand")))
        moves = F.array(
            F.struct(F.col("node").alias("at"), F.least("parent", "low").alias("value"), F.col("parent").alias("was")),
            F.struct(F.col("parent").alias("at"), F.col("low").alias("value"), F.lit(None).cast(state.schema["parent"].dataType).alias("was")),
        )
        new = cut(
            best.select(*keys, F.inline(moves))
            .groupBy(*keys, F.col("at").alias("node"))
            .agg(F.min("value").alias("parent"), F.max("was").alias("was"))
        )
        changed = not new.where(F.col("parent") != F.col("was")).isEmpty()
        state = new.select(*keys, "node", "parent")
        if not changed:
            break
    return state.withColumnRenamed("parent", "component")


def repair_connectivity(nodes: DataFrame, edges: DataFrame, components: DataFrame, weight: float = 0.01) -> DataFrame:
    """Join each smaller component to the largest by one weak edge.

    Ends are the smallest nodes of both; of equally large components the one with the
    smallest node is the main one.
    """
    sizes = components.groupBy("image_id", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("image_id").agg(F.max(F.struct(F.col("n"), -F.col("component"))).alias("m"))
    main = main.select("image_id", (-F.col("m.col2")).alias("main"))
    weak = (
        sizes.join(main, "image_id")
        .where("component <> main")
        .select(
            "image_id",
            F.least("component", "main").alias("src"),
            F.greatest("component", "main").alias("dst"),
            F.lit(float(weight)).alias("weight"),
        )
    )
    return edges.select(*PAIR, "weight").unionByName(weak)
