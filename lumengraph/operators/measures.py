"""Measures of region graphs, as joins and aggregates keyed by graph.

``keys`` name the columns that tell graphs apart; nodes hold ``keys, node`` and edges
``keys, src, dst, weight`` with ``src < dst``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.functions.ordered import exact_median
from lumengraph.operators import distances
from lumengraph.operators.graph import both_ways
from lumengraph.session import cut

KEYS = ("image_id",)
FLOOR = 1e-10


# --- local structure ---------------------------------------------------------------------------


def node_degree(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Degree and strength of every node, 0 for isolated ones."""
    found = both_ways(edges).groupBy(*keys, F.col("u").alias("node")).agg(
        F.count("*").alias("degree"), F.sum("w").alias("strength")
    )
    return nodes.select(*keys, "node").join(found, [*keys, "node"], "left").select(
        *keys,
        "node",
        F.coalesce("degree", F.lit(0)).alias("degree"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"),
    )


def node_strength(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    found = node_degree(nodes, edges, keys)
    return found.select(*keys, "node", F.greatest("strength", F.lit(FLOOR)).alias("strength"))


def triangles(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each triangle once: ``keys, a, b, c`` and its three weights.

    Edges point from the node of smaller degree to that of larger degree. A wedge
    starts at its smallest-degree corner, so a hub has few outgoing edges and the
    number of wedges stays below m * sqrt(2 m).
    """
    keys = list(keys)
    degree = both_ways(edges).groupBy(*keys, F.col("u").alias("node")).agg(F.count("*").alias("d"))
    side = lambda name: degree.select(*keys, F.col("node").alias(name), F.col("d").alias(f"d_{name}"))
    ranked = edges.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"])
    end = lambda name: F.struct(F.col(f"d_{name}").alias("d"), F.col(name).alias("node"))
    forward = end("src") < end("dst")
    out = ranked.select(
        *keys,
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"),
        F.when(forward, end("dst")).otherwise(end("src")).alias("far"),
        "weight",
    )
    one = out.select(*keys, "a", F.col("far").alias("f1"), F.col("weight").alias("w1"))
    two = out.select(*keys, "a", F.col("far").alias("f2"), F.col("weight").alias("w2"))
    wedge = one.join(two, [*keys, "a"]).where("f1 < f2").select(
        *keys, "a", F.col("f1.node").alias("b"), F.col("f2.node").alias("c"), "w1", "w2"
    )
    closing = out.select(*keys, F.col("a").alias("b"), F.col("far.node").alias("c"), F.col("weight").alias("w3"))
    return wedge.join(closing, [*keys, "b", "c"]).select(*keys, "a", "b", "c", "w1", "w2", "w3")


def clustering_weighted(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Geometric mean clustering of each node, weights scaled by the largest of the graph."""
    keys = list(keys)
    top = edges.groupBy(*keys).agg(F.max("weight").alias("top"))
    tri = triangles(edges, keys).join(top, keys)
    closeness = F.cbrt(
        F.col("w1") / F.col("top") * (F.col("w2") / F.col("top")) * (F.col("w3") / F.col("top"))
    )
    corner = tri.select(*keys, closeness.alias("t"), F.explode(F.array("a", "b", "c")).alias("node"))
    sums = corner.groupBy(*keys, "node").agg((F.sum("t") * 2).alias("t"))
    d = F.col("degree")
    return node_degree(nodes, edges, keys).join(sums, [*keys, "node"], "left").select(
        *keys,
        "node",
        F.when((d > 1) & F.col("t").isNotNull(), F.col("t") / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"),
    )


# --- distances -----------------------------------------------------------------------------------


def costs(edges: DataFrame, kind: str) -> DataFrame:
    """Arcs with ``cost``: 1 per hop, the inverse weight, or the weight itself."""
    cost = {
        "hops": F.lit(1.0),
        "inverse": F.lit(1.0) / F.greatest(F.col("w"), F.lit(FLOOR)),
        "weight": F.col("w"),
    }[kind]
    return both_ways(edges).withColumn("cost", cost).drop("w")


shortest_paths = distances.shortest_paths


def betweenness(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, kind: str = "inverse", batch: int = distances.SOURCES
) -> DataFrame:
    """Share of shortest paths through each node, scaled by (n-1)(n-2); ``batch`` sources at a time."""
    keys = list(keys)
    through = distances.path_shares(nodes, costs(edges, kind), keys, batch)
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 2, F.lit(1.0) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(F.lit(0.0))
    base = nodes.select(*keys, "node").join(through, [*keys, "node"], "left")
    return base.join(size, keys).select(
        *keys, "node", (F.coalesce("through", F.lit(0.0)) * scale).alias("betweenness")
    )


def closeness(nodes: DataFrame, sums: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """From ``distances.distance_sums``."""
    keys = list(keys)
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    others = F.col("reached") - 1
    value = F.when(
        (F.col("total") > 0) & (F.col("n") > 1), others / F.col("total") * (others / (F.col("n") - 1))
    ).otherwise(F.lit(0.0))
    return sums.join(size, keys).select(*keys, "node", value.alias("closeness"))


def eccentricity(nodes: DataFrame, hops: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest hop distance of each node, from ``distances.hop_sums``; infinite when the graph is not connected."""
    keys = list(keys)
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    far = F.when(F.col("reached") == F.col("n"), F.col("farthest")).otherwise(F.lit(float("inf")))
    return hops.join(size, keys).select(*keys, "node", far.alias("eccentricity"))


def global_efficiency(nodes: DataFrame, hops: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """From ``distances.hop_sums``."""
    keys = list(keys)
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    total = hops.groupBy(*keys).agg(F.sum("inverse").alias("inverse"))
    n = F.col("n")
    return size.join(total, keys, "left").select(
        *keys,
        F.when(n > 1, F.coalesce("inverse", F.lit(0.0)) / (n * (n - 1))).otherwise(F.lit(0.0)).alias("global_efficiency"),
    )


def local_efficiency(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over nodes of the efficiency among a node's neighbours.

    The edges among the neighbours of a node are its triangles' far sides, so the
    neighbour graphs are one table with the node as an extra key.
    """
    keys = list(keys)
    ego_keys = [*keys, "ego"]
    tri = triangles(edges, keys)
    sides = F.array(
        *[
            F.struct(F.col(e).alias("ego"), F.least(p, q).alias("src"), F.greatest(p, q).alias("dst"))
            for e, p, q in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))
        ]
    )
    ego_edges = tri.select(*keys, F.inline(sides)).withColumn("weight", F.lit(1.0))
    ego_nodes = both_ways(edges).select(*keys, F.col("u").alias("ego"), F.col("v").alias("node"))
    ego_nodes, ego_edges = cut(ego_nodes), cut(ego_edges)
    hops = distances.hop_sums(ego_nodes, costs(ego_edges, "hops"), ego_keys)
    eff = global_efficiency(ego_nodes, hops, ego_keys).withColumnRenamed("ego", "node")
    return nodes.select(*keys, "node").join(eff, [*keys, "node"], "left").groupBy(*keys).agg(
        F.avg(F.coalesce("global_efficiency", F.lit(0.0))).alias("local_efficiency")
    )


def char_path_length(
    nodes: DataFrame, sums: DataFrame, components: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean distance, from ``distances.distance_sums``; over several components the mean of theirs weighted by size.

    Components of one node do not count; a graph of such only has no length (infinite).
    """
    keys = list(keys)
    size = components.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    of = components.select(*keys, "node", "component")
    total = sums.join(of.hint("merge"), [*keys, "node"]).groupBy(*keys, "component").agg(F.sum("total").alias("total"))
    n = F.col("n")
    each = size.join(total.hint("merge"), [*keys, "component"]).where("n > 1").select(
        *keys, n.alias("n"), (F.col("total") / (n * (n - 1))).alias("length")
    )
    found = each.groupBy(*keys).agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("length"))
    return nodes.select(*keys).distinct().join(found, keys, "left").select(
        *keys, F.coalesce("length", F.lit(float("inf"))).alias("char_path_length")
    )


# --- whole graph -----------------------------------------------------------------------------------


def average_clustering(clustering: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return clustering.groupBy(*keys).agg(F.avg("clustering").alias("global_clustering"))


def density(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    keys = list(keys)
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    links = edges.groupBy(*keys).agg(F.count("*").alias("m"))
    n = F.col("n")
    return size.join(links, keys, "left").select(
        *keys, F.when(n > 1, F.coalesce("m", F.lit(0)) * 2 / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density")
    )


def assortativity(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of the strengths at both ends of the arcs, 0 where undefined."""
    keys = list(keys)
    deg = node_degree(nodes, edges, keys)
    end = lambda at, name: deg.select(*keys, F.col("node").alias(at), F.col("strength").alias(name))
    arcs = both_ways(edges).join(end("u", "x"), [*keys, "u"]).join(end("v", "y"), [*keys, "v"])
    # The weights of an arc play no part in the correlation, only in the strengths.
    found = arcs.groupBy(*keys).agg(
        F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("var"), F.max("x").alias("hi"), F.min("x").alias("lo")
    )
    # Both ends have the same spread. Equal strengths, up to rounding, leave it undefined.
    varies = (F.col("hi") - F.col("lo")) > F.abs("hi") * 1e-12
    return nodes.select(*keys).distinct().join(found, keys, "left").select(
        *keys, F.when(varies, F.col("cov") / F.col("var")).otherwise(F.lit(0.0)).alias("assortativity")
    )


def transitivity(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    keys = list(keys)
    tri = triangles(edges, keys).groupBy(*keys).agg(F.count("*").alias("tri"))
    d = F.col("degree")
    open_ = node_degree(nodes, edges, keys).groupBy(*keys).agg(F.sum(d * (d - 1) / 2).alias("triples"))
    return open_.join(tri, keys, "left").select(
        *keys,
        F.when(F.col("triples") > 0, F.coalesce("tri", F.lit(0)) * 3 / F.col("triples"))
        .otherwise(F.lit(0.0))
        .alias("transitivity"),
    )


def rich_club(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, top: int = 5) -> DataFrame:
    """Mean over k of the density among nodes of degree above k, k = 1 .. min(top, max degree)."""
    keys = list(keys)
    deg = node_degree(nodes, edges, keys)
    ks = range(1, top + 1)
    members = deg.groupBy(*keys).agg(
        F.max("degree").alias("max_degree"), *[F.count_if(F.col("degree") > k).alias(f"n{k}") for k in ks]
    )
    end = lambda at, name: deg.select(*keys, F.col("node").alias(at), F.col("degree").alias(name))
    ends = edges.join(end("src", "d1"), [*keys, "src"]).join(end("dst", "d2"), [*keys, "dst"])
    links = ends.groupBy(*keys).agg(
        *[F.count_if(F.least("d1", "d2") > k).alias(f"e{k}") for k in ks]
    )
    joined = members.join(links, keys, "left")
    n, e = (lambda k: F.col(f"n{k}")), (lambda k: F.coalesce(F.col(f"e{k}"), F.lit(0)))
    phi = lambda k: F.when(n(k) > 1, e(k) * 2 / (n(k) * (n(k) - 1))).otherwise(F.lit(0.0))
    counted = [F.when(F.col("max_degree") >= k, phi(k)).otherwise(F.lit(0.0)) for k in ks]
    total = counted[0]
    for c in counted[1:]:
        total = total + c
    used = F.least(F.col("max_degree"), F.lit(top))
    return joined.select(*keys, F.when(used > 0, total / used).otherwise(F.lit(0.0)).alias("rich_club_coefficient"))


def summary_statistics(values: DataFrame, value: str, keys: Sequence[str] = KEYS, median: bool = True) -> DataFrame:
    """Mean, spread, extremes and median of a node measure; infinite counts as 1e10."""
    keys = list(keys)
    v = F.when(F.col(value) == float("inf"), F.lit(1e10)).otherwise(F.col(value))
    clean = values.select(*keys, v.alias("_v"))
    stats = clean.groupBy(*keys).agg(
        F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    if not median:
        return stats
    return stats.join(exact_median(clean, keys, "_v"), keys)


# What stands in for a measure that could not be computed.
NODE_DEFAULTS = {"clustering": 0.0, "strength": 1.0, "betweenness": 0.0, "closeness": 0.0, "eccentricity": float("inf")}
GRAPH_DEFAULTS = {
    "local_efficiency": 0.0, "char_path_length": float("inf"), "global_efficiency": 0.0, "global_clustering": 0.0,
    "density": 0.0, "assortativity": 0.0, "transitivity": 0.0, "rich_club_coefficient": 0.0,
}


def with_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Replace missing and NaN measures by their defaults."""
    fill: dict[str, Column] = {
        c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items() if c in df.columns
    }
    return df.withColumns(fill)


def structure_measures(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The whole-graph measures that need no distances, one row per graph."""
    keys = list(keys)
    out = density(nodes, edges, keys)
    for part in (
        average_clustering(clustering_weighted(nodes, edges, keys), keys),
        assortativity(nodes, edges, keys),
        transitivity(nodes, edges, keys),
        rich_club(nodes, edges, keys),
    ):
        out = out.join(part, keys, "left")
    return out
