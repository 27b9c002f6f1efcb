"""Queries of segment features, region graphs and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import distances, graph, measures
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.registry import query, rounded


def nodes_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = tables.graph_nodes(spark, sf_dir)
    return nodes, graph.build_edges(nodes, tables.GRAPH_THRESHOLD)


@query("E1_graph_nodes", sql.with_(sql.NODES, body="SELECT image_id, node, " + ", ".join(f"{sql.r(c)} AS {c}" for c in ("l", "a", "b", "cy", "cx")) + " FROM nodes"))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.graph_nodes(spark, sf_dir))


_ADJACENT = """adj AS MATERIALIZED (
  SELECT image_id, least(p, q) AS src, greatest(p, q) AS dst, count(*) AS border FROM (
    SELECT a.image_id, a.seg AS p, b.seg AS q FROM pix a JOIN pix b ON a.image_id = b.image_id AND b.y = a.y AND b.x = a.x + 1
    UNION ALL SELECT a.image_id, a.seg, b.seg FROM pix a JOIN pix b ON a.image_id = b.image_id AND b.y = a.y + 1 AND b.x = a.x)
  WHERE p <> q GROUP BY ALL)"""


@query("E2_region_adjacency", sql.with_(sql.DISCS, _ADJACENT, body="SELECT image_id, src, dst, border FROM adj"))
def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.region_adjacency(tables.disc_cells(spark, sf_dir))


_NEAR = 0.5


@query(
    "E3_pair_similarity",
    sql.with_(
        sql.NODES,
        body=f"""SELECT p.image_id, p.node AS src, q.node AS dst, {sql.r(sql.similarity('p', 'q'))} AS weight
FROM nodes p JOIN nodes q ON p.image_id = q.image_id AND p.node < q.node WHERE {sql.similarity('p', 'q')} > 0""",
    ),
)
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that are similar at all, met in cells of colour or position."""
    nodes = tables.graph_nodes(spark, sf_dir)
    return rounded(graph.pair_similarity(nodes, graph.candidate_pairs(nodes, 0.0)).where("weight > 0"))


def _edges_sql(threshold: float) -> str:
    return f"""SELECT p.image_id, p.node AS src, q.node AS dst, {sql.r(sql.similarity('p', 'q'))} AS weight
FROM nodes p JOIN nodes q ON p.image_id = q.image_id AND p.node < q.node
WHERE {sql.similarity('p', 'q')} > {threshold} OR q.node = p.node + 1"""


@query("E4_build_edges", sql.with_(sql.NODES, body=_edges_sql(0.75)))
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.graph_nodes(spark, sf_dir)
    chain = nodes.where("node > 0").select("image_id", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"))
    return rounded(graph.build_edges(nodes, tables.GRAPH_THRESHOLD, chain))


@query("E4_build_edges_default", sql.with_(sql.NODES, body=_edges_sql(0.5)))
def build_edges_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.graph_nodes(spark, sf_dir)
    chain = nodes.where("node > 0").select("image_id", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"))
    return rounded(graph.build_edges(nodes, 0.5, chain))


# A stricter threshold splits the graphs into several components.
_SPLIT = 0.88


def _split_sql() -> str:
    return (
        sql.EDGES.replace("> 0.75)", f"> {_SPLIT})")
        + """,
reach AS (
  SELECT image_id, node AS s, node AS t FROM nodes
  UNION SELECT r.image_id, r.s, a.v FROM reach r JOIN arcs a ON a.image_id = r.image_id AND a.u = r.t),
comp AS MATERIALIZED (SELECT image_id, s AS node, min(t) AS component FROM reach GROUP BY ALL)"""
    )


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = tables.graph_nodes(spark, sf_dir)
    return nodes, graph.build_edges(nodes, _SPLIT)


@query(
    "E5_connected_components",
    sql.with_(_split_sql(), recursive=True, body="SELECT image_id, node, component FROM comp"),
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(*_split(spark, sf_dir))


@query(
    "E6_repair_connectivity",
    sql.with_(
        _split_sql(),
        "sizes AS (SELECT image_id, component, count(*) AS n FROM comp GROUP BY ALL)",
        "main AS (SELECT image_id, arg_max(component, n * 1000 - component) AS main FROM sizes GROUP BY image_id)",
        recursive=True,
        body=f"""SELECT image_id, src, dst, {sql.r('weight')} AS weight FROM edges
UNION ALL SELECT s.image_id, least(component, main), greatest(component, main), 0.01
FROM sizes s JOIN main m ON s.image_id = m.image_id WHERE component <> main""",
    ),
)
def repair_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _split(spark, sf_dir)
    return rounded(graph.repair_connectivity(nodes, edges, graph.connected_components(nodes, edges)))


# --- measures ---------------------------------------------------------------------------------

_TRIANGLES = """tri AS MATERIALIZED (
  SELECT a.image_id, a.src AS a, a.dst AS b, b.dst AS c, a.weight AS w1, c.weight AS w2, b.weight AS w3
  FROM edges a JOIN edges b ON a.image_id = b.image_id AND a.dst = b.src
  JOIN edges c ON c.image_id = a.image_id AND c.src = a.src AND c.dst = b.dst)"""

_CLUSTERING = (
    _TRIANGLES
    + """,
top AS (SELECT image_id, max(weight) AS m FROM edges GROUP BY image_id),
corner AS (
  SELECT t.image_id, u.node, cbrt(w1/m * (w2/m) * (w3/m)) AS v FROM tri t JOIN top USING (image_id), unnest([a, b, c]) AS u(node)),
clus AS MATERIALIZED (
  SELECT d.image_id, d.node, CASE WHEN any_value(d.d) > 1 THEN coalesce(sum(c.v), 0) * 2 / (any_value(d.d) * (any_value(d.d) - 1)) ELSE 0 END AS clustering
  FROM deg d LEFT JOIN corner c ON c.image_id = d.image_id AND c.node = d.node GROUP BY d.image_id, d.node)"""
)


@query("F1_node_strength", sql.with_(sql.EDGES, body=f"SELECT image_id, node, {sql.r('greatest(s, 1e-10)')} AS strength FROM deg"))
def node_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.node_strength(*nodes_edges(spark, sf_dir)))


@query(
    "F2_clustering_weighted",
    sql.with_(sql.EDGES, _CLUSTERING, body=f"SELECT image_id, node, {sql.r('clustering')} AS clustering FROM clus"),
)
def clustering_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.clustering_weighted(*nodes_edges(spark, sf_dir)))


def _paths_sql(cost: str, name: str = "dist", arcs: str = "arcs", nodes: str = "nodes", extra: str = "") -> str:
    """Min-plus squaring; five times covers paths of 32 arcs, more than 20 nodes need."""
    key = "image_id" + extra
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in key.split(","))
    parts = [
        f"""{name}0 AS MATERIALIZED (
  SELECT {key}, node AS s, node AS t, 0.0::DOUBLE AS d FROM {nodes}
  UNION ALL SELECT {key}, u, v, {cost} FROM {arcs})"""
    ]
    for i in range(1, 6):
        parts.append(
            f"""{name}{i} AS MATERIALIZED (
  SELECT {cols}, a.s, b.t, min(a.d + b.d) AS d FROM {name}{i - 1} a JOIN {name}{i - 1} b ON {on} AND a.t = b.s
  GROUP BY ALL)"""
        )
    parts.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}5)")
    return ",\n".join(parts)


_HOPS = _paths_sql("1.0::DOUBLE")
_INVERSE = _paths_sql("1.0 / greatest(w, 1e-10)")
_BY_WEIGHT = _paths_sql("w")


def _paths(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = nodes_edges(spark, sf_dir)
    return nodes, edges, measures.shortest_paths(nodes, measures.costs(edges, kind))


@query("F3_apsp_hops", sql.with_(sql.EDGES, _HOPS, body=f"SELECT image_id, s, t, {sql.r('d')} AS d FROM dist"))
def apsp_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paths(spark, sf_dir, "hops")[2])


@query("F4_apsp_weighted", sql.with_(sql.EDGES, _INVERSE, body=f"SELECT image_id, s, t, {sql.r('d')} AS d FROM dist"))
def apsp_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paths(spark, sf_dir, "inverse")[2])


@query(
    "F5_betweenness",
    sql.with_(
        sql.EDGES,
        _INVERSE,
        """dag AS MATERIALIZED (
  SELECT p.image_id, p.s, a.u, a.v FROM dist p JOIN arcs a ON a.image_id = p.image_id AND a.u = p.t
  JOIN dist q ON q.image_id = p.image_id AND q.s = p.s AND q.t = a.v
  WHERE abs(p.d + 1.0 / greatest(a.w, 1e-10) - q.d) <= q.d * 1e-9)""",
        """path AS (
  SELECT image_id, node AS s, node AS t, [node] AS via FROM nodes
  UNION ALL SELECT p.image_id, p.s, d.v, list_append(p.via, d.v) FROM path p
  JOIN dag d ON d.image_id = p.image_id AND d.s = p.s AND d.u = p.t)""",
        "cnt AS (SELECT image_id, s, t, count(*) AS n FROM path WHERE s <> t GROUP BY ALL)",
        """thr AS (
  SELECT p.image_id, m.node, sum(1.0 / c.n) AS v FROM path p JOIN cnt c USING (image_id, s, t), unnest(p.via) AS m(node)
  WHERE m.node <> p.s AND m.node <> p.t GROUP BY ALL)""",
        "size AS (SELECT image_id, count(*) AS n FROM nodes GROUP BY image_id)",
        recursive=True,
        body=f"""SELECT n.image_id, n.node, {sql.r('coalesce(t.v, 0.0) / ((z.n - 1) * (z.n - 2))')} AS betweenness
FROM nodes n JOIN size z ON z.image_id = n.image_id LEFT JOIN thr t ON t.image_id = n.image_id AND t.node = n.node""",
    ),
)
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.betweenness(*nodes_edges(spark, sf_dir)))


@query(
    "F6_closeness",
    sql.with_(
        sql.EDGES,
        _INVERSE,
        "size AS (SELECT image_id, count(*) AS n FROM nodes GROUP BY image_id)",
        body=f"""SELECT d.image_id, d.t AS node, {sql.r('''CASE WHEN sum(d.d) > 0
  THEN (count(*) - 1) / sum(d.d) * ((count(*) - 1)::DOUBLE / (any_value(z.n) - 1)) ELSE 0.0 END''')} AS closeness
FROM dist d JOIN size z ON z.image_id = d.image_id GROUP BY d.image_id, d.t""",
    ),
)
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nodes_edges(spark, sf_dir)
    return rounded(measures.closeness(nodes, distances.distance_sums(nodes, measures.costs(edges, "inverse"))))


@query(
    "F7_eccentricity",
    sql.with_(
        sql.EDGES,
        _HOPS,
        "size AS (SELECT image_id, count(*) AS n FROM nodes GROUP BY image_id)",
        body="""SELECT d.image_id, d.s AS node, CASE WHEN count(*) = any_value(z.n) THEN max(d.d) END AS eccentricity
FROM dist d JOIN size z ON z.image_id = d.image_id GROUP BY d.image_id, d.s""",
    ),
)
def eccentricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nodes_edges(spark, sf_dir)
    found = measures.eccentricity(nodes, distances.hop_sums(nodes, measures.costs(edges, "hops")))
    finite = F.when(F.col("eccentricity") != float("inf"), F.col("eccentricity"))
    return found.select("image_id", "node", finite.alias("eccentricity"))


_EGO = (
    _TRIANGLES
    + """,
enode AS MATERIALIZED (SELECT image_id, u AS ego, v AS node FROM arcs),
earc AS MATERIALIZED (
  SELECT e.image_id, e.ego, x.u, x.v FROM (
    SELECT image_id, a AS ego, b AS p, c AS q FROM tri UNION ALL SELECT image_id, b, a, c FROM tri UNION ALL SELECT image_id, c, a, b FROM tri) e,
    unnest([{'u': p, 'v': q}, {'u': q, 'v': p}]) AS y(x))"""
)


@query(
    "F8_local_efficiency",
    sql.with_(
        sql.EDGES,
        _EGO,
        _paths_sql("1.0::DOUBLE", "ed", "earc", "enode", ", ego"),
        "esize AS (SELECT image_id, ego, count(*) AS n FROM enode GROUP BY ALL)",
        "etot AS (SELECT image_id, ego, sum(1.0 / d) AS v FROM ed WHERE s <> t GROUP BY ALL)",
        body=f"""SELECT n.image_id, {sql.r('avg(CASE WHEN z.n > 1 THEN coalesce(t.v, 0.0) / (z.n * (z.n - 1)) ELSE 0.0 END)')} AS local_efficiency
FROM nodes n LEFT JOIN esize z ON z.image_id = n.image_id AND z.ego = n.node
LEFT JOIN etot t ON t.image_id = n.image_id AND t.ego = n.node GROUP BY n.image_id""",
    ),
)
def local_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.local_efficiency(*nodes_edges(spark, sf_dir)))


def _length_sql(edges: str) -> str:
    return sql.with_(
        edges,
        _BY_WEIGHT,
        "comp2 AS (SELECT image_id, s AS node, min(t) AS component FROM dist GROUP BY ALL)",
        """each AS (
  SELECT d.image_id, c.component, count(DISTINCT d.s) AS n, sum(d.d) AS total FROM dist d
  JOIN comp2 c ON c.image_id = d.image_id AND c.node = d.s GROUP BY d.image_id, c.component)""",
        recursive=True,
        body=f"""SELECT n.image_id, {sql.r('sum(total / (n * (n - 1)) * n) / sum(n)')} AS char_path_length
FROM (SELECT DISTINCT image_id FROM nodes) n LEFT JOIN (SELECT * FROM each WHERE n > 1) USING (image_id) GROUP BY n.image_id""",
    )


@query("F9_char_path_length", _length_sql(sql.EDGES))
def char_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nodes_edges(spark, sf_dir)
    dist = distances.distance_sums(nodes, measures.costs(edges, "weight"))
    return rounded(measures.char_path_length(nodes, dist, graph.connected_components(nodes, edges)))


@query("F10_char_path_length_disconnected", _length_sql(sql.EDGES.replace("> 0.75)", f"> {_SPLIT})")))
def char_path_length_disconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _split(spark, sf_dir)
    dist = distances.distance_sums(nodes, measures.costs(edges, "weight"))
    found = measures.char_path_length(nodes, dist, graph.connected_components(nodes, edges))
    finite = F.when(F.col("char_path_length") != float("inf"), F.col("char_path_length"))
    return rounded(found.select("image_id", finite.alias("char_path_length")))


@query(
    "F11_global_efficiency",
    sql.with_(
        sql.EDGES,
        _HOPS,
        "size AS (SELECT image_id, count(*) AS n FROM nodes GROUP BY image_id)",
        body=f"""SELECT d.image_id, {sql.r('sum(CASE WHEN s <> t THEN 1.0 / d END) / (any_value(z.n) * (any_value(z.n) - 1))')} AS global_efficiency
FROM dist d JOIN size z ON z.image_id = d.image_id GROUP BY d.image_id""",
    ),
)
def global_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nodes_edges(spark, sf_dir)
    hops = distances.hop_sums(nodes, measures.costs(edges, "hops"))
    return rounded(measures.global_efficiency(nodes, hops))


@query(
    "F12_average_clustering",
    sql.with_(sql.EDGES, _CLUSTERING, body=f"SELECT image_id, {sql.r('avg(clustering)')} AS global_clustering FROM clus GROUP BY image_id"),
)
def average_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.average_clustering(measures.clustering_weighted(*nodes_edges(spark, sf_dir))))


@query(
    "F13_density",
    sql.with_(
        sql.EDGES,
        body=f"SELECT image_id, {sql.r('sum(d)::DOUBLE / (count(*) * (count(*) - 1))')} AS density FROM deg GROUP BY image_id",
    ),
)
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.density(*nodes_edges(spark, sf_dir)))


_ASSORT = """ends AS MATERIALIZED (
  SELECT a.image_id, p.s AS x, q.s AS y FROM arcs a JOIN deg p ON p.image_id = a.image_id AND p.node = a.u
  JOIN deg q ON q.image_id = a.image_id AND q.node = a.v),
asso AS (SELECT image_id, coalesce(corr(x, y), 0.0) AS r FROM ends GROUP BY image_id)"""


@query(
    "F14_assortativity",
    sql.with_(
        sql.EDGES, _ASSORT,
        body=f"SELECT n.image_id, {sql.r('coalesce(r, 0.0)')} AS assortativity FROM (SELECT DISTINCT image_id FROM nodes) n LEFT JOIN asso USING (image_id)",
    ),
)
def assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.assortativity(*nodes_edges(spark, sf_dir)))


_TRANS = """trip AS (SELECT image_id, sum(d * (d - 1) / 2) AS v FROM deg GROUP BY image_id),
ntri AS (SELECT image_id, count(*) AS v FROM tri GROUP BY image_id),
trans AS (SELECT p.image_id, CASE WHEN p.v > 0 THEN 3.0 * coalesce(t.v, 0) / p.v ELSE 0.0 END AS r FROM trip p LEFT JOIN ntri t USING (image_id))"""


@query("F15_transitivity", sql.with_(sql.EDGES, _TRIANGLES, _TRANS, body=f"SELECT image_id, {sql.r('r')} AS transitivity FROM trans"))
def transitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.transitivity(*nodes_edges(spark, sf_dir)))


_RICH = """ks AS (SELECT image_id, unnest(range(1, least(6, max(d) + 1))) AS k FROM deg GROUP BY image_id),
nk AS (SELECT k.image_id, k.k, count(*) FILTER (WHERE d.d > k.k) AS n FROM ks k JOIN deg d USING (image_id) GROUP BY ALL),
ek AS (SELECT k.image_id, k.k, count(*) AS e FROM ks k JOIN edges g ON g.image_id = k.image_id
  JOIN deg p ON p.image_id = k.image_id AND p.node = g.src JOIN deg q ON q.image_id = k.image_id AND q.node = g.dst
  WHERE p.d > k.k AND q.d > k.k GROUP BY ALL),
rich AS (SELECT n.image_id, avg(CASE WHEN n.n > 1 THEN 2.0 * coalesce(e.e, 0) / (n.n * (n.n - 1)) ELSE 0.0 END) AS v
  FROM nk n LEFT JOIN ek e ON e.image_id = n.image_id AND e.k = n.k GROUP BY n.image_id)"""


@query(
    "F16_rich_club",
    sql.with_(
        sql.EDGES, _RICH,
        body=f"SELECT n.image_id, {sql.r('coalesce(v, 0.0)')} AS rich_club_coefficient FROM (SELECT DISTINCT image_id FROM nodes) n LEFT JOIN rich USING (image_id)",
    ),
)
def rich_club(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.rich_club(*nodes_edges(spark, sf_dir)))


@query(
    "F17_defaults",
    sql.with_(
        sql.EDGES.replace("> 0.75)", f"> {_SPLIT})"),
        _ASSORT,
        """str AS (SELECT u AS node, image_id, sum(w) AS s FROM arcs GROUP BY ALL)""",
        body=f"""SELECT n.image_id, n.node, {sql.r('coalesce(s.s, 1.0)')} AS strength, {sql.r('coalesce(a.r, 0.0)')} AS assortativity
FROM nodes n LEFT JOIN str s ON s.image_id = n.image_id AND s.node = n.node
LEFT JOIN asso a ON a.image_id = n.image_id""",
    ),
)
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and assortativity where they exist, the stated defaults elsewhere."""
    nodes, edges = _split(spark, sf_dir)
    linked = graph.both_ways(edges).groupBy("image_id", F.col("u").alias("node")).agg(F.sum("w").alias("strength"))
    joined = (
        nodes.select("image_id", "node")
        .join(linked, ["image_id", "node"], "left")
        .join(measures.assortativity(nodes, edges), "image_id", "left")
    )
    filled = measures.with_defaults(joined, {**measures.NODE_DEFAULTS, **measures.GRAPH_DEFAULTS})
    return rounded(filled.select("image_id", "node", "strength", "assortativity"))


_SUMMARY = {"strength": ("deg", "greatest(s, 1e-10)"), "clustering": ("clus", "clustering")}


@query(
    "I1_node_metric_summary",
    sql.with_(
        sql.EDGES, _CLUSTERING,
        body="\nUNION ALL ".join(
            f"""SELECT image_id, '{m}' AS metric, {sql.r(f'avg({e})')} AS mean, {sql.r(f'stddev_pop({e})')} AS std,
  {sql.r(f'min({e})')} AS min, {sql.r(f'max({e})')} AS max, {sql.r(f'median({e})')} AS median FROM {t} GROUP BY image_id"""
            for m, (t, e) in _SUMMARY.items()
        ),
    ),
)
def node_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summaries(spark, sf_dir, True))


def _summaries(spark: SparkSession, sf_dir: str, median: bool) -> DataFrame:
    nodes, edges = nodes_edges(spark, sf_dir)
    found = measures.node_strength(nodes, edges).select(
        "image_id", F.lit("strength").alias("metric"), F.col("strength").alias("value")
    )
    found = found.unionByName(
        measures.clustering_weighted(nodes, edges).select(
            "image_id", F.lit("clustering").alias("metric"), F.col("clustering").alias("value")
        )
    )
    return measures.summary_statistics(found, "value", ("image_id", "metric"), median)


@query(
    "I2_node_metric_summary4",
    sql.with_(
        sql.EDGES, _CLUSTERING,
        body="\nUNION ALL ".join(
            f"""SELECT image_id, '{m}' AS metric, {sql.r(f'avg({e})')} AS mean, {sql.r(f'stddev_pop({e})')} AS std,
  {sql.r(f'min({e})')} AS min, {sql.r(f'max({e})')} AS max FROM {t} GROUP BY image_id"""
            for m, (t, e) in _SUMMARY.items()
        ),
    ),
)
def node_metric_summary4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summaries(spark, sf_dir, False))


@query(
    "graph_summary",
    sql.with_(
        sql.EDGES, _CLUSTERING, _TRANS, _ASSORT, _RICH,
        body=f"""SELECT d.image_id, count(*) AS nodes, {sql.r('sum(d.d)::DOUBLE / (count(*) * (count(*) - 1))')} AS density,
  {sql.r('avg(c.clustering)')} AS global_clustering, {sql.r('any_value(coalesce(a.r, 0.0))')} AS assortativity,
  {sql.r('any_value(t.r)')} AS transitivity, {sql.r('any_value(coalesce(h.v, 0.0))')} AS rich_club_coefficient,
  {sql.r('avg(greatest(d.s, 1e-10))')} AS strength_mean, {sql.r('stddev_pop(greatest(d.s, 1e-10))')} AS strength_std
FROM deg d JOIN clus c ON c.image_id = d.image_id AND c.node = d.node JOIN trans t ON t.image_id = d.image_id
LEFT JOIN asso a ON a.image_id = d.image_id LEFT JOIN rich h ON h.image_id = d.image_id GROUP BY d.image_id""",
    ),
)
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per graph: size, structure measures and the spread of node strength."""
    nodes, edges = nodes_edges(spark, sf_dir)
    size = nodes.groupBy("image_id").agg(F.count("*").alias("nodes"))
    strength = measures.summary_statistics(measures.node_strength(nodes, edges), "strength", median=False).select(
        "image_id", F.col("mean").alias("strength_mean"), F.col("std").alias("strength_std")
    )
    return rounded(size.join(measures.structure_measures(nodes, edges), "image_id").join(strength, "image_id"))
