"""Queries of the spectral measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import graph, measures, spectral
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.graph_queries import nodes_edges
from lumengraph.plans.registry import query, rounded

_LAPLACIAN = """lap AS MATERIALIZED (
  SELECT a.image_id, a.u AS i, a.v AS j, -a.w / sqrt(p.s * q.s) AS value FROM arcs a
  JOIN deg p ON p.image_id = a.image_id AND p.node = a.u JOIN deg q ON q.image_id = a.image_id AND q.node = a.v
  UNION ALL SELECT image_id, node, node, CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM deg)"""


def _laplacian(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = nodes_edges(spark, sf_dir)
    return nodes, spectral.normalized_laplacian(nodes, edges)


@query("G1_normalized_laplacian", sql.with_(sql.EDGES, _LAPLACIAN, body=f"SELECT image_id, i, j, {sql.r('value')} AS value FROM lap"))
def normalized_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_laplacian(spark, sf_dir)[1])


@query(
    "G2_spectral_energy",
    sql.with_(sql.EDGES, _LAPLACIAN, body=f"SELECT image_id, {sql.r('sum(CASE WHEN i = j THEN value ELSE 0 END)')} AS energy FROM lap GROUP BY image_id"),
)
def spectral_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.energies(_laplacian(spark, sf_dir)[1]).select("image_id", "energy"))


@query(
    "G3_laplacian_energy_2",
    sql.with_(
        sql.EDGES, _LAPLACIAN,
        body=f"SELECT image_id, {sql.r('sum(CASE WHEN i = j THEN 2 - value ELSE 0 END)')} AS normalized_laplacian_energy FROM lap GROUP BY image_id",
    ),
)
def laplacian_energy_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.energies(_laplacian(spark, sf_dir)[1]).select("image_id", "normalized_laplacian_energy"))


def _extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nodes_edges(spark, sf_dir)
    return rounded(spectral.extreme_eigenvalues(nodes, edges, graph.connected_components(nodes, edges)))


def _largest_sql(value: str, doublings: int = 24) -> str:
    """``top``: the largest eigenvalue of ``m0``, which has none below 0, by squaring it again and again.

    trace(m * p) / trace(p) for p = m ^ (2 ^ doublings), brought to trace 1 after each squaring.
    """
    parts = ["p0 AS MATERIALIZED (SELECT * FROM m0)"]
    for i in range(doublings):
        parts.append(
            f"""q{i} AS MATERIALIZED (SELECT a.image_id, a.i, b.j, sum(a.value * b.value) AS value
  FROM p{i} a JOIN p{i} b ON b.image_id = a.image_id AND b.i = a.j GROUP BY a.image_id, a.i, b.j),
p{i + 1} AS MATERIALIZED (SELECT image_id, i, j, value / nullif(sum(CASE WHEN i = j THEN value END) OVER (PARTITION BY image_id), 0) AS value FROM q{i})"""
        )
    parts.append(
        f"""top AS MATERIALIZED (SELECT m.image_id, coalesce(sum(m.value * p.value), 0) AS top
  FROM m0 m JOIN p{doublings} p ON p.image_id = m.image_id AND p.i = m.j AND p.j = m.i GROUP BY m.image_id)"""
    )
    return sql.with_(sql.EDGES, _LAPLACIAN, "m0 AS MATERIALIZED (" + value + ")", *parts, body="{}")


_FULL = "SELECT p.image_id, p.node AS i, q.node AS j, {} AS value FROM deg p JOIN deg q ON q.image_id = p.image_id LEFT JOIN lap l ON l.image_id = p.image_id AND l.i = p.node AND l.j = q.node {}"
_RADIUS_SQL = _largest_sql(_FULL.format("coalesce(l.value, 0)", "")).format(f"SELECT image_id, {sql.r('top')} AS spectral_radius FROM top")
# 2 - x for every eigenvalue x, and 0 in place of the one that belongs to the null vector.
_REST = "CASE WHEN p.node = q.node THEN 2 ELSE 0 END - coalesce(l.value, 0) - CASE WHEN t.s > 0 THEN 2 * sqrt(p.s * q.s) / t.s ELSE 0 END"
_GAP_SQL = _largest_sql(
    _FULL.format(_REST, "JOIN (SELECT image_id, sum(s) AS s FROM deg GROUP BY image_id) t ON t.image_id = p.image_id")
).format(f"SELECT image_id, {sql.r('CASE WHEN top > 0 THEN greatest(2 - top, 0) ELSE 0 END')} AS spectral_gap FROM top")


@query("G4_spectral_radius", _RADIUS_SQL)
def spectral_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extremes(spark, sf_dir).select("image_id", "spectral_radius")


@query("G5_spectral_gap", _GAP_SQL)
def spectral_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extremes(spark, sf_dir).select("image_id", "spectral_gap")


def _product(name: str, source: str, table: str = "lap", cols: str = "lab") -> str:
    sums = ", ".join(f"sum(m.value * x.{c}) AS {c}" for c in cols)
    return f"""{name} AS MATERIALIZED (SELECT m.image_id, m.i AS node, {sums}
  FROM {table} m JOIN {source} x ON x.image_id = m.image_id AND x.node = m.j GROUP BY m.image_id, m.i)"""


def _moments_body() -> str:
    rows = []
    for k in range(5):
        p, q = k // 2, k - k // 2
        for c in "lab":
            rows.append(
                f"SELECT p.image_id, '{c}' AS channel, {k} AS k, {sql.r(f'sum(p.{c} * q.{c})')} AS moment "
                f"FROM x{p} p JOIN x{q} q ON q.image_id = p.image_id AND q.node = p.node GROUP BY p.image_id"
            )
    return "\nUNION ALL ".join(rows)


@query(
    "G6_graph_spectral_moments",
    sql.with_(
        sql.EDGES, _LAPLACIAN, "x0 AS (SELECT image_id, node, l, a, b FROM nodes)",
        _product("x1", "x0"), _product("x2", "x1"), body=_moments_body(),
    ),
)
def graph_spectral_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, lap = _laplacian(spark, sf_dir)
    return rounded(spectral.spectral_moments(lap, nodes))


def _power_sql() -> str:
    parts = [
        sql.EDGES,
        _LAPLACIAN,
        "shift AS MATERIALIZED (SELECT image_id, i, j, CASE WHEN i = j THEN value - 1 ELSE value END AS value FROM lap)",
        "t0 AS (SELECT image_id, node, l AS t FROM nodes)",
        "p1 AS (SELECT m.image_id, m.i AS node, sum(m.value * x.t) AS t FROM shift m JOIN t0 x ON x.image_id = m.image_id AND x.node = m.j GROUP BY ALL)",
        "t1 AS MATERIALIZED (SELECT * FROM p1)",
    ]
    for k in range(2, spectral.ORDER + 1):
        parts.append(
            f"""t{k} AS MATERIALIZED (SELECT p.image_id, p.node, 2 * p.t - q.t AS t FROM (
  SELECT m.image_id, m.i AS node, sum(m.value * x.t) AS t FROM shift m JOIN t{k - 1} x ON x.image_id = m.image_id AND x.node = m.j GROUP BY ALL) p
  JOIN t{k - 2} q ON q.image_id = p.image_id AND q.node = p.node)"""
        )
    dots = " UNION ALL ".join(
        f"SELECT x.image_id, {k} AS k, sum(x.t * y.t) AS c FROM t0 x JOIN t{k} y ON y.image_id = x.image_id AND y.node = x.node GROUP BY x.image_id"
        for k in range(spectral.ORDER + 1)
    )
    weights = [(b, k, w) for b, row in enumerate(spectral.band_weights()) for k, w in enumerate(row)]
    parts += [
        f"cheb AS MATERIALIZED ({dots})",
        sql.values("bw", "band, k, w", weights),
        "pow AS MATERIALIZED (SELECT c.image_id, b.band, greatest(0.0, sum(c.c * b.w)) AS power FROM cheb c JOIN bw b ON b.k = c.k GROUP BY ALL)",
    ]
    return ",\n".join(parts)


_POWER = _power_sql()


def _power(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, lap = _laplacian(spark, sf_dir)
    return nodes, spectral.band_power(spectral.chebyshev_moments(lap, nodes))


@query("G7_spectral_band_power", sql.with_(_POWER, body=f"SELECT image_id, band, {sql.r('power')} AS power FROM pow"))
def spectral_band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_power(spark, sf_dir)[1])


@query(
    "G7_spectral_mean_power",
    sql.with_(_POWER, body=f"""SELECT p.image_id, {sql.r('sum(power) / any_value(n)')} AS spectral_power FROM pow p
JOIN (SELECT image_id, count(*) AS n FROM nodes GROUP BY image_id) z ON z.image_id = p.image_id GROUP BY p.image_id"""),
)
def spectral_mean_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, power = _power(spark, sf_dir)
    return rounded(spectral.mean_power(power, nodes))


@query(
    "G8_spectral_band_entropy",
    sql.with_(
        _POWER,
        "amp AS (SELECT image_id, sqrt(power) / (sum(sqrt(power)) OVER (PARTITION BY image_id) + 1e-10) AS p FROM pow)",
        body=f"SELECT image_id, {sql.r('sum(-p * log2(p + 1e-10))')} AS spectral_entropy FROM amp GROUP BY image_id",
    ),
)
def spectral_band_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.band_entropy(_power(spark, sf_dir)[1]))


@query("G9_spectral_band_peak", sql.with_(_POWER, body=f"SELECT image_id, {sql.r('max(sqrt(power))')} AS spectral_amplitude FROM pow GROUP BY image_id"))
def spectral_band_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.band_peak(_power(spark, sf_dir)[1]))


@query(
    "G10_default_spectral",
    sql.with_(
        _POWER,
        "peak AS (SELECT image_id, max(sqrt(power)) AS v FROM pow GROUP BY image_id)",
        body=f"SELECT image_id, {sql.r('CASE WHEN v > 50 THEN v ELSE 0.0 END')} AS spectral_amplitude FROM peak",
    ),
)
def default_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small peaks are taken away; their places get the default."""
    nodes, power = _power(spark, sf_dir)
    peaks = spectral.band_peak(power)
    lost = peaks.withColumn("spectral_amplitude", F.when(F.col("spectral_amplitude") > 50, F.col("spectral_amplitude")))
    return rounded(measures.with_defaults(lost, spectral.SPECTRAL_DEFAULTS))
