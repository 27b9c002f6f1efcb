"""Queries of the colour, texture and shape features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import colourstats, raster, shape, texture
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.registry import query, rounded

_UNIT = ("(r/255.0::DOUBLE)", "(g/255.0::DOUBLE)", "(b/255.0::DOUBLE)")
_SPACES = {"rgb": ("r::DOUBLE", "g::DOUBLE", "b::DOUBLE"), "hsv": sql.hsv(*_UNIT), "lab": sql.lab(*_UNIT)}

_VALUES = (
    sql.DISCS
    + """,
census AS (SELECT image_id, r, g, b, count(*) AS n FROM pix WHERE mask GROUP BY ALL),
vals AS MATERIALIZED ("""
    + "\nUNION ALL ".join(
        f"SELECT image_id, n, '{s}' AS space, {i} AS channel, {e} AS value FROM census"
        for s, channels in _SPACES.items()
        for i, e in enumerate(channels)
    )
    + """),
mom AS MATERIALIZED (
  SELECT image_id, space, channel, sum(n)::DOUBLE AS size, sum(n * value) / sum(n) AS mean, min(value) AS lo, max(value) AS hi
  FROM vals GROUP BY ALL),
dev AS MATERIALIZED (
  SELECT v.image_id, v.space, v.channel, any_value(m.mean) AS mean, any_value(m.lo) AS lo, any_value(m.hi) AS hi,
    sqrt(sum(n * pow(value - mean, 2)) / any_value(size)) AS std,
    sum(n * pow(value - mean, 3)) / any_value(size) AS c3, sum(n * pow(value - mean, 4)) / any_value(size) AS c4
  FROM vals v JOIN mom m USING (image_id, space, channel) GROUP BY ALL)"""
)


def _bins(n: int) -> str:
    return f"""cells AS MATERIALIZED (
  SELECT v.image_id, v.space, v.channel,
    CASE WHEN hi > lo THEN least({n - 1}, CAST(floor((value - lo) / (hi - lo) * {n}) AS INT)) ELSE 0 END AS bin,
    sum(n) AS n, any_value(size) AS size, any_value(lo) AS lo, any_value(hi) AS hi
  FROM vals v JOIN mom m USING (image_id, space, channel) GROUP BY ALL)"""


def _colour_sql() -> str:
    """All colour features of the vector rasters by name."""
    name = "space || '_' || channel || '_"
    fine, coarse = (_bins(n).replace("cells AS", f"cells{n} AS") for n in (256, 8))
    moments = {
        "mean": "mean", "std": "std", "min": "lo", "max": "hi",
        "skewness": "CASE WHEN hi > lo THEN c3 / pow(std, 3) ELSE 0 END", "kurtosis": "CASE WHEN hi > lo THEN c4 / pow(std, 4) ELSE 0 END",
    }
    parts = [f"SELECT image_id, {name}{n}' AS name, {sql.r(e)} AS value FROM dev" for n, e in moments.items()]
    part = "n / (size * ((hi - lo) / 256))"
    parts += [
        f"SELECT image_id, {name}entropy', {sql.r(f'sum(CASE WHEN hi > lo THEN -({part}) * log2({part}) ELSE 0.0 END)')} FROM cells256 GROUP BY image_id, space, channel",
        f"SELECT image_id, space || '_color_variance', {sql.r('sum(std * std)')} FROM dev GROUP BY image_id, space",
        f"""SELECT m.image_id, m.space || '_' || m.channel || '_hist_' || t.i, {sql.r('coalesce(CASE WHEN c.hi > c.lo THEN c.n / (c.size * ((c.hi - c.lo) / 8)) END, 0.0)')}
  FROM mom m CROSS JOIN range(0, 8) AS t(i)
  LEFT JOIN cells8 c ON c.image_id = m.image_id AND c.space = m.space AND c.channel = m.channel AND c.bin = t.i""",
    ]
    values = _VALUES.replace(sql.DISCS, sql.RASTER).replace(" WHERE mask", "")
    return sql.with_(values, fine, coarse, body="\nUNION ALL ".join(parts))


@query("colour_features", _colour_sql())
def colour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(colourstats.colour_features(tables.raster(spark, sf_dir)))


def _discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.discs(spark, sf_dir)


@query(
    "H1_channel_moments",
    sql.with_(
        _VALUES,
        body=f"""SELECT image_id, space, channel, {sql.r('mean')} AS mean, {sql.r('std')} AS std,
  {sql.r('lo')} AS min, {sql.r('hi')} AS max FROM dev""",
    ),
)
def channel_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = colourstats.channel_statistics(_discs(spark, sf_dir), "mask")
    return rounded(stats.select("image_id", "space", "channel", "mean", "std", "min", "max"))


@query(
    "H2_channel_shape",
    sql.with_(
        _VALUES,
        body=f"""SELECT image_id, space, channel, CASE WHEN hi > lo THEN {sql.r('c3 / pow(std, 3)')} ELSE 0 END AS skewness,
  CASE WHEN hi > lo THEN {sql.r('c4 / pow(std, 4)')} ELSE 0 END AS kurtosis FROM dev""",
    ),
)
def channel_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = colourstats.channel_statistics(_discs(spark, sf_dir), "mask")
    return rounded(stats.select("image_id", "space", "channel", "skewness", "kurtosis"))


@query(
    "H3_channel_entropy",
    sql.with_(
        _VALUES,
        _bins(256),
        body=f"""SELECT image_id, space, channel, {sql.r('''sum(CASE WHEN hi > lo
   THEN -(n / (size * ((hi - lo) / 256))) * log2(n / (size * ((hi - lo) / 256))) ELSE 0.0 END)''')} AS entropy
FROM cells GROUP BY image_id, space, channel""",
    ),
)
def channel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = colourstats.channel_statistics(_discs(spark, sf_dir), "mask")
    return rounded(stats.select("image_id", "space", "channel", "entropy"))


@query(
    "H4_colour_variance",
    sql.with_(
        _VALUES,
        body=f"SELECT image_id, space, {sql.r('sum(std * std)')} AS color_variance FROM dev GROUP BY image_id, space",
    ),
)
def colour_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(colourstats.colour_variance(colourstats.channel_statistics(_discs(spark, sf_dir), "mask")))


@query(
    "H5_channel_histogram",
    sql.with_(
        _VALUES,
        _bins(8),
        body=f"""SELECT m.image_id, m.space, m.channel, CAST(t.i AS INT) AS bin,
  {sql.r('coalesce(CASE WHEN c.hi > c.lo THEN c.n / (c.size * ((c.hi - c.lo) / 8)) END, 0.0)')} AS density
FROM mom m CROSS JOIN range(0, 8) AS t(i)
LEFT JOIN cells c ON c.image_id = m.image_id AND c.space = m.space AND c.channel = m.channel AND c.bin = t.i""",
    ),
)
def channel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(colourstats.channel_histogram(_discs(spark, sf_dir), "mask"))


# --- texture ---------------------------------------------------------------------------------

_GLCM = (
    sql.RASTER
    + ",\n"
    + sql.values("dirs", "distance, angle, dy, dx", texture.pair_offsets())
    + f""",
qp AS MATERIALIZED (SELECT image_id, y, x, CAST(round_even({sql.GRAY}*7.0, 0) AS INT) AS q FROM pix),
offs AS (SELECT DISTINCT dy, dx FROM dirs),
prs AS MATERIALIZED (
  SELECT a.image_id, o.dy, o.dx, a.q AS i, b.q AS j, count(*) AS n
  FROM qp a CROSS JOIN offs o JOIN qp b ON b.image_id = a.image_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL),
sym AS (SELECT image_id, dy, dx, i, j, sum(n) AS n FROM
  (SELECT * FROM prs UNION ALL SELECT image_id, dy, dx, j, i, n FROM prs) GROUP BY ALL),
glcm AS MATERIALIZED (
  SELECT s.image_id, d.distance, d.angle, s.i, s.j, s.n::DOUBLE / sum(s.n) OVER (PARTITION BY s.image_id, d.distance, d.angle) AS p
  FROM sym s JOIN dirs d ON d.dy = s.dy AND d.dx = s.dx)"""
)


@query(
    "H6_glcm",
    sql.with_(_GLCM, body=f"SELECT image_id, distance, angle, i, j, {sql.r('p')} AS p FROM glcm"),
)
def glcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.cooccurrence(tables.raster(spark, sf_dir)))


@query(
    "H7_glcm_properties",
    sql.with_(
        _GLCM,
        body=f"""SELECT image_id, distance, angle, {sql.r('sum(p*(i-j)*(i-j))')} AS contrast,
  {sql.r('sum(p*abs(i-j))')} AS dissimilarity, {sql.r('sum(p/(1.0+(i-j)*(i-j)))')} AS homogeneity,
  {sql.r('sqrt(sum(p*p))')} AS energy, {sql.r('sum(p*p)')} AS "ASM", {sql.r('sum(-p*log2(p))')} AS entropy,
  {sql.r('''CASE WHEN sum(p*i*i)-sum(p*i)*sum(p*i) < 1e-12 THEN 1.0
    ELSE (sum(p*i*j)-sum(p*i)*sum(p*i))/(sum(p*i*i)-sum(p*i)*sum(p*i)) END''')} AS correlation
FROM glcm GROUP BY image_id, distance, angle""",
    ),
)
def glcm_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.cooccurrence_properties(texture.cooccurrence(tables.raster(spark, sf_dir))))


def _lbp_sql(body: str, bins: str = "1 << CAST(radius * 8 AS INT)") -> str:
    taps = [
        (r, i, 1 << i, *tap)
        for r in texture.PATTERN_RADII
        for i, tap in enumerate(texture.pattern_taps(r))
    ]
    corner = lambda n, y, x: (
        f"LEFT JOIN gp {n} ON {n}.image_id = p.image_id AND {n}.y = p.y + t.{y} AND {n}.x = p.x + t.{x}"
    )
    v = lambda n: f"coalesce({n}.v, 0.0::DOUBLE)"
    one = "1.0::DOUBLE"
    sample = (
        f"(({one}-t.fy)*(({one}-t.fx)*{v('a')}+t.fx*{v('b')})+t.fy*(({one}-t.fx)*{v('c')}+t.fx*{v('d')}))"
    )
    return sql.with_(
        sql.RASTER,
        sql.values("taps", "radius, place, bit, y0, x0, y1, x1, fy, fx", taps),
        f"gp AS MATERIALIZED (SELECT image_id, y, x, floor({sql.GRAY}*255.0::DOUBLE) AS v FROM pix)",
        f"""raw AS MATERIALIZED (
  SELECT p.image_id, p.y, p.x, t.radius, CAST(sum(CASE WHEN {sample} - p.v >= 0 THEN t.bit ELSE 0 END) AS BIGINT) AS raw
  FROM gp p CROSS JOIN taps t {corner('a', 'y0', 'x0')} {corner('b', 'y0', 'x1')} {corner('c', 'y1', 'x0')} {corner('d', 'y1', 'x1')}
  GROUP BY p.image_id, p.y, p.x, t.radius)""",
        """cnt AS MATERIALIZED (SELECT image_id, radius, raw, count(*) AS n FROM raw GROUP BY ALL)""",
        """codes AS MATERIALIZED (
  SELECT image_id, radius, method, CAST(code AS INT) AS code, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT image_id, radius, n, 'default' AS method, raw AS code FROM cnt
    UNION ALL SELECT image_id, radius, n, 'uniform',
      CASE WHEN bit_count(xor(raw, raw >> 1) & ((1::BIGINT << (radius*8-1)) - 1)) <= 2 THEN bit_count(raw) ELSE radius*8+1 END FROM cnt
    UNION ALL SELECT image_id, radius, n, 'ror',
      list_min(list_transform(range(0, radius*8), lambda k: ((raw >> k) | (raw << (radius*8-k))) & ((1::BIGINT << (radius*8)) - 1))) FROM cnt)
  GROUP BY image_id, radius, method, code)""",
        f"""span AS (
  SELECT image_id, radius, method, sum(n) AS size,
    CASE WHEN min(code) = max(code) THEN min(code) - 0.5 ELSE min(code) END::DOUBLE AS lo,
    CASE WHEN min(code) = max(code) THEN max(code) + 0.5 ELSE max(code) END::DOUBLE AS hi,
    CASE method WHEN 'uniform' THEN radius*8+2 WHEN 'ror' THEN radius*8+1 ELSE {bins} END AS bins
  FROM codes GROUP BY image_id, radius, method)""",
        """hist AS MATERIALIZED (
  SELECT c.image_id, c.radius, c.method, s.bins, least(bins - 1, CAST(floor((code - lo) / (hi - lo) * bins) AS INT)) AS bin,
    sum(n) / (any_value(size) * any_value((hi - lo) / bins)) AS density
  FROM codes c JOIN span s USING (image_id, radius, method) GROUP BY ALL)""",
        body=body,
    )


@query("H8_lbp", _lbp_sql(f"SELECT image_id, radius, method, bins, bin, {sql.r('density')} AS density FROM hist"))
def lbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.pattern_histogram(texture.binary_patterns(tables.raster(spark, sf_dir))))


@query("H8_lbp_short", _lbp_sql(f"SELECT image_id, radius, method, bins, bin, {sql.r('density')} AS density FROM hist", str(texture.SHORT_BINS)))
def lbp_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortened histogram of the feature catalogue."""
    return rounded(texture.pattern_histogram(texture.binary_patterns(tables.raster(spark, sf_dir)), texture.SHORT_BINS))


@query(
    "H8_lbp_statistics",
    _lbp_sql(
        f"""SELECT c.image_id, c.radius, c.method, {sql.r('c.mean', 4)} AS mean, {sql.r('c.std', 4)} AS std, {sql.r('h.entropy')} AS entropy
FROM (SELECT image_id, radius, method, sum(n * code)::DOUBLE / sum(n) AS mean,
    sqrt(sum(n * (code - m) * (code - m)) / sum(n)) AS std
  FROM codes JOIN (SELECT image_id, radius, method, sum(n * code)::DOUBLE / sum(n) AS m FROM codes GROUP BY ALL) USING (image_id, radius, method)
  GROUP BY image_id, radius, method) c
JOIN (SELECT image_id, radius, method, sum(-density * log2(density + 1e-10)) AS entropy FROM hist GROUP BY ALL) h
  USING (image_id, radius, method)"""
    ),
)
def lbp_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rounded(texture.pattern_statistics(texture.binary_patterns(tables.raster(spark, sf_dir))), 6)
    return rounded(stats.select("image_id", "radius", "method", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "entropy"))


def _gray_pix(source: str, masked: bool) -> str:
    value = f"CASE WHEN mask THEN {sql.GRAY} ELSE 0.0 END" if masked else sql.GRAY
    return source + f",\ngp AS MATERIALIZED (SELECT image_id, y, x, {'mask, ' if masked else ''}{value} AS gray FROM pix)"


def _flip(kernel: list[list[float]]) -> list[list[float]]:
    return [list(row) for row in zip(*kernel)]


def _sobel_kernels() -> dict[str, list[list[float]]]:
    out = {}
    for k, (deriv, smooth) in texture.SOBEL.items():
        out[f"gx{k}"] = texture.outer(smooth, deriv)
        out[f"gy{k}"] = texture.outer(deriv, smooth)
    return out


def _gradient_sql() -> str:
    snap = lambda g: f"CASE WHEN abs({g}) < 1e-9 THEN 0.0 ELSE {g} END"
    bins = ",\n  ".join(
        sql.r(f"sum(CASE WHEN bin = {i} THEN 1 ELSE 0 END) / (count(*) * {2 * math.pi / 16}::DOUBLE)") + f" AS dir_hist_{i}"
        for i in range(16)
    )
    return sql.with_(
        _gray_pix(sql.RASTER, False),
        *[
            sql.stencil(f"s{k}", "gp", "gray", {n: m for n, m in _sobel_kernels().items() if n.endswith(str(k))})
            for k in texture.SOBEL
        ],
        "polar AS ("
        + " UNION ALL ".join(
            f"SELECT image_id, {k} AS ksize, sqrt(gx*gx+gy*gy) AS mag, atan2(gy, gx) AS dir FROM (SELECT image_id, {snap(f'gx{k}')} AS gx, {snap(f'gy{k}')} AS gy FROM s{k})"
            for k in texture.SOBEL
        )
        + ")",
        f"binned AS (SELECT *, least(15, CAST(floor((dir + {math.pi}::DOUBLE) / {2 * math.pi}::DOUBLE * 16) AS INT)) AS bin FROM polar)",
        body=f"""SELECT image_id, ksize, {sql.r('avg(mag)')} AS mag_mean, {sql.r('stddev_pop(mag)')} AS mag_std,
  {sql.r('max(mag)')} AS mag_max, {sql.r('sum(mag*mag)')} AS mag_energy, {sql.r('avg(dir)')} AS dir_mean,
  {sql.r('stddev_pop(dir)')} AS dir_std,
  {bins}
FROM binned GROUP BY image_id, ksize""",
    )


def _gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texture.gradients(raster.gray_strips(tables.raster(spark, sf_dir)))


@query("H9_gradient_stats", _gradient_sql())
def gradient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.gradient_statistics(_gradients(spark, sf_dir)))


@query(
    "H11_laplacian_stats",
    sql.with_(
        _gray_pix(sql.RASTER, False),
        sql.stencil("lap", "gp", "gray", {"v": [list(row) for row in texture.LAPLACE]}),
        body=f"""SELECT image_id, {sql.r('avg(abs(v))')} AS laplacian_mean, {sql.r('stddev_pop(v)')} AS laplacian_std,
  {sql.r('max(abs(v))')} AS laplacian_max FROM lap GROUP BY image_id""",
    ),
)
def laplacian_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.laplacian_statistics(_gradients(spark, sf_dir)))


@query(
    "H12_scharr_stats",
    sql.with_(
        _gray_pix(sql.DISCS, True),
        sql.stencil(
            "sch", "gp", "gray",
            {"gx": texture.outer(texture.SCHARR[1], texture.SCHARR[0]), "gy": texture.outer(texture.SCHARR[0], texture.SCHARR[1])},
        ),
        body=f"""SELECT image_id, {sql.r('avg(m)')} AS scharr_mean, {sql.r('stddev_pop(m)')} AS scharr_std, {sql.r('sum(m*m)')} AS scharr_energy
FROM (SELECT image_id, sqrt(gx*gx+gy*gy) AS m FROM sch JOIN gp USING (image_id, y, x) WHERE mask) GROUP BY image_id""",
    ),
)
def scharr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = raster.gray_strips(_discs(spark, sf_dir), masked=True)
    return rounded(texture.scharr_statistics(texture.gradients(strips, mask="mask")))


def _wavelet_sql() -> str:
    taps = [
        (f, j, low[j], texture.high_pass(low)[j]) for f, low in texture.LOW_PASS.items() for j in range(len(low))
    ]
    fold = lambda pos, size: (
        f"(CASE WHEN (({pos}) % (2*{size}) + 2*{size}) % (2*{size}) < {size} THEN (({pos}) % (2*{size}) + 2*{size}) % (2*{size})"
        f" ELSE 2*{size} - 1 - (({pos}) % (2*{size}) + 2*{size}) % (2*{size}) END)"
    )
    parts = [
        _gray_pix(sql.RASTER, False),
        sql.values("wt", "family, j, lo, hi", taps),
        "lens AS (SELECT family, count(*) AS n FROM wt GROUP BY family)",
        "z0 AS (SELECT family, n, image_id, h::BIGINT AS h, w::BIGINT AS w FROM lens, dims)",
        "c0 AS MATERIALIZED (SELECT family, image_id, y::BIGINT AS y, x::BIGINT AS x, gray AS aa FROM gp, lens)",
    ]
    for i in (1, 2, 3):
        p = i - 1
        parts += [
            f"""px{i} AS MATERIALIZED (SELECT z.family, image_id, k.i AS k, t.lo, t.hi, {fold('2*k.i+1-t.j', 'z.w')} AS src
  FROM z{p} z JOIN wt t USING (family), range(0, (z.w + z.n - 1) // 2) AS k(i))""",
            f"""ha{i} AS MATERIALIZED (SELECT c.family, c.image_id, c.y, p.k AS x, sum(p.lo*c.aa) AS a, sum(p.hi*c.aa) AS d
  FROM c{p} c JOIN px{i} p ON p.family = c.family AND p.image_id = c.image_id AND p.src = c.x GROUP BY ALL)""",
            f"""py{i} AS MATERIALIZED (SELECT z.family, image_id, k.i AS k, t.lo, t.hi, {fold('2*k.i+1-t.j', 'z.h')} AS src
  FROM z{p} z JOIN wt t USING (family), range(0, (z.h + z.n - 1) // 2) AS k(i))""",
            f"""c{i} AS MATERIALIZED (SELECT c.family, c.image_id, p.k AS y, c.x, sum(p.lo*c.a) AS aa, sum(p.hi*c.a) AS da, sum(p.lo*c.d) AS ad, sum(p.hi*c.d) AS dd
  FROM ha{i} c JOIN py{i} p ON p.family = c.family AND p.image_id = c.image_id AND p.src = c.y GROUP BY ALL)""",
            f"z{i} AS (SELECT family, n, image_id, (h + n - 1) // 2 AS h, (w + n - 1) // 2 AS w FROM z{p})",
        ]
    rows = ["SELECT image_id, family, 'approx' AS band, 0 AS level, aa AS c FROM c3"]
    for i in (1, 2, 3):
        for band, col in (("horizontal", "da"), ("vertical", "ad"), ("diagonal", "dd")):
            rows.append(f"SELECT image_id, family, '{band}', {4 - i}, {col} FROM c{i}")
    parts.append("coef AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")")
    parts.append(
        "cm AS (SELECT image_id, family, band, level, avg(c) AS m, stddev_pop(c) AS s FROM coef GROUP BY ALL)"
    )
    return sql.with_(
        *parts,
        body=f"""SELECT image_id, family, band, level, {sql.r('avg(abs(c))')} AS mean, {sql.r('any_value(s)')} AS std,
  {sql.r('sum(c*c)')} AS energy, {sql.r('sum(-c*c*log2(c*c+1e-10))')} AS entropy, {sql.r('max(abs(c))')} AS max,
  {sql.r('avg(pow(c-m,4))/(pow(any_value(s),4)+1e-10)')} AS kurtosis, {sql.r('avg(pow(c-m,3))/(pow(any_value(s),3)+1e-10)')} AS skewness
FROM coef JOIN cm USING (image_id, family, band, level) GROUP BY image_id, family, band, level""",
    )


@query("H13_wavelet_stats", _wavelet_sql())
def wavelet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = raster.gray_strips(tables.raster(spark, sf_dir))
    return rounded(texture.wavelet_statistics(texture.wavelet_coefficients(strips)))


_SOBEL_3 = {n: m for n, m in _sobel_kernels().items() if n.endswith("3")}


def _canny_sql() -> str:
    clamp = lambda p, n: f"least(greatest({p}, 0), {n} - 1)"
    rows = [(dy, dx, _SOBEL_3["gx3"][dy + 1][dx + 1], _SOBEL_3["gy3"][dy + 1][dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return sql.with_(
        sql.RASTER,
        f"gp AS MATERIALIZED (SELECT image_id, y, x, floor({sql.GRAY}*255.0::DOUBLE) AS v FROM pix)",
        sql.values("tp", "dy, dx, kx, ky", rows),
        f"""toq AS MATERIALIZED (SELECT p.image_id, p.y, p.x, {clamp('p.y+tp.dy', 's.h')} AS qy, {clamp('p.x+tp.dx', 's.w')} AS qx, kx, ky
  FROM gp p JOIN dims s USING (image_id) CROSS JOIN tp)""",
        """gr AS MATERIALIZED (SELECT t.image_id, t.y, t.x, sum(q.v*kx) AS dx, sum(q.v*ky) AS dy, abs(sum(q.v*kx)) + abs(sum(q.v*ky)) AS m
  FROM toq t JOIN gp q ON q.image_id = t.image_id AND q.y = t.qy AND q.x = t.qx GROUP BY t.image_id, t.y, t.x)""",
        "o9(dy, dx) AS (SELECT r.i - 1, c.i - 1 FROM range(0, 3) AS r(i), range(0, 3) AS c(i))",
        """nbr AS MATERIALIZED (SELECT p.image_id, p.y, p.x, o.dy AS oy, o.dx AS ox, p.y + o.dy AS qy, p.x + o.dx AS qx FROM gr p, o9 o)""",
        """ring AS MATERIALIZED (SELECT n.image_id, n.y, n.x, """
        + ", ".join(
            f"coalesce(max(CASE WHEN n.oy = {dy} AND n.ox = {dx} THEN q.m END), 0) AS m_{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
        )
        + """ FROM nbr n LEFT JOIN gr q ON q.image_id = n.image_id AND q.y = n.qy AND q.x = n.qx GROUP BY n.image_id, n.y, n.x)""",
        """pk AS MATERIALIZED (SELECT r.image_id, r.y, r.x, CASE WHEN
    CASE WHEN abs(g.dy)*32768 < abs(g.dx)*13573 THEN m_11 > m_10 AND m_11 >= m_12
      WHEN abs(g.dy)*32768 > abs(g.dx)*13573 + abs(g.dx)*65536 THEN m_11 > m_01 AND m_11 >= m_21
      WHEN (g.dx < 0) <> (g.dy < 0) THEN m_11 > m_02 AND m_11 > m_20
      ELSE m_11 > m_00 AND m_11 > m_22 END THEN m_11 ELSE 0 END AS m
  FROM ring r JOIN gr g USING (image_id, y, x))""",
        "cl AS MATERIALIZED (SELECT image_id, t.t, y, x, m > t.t AS strong FROM pk, (VALUES (50), (100), (150)) AS t(t) WHERE m > t.t // 2)",
        """ed AS (SELECT image_id, t, y, x FROM cl WHERE strong
  UNION SELECT c.image_id, c.t, c.y, c.x FROM ed e, o9 o, cl c WHERE c.image_id = e.image_id AND c.t = e.t AND c.y = e.y + o.dy AND c.x = e.x + o.dx)""",
        "sz AS (SELECT image_id, count(*) AS n FROM pix GROUP BY image_id)",
        recursive=True,
        body="SELECT s.image_id, "
        + ", ".join(sql.r(f"count(CASE WHEN e.t = {t} THEN 1 END)::DOUBLE / any_value(s.n)") + f" AS canny_edge_ratio_t{t}" for t in (50, 100, 150))
        + " FROM sz s LEFT JOIN ed e ON e.image_id = s.image_id GROUP BY s.image_id",
    )


@query("H10_canny_ratio", _canny_sql())
def canny_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texture.edge_ratios(raster.gray_strips(tables.raster(spark, sf_dir))))


# --- shape -----------------------------------------------------------------------------------

_POINTS = (
    sql.DISCS
    + """,
pts AS MATERIALIZED (SELECT image_id, y::DOUBLE AS y, x::DOUBLE AS x FROM pix WHERE mask),
mom AS MATERIALIZED (SELECT image_id, """
    + ", ".join(f"sum(pow(y,{p})*pow(x,{q})) AS m{p}{q}" for p in range(4) for q in range(4 - p))
    + ", min(y) AS y_lo, max(y) AS y_hi, min(x) AS x_lo, max(x) AS x_hi FROM pts GROUP BY image_id)"
)


@query(
    "H15_region_area_extent",
    sql.with_(
        _POINTS,
        body=f"SELECT image_id, CAST(m00 AS BIGINT) AS area, {sql.r('m00/((y_hi-y_lo+1)*(x_hi-x_lo+1))')} AS extent FROM mom",
    ),
)
def region_area_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.area_extent(shape.raw_moments(_discs(spark, sf_dir))))


_PERIMETER = """mk AS MATERIALIZED (SELECT image_id, y, x FROM pix WHERE mask),
nb(dy, dx) AS (VALUES (0,1),(0,-1),(1,0),(-1,0)),
bd AS MATERIALIZED (
  SELECT m.image_id, m.y, m.x FROM mk m CROSS JOIN nb LEFT JOIN mk o
    ON o.image_id = m.image_id AND o.y = m.y + nb.dy AND o.x = m.x + nb.dx
  GROUP BY m.image_id, m.y, m.x HAVING count(o.x) < 4),
wt(dy, dx, v) AS (VALUES (0,0,1),(0,1,2),(0,-1,2),(1,0,2),(-1,0,2),(1,1,10),(1,-1,10),(-1,1,10),(-1,-1,10)),
code AS (
  SELECT b.image_id, b.y, b.x, sum(CASE WHEN o.x IS NULL THEN 0 ELSE wt.v END) AS code
  FROM bd b CROSS JOIN wt LEFT JOIN bd o ON o.image_id = b.image_id AND o.y = b.y + wt.dy AND o.x = b.x + wt.dx
  GROUP BY b.image_id, b.y, b.x),
per AS (
  SELECT image_id, sum(CASE WHEN code IN (5,7,15,17,25,27) THEN 1.0::DOUBLE WHEN code IN (21,33) THEN sqrt(2.0::DOUBLE)
    WHEN code IN (13,23) THEN (1.0::DOUBLE+sqrt(2.0::DOUBLE))/2.0::DOUBLE ELSE 0.0::DOUBLE END) AS perimeter
  FROM code GROUP BY image_id)"""


@query(
    "H16_region_perimeter",
    sql.with_(sql.DISCS, _PERIMETER, body=f"SELECT image_id, {sql.r('perimeter')} AS perimeter FROM per"),
)
def region_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.perimeter(_discs(spark, sf_dir)))


@query(
    "H17_region_compactness",
    sql.with_(
        _POINTS,
        _PERIMETER,
        body=f"SELECT image_id, {sql.r(f'CASE WHEN perimeter > 0 THEN {4 * math.pi}::DOUBLE * m00 / (perimeter * perimeter) ELSE 0.0 END')} AS compactness FROM mom LEFT JOIN per USING (image_id)",
    ),
)
def region_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = _discs(spark, sf_dir)
    areas = shape.area_extent(shape.raw_moments(strips))
    return rounded(shape.compactness(areas, shape.perimeter(strips)))


@query(
    "H18_region_eccentricity",
    sql.with_(
        _POINTS,
        """v AS (SELECT image_id, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM pts GROUP BY image_id)""",
        """e AS (SELECT image_id, (vy+vx)/2 + sqrt((vy-vx)*(vy-vx)/4 + c*c) AS l1, greatest((vy+vx)/2 - sqrt((vy-vx)*(vy-vx)/4 + c*c), 0) AS l2 FROM v)""",
        body=f"SELECT image_id, {sql.r('CASE WHEN l1 <= 0 THEN 0.0 ELSE sqrt(greatest(1.0 - l2/l1, 0.0)) END', 4)} AS eccentricity FROM e",
    ),
)
def region_eccentricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.eccentricity(shape.raw_moments(_sheared(spark, sf_dir))), 4)


def _sheared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discs(spark, sf_dir)


@query(
    "H19_boundary_length",
    sql.with_(
        sql.DISCS,
        body="""SELECT image_id, CAST(sum(flip) AS BIGINT) AS boundary_length FROM (
  SELECT a.image_id, CASE WHEN a.mask <> b.mask THEN 1 ELSE 0 END AS flip
  FROM pix a JOIN pix b ON a.image_id = b.image_id AND b.y = a.y AND b.x = a.x + 1
  UNION ALL SELECT a.image_id, CASE WHEN a.mask <> b.mask THEN 1 ELSE 0 END
  FROM pix a JOIN pix b ON a.image_id = b.image_id AND b.y = a.y + 1 AND b.x = a.x) GROUP BY image_id""",
    ),
)
def boundary_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.boundary_length(_discs(spark, sf_dir))


#: From the topmost line, each side goes on to the line reached at the least slope, and of equal ones to the farthest.
_HULL = """ends AS MATERIALIZED (SELECT image_id, y, min(x) AS lo, max(x) AS hi FROM pts GROUP BY ALL),
side AS MATERIALIZED (SELECT image_id, y, 0 AS s, lo AS v FROM ends UNION ALL SELECT image_id, y, 1, -hi FROM ends),
nxt AS MATERIALIZED (
  SELECT p.image_id, p.s, p.y, p.v, q.y AS y2, q.v AS v2
  FROM side p JOIN side q ON p.image_id = q.image_id AND p.s = q.s AND q.y > p.y
  QUALIFY row_number() OVER (PARTITION BY p.image_id, p.s, p.y ORDER BY CAST(q.v - p.v AS DOUBLE) / (q.y - p.y), q.y DESC) = 1),
walk AS (
  SELECT image_id, s, min(y) AS y, 0.0::DOUBLE AS len FROM side GROUP BY image_id, s
  UNION ALL
  SELECT w.image_id, w.s, n.y2, sqrt(CAST((n.y2 - n.y) * (n.y2 - n.y) + (n.v2 - n.v) * (n.v2 - n.v) AS DOUBLE))
  FROM walk w JOIN nxt n ON w.image_id = n.image_id AND w.s = n.s AND w.y = n.y),
caps AS (SELECT image_id, arg_min(hi - lo, y) + arg_max(hi - lo, y) AS width FROM ends GROUP BY image_id),
hull AS (SELECT w.image_id, sum(len) + any_value(width) AS hull FROM walk w JOIN caps USING (image_id) GROUP BY w.image_id)"""

_SUPPORT = f"""hull AS (SELECT image_id, sum(reach) * {2 * math.pi / 360}::DOUBLE AS hull FROM (
  SELECT image_id, t.i, max(x * cos(t.i * {2 * math.pi / 360}::DOUBLE) + y * sin(t.i * {2 * math.pi / 360}::DOUBLE)) AS reach
  FROM pts, range(0, 360) AS t(i) GROUP BY image_id, t.i) GROUP BY image_id)"""

_CONVEXITY = f"SELECT image_id, {sql.r('CASE WHEN perimeter > 0 THEN hull / perimeter ELSE 1.0 END')} AS convexity FROM hull LEFT JOIN per USING (image_id)"


@query("H20_convexity", sql.with_(_POINTS, _PERIMETER, _HULL, recursive=True, body=_CONVEXITY))
def convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.convexity(_discs(spark, sf_dir)))


@query("H20_convexity_by_directions", sql.with_(_POINTS, _PERIMETER, _SUPPORT, body=_CONVEXITY))
def convexity_by_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.convexity(_discs(spark, sf_dir), angles=360))


@query("H20_hull_perimeter", sql.with_(_POINTS, _HULL, recursive=True, body=f"SELECT image_id, {sql.r('hull')} AS hull_perimeter FROM hull"))
def hull_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.hull_perimeter(_discs(spark, sf_dir)))


def _hu_sql() -> str:
    a, b, c, d = "(m30+m12)", "(m21+m03)", "(m30-m12*3)", "(m21*3-m03)"
    s, t = "(m20-m02)", "m11"
    hu = [
        "m20+m02",
        f"{s}*{s}+{t}*{t}*4",
        f"{c}*{c}+{d}*{d}",
        f"{a}*{a}+{b}*{b}",
        f"{c}*{a}*({a}*{a}-{b}*{b}*3)+{d}*{b}*({a}*{a}*3-{b}*{b})",
        f"{s}*({a}*{a}-{b}*{b})+{t}*{a}*{b}*4",
        f"{d}*{a}*({a}*{a}-{b}*{b}*3)-{c}*{b}*({a}*{a}*3-{b}*{b})",
    ]
    return sql.with_(
        _POINTS,
        body="SELECT image_id, "
        + ", ".join(sql.r(f"sign({h})*log10(1+abs({h}))") + f" AS hu_{i}" for i, h in enumerate(hu))
        + " FROM mom",
    )


@query("H21_hu_moments", _hu_sql())
def hu_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hu = shape.hu_moments(shape.raw_moments(_discs(spark, sf_dir)))
    log = lambda c: F.signum(c) * F.log10(F.abs(c) + 1)
    return rounded(hu.select("image_id", *[log(F.col(f"hu_{i}")).alias(f"hu_{i}") for i in range(7)]))
