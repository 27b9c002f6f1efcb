"""Queries of the pixel projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import colour
from lumengraph.operators import raster as ops
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.registry import query, rounded

_DOC_LINES = """doc AS (
  SELECT doc_id AS image_id, hex(text) AS hx, CAST(ceil(strlen(text) / 48.0) AS INT) AS height,
    CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 4 END AS ch
  FROM documents WHERE strlen(text) > 0),
lines AS (
  SELECT image_id, CAST(t.i AS INT) AS y, ch, height, 48 // ch AS width,
    rpad(substr(hx, CAST(t.i * 96 + 1 AS BIGINT), 96), 96, '0') AS line
  FROM doc, range(0, CAST(height AS BIGINT)) AS t(i)),
bytes AS (
  SELECT image_id, y, ch, CAST(p.i // ch AS INT) AS x, p.i % ch AS place,
    (instr('0123456789ABCDEF', substr(line, CAST(p.i * 2 + 1 AS BIGINT), 1)) - 1) * 16
      + instr('0123456789ABCDEF', substr(line, CAST(p.i * 2 + 2 AS BIGINT), 1)) - 1 AS v
  FROM lines, range(0, 48) AS p(i))"""


def _line_sums(strips: DataFrame) -> DataFrame:
    moment = lambda c: F.aggregate(
        F.transform(c, lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda acc, v: acc + v
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return strips.select(
        "image_id",
        "y",
        F.size("r").alias("width"),
        *[total(c).alias(f"{c}_sum") for c in "rgb"],
        *[moment(c).alias(f"{c}_moment") for c in "rgb"],
    )


@query(
    "B1_to_strips",
    sql.with_(
        _DOC_LINES,
        body="""SELECT image_id, y, CAST(max(x) + 1 AS INT) AS width,
  CAST(sum(CASE WHEN place = (CASE ch WHEN 1 THEN 0 ELSE 2 END) THEN v END) AS BIGINT) AS r_sum,
  CAST(sum(CASE WHEN place = (CASE ch WHEN 1 THEN 0 ELSE 1 END) THEN v END) AS BIGINT) AS g_sum,
  CAST(sum(CASE WHEN place = 0 THEN v END) AS BIGINT) AS b_sum,
  CAST(sum(CASE WHEN place = (CASE ch WHEN 1 THEN 0 ELSE 2 END) THEN v * (x + 1) END) AS BIGINT) AS r_moment,
  CAST(sum(CASE WHEN place = (CASE ch WHEN 1 THEN 0 ELSE 1 END) THEN v * (x + 1) END) AS BIGINT) AS g_moment,
  CAST(sum(CASE WHEN place = 0 THEN v * (x + 1) END) AS BIGINT) AS b_moment
FROM bytes GROUP BY image_id, y""",
    ),
)
def to_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_sums(ops.to_strips(tables.document_images(spark, sf_dir)))


@query(
    "B2_normalize_channels",
    sql.with_(
        _DOC_LINES,
        body=f"""SELECT ch AS channels, CAST(count(*) AS BIGINT) AS n_pixels,
  CAST(sum(CASE WHEN place = 0 THEN v END) AS BIGINT) AS blue,
  CAST(sum(CASE WHEN place = (CASE ch WHEN 1 THEN 0 ELSE 2 END) THEN v END) AS BIGINT) AS red
FROM bytes WHERE place = 0 OR (ch > 1 AND place = 2) GROUP BY ch""".replace(
            "count(*)", "sum(CASE WHEN place = 0 THEN 1 ELSE 0 END)"
        ),
    ),
)
def normalize_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = tables.document_images(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    kind = F.when(F.col("image_id") % 3 == 0, 3).when(F.col("image_id") % 3 == 1, 1).otherwise(4)
    return (
        ops.to_strips(images)
        .groupBy(kind.alias("channels"))
        .agg(
            F.sum(F.size("r")).cast("bigint").alias("n_pixels"),
            F.sum(total("b")).alias("blue"),
            F.sum(total("r")).alias("red"),
        )
    )


def _lanczos_sql(name: str, size_in: str, size_out: int) -> str:
    t = "((i + first - centre + 0.5) / grown)"
    sinc = lambda v: f"(CASE WHEN {v} = 0 THEN 1.0 ELSE sin(({v}) * pi()) / (({v}) * pi()) END)"
    return f"""{name}_pos AS (
  SELECT size_in, CAST(o.i AS INT) AS i_out, greatest(size_in / {size_out}.0::DOUBLE, 1.0::DOUBLE) AS grown,
    (o.i + 0.5::DOUBLE) * (size_in / {size_out}.0::DOUBLE) AS centre
  FROM (SELECT DISTINCT {size_in} AS size_in FROM dims), range(0, {size_out}) AS o(i)),
{name}_span AS (
  SELECT *, greatest(0, CAST(floor(centre - grown * 3.0 + 0.5) AS INT)) AS first,
    least(size_in, CAST(floor(centre + grown * 3.0 + 0.5) AS INT)) - 1 AS last FROM {name}_pos),
{name}_raw AS (
  SELECT size_in, i_out, CAST(first + i AS INT) AS i_in,
    CASE WHEN {t} > -3.0 AND {t} < 3.0 THEN {sinc(t)} * {sinc(t + ' / 3.0')} ELSE 0.0 END AS raw
  FROM (SELECT *, unnest(range(0, CAST(last - first + 1 AS BIGINT))) AS i FROM {name}_span)),
{name} AS MATERIALIZED (
  SELECT size_in, i_out, i_in,
    CAST(floor(abs(raw / total) * 4194304 + 0.5) * sign(raw) AS BIGINT) AS weight
  FROM (SELECT *, sum(raw) OVER (PARTITION BY size_in, i_out) AS total FROM {name}_raw))"""


def _resize_sql(width: int, height: int) -> str:
    byte = lambda v: f"greatest(0, least(255, (CAST(sum({v}) AS BIGINT) + 2097152) >> 22))"
    return sql.with_(
        sql.RASTER,
        _lanczos_sql("wx", "w", width),
        _lanczos_sql("wy", "h", height),
        f"""wide AS MATERIALIZED (
  SELECT p.image_id, p.y, t.i_out AS x, {byte('p.r * t.weight')} AS r, {byte('p.g * t.weight')} AS g, {byte('p.b * t.weight')} AS b
  FROM pix p JOIN dims s ON p.image_id = s.image_id JOIN wx t ON t.size_in = s.w AND t.i_in = p.x
  GROUP BY p.image_id, p.y, t.i_out)""",
        body=f"""SELECT p.image_id, t.i_out AS y, p.x, CAST({byte('p.r * t.weight')} AS INT) AS r,
  CAST({byte('p.g * t.weight')} AS INT) AS g, CAST({byte('p.b * t.weight')} AS INT) AS b
FROM wide p JOIN dims s ON p.image_id = s.image_id JOIN wy t ON t.size_in = s.h AND t.i_in = p.y
GROUP BY p.image_id, t.i_out, p.x""",
    )


@query("B3_resize", _resize_sql(40, 75))
def resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pixels(ops.resize(tables.raster(spark, sf_dir), 40, 75))


def _pixel_query(columns: dict[str, str], source: str = sql.RASTER) -> str:
    return sql.with_(
        source, body="SELECT image_id, y, x, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM pix"
    )


_UNIT = ("(r/255.0::DOUBLE)", "(g/255.0::DOUBLE)", "(b/255.0::DOUBLE)")


@query("B4_scale01", _pixel_query({c: sql.r(u) for c, u in zip("rgb", _UNIT)}))
def scale01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pixels(tables.raster(spark, sf_dir))
    return rounded(p.select("image_id", "y", "x", *[colour.scale01(F.col(c)).alias(c) for c in "rgb"]))


def _unit_columns() -> list:
    return [F.col(c) / 255.0 for c in "rgb"]


_LAB = sql.lab(*_UNIT)
_HSV = sql.hsv(*_UNIT)
_HSV8 = sql.hsv8("r", "g", "b")


@query("B6_rgb_to_lab", _pixel_query(dict(zip(("l", "a", "b"), map(sql.r, _LAB)))))
def rgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pixels(tables.raster(spark, sf_dir))
    lab = colour.rgb_to_lab(*_unit_columns())
    return rounded(p.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("lab", lab)]))


@query(
    "B7_normalize_lab",
    _pixel_query(
        {
            "l": sql.r(f"{_LAB[0]}/100.0"),
            "a": sql.r(f"({_LAB[1]}+128.0)/255.0"),
            "b": sql.r(f"({_LAB[2]}+128.0)/255.0"),
        }
    ),
)
def normalize_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pixels(tables.raster(spark, sf_dir))
    lab = colour.normalize_lab(colour.rgb_to_lab(*_unit_columns()))
    return rounded(p.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("lab", lab)]))


@query("B8_rgb_to_hsv", _pixel_query(dict(zip(("h", "s", "v"), map(sql.r, _HSV)))))
def rgb_to_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pixels(tables.raster(spark, sf_dir))
    hsv = colour.rgb_to_hsv(*_unit_columns())
    return rounded(p.select("image_id", "y", "x", *[c.alias(n) for n, c in zip("hsv", hsv)]))


@query("B9_rgb_to_hsv8", _pixel_query(dict(zip(("h", "s", "v"), _HSV8))))
def rgb_to_hsv8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pixels(tables.raster(spark, sf_dir))
    hsv = colour.rgb_to_hsv8(*[F.col(c) for c in "rgb"])
    return p.select("image_id", "y", "x", *[c.cast("int").alias(n) for n, c in zip("hsv", hsv)])


@query(
    "B10_rgb_to_gray",
    _pixel_query({"gray709": sql.r(sql.GRAY), "gray601": f"CAST({sql.GRAY8} AS INT)"}),
)
def rgb_to_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pixels(tables.raster(spark, sf_dir))
    return rounded(
        p.select(
            "image_id",
            "y",
            "x",
            colour.gray(*_unit_columns()).alias("gray709"),
            colour.gray8(*[F.col(c) for c in "rgb"]).cast("int").alias("gray601"),
        )
    )


@query(
    "B11_quantize",
    sql.with_(
        sql.RASTER,
        body=f"""SELECT image_id, CAST(round_even({sql.GRAY}*7.0, 0) AS INT) AS level, count(*) AS n
FROM pix GROUP BY ALL""",
    ),
)
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pixels(tables.raster(spark, sf_dir))
    return p.groupBy("image_id", colour.quantize(colour.gray(*_unit_columns())).alias("level")).agg(
        F.count("*").alias("n")
    )


@query(
    "B12_channel_profile",
    sql.with_(
        sql.DISCS,
        body="""SELECT image_id, min(r) AS r_min, min(g) AS g_min, min(b) AS b_min,
  max(r) AS r_max, max(g) AS g_max, max(b) AS b_max FROM pix GROUP BY image_id""",
    ),
)
def channel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.channel_profile(tables.discs(spark, sf_dir))


@query(
    "B13_apply_mask",
    sql.with_(
        sql.DISCS,
        body=f"""SELECT image_id, CAST(sum(CASE WHEN mask THEN 1 ELSE 0 END) AS BIGINT) AS inside,
  {sql.r(f'sum(CASE WHEN mask THEN {sql.GRAY} ELSE 0 END)')} AS gray_sum FROM pix GROUP BY image_id""",
    ),
)
def apply_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = ops.gray_strips(tables.discs(spark, sf_dir), masked=True)
    total = F.aggregate("gray", F.lit(0.0), lambda acc, v: acc + v)
    inside = F.size(F.filter("mask", lambda m: m))
    return rounded(
        strips.groupBy("image_id").agg(
            F.sum(inside).cast("bigint").alias("inside"), F.sum(total).alias("gray_sum")
        )
    )


# A kernel with no symmetry, so that any flip or shift of the stencil shows.
_KERNEL = [[1.0, 2.0, -1.0], [0.0, 3.0, 5.0], [-2.0, 4.0, 7.0]]


@query(
    "B14_convolve",
    sql.with_(
        sql.RASTER,
        f"gpix AS MATERIALIZED (SELECT image_id, y, x, {sql.GRAY} AS gray FROM pix)",
        sql.stencil("conv", "gpix", "gray", {"v": _KERNEL}),
        body=f"SELECT image_id, y, x, {sql.r('v')} AS v FROM conv",
    ),
)
def convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = ops.gray_strips(tables.raster(spark, sf_dir))
    return rounded(ops.pixels(ops.convolve(strips, "gray", _KERNEL, name="v"), ["v"]))


@query("B5_clahe")
def clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of each channel per line of the equalised pictures."""
    out = ops.equalize_adaptive(tables.discs(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    return rounded(out.select("image_id", "y", *[total(c).alias(c) for c in "rgb"]))
