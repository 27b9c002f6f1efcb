"""Queries of the quality gates and of segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import raster, regions, segment, validate
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.registry import query, rounded
from lumengraph.session import cut

# --- gates -----------------------------------------------------------------------------------


@query(
    "C1_check_shape",
    """WITH doc AS (SELECT doc_id AS image_id, CAST(ceil(strlen(text) / 48.0) AS INT) AS h,
  CASE doc_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 48 ELSE 12 END AS w, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 4 END AS c
  FROM documents WHERE strlen(text) > 0)
SELECT image_id, CASE WHEN h < 50 OR w < 50 THEN 'Image too small (less than 50x50 pixels)'
  WHEN c < 3 THEN 'Image must be color (RGB)' END AS problem FROM doc""",
)
def check_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_shape(tables.document_images(spark, sf_dir))


_H, _S, _V = sql.hsv8("r", "g", "b")
_SKIN = f"""skin AS MATERIALIZED (SELECT image_id, 100.0 * sum(CASE WHEN (h BETWEEN 0 AND 20 OR h BETWEEN 170 AND 180)
    AND s BETWEEN 20 AND 150 AND v BETWEEN 70 AND 255 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS skin_percent
  FROM (SELECT image_id, {_H} AS h, {_S} AS s, {_V} AS v FROM pix) GROUP BY image_id)"""


@query("C2_skin_fraction", sql.with_(sql.DISCS, _SKIN, body=f"SELECT image_id, {sql.r('skin_percent')} AS skin_percent FROM skin"))
def skin_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validate.skin_fraction(tables.discs(spark, sf_dir)))


_OUTER = [[float(a * b) for b in (1, 4, 6, 4, 1)] for a in (1, 4, 6, 4, 1)]
_BLUR = (
    f"g8 AS MATERIALIZED (SELECT image_id, y, x, {sql.GRAY8} AS gray FROM pix),\n"
    + sql.stencil("bl", "g8", "gray", {"v": _OUTER})
    + ",\nblur AS MATERIALIZED (SELECT image_id, y, x, CAST(floor((v + 128) / 256) AS INT) AS gray FROM bl)"
)
_OTSU = """hist AS MATERIALIZED (SELECT image_id, gray AS bin, count(*) AS n FROM blur GROUP BY ALL),
cum AS (
  SELECT image_id, bin, sum(n) OVER up AS n1, sum(n * bin) OVER up AS s1, sum(n) OVER al AS nn, sum(n * bin) OVER al AS ss
  FROM hist WINDOW up AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY image_id)),
sig AS (
  SELECT image_id, bin, CASE WHEN nn > n1 THEN round((n1::DOUBLE / nn) * ((nn - n1)::DOUBLE / nn)
    * (s1::DOUBLE / n1 - (ss - s1)::DOUBLE / (nn - n1)) * (s1::DOUBLE / n1 - (ss - s1)::DOUBLE / (nn - n1)), 9) ELSE 0 END AS v FROM cum),
otsu AS MATERIALIZED (
  SELECT image_id, CASE WHEN max(v) > 0 THEN CAST(min(bin) FILTER (WHERE v = m) AS INT) ELSE 0 END AS threshold
  FROM (SELECT *, max(v) OVER (PARTITION BY image_id) AS m FROM sig) GROUP BY image_id)"""
_DARK = "dk AS MATERIALIZED (SELECT b.image_id, b.y, b.x, b.gray <= o.threshold AS dark FROM blur b JOIN otsu o USING (image_id))"
_RUNS = """edge AS (SELECT image_id, y, x, dark,
    CASE WHEN lag(dark) OVER (PARTITION BY image_id, y ORDER BY x) IS DISTINCT FROM dark THEN 1 ELSE 0 END AS s FROM dk),
grp AS (SELECT *, sum(s) OVER (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM edge),
allruns AS MATERIALIZED (
  SELECT image_id, y, min(x) AS x0, max(x) AS x1, dark, CAST(y * 64 + min(x) AS BIGINT) AS run FROM grp GROUP BY image_id, y, k, dark),
runs AS MATERIALIZED (SELECT * FROM allruns WHERE dark),
runlink AS MATERIALIZED (
  SELECT a.image_id, a.run AS u, b.run AS v FROM runs a JOIN runs b ON b.image_id = a.image_id AND b.y = a.y + 1
  WHERE a.x0 <= b.x1 + 1 AND a.x1 >= b.x0 - 1),
runarc AS MATERIALIZED (SELECT * FROM runlink UNION ALL SELECT image_id, v, u FROM runlink),
rreach AS (
  SELECT image_id, run AS s, run AS t FROM runs
  UNION SELECT r.image_id, r.s, a.v FROM rreach r JOIN runarc a ON a.image_id = r.image_id AND a.u = r.t),
reg AS MATERIALIZED (SELECT image_id, s AS run, min(t) AS region FROM rreach GROUP BY ALL)"""
# Holes: bright runs not connected (by edges) to the border of the picture.
_FILLED = """outer0 AS (
  SELECT image_id, run, y, x0, x1 FROM allruns WHERE NOT dark AND (y = 0 OR y = 63 OR x0 = 0 OR x1 = 63)
  UNION SELECT b.image_id, b.run, b.y, b.x0, b.x1 FROM outer0 o JOIN allruns b
    ON b.image_id = o.image_id AND (b.y = o.y + 1 OR b.y = o.y - 1) WHERE NOT b.dark AND b.x0 <= o.x1 AND b.x1 >= o.x0),
holes AS MATERIALIZED (
  SELECT b.* FROM allruns b LEFT JOIN outer0 o ON o.image_id = b.image_id AND o.run = b.run WHERE NOT b.dark AND o.run IS NULL),
filled AS MATERIALIZED (
  SELECT r.image_id, r.y, r.x0, r.x1, g.region FROM runs r JOIN reg g USING (image_id, run)
  UNION ALL SELECT h.image_id, h.y, h.x0, h.x1, g.region FROM holes h
  JOIN runs r ON r.image_id = h.image_id AND r.y = h.y AND r.x1 = h.x0 - 1 JOIN reg g ON g.image_id = r.image_id AND g.run = r.run),
area AS (SELECT image_id, region, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM filled GROUP BY ALL),
cand AS MATERIALIZED (SELECT * FROM area WHERE area > 4096 * 0.05 AND area < 4096 * 0.9),
big AS MATERIALIZED (SELECT image_id, arg_max(region, area * 10000 - region) AS region, max(area) AS area FROM cand GROUP BY image_id)"""
_VARIATION = """vary AS MATERIALIZED (
  SELECT p.image_id, (stddev_pop(p.r) + stddev_pop(p.g) + stddev_pop(p.b)) / 3.0 AS variation
  FROM big JOIN filled f ON f.image_id = big.image_id AND f.region = big.region
  JOIN pix p ON p.image_id = f.image_id AND p.y = f.y AND p.x BETWEEN f.x0 AND f.x1 GROUP BY p.image_id)"""


@query("C3_gaussian_blur", sql.with_(sql.DISCS, _BLUR, body="SELECT image_id, y, x, gray FROM blur"))
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels(validate.blurred_gray(tables.discs(spark, sf_dir)), ["gray"])


@query("C4_otsu_threshold", sql.with_(sql.DISCS, _BLUR, _OTSU, body="SELECT image_id, threshold FROM otsu"))
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.otsu_threshold(cut(validate.blurred_gray(tables.discs(spark, sf_dir))))


@query(
    "C5_dark_mask",
    sql.with_(sql.DISCS, _BLUR, _OTSU, _DARK,
              body="SELECT image_id, y, CAST(sum(CASE WHEN dark THEN 1 ELSE 0 END) AS INT) AS dark FROM dk GROUP BY image_id, y"),
)
def dark_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = validate.dark_mask(tables.discs(spark, sf_dir))
    return dark.select("image_id", "y", F.size(F.filter("dark", lambda d: d)).alias("dark"))


@query(
    "C6_label_regions",
    sql.with_(sql.DISCS, _BLUR, _OTSU, _DARK, _RUNS, recursive=True,
              body="SELECT r.image_id, r.y, r.x0, r.x1, r.run, g.region FROM runs r JOIN reg g USING (image_id, run)"),
)
def label_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = cut(validate.dark_mask(tables.discs(spark, sf_dir)))
    return regions.label_regions(dark).select("image_id", "y", "x0", "x1", "run", "region")


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dark = cut(validate.dark_mask(tables.discs(spark, sf_dir)))
    filled = cut(regions.filled_regions(dark))
    return filled, validate.lesion_candidates(dark, filled)


@query(
    "C7_filter_region_area",
    sql.with_(sql.DISCS, _BLUR, _OTSU, _DARK, _RUNS, _FILLED, recursive=True, body="SELECT image_id, region, area FROM cand"),
)
def filter_region_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[1]


@query(
    "C8_largest_region",
    sql.with_(sql.DISCS, _BLUR, _OTSU, _DARK, _RUNS, _FILLED, recursive=True, body="SELECT image_id, region, area FROM big"),
)
def largest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.largest_region(_candidates(spark, sf_dir)[1])


@query(
    "C9_colour_variation",
    sql.with_(sql.DISCS, _BLUR, _OTSU, _DARK, _RUNS, _FILLED, _VARIATION, recursive=True,
              body=f"SELECT image_id, {sql.r('variation')} AS variation FROM vary"),
)
def colour_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled, candidates = _candidates(spark, sf_dir)
    return rounded(validate.colour_variation(tables.discs(spark, sf_dir), filled, validate.largest_region(candidates)))


VERDICT_SQL = """verdict AS MATERIALIZED (
  SELECT d.image_id, CASE WHEN skin_percent < 30 THEN printf('Insufficient skin color detected (%.1f%%)', skin_percent)
    WHEN b.region IS NULL THEN 'No potential lesion found in the image'
    WHEN variation < 5.0 THEN 'Insufficient color variation in the potential lesion'
    ELSE 'Valid skin lesion image' END AS reason
  FROM dims d JOIN skin USING (image_id) LEFT JOIN big b USING (image_id) LEFT JOIN vary USING (image_id))"""
VERDICT_PARTS = (sql.DISCS, _SKIN, _BLUR, _OTSU, _DARK, _RUNS, _FILLED, _VARIATION, VERDICT_SQL)


@query(
    "C10_validate_image",
    sql.with_(*VERDICT_PARTS, recursive=True,
              body="SELECT image_id, reason = 'Valid skin lesion image' AS is_valid, reason FROM verdict"),
)
def validate_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = cut(tables.discs(spark, sf_dir))
    return validate.validate_images(validate.strips_shape(strips), strips)


# --- segmentation ------------------------------------------------------------------------------

_UNIT = ("(r/255.0::DOUBLE)", "(g/255.0::DOUBLE)", "(b/255.0::DOUBLE)")
_LAB = sql.lab(*_UNIT)


def _slic_sql(rounds: int = 10, n: int = 20, compactness: float = 10.0) -> str:
    taps = [(i - 4, w) for i, w in enumerate(raster.gaussian_weights(1.0))]
    fold = lambda p, s: f"(CASE WHEN {p} < 0 THEN -1-({p}) WHEN {p} >= {s} THEN 2*{s}-1-({p}) ELSE {p} END)"
    parts = [
        sql.RASTER,
        f"lab0 AS MATERIALIZED (SELECT image_id, y, x, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM pix)",
        sql.values("gt", "o, wt", taps),
        f"""lab1 AS MATERIALIZED (SELECT t.image_id, t.y, t.x, sum(q.l*wt) AS l, sum(q.a*wt) AS a, sum(q.b*wt) AS b
  FROM (SELECT p.image_id, p.y, p.x, {fold('p.y+gt.o', 's.h')} AS qy, wt FROM lab0 p JOIN dims s USING (image_id) CROSS JOIN gt) t
  JOIN lab0 q ON q.image_id = t.image_id AND q.y = t.qy AND q.x = t.x GROUP BY t.image_id, t.y, t.x)""",
        f"""lab2 AS MATERIALIZED (SELECT t.image_id, t.y, t.x, sum(q.l*wt) AS l, sum(q.a*wt) AS a, sum(q.b*wt) AS b
  FROM (SELECT p.image_id, p.y, p.x, {fold('p.x+gt.o', 's.w')} AS qx, wt FROM lab1 p JOIN dims s USING (image_id) CROSS JOIN gt) t
  JOIN lab1 q ON q.image_id = t.image_id AND q.y = t.y AND q.x = t.qx GROUP BY t.image_id, t.y, t.x)""",
        f"""grid AS MATERIALIZED (SELECT image_id, h, w, greatest(1, CAST(floor(h / sqrt(h * w / {n}.0::DOUBLE) + 0.5) AS INT)) AS gy,
  greatest(1, CAST(floor(w / sqrt(h * w / {n}.0::DOUBLE) + 0.5) AS INT)) AS gx, {compactness**2}::DOUBLE / (h * w / {n}.0::DOUBLE) AS pull FROM dims)""",
        """px AS MATERIALIZED (SELECT p.*, g.gx, g.pull, (p.y * g.gy) // g.h AS prow, (p.x * g.gx) // g.w AS pcol FROM lab2 p JOIN grid g USING (image_id))""",
        """seed AS MATERIALIZED (SELECT image_id, CAST(t.i AS INT) AS seg, t.i // gx AS crow, t.i % gx AS ccol,
  ((t.i // gx) * 2 + 1) * h // (gy * 2) AS sy, ((t.i % gx) * 2 + 1) * w // (gx * 2) AS sx FROM grid, range(0, gy * gx) AS t(i))""",
        """ce0 AS MATERIALIZED (SELECT s.image_id, s.seg, s.crow, s.ccol, s.sy::DOUBLE AS cy, s.sx::DOUBLE AS cx, p.l, p.a, p.b
  FROM seed s JOIN lab2 p ON p.image_id = s.image_id AND p.y = s.sy AND p.x = s.sx)""",
        "step9(dr, dc) AS (SELECT r.i - 1, c.i - 1 FROM range(0, 3) AS r(i), range(0, 3) AS c(i))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""as{i} AS MATERIALIZED (
  SELECT image_id, y, x, any_value(l) AS l, any_value(a) AS a, any_value(b) AS b, arg_min(seg, cost) AS seg FROM (
    SELECT p.image_id, p.y, p.x, p.l, p.a, p.b, c.seg,
      ((p.l-c.l)*(p.l-c.l) + (p.a-c.a)*(p.a-c.a) + (p.b-c.b)*(p.b-c.b) + ((p.y-c.cy)*(p.y-c.cy) + (p.x-c.cx)*(p.x-c.cx)) * p.pull) AS cost
    FROM (SELECT px.*, prow + dr AS nr, pcol + dc AS nc FROM px, step9) p
    JOIN ce{i} c ON c.image_id = p.image_id AND c.crow = p.nr AND c.ccol = p.nc) GROUP BY image_id, y, x)"""
        )
        if i < rounds:
            parts.append(
                f"""ce{i + 1} AS MATERIALIZED (
  SELECT c.image_id, c.seg, c.crow, c.ccol, coalesce(m.cy, c.cy) AS cy, coalesce(m.cx, c.cx) AS cx, coalesce(m.l, c.l) AS l, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b
  FROM ce{i} c LEFT JOIN (SELECT image_id, seg, avg(y) AS cy, avg(x) AS cx, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM as{i} GROUP BY ALL) m USING (image_id, seg))"""
            )
    return sql.with_(*parts, body=f"SELECT image_id, y, x, seg FROM as{rounds}")


@query("D1_superpixels", _slic_sql())
def superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels(segment.superpixels(tables.raster(spark, sf_dir)), ["seg"])


@query("D2_enforce_connectivity")
def enforce_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = cut(segment.superpixels(tables.raster(spark, sf_dir)))
    return segment.enforce_connectivity(strips)


@query(
    "D2_connected_superpixels",
    sql.with_(
        sql.RASTER,
        body="""SELECT image_id, count(*) AS pixels, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS split_segments, CAST(0 AS BIGINT) AS small_segments
  FROM pix GROUP BY image_id""",
    ),
)
def connected_superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold after merging: every pixel has a number below the count of segments, each
    segment is one piece, and none is smaller than half the mean of the segments before."""
    raw = cut(segment.superpixels(tables.raster(spark, sf_dir)))
    runs = cut(regions.value_runs(segment.connected_superpixels(raw), "seg"))
    pieces = regions.connected_runs(runs, F.col("seg"), F.lit(0))
    size = pieces.groupBy("image_id", "seg").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.countDistinct("piece").alias("pieces"))
    least = raw.select("image_id", F.explode("seg").alias("seg")).groupBy("image_id").agg((F.count("seg") / F.countDistinct("seg") / 2).alias("least"))
    return size.join(least, "image_id").groupBy("image_id").agg(
        F.sum("n").alias("pixels"),
        (F.max("seg") + 1 - F.count("seg")).cast("bigint").alias("gaps"),
        F.count_if(F.col("pieces") > 1).alias("split_segments"),
        F.count_if(F.col("n") < F.col("least")).alias("small_segments"),
    )


_CELLS = f"""lab AS (SELECT image_id, seg, y, x, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM pix)"""


@query(
    "D3_segment_features",
    sql.with_(
        sql.DISCS, _CELLS,
        body=f"""SELECT image_id, seg AS node, {sql.r('avg(l)')} AS l, {sql.r('avg(a)')} AS a, {sql.r('avg(b)')} AS b,
  {sql.r('avg(y)')} AS cy, {sql.r('avg(x)')} AS cx FROM lab GROUP BY image_id, seg""",
    ),
)
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = segment.lab_strips(tables.disc_cells(spark, sf_dir))
    return rounded(segment.segment_features(cells))


_DARK_SEG = "(CASE WHEN r + g + b < 300 THEN 1 ELSE 0 END)"


@query(
    "D4_segment_boundaries",
    sql.with_(
        sql.DISCS,
        f"sg AS MATERIALIZED (SELECT image_id, y, x, {_DARK_SEG} AS s FROM pix)",
        """nb AS (SELECT a.image_id, a.y, a.x, a.s, a.y + o.dy AS qy, a.x + o.dx AS qx
  FROM sg a CROSS JOIN (VALUES (0,1),(0,-1),(1,0),(-1,0)) AS o(dy, dx))""",
        body="""SELECT DISTINCT n.image_id, n.y, n.x FROM nb n JOIN sg b ON b.image_id = n.image_id AND b.y = n.qy AND b.x = n.qx WHERE b.s <> n.s""",
    ),
)
def segment_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = raster.map_strips(
        tables.discs(spark, sf_dir), "seg", lambda r, g, b: F.when(r + g + b < 300, 1).otherwise(0)
    )
    return segment.segment_boundaries(strips)


@query(
    "D5_lesion_mask",
    sql.with_(sql.DISCS, body="SELECT image_id, CAST(sum(CASE WHEN seg > -1 THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM pix GROUP BY image_id"),
)
def lesion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = segment.lesion_mask(tables.disc_cells(spark, sf_dir))
    return masked.groupBy("image_id").agg(F.sum(F.size(F.filter("mask", lambda m: m))).cast("bigint").alias("inside"))
