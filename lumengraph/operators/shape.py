"""Shape features of a mask given as strips with a boolean ``mask``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengraph.operators.raster import with_neighbours


def mask_points(strips: DataFrame) -> DataFrame:
    """``image_id, y, x`` of the pixels inside the mask."""
    return strips.select("image_id", "y", F.posexplode("mask").alias("x", "inside")).where("inside").drop("inside")


def _line_sums(strips: DataFrame, order: int) -> DataFrame:
    """Sums of x^k over the inside of each line; ``y`` enters once per line."""
    xs = F.filter(F.transform("mask", lambda m, x: F.when(m, x)), lambda x: x.isNotNull())
    lines = strips.select("image_id", "y", xs.alias("xs")).where(F.size("xs") > 0)
    power = lambda k: F.aggregate(
        "xs", F.lit(0.0), lambda acc, x: acc + F.pow(x.cast("double"), F.lit(float(k)))
    )
    return lines.select(
        "image_id", "y", F.array_min("xs").alias("x_lo"), F.array_max("xs").alias("x_hi"),
        *[power(k).alias(f"s{k}") for k in range(order + 1)],
    )


def raw_moments(strips: DataFrame, order: int = 3) -> DataFrame:
    """``m_pq`` = sum of y^p x^q for p + q up to ``order``."""
    lines = _line_sums(strips, order)
    y = F.col("y").cast("double")
    return lines.groupBy("image_id").agg(
        *[
            F.sum(F.pow(y, F.lit(float(p))) * F.col(f"s{q}")).alias(f"m{p}{q}")
            for p in range(order + 1)
            for q in range(order + 1 - p)
        ],
        F.min("y").alias("y_lo"),
        F.max("y").alias("y_hi"),
        F.min("x_lo").alias("x_lo"),
        F.max("x_hi").alias("x_hi"),
    )


def area_extent(moments: DataFrame) -> DataFrame:
    box = (F.col("y_hi") - F.col("y_lo") + 1) * (F.col("x_hi") - F.col("x_lo") + 1)
    return moments.select(
        "image_id", F.col("m00").cast("bigint").alias("area"), (F.col("m00") / box).alias("extent")
    )


def eccentricity(moments: DataFrame) -> DataFrame:
    """Of the ellipse with the same second moments; 0 for a single point."""
    n = F.col("m00")
    var = lambda second, first: F.col(second) / n - (F.col(first) / n) * (F.col(first) / n)
    vy, vx = var("m20", "m10"), var("m02", "m01")
    cov = F.col("m11") / n - (F.col("m10") / n) * (F.col("m01") / n)
    half = (vy + vx) / 2
    gap = F.sqrt((vy - vx) * (vy - vx) / 4 + cov * cov)
    big, small = half + gap, F.greatest(half - gap, F.lit(0.0))
    return moments.select(
        "image_id",
        F.when(big <= 0, F.lit(0.0)).otherwise(F.sqrt(F.lit(1.0) - small / big)).alias("eccentricity"),
    )


def hu_from(n: dict[str, Column]) -> list[Column]:
    """The seven rotation invariants of second and third order moments."""
    a, b = n["30"] + n["12"], n["21"] + n["03"]
    c, d = n["30"] - n["12"] * 3, n["21"] * 3 - n["03"]
    s, t = n["20"] - n["02"], n["11"]
    return [
        n["20"] + n["02"],
        s * s + t * t * 4,
        c * c + d * d,
        a * a + b * b,
        c * a * (a * a - b * b * 3) + d * b * (a * a * 3 - b * b),
        s * (a * a - b * b) + t * a * b * 4,
        d * a * (a * a - b * b * 3) - c * b * (a * a * 3 - b * b),
    ]


def hu_moments(moments: DataFrame, mode: str = "raw") -> DataFrame:
    """Hu invariants ``hu_0 .. hu_6``, from raw moments or from normalised central ones."""
    if mode == "raw":
        use = {k: F.col(f"m{k}") for k in ("20", "02", "11", "30", "21", "12", "03")}
    elif mode == "central":
        m = lambda k: F.col(f"m{k}")
        cy, cx = m("10") / m("00"), m("01") / m("00")
        mu = {
            "20": m("20") - cy * m("10"),
            "02": m("02") - cx * m("01"),
            "11": m("11") - cy * m("01"),
            "30": m("30") - cy * m("20") * 3 + cy * cy * m("10") * 2,
            "03": m("03") - cx * m("02") * 3 + cx * cx * m("01") * 2,
            "21": m("21") - cy * m("11") * 2 - cx * m("20") + cy * cy * m("01") * 2,
            "12": m("12") - cx * m("11") * 2 - cy * m("02") + cx * cx * m("10") * 2,
        }
        use = {k: v / F.pow(m("00"), F.lit(1.0 + (int(k[0]) + int(k[1])) / 2.0)) for k, v in mu.items()}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return moments.select("image_id", *[h.alias(f"hu_{i}") for i, h in enumerate(hu_from(use))])


# Weight of a border pixel by the code of its border neighbours.
_ONE = (5, 7, 15, 17, 25, 27)
_DIAGONAL = (21, 33)
_MIXED = (13, 23)


def perimeter(strips: DataFrame) -> DataFrame:
    """Length of the border by the pattern of border pixels around each of them.

    A border pixel has an outside 4-neighbour; one more line and column around it
    tell which of its neighbours are border pixels, so two lines above and below do.
    """
    bits = strips.withColumn("m", F.transform("mask", lambda v: F.when(v, 1).otherwise(0)))
    near = with_neighbours(bits, ["m"], 2, 2, border="zero")
    at = lambda j, x: F.get(F.get(F.col("m"), F.lit(j)), x)
    # Border pixels of lines y-1, y, y+1, for columns -1 .. width.
    border = lambda j: F.transform(
        F.sequence(F.lit(1), F.col("width") + 2),
        lambda x: F.when(
            (at(j, x) == 1)
            & (at(j - 1, x) + at(j + 1, x) + at(j, x - 1) + at(j, x + 1) < 4),
            1,
        ).otherwise(0),
    )
    rows = near.select("image_id", "width", *[border(j).alias(f"b{j}") for j in (1, 2, 3)])
    px = rows.select("image_id", "b1", "b2", "b3", F.explode(F.sequence(F.lit(1), F.col("width"))).alias("x"))
    b = lambda j, dx: F.get(F.col(f"b{j}"), F.col("x") + dx)
    code = (
        b(2, 0)
        + (b(1, 0) + b(3, 0) + b(2, -1) + b(2, 1)) * 2
        + (b(1, -1) + b(1, 1) + b(3, -1) + b(3, 1)) * 10
    )
    coded = px.where(b(2, 0) == 1).select("image_id", code.alias("code"))
    weight = (
        F.when(F.col("code").isin(*_ONE), F.lit(1.0))
        .when(F.col("code").isin(*_DIAGONAL), F.lit(math.sqrt(2.0)))
        .when(F.col("code").isin(*_MIXED), F.lit((1.0 + math.sqrt(2.0)) / 2.0))
        .otherwise(F.lit(0.0))
    )
    return coded.groupBy("image_id").agg(F.sum(weight).alias("perimeter"))


def compactness(areas: DataFrame, perimeters: DataFrame) -> DataFrame:
    p = F.col("perimeter")
    return areas.join(perimeters, "image_id", "left").select(
        "image_id",
        F.when(p > 0, F.lit(4 * math.pi) * F.col("area") / (p * p)).otherwise(F.lit(0.0)).alias("compactness"),
    )


def boundary_length(strips: DataFrame) -> DataFrame:
    """Number of 4-neighbour pairs with one side inside: the vertices of the contours."""
    flips = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda p, q: p != q), lambda v: v))
    near = with_neighbours(strips, ["mask"], 0, 1, border="none", side=0)
    line = F.get("mask", F.lit(0))
    short = F.slice(line, 1, F.col("width") - 1)
    across = F.when(F.col("width") > 1, flips(short, F.slice(line, 2, F.col("width") - 1))).otherwise(F.lit(0))
    below = F.when(F.size("mask") > 1, flips(line, F.get("mask", F.lit(1)))).otherwise(F.lit(0))
    return near.groupBy("image_id").agg(F.sum(across + below).cast("bigint").alias("boundary_length"))


#: Lines whose hull is made together, and hulls that are merged at once.
HULL_LINES, HULLS = 256, 16


def hull_corners(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Corners (y, x) of the convex hull of whole-numbered points, once around; points on its sides are none."""
    points = np.unique(np.stack([ys, xs], axis=1), axis=0)
    if len(points) < 3:
        return points

    def side(way: np.ndarray) -> list[list[int]]:
        kept: list[list[int]] = []
        for y, x in way.tolist():
            while len(kept) > 1:
                (y0, x0), (y1, x1) = kept[-2:]
                if (y1 - y0) * (x - x0) > (x1 - x0) * (y - y0):
                    break
                kept.pop()
            kept.append([y, x])
        return kept[:-1]

    return np.array(side(points) + side(points[::-1]))


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ys", "xs")]))
def _hull(ys: pd.Series, xs: pd.Series) -> pd.DataFrame:
    corners = [hull_corners(np.asarray(y), np.asarray(x)) for y, x in zip(ys, xs)]
    return pd.DataFrame({"ys": [c[:, 0] for c in corners], "xs": [c[:, 1] for c in corners]})


def convex_hull(strips: DataFrame) -> DataFrame:
    """``image_id, ys, xs``: corners of the convex hull of the pixel centres, once around.

    Only both ends of a line can be corners. Hulls are made for blocks of `HULL_LINES` lines
    and merged, `HULLS` at a time, so no task holds more than the corners of a few hulls, and
    a block of H lines and W columns has some (H * W)^(1/3) of them. Pictures without an
    inside have no row.
    """
    tallest = strips.agg(F.max("y").alias("y")).first()["y"] or 0
    ends = _line_sums(strips, 0).select(
        "image_id", F.floor(F.col("y") / HULL_LINES).cast("int").alias("part"), F.array(F.col("y"), F.col("y")).alias("ys"), F.array("x_lo", "x_hi").alias("xs")
    )
    joined = lambda c: F.flatten(F.transform("met", lambda s: s[c].cast("array<int>")))
    parts, last = ends, tallest // HULL_LINES
    while True:
        met = parts.groupBy("image_id", "part").agg(F.collect_list(F.struct("ys", "xs")).alias("met"))
        hulls = met.select("image_id", "part", _hull(joined("ys"), joined("xs")).alias("hull"))
        if last == 0:
            return hulls.select("image_id", "hull.ys", "hull.xs")
        parts = hulls.select("image_id", F.floor(F.col("part") / HULLS).cast("int").alias("part"), "hull.ys", "hull.xs")
        last //= HULLS


def hull_perimeter(strips: DataFrame, angles: int | None = None) -> DataFrame:
    """Perimeter of the convex hull of the pixel centres.

    With ``angles`` it is estimated by Cauchy's formula: the mean width over so many
    directions. The farthest point in any direction is a corner of the hull, so all
    directions are read off the corners, in the picture's one row.
    """
    hulls = convex_hull(strips)
    if angles is not None:
        return hulls.select("image_id", _mean_reach(angles)("ys", "xs").alias("hull_perimeter"))
    ahead = lambda c: F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1))
    step = lambda a, b: F.zip_with(a, b, lambda p, q: (p - q).cast("double") * (p - q))
    sides = F.zip_with(step("ys", ahead("ys")), step("xs", ahead("xs")), lambda p, q: F.sqrt(p + q))
    return hulls.select("image_id", F.aggregate(sides, F.lit(0.0), lambda acc, v: acc + v).alias("hull_perimeter"))


def _mean_reach(angles: int):
    """Sum over the directions of the largest reach of the corners (ys, xs), by the step."""
    step = 2 * math.pi / angles
    turn = np.arange(angles) * step
    cos, sin = np.cos(turn), np.sin(turn)

    @F.pandas_udf("double")
    def reach(ys: pd.Series, xs: pd.Series) -> pd.Series:
        sums = []
        for y, x in zip(ys, xs):
            top = np.full(angles, -np.inf)
            for a in range(0, len(y), 1024):  # few corners at once, whatever their number
                part = slice(a, a + 1024)
                top = np.maximum(top, (np.outer(np.asarray(x[part]), cos) + np.outer(np.asarray(y[part]), sin)).max(axis=0))
            sums.append(float(top.sum()) * step)
        return pd.Series(sums, dtype="float64")

    return reach


def convexity(strips: DataFrame, angles: int | None = None) -> DataFrame:
    """Hull perimeter over perimeter, 1 when the perimeter is 0."""
    p = F.col("perimeter")
    return hull_perimeter(strips, angles).join(perimeter(strips), "image_id", "left").select(
        "image_id",
        F.when(p > 0, F.col("hull_perimeter") / p).otherwise(F.lit(1.0)).alias("convexity"),
    )
