"""Quality gates: shape, skin colour, presence and colour of a dark spot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions import colour
from lumengraph.operators import regions
from lumengraph.operators.raster import gaussian_blur5, map_strips, pixels
from lumengraph.session import cut

# Limits and messages of the gates.
MIN_SIDE = 50
MIN_SKIN_PERCENT = 30.0
MIN_SHARE = 0.05
MAX_SHARE = 0.9
MIN_VARIATION = 5.0
EMPTY = "Empty image"
TOO_SMALL = "Image too small (less than 50x50 pixels)"
NOT_COLOUR = "Image must be color (RGB)"
LITTLE_SKIN = "Insufficient skin color detected (%.1f%%)"
NO_LESION = "No potential lesion found in the image"
FLAT_LESION = "Insufficient color variation in the potential lesion"
VALID = "Valid skin lesion image"


def shape_problem(height: Column, width: Column, channels: Column) -> Column:
    """The first failing shape rule, or null."""
    return (
        F.when(height.isNull() | width.isNull() | (height <= 0) | (width <= 0), F.lit(EMPTY))
        .when((height < MIN_SIDE) | (width < MIN_SIDE), F.lit(TOO_SMALL))
        .when(channels < 3, F.lit(NOT_COLOUR))
    )


def check_shape(images: DataFrame) -> DataFrame:
    """``image_id, problem`` of image rows."""
    i = lambda name: F.col(f"image.{name}")
    return images.select("image_id", shape_problem(i("height"), i("width"), i("nChannels")).alias("problem"))


def is_skin(h: Column, s: Column, v: Column) -> Column:
    """Fixed HSV ranges of skin: reddish hues, medium saturation, not dark."""
    return (h.between(0, 20) | h.between(170, 180)) & s.between(20, 150) & v.between(70, 255)


def skin_fraction(strips: DataFrame) -> DataFrame:
    """Percentage of skin-coloured pixels."""
    px = pixels(strips)
    h, s, v = colour.rgb_to_hsv8(*[F.col(c) for c in "rgb"])
    tested = px.select("image_id", h.alias("h"), s.alias("s"), v.alias("v"))
    skin = is_skin(F.col("h"), F.col("s"), F.col("v"))
    return tested.groupBy("image_id").agg((F.count_if(skin) / F.count("*") * 100.0).alias("skin_percent"))


def blurred_gray(strips: DataFrame) -> DataFrame:
    gray = map_strips(strips, "gray", colour.gray8)
    return gaussian_blur5(gray, "gray")


def otsu_threshold(strips: DataFrame, column: str = "gray") -> DataFrame:
    """The byte threshold with the largest variance between both classes; lowest of equals.

    The window runs over the 256 histogram cells of an image, not over its pixels.
    """
    px = strips.select("image_id", F.explode(column).alias("bin"))
    hist = px.groupBy("image_id", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    run = hist.select(
        "image_id", "bin",
        F.sum("n").over(upto).alias("n1"),
        F.sum(F.col("n") * F.col("bin")).over(upto).alias("s1"),
        F.sum("n").over(whole).alias("n_all"),
        F.sum(F.col("n") * F.col("bin")).over(whole).alias("s_all"),
    )
    n2 = F.col("n_all") - F.col("n1")
    q1, q2 = F.col("n1") / F.col("n_all"), n2 / F.col("n_all")
    gap = F.col("s1") / F.col("n1") - (F.col("s_all") - F.col("s1")) / n2
    between = F.when(n2 > 0, q1 * q2 * gap * gap).otherwise(F.lit(0.0))
    best = run.withColumn("between", F.round(between, 9)).groupBy("image_id").agg(
        F.max(F.struct("between", (-F.col("bin")).alias("minus"))).alias("best")
    )
    return best.select(
        "image_id", F.when(F.col("best.between") > 0, -F.col("best.minus")).otherwise(F.lit(0)).alias("threshold")
    )


def dark_mask(strips: DataFrame) -> DataFrame:
    """Strips with ``dark``: blurred gray not above the threshold.

    The hint keeps the lines off the driver, as in ``colour_variation``.
    """
    gray = cut(blurred_gray(strips))
    return gray.join(otsu_threshold(gray).hint("merge"), "image_id").withColumn(
        "dark", F.transform("gray", lambda v: v <= F.col("threshold"))
    )


def lesion_candidates(dark: DataFrame, filled: DataFrame) -> DataFrame:
    """Regions with between 5 and 90 percent of the picture."""
    size = dark.groupBy("image_id").agg(F.sum("width").alias("pixels"))
    area = regions.region_areas(filled).join(size, "image_id")
    return area.where(
        (F.col("area") > F.col("pixels") * MIN_SHARE) & (F.col("area") < F.col("pixels") * MAX_SHARE)
    ).select("image_id", "region", "area")


def largest_region(candidates: DataFrame) -> DataFrame:
    best = candidates.groupBy("image_id").agg(F.max(F.struct("area", (-F.col("region")).alias("minus"))).alias("best"))
    return best.select("image_id", (-F.col("best.minus")).alias("region"), F.col("best.area").alias("area"))


def colour_variation(strips: DataFrame, filled: DataFrame, largest: DataFrame) -> DataFrame:
    """Mean over the channels of the spread of colour inside the largest region.

    Runs meet the strips line by line; each run cuts its own stretch out of the line. The hint
    keeps the lines off the driver: the planner takes them for smaller than they are.
    """
    spot = filled.join(largest.select("image_id", "region"), ["image_id", "region"]).select("image_id", "y", "x0", "x1")
    cut_out = [F.slice(c, F.col("x0") + 1, F.col("x1") - F.col("x0") + 1).alias(c) for c in "rgb"]
    px = (
        strips.select("image_id", "y", *"rgb")
        .join(spot.hint("merge"), ["image_id", "y"])
        .select("image_id", F.arrays_zip(*cut_out).alias("px"))
        .select("image_id", F.inline("px"))
    )
    spread = sum((F.stddev_pop(c) for c in "gb"), F.stddev_pop("r")) / 3.0
    return px.groupBy("image_id").agg(spread.alias("variation"))


def validate_images(shapes: DataFrame, strips: DataFrame) -> DataFrame:
    """``image_id, is_valid, reason``: the first failing gate, or the message of success."""
    return gates(shapes, strips)[0]


def gates(shapes: DataFrame, strips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdicts ``image_id, is_valid, reason``, and the largest regions they saw.

    ``shapes`` is ``image_id, problem``. Only images of sound shape and enough skin go on
    to the costly region step.
    """
    shapes = cut(shapes)
    sound = cut(strips.join(shapes.where("problem IS NULL").select("image_id"), "image_id", "left_semi"))
    skin = cut(skin_fraction(sound))
    skinny = skin.where(F.col("skin_percent") >= MIN_SKIN_PERCENT).select("image_id")
    rest = cut(sound.join(skinny, "image_id", "left_semi"))
    dark = cut(dark_mask(rest))
    filled = cut(regions.filled_regions(dark))
    largest = cut(largest_region(lesion_candidates(dark, filled)))
    variation = colour_variation(rest, filled, largest)
    joined = shapes.join(skin, "image_id", "left").join(largest.select("image_id", "region"), "image_id", "left")
    joined = joined.join(variation, "image_id", "left")
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("skin_percent") < MIN_SKIN_PERCENT, F.format_string(LITTLE_SKIN, "skin_percent"))
        .when(F.col("region").isNull(), F.lit(NO_LESION))
        .when(F.col("variation") < MIN_VARIATION, F.lit(FLAT_LESION))
        .otherwise(F.lit(VALID))
    )
    return joined.select("image_id", (reason == VALID).alias("is_valid"), reason.alias("reason")), largest


def strips_shape(strips: DataFrame) -> DataFrame:
    """Shape verdict of three-channel strips."""
    size = strips.groupBy("image_id").agg(F.max("height").alias("h"), F.max("width").alias("w"))
    return size.select("image_id", shape_problem(F.col("h"), F.col("w"), F.lit(3)).alias("problem"))

