"""Colour statistics per image, colour space and channel.

Pixels are first counted by colour. The key of that count is (image, r, g, b), so
one very large image is spread over many tasks, and every later step works on
distinct colours with weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import colour
from lumengraph.operators.raster import pixels
from lumengraph.session import cut

CHANNEL = ("image_id", "space", "channel")
VALUES = tuple(f"{space}_{i}" for space in ("rgb", "hsv", "lab") for i in range(3))


def colour_census(strips: DataFrame, mask: str | None = None) -> DataFrame:
    """Number of pixels of each colour, inside the mask if one is named."""
    px = pixels(strips, ["r", "g", "b"] + ([mask] if mask else []))
    if mask:
        px = px.where(F.col(mask))
    return px.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def channel_values(census: DataFrame) -> DataFrame:
    """Nine values for each colour in one row: RGB bytes, HSV in [0, 1] and Lab."""
    unit = [F.col(c) / 255.0 for c in "rgb"]
    hsv, lab = colour.rgb_to_hsv(*unit), colour.rgb_to_lab(*unit)
    return census.select(
        "image_id",
        "n",
        *[F.col(c).cast("double").alias(f"rgb_{i}") for i, c in enumerate("rgb")],
        *[c.alias(f"hsv_{i}") for i, c in enumerate(hsv)],
        *[c.alias(f"lab_{i}") for i, c in enumerate(lab)],
    )


def channel_moments(values: DataFrame) -> DataFrame:
    """One row per image: its size, and mean, smallest and largest value of each channel."""
    each = [
        F.struct((F.sum(F.col("n") * F.col(v)) / F.sum("n")).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")).alias(f"{v}_m")
        for v in VALUES
    ]
    return values.groupBy("image_id").agg(F.sum("n").alias("size"), *each)


def channel_bins(values: DataFrame, bins: int = 256) -> DataFrame:
    """Equal-width bins from smallest to largest value with centred power sums.

    The hint keeps the colours off the driver: before they are counted, the planner
    takes them for as small as the table the pictures are made from, and would broadcast them.
    """
    wide = values.join(channel_moments(values).hint("merge"), "image_id")
    cells = [
        F.struct(F.lit(v[:3]).alias("space"), F.lit(int(v[4:])).alias("channel"), F.col(v).alias("value"), *[F.col(f"{v}_m.{m}").alias(m) for m in ("mean", "min", "max")])
        for v in VALUES
    ]
    known = wide.select("image_id", "n", "size", F.inline(F.array(*cells)))
    share = (F.col("value") - F.col("min")) / (F.col("max") - F.col("min"))
    place = F.when(F.col("max") > F.col("min"), F.least(F.floor(share * bins), F.lit(bins - 1)))
    dev = F.col("value") - F.col("mean")
    return known.groupBy(*CHANNEL, F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(
        F.sum("n").alias("n"),
        F.first("size").alias("size"),
        F.first("mean").alias("mean"),
        F.first("min").alias("min"),
        F.first("max").alias("max"),
        *[F.sum(F.col("n") * F.pow(dev, F.lit(float(k)))).alias(f"d{k}") for k in (2, 3, 4)],
    )


def channel_statistics(strips: DataFrame, mask: str | None = None, bins: int = 256) -> DataFrame:
    """Mean, spread, skewness, kurtosis and density entropy of each channel.

    The entropy follows the bin densities, not probabilities; a constant channel has
    skewness, kurtosis and entropy 0.
    """
    return statistics_of(channel_bins(channel_values(colour_census(strips, mask)), bins), bins)


def statistics_of(cells: DataFrame, bins: int) -> DataFrame:
    density = F.col("n") / (F.col("size") * ((F.col("max") - F.col("min")) / bins))
    varies = F.col("max") > F.col("min")
    cells = cells.withColumn("part", F.when(varies, -density * F.log2(density)).otherwise(F.lit(0.0)))
    whole = cells.groupBy(*CHANNEL).agg(
        F.first("size").alias("size"),
        F.first("mean").alias("mean"),
        F.first("min").alias("min"),
        F.first("max").alias("max"),
        *[F.sum(f"d{k}").alias(f"d{k}") for k in (2, 3, 4)],
        F.sum("part").alias("entropy"),
    )
    std = F.sqrt(F.col("d2") / F.col("size"))
    shape = lambda k: F.when(
        varies, F.col(f"d{k}") / F.col("size") / F.pow(std, F.lit(float(k)))
    ).otherwise(F.lit(0.0))
    return whole.select(
        *CHANNEL,
        "mean",
        std.alias("std"),
        "min",
        "max",
        shape(3).alias("skewness"),
        shape(4).alias("kurtosis"),
        "entropy",
    )


def colour_variance(statistics: DataFrame) -> DataFrame:
    """Sum of the channel variances of each space."""
    return statistics.groupBy("image_id", "space").agg(
        F.sum(F.col("std") * F.col("std")).alias("color_variance")
    )


def channel_histogram(strips: DataFrame, mask: str | None = None, bins: int = 8) -> DataFrame:
    """Bin densities of each channel, zero for empty bins and constant channels."""
    return histogram_of(channel_bins(channel_values(colour_census(strips, mask)), bins), bins)


def histogram_of(cells: DataFrame, bins: int) -> DataFrame:
    width = (F.col("max") - F.col("min")) / bins
    density = F.when(F.col("max") > F.col("min"), F.col("n") / (F.col("size") * width)).otherwise(F.lit(0.0))
    filled = cells.groupBy(*CHANNEL).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("bin"), density.alias("d")))).alias("found")
    )
    every = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("found"), i), F.lit(0.0))
    )
    return filled.select(*CHANNEL, F.posexplode(every).alias("bin", "density"))


def colour_features(strips: DataFrame, mask: str | None = None) -> DataFrame:
    """All colour features as ``image_id, name, value``.

    One census and one set of 256 bins serve both the statistics and the 8-bin
    histogram: a coarse bin is 32 fine ones.
    """
    fine, coarse = 256, 8
    cells = cut(channel_bins(channel_values(cut(colour_census(strips, mask))), fine))
    stats = statistics_of(cells, fine)
    prefix = F.concat_ws("_", "space", F.col("channel").cast("string"))
    names = ("mean", "std", "min", "max", "skewness", "kurtosis", "entropy")
    pairs = [F.struct(F.concat_ws("_", prefix, F.lit(n)).alias("name"), F.col(n).alias("value")) for n in names]
    scalars = stats.select("image_id", F.inline(F.array(*pairs)))
    variance = colour_variance(stats).select(
        "image_id", F.concat_ws("_", "space", F.lit("color_variance")).alias("name"), F.col("color_variance").alias("value")
    )
    whole = [F.first(c).alias(c) for c in ("size", "min", "max")]
    bin_ = F.floor(F.col("bin") / (fine // coarse)).cast("int").alias("bin")
    wide = cells.groupBy(*CHANNEL, bin_).agg(F.sum("n").alias("n"), *whole)
    hist = histogram_of(wide, coarse).select(
        "image_id",
        F.concat_ws("_", prefix, F.lit("hist"), F.col("bin").cast("string")).alias("name"),
        F.col("density").alias("value"),
    )
    return scalars.unionByName(variance).unionByName(hist)
