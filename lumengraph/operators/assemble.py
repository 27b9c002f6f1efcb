"""From long features to a matrix in the fixed order of the feature catalogue."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengraph.operators import spectral, texture

NODE_METRICS = ("clustering", "strength", "betweenness", "closeness")
STATS = ("mean", "std", "min", "max", "median")
GLOBAL = (
    "local_efficiency", "char_path_length", "global_efficiency", "global_clustering",
    "density", "assortativity", "transitivity", "rich_club_coefficient",
)
SPECTRAL = (
    "spectral_radius", "energy", "spectral_gap", "normalized_laplacian_energy",
    "spectral_power", "spectral_entropy", "spectral_amplitude",
)
MOMENT_ORDER = 4


def graph_names() -> list[str]:
    """55 names: node statistics, global and spectral scalars, moments and band powers."""
    names = [f"{m}_{s}" for m in NODE_METRICS for s in STATS] + list(GLOBAL) + list(SPECTRAL)
    names += [f"moment_{c}_{k}" for c in spectral.SIGNALS for k in range(1, MOMENT_ORDER + 1)]
    return names + [f"band_power_{b}" for b in range(spectral.BANDS)]


def geometric_names() -> list[str]:
    plain = ["area", "perimeter", "compactness", "eccentricity", "extent", "boundary_length", "convexity"]
    return plain + [f"hu_moments_{i}" for i in range(7)]


def colour_names() -> list[str]:
    stats = ("mean", "std", "min", "max", "skewness", "kurtosis", "entropy")
    out = []
    for s in ("rgb", "hsv", "lab"):
        out += [f"{s}_{c}_{n}" for c in range(3) for n in stats]
        out += [f"{s}_color_variance"] + [f"{s}_{c}_hist_{i}" for c in range(3) for i in range(8)]
    return out


def texture_names() -> list[str]:
    out = [
        f"glcm_{p}_d{d}_a{a}"
        for p in texture.COOCCURRENCE_PROPERTIES
        for d in texture.DISTANCES
        for a in range(len(texture.ANGLES))
    ]
    for r in texture.PATTERN_RADII:
        for m in texture.PATTERN_METHODS:
            out += [f"lbp_hist_r{r}_{m}_{i}" for i in range(min(texture.SHORT_NAMES, texture.pattern_bins(r, m, texture.SHORT_BINS)))]
            out += [f"lbp_{s}_r{r}_{m}" for s in ("mean", "std", "entropy")]
    for aliases in texture.SAME_FILTERS.values():
        for f in aliases:
            out += [f"wavelet_{f}_approx_{s}" for s in ("mean", "std", "energy", "entropy", "kurtosis", "skewness")]
            out += [
                f"wavelet_{f}_{b}_{level}_{s}"
                for b in ("horizontal", "vertical", "diagonal")
                for level in (1, 2, 3)
                for s in ("mean", "std", "energy", "entropy", "max")
            ]
    for k in texture.SOBEL:
        out += [f"gradient_mag_k{k}_{s}" for s in ("mean", "std", "max", "energy")]
        out += [f"gradient_dir_k{k}_{s}" for s in ("mean", "std")]
        out += [f"gradient_dir_k{k}_hist_{i}" for i in range(texture.DIRECTION_BINS)]
    out += [f"canny_edge_ratio_t{t}" for t in texture.EDGE_THRESHOLDS]
    return out + [f"{e}_{s}" for e, kinds in (("laplacian", ("mean", "std", "max")), ("scharr", ("mean", "std", "energy"))) for s in kinds]


def catalogue() -> list[str]:
    """All 983 names: graph features first, then the others by name."""
    return graph_names() + sorted(geometric_names() + colour_names() + texture_names())


def group_of() -> dict[str, str]:
    groups = {"graph": graph_names(), "geometric": geometric_names(), "color": colour_names(), "texture": texture_names()}
    return {name: group for group, names in groups.items() for name in names}


# --- shaping -----------------------------------------------------------------------------------


def expand_lists(lists: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``keys, name, values array`` as ``name_0, name_1, ...`` rows."""
    return lists.select(*keys, "name", F.posexplode("values").alias("i", "value")).select(
        *keys, F.concat_ws("_", "name", F.col("i").cast("string")).alias("name"), "value"
    )


def long_from_wide(wide: DataFrame, rename: dict[str, str] | None = None, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``keys, name, value`` of the other columns, optionally renamed."""
    rename = rename or {}
    names = [c for c in wide.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(rename.get(c, c)).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(*keys, F.inline(cells))


def clean_value():
    """Null, NaN and infinite values become 0."""
    v = F.col("value")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def complete(long: DataFrame, ids: DataFrame, names: Sequence[str], id_col: str = "image_id") -> DataFrame:
    """One row per id and catalogue name; what is missing becomes 0 in its own place."""
    wanted = ids.select(id_col).distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    return wanted.join(long.select(id_col, "name", "value"), [id_col, "name"], "left").select(
        id_col, "name", clean_value().alias("value")
    )


def _dense(size: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fill(places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for p, v in zip(places, values):
            row = np.zeros(size)
            row[np.asarray(p, dtype=int)] = np.asarray(v, dtype=float)
            out.append(row)
        return pd.Series(out)

    return fill


def assemble_features(long: DataFrame, names: Sequence[str], id_col: str = "image_id") -> DataFrame:
    """``id, features array<double>`` in catalogue order, 0 where a feature is missing.

    The catalogue, whose size is fixed, is broadcast; a row gathers one cell per name.
    """
    spark = long.sparkSession
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place int")
    placed = long.join(F.broadcast(order), "name").select(id_col, "place", clean_value().alias("value"))
    gathered = placed.groupBy(id_col).agg(F.collect_list("place").alias("p"), F.collect_list("value").alias("v"))
    return gathered.select(id_col, _dense(len(names))("p", "v").alias("features"))


def named_matrix(long: DataFrame, names: Sequence[str], labels: DataFrame | None = None, id_col: str = "image_id") -> DataFrame:
    """A column per name and, with labels, ``diagnosis`` in words.

    Missing, NaN and infinite values are 0. With labels there is one row for each of them,
    also for pictures without any feature.
    """
    wide = long.select(id_col, "name", clean_value().alias("value")).groupBy(id_col).pivot("name", list(names)).agg(F.first("value"))
    if labels is None:
        return wide.na.fill(0.0, list(names))
    word = F.when(F.col("label") == 1, F.lit("melanoma")).otherwise(F.lit("benign"))
    rows = labels.select(id_col, word.alias("diagnosis")).join(wide, id_col, "left")
    return rows.select(id_col, *[F.col(f"`{n}`") for n in names], "diagnosis").na.fill(0.0, list(names))


def column_names(names: Sequence[str], width: int) -> list[str]:
    """The names fitted to a width: ``feature_i`` beyond the last, or cut off."""
    return list(names[:width]) + [f"feature_{i}" for i in range(len(names), width)]


def feature_counts(long: DataFrame, groups: dict[str, str], least: int = 300, id_col: str = "image_id") -> DataFrame:
    """Found features per group and whether the conventional ones are suspiciously few."""
    spark = long.sparkSession
    table = spark.createDataFrame(sorted(groups.items()), "name string, grp string")
    kinds = sorted(set(groups.values()))
    found = long.where(F.col("value").isNotNull()).join(F.broadcast(table), "name")
    counts = found.groupBy(id_col).agg(*[F.count_if(F.col("grp") == g).alias(f"n_{g}") for g in kinds])
    conventional = sum((F.col(f"n_{g}") for g in kinds if g != "graph"), F.lit(0))
    return counts.withColumn("few", conventional < least)
