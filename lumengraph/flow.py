"""The whole dataflow: strips of pictures to features, training and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.functions import colour
from lumengraph.operators import (
    assemble, colourstats, distances, graph, learn, measures, raster, results, segment, shape, spectral, texture, validate,
)
from lumengraph.session import at_once, cut

SIDE = 750


def preprocess(strips: DataFrame, clip_limit: float = 0.03, normalized_lab: bool = False) -> DataFrame:
    """Equalised channels in [0, 1]; with ``normalized_lab`` scaled Lab instead of RGB."""
    even = raster.equalize_adaptive(strips, clip_limit)
    if not normalized_lab:
        return even
    part = lambda i: lambda r, g, b: colour.normalize_lab(colour.rgb_to_lab(r, g, b))[i]
    work = even
    for i, c in enumerate(raster.CHANNELS):
        work = raster.map_strips(work, f"_{c}", part(i))
    return work.select(*raster.KEYS, *[F.col(f"_{c}").alias(c) for c in raster.CHANNELS])


def region_graph(
    strips: DataFrame, n_segments: int = 20, compactness: float = 10.0, threshold: float = 0.5,
    normalize_positions: bool = False, connect: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, segmented strips)`` of preprocessed pictures (channels in [0, 1])."""
    raw = cut(segment.superpixels(strips, n_segments, compactness, color_input="unit"))
    segs = cut(segment.connected_superpixels(raw))
    nodes = cut(segment.segment_features(segs))
    placed = nodes
    if normalize_positions:
        placed = graph.normalize_positions(nodes, segs.groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width")))
    edges = cut(graph.build_edges(placed, threshold, graph.region_adjacency(segs)))
    if connect:
        edges = cut(graph.repair_connectivity(nodes, edges, graph.connected_components(nodes, edges)))
    return nodes, edges, segs


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The 55 graph features as ``image_id, name, value``."""
    ids = ["image_id"]
    nodes, edges = cut(nodes), cut(edges)  # every measure below reads them
    # The loops do not depend on each other; their many small jobs share the cluster.
    costs = {kind: measures.costs(edges, kind) for kind in ("inverse", "hops", "weight")}
    inverse, hops, lengths, components, clustering, between = at_once([
        lambda: cut(distances.distance_sums(nodes, costs["inverse"])),
        lambda: cut(distances.hop_sums(nodes, costs["hops"])),
        lambda: cut(distances.distance_sums(nodes, costs["weight"])),
        lambda: cut(graph.connected_components(nodes, edges)),
        lambda: cut(measures.clustering_weighted(nodes, edges)),
        lambda: cut(measures.betweenness(nodes, edges)),
    ])
    per_node = {
        "clustering": clustering,
        "strength": measures.node_strength(nodes, edges),
        "betweenness": between,
        "closeness": measures.closeness(nodes, inverse),
    }
    values = None
    for name, table in per_node.items():
        part = table.select("image_id", F.lit(name).alias("metric"), F.col(name).alias("value"))
        values = part if values is None else values.unionByName(part)
    stats = measures.summary_statistics(cut(values), "value", ("image_id", "metric"))
    cells = F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("value")) for s in assemble.STATS])
    long = stats.select("image_id", "metric", F.inline(cells)).select(
        "image_id", F.concat_ws("_", "metric", "s").alias("name"), "value"
    )
    lap = cut(spectral.normalized_laplacian(nodes, edges))
    power = cut(spectral.band_power(spectral.chebyshev_moments(lap, nodes)))
    parts = [
        lambda: measures.structure_measures(nodes, edges),
        lambda: measures.local_efficiency(nodes, edges),
        lambda: measures.char_path_length(nodes, lengths, components),
        lambda: measures.global_efficiency(nodes, hops),
        lambda: spectral.extreme_eigenvalues(nodes, edges, components).drop("residual"),
        lambda: spectral.energies(lap),
        lambda: spectral.mean_power(power, nodes),
        lambda: spectral.band_entropy(power),
        lambda: spectral.band_peak(power),
    ]
    wide = at_once([lambda part=part: cut(part()) for part in parts])
    for table in wide:
        filled = measures.with_defaults(table, {**measures.GRAPH_DEFAULTS, **spectral.SPECTRAL_DEFAULTS})
        long = long.unionByName(assemble.long_from_wide(filled))
    moments = spectral.spectral_moments(lap, nodes, assemble.MOMENT_ORDER).where("k > 0")
    moments = moments.select(*ids, F.concat_ws("_", F.lit("moment"), "channel", F.col("k").cast("string")).alias("name"), F.col("moment").alias("value"))
    bands = power.select(*ids, F.concat_ws("_", F.lit("band_power"), F.col("band").cast("string")).alias("name"), F.col("power").alias("value"))
    return long.unionByName(moments).unionByName(bands)


def _named(table: DataFrame, prefix: list, values: dict[str, str], order: str = "front") -> DataFrame:
    """Long rows named ``<value>_<prefix>`` or ``<prefix>_<value>``."""
    join = lambda v: F.concat_ws("_", F.lit(v), *prefix) if order == "front" else F.concat_ws("_", *prefix, F.lit(v))
    cells = [F.struct(join(v).alias("name"), F.col(c).cast("double").alias("value")) for c, v in values.items()]
    return table.select("image_id", F.inline(F.array(*cells)))


def texture_features(strips: DataFrame) -> DataFrame:
    """Texture features of byte strips with ``mask``."""
    text = lambda c: F.col(c).cast("string")
    glcm = texture.cooccurrence_properties(cut(texture.cooccurrence(strips)))
    place = [F.concat(F.lit("d"), text("distance")), F.concat(F.lit("a"), text("angle"))]
    out = _named(glcm, place, {p: f"glcm_{p}" for p in texture.COOCCURRENCE_PROPERTIES})
    cells = cut(texture.pattern_cells(cut(texture.binary_patterns(strips, "mask")), texture.SHORT_BINS))
    kind = [F.concat(F.lit("r"), text("radius")), F.col("method")]
    hist = cells.where(F.col("bin") < texture.SHORT_NAMES)
    out = out.unionByName(hist.select("image_id", F.concat_ws("_", F.lit("lbp_hist"), *kind, text("bin")).alias("name"), F.col("density").alias("value")))
    out = out.unionByName(_named(texture.statistics_of_cells(cells), kind, {s: f"lbp_{s}" for s in ("mean", "std", "entropy")}))
    gray = cut(raster.gray_strips(strips, masked=True).select(*raster.KEYS, "gray", "mask"))
    waves = cut(texture.wavelet_statistics(texture.wavelet_coefficients(gray)))
    alias = F.array(*[F.struct(F.lit(f).alias("of"), F.lit(a).alias("as")) for f, names in texture.SAME_FILTERS.items() for a in names])
    waves = waves.withColumn("alias", F.explode(alias)).where("alias.of = family")
    front = [F.lit("wavelet"), F.col("alias.as"), F.col("band")]
    top = waves.where("level = 0")
    rest = waves.where("level > 0")
    out = out.unionByName(_named(top, front, {s: s for s in ("mean", "std", "energy", "entropy", "kurtosis", "skewness")}, "back"))
    out = out.unionByName(_named(rest, [*front, text("level")], {s: s for s in ("mean", "std", "energy", "entropy", "max")}, "back"))
    grads = cut(texture.gradients(gray, mask="mask"))  # three statistics read them
    by_size = texture.gradient_statistics(grads)
    k = [F.concat(F.lit("k"), text("ksize"))]
    for kind_, names in (("mag", ("mean", "std", "max", "energy")), ("dir", ("mean", "std", *[f"hist_{i}" for i in range(16)]))):
        out = out.unionByName(_named(by_size, [F.lit(f"gradient_{kind_}"), *k], {f"{kind_}_{n}": n for n in names}, "back"))
    for table in (texture.laplacian_statistics(grads), texture.scharr_statistics(grads), texture.edge_ratios(gray, mask="mask")):
        out = out.unionByName(assemble.long_from_wide(table))
    return out


def shape_features(strips: DataFrame, hu_mode: str = "raw") -> DataFrame:
    """Shape features of the strips' ``mask``."""
    moments = cut(shape.raw_moments(strips))
    areas = shape.area_extent(moments)
    border = cut(shape.perimeter(strips))
    hu = shape.hu_moments(moments, hu_mode)
    lists = hu.select("image_id", F.lit("hu_moments").alias("name"), F.array(*[f"hu_{i}" for i in range(7)]).alias("values"))
    out = assemble.expand_lists(lists)
    for table in (
        areas, border, shape.compactness(areas, border), shape.eccentricity(moments),
        shape.boundary_length(strips), shape.convexity(strips),
    ):
        out = out.unionByName(assemble.long_from_wide(table))
    return out


def conventional_features(strips: DataFrame) -> DataFrame:
    """The 928 colour, texture and shape features of byte strips with ``mask``."""
    return colourstats.colour_features(strips, "mask").unionByName(texture_features(strips)).unionByName(shape_features(strips))


def image_features(strips: DataFrame, **graph_options) -> DataFrame:
    """All 983 features of byte strips as ``image_id, name, value``.

    The mask is every segmented pixel, as in the original dataflow, unless the strips
    bring a ``mask`` of their own.
    """
    strips = cut(strips)
    nodes, edges, _ = region_graph(preprocess(strips), **graph_options)
    masked = strips
    if "mask" not in strips.columns:
        masked = strips.withColumn("mask", F.transform("r", lambda v: F.lit(True)))
    return cut(graph_features(nodes, edges)).unionByName(cut(conventional_features(masked)))


def feature_matrix(strips: DataFrame, **graph_options) -> DataFrame:
    """``image_id, features`` in catalogue order."""
    return assemble.assemble_features(image_features(strips, **graph_options), assemble.catalogue())


def prepare(images: DataFrame, side: int | None = SIDE) -> DataFrame:
    """Strips of decoded images, resampled to a square of ``side`` unless it is None."""
    strips = raster.to_strips(images)
    return strips if side is None else raster.resize(strips, side, side)


def score_images(images: DataFrame, model: learn.Classifier, side: int | None = SIDE, **graph_options) -> DataFrame:
    """``image_id, is_valid, validation, prediction, probability, label, risk_level``.

    Gates come first; features are worked out for valid pictures only.
    """
    strips = cut(prepare(images, side))
    verdict = cut(validate.validate_images(validate.strips_shape(strips), strips))
    valid = strips.join(verdict.where("is_valid").select("image_id"), "image_id", "left_semi")
    scored = model.predict(feature_matrix(valid, **graph_options)).select("image_id", "prediction", "probability")
    joined = verdict.withColumnRenamed("reason", "validation").join(scored, "image_id", "left")
    has = F.col("probability").isNotNull()
    return joined.withColumn(
        "label", F.when(has, results.prediction_label(F.col("prediction")))
    ).withColumn("risk_level", F.when(has, results.risk_level(F.col("probability"))))
