"""Texture features: co-occurrence, binary patterns, gradients, wavelets, edges."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengraph.functions import colour
from lumengraph.operators import raster
from lumengraph.operators.raster import horizontal_pass, vertical_pass, weighted, with_neighbours
from lumengraph.operators.regions import label_regions
from lumengraph.operators.segment import _flat, _lengths, _lists, _slices
from lumengraph.session import cut


def _cubes(lines: pa.ListArray, wide: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one width and their ``2k + 1`` lines, padded by ``k``, as one cube; NaN where some lack."""
    inner = lines.flatten()
    flat, lengths = _flat(inner), _lengths(inner)
    first = np.concatenate([[0], np.cumsum(_lengths(lines))])  # of the lines of a row
    start = np.concatenate([[0], np.cumsum(lengths)])  # of the values of a line
    for w in np.unique(wide):
        rows = np.flatnonzero(wide == w)
        size = (2 * k + 1) * (w + 2 * k)
        there = np.diff(first)[rows] == 2 * k + 1
        there &= start[first[rows + 1]] - start[first[rows]] == size
        cube = np.full((len(rows), size), np.nan)
        cube[there] = flat[start[first[rows[there]]][:, None] + np.arange(size)]
        cube = cube.reshape(len(rows), 2 * k + 1, w + 2 * k)
        for i in np.flatnonzero(~there):
            for j, at in enumerate(range(first[rows[i]], first[rows[i] + 1])):
                cube[i, j, : lengths[at]] = flat[start[at] : start[at + 1]]
        yield rows, cube


def _total(parts: Sequence[tuple[float, np.ndarray]]) -> np.ndarray:
    """The same sum in the same order as `raster.weighted`."""
    total = None
    for weight, part in parts:
        if weight != 0:
            part = part if weight == 1 else part * weight
            total = part if total is None else total + part
    return total

# --- co-occurrence ----------------------------------------------------------------------------

# Distances and directions.
DISTANCES = (1, 2, 3, 4)
ANGLES = (
    0.0,
    math.pi / 6,
    math.pi / 4,
    math.pi / 3,
    math.pi / 2,
    2 * math.pi / 3,
    3 * math.pi / 4,
    5 * math.pi / 6,
)


def _nearest(v: float) -> int:
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def pair_offsets() -> list[tuple[int, int, int, int]]:
    """``(distance, angle index, line offset, column offset)`` of all directions."""
    return [
        (d, i, _nearest(d * math.sin(a)), _nearest(d * math.cos(a)))
        for d in DISTANCES
        for i, a in enumerate(ANGLES)
    ]


def cooccurrence(strips: DataFrame, levels: int = 8) -> DataFrame:
    """Symmetric, normalised co-occurrence ``(image_id, distance, angle, i, j, p)``.

    Several directions round to the same pixel offset; each offset is counted once
    and handed to all its directions afterwards.
    """
    offsets = pair_offsets()
    distinct = sorted({(dy, dx) for _, _, dy, dx in offsets})
    reach = max(dy for dy, _ in distinct)
    q = raster.map_strips(
        strips, "q", lambda r, g, b: colour.quantize(colour.gray(r / 255.0, g / 255.0, b / 255.0), levels)
    )
    near = with_neighbours(q, ["q"], 0, reach, border="none", side=0)
    px = near.select("image_id", "q", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    partner = lambda dy, dx: F.get(F.get(F.col("q"), F.lit(dy)), F.col("x") + dx)
    pairs = px.select(
        "image_id",
        F.col("q")[0][F.col("x")].alias("i"),
        F.posexplode(F.array(*[partner(dy, dx) for dy, dx in distinct])).alias("offset", "j"),
    )
    counts = pairs.where("j IS NOT NULL").groupBy("image_id", "offset", "i", "j").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.select("image_id", "offset", F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    both = both.groupBy("image_id", "offset", "i", "j").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("image_id", "offset"))
    directions = F.array(
        *[
            F.array(
                *[
                    F.struct(F.lit(d).alias("distance"), F.lit(a).alias("angle"))
                    for d, a, y, x in offsets
                    if (y, x) == place
                ]
            )
            for place in distinct
        ]
    )
    shared = both.select("image_id", "offset", "i", "j", share.alias("p"))
    return shared.select(
        "image_id", "i", "j", "p", F.explode(F.get(directions, F.col("offset"))).alias("to")
    ).select("image_id", "to.distance", "to.angle", "i", "j", "p")


# Fixed values.
COOCCURRENCE_PROPERTIES = (
    "contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM", "entropy",
)


def cooccurrence_properties(table: DataFrame) -> DataFrame:
    gap = F.col("i") - F.col("j")
    p = F.col("p")
    sums = table.groupBy("image_id", "distance", "angle").agg(
        F.sum(p * gap * gap).alias("contrast"),
        F.sum(p * F.abs(gap)).alias("dissimilarity"),
        F.sum(p / (F.lit(1.0) + gap * gap)).alias("homogeneity"),
        F.sum(p * p).alias("ASM"),
        F.sum(-p * F.log2(p)).alias("entropy"),
        F.sum(p * F.col("i")).alias("m1"),
        F.sum(p * F.col("i") * F.col("i")).alias("m2"),
        F.sum(p * F.col("i") * F.col("j")).alias("m11"),
    )
    var = F.col("m2") - F.col("m1") * F.col("m1")
    corr = F.when(var < 1e-12, F.lit(1.0)).otherwise((F.col("m11") - F.col("m1") * F.col("m1")) / var)
    return sums.select(
        "image_id", "distance", "angle", "contrast", "dissimilarity", "homogeneity",
        F.sqrt("ASM").alias("energy"), corr.alias("correlation"), "ASM", "entropy",
    )


# --- local binary patterns -----------------------------------------------------------------------

# Fixed values.
PATTERN_RADII = (1, 2, 3)
PATTERN_METHODS = ("uniform", "default", "ror")


def pattern_taps(radius: int) -> list[tuple[int, int, int, int, float, float]]:
    """Sample points ``(y0, x0, y1, x1, fy, fx)`` on the circle, by bilinear corners."""
    n = 8 * radius
    taps = []
    for i in range(n):
        dy = round(-radius * math.sin(2 * math.pi * i / n), 5)
        dx = round(radius * math.cos(2 * math.pi * i / n), 5)
        y0, x0 = math.floor(dy), math.floor(dx)
        taps.append((y0, x0, math.ceil(dy), math.ceil(dx), dy - y0, dx - x0))
    return taps


def _pattern_codes(cube: np.ndarray, radius: int) -> np.ndarray:
    """Pattern codes of the middle lines of a cube of padded neighbourhoods.

    A pixel has 48 samples of four corners each; as nested array expressions, which
    Spark interprets value by value, that is two orders of magnitude slower.
    """
    far = max(PATTERN_RADII)
    w = cube.shape[2] - 2 * far
    cut_out = lambda dy, dx: cube[:, far + dy, far + dx : far + dx + w]
    centre = cut_out(0, 0)
    code = np.zeros(centre.shape, dtype=np.int64)
    for i, (y0, x0, y1, x1, fy, fx) in enumerate(pattern_taps(radius)):
        top = (1.0 - fx) * cut_out(y0, x0) + fx * cut_out(y0, x1)
        low = (1.0 - fx) * cut_out(y1, x0) + fx * cut_out(y1, x1)
        code |= (((1.0 - fy) * top + fy * low) - centre >= 0).astype(np.int64) << i
    return code


def _pattern_forms(raw: np.ndarray, radius: int) -> dict[str, np.ndarray]:
    """The codes of every method from raw ones."""
    n = 8 * radius
    whole = (1 << n) - 1
    flips = np.bitwise_count((raw ^ (raw >> 1)) & (whole >> 1))
    turned = raw
    for k in range(1, n):
        turned = np.minimum(turned, ((raw >> k) | (raw << (n - k))) & whole)
    return {"uniform": np.where(flips <= 2, np.bitwise_count(raw), n + 1), "default": raw, "ror": turned}


# The shortened histogram of the feature catalogue has so many bins of raw codes
# at most, of which the first are features.
SHORT_BINS = 128
SHORT_NAMES = 30


def pattern_bins(radius: int, method: str, most: int | None = None) -> int:
    """Bins of a coding; raw codes have one each, unless ``most`` gives a smaller number."""
    n = 8 * radius
    return {"uniform": n + 2, "default": min(2**n, most or 2**n), "ror": n + 1}[method]


def binary_patterns(strips: DataFrame, mask: str | None = None) -> DataFrame:
    """Counts of pattern codes ``(image_id, radius, method, code, n)``.

    Codes come from the whole picture, outside of it counting as 0; the mask only
    selects the pixels that are counted.
    """
    far = max(PATTERN_RADII)
    keep = [mask] if mask else []
    bytes_ = raster.map_strips(
        strips, "v", lambda r, g, b: F.floor(colour.gray(r / 255.0, g / 255.0, b / 255.0) * 255.0).cast("double")
    )
    near = with_neighbours(bytes_, ["v"], far, far, border="zero", keep=keep)
    id_type = near.schema["image_id"].dataType
    schema = T.StructType([
        T.StructField("image_id", id_type), T.StructField("radius", T.IntegerType()), T.StructField("form", T.IntegerType()),
        T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType()),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All methods' codes of some lines, counted, so that no row is made for a pixel."""
        for batch in batches:
            # Lines of about 2^16 pixels together, as a pixel has seven lines of neighbours here.
            wide = batch.column("width").to_numpy().astype(np.int64)
            steps = np.flatnonzero(np.diff(np.cumsum(wide) >> 16, prepend=-1))
            for first, last in zip(steps, [*steps[1:], len(wide)]):
                one = batch.slice(first, last - first)
                ids = one.column("image_id").dictionary_encode()
                place = ids.indices.to_numpy().astype(np.int64)
                inside = one.column(mask) if mask else None
                inner = np.concatenate([[0], np.cumsum(_lengths(inside))]) if mask else None
                on = pc.fill_null(inside.flatten(), False).to_numpy(zero_copy_only=False) if mask else None
                for rows, cube in _cubes(one.column("v"), wide[first:last], far):
                    if np.isnan(cube).any():
                        raise ValueError("a picture lacks lines or pixels")
                    shape = (len(rows), cube.shape[2] - 2 * far)
                    of = np.broadcast_to(place[rows][:, None], shape)
                    taken = on[inner[rows][:, None] + np.arange(shape[1])] if mask else np.ones(shape, bool)
                    for radius in PATTERN_RADII:
                        keys, n = np.unique(of[taken] << 24 | _pattern_codes(cube, radius)[taken], return_counts=True)
                        for form, codes in enumerate(_pattern_forms(keys & 0xFFFFFF, radius).values()):
                            kinds, at = np.unique((keys >> 24) << 24 | codes, return_inverse=True)
                            sums = np.bincount(at, n, len(kinds)).astype(np.int64)
                            fixed = [pa.array(np.full(len(kinds), v, np.int32)) for v in (radius, form)]
                            yield pa.RecordBatch.from_arrays(
                                [ids.dictionary.take(pa.array(kinds >> 24)), *fixed, pa.array((kinds & 0xFFFFFF).astype(np.int32)), pa.array(sums)],
                                names=schema.names,
                            )

    counted = near.select("image_id", "width", "v", *keep).mapInArrow(count, schema)
    methods = F.array(*[F.lit(m) for m in PATTERN_METHODS])
    return (
        counted.groupBy("image_id", "radius", "form", "code")
        .agg(F.sum("n").alias("n"))
        .select("image_id", "radius", F.get(methods, F.col("form")).alias("method"), "code", "n")
    )


def _pattern_bin_count(most: int | None) -> Column:
    n = F.col("radius") * 8
    raw = F.expr("shiftleft(1, radius * 8)")
    raw = raw if most is None else F.least(raw, F.lit(most))
    return F.when(F.col("method") == "uniform", n + 2).when(F.col("method") == "ror", n + 1).otherwise(raw)


PATTERN = ("image_id", "radius", "method")


def pattern_cells(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The bins of `pattern_histogram` with what `pattern_statistics` sums over them.

    Raw codes are about as many as pixels, so one pass over the counts serves both.
    """
    span = counts.groupBy(*PATTERN).agg(
        F.min("code").alias("lo"), F.max("code").alias("hi"), F.sum("n").alias("size"),
        (F.sum(F.col("n") * F.col("code")) / F.sum("n")).alias("mean"),
    )
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        *PATTERN, "size", "mean",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi").cast("double")).alias("hi"),
        _pattern_bin_count(most).alias("bins"),
    )
    known = counts.join(span, list(PATTERN))
    place = F.least(
        F.floor((F.col("code") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1
    ).cast("int")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    dev = F.col("code") - F.col("mean")
    return known.groupBy(*PATTERN, "bins", place.alias("bin")).agg(
        (F.sum("n") / (F.first("size") * F.first(width))).alias("density"),
        F.first("size").alias("size"), F.first("mean").alias("mean"), F.sum(F.col("n") * dev * dev).alias("spread"),
    )


def pattern_histogram(counts: DataFrame, most: int | None = None) -> DataFrame:
    """Bin densities ``(…, bin, density, bins)`` of the codes, empty bins left out.

    Raw codes have a bin each; ``most`` (`SHORT_BINS` in the feature catalogue) merges them.
    """
    return pattern_cells(counts, most).select(*PATTERN, "bins", "bin", "density")


def pattern_statistics(counts: DataFrame, most: int | None = None) -> DataFrame:
    """Mean and spread of the codes and the entropy of their histogram."""
    return statistics_of_cells(pattern_cells(counts, most))


def statistics_of_cells(cells: DataFrame) -> DataFrame:
    h = F.col("density")
    return cells.groupBy(*PATTERN).agg(
        F.first("mean").alias("mean"), F.sqrt(F.sum("spread") / F.first("size")).alias("std"), F.sum(-h * F.log2(h + 1e-10)).alias("entropy"),
    )


# --- gradients -------------------------------------------------------------------------------

# Derivative and smoothing taps of the Sobel and Scharr operators.
SOBEL = {
    3: ((-1.0, 0.0, 1.0), (1.0, 2.0, 1.0)),
    5: ((-1.0, -2.0, 0.0, 2.0, 1.0), (1.0, 4.0, 6.0, 4.0, 1.0)),
    7: ((-1.0, -4.0, -5.0, 0.0, 5.0, 4.0, 1.0), (1.0, 6.0, 15.0, 20.0, 15.0, 6.0, 1.0)),
}
SCHARR = ((-1.0, 0.0, 1.0), (3.0, 10.0, 3.0))
LAPLACE = ((0.0, 1.0, 0.0), (1.0, -4.0, 1.0), (0.0, 1.0, 0.0))
DIRECTION_BINS = 16
NOISE = 1e-9


def outer(column: Sequence[float], line: Sequence[float]) -> list[list[float]]:
    return [[c * v for v in line] for c in column]


def gradients(strips: DataFrame, column: str = "gray", mask: str | None = None) -> DataFrame:
    """Per pixel derivatives ``gx_*, gy_*`` for Sobel 3/5/7 and Scharr, and ``laplace``.

    All operators share one neighbourhood of three lines above and below, so the
    picture is shuffled once. Neighbourhoods cross to numpy in Arrow batches, as a loop
    over array expressions is interpreted pixel by pixel.
    """
    k = 3
    keep = [mask] if mask else []
    pairs = {f"k{size}": taps for size, taps in SOBEL.items()} | {"scharr": SCHARR}
    near = with_neighbours(strips, [column], k, k, keep=keep).select("image_id", "y", "width", column, *keep)
    names = [f"g{axis}_{name}" for name in pairs for axis in "xy"]
    fields = near.schema
    schema = T.StructType([fields["image_id"], fields["y"], T.StructField("x", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in (*names, "laplace")]])

    def derive(cube: np.ndarray) -> list[np.ndarray]:
        w = cube.shape[2] - 2 * k
        down = lambda taps: _total([(t, cube[:, k - len(taps) // 2 + j]) for j, t in enumerate(taps)])
        along = lambda line, taps: _total([(t, line[:, k - len(taps) // 2 + i :][:, :w]) for i, t in enumerate(taps)])
        out = []
        for deriv, smooth in pairs.values():
            out += [along(down(smooth), deriv), along(down(deriv), smooth)]
        # Sums of the same terms in another order differ in the last digits only; without a
        # noise floor the direction of a flat spot would be that of its rounding errors.
        for values in out:
            values[np.abs(values) < NOISE] = 0.0
        taps = [(t, cube[:, k + j - 1, k + i - 1 : k + i - 1 + w]) for j, row in enumerate(LAPLACE) for i, t in enumerate(row)]
        return [*out, _total(taps)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids, y, wide = one.column("image_id"), one.column("y").to_numpy(), one.column("width").to_numpy().astype(np.int64)
                if mask:
                    inner = np.concatenate([[0], np.cumsum(_lengths(one.column(mask)))])
                    on = pc.fill_null(one.column(mask).flatten(), False).to_numpy(zero_copy_only=False)
                for rows, cube in _cubes(one.column(column), wide, k):
                    w = cube.shape[2] - 2 * k
                    x = np.arange(w)
                    taken = on[inner[rows][:, None] + x] if mask else np.ones((len(rows), w), bool)
                    line, x = np.nonzero(taken)
                    values = [pa.array(v[taken], from_pandas=True) for v in derive(cube)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows[line])), pa.array(y[rows[line]]), pa.array(x.astype(np.int32)), *values], names=schema.names
                    )

    return near.mapInArrow(work, schema)


def gradient_statistics(grads: DataFrame) -> DataFrame:
    """Magnitude and direction statistics per Sobel size, with a 16-bin direction density."""
    rows = F.array(
        *[F.struct(F.lit(k).alias("ksize"), F.col(f"gx_k{k}").alias("gx"), F.col(f"gy_k{k}").alias("gy")) for k in SOBEL]
    )
    long = grads.select("image_id", F.inline(rows)).select(
        "image_id", "ksize", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag"),
        F.atan2("gy", "gx").alias("dir"),
    )
    bin_ = F.least(F.floor((F.col("dir") + math.pi) / (2 * math.pi) * DIRECTION_BINS), F.lit(DIRECTION_BINS - 1))
    long = long.withColumn("bin", bin_.cast("int"))
    width = 2 * math.pi / DIRECTION_BINS
    return long.groupBy("image_id", "ksize").agg(
        F.avg("mag").alias("mag_mean"),
        F.stddev_pop("mag").alias("mag_std"),
        F.max("mag").alias("mag_max"),
        F.sum(F.col("mag") * F.col("mag")).alias("mag_energy"),
        F.avg("dir").alias("dir_mean"),
        F.stddev_pop("dir").alias("dir_std"),
        *[
            (F.count_if(F.col("bin") == i) / (F.count("*") * F.lit(width))).alias(f"dir_hist_{i}")
            for i in range(DIRECTION_BINS)
        ],
    )


def laplacian_statistics(grads: DataFrame) -> DataFrame:
    return grads.groupBy("image_id").agg(
        F.avg(F.abs("laplace")).alias("laplacian_mean"),
        F.stddev_pop("laplace").alias("laplacian_std"),
        F.max(F.abs("laplace")).alias("laplacian_max"),
    )


def scharr_statistics(grads: DataFrame) -> DataFrame:
    mag = F.sqrt(F.col("gx_scharr") * F.col("gx_scharr") + F.col("gy_scharr") * F.col("gy_scharr"))
    return grads.select("image_id", mag.alias("mag")).groupBy("image_id").agg(
        F.avg("mag").alias("scharr_mean"),
        F.stddev_pop("mag").alias("scharr_std"),
        F.sum(F.col("mag") * F.col("mag")).alias("scharr_energy"),
    )


# --- wavelets --------------------------------------------------------------------------------

# Low-pass decomposition filters.
LOW_PASS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db2": (-0.12940952255092145, 0.22414386804185735, 0.836516303737469, 0.48296291314469025),
    "coif1": (
        -0.01565572813546454, -0.0727326195128539, 0.38486484686420286,
        0.8525720202122554, 0.3378976624578092, -0.0727326195128539,
    ),
}
# Families whose filters equal another's.
SAME_FILTERS = {"haar": ("haar", "db1"), "db2": ("db2", "sym2"), "coif1": ("coif1",)}


def high_pass(low: Sequence[float]) -> list[float]:
    n = len(low)
    return [(-1.0) ** (k + 1) * low[n - 1 - k] for k in range(n)]


def _mirror_half(pos: np.ndarray, size: int) -> np.ndarray:
    """Symmetric extension that repeats the border sample, any number of times."""
    turn = pos % (size * 2)
    return np.where(turn < size, turn, size * 2 - 1 - turn)


def _filter_across(one: pa.RecordBatch, column: str, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Some lines filtered along x, one row for each output line that needs them."""
    family = np.asarray(one.column("family").to_pylist())
    y, height, wide = (one.column(c).to_numpy().astype(np.int64) for c in ("y", "height", "width"))
    lengths = _lengths(one.column(column))
    start = np.cumsum(lengths) - lengths
    flat = np.append(_flat(one.column(column)), np.nan)
    for f, low in LOW_PASS.items():
        n, high = len(low), high_pass(low)
        for w in np.unique(wide[family == f]):
            rows = np.flatnonzero((family == f) & (wide == w))
            k = np.arange((w + n - 1) // 2)
            at = start[rows][:, None] + np.arange(w)
            line = flat[np.where(np.arange(w) < lengths[rows][:, None], at, len(flat) - 1)]
            under = [line[:, _mirror_half(k * 2 + 1 - j, w)] for j in range(n)]
            a, d = (sum((t * v for t, v in zip(taps, under)), 0.0) for taps in (low, high))
            # Which output lines need a line, and with which tap: the mirrored copies of the
            # line number, then every tap of matching parity.
            h = height[rows]
            for copy in [v + h * (2 * m) for m in range(-3, 4) for v in (y[rows], -y[rows] - 1)]:
                for j in range(n):
                    to = (copy + j - 1) // 2
                    sent = np.flatnonzero((copy > -n) & (copy < h + n) & ((copy + j - 1) % 2 == 0) & (to >= 0) & (to < (h + n - 1) // 2))
                    if len(sent):
                        of = pa.array(rows[sent])
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[one.column(c).take(of) for c in ("image_id", "family", "height", "width")],
                                pa.array(to[sent].astype(np.int32)), pa.array(np.full(len(sent), j, np.int32)),
                                *[_lists(v[sent].ravel(), np.full(len(sent), len(k)), pa.nulls(0)) for v in (a, d)],
                            ],
                            names=names,
                        )


def _filter_down(one: pa.RecordBatch, names: Sequence[str]) -> pa.RecordBatch:
    """The four bands of some output lines from the filtered lines under them."""
    family = np.asarray(one.column("family").to_pylist())
    height, width = (one.column(c).to_numpy().astype(np.int64) for c in ("height", "width"))
    taps = np.array([len(LOW_PASS[f]) for f in family], dtype=np.int64)
    out_h, out_w = (height + taps - 1) // 2, (width + taps - 1) // 2
    under = one.column("under").flatten()
    row = np.repeat(np.arange(one.num_rows), _lengths(one.column("under")))
    tap = np.asarray(under.field(0))
    flat = [_flat(under.field(i)) for i in (1, 2)]
    lengths = _lengths(under.field(1))
    start = np.cumsum(lengths) - lengths
    ends = np.cumsum(out_w)
    bands = np.empty((4, int(out_w.sum())))
    for f, low in LOW_PASS.items():
        high = high_pass(low)
        for w in np.unique(out_w[family == f]):
            rows = np.flatnonzero((family == f) & (out_w == w))
            back = np.full(one.num_rows, -1)
            back[rows] = np.arange(len(rows))
            mine = np.flatnonzero(back[row] >= 0)
            cubes = []
            for values in flat:
                # Lines that a picture lacks count as none.
                cube = np.zeros((len(low), len(rows), w))
                cube[tap[mine], back[row[mine]]] = values[start[mine][:, None] + np.arange(w)]
                cubes.append(cube)
            place = (ends - out_w)[rows][:, None] + np.arange(w)
            for band, (cube, by) in enumerate([(cubes[0], low), (cubes[0], high), (cubes[1], low), (cubes[1], high)]):
                bands[band][place] = sum((t * v for t, v in zip(by, cube)), 0.0)
    return pa.RecordBatch.from_arrays(
        [
            *[one.column(c) for c in ("image_id", "family", "y")], pa.array(out_h.astype(np.int32)), pa.array(out_w.astype(np.int32)),
            *[_lists(v, out_w, pa.nulls(0)) for v in bands],
        ],
        names=names,
    )


def wavelet_step(strips: DataFrame, column: str) -> DataFrame:
    """One 2-D step for every family: strips with ``aa, da, ad, dd`` of half the size.

    The first letter is the vertical filter. ``strips`` needs ``family``; lines under
    one output line are at most as many as the filter is long. Lines are filtered in
    numpy, in Arrow batches, as nested array expressions are interpreted value by value.
    """
    id_type = strips.schema["image_id"].dataType.simpleString()
    head = f"image_id {id_type}, family string"
    sent_names = ["image_id", "family", "height", "width", "y", "j", "a", "d"]
    done_names = ["image_id", "family", "y", "height", "width", "aa", "da", "ad", "dd"]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in _slices([batch], column):
                yield from _filter_across(one, column, sent_names)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                yield _filter_down(batch.slice(i, 512), done_names)

    sent = strips.select(*raster.KEYS, "family", column).mapInArrow(across, f"{head}, height int, width int, y int, j int, a array<double>, d array<double>")
    lines = sent.groupBy("image_id", "family", "y").agg(
        F.first("height").alias("height"), F.first("width").alias("width"),
        F.collect_list(F.struct("j", "a", "d")).alias("under"),
    )
    return lines.mapInArrow(down, f"{head}, y int, height int, width int, aa array<double>, da array<double>, ad array<double>, dd array<double>")


def wavelet_coefficients(strips: DataFrame, column: str = "gray", levels: int = 3) -> DataFrame:
    """Coefficients ``(image_id, family, band, level, c)`` as strips.

    ``level`` 0 is the approximation, 1 the coarsest detail.
    """
    families = F.array(*[F.lit(f) for f in LOW_PASS])
    current = strips.select(
        "image_id", "y", "height", "width", F.col(column).alias("aa"), F.explode(families).alias("family")
    )
    out = None
    bands = {"horizontal": "da", "vertical": "ad", "diagonal": "dd"}
    for step in range(levels):
        # Written per level: the bands of this level and the next level both read it.
        done = cut(wavelet_step(current, "aa"))
        rows = [
            F.struct(F.lit(b).alias("band"), F.lit(levels - step).alias("level"), F.col(c).alias("c"))
            for b, c in bands.items()
        ]
        if step == levels - 1:
            rows.append(F.struct(F.lit("approx").alias("band"), F.lit(0).alias("level"), F.col("aa").alias("c")))
        detail = done.select("image_id", "family", F.inline(F.array(*rows)))
        out = detail if out is None else out.unionByName(detail)
        current = done.select("image_id", "family", "y", "height", "width", "aa")
    return out


def wavelet_statistics(coefficients: DataFrame) -> DataFrame:
    """Mean magnitude, spread, energy, entropy, largest magnitude and shape of each band."""
    keys = ("image_id", "family", "band", "level")
    flat = coefficients.select(*keys, F.explode("c").alias("c"))
    c, c2 = F.col("c"), F.col("c") * F.col("c")
    found = flat.groupBy(*keys).agg(
        F.avg(F.abs(c)).alias("mean"),
        F.stddev_pop(c).alias("std"),
        F.sum(c2).alias("energy"),
        F.sum(-c2 * F.log2(c2 + 1e-10)).alias("entropy"),
        F.max(F.abs(c)).alias("max"),
        F.skewness(c).alias("skew"),
        (F.kurtosis(c) + 3.0).alias("kurt"),
    )
    std3, std4 = F.pow("std", F.lit(3.0)), F.pow("std", F.lit(4.0))
    flat_zero = lambda v: F.when(F.col("std") == 0, F.lit(0.0)).otherwise(v)
    return found.select(
        *keys, "mean", "std", "energy", "entropy", "max",
        flat_zero(F.col("kurt") * std4 / (std4 + 1e-10)).alias("kurtosis"),
        flat_zero(F.col("skew") * std3 / (std3 + 1e-10)).alias("skewness"),
    )


# --- edges -----------------------------------------------------------------------------------

# Fixed values.
EDGE_THRESHOLDS = (50, 100, 150)
# Tangent of 22.5 degrees in 15-bit fixed point.
_TAN_22 = 13573
WEAK, STRONG = 1, 2


def edge_candidates(strips: DataFrame, column: str = "gray", mask: str | None = None) -> DataFrame:
    """Strips with ``class_<t>``: 0 none, 1 weak, 2 strong, after thinning ridges.

    A pixel is a ridge if its gradient magnitude (sum of both absolute derivatives) is
    not below that of its two neighbours across the edge. Weak starts at half of t.
    """
    keep = [mask] if mask else []
    bytes_ = strips.withColumn(column, F.transform(column, lambda v: F.floor(v * 255.0).cast("int")))
    near = with_neighbours(bytes_, [column], 1, 1, border="nearest", keep=keep)
    deriv, smooth = SOBEL[3]
    width = F.col("width")
    tall = near.select(
        *raster.KEYS, *keep,
        vertical_pass(F.col(column), smooth, width + 2).alias("s"),
        vertical_pass(F.col(column), deriv, width + 2).alias("d"),
    )
    both = tall.select(
        *raster.KEYS, *keep,
        horizontal_pass(F.col("s"), deriv, width).alias("dx"),
        horizontal_pass(F.col("d"), smooth, width).alias("dy"),
    ).withColumn("mag", F.zip_with("dx", "dy", lambda a, b: F.abs(a) + F.abs(b)))
    ring = with_neighbours(both, ["mag"], 1, 1, border="zero", keep=["dx", "dy", *keep])
    at = lambda x, dy, dx: F.get(F.get(F.col("mag"), F.lit(1 + dy)), x + (1 + dx))

    def ridge(s: Column, x: Column) -> Column:
        m = at(x, 0, 0)
        across, down = F.abs(s["dx"]), F.abs(s["dy"]) * 32768
        flat = across * _TAN_22
        steep = flat + across * 65536
        beside = (m > at(x, 0, -1)) & (m >= at(x, 0, 1))
        above = (m > at(x, -1, 0)) & (m >= at(x, 1, 0))
        falling = (m > at(x, -1, 1)) & (m > at(x, 1, -1))
        rising = (m > at(x, -1, -1)) & (m > at(x, 1, 1))
        opposite = (s["dx"] < 0) != (s["dy"] < 0)
        peak = F.when(down < flat, beside).when(down > steep, above).when(opposite, falling).otherwise(rising)
        return F.when(peak, m).otherwise(F.lit(0.0))

    lines = ring.withColumn("ridge", F.transform(F.arrays_zip("dx", "dy"), ridge))
    graded = lambda t: F.transform(
        "ridge", lambda m: F.when(m > t, STRONG).when(m > t // 2, WEAK).otherwise(0)
    )
    return lines.select(*raster.KEYS, *keep, *[graded(t).alias(f"class_{t}") for t in EDGE_THRESHOLDS])


def edge_ratios(strips: DataFrame, column: str = "gray", mask: str | None = None) -> DataFrame:
    """``canny_edge_ratio_t*``: edge pixels over mask pixels for each threshold.

    An edge is a connected stretch of candidates with at least one strong pixel. All
    thresholds go through one labelling, as separate pictures.
    """
    inside = F.size(F.filter(mask, lambda m: m)) if mask else F.col("width")
    size = strips.groupBy("image_id").agg(F.sum(inside).alias("size"))
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"class_{t}").alias("class")) for t in EDGE_THRESHOLDS])
    graded = cut(edge_candidates(strips, column, mask).select(*raster.KEYS, F.inline(cells)))
    graded = graded.withColumn("image_id", F.concat_ws("#", F.col("image_id").cast("string"), "t")).drop("t")
    marked = graded.withColumn("edge", F.transform("class", lambda c: c > 0))
    runs = label_regions(marked.drop("class"), "edge")
    held = runs.join(graded.select("image_id", "y", "class"), ["image_id", "y"]).select(
        "image_id", "region", (F.col("x1") - F.col("x0") + 1).alias("n"),
        F.array_max(F.slice("class", F.col("x0") + 1, F.col("x1") - F.col("x0") + 1)).alias("top"),
    )
    edges = held.groupBy("image_id", "region").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(
        F.col("top") == STRONG
    )
    of, t = F.regexp_extract("image_id", "^(.*)#", 1), F.regexp_extract("image_id", "#([0-9]+)$", 1).cast("int")
    found = edges.groupBy(of.alias("_of")).agg(
        *[F.sum(F.when(t == v, F.col("n")).otherwise(0)).alias(f"n_{v}") for v in EDGE_THRESHOLDS]
    )
    size = size.withColumn("_of", F.col("image_id").cast("string"))
    return size.join(found, "_of", "left").select(
        "image_id",
        *[(F.coalesce(f"n_{t}", F.lit(0)) / F.col("size")).alias(f"canny_edge_ratio_t{t}") for t in EDGE_THRESHOLDS],
    )
