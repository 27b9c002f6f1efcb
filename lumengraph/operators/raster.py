"""Pixel tables: strips, neighbourhoods, convolution and resampling.

A strip is one image line: ``image_id, y, height, width`` and one array per
channel. Horizontal neighbours are found by array index. Vertical neighbours come
from windows over (image, block of lines); the few lines around a block are
copied into it, so an image is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions import colour
from lumengraph.session import cut

KEYS = ("image_id", "y", "height", "width")
CHANNELS = ("r", "g", "b")
ArrowStep = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


# --- strips ---------------------------------------------------------------------------------


def to_strips(images: DataFrame) -> DataFrame:
    """Byte rows of ``struct image(height, width, nChannels, data)`` as strips.

    The source stores blue first. One channel is copied to three, a fourth (alpha)
    is dropped. Spark has no expression that turns a binary into numbers without a
    string per byte, so the bytes cross to numpy in Arrow batches, once.
    """
    raw = images.select("image_id", "image.height", "image.width", "image.nChannels", "image.data").where(
        "height > 0 AND width > 0"
    )
    id_type = raw.schema["image_id"].dataType.simpleString()
    schema = f"image_id {id_type}, y int, height int, width int, r array<int>, g array<int>, b array<int>"
    return raw.mapInArrow(_decode_batches, schema)


_LINES_PER_BATCH = 4096


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("image_id")
        for i in range(batch.num_rows):
            h, w, c = (batch.column(n)[i].as_py() for n in ("height", "width", "nChannels"))
            flat = np.frombuffer(batch.column("data")[i].as_buffer(), dtype=np.uint8, count=h * w * c)
            cube = flat.reshape(h, w, c)
            planes = [cube[:, :, k] for k in ((0, 0, 0) if c == 1 else (2, 1, 0))]
            for top in range(0, h, _LINES_PER_BATCH):
                n = min(_LINES_PER_BATCH, h - top)
                offsets = pa.array(np.arange(0, n * w + 1, w, dtype=np.int32))
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(p[top : top + n].astype(np.int32).ravel()))
                    for p in planes
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([i] * n)),
                        pa.array(np.arange(top, top + n, dtype=np.int32)),
                        pa.array(np.full(n, h, dtype=np.int32)),
                        pa.array(np.full(n, w, dtype=np.int32)),
                        *lists,
                    ],
                    names=[*KEYS, *CHANNELS],
                )


def pixels(strips: DataFrame, channels: Sequence[str] = CHANNELS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per pixel: ``image_id, y, x`` and the channels."""
    spread = strips.select(
        "image_id", "y", *keep, *channels, F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x")
    )
    return spread.select("image_id", "y", "x", *keep, *[F.col(c)[F.col("x")].alias(c) for c in channels])


def map_strips(strips: DataFrame, name: str, fn, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Add an array column holding ``fn(*channel values)`` for each pixel of the line.

    The channels go in as the argument of the loop, not as captured columns: Catalyst
    may inline a captured array and would then rebuild it for each pixel.
    """
    return strips.withColumn(name, F.transform(F.arrays_zip(*channels), lambda s: fn(*[s[c] for c in channels])))


def gray_strips(strips: DataFrame, masked: bool = False) -> DataFrame:
    """Strips with ``gray`` in [0, 1] (BT.709), 0 outside ``mask`` when asked."""
    out = map_strips(strips, "gray", lambda r, g, b: colour.gray(r / 255.0, g / 255.0, b / 255.0))
    if masked:
        out = apply_mask(out, "gray")
    return out


def apply_mask(strips: DataFrame, column: str, mask: str = "mask") -> DataFrame:
    """Set a channel to 0 outside the mask."""
    return strips.withColumn(
        column, F.zip_with(column, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0).cast("double")))
    )


def channel_profile(strips: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Smallest and largest value of each channel; lines are reduced before the shuffle."""
    return strips.groupBy("image_id").agg(
        *[F.min(F.array_min(c)).alias(f"{c}_min") for c in channels],
        *[F.max(F.array_max(c)).alias(f"{c}_max") for c in channels],
    )


# --- neighbourhoods --------------------------------------------------------------------------


def _pad_line(values: Column, width: Column, k: int, border: str) -> Column:
    if k == 0 or border == "none":
        return values
    if border == "reflect101":
        left, right = F.slice(values, 2, k), F.slice(values, width - k, k)
        return F.concat(F.reverse(left), values, F.reverse(right))
    if border == "symmetric":
        left, right = F.slice(values, 1, k), F.slice(values, width - k + 1, k)
        return F.concat(F.reverse(left), values, F.reverse(right))
    if border == "nearest":
        left, right = F.get(values, F.lit(0)), F.get(values, width - 1)
        return F.concat(F.array_repeat(left, k), values, F.array_repeat(right, k))
    if border == "zero":
        zeros = F.array_repeat(F.get(values, F.lit(0)) * 0, k)
        return F.concat(zeros, values, zeros)
    raise ValueError(f"unknown border {border!r}")


def _virtual_lines(above: int, below: int, border: str) -> Column:
    """Every line number, real or outside the image, that a line stands for."""
    y, h = F.col("y"), F.col("height")
    own = F.array(y)
    if border == "reflect101":
        top = F.when((y >= 1) & (y <= above), F.array(-y))
        bottom = F.when((y >= h - 1 - below) & (y <= h - 2), F.array((h - 1) * 2 - y))
    elif border == "symmetric":
        top = F.when(y < above, F.array(-y - 1))
        bottom = F.when(y >= h - below, F.array(h * 2 - 1 - y))
    elif border in ("nearest", "zero"):
        top = F.when(y == 0, F.array(*[F.lit(-i) for i in range(1, above + 1)])) if above else None
        bottom = F.when(y == h - 1, F.array(*[h - 1 + i for i in range(1, below + 1)])) if below else None
    elif border == "none":
        return own
    else:
        raise ValueError(f"unknown border {border!r}")
    none = F.array().cast("array<int>")
    extra = [F.coalesce(part, none) for part in (top, bottom) if part is not None]
    return F.concat(own, *extra)


def with_neighbours(
    strips: DataFrame,
    columns: Sequence[str],
    above: int,
    below: int,
    border: str = "reflect101",
    side: int | None = None,
    block: int = 64,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Replace each column by the list of its lines ``y-above .. y+below``.

    Lines are padded by ``side`` values left and right by the same border rule. A
    line travels to its own block and, near a block edge, to the next one too: the
    copying overhead is about ``(above + below) / block``. With ``border='none'``
    lines outside the image are missing from the list.
    """
    side = max(above, below) if side is None else side
    width = F.col("width")
    lines = strips.select(
        *KEYS,
        *keep,
        *[_pad_line(F.col(c), width, side, border).alias(c) for c in columns],
        F.explode(_virtual_lines(above, below, border)).alias("_line"),
    )
    if border == "zero":
        inside = F.col("_line") == F.col("y")
        for c in columns:
            lines = lines.withColumn(c, F.when(inside, F.col(c)).otherwise(F.transform(c, lambda v: v * 0)))
    first = F.greatest(F.lit(0), F.floor((F.col("_line") - below) / block).cast("int"))
    last = F.least(
        F.floor((F.col("height") - 1) / block).cast("int"), F.floor((F.col("_line") + above) / block).cast("int")
    )
    lines = lines.withColumn("_block", F.explode(F.sequence(first, last)))
    around = Window.partitionBy("image_id", "_block").orderBy("_line").rowsBetween(-above, below)
    lines = lines.select(
        "image_id", F.col("_line"), "_block", "height", "width", *keep,
        *[F.collect_list(c).over(around).alias(c) for c in columns],
    )
    home = (
        (F.col("_line") >= 0)
        & (F.col("_line") < F.col("height"))
        & (F.floor(F.col("_line") / block).cast("int") == F.col("_block"))
    )
    return lines.where(home).select("image_id", F.col("_line").alias("y"), "height", "width", *keep, *columns)


def weighted(terms: Sequence[tuple[float, Column]]) -> Column:
    """Sum of weight times column, leaving out zero weights."""
    total = None
    for weight, col in terms:
        if weight == 0:
            continue
        part = col if weight == 1 else col * float(weight)
        total = part if total is None else total + part
    return total if total is not None else F.lit(0.0)


def vertical_pass(lines: Column, weights: Sequence[float], length: Column) -> Column:
    """One line: the weighted sum of the lines of a neighbourhood."""
    return F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: weighted([(w, F.get(F.get(lines, F.lit(j)), i)) for j, w in enumerate(weights)]),
    )


def horizontal_pass(line: Column, weights: Sequence[float], width: Column) -> Column:
    """Weighted sum along a padded line."""
    return F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda x: weighted([(w, F.get(line, x + i)) for i, w in enumerate(weights)]),
    )


def convolve(
    strips: DataFrame, column: str, kernel: Sequence[Sequence[float]], border: str = "reflect101", name: str | None = None
) -> DataFrame:
    """Correlate a channel with an odd-sized kernel."""
    k = len(kernel) // 2
    near = with_neighbours(strips, [column], k, k, border)
    out = F.transform(
        F.sequence(F.lit(0), F.col("width") - 1),
        lambda x: weighted(
            [
                (w, F.get(F.get(F.col(column), F.lit(j)), x + i))
                for j, row in enumerate(kernel)
                for i, w in enumerate(row)
            ]
        ),
    )
    return near.select(*KEYS, out.alias(name or column))


def convolve_separable(
    strips: DataFrame,
    columns: Sequence[str],
    down: Sequence[float],
    across: Sequence[float],
    border: str = "reflect101",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Correlate channels with the outer product of two one-dimensional kernels."""
    k = len(down) // 2
    near = with_neighbours(strips, columns, k, k, border, keep=keep)
    tall = near.select(
        *KEYS, *keep, *[vertical_pass(F.col(c), down, F.col("width") + 2 * k).alias(c) for c in columns]
    )
    return tall.select(*KEYS, *keep, *[horizontal_pass(F.col(c), across, F.col("width")).alias(c) for c in columns])


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return [v / total for v in raw]


# 5-tap binomial blur.
BLUR_5 = (1.0, 4.0, 6.0, 4.0, 1.0)


def gaussian_blur5(strips: DataFrame, column: str) -> DataFrame:
    """The 5x5 binomial blur of a byte channel, rounded half up to bytes again.

    Sums are exact in whole numbers, so each line's five padded lines cross to numpy in
    Arrow batches; a loop over array expressions takes about ten times as long.
    """
    near = with_neighbours(strips, [column], 2, 2)
    weights = np.array(BLUR_5, dtype=np.int64)

    def blur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(column)
            wide = batch.column("width").to_numpy().astype(np.int64)
            # Lines of one width are one cube; its rows lie one after the other in the buffer.
            out = np.empty(int(wide.sum()), np.int32)
            ends = np.cumsum(wide)
            flat = lines.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum((wide + 4) * 5)])
            edges = np.flatnonzero(np.diff(wide, prepend=-1, append=-1))
            for first, last in zip(edges[:-1], edges[1:]):
                w = int(wide[first])
                cube = flat[starts[first] : starts[last]].reshape(last - first, 5, w + 4)
                tall = np.tensordot(cube, weights, (1, 0))
                sums = sum(weights[i] * tall[:, i : i + w] for i in range(5))
                out[ends[first] - w : ends[last - 1]] = ((sums + 128) >> 8).ravel()
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            blurred = pa.ListArray.from_arrays(offsets, pa.array(out))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in KEYS], blurred], names=[*KEYS, column])

    id_type = near.schema["image_id"].dataType.simpleString()
    return near.select(*KEYS, column).mapInArrow(blur, f"image_id {id_type}, y int, height int, width int, {column} array<int>")


# --- resampling ------------------------------------------------------------------------------

_FIXED = 1 << 22  # weights are rounded to 22 fractional bits, sums back to bytes


def _lanczos3(t: Column) -> Column:
    sinc = lambda v: F.when(v == 0, F.lit(1.0)).otherwise(F.sin(v * math.pi) / (v * math.pi))
    return F.when((t > -3.0) & (t < 3.0), sinc(t) * sinc(t / 3.0)).otherwise(F.lit(0.0))


def resample_weights(sizes: DataFrame, size_out: int) -> DataFrame:
    """Filter weights ``(size_in, i_out, first, weights)`` for each distinct input size.

    One row per output position and distinct size; the support grows with the
    shrinking factor, the weights of a position add up to one before rounding.
    """
    scale = F.col("size_in") / F.lit(float(size_out))
    grown = F.greatest(scale, F.lit(1.0))
    centre = (F.col("i_out") + 0.5) * scale
    first = F.greatest(F.lit(0), F.floor(centre - grown * 3.0 + 0.5).cast("int"))
    last = F.least(F.col("size_in"), F.floor(centre + grown * 3.0 + 0.5).cast("int")) - 1
    spread = (
        sizes.select(F.col("size_in").cast("int"))
        .distinct()
        .withColumn("i_out", F.explode(F.sequence(F.lit(0), F.lit(size_out - 1))))
        .withColumn("first", first)
        .withColumn(
            "raw",
            F.transform(F.sequence(first, last), lambda i: _lanczos3((i - centre + 0.5) / grown)),
        )
    )
    total = F.aggregate("raw", F.lit(0.0), lambda acc, v: acc + v)
    fixed = lambda v: F.floor(F.abs(v) * _FIXED + 0.5).cast("bigint") * F.signum(v).cast("bigint")
    return (
        spread.withColumn("total", total)
        .select("size_in", "i_out", "first", F.transform("raw", lambda v: fixed(v / F.col("total"))).alias("weights"))
    )


def _to_byte(total: Column) -> Column:
    value = F.shiftright(total + (_FIXED >> 1), 22)
    return F.greatest(F.lit(0), F.least(F.lit(255), value)).cast("int")


def resize(strips: DataFrame, width_out: int = 750, height_out: int = 750, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Lanczos-3 resampling to a fixed size; first along lines, then across them.

    The weights of a size are packed into one row per size (across: one per input
    line), so lines meet them by an equi-join on the size. The second step groups
    only the lines under one output line: their number is bounded by the filter
    support.
    """
    across = (
        resample_weights(strips.select(F.col("width").alias("size_in")), width_out)
        .groupBy("size_in")
        .agg(F.array_sort(F.collect_list(F.struct("i_out", "first", "weights"))).alias("plan"))
        .withColumnRenamed("size_in", "width")
    )

    def dot(line: Column) -> Column:
        return F.transform(
            "plan",
            lambda p: _to_byte(
                F.aggregate(
                    F.transform(p["weights"], lambda w, k: w * F.get(line, p["first"] + k)),
                    F.lit(0).cast("bigint"),
                    lambda acc, v: acc + v,
                )
            ),
        )

    wide = strips.join(across, "width").select(
        "image_id", "y", "height", *[dot(F.col(c)).alias(c) for c in channels]
    )
    down = resample_weights(strips.select(F.col("height").alias("size_in")), height_out)
    down = (
        down.select("size_in", "i_out", F.posexplode("weights").alias("k", "weight"), "first")
        .select("size_in", (F.col("first") + F.col("k")).alias("y"), "i_out", "weight")
        .where("weight <> 0")
        .groupBy("size_in", "y")
        .agg(F.collect_list(F.struct("i_out", "weight")).alias("targets"))
        .withColumnRenamed("size_in", "height")
    )
    parts = wide.join(down, ["height", "y"]).select("image_id", F.explode("targets").alias("t"), *channels)
    gathered = parts.groupBy("image_id", F.col("t.i_out").alias("y")).agg(
        F.collect_list(F.struct(F.col("t.weight").alias("weight"), *channels)).alias("lines")
    )

    def column_sum(channel: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(width_out - 1)),
            lambda x: _to_byte(
                F.aggregate(
                    "lines", F.lit(0).cast("bigint"), lambda acc, s: acc + s["weight"] * F.get(s[channel], x)
                )
            ),
        )

    return gathered.select(
        "image_id",
        "y",
        F.lit(height_out).alias("height"),
        F.lit(width_out).alias("width"),
        *[column_sum(c).alias(c) for c in channels],
    )


# --- contrast-limited adaptive equalisation ----------------------------------------------------

_GRAYS = 1 << 14  # working gray levels
_BINS = 256


def leveled(hist: np.ndarray, limit: int) -> np.ndarray:
    """The histogram cut off at ``limit``, its surplus spread evenly over the bins below.

    All bins rise by the same count, each as far as its room goes. The remainder, fewer than
    the bins that still have room, goes to bins at even ranks among those, one each. What
    finds no room at all is lost.
    """
    return _leveled_rows(hist[None, :], np.array([limit]))[0]


def _leveled_rows(hist: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """``leveled`` for the rows of a matrix, each with a limit."""
    kept = np.minimum(hist, limit[:, None])
    surplus, room = (hist - kept).sum(axis=1), limit[:, None] - kept
    rising = np.sort(room, axis=1)
    n = rising.shape[1]
    # Cost of a rise by the k-th smallest room: smaller ones are full, all others rise as far.
    before = np.cumsum(rising, axis=1) - rising
    full = (before + rising * np.arange(n, 0, -1) <= surplus[:, None]).sum(axis=1)
    spent = np.append(before, rising.sum(axis=1)[:, None], axis=1)[np.arange(len(full)), full]
    rise = np.where(full == n, rising[:, -1], (surplus - spent) // np.maximum(n - full, 1))
    risen = np.minimum(room, rise[:, None])
    rest = np.where(full == n, 0, surplus - risen.sum(axis=1))[:, None]
    has_room = room > rise[:, None]
    rank, spare = np.cumsum(has_room, axis=1) - 1, np.maximum(has_room.sum(axis=1), 1)[:, None]
    # the rank that the i-th of the rest goes to is i * spare // rest
    nth = -(-rank * rest // spare)
    chosen = has_room & (nth < rest) & (nth * spare // np.maximum(rest, 1) == rank)
    return kept + risen + chosen


def _flat(batch: pa.RecordBatch, names: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lines of a batch, and the values of all lines in a row for each name."""
    columns = [batch.column(c) for c in names]
    return columns[0].value_lengths().to_numpy(), [c.flatten().to_numpy(zero_copy_only=False) for c in columns]


def _lines(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values of all lines in a row as an array for each line."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _pixel_places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line of each pixel and its place in it."""
    line = np.repeat(np.arange(len(lengths)), lengths)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _reach(channels: Sequence[str]) -> ArrowStep:
    """The least and greatest of the brightest channel's values in each line."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, values = _flat(batch, channels)
            some = np.flatnonzero(lengths)
            if len(some):
                top, begin = np.maximum.reduce(values), (np.cumsum(lengths) - lengths)[some]
                ends = [pa.array(edge.reduceat(top, begin).astype(np.float64)) for edge in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(some)), *ends], ["image_id", "lo", "hi"])

    return step


def _gray_bins(batch: pa.RecordBatch, channels: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines and places of all pixels, and the bins of their gray between the darkest and brightest value of the picture."""
    lengths, values = _flat(batch, channels)
    top = np.maximum.reduce(values)
    line, x = _pixel_places(lengths)
    lo, hi = (batch.column(c).to_numpy() / 255.0 for c in ("lo", "hi"))
    span = (hi - lo)[line]
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where(span == 0, 0.0, (top / 255.0 - lo[line]) / span * float(_GRAYS - 1))
    return line, x, np.floor(np.rint(level) / float(1 + _GRAYS // _BINS)).astype(np.int64)


_CELLS = "height int, width int, ty int, tx int, bin int, n int"


def _count_cells(channels: Sequence[str]) -> ArrowStep:
    """Pixels of each (size, tile row, tile column, bin) of a batch's pictures.

    Tiles also cover a mirrored margin on the right and below when sizes do not divide.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            line, x, bins = _gray_bins(batch, channels)
            y, height, width = (batch.column(c).to_numpy().astype(np.int64) for c in ("y", "height", "width"))
            th, tw = np.maximum(height // 8, 1), np.maximum(width // 8, 1)
            image = pc.dictionary_encode(batch.column("image_id"), null_encoding="encode").indices.to_numpy()
            _, first, picture = np.unique(np.stack([image, height, width], axis=1), axis=0, return_index=True, return_inverse=True)
            mirrored = lambda at, size, step: (size * 2 - 2 - at < -(-size // step) * step) & (at < size - 1)
            keys = []
            for lines, my in ((np.ones(len(y), bool), y), (mirrored(y, height, th), height * 2 - 2 - y)):
                for over, mx in ((np.ones(len(x), bool), x), (mirrored(x, width[line], tw[line]), width[line] * 2 - 2 - x)):
                    px = np.flatnonzero(over & lines[line])
                    at = line[px]
                    ty, tx = my[at] // th[at], mx[px] // tw[at]
                    keys.append(((picture.ravel()[at] * 64 + ty) * 64 + tx) * _BINS + bins[px])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            own = first[key // (64 * 64 * _BINS)]
            numbers = [height[own], width[own], key // (64 * _BINS) % 64, key // _BINS % 64, key % _BINS, n]
            columns = [batch.column("image_id").take(pa.array(own)), *[pa.array(v.astype(np.int32)) for v in numbers]]
            yield pa.RecordBatch.from_arrays(columns, ["image_id", *[f.split()[0] for f in _CELLS.split(", ")]])

    return step


def _tile_curves(clip: float) -> ArrowStep:
    """Gray curves of tiles from their (at most 256) histogram cells, two bytes a gray."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, (bins, counts) = _flat(batch, ["bins", "counts"])
            hist = np.zeros((batch.num_rows, _BINS), np.int64)
            hist[np.repeat(np.arange(batch.num_rows), lengths), bins] = counts
            pixels = batch.column("area").to_numpy().astype(np.int64)
            below = np.cumsum(_leveled_rows(hist, np.maximum((clip * pixels).astype(np.int64), 1)), axis=1)
            curve = np.minimum(below * ((_GRAYS - 1) / pixels)[:, None], _GRAYS - 1).astype("<u2")
            kept = [batch.column(c) for c in ("image_id", "n_ty", "ty", "tx")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes() for c in curve], pa.binary())], ["image_id", "n_ty", "ty", "tx", "curve"])

    return step


def _blended(channels: Sequence[str]) -> ArrowStep:
    """Each pixel's gray from the curves of the four tiles around it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("curves0").null_count:
                batch = batch.filter(pc.is_valid(batch.column("curves0")))
            for at in range(0, batch.num_rows, _LINES_PER_BATCH):
                part = batch.slice(at, _LINES_PER_BATCH)
                line, x, bins = _gray_bins(part, channels)
                y, height, width = (part.column(c).to_numpy().astype(np.int64) for c in ("y", "height", "width"))
                th, tw = np.maximum(height // 8, 1), np.maximum(width // 8, 1)
                fy = ((y + th // 2) % th / th)[line]
                pos, step_x = x + (tw // 2)[line], tw[line]
                px, fx = pos // step_x, pos % step_x / step_x
                grays, begin = [], []
                for c in ("curves0", "curves1"):
                    curves = part.column(c)
                    n = curves.value_lengths().to_numpy()
                    grays.append(np.frombuffer(b"".join(curves.flatten().to_pylist()), "<u2").astype(np.int64))
                    begin.append((np.cumsum(n) - n)[line])
                left, right = np.maximum(px - 1, 0), np.minimum(px, n[line] - 1)
                pick = lambda side, tile: grays[side][(begin[side] + tile) * _BINS + bins]  # noqa: B023, E731
                eq = np.floor(
                    pick(0, left) * ((1 - fy) * (1 - fx)) + pick(0, right) * ((1 - fy) * fx)
                    + pick(1, left) * (fy * (1 - fx)) + pick(1, right) * (fy * fx)
                )
                lengths, kept = part.column(channels[0]).value_lengths().to_numpy(), [*KEYS, *channels]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], _lines(lengths, eq.astype(np.int64), pa.int64())], [*kept, "eq"])

    return step


def _recoloured(channels: Sequence[str]) -> ArrowStep:
    """Value replaced, hue and saturation kept."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, (eq, *colours) = _flat(batch, ["eq", *channels])
            top = np.maximum.reduce(colours)
            line, _ = _pixel_places(lengths)
            lo, hi = (batch.column(c).to_numpy()[line] for c in ("eq_lo", "eq_hi"))
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(hi == lo, 0.0, (eq - lo) / (hi - lo))
                out = [np.where(top == 0, value, value * c / top) for c in colours]
            columns = [*[batch.column(c) for c in KEYS], *[_lines(lengths, v, pa.float64()) for v in out]]
            yield pa.RecordBatch.from_arrays(columns, [*KEYS, *channels])

    return step


def equalize_adaptive(strips: DataFrame, clip_limit: float = 0.03, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation of the HSV value channel.

    Output channels are doubles in [0, 1]. The image is cut into tiles of an eighth
    of its size; a tile histogram is clipped, its surplus spread over the bins, and
    its running share becomes a gray curve. A pixel blends the curves of the four
    tiles around it.

    The hints keep curves and pictures off the driver: before they are made, the planner takes
    them for as small as the table the pictures are made from, and would broadcast them.
    """
    id_type, kinds = strips.schema["image_id"].dataType.simpleString(), [f"{c} {strips.schema[c].dataType.simpleString()}" for c in channels]
    keys = ", ".join(f"{c} {strips.schema[c].dataType.simpleString()}" for c in KEYS)
    work = strips.select(*KEYS, *channels)
    reach = work.select("image_id", *channels).mapInArrow(_reach(channels), f"image_id {id_type}, lo double, hi double")
    reach = reach.groupBy("image_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    work = work.join(reach.hint("merge"), "image_id")
    th, tw = (F.greatest(F.floor(F.col(n) / 8).cast("int"), F.lit(1)) for n in ("height", "width"))
    cells = (
        work.mapInArrow(_count_cells(channels), f"image_id {id_type}, {_CELLS}")
        .groupBy("image_id", th.alias("th"), tw.alias("tw"), F.ceil(F.col("height") / th).cast("int").alias("n_ty"), "ty", "tx", "bin")
        .agg(F.sum("n").cast("int").alias("n"))
    )
    tiles = cells.groupBy("image_id", "th", "tw", "n_ty", "ty", "tx").agg(
        F.collect_list("bin").alias("bins"), F.collect_list("n").alias("counts")
    )
    tiles = tiles.select("image_id", "n_ty", "ty", "tx", (F.col("th") * F.col("tw")).alias("area"), "bins", "counts")
    curves = tiles.mapInArrow(_tile_curves(float(clip_limit)), f"image_id {id_type}, n_ty int, ty int, tx int, curve binary")
    # Each line blends two tile rows, known to it by one number ``py``: the rows py - 1 and py, within
    # the picture. The curves of a tile row are one array.
    ty, use = F.col("ty"), lambda py, side: F.struct(py.alias("py"), F.lit(side).alias("side"))
    uses = F.filter(
        F.array(
            use(ty + 1, 0), use(ty, 1),
            F.when(ty == 0, use(ty, 0)), F.when(ty == F.col("n_ty") - 1, use(ty + 1, 1)),
        ),
        lambda u: u.isNotNull(),
    )
    used = curves.select("image_id", "tx", "curve", F.inline(uses))
    of = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("tx", "curve")))), lambda s: s["curve"])
    pairs = used.groupBy("image_id", "py").agg(of(0).alias("curves0"), of(1).alias("curves1"))
    work = work.withColumn("py", F.floor((F.col("y") + F.floor(th / 2).cast("int")) / th).cast("int"))
    # a left join, as an inner one would filter the lines on the way and shuffle them once more than for the cells
    work = work.join(pairs.hint("merge"), ["image_id", "py"], "left")
    # Written once: the range of the result and the result itself both need it.
    work = cut(work.mapInArrow(_blended(channels), ", ".join([keys, *kinds, "eq array<bigint>"])))
    final = work.groupBy("image_id").agg(
        F.min(F.array_min("eq")).alias("eq_lo"), F.max(F.array_max("eq")).alias("eq_hi")
    )
    # Back to colour
    work = work.join(final.hint("merge"), "image_id")
    return work.mapInArrow(_recoloured(channels), ", ".join([keys, *[f"{c} array<double>" for c in channels]]))
