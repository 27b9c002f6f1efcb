"""Texture steps work on lines in Arrow batches; no expression runs pixel by pixel and no row is made for a pattern."""

from __future__ import annotations

import numpy as np
from conftest import as_strips
from pyspark.sql import functions as F

from lumengraph.operators import raster, texture


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pictures(rng):
    images = {i: rng.integers(0, 256, (7 + 30 * i, 11 - 2 * i, 3)) for i in range(4)}
    return images, {i: rng.random(v.shape[:2]) < 0.7 for i, v in images.items()}


def test_patterns_are_counted_in_batches(spark, rng):
    """All methods' codes of masked pictures of several widths, against strings of bits."""
    images, masks = pictures(rng)
    counts = texture.binary_patterns(as_strips(spark, images, masks), "mask")
    assert "codes" not in optimized(counts) and optimized(counts).count("Aggregate") == 1
    got = {(r.image_id, r.radius, r.method, r.code): r.n for r in counts.collect()}
    want: dict = {}
    for i, image in images.items():
        r, g, b = (image[:, :, c] / 255.0 for c in range(3))
        gray = np.floor((r * 0.2125 + g * 0.7154 + b * 0.0721) * 255)
        p = np.pad(gray, 3)
        for y, x in zip(*np.nonzero(masks[i])):
            for radius in texture.PATTERN_RADII:
                bits = ""
                for y0, x0, y1, x1, fy, fx in texture.pattern_taps(radius):
                    at = lambda dy, dx: p[y + 3 + dy, x + 3 + dx]  # noqa: B023, E731
                    top = (1 - fx) * at(y0, x0) + fx * at(y0, x1)
                    low = (1 - fx) * at(y1, x0) + fx * at(y1, x1)
                    bits = ("1" if (1 - fy) * top + fy * low - gray[y, x] >= 0 else "0") + bits
                n = len(bits)
                flips = sum(p_ != q for p_, q in zip(bits, bits[1:]))
                codes = {
                    "default": int(bits, 2), "ror": min(int(bits[k:] + bits[:k], 2) for k in range(n)),
                    "uniform": bits.count("1") if flips <= 2 else n + 1,
                }
                for method, code in codes.items():
                    key = (i, radius, method, code)
                    want[key] = want.get(key, 0) + 1
    assert got == want


def test_gradients_of_several_widths(spark, rng):
    """Derivatives of the pixels inside masks, against whole padded pictures; too few lines give nulls."""
    images, masks = pictures(rng)
    images[9], masks[9] = rng.integers(0, 256, (2, 6, 3)), np.ones((2, 6), bool)
    gray = raster.gray_strips(as_strips(spark, images, masks), masked=True)
    grads = texture.gradients(gray, mask="mask")
    assert "Generate [explode" not in optimized(grads).replace("Generate explode", "Generate [explode").split("Window")[0]
    got = {(r.image_id, r.y, r.x): r for r in grads.collect()}
    assert len(got) == sum(int(m.sum()) for m in masks.values())
    assert all(r.gx_k7 is None for (i, _, _), r in got.items() if i == 9)
    for i in range(4):
        r, g, b = (images[i][:, :, c] / 255.0 for c in range(3))
        p = np.pad(np.where(masks[i], r * 0.2125 + g * 0.7154 + b * 0.0721, 0.0), 3, mode="reflect")
        kernels = {}
        for name, (deriv, smooth) in ({f"k{k}": t for k, t in texture.SOBEL.items()} | {"scharr": texture.SCHARR}).items():
            kernels[f"gx_{name}"], kernels[f"gy_{name}"] = np.outer(smooth, deriv), np.outer(deriv, smooth)
        kernels["laplace"] = np.array(texture.LAPLACE)
        for y, x in zip(*np.nonzero(masks[i])):
            for name, kernel in kernels.items():
                k = len(kernel) // 2
                want = (p[y + 3 - k : y + 4 + k, x + 3 - k : x + 4 + k] * kernel).sum()
                assert abs(got[i, y, x][name] - want) < 1e-9


def test_wavelet_steps_of_several_sizes(spark, rng):
    """One step of pictures of several sizes in one batch keeps the energy of the Haar filter."""
    images, _ = pictures(rng)
    images = {i: v[: v.shape[0] // 2 * 2, : v.shape[1] // 2 * 2] for i, v in images.items()}
    gray = raster.gray_strips(as_strips(spark, images))
    step = texture.wavelet_step(gray.withColumn("family", F.explode(F.array(*[F.lit(f) for f in texture.LOW_PASS]))), "gray")
    assert "lambda" not in optimized(step).split("MapInArrow across")[0]
    rows = step.where("family = 'haar'").collect()
    for i, image in images.items():
        r, g, b = (image[:, :, c] / 255.0 for c in range(3))
        whole = ((r * 0.2125 + g * 0.7154 + b * 0.0721) ** 2).sum()
        mine = [row for row in rows if row.image_id == i]
        assert sorted(row.y for row in mine) == list(range(image.shape[0] // 2))
        assert abs(sum((np.array(row[band]) ** 2).sum() for row in mine for band in ("aa", "da", "ad", "dd")) - whole) < 1e-9
