"""Colour space conversions as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ matrix, D65 2-degree white, gray weights.
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
D65_WHITE = (0.95047, 1.0, 1.08883)
GRAY_709 = (0.2125, 0.7154, 0.0721)
# BT.601 luma in 15-bit fixed point (.299, .587, .114 times 2^15).
GRAY_601_FIXED = (9798, 19235, 3735)


def scale01(v: Column) -> Column:
    return v / F.lit(255.0)


def linear_light(c: Column) -> Column:
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def _lab_curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)


def lab_curves(lr: Column, lg: Column, lb: Column) -> tuple[Column, Column, Column]:
    """The three response curves Lab is made of, from linear light."""
    return tuple(
        _lab_curve((lr * m[0] + lg * m[1] + lb * m[2]) / white) for m, white in zip(RGB_TO_XYZ, D65_WHITE)
    )


def lab_from_curves(fx: Column, fy: Column, fz: Column) -> tuple[Column, Column, Column]:
    return fy * 116.0 - 16.0, (fx - fy) * 500.0, (fy - fz) * 200.0


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lab from sRGB channels in [0, 1]."""
    return lab_from_curves(*lab_curves(linear_light(r), linear_light(g), linear_light(b)))


def lab_values(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`rgb_to_lab` of arrays inside a task."""
    r, g, b = (np.where(c > 0.04045, ((np.maximum(c, 0.0) + 0.055) / 1.055) ** 2.4, c / 12.92) for c in (r, g, b))
    curve = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116.0)
    return lab_from_curves(*[curve((r * m[0] + g * m[1] + b * m[2]) / white) for m, white in zip(RGB_TO_XYZ, D65_WHITE)])


def normalize_lab(lab: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    l, a, b = lab
    return l / 100.0, (a + 128.0) / 255.0, (b + 128.0) / 255.0


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """HSV in [0, 1] from channels in [0, 1]."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = (
        F.when(b == top, (r - g) / span + 4.0).when(g == top, (b - r) / span + 2.0).otherwise((g - b) / span)
    )
    hue = F.when(span == 0, F.lit(0.0)).when(sector < 0, sector / 6.0 + 1.0).otherwise(sector / 6.0)
    return hue, F.when(span == 0, F.lit(0.0)).otherwise(span / top), top


def rgb_to_hsv8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV with hue in [0, 180), in 12-bit fixed point."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sat_step = F.rint(F.lit(255.0 * 4096) / top)
    hue_step = F.rint(F.lit(30.0 * 4096) / span)
    sat = F.when(top == 0, F.lit(0)).otherwise(F.floor((span * sat_step + 2048) / 4096).cast("int"))
    turn = F.when(top == r, g - b).when(top == g, b - r + span * 2).otherwise(r - g + span * 4)
    hue = F.floor((turn * hue_step + 2048) / 4096).cast("int")
    hue = F.when(span == 0, F.lit(0)).when(hue < 0, hue + 180).otherwise(hue)
    return hue, sat, top


def gray(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = GRAY_709) -> Column:
    return r * weights[0] + g * weights[1] + b * weights[2]


def gray8(r: Column, g: Column, b: Column) -> Column:
    """BT.601 gray of byte channels, rounded in 15-bit fixed point."""
    wr, wg, wb = GRAY_601_FIXED
    return F.shiftright(r * wr + g * wg + b * wb + F.lit(1 << 14), 15)


def quantize(v: Column, levels: int = 8) -> Column:
    """Nearest of ``levels`` levels, halves to even."""
    return F.rint(v * float(levels - 1)).cast("int")
