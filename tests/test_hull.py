"""Convex hulls, the spreading of clipped histograms, named matrices, full pattern histograms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengraph.operators import assemble, raster, shape, texture


def strips_of(spark, masks):
    rows = [(k, y, m.shape[0], m.shape[1], [bool(v) for v in m[y]]) for k, m in masks.items() for y in range(m.shape[0])]
    return spark.createDataFrame(rows, "image_id int, y int, height int, width int, mask array<boolean>")


def brute_hull(mask):
    """Perimeter by sides: pairs of points with all others on one side or between them."""
    pts = [tuple(p) for p in np.argwhere(mask).tolist()]
    if not pts:
        return None
    total = 0.0
    for p in pts:
        for q in pts:
            d = (q[0] - p[0], q[1] - p[1])
            size = d[0] ** 2 + d[1] ** 2
            good = size > 0
            for r in pts:
                e = (r[0] - p[0], r[1] - p[1])
                cross, along = d[0] * e[1] - d[1] * e[0], d[0] * e[0] + d[1] * e[1]
                good = good and (cross > 0 or cross == 0 and 0 <= along <= size)
            total += math.sqrt(size) if good else 0.0
    return total


def test_hulls_of_blocks_merge_to_the_hull(spark, rng, monkeypatch):
    monkeypatch.setattr(shape, "HULL_LINES", 3)
    monkeypatch.setattr(shape, "HULLS", 2)
    masks = {i: rng.random((int(rng.integers(1, 24)), 9)) < 0.12 for i in range(12)}
    masks |= {20: np.zeros((5, 4), bool), 21: np.eye(19, dtype=bool), 22: np.eye(1, 7, 3).astype(bool), 23: np.ones((17, 6), bool)}
    got = {r["image_id"]: r["hull_perimeter"] for r in shape.hull_perimeter(strips_of(spark, masks)).collect()}
    want = {k: brute_hull(m) for k, m in masks.items()}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    by_directions = shape.hull_perimeter(strips_of(spark, {23: masks[23]}), angles=360).first()["hull_perimeter"]
    assert abs(by_directions - want[23]) < 0.02 * want[23]


def test_hull_of_no_pictures(spark):
    assert shape.convex_hull(strips_of(spark, {}).where("false")).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 8, 50])
def test_surplus_is_spread_evenly(rng, limit):
    for _ in range(50):
        hist = rng.integers(0, 12, 256) * (rng.random(256) < 0.4)
        out = raster.leveled(hist, limit)
        assert out.sum() == min(hist.sum(), limit * 256) and out.max() <= limit
        gain = out - np.minimum(hist, limit)
        free = out < limit
        assert (gain >= 0).all() and (not free.any() or np.ptp(gain[free]) <= 1 and gain.max() <= gain[free].max() + 1)


def test_named_matrix_keeps_labelled_rows(spark):
    rows = [(1, "p", 2.0), (1, "q", float("inf")), (2, "p", float("nan")), (2, "q", -1.0), (4, "p", 5.0)]
    long = spark.createDataFrame(rows, "image_id int, name string, value double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "image_id int, label int")
    got = {tuple(r) for r in assemble.named_matrix(long, ["p", "q"], labels).collect()}
    assert got == {(1, 2.0, 0.0, "melanoma"), (2, 0.0, -1.0, "benign"), (3, 0.0, 0.0, "melanoma")}
    assert assemble.named_matrix(long, ["p", "q"]).count() == 3


def test_pattern_bins_are_whole_unless_asked(spark):
    counts = spark.createDataFrame([(0, 1, "default", c, 1) for c in range(256)], "image_id int, radius int, method string, code int, n long")
    full = texture.pattern_histogram(counts)
    assert full.count() == 256 and full.select("bins").distinct().first()["bins"] == 256
    assert texture.pattern_histogram(counts, texture.SHORT_BINS).agg(F.max("bin")).first()[0] == texture.SHORT_BINS - 1
    assert texture.pattern_bins(3, "default") == 2**24 and texture.pattern_bins(3, "uniform") == 26
