"""Equalisation in batches of lines: sizes that do not divide, and pictures side by side."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import as_strips

from lumengraph.operators import raster


def plain_cells(img: np.ndarray) -> dict:
    """Pixels by (tile row, tile column, bin), one at a time."""
    h, w = img.shape[:2]
    top = img.max(axis=2) / 255.0
    level = (top - top.min()) / (top.max() - top.min()) * (raster._GRAYS - 1)
    th, tw = max(h // 8, 1), max(w // 8, 1)
    out: dict = {}
    for my in range(-(-h // th) * th):
        for mx in range(-(-w // tw) * tw):
            y, x = (2 * s - 2 - m if m >= s else m for m, s in ((my, h), (mx, w)))
            key = (my // th, mx // tw, int(np.rint(level[y, x]) // 65))
            out[key] = out.get(key, 0) + 1
    return out


def test_cells_of_a_batch_of_several_sizes():
    rng = np.random.default_rng(3)
    imgs = {7: rng.integers(0, 256, (19, 21, 3)), 3: rng.integers(0, 256, (16, 9, 3)), 5: rng.integers(0, 256, (8, 30, 3))}
    lines = [(i, y, *img.shape[:2], *(img[y, :, c].tolist() for c in range(3)), float(img.max(axis=2).min()), float(img.max(axis=2).max())) for i, img in imgs.items() for y in range(len(img))]
    order = rng.permutation(len(lines))
    names = [*raster.KEYS, *"rgb", "lo", "hi"]
    kinds = [pa.int32()] * 4 + [pa.list_(pa.int32())] * 3 + [pa.float64()] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([lines[k][c] for k in order], kind) for c, kind in enumerate(kinds)], names)
    found = pa.Table.from_batches(raster._count_cells("rgb")(iter([batch]))).to_pylist()
    for i, img in imgs.items():
        assert {(r["ty"], r["tx"], r["bin"]): r["n"] for r in found if r["image_id"] == i} == plain_cells(img)


def test_curves_of_many_tiles_are_those_of_each():
    rng = np.random.default_rng(8)
    hist = rng.integers(0, 60, (50, 256)) * (rng.random((50, 256)) < rng.random((50, 1)))
    limit = rng.integers(1, 80, 50)
    many = raster._leveled_rows(hist, limit)
    for h, most, got in zip(hist, limit, many, strict=True):
        assert (raster.leveled(h, int(most)) == got).all()
        # nothing is lost while there is room, and no bin goes over its limit
        assert got.max() <= most and got.sum() == min(h.sum(), 256 * most)


def test_pixels_stay_in_arrays(spark, monkeypatch):
    rng = np.random.default_rng(9)
    strips = as_strips(spark, {1: rng.integers(0, 256, (19, 21, 3)), 2: np.full((19, 21, 3), 77)})
    seen = []
    cut = raster.cut
    monkeypatch.setattr(raster, "cut", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    out = raster.equalize_adaptive(strips).collect()
    assert "Generate posexplode" not in seen[0] and "MapInArrow" in seen[0]
    flat = [r for r in out if r["image_id"] == 2]
    assert len(out) == 38 and all(v == pytest.approx(0.0) for r in flat for c in "rgb" for v in r[c])
