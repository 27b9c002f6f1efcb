"""The hull by directions is read off the corners: no row for each line and direction."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import as_strips

from lumengraph.operators import shape


def test_directions_come_from_corners(spark, rng):
    masks = {i: rng.random((40 + 300 * i, 30)) < 0.2 for i in range(2)}
    images = {i: np.zeros((*m.shape, 3), np.uint8) for i, m in masks.items()}
    table = shape.hull_perimeter(as_strips(spark, images, masks), angles=36)
    assert "turn" not in table._jdf.queryExecution().analyzed().toString()
    got = {r.image_id: r.hull_perimeter for r in table.collect()}
    turn = np.arange(36) * 2 * np.pi / 36
    for i, mask in masks.items():
        ys, xs = np.nonzero(mask)
        want = (np.outer(xs, np.cos(turn)) + np.outer(ys, np.sin(turn))).max(axis=0).sum() * 2 * np.pi / 36
        assert got[i] == pytest.approx(want, rel=1e-12)
