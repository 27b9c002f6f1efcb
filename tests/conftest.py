"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lumengraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(7)


def as_strips(spark, images: dict[int, np.ndarray], mask: dict[int, np.ndarray] | None = None):
    """RGB arrays as a strip table."""
    rows = []
    for image_id, img in images.items():
        h, w = img.shape[:2]
        for y in range(h):
            row = [image_id, y, h, w, *[[int(v) for v in img[y, :, c]] for c in range(3)]]
            if mask:
                row.append([bool(v) for v in mask[image_id][y]])
            rows.append(tuple(row))
    schema = "image_id int, y int, height int, width int, r array<int>, g array<int>, b array<int>"
    return spark.createDataFrame(rows, schema + (", mask array<boolean>" if mask else ""))


def plane(spark, values: np.ndarray, name: str, kind: str, image_id: int = 0):
    """One channel as a strip table."""
    h, w = values.shape
    rows = [(image_id, y, h, w, values[y].tolist()) for y in range(h)]
    return spark.createDataFrame(rows, f"image_id int, y int, height int, width int, {name} array<{kind}>")


def collect_plane(df, name: str) -> np.ndarray:
    rows = sorted(df.select("y", name).collect(), key=lambda r: r["y"])
    return np.array([r[name] for r in rows])
