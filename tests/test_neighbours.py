"""Mutual information by neighbours against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengraph.operators import learn, neighbours


def psi(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(x: np.ndarray, y: np.ndarray, k: int) -> float:
    own = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[own], y[own]
    total = 0.0
    for i in range(len(x)):
        others = np.sort([abs(x[j] - x[i]) for j in range(len(x)) if j != i and y[j] == y[i]])
        of = min(k, len(others))
        r = others[of - 1]
        nearer = sum(abs(x[j] - x[i]) < r or x[j] == x[i] for j in range(len(x)))
        total += psi(of) - psi(len(others) + 1) - psi(nearer)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 150)
    y[0] = 9  # a class with a single row
    y[1:3] = 8  # and one with fewer others than neighbours
    return y, {
        "noise": rng.normal(size=150), "told": y + 0.3 * rng.normal(size=150), "ties": np.round(rng.normal(size=150)), "flat": np.ones(150),
        "tiny": rng.integers(0, 4, 150) * 0.1 + rng.integers(0, 3, 150) * 0.3,
    }


@pytest.mark.parametrize("k", [1, 5])
def test_mutual_information(spark, columns, k):
    """Ranges hold fewer rows than neighbours are asked for."""
    y, values = columns
    rows = [(i, name, float(v), float(y[i])) for name, column in values.items() for i, v in enumerate(column)]
    long = spark.createDataFrame(rows, "id long, name string, value double, label double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = {r["name"]: r["mi"] for r in neighbours.mutual_information(long, "id", k).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got.keys() == values.keys()
    for name, column in values.items():
        assert abs(got[name] - plain(column, y, k)) < 1e-9, name
    best = [r["name"] for r in learn.select_features(long, "id", "anything", 1).collect()]
    assert best == ["told"]


def test_digamma(spark):
    got = spark.range(1, 400).select("id", neighbours.digamma(F.col("id").cast("double")).alias("v")).collect()
    assert all(math.isclose(r["v"], psi(r["id"]), abs_tol=1e-11) for r in got)
