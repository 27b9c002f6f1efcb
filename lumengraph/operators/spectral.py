"""Spectral measures of region graphs from sparse matrix-vector products.

The normalised Laplacian is a table of entries ``keys, i, j, value``. A product with a
signal is a join on j and a sum per i; no graph is ever gathered.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengraph.operators.graph import both_ways
from lumengraph.operators.measures import KEYS, node_degree
from lumengraph.session import cut

SIGNALS = ("l", "a", "b")
BANDS = 8
ORDER = 8


def normalized_laplacian(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Entries of I - D^-1/2 A D^-1/2; the diagonal of an isolated node is 0."""
    keys = list(keys)
    deg = node_degree(nodes, edges, keys)
    end = lambda at: deg.select(*keys, F.col("node").alias(at), F.col("strength").alias(f"s_{at}"))
    off = (
        both_ways(edges)
        .join(end("u"), [*keys, "u"])
        .join(end("v"), [*keys, "v"])
        .select(*keys, F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("w") / F.sqrt(F.col("s_u") * F.col("s_v"))).alias("value"))
    )
    diagonal = deg.select(
        *keys, F.col("node").alias("i"), F.col("node").alias("j"),
        F.when(F.col("strength") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
    )
    return off.unionByName(diagonal)


def multiply(laplacian: DataFrame, signal: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, node`` and the product for each signal column; by merge, as rounds of broadcasts would add up on the driver."""
    keys = list(keys)
    met = laplacian.join(signal.withColumnRenamed("node", "j").hint("merge"), [*keys, "j"])
    return met.groupBy(*keys, F.col("i").alias("node")).agg(
        *[F.sum(F.col("value") * F.col(c)).alias(c) for c in columns]
    )


def energies(laplacian: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``energy`` = trace, the sum of the eigenvalues; and the sum of their gaps to 2."""
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(F.lit(0.0)))
    count = F.count_if(F.col("i") == F.col("j"))
    return laplacian.groupBy(*keys).agg(
        trace.alias("energy"), (count * F.lit(2.0) - trace).alias("normalized_laplacian_energy")
    )


def spectral_moments(
    laplacian: DataFrame, signal: DataFrame, order: int = 4, columns: Sequence[str] = SIGNALS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, channel, k, moment`` = x' L^k x for k = 0 .. order.

    Two moments come from each product: (L^p x)'(L^p x) and (L^p x)'(L^{p+1} x).
    """
    keys = list(keys)
    laplacian = cut(laplacian)
    now = cut(signal.select(*keys, "node", *columns))
    out = None

    def dot(left: DataFrame, right: DataFrame | None, k: int) -> DataFrame:
        if right is None:
            joined = left.select(*keys, *[(F.col(c) * F.col(c)).alias(c) for c in columns])
        else:
            other = right.select(*keys, "node", *[F.col(c).alias(f"_{c}") for c in columns])
            joined = left.join(other, [*keys, "node"]).select(
                *keys, *[(F.col(c) * F.col(f"_{c}")).alias(c) for c in columns]
            )
        sums = joined.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
        cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(k).alias("k"), F.col(c).alias("moment")) for c in columns])
        return sums.select(*keys, F.inline(cells))

    for p in range(order // 2 + 1):
        part = dot(now, None, 2 * p)
        out = part if out is None else out.unionByName(part)
        if 2 * p + 1 > order:
            break
        after = cut(multiply(laplacian, now, columns, keys))
        out = out.unionByName(dot(now, after, 2 * p + 1))
        now = after
    return out


def band_weights(bands: int = BANDS, order: int = ORDER) -> list[list[float]]:
    """Damped Chebyshev coefficients of the indicator of each band of [0, 2]."""
    n = order + 1
    damp = [
        ((n - k + 1) * math.cos(math.pi * k / (n + 1)) + math.sin(math.pi * k / (n + 1)) / math.tan(math.pi / (n + 1)))
        / (n + 1)
        for k in range(n)
    ]
    out = []
    for b in range(bands):
        low, high = (math.acos(max(-1.0, min(1.0, 2.0 * e / bands - 1.0))) for e in (b, b + 1))
        row = [(low - high) / math.pi]
        row += [2.0 / math.pi * (math.sin(k * low) - math.sin(k * high)) / k for k in range(1, n)]
        out.append([d * c for d, c in zip(damp, row)])
    return out


def chebyshev_moments(
    laplacian: DataFrame, signal: DataFrame, column: str = "l", order: int = ORDER, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``keys, c0 .. c<order>``: x' T_k(L - I) x, two per product."""
    keys = list(keys)
    shifted = cut(
        laplacian.select(
            *keys, "i", "j", F.when(F.col("i") == F.col("j"), F.col("value") - 1.0).otherwise(F.col("value")).alias("value")
        )
    )
    state = cut(signal.select(*keys, "node", F.col(column).alias("t"), F.lit(0.0).alias("before")))
    sums = None
    half = (order + 1) // 2
    for p in range(half + 1):
        squared = state.groupBy(*keys).agg(F.sum(F.col("t") * F.col("t")).alias(f"q{2 * p}"))
        sums = squared if sums is None else sums.join(squared, keys)
        if p == half:
            break
        product = multiply(shifted, state.select(*keys, "node", "t"), ["t"], keys).withColumnRenamed("t", "at")
        after = F.col("at") if p == 0 else F.col("at") * 2.0 - F.col("before")
        state = cut(
            state.join(product, [*keys, "node"]).select(
                *keys, "node", after.alias("t"), F.col("t").alias("before")
            )
        )
        sums = sums.join(
            state.groupBy(*keys).agg(F.sum(F.col("t") * F.col("before")).alias(f"q{2 * p + 1}")), keys
        )
    first = {0: F.col("q0"), 1: F.col("q1")}
    moment = lambda k: first[k] if k < 2 else F.col(f"q{k}") * 2.0 - F.col(f"q{k % 2}")
    return sums.select(*keys, *[moment(k).alias(f"c{k}") for k in range(order + 1)])


def band_power(moments: DataFrame, bands: int = BANDS, order: int = ORDER, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, band, power``: energy of the signal in equal bands of the spectrum."""
    rows = F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.greatest(
                    F.lit(0.0), sum((F.col(f"c{k}") * w for k, w in enumerate(weights[1:], 1)), F.col("c0") * weights[0])
                ).alias("power"),
            )
            for b, weights in enumerate(band_weights(bands, order))
        ]
    )
    return moments.select(*keys, F.inline(rows))


def mean_power(power: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Energy of the signal per node."""
    keys = list(keys)
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    total = power.groupBy(*keys).agg(F.sum("power").alias("total"))
    return size.join(total, keys).select(*keys, (F.col("total") / F.col("n")).alias("spectral_power"))


def band_entropy(power: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    keys = list(keys)
    amp = power.select(*keys, F.sqrt("power").alias("amp"))
    total = amp.groupBy(*keys).agg(F.sum("amp").alias("total"))
    p = F.col("amp") / (F.col("total") + 1e-10)
    return amp.join(total, keys).groupBy(*keys).agg(F.sum(-p * F.log2(p + 1e-10)).alias("spectral_entropy"))


def band_peak(power: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return power.groupBy(*keys).agg(F.max(F.sqrt("power")).alias("spectral_amplitude"))


# --- extreme eigenvalues -------------------------------------------------------------------------

EXHAUSTED = 1e-7

_EXTREMES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("low", "high", "residual")])


@F.pandas_udf(_EXTREMES)
def _tridiagonal_extremes(alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
    """Smallest and largest eigenvalue of the small matrices of the rounds.

    An eigenvalue of the graph is within ``residual`` of each: the length of what the last
    round left, times the last component of the small eigenvector. Rounds after nothing was
    left are noise.
    """
    rows = []
    for a, b in zip(alpha, beta):
        a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
        stop = np.flatnonzero(b < EXHAUSTED)
        size = int(stop[0]) + 1 if len(stop) else len(a)
        values, vectors = np.linalg.eigh(np.diag(a[:size]) + np.diag(b[: size - 1], 1) + np.diag(b[: size - 1], -1))
        rows.append((float(values[0]), float(values[-1]), float(b[size - 1] * np.abs(vectors[-1, [0, -1]]).max())))
    return pd.DataFrame(rows, columns=["low", "high", "residual"])


#: Rounds between two looks at the residuals.
LOOK = 8


def extreme_eigenvalues(
    nodes: DataFrame, edges: DataFrame, components: DataFrame, rounds: int | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``spectral_radius``, ``spectral_gap`` and ``residual`` of each graph by Lanczos rounds.

    The known null vector (square roots of the strengths) is taken out of the start
    vector and of every product, so the smallest value found is the gap of a connected
    graph; a graph of several components has gap 0. Each round is one product and two
    sums per graph. Rounds go on until the ``residual`` of every graph, a bound on the error
    of both values, is at most ``EXHAUSTED``, unless a number of ``rounds`` is asked for.
    Only the rounds' coefficients, two numbers each, meet in one row per graph. Rounds join by
    merge: one broadcast each would be small, but all of them pass through the driver.
    """
    keys = list(keys)
    lap = cut(normalized_laplacian(nodes, edges, keys))
    deg = node_degree(nodes, edges, keys)
    total = deg.groupBy(*keys).agg(F.sum("strength").alias("total"), F.count("*").alias("n"))
    noise = F.pmod(F.abs(F.xxhash64("node")), F.lit(1000003)) / 1000003.0 - 0.5
    start = deg.join(total.hint("merge"), keys).select(
        *keys, "node", noise.alias("v"),
        F.when(F.col("total") > 0, F.sqrt(F.col("strength") / F.col("total"))).otherwise(F.lit(0.0)).alias("z"),
    )

    sums = lambda df, **cols: df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in cols.items()])
    v, w, z = F.col("v"), F.col("w"), F.col("z")

    def scaled(df: DataFrame) -> DataFrame:
        """``v`` to unit length; ``beta`` is the length it had, 0 once nothing is left."""
        norm = sums(df, n2=v * v).withColumn("norm", F.sqrt("n2")).drop("n2")
        alive = F.col("norm") > EXHAUSTED
        return df.join(norm.hint("merge"), keys).select(
            *keys, "node", "z", "old",
            F.when(alive, v / F.col("norm")).otherwise(F.lit(0.0)).alias("v"),
            F.when(alive, F.col("norm")).otherwise(F.lit(0.0)).alias("beta"),
        )

    flat = start.join(sums(start, along=v * z).hint("merge"), keys).withColumn("v", v - F.col("along") * z)
    state = cut(scaled(flat.withColumn("old", F.lit(0.0))).withColumn("beta", F.lit(0.0)))
    left = lambda new, now, old: new - F.col("alpha") * now - F.col("beta") * old
    step = 0
    found: list[DataFrame] = []
    while True:
        product = multiply(lap, state.select(*keys, "node", "v"), ["v"], keys).withColumnRenamed("v", "w")
        met = cut(state.join(product.hint("merge"), [*keys, "node"]))
        rest = cut(
            met.join(sums(met, alpha=v * w, wz=w * z, vz=v * z, oz=F.col("old") * z).hint("merge"), keys).select(
                *keys, "node", "z", v.alias("old"), "alpha",
                (left(w, v, F.col("old")) - left(F.col("wz"), F.col("vz"), F.col("oz")) * z).alias("v"),
            )
        )
        found.append(
            rest.groupBy(*keys).agg(
                F.struct(F.lit(step).alias("step"), F.max("alpha").alias("alpha"), F.sqrt(F.sum(v * v)).alias("beta")).alias("c")
            )
        )
        state = scaled(rest)
        step += 1
        if step % LOOK == 0 or step == rounds:
            found = [cut(functools.reduce(DataFrame.unionByName, found))]
            rows = found[0].groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("c"))
            ends = cut(rows.select(*keys, _tridiagonal_extremes("c.alpha", "c.beta").alias("e")))
            if step == rounds or ends.where(F.col("e.residual") > EXHAUSTED).isEmpty():
                break
    ends = ends.join(total.hint("merge"), keys)
    parts = components.select(*keys, "component").distinct().groupBy(*keys).agg(F.count("*").alias("parts"))
    return ends.join(parts.hint("merge"), keys).select(
        *keys,
        F.when((F.col("n") > 1) & (F.col("total") > 0), F.col("e.high")).otherwise(F.lit(0.0)).alias("spectral_radius"),
        F.when((F.col("parts") == 1) & (F.col("n") > 1), F.greatest(F.col("e.low"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("spectral_gap"),
        F.col("e.residual").alias("residual"),
    )


# What stands in for a spectral measure that could not be computed.
SPECTRAL_DEFAULTS = {
    "spectral_radius": 0.0, "energy": 0.0, "spectral_gap": 0.0, "normalized_laplacian_energy": 0.0,
    "spectral_power": 0.0, "spectral_entropy": 0.0, "spectral_amplitude": 0.0,
}

