"""Ranks, running totals and medians without one-task windows.

A window ordered over a whole group puts that group into one task. Here a group
is first split into buckets that keep its order; only the bucket totals (a
bounded number of rows) go through a window over the group, and the rows
themselves through windows over single buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.session import cut

BUCKET = "_bucket"


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(keys), how)


def with_buckets(df: DataFrame, keys: Sequence[str], order: str, buckets: int = 256) -> DataFrame:
    """Add ``_bucket``: equal values share a bucket, larger values a later one."""
    points = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx(F.col(order).cast("double"), points, buckets * 20)
    place = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col(order).cast("double")))
    if not keys:
        found = df.agg(cuts.alias("c")).first()["c"] or []
        bounds = F.array(*[F.lit(float(b)) for b in found]).cast("array<double>")
        return df.withColumn(BUCKET, place(bounds))
    bounds = df.groupBy(*keys).agg(cuts.alias("_cuts"))
    return _on(df, bounds, keys).withColumn(BUCKET, place(F.col("_cuts"))).drop("_cuts")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    *,
    descending: bool = False,
) -> DataFrame:
    """Running totals inside each ``keys`` group; ``df`` must hold ``_bucket``.

    ``order`` sorts rows inside a bucket (callers pass descending columns
    themselves); ``descending`` says in which direction the buckets run.
    """
    keys = list(keys)
    parts = {f"_p{i}": (name, col) for i, (name, col) in enumerate(sums.items())}
    work = df.select("*", *[col.alias(p) for p, (_, col) in parts.items()])
    totals = work.groupBy(*keys, BUCKET).agg(*[F.sum(p).alias(p) for p in parts])
    direction = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    across = (Window.partitionBy(*keys) if keys else Window).orderBy(direction)
    across = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(p).over(across), F.lit(0)).alias(f"{p}_before") for p in parts]
    )
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = _on(work, offsets, [*keys, BUCKET])
    for p, (name, _) in parts.items():
        out = out.withColumn(name, F.col(f"{p}_before") + F.sum(p).over(inside))
    return out.drop(*parts, *[f"{p}_before" for p in parts])


def with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_bucket``: equal shares of the rows in the order of ``keys`` and ``order``.

    Unlike ``with_buckets`` it splits rows of one value by what follows in ``order``, so one
    hot value or key fills many buckets. There are as many as shuffle partitions, less what
    adaptive execution merges; the result is written, as another run might sample other bounds.
    """
    return cut(df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn(BUCKET, F.spark_partition_id()))


def with_rank(df: DataFrame, keys: Sequence[str], order: str, tie: str, name: str = "rank") -> DataFrame:
    """1-based rank by (``order``, ``tie``) inside each group; exact."""
    ranked = running_totals(
        with_ranges(df, keys, [order, tie]), keys, [F.col(order), F.col(tie)], {name: F.lit(1).cast("bigint")}
    )
    return ranked.drop(BUCKET)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """The middle value (or the mean of the two middle ones) of each group."""
    keys = list(keys)
    # Read four times below: written once instead of computed four times.
    counts = cut(df.groupBy(*keys, value).agg(F.count("*").alias("_n")))
    run = running_totals(
        with_buckets(counts, keys, value), keys, [F.col(value)], {"_upto": F.col("_n")}
    ).drop(BUCKET)
    size = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    lower = F.expr("(_size + 1) div 2")
    upper = F.expr("(_size + 2) div 2")
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    return (
        _on(run, size, keys)
        .where(holds(lower) | holds(upper))
        .groupBy(*keys)
        .agg(((F.min(value) + F.max(value)) / 2).alias(name))
    )
