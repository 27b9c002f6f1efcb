"""Mutual information between a class and a number by nearest neighbours (Ross 2014).

For each row, the distance to its k-th nearest row of the same class in the column, and the
number of rows of any class that are nearer. Both come from sorted ranges of the column, so
no task holds a column: the k rows before and behind a range are handed to it, and counts
are running totals over ranges. Work is linear in the rows but for sorting.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengraph.functions.ordered import BUCKET, running_totals, with_ranges
from lumengraph.session import cut

NEIGHBOURS = 3
_EULER_FREE_TERMS = ((2, -12.0), (4, 120.0), (6, -252.0), (8, 240.0))


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function, for x >= 1, to about 1e-12."""
    y = x + 8.0
    shift = sum((F.lit(1.0) / (x + float(i)) for i in range(1, 8)), F.lit(1.0) / x)
    tail = sum((F.lit(1.0) / (c * F.pow(y, F.lit(float(p)))) for p, c in _EULER_FREE_TERMS), F.lit(-0.5) / y)
    return F.log(y) + tail - shift


def digamma_sql(x: str) -> str:
    y = f"({x} + 8.0)"
    shift = " + ".join(f"1.0 / ({x} + {i}.0)" for i in range(8))
    tail = " + ".join(f"1.0 / ({c} * pow({y}, {p}))" for p, c in _EULER_FREE_TERMS)
    return f"(ln({y}) - 0.5 / {y} + {tail} - ({shift}))"


def _with_halo(ranged: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """Add ``_before`` and ``_behind``: up to k values of the group around each range.

    Only 2 k values of each range go through a window over a group.
    """
    # every range has a row, so the k ranges next to one hold k values, if there are as many
    low = Window.partitionBy(*keys, BUCKET).orderBy(F.col(value))
    high = Window.partitionBy(*keys, BUCKET).orderBy(F.col(value).desc())
    edges = ranged.select(*keys, BUCKET, value, F.row_number().over(low).alias("_low"), F.row_number().over(high).alias("_high"))
    edges = edges.where((F.col("_low") <= k) | (F.col("_high") <= k))
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("_low") <= k, F.col(value)))), 1, k)
    last = F.array_sort(F.collect_list(F.when(F.col("_high") <= k, F.col(value))))
    ends = edges.groupBy(*keys, BUCKET).agg(first.alias("_first"), last.alias("_last"))
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    before = F.flatten(F.collect_list("_last").over(across.rowsBetween(-k, -1)))
    behind = F.flatten(F.collect_list("_first").over(across.rowsBetween(1, k)))
    trimmed = F.slice(before, F.greatest(F.size(before) - k + 1, F.lit(1)), k)
    return ranged.join(ends.select(*keys, BUCKET, trimmed.alias("_before"), F.slice(behind, 1, k).alias("_behind")), [*keys, BUCKET])


def kth_distance(df: DataFrame, keys: list[str], value: str, id_col: str, k: int) -> DataFrame:
    """Add ``radius``: the distance to the k-th nearest other row of the group; to the last one if there are fewer, null if none."""
    ranged = _with_halo(with_ranges(df, keys, [value, id_col]), keys, value, k)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(value, id_col)
    back = Window.partitionBy(*keys, BUCKET).orderBy(F.col(value).desc(), F.col(id_col).desc())
    rows = ranged.withColumn("_nth", F.row_number().over(inside)).withColumn("_left", F.row_number().over(back))
    reach = []
    for j in range(1, k + 1):
        earlier = F.when(F.col("_nth") > j, F.lag(value, j).over(inside)).otherwise(F.get("_before", F.size("_before") - 1 - (j - F.col("_nth"))))
        later = F.when(F.col("_left") > j, F.lead(value, j).over(inside)).otherwise(F.get("_behind", j - F.col("_left")))
        reach += [F.col(value) - earlier, later - F.col(value)]
    distances = F.array_sort(F.array_compact(F.array(*reach)))
    out = rows.withColumn("_reach", distances).withColumn("radius", F.get("_reach", F.least(F.lit(k), F.size("_reach")) - 1))
    return out.drop("_before", "_behind", "_nth", "_left", "_reach", BUCKET)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as whole numbers of the same order, neighbours one apart; its own inverse but for the type."""
    bits = x.view(np.int64)
    return np.where(bits < 0, np.iinfo(np.int64).min - bits, bits)


def _beyond(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The least number that is, as numbers are subtracted, ``radius`` (above 0) or more beyond ``x``."""
    inside = _ordered(x)
    outside = np.maximum(_ordered(x + 2 * radius), inside + 1)
    while (outside - inside > 1).any():
        middle = inside + (outside - inside) // 2
        far = _ordered(middle.view(np.float64)).view(np.float64) - x >= radius
        inside, outside = np.where(far, inside, middle), np.where(far, middle, outside)
    return _ordered(outside.view(np.float64)).view(np.float64)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _open_ends(value: pd.Series, radius: pd.Series) -> pd.DataFrame:
    """The nearest numbers on both sides that are not less than ``radius`` away; of a radius of 0, the next numbers."""
    x, r = value.to_numpy() + 0.0, np.maximum(radius.to_numpy(), np.nextafter(0.0, 1.0))
    return pd.DataFrame({"low": -_beyond(-x, r), "high": _beyond(x, r)})


def nearer_counts(df: DataFrame, keys: list[str], value: str, id_col: str) -> DataFrame:
    """``keys, id_col, nearer``: rows of the group less than ``radius`` away, the row itself among them."""
    ends = cut(df.select(*keys, id_col, value, _open_ends(F.col(value), F.col("radius")).alias("_ends")))
    # Places on the column: at one place, first those that must not count the rows there, then rows, then those that must.
    at = lambda column, kind, plus, one: F.struct(column.alias("at"), F.lit(kind).alias("kind"), F.lit(plus).alias("plus"), F.lit(one).alias("one"))
    places = F.array(at(F.col("_ends.high"), -1, 1, 0), at(F.col(value), 0, 0, 1), at(F.col("_ends.low"), 1, -1, 0))
    marks = ends.select(*keys, id_col, F.explode(places).alias("p")).select(*keys, id_col, "p.*")
    ranged = with_ranges(marks, keys, ["at", "kind", id_col])
    counted = running_totals(ranged, keys, [F.col("at"), F.col("kind"), F.col(id_col)], {"upto": F.col("one").cast("bigint")})
    return counted.where("kind <> 0").groupBy(*keys, id_col).agg(F.sum(F.col("plus") * F.col("upto")).alias("nearer"))


def mutual_information(
    long: DataFrame, id_col: str, neighbours: int = NEIGHBOURS, name: str = "name", value: str = "value", label: str = "label"
) -> DataFrame:
    """``name, mi`` (nats, not below 0) between the class and each feature.

    Rows of a class with a single row take no part; of a class with fewer others than
    ``neighbours``, the last neighbour counts. Ids are unique in a feature.
    """
    df = cut(long.select(F.col(name).alias("name"), F.col(label).alias("label"), F.col(value).alias("value"), F.col(id_col).alias("id")))
    sizes = df.groupBy("name", "label").agg(F.count("*").alias("of_class"))
    with_radius = cut(kth_distance(df, ["name", "label"], "value", "id", neighbours).where("radius IS NOT NULL"))
    near = nearer_counts(with_radius, ["name"], "value", "id")
    taken = F.least(F.col("of_class") - 1, F.lit(neighbours)).cast("double")
    by_class = sizes.where("of_class > 1").groupBy("name").agg(
        F.sum("of_class").alias("n"),
        F.sum(F.col("of_class") * (digamma(taken) - digamma(F.col("of_class").cast("double")))).alias("classes"),
    )
    by_row = near.groupBy("name").agg(F.sum(digamma(F.col("nearer").cast("double"))).alias("rows"))
    n = F.col("n").cast("double")
    mi = digamma(n) + (F.col("classes") - F.col("rows")) / n
    return by_class.join(by_row, "name").select(F.col("name").alias(name), F.greatest(mi, F.lit(0.0)).alias("mi"))
