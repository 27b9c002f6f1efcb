"""Connected regions of a picture as runs: stretches of equal pixels in a line.

A run is ``image_id, y, x0, x1, run``; ``run`` is the number of its first pixel in
reading order, so it is unique in the image and the smallest run of a region is the
region's first pixel.

Runs are written in a small part of the bytes they take in memory, most of all where pictures
are known by long names. The hints on joins of runs and pieces keep them off the driver: the
planner would broadcast what is small as a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.operators.graph import connected_components
from lumengraph.session import cut

_SPAN = 64
_BLOCK = 64


def value_runs(strips: DataFrame, column: str) -> DataFrame:
    """Runs of equal values, with the value under the column's name."""
    start = F.filter(
        F.transform(
            F.zip_with(F.col(column), F.concat(F.array(F.lit(None)), F.slice(F.col(column), 1, F.col("width") - 1)), lambda v, before: v.eqNullSafe(before)),
            lambda same, x: F.when(~same, x),
        ),
        lambda x: x.isNotNull(),
    )
    lines = strips.select("image_id", "y", "width", F.col(column).alias("_v"), start.alias("_start"))
    after = F.concat(F.slice("_start", 2, F.size("_start")), F.array(F.col("width")))
    each = lines.select(
        "image_id", "y", "width",
        F.explode(
            F.zip_with("_start", after, lambda a, b: F.struct(a.alias("x0"), (b - 1).alias("x1"), F.get(F.col("_v"), a).alias("v")))
        ).alias("r"),
    )
    return each.select(
        "image_id", "y", F.col("r.x0").cast("int").alias("x0"), F.col("r.x1").cast("int").alias("x1"),
        (F.col("y").cast("bigint") * F.col("width") + F.col("r.x0")).alias("run"),
        F.col("r.v").alias(column),
    )


def _spans(df: DataFrame, low, high) -> DataFrame:
    first, last = F.floor(low / _SPAN).cast("int"), F.floor(high / _SPAN).cast("int")
    return df.withColumn("_span", F.explode(F.sequence(first, last)))


def _line_overlaps(runs: DataFrame, reach: int, keep: tuple[str, ...]) -> DataFrame:
    """Pairs of runs in successive lines that overlap, or nearly so by ``reach``.

    A range join: runs are spread over 64-pixel spans of their line, so that a join
    key holds at most 64 runs of either line.
    """
    upper = runs.select("image_id", (F.col("y") + 1).alias("y"), *[F.col(c).alias(f"up_{c}") for c in ("run", "x0", "x1", *keep)])
    upper = _spans(upper, F.col("up_x0") - reach, F.col("up_x1") + reach)
    lower = _spans(runs.select("image_id", "y", "run", "x0", "x1", *keep), F.col("x0"), F.col("x1"))
    met = upper.join(lower, ["image_id", "y", "_span"]).where(
        (F.col("x0") <= F.col("up_x1") + reach) & (F.col("x1") >= F.col("up_x0") - reach)
    )
    # A pair that shares several spans is kept in the first of them only.
    first = F.floor(F.greatest(F.col("x0"), F.col("up_x0") - reach) / _SPAN).cast("int")
    return met.where(F.col("_span") == first).drop("_span")


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by image and block, dealt anew so that no block is cut; a block has a bound."""
    rest = None
    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        last = (rows["image_id"] == rows["image_id"].iloc[-1]) & (rows["_block"] == rows["_block"].iloc[-1])
        whole = len(rows) - int(last.sum())
        if whole:
            yield rows.iloc[:whole]
        rest = rows.iloc[whole:]
    if rest is not None and len(rest):
        yield rest


def _link_in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest connected run, within its block of lines, for each run; blocks come sorted by line."""
    for rows in _whole_blocks(batches):
        place = [rows[c].to_numpy() for c in ("image_id", "_block", "y")]
        block = np.cumsum(np.any([p[1:] != p[:-1] for p in place[:2]], axis=0), dtype=np.int64)
        block = np.concatenate([[0], block])
        new_line = np.concatenate([[True], (block[1:] != block[:-1]) | (place[2][1:] != place[2][:-1]), [True]])
        lines = np.flatnonzero(new_line)
        follows = (block[lines[1:-1]] == block[lines[:-2]]) & (place[2][lines[1:-1]] == place[2][lines[:-2]] + 1)
        x0, x1, value, reach = (rows[c].tolist() for c in ("x0", "x1", "_value", "_reach"))
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:  # noqa: B023
                root[i] = root[root[i]]  # noqa: B023
                i = root[i]  # noqa: B023
            return i

        lines = lines.tolist()
        for top, low, end, near in zip(lines[:-2], lines[1:-1], lines[2:], follows.tolist()):
            if not near:
                continue
            i, j = top, low
            while i < low and j < end:
                if value[i] == value[j] and x0[j] <= x1[i] + reach[i] and x1[j] >= x0[i] - reach[i]:
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
                # The run that ends first meets nothing further on; with equal ends both
                # may still touch the other's successor by a corner.
                if x1[i] < x1[j]:
                    i += 1
                elif x1[j] < x1[i]:
                    j += 1
                else:
                    if i + 1 < low and value[i + 1] == value[j] and x0[i + 1] <= x1[j] + reach[j]:
                        p, q = find(i + 1), find(j)
                        root[max(p, q)] = min(p, q)
                    if j + 1 < end and value[j + 1] == value[i] and x0[j + 1] <= x1[i] + reach[i]:
                        p, q = find(i), find(j + 1)
                        root[max(p, q)] = min(p, q)
                    i, j = i + 1, j + 1
        run = rows["run"].to_numpy()
        yield rows[["image_id", "run"]].assign(local=run[[find(i) for i in range(len(rows))]])


def connected_runs(runs: DataFrame, value: Column, reach: Column) -> DataFrame:
    """``runs`` with ``piece``: the smallest run connected to each run.

    Runs connect to runs of equal ``value`` in the next line; ``reach`` 1 also takes
    corners. A block of lines is a bounded group and is labelled in one task; only the
    labels that touch across block edges go through the distributed rounds.
    """
    id_type = runs.schema["image_id"].dataType.simpleString()
    work = runs.withColumns({"_value": value, "_reach": reach, "_block": F.floor(F.col("y") / _BLOCK).cast("int")})
    # Many small blocks go through one call: a call for each would cost more than its work.
    sorted_ = work.select("image_id", "_block", "y", "x0", "x1", "run", "_value", "_reach").repartition("image_id", "_block").sortWithinPartitions("image_id", "_block", "y", "x0")
    local = cut(sorted_.mapInPandas(_link_in_blocks, f"image_id {id_type}, run bigint, local bigint"))
    labelled = work.join(local.hint("merge"), ["image_id", "run"])
    edge = labelled.where((F.col("y") % _BLOCK == 0) | ((F.col("y") + 1) % _BLOCK == 0))
    met = _line_overlaps(edge, 1, ("_value", "_reach", "local", "_block"))
    close = (F.col("x0") <= F.col("up_x1") + F.col("_reach")) & (F.col("x1") >= F.col("up_x0") - F.col("_reach"))
    crossing = cut(
        met.where((F.col("up__block") != F.col("_block")) & (F.col("up__value") == F.col("_value")) & close)
        .select("image_id", F.col("up_local").alias("src"), F.col("local").alias("dst"))
        .distinct()
    )
    out = runs.join(local.hint("merge"), ["image_id", "run"])
    if crossing.isEmpty():
        return out.withColumnRenamed("local", "piece")
    ends = crossing.select("image_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    merged = connected_components(ends, crossing)
    merged = merged.select("image_id", F.col("node").alias("local"), F.col("component").alias("merged"))
    return out.join(merged.hint("merge"), ["image_id", "local"], "left").withColumn("piece", F.coalesce("merged", "local")).drop("local", "merged")


def shared_borders(runs: DataFrame, label: str) -> DataFrame:
    """Border length between differently labelled runs: ``image_id, <label>, other, border``."""
    below = _line_overlaps(runs, 0, (label,)).where(F.col(f"up_{label}") != F.col(label)).select(
        "image_id", F.col(f"up_{label}").alias("p"), F.col(label).alias("q"),
        (F.least("x1", "up_x1") - F.greatest("x0", "up_x0") + 1).alias("n"),
    )
    right = runs.select("image_id", "y", (F.col("x0") - 1).alias("x1"), F.col(label).alias("q"))
    beside = runs.select("image_id", "y", "x1", F.col(label).alias("p")).join(right, ["image_id", "y", "x1"])
    beside = beside.where("p <> q").select("image_id", "p", "q", F.lit(1).alias("n"))
    pairs = below.unionByName(beside)
    both = pairs.unionByName(pairs.select("image_id", F.col("q").alias("p"), F.col("p").alias("q"), "n"))
    return both.groupBy("image_id", F.col("p").alias(label), F.col("q").alias("other")).agg(F.sum("n").alias("border"))


def label_regions(strips: DataFrame, mask: str = "dark") -> DataFrame:
    """Runs inside the mask with ``region``: 8-connected, named by its first pixel."""
    runs = cut(value_runs(strips, mask).where(F.col(mask)).drop(mask))
    return connected_runs(runs, F.lit(1), F.lit(1)).withColumnRenamed("piece", "region")


def filled_regions(strips: DataFrame, mask: str = "dark") -> DataFrame:
    """Runs of the outermost regions with everything they enclose.

    Inside pixels hang together by edges and corners, outside pixels by edges. Every
    piece but the outermost lies in the piece left of its first pixel; following that
    link outwards ends at the region that encloses it. Outside pieces that touch the
    picture's border enclose nothing.
    """
    ends = strips.groupBy("image_id").agg(F.max("y").alias("last_y"), (F.max("width") - 1).alias("last_x"))
    runs = cut(value_runs(strips, mask).withColumnRenamed(mask, "inside").join(ends.hint("merge"), "image_id"))
    side = F.col("inside").cast("int")
    runs = cut(connected_runs(runs, side, side))
    edge = (F.col("y") == 0) | (F.col("y") == F.col("last_y")) | (F.col("x0") == 0) | (F.col("x1") == F.col("last_x"))
    open_ = runs.groupBy("image_id", "piece").agg((F.max(edge) & ~F.max("inside")).alias("open"))
    first = runs.where("run = piece").select("image_id", "piece", "y", (F.col("x0") - 1).alias("x1"))
    left = runs.select("image_id", "y", "x1", F.col("piece").alias("around"))
    nested = first.join(left.hint("merge"), ["image_id", "y", "x1"], "left").join(open_.hint("merge"), ["image_id", "piece"])
    around_open = open_.select("image_id", F.col("piece").alias("around"), F.col("open").alias("around_open"))
    nested = cut(
        nested.join(around_open.hint("merge"), ["image_id", "around"], "left")
        .where("NOT open")
        .select("image_id", "piece", F.when(~F.coalesce("around_open", F.lit(True)), F.col("around")).alias("around"))
    )
    trees = connected_components(
        nested.select("image_id", F.col("piece").alias("node")),
        nested.where("around IS NOT NULL").select("image_id", F.col("around").alias("src"), F.col("piece").alias("dst")),
    )
    tree = trees.select("image_id", F.col("node").alias("piece"), F.col("component").alias("tree"))
    root = nested.where("around IS NULL").join(tree.hint("merge"), ["image_id", "piece"]).select(
        "image_id", "tree", F.col("piece").alias("region")
    )
    whole = tree.join(root.hint("merge"), ["image_id", "tree"]).select("image_id", "piece", "region")
    return runs.join(whole.hint("merge"), ["image_id", "piece"]).select("image_id", "y", "x0", "x1", "region")


def region_areas(runs: DataFrame) -> DataFrame:
    return runs.groupBy("image_id", "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def paint_runs(strips: DataFrame, runs: DataFrame, column: str) -> DataFrame:
    """``strips`` with ``column`` filled from ``runs`` that cover every line; a line is one array already."""
    stretch = lambda r: F.array_repeat(r["v"], (r["x1"] - r["x0"] + 1).cast("int"))
    runs = runs.select("image_id", "y", F.struct("x0", "x1", F.col(column).alias("v")).alias("r"))
    lines = runs.groupBy("image_id", "y").agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), stretch)).alias(column))
    return strips.drop(column).join(lines, ["image_id", "y"])
