"""Lines and runs of pictures are never sent to the driver."""

import numpy as np
from conftest import as_strips
from pyspark.sql import functions as F

from lumengraph.operators import regions, validate


def test_runs_and_lines_join_by_merge(spark, monkeypatch):
    y, x = np.mgrid[0:70, 0:60]
    ring = (np.abs(np.hypot(y - 35, x - 30) - 20) < 6) | (np.hypot(y - 35, x - 30) < 4)
    picture = np.where(ring[:, :, None], 40, 200) + np.zeros((70, 60, 3), int)
    strips = as_strips(spark, {1: picture}).withColumn("image_id", F.lit("file:/landing/one.bmp"))
    seen = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cut = regions.cut
    monkeypatch.setattr(regions, "cut", lambda df: (seen.append(plan(df)), cut(df))[1])
    dark = validate.dark_mask(strips)
    filled = regions.filled_regions(cut(dark))
    # pairs of runs at the edges of blocks are few
    seen = [p for p in seen if "up__block" not in p] + [plan(dark), plan(filled)]
    assert sum("SortMergeJoin" in p for p in seen) >= 4
    assert not any("BroadcastHashJoin" in p for p in seen)
    runs = filled.collect()
    assert len({r["region"] for r in runs}) == 1
    assert 1800 < sum(r["x1"] - r["x0"] + 1 for r in runs) < 2500
