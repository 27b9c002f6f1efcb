"""Adaptive equalisation never broadcasts curves or pictures."""

import numpy as np

from lumengraph.operators import raster


def test_equalisation_joins_by_merge(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, y, 20, 24, *(rng.integers(0, 256, 24).tolist() for _ in range(3))) for i in range(2) for y in range(20)]
    strips = spark.createDataFrame(rows, "image_id int, y int, height int, width int, r array<int>, g array<int>, b array<int>")
    seen = []
    cut = raster.cut

    def watched(df):
        seen.append(df)
        return cut(df)

    monkeypatch.setattr(raster, "cut", watched)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = raster.equalize_adaptive(strips)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*seen, out)]
        assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
        assert out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
