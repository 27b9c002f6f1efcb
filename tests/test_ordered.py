from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lumengraph.functions.ordered import BUCKET, exact_median, with_rank, with_ranges
from lumengraph.session import at_once, cut, scratch, shared_dir


def test_rank_and_median_with_a_hot_group(spark, rng):
    rows = [(1 if i % 3 == 0 else i % 11, i, float(rng.integers(0, 40)) if i % 2 else 5.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, id int, v double")
    ranked = with_rank(df, ["k"], "v", "id", "rank").collect()
    want = {}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])), 1):
            want[r[1]] = i
    assert {r["id"]: r["rank"] for r in ranked} == want
    medians = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    for k in medians:
        assert medians[k] == np.median([r[2] for r in rows if r[0] == k])


def test_rank_without_keys(spark):
    df = spark.range(1000).select("id", F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"))
    got = {r["id"]: r["rank"] for r in with_rank(df, [], "v", "id", "rank").collect()}
    assert got == {i: i * 7919 % 1000 + 1 for i in range(1000)}


def test_a_hot_value_is_spread(spark):
    """99 of 100 rows are 0; no bucket, the unit of the window's work, holds more than a fair share."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 7, F.col("id")).otherwise(0).cast("double").alias("v"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # merging by size is right for small tables, but hides the split
    try:
        sizes = [r["count"] for r in with_ranges(df, [], ["v", "id"]).groupBy(BUCKET).count().collect()]
    finally:
        spark.conf.set(merging, "true")
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    got = {r["id"]: r["rank"] for r in with_rank(df, [], "v", "id", "rank").collect()}
    ordered = sorted(got, key=lambda i: (i if i % 100 == 7 else 0, i))
    assert [got[i] for i in ordered] == list(range(1, 20_001))


def test_scratch_tables_go_with_their_block(spark):
    def folders():
        root = Path(shared_dir(spark).removeprefix("file:")) / "lumengraph"
        return set(root.iterdir()) if root.exists() else set()

    before = folders()
    with scratch(spark):
        parts = at_once([lambda n=n: cut(spark.range(n)).count() for n in (3, 5, 7)])
        assert len(folders() - before) == 3
    assert parts == [3, 5, 7] and folders() == before
