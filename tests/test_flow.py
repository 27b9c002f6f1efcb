import numpy as np
from conftest import as_strips
from pyspark.sql import functions as F

from lumengraph import flow
from lumengraph.operators import assemble, graph
from lumengraph.streaming import score as streaming
from test_raster import png


def test_every_catalogue_name_is_made(spark, rng):
    imgs = {1: rng.integers(0, 256, (24, 20, 3)), 2: np.full((24, 20, 3), 80)}
    full = {i: np.ones((24, 20), bool) for i in imgs}
    rows = flow.conventional_features(as_strips(spark, imgs, full)).collect()
    names = {r["name"] for r in rows if r["image_id"] == 1}
    want = set(assemble.geometric_names() + assemble.colour_names() + assemble.texture_names())
    assert names <= want
    # Histogram cells that hold nothing are left out and become 0 in the matrix.
    assert {n for n in want - names if not n.startswith("lbp_hist")} == set()
    assert len({(r["image_id"], r["name"]) for r in rows}) == len(rows)
    assert all(r["value"] is not None and not np.isnan(r["value"]) for r in rows)


def test_graph_features_names(spark, rng):
    rows = [(1, i, *[float(v) for v in rng.normal(0, 30, 3)], float(i), float(i % 3)) for i in range(6)]
    nodes = spark.createDataFrame(rows, "image_id int, node int, l double, a double, b double, cy double, cx double")
    edges = graph.build_edges(nodes, 0.4, nodes.where("node > 0").select("image_id", (F.col("node") - 1).alias("src"), F.col("node").alias("dst")))
    names = [r["name"] for r in flow.graph_features(nodes, edges).collect()]
    assert sorted(names) == sorted(assemble.graph_names())


def test_stream_scores_and_sets_aside(spark, tmp_path, rng):
    landing = tmp_path / "landing"
    landing.mkdir()
    png(landing / "one.png", rng.integers(0, 256, (8, 8, 3)))
    png(landing / "dark.png", np.zeros((8, 8, 3), int))
    (landing / "broken.png").write_bytes(b"nothing")
    paths = [str(tmp_path / n) for n in ("good", "bad", "state")]

    def scorer(rows):
        bright = F.conv(F.hex(F.substring("image.data", 1, 1)), 16, 10).cast("int") + F.length("image.data") * 0
        lit = F.col("image.height") > 0
        dark = F.regexp_like("image_id", F.lit("dark"))
        return rows.select(
            "image_id", (lit & ~dark).alias("is_valid"), F.when(dark, F.lit("too dark")).alias("validation"), (bright / 255.0).alias("probability")
        )

    def run():
        streaming.score_stream(spark, str(landing), scorer, *paths, once=True).awaitTermination()
        good = {r["filename"] for r in spark.read.parquet(paths[0]).collect()}
        bad = {r["filename"]: r["reason"] for r in spark.read.parquet(paths[1]).collect()}
        return good, bad

    assert run() == ({"one.png"}, {"dark.png": "too dark", "broken.png": "Could not read image"})
    png(landing / "two.png", rng.integers(0, 256, (8, 8, 3)))
    assert run()[0] == {"one.png", "two.png"}
    assert spark.read.parquet(paths[1]).count() == 2


def test_many_small_files_are_one_batch(spark, tmp_path):
    from lumengraph.streaming import score

    (tmp_path / "in").mkdir()
    for i in range(1100):
        (tmp_path / "in" / f"{i}.bmp").write_bytes(b"no picture")
    sizes = []
    stream = score.arriving_images(spark, str(tmp_path / "in")).writeStream.trigger(availableNow=True)
    stream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda batch, _: sizes.append(batch.count())).start().awaitTermination()
    assert sizes == [1100]
