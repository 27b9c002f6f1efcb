import numpy as np
import pandas as pd
from conftest import as_strips, collect_plane, plane

from lumengraph.operators import regions, segment, shape, validate


def flood(mask, eight):
    label = np.full(mask.shape, -1)
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0) and (eight or dy * dx == 0)]
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x] >= 0:
            continue
        todo, label[y, x] = [(y, x)], y * mask.shape[1] + x
        while todo:
            cy, cx = todo.pop()
            for dy, dx in steps:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and label[ny, nx] < 0:
                    label[ny, nx] = label[y, x]
                    todo.append((ny, nx))
    return label


def paint(runs, shape_, value):
    out = np.full(shape_, -1)
    for r in runs.collect():
        out[r["y"], r["x0"] : r["x1"] + 1] = r[value]
    return out


def test_label_regions_on_noise(spark, rng):
    mask = rng.random((140, 150)) < 0.45  # wider than one span, higher than two blocks
    got = paint(regions.label_regions(plane(spark, mask, "dark", "boolean")), mask.shape, "region")
    assert np.array_equal(got, flood(mask, True))


def test_nested_rings_fill(spark):
    mask = np.zeros((40, 40), bool)
    mask[2:30, 2:30] = True
    mask[6:26, 6:26] = False  # a hole
    mask[10:20, 10:20] = True  # an island in it
    mask[13:16, 13:16] = False  # a hole in the island
    mask[33:36, 33:36] = True
    mask[0:1, 35:40] = True  # touches the border
    filled = regions.filled_regions(plane(spark, mask, "dark", "boolean"))
    got = paint(filled, mask.shape, "region")
    want = np.full(mask.shape, -1)
    want[2:30, 2:30], want[33:36, 33:36], want[0, 35:40] = 2 * 40 + 2, 33 * 40 + 33, 35
    assert np.array_equal(got, want)
    areas = {r["region"]: r["area"] for r in regions.region_areas(filled).collect()}
    assert areas == {82: 28 * 28, 33 * 40 + 33: 9, 35: 5}


def test_gates_in_order(spark):
    yy, xx = np.mgrid[:64, :64]
    skin = np.zeros((64, 64, 3), int) + np.array([220, 170, 140])
    spot = (xx - 32) ** 2 + (yy - 32) ** 2 <= 200
    ok = skin.copy()
    ok[spot] = np.stack([90 + (xx * 7 + yy * 3) % 40, 50 + (xx * 3) % 30, 30 + (yy * 5) % 30], axis=2)[spot]
    flat = skin.copy()
    flat[spot] = [90, 50, 30]
    speck = skin.copy()
    speck[30:34, 30:34] = [90, 50, 30]
    blue = np.zeros((64, 64, 3), int) + np.array([60, 160, 220])
    strips = as_strips(spark, {1: ok, 2: flat, 3: speck, 4: blue, 5: skin[:40]})
    got = {r["image_id"]: (r["is_valid"], r["reason"]) for r in validate.validate_images(validate.strips_shape(strips), strips).collect()}
    assert got == {
        1: (True, validate.VALID), 2: (False, validate.FLAT_LESION), 3: (False, validate.NO_LESION),
        4: (False, "Insufficient skin color detected (0.0%)"), 5: (False, validate.TOO_SMALL),
    }


def test_superpixels_split_two_halves(spark):
    img = np.zeros((60, 60, 3), int)
    img[:, :30], img[:, 30:] = [200, 30, 30], [30, 30, 200]
    segs = segment.superpixels(as_strips(spark, {0: img}), 16, compactness=1.0, sigma=0)
    label = collect_plane(segs, "seg")
    assert len(np.unique(label)) == 16
    assert not set(label[:, :30].ravel()) & set(label[:, 30:].ravel())
    nodes = segment.segment_features(segs).collect()
    assert len(nodes) == 16 and all(abs(n["cx"] - 29.5) > 3 for n in nodes)


def test_enforced_segments_are_connected_and_large(spark, rng):
    img = rng.integers(0, 256, (50, 50, 3))
    segs = segment.superpixels(as_strips(spark, {0: img}), 9, compactness=1.0)
    out = paint(segment.enforce_connectivity(segs), (50, 50), "seg")
    assert (out >= 0).all()
    sizes = []
    for s in np.unique(out):
        pieces = flood(out == s, False)
        assert len(np.unique(pieces[pieces >= 0])) == 1
        sizes.append((out == s).sum())
    assert min(sizes) >= 2500 / 9 * 0.5
    # As strips: the same parts, numbered without gaps by their first pixels.
    label = collect_plane(segment.connected_superpixels(segs), "seg")
    assert label.shape == (50, 50)
    _, number = np.unique(out, return_inverse=True)
    assert (label == number.reshape(50, 50)).all()


def test_rectangle_shape(spark):
    mask = np.zeros((80, 70), bool)
    mask[10:39, 12:61] = True  # 29 x 49
    strips = plane(spark, mask, "mask", "boolean")
    m = shape.raw_moments(strips)
    assert shape.area_extent(m).first()["area"] == 29 * 49 and shape.area_extent(m).first()["extent"] == 1
    assert abs(shape.hull_perimeter(strips).first()["hull_perimeter"] - 2 * (28 + 48)) < 0.02 * 152
    assert shape.perimeter(strips).first()["perimeter"] == 2 * (29 + 49) - 4
    assert shape.boundary_length(strips).first()["boundary_length"] == 2 * (29 + 49)
    ecc = shape.eccentricity(m).first()["eccentricity"]
    assert abs(ecc - np.sqrt(1 - (29**2 - 1) / (49**2 - 1))) < 1e-9


def test_hu_invariance(spark):
    mask = np.zeros((60, 60), bool)
    mask[10:30, 8:15] = True
    mask[20:24, 15:40] = True
    a = shape.hu_moments(shape.raw_moments(plane(spark, mask, "mask", "boolean")), "central").first()
    b = shape.hu_moments(shape.raw_moments(plane(spark, np.rot90(mask), "mask", "boolean")), "central").first()
    c = shape.hu_moments(shape.raw_moments(plane(spark, np.roll(mask, (9, 11), (0, 1)), "mask", "boolean")), "central").first()
    for i in range(6):
        assert np.isclose(a[f"hu_{i}"], b[f"hu_{i}"], rtol=1e-6, atol=1e-12)
    for i in range(7):
        assert np.isclose(a[f"hu_{i}"], c[f"hu_{i}"], rtol=1e-6, atol=1e-12)


def test_lines_are_not_broadcast(spark, rng, tmp_path):
    strips = as_strips(spark, {1: rng.integers(0, 256, (5, 6, 3))})
    filled = spark.createDataFrame([(1, 2, 1, 3, 13)], "image_id int, y int, x0 int, x1 int, region bigint")
    largest = spark.createDataFrame([(1, 13, 3)], "image_id int, region bigint, area bigint")
    on_disk = []
    for name, table in (("strips", strips), ("filled", filled), ("largest", largest)):
        table.write.parquet(str(tmp_path / name))
        on_disk.append(spark.read.parquet(str(tmp_path / name)))
    plan = validate.colour_variation(*on_disk)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [image_id" in plan and plan.count("BroadcastHashJoin") <= 1  # runs with the one region of each image


def test_blocks_cut_by_batches_are_put_together(spark, rng):
    mask = rng.random((70, 9)) < 0.55
    rows = sorted(
        (r.image_id, r.y // 64, r.y, r.x0, r.x1, r.run, 1, 1)
        for r in regions.value_runs(plane(spark, mask, "dark", "boolean"), "dark").where("dark").collect()
    )
    table = pd.DataFrame(rows, columns=["image_id", "_block", "y", "x0", "x1", "run", "_value", "_reach"])
    whole = pd.concat(regions._link_in_blocks(iter([table])), ignore_index=True)
    parts = pd.concat(regions._link_in_blocks(table.iloc[i : i + 7] for i in range(0, len(table), 7)), ignore_index=True)
    assert whole.equals(parts) and len(whole) == len(table)
    label = flood(mask[:64], True)
    assert all(label[r.run // 9, r.run % 9] == r.local for r in whole.itertuples() if r.run < 64 * 9)
