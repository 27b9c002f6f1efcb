import struct
import zlib

import numpy as np
import pytest
from conftest import as_strips, collect_plane, plane
from pyspark.sql import functions as F

from lumengraph.operators import colourstats, raster, texture, validate
from lumengraph.sources import images


def png(path, pixels):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[pixels.shape[2]], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_files_to_strips(spark, tmp_path, rng):
    for folder in ("melanoma", "benign"):
        (tmp_path / folder).mkdir()
    pics = {"melanoma/a.png": rng.integers(0, 256, (5, 7, 3)), "benign/b.png": rng.integers(0, 256, (6, 4, 1)), "benign/c.png": rng.integers(0, 256, (3, 3, 4))}
    for name, p in pics.items():
        png(tmp_path / name, p)
    (tmp_path / "benign" / "broken.png").write_bytes(b"no picture")
    found = images.scan_images(spark, str(tmp_path))
    good, bad = images.split_readable(found)
    assert [r[0].rsplit("/", 1)[1] for r in bad.collect()] == ["broken.png"]
    strips = raster.to_strips(good).collect()
    for name, p in pics.items():
        got = sorted((r for r in strips if r["image_id"].endswith(name)), key=lambda r: r["y"])
        for c, ch in enumerate("rgb"):
            want = p[:, :, 0 if p.shape[2] == 1 else c]
            assert np.array_equal(np.array([r[ch] for r in got]), want), (name, ch)
    labels = images.label_from_directory(good, "image_id").select("label").collect()
    assert sorted(r[0] for r in labels) == [0.0, 0.0, 1.0]


def reflect(img, k, mode):
    return np.pad(img, k, mode={"reflect101": "reflect", "symmetric": "symmetric", "nearest": "edge", "zero": "constant"}[mode])


@pytest.mark.parametrize("border", ["reflect101", "symmetric", "nearest", "zero"])
def test_neighbours_across_blocks(spark, rng, border):
    img = rng.integers(0, 99, (37, 9)).astype(float)
    near = raster.with_neighbours(plane(spark, img, "v", "double"), ["v"], 3, 3, border, block=8)
    rows = {r["y"]: np.array(r["v"]) for r in near.collect()}
    padded = reflect(img, 3, border)
    assert len(rows) == 37
    for y in range(37):
        assert np.array_equal(rows[y], padded[y : y + 7]), (border, y)


def test_neighbours_none_border(spark, rng):
    img = rng.integers(0, 99, (20, 4)).astype(float)
    near = raster.with_neighbours(plane(spark, img, "v", "double"), ["v"], 0, 4, "none", side=0, block=6)
    for r in near.collect():
        assert np.array_equal(np.array(r["v"]), img[r["y"] : r["y"] + 5])


def test_convolve_matches_brute_force(spark, rng):
    img = rng.random((150, 11))
    kernel = rng.random((5, 5)).tolist()
    got = collect_plane(raster.convolve(plane(spark, img, "v", "double"), "v", kernel), "v")
    p = np.pad(img, 2, mode="reflect")
    want = sum(kernel[j][i] * p[j : j + 150, i : i + 11] for j in range(5) for i in range(5))
    assert np.allclose(got, want)


def test_resize_properties(spark):
    flat = np.full((40, 30, 3), 77)
    out = raster.resize(as_strips(spark, {1: flat}), 13, 90).collect()
    assert len(out) == 90 and all(set(r["r"]) == {77} and len(r["r"]) == 13 for r in out)
    same = np.arange(20 * 10 * 3).reshape(20, 10, 3) % 256
    back = raster.resize(as_strips(spark, {1: same}), 10, 20)
    assert np.array_equal(collect_plane(back, "g"), same[:, :, 1])


def brute_equalize(v, clip):
    """An independent reading of adaptive equalisation on a value channel in [0, 1]."""
    h, w = v.shape
    k = [max(h // 8, 1), max(w // 8, 1)]
    lo, hi = v.min(), v.max()
    levels = np.rint((v - lo) / (hi - lo) * 16383).astype(int)
    bins = levels // (1 + 16384 // 256)
    n = [-(-s // t) for s, t in zip(v.shape, k)]
    ext = np.pad(bins, [(0, n[0] * k[0] - h), (0, n[1] * k[1] - w)], mode="reflect")
    area = k[0] * k[1]
    maps = np.zeros((*n, 256))
    for i in range(n[0]):
        for j in range(n[1]):
            hist = np.bincount(ext[i * k[0] : (i + 1) * k[0], j * k[1] : (j + 1) * k[1]].ravel(), minlength=256)
            limit = max(int(clip * area), 1)
            extra = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit)
            while extra >= (hist < limit).sum() > 0:
                extra -= (hist < limit).sum()
                hist = hist + (hist < limit)
            free = [b for b in range(256) if hist[b] < limit]
            for turn in range(extra if free else 0):
                hist[free[turn * len(free) // extra]] += 1
            maps[i, j] = np.minimum(np.cumsum(hist) * (16383 / area), 16383).astype(int)
    out = np.zeros_like(v)
    for y in range(h):
        for x in range(w):
            py, fy = divmod(y + k[0] // 2, k[0])
            px, fx = divmod(x + k[1] // 2, k[1])
            fy, fx = fy / k[0], fx / k[1]
            y0, y1 = max(py - 1, 0), min(py, n[0] - 1)
            x0, x1 = max(px - 1, 0), min(px, n[1] - 1)
            b = bins[y, x]
            out[y, x] = int(
                maps[y0, x0, b] * ((1 - fy) * (1 - fx)) + maps[y0, x1, b] * ((1 - fy) * fx)
                + maps[y1, x0, b] * (fy * (1 - fx)) + maps[y1, x1, b] * (fy * fx)
            )
    return (out - out.min()) / (out.max() - out.min())


def test_equalize_matches_brute_force(spark, rng):
    for shape in ((48, 40), (67, 51)):
        img = np.clip(rng.normal(120, 40, (*shape, 3)), 1, 255).astype(int)
        out = raster.equalize_adaptive(as_strips(spark, {3: img}), 0.03)
        v = img.max(axis=2)
        want = brute_equalize(v / 255.0, 0.03)
        got = np.stack([collect_plane(out, c) for c in "rgb"], axis=2)
        assert np.abs(got.max(axis=2) - want).max() < 1e-6
        assert np.allclose(got, want[:, :, None] * img / v[:, :, None], atol=1e-6)


def test_cooccurrence_sums_and_symmetry(spark, rng):
    img = rng.integers(0, 256, (70, 12, 3))
    rows = texture.cooccurrence(as_strips(spark, {0: img})).collect()
    table = {}
    for r in rows:
        table.setdefault((r["distance"], r["angle"]), np.zeros((8, 8)))[r["i"], r["j"]] = r["p"]
    assert len(table) == 32
    for p in table.values():
        assert abs(p.sum() - 1) < 1e-12 and np.allclose(p, p.T)
    q = np.rint((img / 255.0) @ np.array([0.2125, 0.7154, 0.0721]) * 7).astype(int)
    want = np.zeros((8, 8))
    for y in range(67):  # three lines down, none across: 90 degrees, distance 3
        for x in range(12):
            want[q[y, x], q[y + 3, x]] += 1
            want[q[y + 3, x], q[y, x]] += 1
    assert np.allclose(table[(3, 4)], want / want.sum())


def test_constant_picture_texture(spark):
    strips = as_strips(spark, {0: np.full((70, 60, 3), 100)})
    props = texture.cooccurrence_properties(texture.cooccurrence(strips)).collect()
    assert all(r["contrast"] == 0 and r["energy"] == 1 and r["correlation"] == 1 and r["entropy"] == 0 for r in props)
    grads = texture.gradients(raster.gray_strips(strips))
    assert texture.gradient_statistics(grads).agg(F.max("mag_max")).first()[0] == 0
    edges = texture.edge_ratios(raster.gray_strips(strips)).first()
    assert edges["canny_edge_ratio_t50"] == 0


def test_patterns_brute_force(spark, rng):
    img = np.repeat(rng.integers(0, 256, (68, 9, 1)), 3, axis=2)
    counts = texture.binary_patterns(as_strips(spark, {0: img})).where("method = 'default'").collect()
    gray = np.floor(((img / 255.0)[:, :, 0] * 0.2125 + (img / 255.0)[:, :, 1] * 0.7154 + (img / 255.0)[:, :, 2] * 0.0721) * 255)
    p = np.pad(gray, 3)
    for radius in (1, 2, 3):
        want = {}
        for y in range(68):
            for x in range(9):
                code = 0
                for i, (y0, x0, y1, x1, fy, fx) in enumerate(texture.pattern_taps(radius)):
                    at = lambda dy, dx: p[y + 3 + dy, x + 3 + dx]  # noqa: B023, E731
                    top = (1 - fx) * at(y0, x0) + fx * at(y0, x1)
                    low = (1 - fx) * at(y1, x0) + fx * at(y1, x1)
                    code += ((1 - fy) * top + fy * low - gray[y, x] >= 0) << i
                want[code] = want.get(code, 0) + 1
        assert {r["code"]: r["n"] for r in counts if r["radius"] == radius} == want


def test_haar_keeps_energy(spark, rng):
    img = rng.random((64, 32))
    coefs = texture.wavelet_coefficients(plane(spark, img, "gray", "double"))
    total = texture.wavelet_statistics(coefs).where("family = 'haar'").agg(F.sum("energy")).first()[0]
    assert abs(total - (img**2).sum()) < 1e-9


@pytest.mark.parametrize("size", [(5, 3), (7, 9)])
def test_wavelets_of_small_pictures(spark, rng, size):
    """Lines shorter than the filters reflect more than once."""
    img = rng.random(size)

    def step(a, low):
        n = len(low)
        high = [(-1) ** (k + 1) * low[n - 1 - k] for k in range(n)]
        ext = lambda m, i: (lambda t: t if t < m else 2 * m - 1 - t)(i % (2 * m))
        half = lambda v, f: np.array([sum(f[j] * v[ext(len(v), 2 * k + 1 - j)] for j in range(n)) for k in range((len(v) + n - 1) // 2)])
        rows = {f: np.array([half(line, t) for line in a]) for f, t in (("a", low), ("d", high))}
        return {f"{v}{h}": np.array([half(c, low if v == "a" else high) for c in rows[h].T]).T for v in "ad" for h in "ad"}

    coefs = texture.wavelet_coefficients(plane(spark, img, "gray", "double"), levels=2)
    stats = {(r["family"], r["band"], r["level"]): r["energy"] for r in texture.wavelet_statistics(coefs).collect()}
    for family, low in texture.LOW_PASS.items():
        one = step(img, low)
        two = step(one["aa"], low)
        for band, key in (("horizontal", "da"), ("vertical", "ad"), ("diagonal", "dd")):
            assert abs(stats[(family, band, 2)] - (one[key] ** 2).sum()) < 1e-9
            assert abs(stats[(family, band, 1)] - (two[key] ** 2).sum()) < 1e-9
        assert abs(stats[(family, "approx", 0)] - (two["aa"] ** 2).sum()) < 1e-9


def test_gray_values(spark):
    px = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]])
    got = validate.map_strips(as_strips(spark, {0: px}), "g8", validate.colour.gray8).first()["g8"]
    assert got == [76, 150, 29, 255]


def _broadcasts(df) -> bool:
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_colours_are_not_broadcast(spark, rng, tmp_path):
    as_strips(spark, {1: rng.integers(0, 256, (5, 6, 3))}).write.parquet(str(tmp_path / "strips"))
    strips = spark.read.parquet(str(tmp_path / "strips"))  # small on disk
    assert not _broadcasts(colourstats.channel_statistics(strips))
    assert not _broadcasts(colourstats.channel_histogram(strips))
