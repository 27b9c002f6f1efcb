import itertools
import math

import numpy as np
import pytest

from lumengraph.operators import distances, graph, measures, spectral


def table(spark, graphs):
    nodes = [(g, n) for g, (size, _) in graphs.items() for n in range(size)]
    edges = [(g, min(a, b), max(a, b), float(w)) for g, (_, es) in graphs.items() for a, b, w in es]
    return (
        spark.createDataFrame(nodes, "image_id string, node int"),
        spark.createDataFrame(edges, "image_id string, src int, dst int, weight double"),
    )


def complete(n, w=1.0):
    return n, [(a, b, w) for a, b in itertools.combinations(range(n), 2)]


GRAPHS = {
    "path5": (5, [(i, i + 1, 1.0) for i in range(4)]),
    "cycle6": (6, [(i, (i + 1) % 6, 1.0) for i in range(6)]),
    "star6": (6, [(0, i, 1.0) for i in range(1, 6)]),
    "k5": complete(5),
    "two": (5, [(0, 1, 0.5), (1, 2, 0.5), (3, 4, 0.25)]),
}


@pytest.fixture(scope="module")
def tiny(spark):
    return table(spark, GRAPHS)


def by(df, value, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r[value] for r in df.collect()}


def test_closed_forms(tiny):
    nodes, edges = tiny
    density = by(measures.density(nodes, edges), "density", "image_id")
    assert density["k5"] == 1 and math.isclose(density["path5"], 0.4) and math.isclose(density["star6"], 1 / 3)
    trans = by(measures.transitivity(nodes, edges), "transitivity", "image_id")
    assert trans["k5"] == 1 and trans["cycle6"] == 0
    clus = by(measures.clustering_weighted(nodes, edges), "clustering", "image_id", "node")
    assert all(math.isclose(clus[("k5", i)], 1) for i in range(5)) and clus[("star6", 0)] == 0
    hops = distances.hop_sums(nodes, measures.costs(edges, "hops"))
    eff = by(measures.global_efficiency(nodes, hops), "global_efficiency", "image_id")
    assert math.isclose(eff["k5"], 1) and math.isclose(eff["star6"], (10 + 20 * 0.5) / 30)
    ecc = by(measures.eccentricity(nodes, hops), "eccentricity", "image_id", "node")
    assert ecc[("path5", 0)] == 4 and ecc[("path5", 2)] == 2 and ecc[("two", 0)] == float("inf")
    local = by(measures.local_efficiency(nodes, edges), "local_efficiency", "image_id")
    assert math.isclose(local["k5"], 1) and local["cycle6"] == 0
    rich = by(measures.rich_club(nodes, edges), "rich_club_coefficient", "image_id")
    assert math.isclose(rich["k5"], 3 / 4)  # k = 1, 2, 3 give 1, k = 4 no node
    asso = by(measures.assortativity(nodes, edges), "assortativity", "image_id")
    assert asso["cycle6"] == 0 and math.isclose(asso["star6"], -1)


def test_betweenness_with_ties(tiny):
    nodes, edges = tiny
    got = by(measures.betweenness(nodes, edges), "betweenness", "image_id", "node")
    assert math.isclose(got[("path5", 2)], 4 * 2 / 12)
    assert math.isclose(got[("star6", 0)], 1)
    assert all(math.isclose(got[("cycle6", i)], 4 / 20) for i in range(6))  # opposite nodes tie
    assert got[("k5", 0)] == 0


def test_path_length_of_parts(tiny):
    nodes, edges = tiny
    comps = graph.connected_components(nodes, edges)
    assert by(comps, "component", "image_id", "node")[("two", 4)] == 3
    dist = distances.distance_sums(nodes, measures.costs(edges, "weight"))
    got = by(measures.char_path_length(nodes, dist, comps), "char_path_length", "image_id")
    assert math.isclose(got["two"], ((0.5 + 0.5 + 1.0) / 3 * 3 + 0.25 * 2) / 5)
    fixed = graph.repair_connectivity(nodes, edges, comps).where("image_id = 'two'").collect()
    assert (0, 3, 0.01) in {(r["src"], r["dst"], r["weight"]) for r in fixed}


def test_components_of_long_and_random_graphs(spark, rng):
    path = [(("p"), i, i + 1, 1.0) for i in range(300)]
    loose = [("r", int(a), int(b), 1.0) for a, b in rng.integers(0, 200, (150, 2)) if a != b]
    hub = [("h", 0, i, 1.0) for i in range(1, 400)]
    nodes = [("p", i) for i in range(301)] + [("r", i) for i in range(200)] + [("h", i) for i in range(400)]
    perm = {g: dict(zip(range(500), rng.permutation(500).tolist())) for g in "prh"}
    edges = [(g, perm[g][a], perm[g][b], w) for g, a, b, w in path + loose + hub]
    nodes = [(g, perm[g][n]) for g, n in nodes]
    got = by(
        graph.connected_components(
            spark.createDataFrame(nodes, "image_id string, node int"),
            spark.createDataFrame(edges, "image_id string, src int, dst int, weight double"),
        ),
        "component", "image_id", "node",
    )
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for g, a, b, _ in edges:
        ra, rb = find((g, a)), find((g, b))
        root[max(ra, rb)] = min(ra, rb)
    want = {n: find(n)[1] for n in nodes}
    assert got == want


def test_similarity_join_finds_all_pairs(spark, rng):
    rows = [(i % 2, i, *[float(v) for v in rng.normal(0, 40, 3)], *[float(v) for v in rng.normal(0, 1, 2)]) for i in range(120)]
    nodes = spark.createDataFrame(rows, "image_id int, node int, l double, a double, b double, cy double, cx double")

    def sim(p, q):
        c = math.dist(p[2:5], q[2:5])
        d = math.dist(p[5:], q[5:])
        return 0.7 * (1 - min(c / 100, 1)) + 0.3 * (1 - min(d / math.sqrt(2), 1))

    for threshold in (0.9, 0.75, 0.5, 0.2, 0.0):
        want = {(p[0], p[1], q[1]) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] and sim(p, q) > threshold}
        got = {(r["image_id"], r["src"], r["dst"]) for r in graph.build_edges(nodes, threshold).collect()}
        assert got == want, threshold
    with pytest.raises(ValueError):
        graph.build_edges(nodes, -0.1)


def test_extreme_eigenvalues(spark, rng):
    graphs = dict(GRAPHS)
    for n in (8, 15, 20):
        graphs[f"r{n}"] = (n, [(a, b, float(rng.random() + 0.1)) for a, b in itertools.combinations(range(n), 2) if b == a + 1 or rng.random() < 0.4])
    nodes, edges = table(spark, graphs)
    comps = graph.connected_components(nodes, edges)
    got = {r["image_id"]: r for r in spectral.extreme_eigenvalues(nodes, edges, comps).collect()}
    energy = by(spectral.energies(spectral.normalized_laplacian(nodes, edges)), "energy", "image_id")
    for g, (n, es) in graphs.items():
        a = np.zeros((n, n))
        for u, v, w in es:
            a[u, v] = a[v, u] = w
        s = a.sum(axis=1)
        lap = np.eye(n) - a / np.sqrt(np.outer(s, s))
        values = np.sort(np.linalg.eigvalsh(lap))
        assert abs(got[g]["spectral_radius"] - values[-1]) < 1e-6, g
        assert abs(got[g]["spectral_gap"] - (values[1] - values[0])) < 1e-6, g
        assert abs(energy[g] - np.abs(values).sum()) < 1e-9


def test_moments_and_bands(spark, rng):
    nodes, edges = table(spark, {"k": complete(7, 0.5)})
    signal = spark.createDataFrame([("k", i, float(rng.normal())) for i in range(7)], "image_id string, node int, l double")
    x = np.array([r["l"] for r in sorted(signal.collect(), key=lambda r: r["node"])])
    lap = spectral.normalized_laplacian(nodes, edges)
    dense = np.eye(7) * (1 + 1 / 6) - np.ones((7, 7)) / 6
    got = by(spectral.spectral_moments(lap, signal, 4, ["l"]), "moment", "k")
    for k in range(5):
        assert abs(got[k] - x @ np.linalg.matrix_power(dense, k) @ x) < 1e-9
    power = by(spectral.band_power(spectral.chebyshev_moments(lap, signal)), "power", "band")
    assert abs(sum(power.values()) - x @ x) < 1e-9


def test_sums_over_distances_are_those_of_all_pairs(spark, rng):
    """Batches of few sources; graphs of one word and of several, in parts, with ties and a lone node."""
    nodes, edges = [], []
    for name, n, m in (("big", 66, 420), ("small", 7, 9), ("lone", 1, 0)):
        nodes += [(name, 3 * i) for i in range(n)]
        pairs = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(m)}
        edges += [(name, 3 * a, 3 * b, float(rng.integers(1, 5)) / 4) for a, b in pairs]
    nodes = spark.createDataFrame(nodes, "image_id string, node int")
    edges = spark.createDataFrame(edges, "image_id string, src int, dst int, weight double")
    for kind, found in (("hops", lambda arcs: distances.hop_sums(nodes, arcs, words=1)), ("weight", lambda arcs: distances.distance_sums(nodes, arcs, sources=40))):
        arcs = measures.costs(edges, kind)
        want: dict = {}
        for r in measures.shortest_paths(nodes, arcs).collect():
            reached, total, far, inverse = want.get((r["image_id"], r["t"]), (0, 0.0, 0.0, 0.0))
            want[r["image_id"], r["t"]] = (reached + 1, total + r["d"], max(far, r["d"]), inverse + (1 / r["d"] if r["d"] else 0))
        got = {(r["image_id"], r["node"]): tuple(r[c] for c in ("reached", "total", "farthest", "inverse")) for r in found(arcs).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    whole, parts = (by(measures.betweenness(nodes, edges, batch=b), "betweenness", "image_id", "node") for b in (64, 40))
    assert whole.keys() == parts.keys() and all(math.isclose(whole[k], parts[k], abs_tol=1e-12) for k in whole)
