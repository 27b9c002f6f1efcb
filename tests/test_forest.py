"""Forests against a plain grower, and grid searches against one setting at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengraph.operators import forest, learn
from lumengraph.session import cut

N, D = 240, 7
PLANS = [forest.Plan(-1, 1, (1.0, 1.25)), forest.Plan(2, 3, (0.75, 1.5))]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, D))
    x[:, 3], x[:, 4] = 1.0, np.round(x[:, 4])
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=N) > 0).astype(int)
    df = spark.createDataFrame([(i, i % 5, int(y[i]), x[i].tolist()) for i in range(N)], "key long, fold int, label int, features array<double>")
    edges = forest.bin_edges(df)
    return cut(forest.to_bins(df, edges, ["key", "fold", "label"]).select("key", "fold", "label", "bins")), x, y, edges


def plain_tree(bins, label, drawn, seed, plan) -> dict:
    """One tree, node by node: its split or None, and its counts."""
    look = max(1, int(math.sqrt(D)))
    weights = np.array(plan.weights)

    def node(rows, seed) -> dict:
        counts = [len(rows), *(int(drawn[rows][label[rows] == c].sum()) for c in (0, 1))]
        out = {"counts": counts, "split": None}
        if 0 in counts[1:] or len(rows) < 2 * plan.min_leaf:
            return out
        for turn in range(-(-D // look)):
            best = None
            for f in forest.features_of(np.array([seed]), np.array([turn]), D, look)[0]:
                for b in np.unique(bins[rows, f]) if f >= 0 else ():
                    left = bins[rows, f] <= b
                    if min(left.sum(), (~left).sum()) < max(plan.min_leaf, 1):
                        continue
                    sides = [np.array([drawn[rows[s]][label[rows[s]] == c].sum() for c in (0, 1)]) * weights for s in (left, ~left)]
                    purity = sum((s**2).sum() / s.sum() for s in sides)
                    if best is None or (-purity, f, b) < best[0]:
                        best = ((-purity, f, b), left)
            if best is not None:
                (_, f, b), left = best
                one, two = forest.child_seeds(np.array([seed]))
                return {**out, "split": (int(f), int(b)), "below": (node(rows[left], one), node(rows[~left], two))}
        return out

    return node(np.flatnonzero(drawn > 0), seed)


def table_trees(nodes) -> dict:
    """The same trees from a table of nodes, by forest and tree."""
    rows = nodes.collect()
    of = {(r.forest, r.tree, r.block, r.node): r for r in rows}
    under = {(r.forest, r.tree, r.under): r for r in rows if r.block >= 0 and r.node == 0}

    def tree(r) -> dict:
        out = {"counts": [r.n, r.c0, r.c1], "split": None}
        if r.feature < 0:
            return out
        find = lambda i: of.get((r.forest, r.tree, r.block, i)) or under[r.forest, r.tree, i]
        below = (tree(find(r.left)), tree(find(r.right)))
        assert [r.left0, r.left1] == below[0]["counts"][1:]
        return {**out, "split": (r.feature, r.bin), "below": below}

    keys = {(r.forest, r.tree) for r in rows}
    return {k: tree(of.get((*k, -1, 0)) or under[(*k, 0)]) for k in keys}


@pytest.mark.parametrize("limits", [{}, {"small": 40}, {"small": 40, "most_open": 40}])
def test_trees_are_those_of_a_plain_grower(sample, limits):
    """Whole trees in one task; levels over all rows above small blocks; levels in waves of trees."""
    rows, _, _, _ = sample
    got = table_trees(forest.grow(rows, PLANS, 3, D, seed=5, **limits))
    have = sorted(rows.collect(), key=lambda r: r.key)
    bins = np.array([list(r.bins) for r in have], np.int64)
    key, fold, label = (np.array([r[c] for r in have]) for c in ("key", "fold", "label"))
    for f, plan in enumerate(PLANS):
        seeds = forest.tree_seeds(5, plan.fold, np.arange(3))
        drawn = forest.draws(key, seeds)
        drawn[fold == plan.fold] = 0
        for t in range(3):
            assert got[f, t] == plain_tree(bins, label, drawn[:, t], seeds[t], plan)


def test_scores_are_those_of_stopped_trees(sample):
    """Depth, size and number of trees are read off one forest, from broadcast nodes and from blocks."""
    rows, _, _, _ = sample
    readings = [forest.Reading(3), forest.Reading(2, 3), forest.Reading(3, 0, 20), forest.Reading(1, 5, 10)]
    for small in (forest.SMALL, 40):
        nodes = forest.grow(rows, PLANS, 3, D, seed=5, small=small)
        trees = table_trees(nodes)

        def share(tree, row, reading, weights, depth=0):
            if tree["split"] is None or tree["counts"][0] < reading.min_split or (reading.max_depth and depth >= reading.max_depth):
                c0, c1 = (c * w for c, w in zip(tree["counts"][1:], weights, strict=True))
                return c1 / (c0 + c1)
            f, b = tree["split"]
            return share(tree["below"][int(row[f] > b)], row, reading, weights, depth + 1)

        want = {}
        for r in rows.collect():
            for f, plan in enumerate(PLANS):
                if plan.fold in (-1, r.fold):
                    want[r.key, f] = [np.mean([share(trees[f, t], r.bins, g, plan.weights) for t in range(g.trees)]) for g in readings]
        for most in (forest.MOST_BROADCAST, 0):
            got = {(r.key, r.forest): r.scores for r in forest.score(rows, ["key"], nodes, PLANS, readings, D, most).collect()}
            assert got.keys() == want.keys()
            assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_features_of_a_node_are_all_features_once():
    for width in (1, 2, 7, 64, 983):
        look = max(1, int(math.sqrt(width)))
        seeds = forest.tree_seeds(1, 0, np.arange(20))
        turns = -(-width // look)
        looked = np.concatenate([forest.features_of(seeds, np.full(20, t), width, look) for t in range(turns)], axis=1)
        assert all(sorted(x[x >= 0].tolist()) == list(range(width)) for x in looked)


def test_deep_tree(spark):
    """A row of alternating classes asks for a depth no library limit allows."""
    df = spark.createDataFrame([(i, [float(i)], float(i % 2)) for i in range(200)], "id long, features array<double>, label double")
    model = learn.train(df, "id", learn.Params("rf", trees=30))
    assert model.model.nodes.agg(F.max("depth")).first()[0] > 7
    got = model.predict(df)
    assert got.where("prediction = label").count() > 190


def test_importance(spark, sample):
    rows, x, y, _ = sample
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(N)], "id long, features array<double>, label double")
    model = learn.train(df, "id", learn.Params("rf", trees=40))
    found = {r["name"]: r["importance"] for r in learn.feature_importance(model, list("abcdefg"), spark).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and found["d"] == 0 and max(found, key=found.get) == "a"
    # Gini decrease from the tree itself
    trees = table_trees(model.model.nodes)
    weights = np.array(model.model.plan.weights)
    total = np.zeros(D)
    for tree in trees.values():
        own = np.zeros(D)

        def walk(node):
            w = np.array(node["counts"][1:]) * weights
            impure = w.sum() - (w**2).sum() / w.sum()
            if node["split"] is not None:
                less = impure - sum(walk(b) for b in node["below"])
                own[node["split"][0]] += less  # noqa: B023
            return impure

        walk(tree)
        total += own / own.sum()
    assert np.allclose([found[c] for c in "abcdefg"], total / len(trees), atol=1e-9)


def test_grid_is_one_setting_at_a_time(spark, sample):
    """Metrics of a setting in the grid are those of its own cross-validation."""
    _, x, y, _ = sample
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(N)], "id long, features array<double>, label double")
    grid = {"trees": [5, 10], "max_depth": [0, 2], "min_split": [2, 20], "min_leaf": [1, 4]}
    table, model = learn.grid_search(df, "id", "rf", grid, 3)
    tried = {r["setting"]: r for r in table.collect()}
    assert len(tried) == 16 and model.params.kind == "rf"
    for setting in learn._settings(grid)[::5]:
        folds = learn.cross_validate(df, "id", learn.Params("rf", **setting), 3).collect()
        row = tried[learn.json.dumps(setting, sort_keys=True)]
        for name in ("accuracy", "precision", "recall", "f1_score"):
            assert abs(row[name] - np.mean([f[name] for f in folds])) < 1e-9
    table, model = learn.grid_search(df, "id", "svm", {"c": [0.1, 10.0], "gamma": ["scale"], "kernel": ["rbf", "linear", "poly"]}, 3)
    tried = {r["setting"]: r["f1_score"] for r in table.collect()}
    assert len(tried) == 6 and max(tried.values()) > 0.75
    with pytest.raises(ValueError):
        learn.grid_search(df, "id", "knn")


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_tensor_sketch_meets_the_polynomial_kernel(spark, degree):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 12))
    size, gamma = 8192, 1 / 12
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>").repartition(3)
    rows = sorted(df.select("id", learn.tensor_sketch(F.col("features"), gamma, degree, size).alias("z")).collect(), key=lambda r: r["id"])
    z = np.array([r["z"] for r in rows])
    norms = gamma ** (degree / 2) * np.linalg.norm(x, axis=1) ** degree
    error = np.abs(z @ z.T - (gamma * (x @ x.T)) ** degree) / np.outer(norms, norms)
    deviation = math.sqrt(3**degree / size)
    assert error.max() < 6 * deviation and np.sqrt((error**2).mean()) < 1.5 * deviation


def test_polynomial_classes(spark):
    """The sign of a product of three features: a plane cannot part it, a polynomial of degree 3 can."""
    rng = np.random.default_rng(4)
    x = rng.choice([-1.0, 1.0], size=(400, 3)) * rng.uniform(0.5, 1.5, size=(400, 3))
    y = (x.prod(axis=1) > 0).astype(float)
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, features array<double>, label double")
    right = {k: learn.train(df, "id", learn.Params(kernel=k)).predict(df).where("prediction = label").count() / 400 for k in ("linear", "poly")}
    assert right["linear"] < 0.8 and right["poly"] > 0.9


def test_planes_meet_the_least_value(spark):
    """Planes of several tasks in the same passes, each against a plain descent of its own function."""
    from lumengraph.operators import margins

    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=120) > 0).astype(int)
    rows = spark.createDataFrame([(i % 3, int(y[i]), x[i].tolist()) for i in range(120)], "fold int, label int, features array<double>")
    rows = cut(rows.repartition(4).select("fold", "label", margins.as_bytes(F.col("features")).alias("x")))
    tasks = [margins.Task("x", f, c, (1.0, 1.5), 80 if f >= 0 else 120) for f in (-1, 0, 2) for c in (0.1, 10.0)]
    for task, plane in zip(tasks, margins.fit(rows, {"x": 4}, tasks, 500, 1e-4), strict=True):
        own = np.arange(120) % 3 != task.fold
        s, weight = 2 * y[own] - 1, np.where(y[own] == 1, 1.5, 1.0)

        def value(w):
            z = s * (x[own] @ w[:-1] + w[-1])
            short = 1 - z
            hinge = np.where(short <= 0, 0, np.where(short < margins.ROUNDED, short**2 / (2 * margins.ROUNDED), short - margins.ROUNDED / 2))
            return (weight * hinge).mean() + w[:-1] @ w[:-1] / (2 * task.c * own.sum())

        assert plane.converged
        best = value(plane.values)
        for scale in (1e-1, 1e-2, 1e-3):
            assert all(value(plane.values + scale * rng.normal(size=5)) > best - 1e-5 for _ in range(200))
