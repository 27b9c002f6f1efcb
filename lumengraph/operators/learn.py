"""Splitting, scaling, selecting, training, cross-validation and prediction.

Rows are ``<id>, features array<double>, label double``. What a model learns per feature
(means, spreads) is bounded by the feature catalogue and is kept on the driver, as any
fitted model is; the rows themselves stay distributed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumengraph.functions.ordered import with_rank
from lumengraph.operators import evaluate, forest, margins, neighbours
from lumengraph.session import at_once, cut

SEED = 42


# --- samples ----------------------------------------------------------------------------------


def id_number(df: DataFrame, id_col: str) -> Column:
    """A whole number for each id: the id itself, or 32 bits of a text id's MD5."""
    if isinstance(df.schema[id_col].dataType, T.StringType):
        return F.conv(F.substring(F.md5(id_col), 1, 8), 16, 10).cast("bigint")
    return F.col(id_col)


def shuffle_key(number: Column, seed: int = SEED) -> Column:
    """A fixed pseudo-random order of whole numbers (multiplicative hashing)."""
    return F.pmod(F.pmod(number.cast("bigint"), F.lit(1 << 31)) * 2654435761 + seed * 40503, F.lit(1 << 32))


def split_dataset(df: DataFrame, id_col: str, test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``part``: the first max(1, floor(n (1 - share))) rows in shuffled order train."""
    n = df.count()
    if n < 2:
        raise ValueError("a split takes two rows or more")
    train = max(1, int(n * (1 - test_share)))
    ranked = with_rank(df.withColumn("_order", shuffle_key(id_number(df, id_col), seed)), [], "_order", id_col, "_rank")
    part = F.when(F.col("_rank") <= train, F.lit("train")).otherwise(F.lit("test"))
    return ranked.withColumn("part", part).drop("_order", "_rank")


def fold_count(df: DataFrame, k: int, label: str = "label") -> int:
    """At most the size of the smallest class, at least two."""
    smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    return max(2, min(k, smallest))


def stratified_folds(
    df: DataFrame, id_col: str, k: int = 5, shuffle: bool = True, seed: int = SEED, label: str = "label"
) -> DataFrame:
    """Add ``fold`` 0 .. k-1, each class dealt out in turn; unshuffled text ids go by their hash."""
    k = fold_count(df, k, label)
    number = id_number(df, id_col)
    order = shuffle_key(number, seed) if shuffle else number.cast("bigint")
    ranked = with_rank(df.withColumn("_order", order), [label], "_order", id_col, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_order", "_rank")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, weight`` = n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    return counts.select(label, (F.lit(float(total["n"])) / (F.col("n") * total["k"])).alias("weight"))


def training_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def require_both_classes(df: DataFrame, label: str = "label") -> None:
    if training_distribution(df, label).count() < 2:
        raise ValueError("both classes must occur in the rows to train on")


# --- features ----------------------------------------------------------------------------------


def standard_scale(long: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Long features with ``z``: distance from the mean in population spreads, 0 if constant."""
    moments = long.groupBy(name).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return long.join(moments, name).withColumn("z", z).drop("_m", "_s")


def f_scores(long: DataFrame, name: str = "name", value: str = "value", label: str = "label") -> DataFrame:
    """``name, f``: variance between classes over variance within them."""
    per_class = long.groupBy(name, label).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    total = per_class.groupBy(name).agg(
        F.sum("n").alias("n_all"), F.count("*").alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m_all"),
    )
    gap = F.col("m") - F.col("m_all")
    sums = per_class.join(total, name).groupBy(name).agg(
        F.sum(F.col("n") * gap * gap).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.first("n_all").alias("n_all"), F.first("k").alias("k"),
    )
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n_all") - F.col("k")))
    return sums.select(name, F.when(F.col("within") > 0, f).alias("f"))


def binned_information(
    long: DataFrame, id_col: str, bins: int = 10, name: str = "name", value: str = "value", label: str = "label"
) -> DataFrame:
    """``name, mi`` (nats) between the class and the feature in equally filled bins.

    Bins come from exact ranks; a column is ranked in buckets, never in one task.
    """
    ranked = with_rank(cut(long.select(id_col, name, value, label)), [name], value, id_col, "_rank")
    size = long.groupBy(name).agg(F.count("*").alias("_n"))
    cells = (
        ranked.join(size, name)
        .withColumn("_bin", F.floor((F.col("_rank") - 1) * bins / F.col("_n")).cast("int"))
        .groupBy(name, "_bin", label)
        .agg(F.count("*").alias("c"), F.first("_n").alias("_n"))
    )
    cells = cut(cells)
    by_bin = cells.groupBy(name, "_bin").agg(F.sum("c").alias("cb"))
    by_label = cells.groupBy(name, label).agg(F.sum("c").alias("cy"))
    met = cells.join(by_bin, [name, "_bin"]).join(by_label, [name, label])
    part = F.col("c") / F.col("_n") * F.log(F.col("c") * F.col("_n") / (F.col("cb") * F.col("cy")))
    return met.groupBy(name).agg(F.sum(part).alias("mi"))


def select_k_best(scores: DataFrame, score: str, k: int = 100, name: str = "name") -> DataFrame:
    """The ``k`` features with the highest score; a report of the catalogue, not of the rows."""
    return scores.where(F.col(score).isNotNull()).orderBy(F.desc(score), name).limit(k)


def select_features(long: DataFrame, id_col: str, method: str = "mutual_info", k: int = 100) -> DataFrame:
    """Names of the best features; an unknown method falls back to mutual information by neighbours."""
    if method == "f_classif":
        return select_k_best(f_scores(long), "f", k)
    if method == "binned":
        return select_k_best(binned_information(long, id_col), "mi", k)
    return select_k_best(neighbours.mutual_information(long, id_col), "mi", k)


def nan_to_zero(features: str = "features") -> Column:
    return F.transform(features, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))


@dataclass
class Scaler:
    """Means and population spreads; constant features become 0."""

    means: list[float]
    spreads: list[float]

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features") -> Scaler:
        vector = array_to_vector(nan_to_zero(features)).alias("v")
        row = df.select(vector).select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
        n = row["count"]
        sample = np.asarray(row["variance"].toArray())
        spread = np.sqrt(sample * (n - 1) / n) if n > 1 else np.zeros_like(sample)
        return cls([float(m) for m in row["mean"].toArray()], [float(s) for s in spread])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        mean = F.array(*[F.lit(m) for m in self.means])
        spread = F.array(*[F.lit(s) for s in self.spreads])
        zipped = F.arrays_zip(nan_to_zero(features).alias("v"), mean.alias("m"), spread.alias("s"))
        scaled = lambda t: F.when(t["s"] > 0, (t["v"] - t["m"]) / t["s"]).otherwise(F.lit(0.0))
        return df.withColumn(features, F.transform(zipped, scaled))


# --- models -----------------------------------------------------------------------------------


def fourier_features(features: Column, gamma: float, size: int, seed: int = SEED) -> Column:
    """Random cosine features whose inner products approach exp(-gamma |x - y|^2).

    The frequencies are drawn from the seed inside each task; a batch of rows is one
    matrix product.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def cosines(column: pd.Series) -> pd.Series:
        rows = np.vstack(column.to_numpy())
        rng = np.random.default_rng(seed)
        waves = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(rows.shape[1], size))
        phase = rng.uniform(0.0, 2.0 * np.pi, size=size)
        return pd.Series(list(np.sqrt(2.0 / size) * np.cos(rows @ waves + phase)))

    return cosines(features)


def count_sketches(values: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """The spectra of count sketches of rows: each feature is added to one of ``size`` places with a sign of its own."""
    place, sign = rng.integers(0, size, values.shape[1]), rng.choice([-1.0, 1.0], values.shape[1])
    added = np.zeros((values.shape[1], size))
    added[np.arange(values.shape[1]), place] = sign
    return np.fft.rfft(values @ added, axis=1)


def tensor_sketch(features: Column, gamma: float, degree: int, size: int, seed: int = SEED) -> Column:
    """Features whose inner products approach (gamma <x, y>) ** degree (Pham and Pagh 2013).

    The product of the spectra of independent count sketches is the spectrum of a count sketch
    of the tensor power, which is never formed. The error of an inner product has a standard
    deviation of at most sqrt(3 ** degree / size) gamma ** degree |x| ** degree |y| ** degree.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sketched(column: pd.Series) -> pd.Series:
        rows = np.vstack(column.to_numpy()) * np.sqrt(gamma)
        rng = np.random.default_rng(seed)
        spectrum = count_sketches(rows, size, rng)
        for _ in range(degree - 1):
            spectrum = spectrum * count_sketches(rows, size, rng)
        return pd.Series(list(np.fft.irfft(spectrum, size, axis=1)))

    return sketched(features)


@dataclass
class Params:
    """Training parameters; the defaults are those of the original classifiers.

    A ``max_depth`` of 0 is no limit. ``converged`` of the fitted model says whether the margins
    met ``tolerance`` within ``max_iter`` rounds.
    """

    kind: str = "svm"
    c: float = 10.0
    gamma: str | float = "scale"
    kernel: str = "rbf"
    degree: int = 3
    fourier_size: int = 512
    sketch_size: int = 1024
    max_iter: int = 500
    tolerance: float = 1e-2
    trees: int = 200
    max_depth: int = 0
    min_split: int = 2
    min_leaf: int = 1
    seed: int = SEED


@dataclass
class Forest:
    """The nodes of a fitted forest, the edges of its bins, its class weights and how it is read."""

    nodes: DataFrame
    edges: list[np.ndarray]
    plan: forest.Plan
    reading: forest.Reading

    def probability(self, df: DataFrame) -> DataFrame:
        """``df`` and ``probability`` of class 1, from its column ``features``."""
        keep = df.columns
        few = self.nodes.count() <= forest.MOST_BROADCAST
        if few:
            rows = df.select(F.struct(*keep).alias("row"), "features", F.lit(-1).alias("fold"))
            binned = forest.to_bins(rows, self.edges, ["row", "fold"])
            scored = forest.score(binned, ["row"], self.nodes, [self.plan], [self.reading], len(self.edges))
            return scored.select("row.*", F.col("scores")[0].alias("probability"))
        # too many nodes to send to the rows: rows are numbered, scored where the nodes are, and met again
        numbered = cut(df.withColumn("_nth", F.monotonically_increasing_id()))
        binned = cut(forest.to_bins(numbered.withColumn("fold", F.lit(-1)), self.edges, ["_nth", "fold"]))
        scored = forest.score(binned, ["_nth"], self.nodes, [self.plan], [self.reading], len(self.edges))
        return numbered.join(scored.select("_nth", F.col("scores")[0].alias("probability")), "_nth").select(*keep, "probability")


@dataclass
class Classifier:
    """A fitted scaler and model; ``predict`` adds ``prediction`` and ``probability``."""

    params: Params
    scaler: Scaler
    model: Forest | margins.Plane
    calibration: LogisticRegressionModel | None = None
    gamma: float = 0.0
    converged: bool = True
    #: Names of the features in use and their places in the array; none: all.
    selected: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        scaled = self.scaler.transform(chosen_features(df, self.places))
        if self.params.kind == "rf":
            out = self.model.probability(scaled)
            return out.select(*keep, (F.col("probability") > 0.5).cast("int").alias("prediction"), "probability")
        out = scaled.withColumn("margin", self.model.margin(kernel_features(self.params, self.gamma)))
        out = out.select(*keep, (F.col("margin") > 0).cast("int").alias("prediction"), "margin")
        slope, offset = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("margin") * slope + offset)))
        return out.withColumn("probability", p)


def _rbf_gamma(scaled: DataFrame, setting: str | float) -> float:
    if not isinstance(setting, str):
        return float(setting)
    d = scaled.select(F.size("features")).first()[0]
    if setting == "auto":
        return 1.0 / d
    spread = scaled.select(F.explode("features").alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (d * spread) if spread > 0 else 1.0


KERNELS = ("rbf", "linear", "poly")


def kernel_features(params: Params, gamma: float, features: str = "features") -> Column:
    """The features in which a plane stands for the kernel."""
    if params.kernel == "rbf":
        return fourier_features(F.col(features), gamma, params.fourier_size, params.seed)
    if params.kernel == "poly":
        return tensor_sketch(F.col(features), gamma, params.degree, params.sketch_size, params.seed)
    return F.col(features)


def kernel_width(params: Params, width: int) -> int:
    return {"rbf": params.fourier_size, "poly": params.sketch_size, "linear": width}[params.kernel]


def _weights(df: DataFrame) -> tuple[float, float]:
    """The balanced weights of class 0 and 1."""
    found = {int(r["label"]): r["weight"] for r in class_weights(df).collect()}
    return found[0], found[1]


def _for_forest(df: DataFrame, id_col: str, fold: Column, edges: list[np.ndarray]) -> DataFrame:
    """The rows a forest is grown from, written and dealt over all cores, as each meets many trees; an id is known by its hash."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.repartition(max(2 * cores, 8), id_col).select(F.xxhash64(id_col).alias("key"), fold.cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "features")
    return cut(forest.to_bins(rows, edges, ["key", "fold", "label"]).select("key", "fold", "label", "bins"))


def _grow(scaled: DataFrame, id_col: str, params: Params) -> Forest:
    edges = forest.bin_edges(scaled)
    plan = forest.Plan(-1, params.min_leaf, _weights(scaled))
    nodes = forest.grow(_for_forest(scaled, id_col, F.lit(-1), edges), [plan], params.trees, len(edges), params.seed)
    return Forest(nodes, edges, plan, forest.Reading(params.trees, params.max_depth, params.min_split))


def chosen_features(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """``features`` cut down to some places of the array; all if none are given."""
    return df.withColumn("features", F.array(*[F.col("features")[p] for p in places])) if places else df


def train(
    df: DataFrame, id_col: str, params: Params | None = None, scaler: Scaler | None = None,
    names: Sequence[str] = (), selected: Sequence[str] = (),
) -> Classifier:
    """Fit scaler and model with balanced class weights, on the ``selected`` of the ``names`` of the features.

    Prediction takes the same features out of the whole array by itself.

    The support vector machine works on random Fourier features; its margins become
    probabilities by a logistic curve fitted to margins of rows left out of training.
    """
    params = params or Params()
    if params.kind not in ("svm", "rf"):
        raise ValueError(f"no classifier is called {params.kind!r}")
    require_both_classes(df)
    places = [list(names).index(n) for n in selected]
    if places:
        model = train(chosen_features(df, places), id_col, params, scaler)
        model.selected, model.places = list(selected), places
        return model
    scaler = scaler or Scaler.fit(df)
    scaled = cut(scaler.transform(df.select(id_col, "features", "label")).join(class_weights(df), "label"))
    if params.kind == "rf":
        return Classifier(params, scaler, _grow(scaled, id_col, params))
    if params.kernel not in KERNELS:
        raise ValueError(f"Unsupported kernel: {params.kernel}")
    gamma = 0.0 if params.kernel == "linear" else _rbf_gamma(scaled, params.gamma)
    rows = stratified_folds(scaled, id_col, 3).withColumn("label", F.col("label").cast("int"))
    rows = cut(rows.select("fold", "label", "weight", margins.as_bytes(kernel_features(params, gamma)).alias("x")))
    n, n_folds = rows.agg(F.count("*"), F.max("fold") + 1).first()
    held = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    weights = _weights(scaled)
    width = {"x": kernel_width(params, len(scaler.means))}
    # the planes that calibration needs and the final one are fitted in the same passes
    tasks = [margins.Task("x", f, params.c, weights, n - (held[f] if f >= 0 else 0)) for f in (*range(n_folds), -1)]
    *parts, whole = margins.fit(rows, width, tasks, params.max_iter, params.tolerance)
    planes = np.stack([p.values for p in parts], axis=1)

    @F.pandas_udf("double")
    def left_out(x: pd.Series, fold: pd.Series) -> pd.Series:
        """The margin by the plane that did not see the row."""
        values = np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1)
        return pd.Series((values * planes[:-1, fold].T).sum(axis=1) + planes[-1, fold])

    margin = cut(rows.select("label", "weight", left_out("x", "fold").alias("margin")))
    calibration = LogisticRegression(featuresCol="m", labelCol="label", weightCol="weight").fit(
        margin.select("label", "weight", array_to_vector(F.array("margin")).alias("m"))
    )
    return Classifier(params, scaler, whole, calibration, gamma, whole.converged)


def _folded(df: DataFrame, id_col: str, k: int, shuffle: bool) -> tuple[DataFrame, int]:
    folded = cut(stratified_folds(df.select(id_col, "features", "label"), id_col, k, shuffle))
    return folded, folded.agg(F.max("fold")).first()[0] + 1


def _forest_scores(folded: DataFrame, id_col: str, k: int, least: Sequence[int], readings: Sequence[forest.Reading], seed: int) -> DataFrame:
    """``fold, label, min_leaf, scores``: every row under each reading of the forests that left its fold out.

    All folds and least sizes of a leaf are grown together. Scaling would not change a tree.
    """
    folded = cut(folded.withColumn("features", nan_to_zero()))
    edges = forest.bin_edges(folded)
    weights = {f: _weights(folded.where(F.col("fold") != f)) for f in range(k)}
    plans = [forest.Plan(f, m, weights[f]) for m in least for f in range(k)]
    rows = _for_forest(folded, id_col, F.col("fold"), edges)
    # "key" is for rows that travel to their nodes; ids that repeat would be one row there
    numbered = cut(rows.withColumn("nth", F.monotonically_increasing_id()))
    n, trees = rows.count(), max(r.trees for r in readings)
    if n <= forest.WHOLE and n * trees * len(plans) > forest.MOST_KEPT:
        scored = cut(forest.left_out_scores(numbered, ["nth", "fold", "label"], plans, readings, len(edges), seed))
    else:
        nodes = forest.grow(rows, plans, trees, len(edges), seed)
        scored = forest.score(numbered, ["nth", "fold", "label"], nodes, plans, readings, len(edges))
    of = F.array(*[F.lit(p.min_leaf) for p in plans])
    return scored.select("fold", "label", of[F.col("forest")].alias("min_leaf"), "scores")


def cross_validate(
    df: DataFrame, id_col: str, params: Params | None = None, k: int = 5, shuffle: bool = False, leaky: bool = False
) -> DataFrame:
    """All metrics per fold. ``leaky`` fits the scaler on all rows before folding."""
    params = params or Params()
    folded, n_folds = _folded(df, id_col, k, shuffle)
    if params.kind == "rf":
        reading = forest.Reading(params.trees, params.max_depth, params.min_split)
        found = _forest_scores(folded, id_col, n_folds, [params.min_leaf], [reading], params.seed)
        score = F.col("scores")[0]
        return evaluate.all_metrics(found.select("fold", "label", score.alias("score"), (score > 0.5).cast("int").alias("prediction")), ["fold"])
    scaler = Scaler.fit(folded) if leaky else None

    def one(f: int) -> DataFrame:
        model = train(folded.where(F.col("fold") != f).drop("fold"), id_col, params, scaler)
        part = model.predict(folded.where(F.col("fold") == f))
        return part.select("fold", F.col("label").cast("int").alias("label"), F.col("probability").alias("score"), "prediction")

    scored, *others = at_once([lambda f=f: one(f) for f in range(n_folds)])
    for part in others:
        scored = scored.unionByName(part)
    return evaluate.all_metrics(scored, ["fold"])


def evaluate_model(model: Classifier, df: DataFrame, id_col: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(fold metrics, metrics)``: folds refitted on the given rows, and the model itself on them."""
    folds = cross_validate(df, id_col, model.params, k, shuffle=True)
    scored = evaluate.score_fallback(model.predict(df))
    return folds, evaluate.all_metrics(scored.withColumn("label", F.col("label").cast("int")))


# Searched settings; a depth of 0 is none.
SVM_GRID = {"c": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", "auto", 0.01, 0.1], "kernel": ["rbf", "linear", "poly"]}
FOREST_GRID = {"trees": [100, 200, 300], "max_depth": [0, 10, 20, 30], "min_split": [2, 5, 10], "min_leaf": [1, 2, 4]}
_TRIED = "setting string, accuracy double, precision double, recall double, f1_score double"
_COUNTS = ("tn", "fp", "fn", "tp")


def _settings(grid: dict[str, Sequence]) -> list[dict]:
    """All settings; the linear kernel has no width to search."""
    out: list[dict] = []
    for values in product(*grid.values()):
        setting = dict(zip(grid, values, strict=True))
        if setting.get("kernel") == "linear":
            setting.pop("gamma", None)
        if setting not in out:
            out.append(setting)
    return out


def _search_forests(folded: DataFrame, id_col: str, k: int, settings: list[dict]) -> list[tuple[str, int, tuple]]:
    """(setting, fold, counts). Only the least size of a leaf asks for trees of its own."""
    full = [Params(kind="rf", **s) for s in settings]
    reading = [forest.Reading(p.trees, p.max_depth, p.min_split) for p in full]
    readings, least = list(dict.fromkeys(reading)), sorted({p.min_leaf for p in full})
    found = _forest_scores(folded, id_col, k, least, readings, SEED)
    long = found.select("fold", "min_leaf", "label", F.posexplode("scores").alias("nth", "score"))
    hit = (F.col("score") > 0.5).cast("int")
    counts = [F.count_if((F.col("label") == y) & (hit == p)).alias(c) for c, (y, p) in zip(_COUNTS, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)]
    # a row for each setting and fold
    by = {(r["min_leaf"], r["nth"], r["fold"]): tuple(r[c] for c in _COUNTS) for r in long.groupBy("min_leaf", "nth", "fold").agg(*counts).collect()}
    return [
        (json.dumps(s, sort_keys=True), f, by[p.min_leaf, readings.index(r), f])
        for s, p, r in zip(settings, full, reading, strict=True) for f in range(k)
    ]


def _search_margins(folded: DataFrame, id_col: str, k: int, settings: list[dict]) -> list[tuple[str, int, tuple]]:
    """(setting, fold, counts). A fold is scaled once and mapped once for each kernel and width; all planes step together."""
    of = [Params(kind="svm", **s) for s in settings]
    maps = list(dict.fromkeys((p.kernel, p.gamma if p.kernel != "linear" else 0.0) for p in of))
    by_map = [next(p for p in of if p.kernel == kernel and (kernel == "linear" or p.gamma == gamma)) for kernel, gamma in maps]

    def mapped(f: int) -> tuple[DataFrame, int, tuple[float, float], int]:
        others = folded.where(F.col("fold") != f)
        scaler = Scaler.fit(others)
        rows = cut(scaler.transform(folded).select("fold", F.col("label").cast("int").alias("label"), "features"))
        seen = rows.where(F.col("fold") != f)
        spread = {g: _rbf_gamma(seen, g) for g in {p.gamma for p in by_map}}
        x = [margins.as_bytes(kernel_features(p, spread[p.gamma])).alias(f"x{f}_{i}") for i, p in enumerate(by_map)]
        return cut(rows.select("fold", "label", *x)), seen.count(), _weights(others), len(scaler.means)

    def one(f: int) -> list[tuple[str, int, tuple]]:
        rows, n, weights, width = mapped(f)
        widths = {f"x{f}_{i}": kernel_width(p, width) for i, p in enumerate(by_map)}
        own = [f"x{f}_{maps.index((p.kernel, p.gamma if p.kernel != 'linear' else 0.0))}" for p in of]
        tasks = [margins.Task(x, f, p.c, weights, n) for x, p in zip(own, of, strict=True)]
        planes = margins.fit(rows, widths, tasks, of[0].max_iter, of[0].tolerance)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = batch.column("label").to_numpy()
                values = {x: np.frombuffer(b"".join(batch.column(x).to_pylist()), np.float64).reshape(len(label), -1) for x in widths}
                hits = [values[x] @ p.values[:-1] + p.values[-1] > 0 for x, p in zip(own, planes, strict=True)]
                counts = np.array([np.bincount(2 * label + hit, minlength=4) for hit in hits])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), *map(pa.array, counts.T)], ["nth", *_COUNTS])

        counted = rows.where(F.col("fold") == f).mapInArrow(count, "nth long, tn long, fp long, fn long, tp long")
        got = {r["nth"]: tuple(r[c] for c in _COUNTS) for r in counted.groupBy("nth").agg(*[F.sum(c).alias(c) for c in _COUNTS]).collect()}
        return [(json.dumps(s, sort_keys=True), f, got[i]) for i, s in enumerate(settings)]

    return [row for rows in at_once([lambda f=f: one(f) for f in range(k)]) for row in rows]


def _rates(counts: tuple) -> tuple[float, float, float, float]:
    """accuracy, precision, recall and F1 from tn, fp, fn, tp; 0 where there is nothing to divide by."""
    tn, fp, fn, tp = counts
    return (tn + tp) / max(1, sum(counts)), tp / max(1, tp + fp), tp / max(1, tp + fn), 2 * tp / max(1, 2 * tp + fp + fn)


def grid_search(
    df: DataFrame, id_col: str, kind: str = "svm", grid: dict[str, Sequence] | None = None, k: int = 5
) -> tuple[DataFrame, Classifier]:
    """``(settings with mean accuracy, precision, recall and F1 of the folds, best first; classifier refitted with the best)``.

    Rows are put into folds once; what settings have in common is done once.
    """
    if kind not in ("svm", "rf"):
        raise ValueError(f"no classifier is called {kind!r}")
    settings = _settings(grid or (SVM_GRID if kind == "svm" else FOREST_GRID))
    df = df.select(id_col, "features", "label")
    require_both_classes(df)
    folded, n_folds = _folded(df, id_col, k, shuffle=False)
    search = _search_margins if kind == "svm" else _search_forests
    by_setting: dict[str, list[tuple]] = {}
    for setting, _, counts in search(folded, id_col, n_folds, settings):
        by_setting.setdefault(setting, []).append(_rates(counts))
    tried = [(setting, *[float(v) for v in np.mean(rates, axis=0)]) for setting, rates in by_setting.items()]
    tried.sort(key=lambda t: (-t[4], t[0]))
    table = df.sparkSession.createDataFrame(tried, _TRIED)
    return table, train(folded.drop("fold"), id_col, Params(kind=kind, **json.loads(tried[0][0])))


def feature_importance(model: Classifier, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """``name, importance`` in falling order: forest importances or absolute coefficients."""
    if model.params.kind == "rf":
        found = forest.importances(model.model.nodes, model.model.plan, model.params.trees).collect()
        values = np.zeros(len(model.model.edges))
        values[[r["place"] for r in found]] = [r["importance"] for r in found]
    elif model.params.kernel == "linear":
        values = np.abs(model.model.values[:-1])
    else:
        raise ValueError("a kernel model has no importance per feature")
    rows = sorted(((n, float(v)) for n, v in zip(names, values, strict=True)), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows, "name string, importance double")


# --- storage -----------------------------------------------------------------------------------


def save_model(model: Classifier, path: str, spark: SparkSession) -> dict[str, str]:
    """Write model, scaler and, if any, the selected names as three parts under ``path``."""
    paths = {"model": f"{path}/classifier", "scaler": f"{path}/scaler", "feature_selector": f"{path}/feature_selector"}
    grown = model.params.kind == "rf"
    if grown:
        model.model.nodes.write.mode("overwrite").parquet(paths["model"])
    else:
        plane = list(enumerate(model.model.values.tolist()))
        spark.createDataFrame(plane, "place int, value double").coalesce(1).write.mode("overwrite").parquet(paths["model"])
    if model.calibration is not None:
        model.calibration.write().overwrite().save(f"{path}/calibration")
    scaler = spark.createDataFrame(
        list(zip(range(len(model.scaler.means)), model.scaler.means, model.scaler.spreads)),
        "place int, mean double, spread double",
    )
    scaler.coalesce(1).write.mode("overwrite").parquet(paths["scaler"])
    # What the description does not name is not read, so a folder left by another model does no harm.
    meta = {"params": vars(model.params), "gamma": model.gamma, "selected": bool(model.selected), "calibrated": model.calibration is not None, "converged": model.converged}
    if grown:
        meta |= {"edges": [e.tolist() for e in model.model.edges], "weights": list(model.model.plan.weights)}
    meta = json.dumps(meta)
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    if not model.selected:
        del paths["feature_selector"]
        return paths
    names = spark.createDataFrame(list(zip(range(len(model.selected)), model.selected, model.places)), "nth int, name string, place int")
    names.coalesce(1).write.mode("overwrite").parquet(paths["feature_selector"])
    return paths


def load_model(path: str, spark: SparkSession) -> Classifier:
    """Read what ``save_model`` wrote; the kind of model is checked against its description."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    params = Params(**meta["params"])
    if params.kind not in ("svm", "rf"):
        raise ValueError(f"no classifier is called {params.kind!r}")
    rows = spark.read.parquet(f"{path}/scaler").orderBy("place").collect()
    scaler = Scaler([r["mean"] for r in rows], [r["spread"] for r in rows])
    picked = spark.read.parquet(f"{path}/feature_selector").orderBy("nth").collect() if meta.get("selected") else []
    chosen = {"selected": [r["name"] for r in picked], "places": [r["place"] for r in picked]}
    if params.kind == "rf":
        plan = forest.Plan(-1, params.min_leaf, tuple(meta["weights"]))
        reading = forest.Reading(params.trees, params.max_depth, params.min_split)
        nodes = spark.read.schema(forest.NODES).parquet(f"{path}/classifier")
        return Classifier(params, scaler, Forest(nodes, [np.array(e, np.float64) for e in meta["edges"]], plan, reading), **chosen)
    values = spark.read.parquet(f"{path}/classifier").orderBy("place").collect()
    model = margins.Plane(np.array([r["value"] for r in values]), meta["converged"])
    calibration = LogisticRegressionModel.load(f"{path}/calibration") if meta.get("calibrated", True) else None
    return Classifier(params, scaler, model, calibration, meta["gamma"], meta["converged"], **chosen)
