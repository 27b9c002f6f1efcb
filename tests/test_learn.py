import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengraph.operators import assemble, evaluate, learn, results
from lumengraph.sources import images, tables


def scored(spark, rng, n=2000):
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    rows = [(int(a), float(b), int(b > 0.5), int(i % 3)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "label int, score double, prediction int, fold int"), y, s


def test_auc_is_pair_counting(spark, rng):
    df, y, s = scored(spark, rng)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert abs(evaluate.roc_auc(df).first()[0] - want) < 1e-9
    bent = df.withColumn("score", F.exp(F.col("score") * 7))
    assert abs(evaluate.roc_auc(bent).first()[0] - want) < 1e-9


def test_curves_and_short_curve(spark, rng):
    df, y, s = scored(spark, rng)
    curve = {round(r["threshold"], 6): (r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df).collect()}
    for t in np.unique(s):
        hit = s >= t
        assert np.allclose(curve[round(float(t), 6)], ((hit & (y == 0)).sum() / (y == 0).sum(), (hit & (y == 1)).sum() / (y == 1).sum()))
    short = evaluate.roc_curve(df, drop_intermediate=True)
    assert short.count() <= len(curve)
    full = sorted(curve.values())
    kept = sorted((r["fpr"], r["tpr"]) for r in short.collect())
    area = lambda pts: np.trapezoid([p[1] for p in pts], [p[0] for p in pts])
    assert abs(area(full) - area(kept)) < 1e-12


def test_metrics_by_fold(spark, rng):
    df, y, s = scored(spark, rng)
    rows = evaluate.all_metrics(df, ["fold"]).collect()
    for r in rows:
        sel = np.arange(len(y)) % 3 == r["fold"]
        yy, pp = y[sel], (s[sel] > 0.5).astype(int)
        assert abs(r["accuracy"] - (yy == pp).mean()) < 1e-12
        assert abs(r["mcc"] - np.corrcoef(yy, pp)[0, 1]) < 1e-9
    perfect = spark.createDataFrame([(1, 1.0, 1)] * 4, "label int, score double, prediction int")
    one = evaluate.all_metrics(perfect).first()
    assert one["auc"] is None and one["recall"] == 1 and one["specificity"] == 0


def rings(spark, rng, n=300):
    """Two classes no plane can part."""
    radius = np.where(rng.integers(0, 2, n) == 1, 1.0, 2.5)
    angle = rng.uniform(0, 2 * np.pi, n)
    rows = [
        (i, [float(r * np.cos(a)), float(r * np.sin(a)), 3.0], float(r < 2))
        for i, (r, a) in enumerate(zip(radius, angle))
    ]
    return spark.createDataFrame(rows, "id int, features array<double>, label double")


@pytest.mark.parametrize("params", [learn.Params("svm", fourier_size=64), learn.Params("rf", trees=10)])
def test_models_learn_and_survive_storage(spark, rng, tmp_path, params):
    df = rings(spark, rng)
    model = learn.train(df, "id", params)
    got = model.predict(df)
    metrics = evaluate.all_metrics(evaluate.score_fallback(got).withColumn("label", F.col("label").cast("int"))).first()
    assert metrics["auc"] > 0.97 and metrics["accuracy"] > 0.9
    learn.save_model(model, str(tmp_path / "model"), spark)
    again = learn.load_model(str(tmp_path / "model"), spark).predict(df)
    a = {r["id"]: r["probability"] for r in got.collect()}
    b = {r["id"]: r["probability"] for r in again.collect()}
    assert a == b


def test_linear_kernel_importance(spark, rng):
    rows = [(i, [float(x), float(z)], float(x > 0)) for i, (x, z) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id int, features array<double>, label double")
    model = learn.train(df, "id", learn.Params("svm", kernel="linear"))
    names = [r["name"] for r in learn.feature_importance(model, ["x", "z"], spark).collect()]
    assert names == ["x", "z"]


def test_folds_and_split(spark):
    df = spark.range(103).select("id", (F.col("id") % 10 == 0).cast("double").alias("label"))
    folds = learn.stratified_folds(df, "id").groupBy("fold", "label").count().collect()
    assert {r["count"] for r in folds if r["label"] == 1} <= {2, 3} and len({r["fold"] for r in folds}) == 5
    parts = {r["part"]: r["count"] for r in learn.split_dataset(df, "id").groupBy("part").count().collect()}
    assert parts == {"train": 82, "test": 21}
    with pytest.raises(ValueError):
        learn.split_dataset(df.limit(1), "id")
    with pytest.raises(ValueError):
        learn.require_both_classes(df.where("label = 0"))


def test_scaler_fills_and_centres(spark):
    rows = [(1, [1.0, 5.0, float("nan")]), (2, [3.0, 5.0, None]), (3, [5.0, 5.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    scaler = learn.Scaler.fit(df)
    out = {r["id"]: r["features"] for r in scaler.transform(df).collect()}
    assert np.allclose([out[i][0] for i in (1, 2, 3)], np.array([-1, 0, 1]) * np.sqrt(1.5))
    assert all(out[i][1:] == [0.0, 0.0] for i in out)


def test_appending_twice_adds_nothing(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("string").alias("analysis_id"), F.timestamp_seconds(F.col("id") * 9000).alias("timestamp"))
    path = str(tmp_path / "results")
    tables.append_analysis_results(rows.limit(12), path)
    tables.append_analysis_results(rows.unionByName(rows), path)
    assert spark.read.parquet(path).count() == 20


def test_catalogue_and_matrix(spark):
    names = assemble.catalogue()
    assert len(names) == len(set(names)) == 983
    long = spark.createDataFrame([("a", names[0], 1.5), ("a", names[900], float("inf")), ("b", names[982], 2.0), ("b", "unknown", 9.0)], "image_id string, name string, value double")
    got = {r["image_id"]: r["features"] for r in assemble.assemble_features(long, names).collect()}
    assert got["a"][0] == 1.5 and got["a"][900] == 0 and got["b"][982] == 2.0 and sum(got["b"]) == 2.0
    assert assemble.column_names(["x"], 3) == ["x", "feature_1", "feature_2"]


def test_history_limit_and_ingest(spark):
    records = spark.range(30).select(
        F.col("id").cast("string").alias("analysis_id"), F.lit("f").alias("filename"), F.timestamp_seconds("id").alias("timestamp"),
        F.lit(1).alias("predicted_class"), F.lit(0.7).alias("probability"),
    )
    assert [r["id"] for r in results.analysis_history(records, 3).collect()] == ["29", "28", "27"]
    uploads = spark.createDataFrame([(1, "a.png", True), (2, "b.png", False), (3, "c.png", True)], "image_id int, filename string, readable boolean")
    uploads = uploads.withColumn("at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    verdicts = spark.createDataFrame([(1, True, "fine"), (3, False, "bad")], "image_id int, is_valid boolean, reason string")
    good, bad, counts = images.ingest(uploads, verdicts)
    assert [r["stored"] for r in good.collect()] == ["20240506_070809_a.png"]
    assert {r["image_id"]: r["reason"] for r in bad.collect()} == {2: "Could not read image", 3: "bad"}
    assert counts.first().asDict() == {"saved": 3, "accepted": 1, "rejected": 2}


def test_text_ids_and_selected_features(spark, rng, tmp_path):
    """Ids as picture files have; the model takes its features out of the whole array, also when read back."""
    rows = []
    for i in range(60):
        y = i % 2
        rows.append((f"file:/{'ab'[y]}/{i}.png", [float(rng.normal()), 3.0 * y + float(rng.normal()) * 0.3, float(rng.normal()), 2.0 * y], float(y)))
    df = spark.createDataFrame(rows, "image_id string, features array<double>, label double")
    parts = learn.split_dataset(df, "image_id")
    assert parts.where("part = 'train'").count() == 48
    assert sorted(r["n"] for r in learn.stratified_folds(df, "image_id").groupBy("fold").count().withColumnRenamed("count", "n").collect()) == [12] * 5
    for params in (learn.Params(kind="svm"), learn.Params(kind="rf", trees=10)):
        model = learn.train(df, "image_id", params, names=["p", "q", "r", "s"], selected=["q", "s"])
        learn.save_model(model, f"{tmp_path}/model", spark)
        again = learn.load_model(f"{tmp_path}/model", spark)
        assert again.selected == ["q", "s"] and again.places == [1, 3] and len(again.scaler.means) == 2
        for m in (model, again):
            assert m.predict(df).where("prediction <> label").count() == 0
    # a model of all features over the folder of one of two reads nothing stale
    learn.save_model(learn.train(df, "image_id", learn.Params(kind="rf", trees=10)), f"{tmp_path}/model", spark)
    assert learn.load_model(f"{tmp_path}/model", spark).places == []


class _Stop(Exception):
    pass


def test_registered_learn_queries_run_the_defaults(spark, monkeypatch):
    from lumengraph.plans import learn_queries as q

    rows = spark.createDataFrame([(i, [float(i)], float(i % 2)) for i in range(20)], "vec_id long, features array<double>, label double")
    called: list[tuple] = []

    def stop(*args, **named):
        called.append((*args[2:], *named.items()))
        raise _Stop

    def reached(name, run):
        called.clear()
        with monkeypatch.context() as patch:
            patch.setattr(q.tables, "vector_features", lambda *_: rows)
            patch.setattr(learn, name, stop)
            with pytest.raises(_Stop):
                run(spark, "")
        return called[0]

    for run in (q.train_random_forest, q.predict, q.feature_importance, q.evaluate_model, q.save_load_model):
        assert reached("train", run) == (learn.Params("rf"),)
    assert reached("cross_validate", q.cross_validate) == (learn.Params("rf"),)
    with monkeypatch.context() as patch:
        patch.setattr(learn, "train", lambda *_: None)
        assert reached("evaluate_model", q.evaluate_model) == ("vec_id",)

    settings = {kind: learn._settings(grid) for kind, grid in (("svm", learn.SVM_GRID), ("rf", learn.FOREST_GRID))}
    assert len(settings["rf"]) == 3 * 4 * 3 * 3 and len(settings["svm"]) == 4 * (4 + 1 + 4)
    seen: list[tuple] = []
    for kind, name in (("rf", "_search_forests"), ("svm", "_search_margins")):
        counts = lambda df, id_col, k, found, kind=kind: seen.append((kind, k, found)) or [(learn.json.dumps(s, sort_keys=True), f, (1, 1, 1, 1)) for s in found for f in range(k)]
        monkeypatch.setattr(learn, name, counts)
    monkeypatch.setattr(learn, "train", lambda *_: None)
    monkeypatch.setattr(q.tables, "vector_features", lambda *_: rows)
    found = q.grid_search(spark, "").collect()
    assert sorted(seen, key=str) == sorted([(kind, 5, settings[kind]) for kind in settings], key=str)
    assert len(found) == 108 + 36 and {r.kind for r in found} == {"rf", "svm"}
