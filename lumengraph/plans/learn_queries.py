"""Queries of splitting, scaling, selection, training and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import forest, learn, neighbours
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.registry import query, rounded
from lumengraph.session import cut, shared_dir

_ORDER = "((doc_id % 2147483648) * 2654435761 + 42 * 40503) % 4294967296"


@query(
    "J1_split_dataset",
    sql.with_(
        sql.SCORED,
        body=f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_ORDER}, doc_id) <= (SELECT greatest(1, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT)) FROM scored)
  THEN 'train' ELSE 'test' END AS part FROM scored""",
    ),
)
def split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.split_dataset(tables.scored_labels(spark, sf_dir).select("doc_id"), "doc_id")


_TEXT_ORDER = "((CAST(('0x' || substr(md5('D' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2147483648) * 2654435761 + 42 * 40503) % 4294967296"


@query(
    "J1_split_text_ids",
    sql.with_(
        sql.SCORED,
        body=f"""SELECT 'D' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN row_number() OVER (ORDER BY {_TEXT_ORDER}, 'D' || CAST(doc_id AS VARCHAR)) <= (SELECT greatest(1, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT)) FROM scored)
  THEN 'train' ELSE 'test' END AS part FROM scored""",
    ),
)
def split_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split over ids that are texts, as those of picture files are."""
    named = tables.scored_labels(spark, sf_dir).select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"))
    return learn.split_dataset(named, "id")


@query(
    "J9_folds_text_ids",
    sql.with_(
        sql.SCORED,
        body=f"""SELECT 'D' || CAST(doc_id AS VARCHAR) AS id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_TEXT_ORDER}, 'D' || CAST(doc_id AS VARCHAR)) - 1) % 5 AS INT) AS fold FROM scored""",
    ),
)
def folds_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tables.scored_labels(spark, sf_dir).select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), "label")
    return learn.stratified_folds(named, "id")


@query(
    "J2_standard_scale",
    sql.with_(
        sql.FEATURES,
        body=f"""SELECT vec_id, name, {sql.r('''CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0.0 END''')} AS z
FROM feat WINDOW w AS (PARTITION BY name)""",
    ),
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.standard_scale(tables.long_features(spark, sf_dir)).select("vec_id", "name", "z"))


@query("J2_scaler", sql.with_(
    sql.FEATURES,
    body=f"""SELECT vec_id, {sql.r('sum(z)')} AS total FROM (
  SELECT vec_id, CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0.0 END AS z
  FROM feat WINDOW w AS (PARTITION BY name)) GROUP BY vec_id""",
))
def scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted scaler on feature arrays: the sum of each row's scaled values."""
    rows = tables.vector_features(spark, sf_dir)
    scaled = learn.Scaler.fit(rows).transform(rows)
    return rounded(scaled.select("vec_id", F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("total")))


@query(
    "J3_balanced_class_weight",
    sql.with_(sql.FEATURES, body=f"""SELECT label, {sql.r('sum(n) OVER () / (2.0 * n)')} AS weight FROM (
  SELECT label, count(DISTINCT vec_id)::DOUBLE AS n FROM feat GROUP BY label)"""),
)
def balanced_class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.class_weights(tables.vector_features(spark, sf_dir)))


_F = """cls AS (SELECT name, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM feat GROUP BY ALL),
alls AS (SELECT name, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m FROM cls GROUP BY name),
fs AS (SELECT c.name, (sum(c.n * (c.m - a.m) * (c.m - a.m)) / (any_value(a.k) - 1)) / (sum(c.n * c.v) / (any_value(a.n) - any_value(a.k))) AS f
  FROM cls c JOIN alls a ON a.name = c.name GROUP BY c.name)"""


@query("J6_f_scores", sql.with_(sql.FEATURES, _F, body=f"SELECT name, {sql.r('f')} AS f FROM fs"))
def f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.f_scores(tables.long_features(spark, sf_dir)))


@query("J6_select_k_best_f", sql.with_(sql.FEATURES, _F, body=f"SELECT name, {sql.r('f')} AS f FROM fs ORDER BY fs.f DESC, name LIMIT 20"))
def select_k_best_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.select_features(tables.long_features(spark, sf_dir), "vec_id", "f_classif", 20))


_MI = f"""size AS (SELECT name, label, count(*)::DOUBLE AS c FROM feat GROUP BY ALL),
inn AS MATERIALIZED (SELECT f.*, s.c FROM feat f JOIN size s ON f.name = s.name AND f.label = s.label WHERE s.c > 1),
gap AS (SELECT a.name, a.vec_id, any_value(a.value) AS value, list_sort(list(abs(b.value - a.value)))[CAST(least(3, any_value(a.c) - 1) AS INT)] AS r
  FROM inn a JOIN inn b ON a.name = b.name AND a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.name, a.vec_id),
near AS (SELECT a.name, a.vec_id, count(*)::DOUBLE AS m
  FROM gap a JOIN inn b ON a.name = b.name AND (abs(b.value - a.value) < a.r OR b.value = a.value) GROUP BY a.name, a.vec_id),
cls AS (SELECT name, sum(c) AS n, sum(c * ({neighbours.digamma_sql('least(3.0, c - 1)')} - {neighbours.digamma_sql('c')})) AS t FROM size WHERE c > 1 GROUP BY name),
mi AS (SELECT c.name, greatest(0.0, {neighbours.digamma_sql('any_value(c.n)')} + (any_value(c.t) - sum({neighbours.digamma_sql('m')})) / any_value(c.n)) AS mi
  FROM cls c JOIN near x ON x.name = c.name GROUP BY c.name)"""


@query("J7_mutual_information", sql.with_(sql.FEATURES, _MI, body=f"SELECT name, {sql.r('mi')} AS mi FROM mi"))
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the class and each feature, by nearest neighbours."""
    return rounded(neighbours.mutual_information(tables.long_features(spark, sf_dir), "vec_id"))


@query("J7_select_k_best_mi", sql.with_(sql.FEATURES, _MI, body=f"SELECT name, {sql.r('mi')} AS mi FROM mi ORDER BY mi.mi DESC, name LIMIT 20"))
def select_k_best_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.select_features(tables.long_features(spark, sf_dir), "vec_id", "mutual_info", 20))


@query(
    "J7_binned_mi",
    sql.with_(
        sql.FEATURES,
        """rk AS (SELECT name, label, (row_number() OVER (PARTITION BY name ORDER BY value, vec_id) - 1) * 10 // count(*) OVER (PARTITION BY name) AS bin,
  count(*) OVER (PARTITION BY name) AS n FROM feat)""",
        """cell AS (SELECT name, label, bin, count(*)::DOUBLE AS c, any_value(n)::DOUBLE AS n FROM rk GROUP BY ALL)""",
        """mi AS (SELECT name, sum(c / n * ln(c * n / (cb * cy))) AS mi FROM (
  SELECT *, sum(c) OVER (PARTITION BY name, bin) AS cb, sum(c) OVER (PARTITION BY name, label) AS cy FROM cell) GROUP BY name)""",
        body=f"SELECT name, {sql.r('mi')} AS mi FROM mi ORDER BY mi.mi DESC, name LIMIT 20",
    ),
)
def binned_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.select_features(tables.long_features(spark, sf_dir), "vec_id", "binned", 20))


@query(
    "J9_stratified_folds",
    sql.with_(
        sql.SCORED,
        body=f"""SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_ORDER}, doc_id) - 1)
  % greatest(2, least(5, (SELECT min(n) FROM (SELECT count(*) AS n FROM scored GROUP BY label)))) AS INT) AS fold FROM scored""",
    ),
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.stratified_folds(tables.scored_labels(spark, sf_dir).select("doc_id", "label"), "doc_id")


@query("J12_training_distribution", sql.with_(sql.SCORED, body="SELECT label, count(*) AS n FROM scored GROUP BY label"))
def training_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.training_distribution(tables.scored_labels(spark, sf_dir))


# --- models ------------------------------------------------------------------------------------


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tables.vector_features(spark, sf_dir))


def _predicted(model: learn.Classifier, rows: DataFrame) -> DataFrame:
    return rounded(model.predict(rows).select("vec_id", "label", "prediction", "probability"))


@query("J4_train_svm_rbf")
def train_svm_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _predicted(learn.train(rows, "vec_id", learn.Params("svm")), rows)


@query("J5_train_random_forest")
def train_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _predicted(learn.train(rows, "vec_id", learn.Params("rf")), rows)


@query("J8_grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grids of both kinds."""
    rows = _rows(spark, sf_dir)
    forest, svm = (learn.grid_search(rows, "vec_id", kind)[0].withColumn("kind", F.lit(kind)) for kind in ("rf", "svm"))
    return rounded(forest.unionByName(svm))


@query("J10_cross_validate")
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.cross_validate(_rows(spark, sf_dir), "vec_id", learn.Params("rf")))


@query("J11_predict")
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the training part, applied to the test part."""
    rows = cut(learn.split_dataset(tables.vector_features(spark, sf_dir), "vec_id"))
    model = learn.train(rows.where("part = 'train'").drop("part"), "vec_id", learn.Params("rf"))
    return _predicted(model, rows.where("part = 'test'"))


@query("J13_feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn.train(_rows(spark, sf_dir), "vec_id", learn.Params("rf"))
    return rounded(learn.feature_importance(model, [f"f{i}" for i in range(64)], spark))


@query("K11_evaluate")
def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    model = learn.train(rows, "vec_id", learn.Params("rf"))
    folds, whole = learn.evaluate_model(model, rows, "vec_id")
    both = folds.withColumn("fold", F.col("fold").cast("string")).unionByName(whole.withColumn("fold", F.lit("all")))
    return rounded(both)


@query("A12_save_load_model")
def save_load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a model read back from storage."""
    rows = _rows(spark, sf_dir)
    model = learn.train(rows, "vec_id", learn.Params("rf"))
    path = f"{shared_dir(spark)}/lumengraph_model_{spark.sparkContext.applicationId}"
    learn.save_model(model, path, spark)
    return _predicted(learn.load_model(path, spark), rows)


# --- what must hold of the models, whatever they learned -----------------------------------------


_FOLDS = sql.with_(
    sql.FEATURES,
    "r AS (SELECT DISTINCT vec_id, label FROM feat)",
    "f AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY {order}) - 1) % least(5, (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY label))) AS fold FROM r)",
    body="SELECT CAST(fold AS INT) AS fold, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives FROM f GROUP BY fold",
)


@query("J10_fold_sizes", _FOLDS.format(order="vec_id"))
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored once, in its own fold."""
    folds = learn.cross_validate(_rows(spark, sf_dir), "vec_id", learn.Params("rf"))
    return folds.select("fold", (F.col("tn") + F.col("fp")).cast("bigint").alias("negatives"), (F.col("fn") + F.col("tp")).cast("bigint").alias("positives"))


@query(
    "J11_predicted_rows",
    sql.with_(
        sql.FEATURES,
        "r AS (SELECT DISTINCT vec_id, label FROM feat)",
        body=f"""SELECT vec_id, label, true AS probable FROM r QUALIFY row_number() OVER (ORDER BY {_ORDER.replace('doc_id', 'vec_id')}, vec_id)
  > (SELECT greatest(1, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT)) FROM r)""",
    ),
)
def predicted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions are for the test part, and agree with their probabilities."""
    p = F.col("probability")
    agrees = p.between(0, 1) & (F.col("prediction") == (p > 0.5).cast("int"))
    return predict(spark, sf_dir).select("vec_id", "label", agrees.alias("probable"))


@query(
    "J5_forest_invariants",
    """SELECT 'rows' AS name, count(*) AS value FROM embeddings UNION ALL SELECT 'trees', 200 UNION ALL SELECT 'children do not add up', 0
UNION ALL SELECT 'leaves that could be split', 0 UNION ALL SELECT 'wrong on more than a twentieth', 0 UNION ALL SELECT 'importance of all features, thousandths', 1000
UNION ALL SELECT 'other predictions after reading back', 0""",
)
def forest_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's rows are those of its children, and only leaves of one class or a single row are left."""
    rows = _rows(spark, sf_dir)
    model = learn.train(rows, "vec_id", learn.Params("rf"))
    nodes = model.model.nodes
    off = forest.unbalanced(nodes)
    path = f"{shared_dir(spark)}/lumengraph_forest_{spark.sparkContext.applicationId}"
    learn.save_model(model, path, spark)
    mine, again = cut(model.predict(rows).select("vec_id", "label", "prediction", "probability")), learn.load_model(path, spark).predict(rows)
    both = mine.join(again.select("vec_id", F.col("probability").alias("p")), "vec_id")
    total = sum(r["importance"] for r in learn.feature_importance(model, [f"f{i}" for i in range(64)], spark).collect())
    wrong = mine.where("prediction <> label").count() * 20 > mine.count()
    values = [
        ("rows", mine.count()),
        ("trees", nodes.select("tree").distinct().count()),
        ("children do not add up", off.count()),
        ("leaves that could be split", nodes.where("feature < 0 AND c0 > 0 AND c1 > 0 AND n > 1").count()),
        ("wrong on more than a twentieth", int(wrong)),
        ("importance of all features, thousandths", round(1000 * total)),
        ("other predictions after reading back", both.where("probability <> p").count()),
    ]
    return spark.createDataFrame(values, "name string, value long")
