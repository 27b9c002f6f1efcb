"""Queries of evaluation and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.operators import evaluate, measures, results
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.graph_queries import _CLUSTERING, _TRANS, nodes_edges
from lumengraph.plans.registry import query, rounded

_scored = tables.scored_labels


def _confusion(key: str) -> str:
    cells = ", ".join(
        f"count(*) FILTER (WHERE label = {y} AND prediction = {p}) AS {n}"
        for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )
    return f"cm AS MATERIALIZED (SELECT {key}{', ' if key else ''}{cells} FROM scored{' GROUP BY ' + key if key else ''})"


_RATIO = lambda a, b: f"(CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END)"
_METRIC = {
    "accuracy": _RATIO("tn+tp", "(tn+fp+fn+tp)"),
    "precision": _RATIO("tp", "(tp+fp)"),
    "recall": _RATIO("tp", "(tp+fn)"),
    "f1_score": _RATIO("2*tp", "(2*tp+fp+fn)"),
    "specificity": _RATIO("tn", "(tn+fp)"),
    "balanced_accuracy": f"(({_RATIO('tp', '(tp+fn)')} + {_RATIO('tn', '(tn+fp)')}) / 2)",
    "mcc": _RATIO("tp*tn-fp*fn", "(sqrt((tp+fp)::DOUBLE)*sqrt((tp+fn)::DOUBLE)*sqrt((tn+fp)::DOUBLE)*sqrt((tn+fn)::DOUBLE))"),
    "kappa": """(CASE WHEN 1.0 - ((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))::DOUBLE/((tn+fp+fn+tp)*(tn+fp+fn+tp)) <> 0
      THEN ((tn+tp)::DOUBLE/(tn+fp+fn+tp) - ((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))::DOUBLE/((tn+fp+fn+tp)*(tn+fp+fn+tp)))
        / (1.0 - ((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))::DOUBLE/((tn+fp+fn+tp)*(tn+fp+fn+tp))) ELSE 0.0 END)""",
}


def _steps(key: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    k = f"{key}, " if key else ""
    return f"""per AS (SELECT {k}score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY {k}score),
steps AS MATERIALIZED (
  SELECT {k}score, pos, neg, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp, sum(pos) OVER al AS p_all, sum(neg) OVER al AS n_all
  FROM per WINDOW up AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), al AS ({part}))"""


@query("K1_confusion_matrix", sql.with_(sql.SCORED, _confusion(""), body="SELECT tn, fp, fn, tp FROM cm"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(_scored(spark, sf_dir))


def _plain(names: tuple[str, ...]) -> str:
    return sql.with_(
        sql.SCORED, _confusion("lang"),
        body="SELECT lang, tn, fp, fn, tp, " + ", ".join(f"{sql.r(_METRIC[n])} AS {n}" for n in names) + " FROM cm",
    )


@query("K2_basic_metrics", _plain(("accuracy", "precision", "recall", "f1_score")))
def basic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.basic_metrics(evaluate.confusion_matrix(_scored(spark, sf_dir), ["lang"])))


@query("K3_specificity_balanced_accuracy", _plain(("specificity", "balanced_accuracy")))
def specificity_balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.balance_metrics(evaluate.confusion_matrix(_scored(spark, sf_dir), ["lang"])))


@query("K4_mcc_kappa", _plain(("mcc", "kappa")))
def mcc_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.agreement_metrics(evaluate.confusion_matrix(_scored(spark, sf_dir), ["lang"])))


_ROC = f"""SELECT lang, {sql.r('score')} AS threshold, {sql.r('fp::DOUBLE / n_all')} AS fpr, {sql.r('tp::DOUBLE / p_all')} AS tpr FROM steps"""


@query(
    "K5_roc_curve",
    sql.with_(sql.SCORED, _steps("lang"), body=_ROC + " UNION ALL SELECT DISTINCT lang, NULL, 0.0, 0.0 FROM steps"),
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(rounded(evaluate.roc_curve(_scored(spark, sf_dir), ["lang"])))


def _finite(curve: DataFrame) -> DataFrame:
    """The threshold of the added end point as null: infinity has no rounding."""
    return curve.withColumn("threshold", F.when(F.col("threshold") < 1e300, F.col("threshold")))


@query(
    "K5_roc_curve_short",
    sql.with_(
        sql.SCORED, _steps("lang"),
        """nx AS (SELECT *, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg FROM steps WINDOW w AS (PARTITION BY lang ORDER BY score DESC))""",
        body=_ROC.replace("FROM steps", "FROM nx WHERE npos IS NULL OR npos <> pos OR nneg <> neg")
        + " UNION ALL SELECT DISTINCT lang, NULL, 0.0, 0.0 FROM steps",
    ),
)
def roc_curve_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(rounded(evaluate.roc_curve(_scored(spark, sf_dir), ["lang"], drop_intermediate=True)))


_AUC = "sum(neg * (tp - pos / 2.0::DOUBLE)) / (any_value(p_all) * any_value(n_all)::DOUBLE)"


@query(
    "K6_roc_auc",
    sql.with_(sql.SCORED, body=f"""SELECT {sql.r('avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)')} AS auc
FROM scored a JOIN scored b ON a.label = 1 AND b.label = 0"""),
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.roc_auc(_scored(spark, sf_dir)))


@query(
    "K7_pr_curve",
    sql.with_(
        sql.SCORED, _steps("lang"),
        body=f"""SELECT lang, {sql.r('score')} AS threshold, {sql.r('tp::DOUBLE / (tp + fp)')} AS precision, {sql.r('tp::DOUBLE / p_all')} AS recall FROM steps
UNION ALL SELECT DISTINCT lang, NULL, 1.0, 0.0 FROM steps""",
    ),
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finite(rounded(evaluate.pr_curve(_scored(spark, sf_dir), ["lang"])))


_AP = "sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(p_all)"


@query("K8_average_precision", sql.with_(sql.SCORED, _steps(""), body=f"SELECT {sql.r(_AP)} AS auc_pr FROM steps"))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.average_precision(_scored(spark, sf_dir)))


def _fold_sql(key: str) -> str:
    return (
        sql.SCORED + ",\n" + _confusion(key) + ",\n" + _steps(key)
        + f""",
area AS (SELECT {key}, {_AUC} AS auc, {_AP} AS auc_pr FROM steps GROUP BY {key}),
fold AS MATERIALIZED (SELECT cm.{key}, tn, fp, fn, tp, auc, auc_pr, {', '.join(f'{e} AS {n}' for n, e in _METRIC.items())}
  FROM cm JOIN area ON area.{key} = cm.{key})"""
    )


@query(
    "K9_fold_metrics",
    sql.with_(_fold_sql("fold"), body="SELECT fold, tn, fp, fn, tp, " + ", ".join(f"{sql.r(m)} AS {m}" for m in evaluate.METRICS) + " FROM fold"),
)
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.all_metrics(_scored(spark, sf_dir), ["fold"]))


@query(
    "K10_cv_summary",
    sql.with_(
        _fold_sql("fold"),
        body=" UNION ALL ".join(
            f"SELECT '{m}' AS metric, {sql.r(f'avg({m})')} AS mean, {sql.r(f'stddev_pop({m})')} AS std FROM fold" for m in evaluate.METRICS
        ),
    ),
)
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.cv_summary(evaluate.all_metrics(_scored(spark, sf_dir), ["fold"])))


@query(
    "K12_score_fallback",
    sql.with_(
        sql.SCORED,
        body=f"""SELECT doc_id, {sql.r('CASE doc_id % 3 WHEN 0 THEN score WHEN 1 THEN score * 4 - 2 ELSE prediction::DOUBLE END')} AS score FROM scored""",
    ),
)
def score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows have a probability, a third a margin, a third only a class."""
    kind = F.col("doc_id") % 3
    rows = _scored(spark, sf_dir).select(
        "doc_id", "prediction",
        F.when(kind == 0, F.col("score")).alias("probability"),
        F.when(kind <= 1, F.col("score") * 4 - 2).alias("margin"),
    )
    return rounded(evaluate.score_fallback(rows).select("doc_id", "score"))


# --- results -----------------------------------------------------------------------------------

_records = tables.analysis_records


@query(
    "L1_prediction_label",
    sql.with_(sql.RECORDS, body="SELECT analysis_id, CASE predicted_class WHEN 1 THEN 'Melanoma' ELSE 'Benign' END AS result FROM rec"),
)
def prediction_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("analysis_id", results.prediction_label(F.col("predicted_class")).alias("result"))


@query(
    "L2_risk_level",
    sql.with_(sql.RECORDS, body="SELECT analysis_id, CASE WHEN probability > 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM rec"),
)
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("analysis_id", results.risk_level(F.col("probability")).alias("risk_level"))


@query(
    "L3_probability_percent",
    sql.with_(
        sql.RECORDS,
        body="""SELECT analysis_id, CAST(trunc(probability * 100) AS INT) AS percent,
  CASE WHEN trunc(probability * 100) <= 50 THEN 'Low' ELSE 'High' END AS band FROM rec""",
    ),
)
def probability_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = results.probability_percent(F.col("probability"))
    return _records(spark, sf_dir).select("analysis_id", percent.alias("percent"), results.percent_band(percent).alias("band"))


@query(
    "L4_analysis_history",
    sql.with_(
        sql.RECORDS,
        body=f"""SELECT analysis_id AS id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS date, filename AS image,
  CASE predicted_class WHEN 1 THEN 'Melanoma' ELSE 'Benign' END AS result, {sql.r('probability')} AS confidence FROM rec""",
    ),
)
def analysis_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.analysis_history(_records(spark, sf_dir)))


_TRAINING = """runs AS (
  SELECT batch AS id, CAST(sum(predicted_class) AS BIGINT) AS melanoma_samples, CAST(count(*) - sum(predicted_class) AS BIGINT) AS benign_samples,
    avg(probability) AS accuracy, min(probability) AS precision, max(probability) AS recall, stddev_pop(probability) AS f1_score
  FROM rec GROUP BY batch)"""


@query(
    "L5_training_summary",
    sql.with_(
        sql.RECORDS, _TRAINING,
        body="SELECT id, melanoma_samples, benign_samples, melanoma_samples + benign_samples AS total_samples, "
        + ", ".join(f"{sql.r(f'{c} * 100', 2)} AS {c}" for c in ("accuracy", "precision", "recall", "f1_score")) + " FROM runs",
    ),
)
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("probability")
    runs = _records(spark, sf_dir).groupBy(F.col("batch").alias("id")).agg(
        F.sum("predicted_class").alias("melanoma_samples"),
        (F.count("*") - F.sum("predicted_class")).alias("benign_samples"),
        F.avg(p).alias("accuracy"), F.min(p).alias("precision"), F.max(p).alias("recall"), F.stddev_pop(p).alias("f1_score"),
    )
    return rounded(results.training_summary(runs), 2)


@query(
    "L6_api_payload",
    sql.with_(
        sql.RECORDS,
        body="""SELECT CAST(analysis_id AS BIGINT) AS image_id,
  CASE WHEN probability > 0.1
    THEN '{"status":200,"message":"Image processed successfully","data":{"probability":' || CAST(CAST(floor(probability * 100) / 100 AS DOUBLE) AS VARCHAR)
      || ',"risk_level":"' || CASE WHEN CAST(floor(probability * 100) / 100 AS DOUBLE) > 0.5 THEN 'HIGH' ELSE 'LOW' END || '","validation":"' || batch || '"}}'
    ELSE '{"status":400,"message":"Invalid input image","details":"' || batch || '"}' END AS payload FROM rec""",
    ),
)
def api_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select(
        F.col("analysis_id").cast("bigint").alias("image_id"),
        (F.floor(F.col("probability") * 100) / 100.0).alias("probability"),
        (F.col("probability") > 0.1).alias("is_valid"),
        F.col("batch").alias("validation"),
    )
    return results.api_payload(rows)


@query(
    "L7_metric_histogram",
    sql.with_(
        sql.RECORDS,
        "span AS (SELECT batch, min(probability) AS lo, max(probability) AS hi FROM rec GROUP BY batch)",
        """cnt AS (SELECT r.batch, least(19, CAST(floor((probability - lo) / (hi - lo) * 20) AS INT)) AS bin, count(*) AS n
  FROM rec r JOIN span s USING (batch) GROUP BY ALL)""",
        body=f"""SELECT s.batch, CAST(t.i AS INT) AS bin, {sql.r('lo + t.i * ((hi - lo) / 20)')} AS low, {sql.r('lo + (t.i + 1) * ((hi - lo) / 20)')} AS high,
  coalesce(c.n, 0) AS n FROM span s CROSS JOIN range(0, 20) AS t(i) LEFT JOIN cnt c ON c.batch = s.batch AND c.bin = t.i""",
    ),
)
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.metric_histogram(_records(spark, sf_dir).select("batch", "probability"), "probability", ["batch"]))


@query(
    "L8_zscore",
    sql.with_(
        sql.NODES,
        body=f"""SELECT image_id, node, {sql.r('(l - avg(l) OVER w) / stddev_pop(l) OVER w')} AS z FROM nodes WINDOW w AS (PARTITION BY image_id)""",
    ),
)
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.zscore(tables.graph_nodes(spark, sf_dir).select("image_id", "node", "l"), "l", ["image_id"]).drop("l"))


@query(
    "L9_relative_edge_weight",
    sql.with_(sql.EDGES, body=f"SELECT image_id, src, dst, {sql.r('2 * weight / max(weight) OVER (PARTITION BY image_id)')} AS width FROM edges"),
)
def relative_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(results.relative_edge_weight(nodes_edges(spark, sf_dir)[1]).drop("weight"))


@query(
    "L10_global_feature_bars",
    sql.with_(
        sql.EDGES, _CLUSTERING, _TRANS,
        body=f"""SELECT image_id, 'global_clustering' AS name, {sql.r('avg(clustering)')} AS value FROM clus GROUP BY image_id
UNION ALL SELECT image_id, 'transitivity', {sql.r('r')} FROM trans
UNION ALL SELECT image_id, 'density', {sql.r('sum(d)::DOUBLE / (count(*) * (count(*) - 1))')} FROM deg GROUP BY image_id""",
    ),
)
def global_feature_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nodes_edges(spark, sf_dir)
    wide = (
        measures.density(nodes, edges)
        .join(measures.transitivity(nodes, edges), "image_id")
        .join(measures.average_clustering(measures.clustering_weighted(nodes, edges)), "image_id")
    )
    return rounded(results.feature_bars(wide))


