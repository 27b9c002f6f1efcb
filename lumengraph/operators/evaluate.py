"""Evaluation of scored rows: ``label`` and ``prediction`` 0/1, ``score`` double.

Every function takes the columns that tell runs apart (a fold, a model); without any
it evaluates all rows together. Curves are built from counts per distinct score with
running totals that never sort a whole run in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions.ordered import BUCKET, running_totals, with_buckets
from lumengraph.session import cut

METRICS = (
    "accuracy", "precision", "recall", "f1_score", "specificity", "balanced_accuracy", "auc", "auc_pr", "mcc", "kappa",
)


def confusion_matrix(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    hit = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p))
    return scored.groupBy(*keys).agg(
        hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def _counts() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))


def basic_metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where undefined."""
    tn, fp, fn, tp = _counts()
    return confusion.withColumns(
        {
            "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1_score": _ratio(tp * 2, tp * 2 + fp + fn),
        }
    )


def balance_metrics(confusion: DataFrame) -> DataFrame:
    tn, fp, fn, tp = _counts()
    specificity, recall = _ratio(tn, tn + fp), _ratio(tp, tp + fn)
    return confusion.withColumns({"specificity": specificity, "balanced_accuracy": (recall + specificity) / 2})


def agreement_metrics(confusion: DataFrame) -> DataFrame:
    """Matthews correlation and Cohen's kappa, 0 where undefined."""
    tn, fp, fn, tp = _counts()
    n = tn + fp + fn + tp
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    agree = (tn + tp) / n
    return confusion.withColumns(
        {"mcc": _ratio(tp * tn - fp * fn, spread), "kappa": _ratio(agree - chance, F.lit(1.0) - chance)}
    )


def score_steps(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with its counts and the counts of scores not below it."""
    keys = list(keys)
    per_score = cut(
        scored.groupBy(*keys, "score").agg(
            F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
        )
    )
    bucketed = with_buckets(per_score, keys, "score")
    return running_totals(
        bucketed, keys, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True
    )


def _class_totals(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.count_if(F.col("label") == 1).alias("p_all"), F.count_if(F.col("label") != 1).alias("n_all")
    )


def _with_totals(df: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = _class_totals(scored, keys)
    if keys:
        return df.join(totals, list(keys))
    row = totals.first()
    return df.withColumns({"p_all": F.lit(row["p_all"]), "n_all": F.lit(row["n_all"])})


def roc_curve(scored: DataFrame, keys: Sequence[str] = (), drop_intermediate: bool = False) -> DataFrame:
    """``threshold, fpr, tpr`` at each distinct score and the start (0, 0) at infinity.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours.
    """
    keys = list(keys)
    steps = _with_totals(score_steps(scored, keys), scored, keys)
    if drop_intermediate:
        steps = _drop_straight(steps, keys)
    points = steps.select(
        *keys, F.col("score").cast("double").alias("threshold"),
        (F.col("fp") / F.col("n_all")).alias("fpr"), (F.col("tp") / F.col("p_all")).alias("tpr"),
    )
    origin = F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    starts = scored.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, *origin)
    return points.unionByName(starts)


def _drop_straight(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Keep a point unless the next step repeats its counts; the last one always stays.

    The next step of the last row of a bucket is the first row of the next bucket; the
    table of first rows holds one row per bucket.
    """
    within = Window.partitionBy(*keys, BUCKET).orderBy(F.col("score").desc())
    across = (Window.partitionBy(*keys) if keys else Window).orderBy(F.col(BUCKET).desc())
    counts = F.struct("pos", "neg")
    steps = cut(steps)
    first = steps.groupBy(*keys, BUCKET).agg(F.max_by(counts, "score").alias("head"))
    follow = first.select(*keys, BUCKET, F.lead("head").over(across).alias("after"))
    joined = steps.withColumn("next", F.lead(counts).over(within)).join(follow, [*keys, BUCKET])
    following = F.coalesce("next", "after")
    return joined.where(following.isNull() | (following != counts))


def roc_auc(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; ties count half. Null with one class only."""
    steps = _with_totals(score_steps(scored, keys), scored, keys)
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    area = F.sum(strip) / (F.first("p_all") * F.first("n_all").cast("double"))
    return steps.groupBy(*keys).agg(
        F.when((F.first("p_all") > 0) & (F.first("n_all") > 0), area).alias("auc")
    )


def pr_curve(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``threshold, precision, recall`` at each distinct score and the end (1, 0)."""
    keys = list(keys)
    steps = _with_totals(score_steps(scored, keys), scored, keys)
    points = steps.select(
        *keys, F.col("score").cast("double").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp").cast("double"), F.col("p_all")).alias("recall"),
    )
    end = F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    return points.unionByName(scored.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, *end))


def average_precision(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    steps = _with_totals(score_steps(scored, keys), scored, keys)
    part = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.groupBy(*keys).agg(_ratio(F.sum(part), F.first("p_all")).alias("auc_pr"))


def all_metrics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All ten metrics and the confusion matrix, one row per run."""
    keys = list(keys)
    scored = cut(scored.select(*keys, "label", "score", "prediction"))
    plain = agreement_metrics(balance_metrics(basic_metrics(confusion_matrix(scored, keys))))
    steps = cut(_with_totals(score_steps(scored, keys), scored, keys))
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    part = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (F.first("p_all") > 0) & (F.first("n_all") > 0)
    areas = steps.groupBy(*keys).agg(
        F.when(both, F.sum(strip) / (F.first("p_all") * F.first("n_all").cast("double"))).alias("auc"),
        _ratio(F.sum(part), F.first("p_all")).alias("auc_pr"),
    )
    if keys:
        out = plain.join(areas, keys)
    else:
        row = areas.first()
        out = plain.withColumns({c: F.lit(row[c]).cast("double") for c in ("auc", "auc_pr")})
    return out.select(*keys, *METRICS, "tn", "fp", "fn", "tp")


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """``metric, mean, std`` over the folds, with the population spread."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return (
        fold_metrics.select(F.inline(cells))
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def score_fallback(predicted: DataFrame) -> DataFrame:
    """``score``: the probability of class 1, else the margin, else the predicted class."""
    have = set(predicted.columns)
    options = []
    if "probability" in have:
        options.append(F.col("probability"))
    if "margin" in have:
        options.append(F.col("margin"))
    options.append(F.col("prediction").cast("double"))
    return predicted.withColumn("score", F.coalesce(*options))
