"""Result queries: labels, risk, history, summaries and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output words and the risk limit.
POSITIVE, NEGATIVE = "Melanoma", "Benign"
HIGH, LOW = "HIGH", "LOW"
RISK_LIMIT = 0.5


def prediction_label(predicted: Column) -> Column:
    return F.when(predicted == 1, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def risk_level(probability: Column) -> Column:
    return F.when(probability > RISK_LIMIT, F.lit(HIGH)).otherwise(F.lit(LOW))


def probability_percent(probability: Column) -> Column:
    return (probability * 100).cast("int")


def percent_band(percent: Column) -> Column:
    return F.when(percent <= 50, F.lit("Low")).otherwise(F.lit("High"))


def analysis_history(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Scored images, newest first; with a limit only the top rows are sorted."""
    rows = records.select(
        F.col("analysis_id").alias("id"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("filename").alias("image"),
        prediction_label(F.col("predicted_class")).alias("result"),
        F.col("probability").alias("confidence"),
    ).orderBy(F.desc("date"), "id")
    return rows.limit(limit) if limit is not None else rows


def training_summary(records: DataFrame) -> DataFrame:
    """Class counts, total and metrics in percent with two decimals, per run."""
    percent = lambda c: F.round(F.col(c) * 100, 2).alias(c)
    return records.select(
        "id", "melanoma_samples", "benign_samples",
        (F.col("melanoma_samples") + F.col("benign_samples")).alias("total_samples"),
        *[percent(c) for c in ("accuracy", "precision", "recall", "f1_score")],
    )


def api_payload(scored: DataFrame) -> DataFrame:
    """The answer to a scoring request as JSON text; ``validation`` holds the gate's message."""
    ok = F.struct(
        F.lit(200).alias("status"),
        F.lit("Image processed successfully").alias("message"),
        F.struct(
            F.col("probability"), risk_level(F.col("probability")).alias("risk_level"), F.col("validation")
        ).alias("data"),
    )
    refused = F.struct(
        F.lit(400).alias("status"), F.lit("Invalid input image").alias("message"), F.col("validation").alias("details")
    )
    return scored.select("image_id", F.when(F.col("is_valid"), F.to_json(ok)).otherwise(F.to_json(refused)).alias("payload"))


def metric_histogram(values: DataFrame, value: str, keys: Sequence[str], bins: int = 20) -> DataFrame:
    """``keys, bin, low, high, n``: equal-width counts from smallest to largest, empty bins included."""
    keys = list(keys)
    span = values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    place = F.least(
        F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
    ).cast("int")
    counts = values.join(span, keys).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def zscore(values: DataFrame, value: str, keys: Sequence[str], name: str = "z") -> DataFrame:
    """Value standardised inside its group with the population spread; null if constant.

    Group moments are partial aggregates joined back, so no group is held in one task.
    """
    keys = list(keys)
    moments = values.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    z = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std"))
    return values.join(moments, keys).withColumn(name, z).drop("_mean", "_std")


def relative_edge_weight(edges: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    top = edges.groupBy(*keys).agg(F.max("weight").alias("_top"))
    return edges.join(top, list(keys)).withColumn("width", F.col("weight") * 2 / F.col("_top")).drop("_top")


def feature_bars(graphs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The numeric measures of a graph as ``keys, name, value``."""
    keys = list(keys)
    numeric = [f.name for f in graphs.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in keys]
    return graphs.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(keys, numeric, "name", "value")
