"""Sinks: the feature matrix, analysis results and training records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANALYSIS_SCHEMA = """id bigint, analysis_id string, filename string, timestamp timestamp, prediction string,
probability double, features_extracted int, n_segments int, compactness double, connectivity_threshold double,
original_image_path string, superpixels_image_path string, graph_image_path string, features_image_path string"""
TRAINING_SCHEMA = """id bigint, timestamp timestamp, classifier_type string, n_segments int, compactness double,
connectivity_threshold double, melanoma_samples int, benign_samples int, accuracy double, precision double,
recall double, f1_score double, auc double, model_path string"""


def write_feature_matrix(matrix: DataFrame, path: str, size: int, fmt: str = "csv") -> None:
    """``feature_0 .. , label`` from ``features array, label``; CSV with a header, or Parquet."""
    wide = matrix.select(*[F.get("features", F.lit(i)).alias(f"feature_{i}") for i in range(size)], "label")
    writer = wide.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)


def read_feature_matrix(spark: SparkSession, path: str, size: int, fmt: str = "csv") -> DataFrame:
    schema = ", ".join([*[f"feature_{i} double" for i in range(size)], "label double"])
    reader = spark.read.schema(schema)
    return reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None only if there is nothing there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_unique(rows: DataFrame, path: str, key: str, day: str = "timestamp") -> None:
    """Append rows whose key is new, partitioned by day.

    Only the key column of the table is read for the check.
    """
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    known = _existing(spark, path)
    if known is not None:
        fresh = fresh.join(known.select(key), key, "left_anti")
    fresh.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def append_analysis_results(rows: DataFrame, path: str) -> None:
    append_unique(rows, path, "analysis_id")


def append_training_record(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
