"""Reading image files and metadata: listing, labelling, capping, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions.ordered import with_rank

# Accepted file types, class folders and diagnoses.
FORMATS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff")
TRAINING_FORMATS = (".jpg", ".jpeg", ".png", ".bmp")
UPLOAD_FORMATS = (".jpg", ".jpeg", ".png")
POSITIVE_DIR, NEGATIVE_DIR = "melanoma", "benign"
DIAGNOSES = {"Benign": NEGATIVE_DIR, "Malignant": POSITIVE_DIR}
METADATA_SCHEMA = "isic_id string, diagnosis_1 string"

IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def scan_images(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Decoded images ``image_id, image``; the file is the id. Broken files have height -1."""
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
    return with_id(rows.load(path if isinstance(path, str) else list(path)))


def with_id(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("image.origin").alias("image_id"), "image")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime`` without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def filter_supported(df: DataFrame, path: str = "path", formats: Sequence[str] = FORMATS) -> DataFrame:
    return df.where(extension(F.col(path)).isin(*formats))


def class_of(path: Column) -> Column:
    """1 or 0 by the parent folder, null for any other folder."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.when(folder == POSITIVE_DIR, F.lit(1.0)).when(folder == NEGATIVE_DIR, F.lit(0.0))


def label_from_directory(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("label", class_of(F.col(path))).where("label IS NOT NULL")


def cap_per_class(df: DataFrame, order: Column, tie: str, n: int = 2000, label: str = "label") -> DataFrame:
    """At most ``n`` rows per class in the given pseudo-random order, before any decoding."""
    ranked = with_rank(df.withColumn("_order", order), [label], "_order", tie, "_rank")
    return ranked.where(F.col("_rank") <= n).drop("_order", "_rank")


def read_metadata(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The labelled metadata, read with a header; only two columns are used."""
    reader = spark.read.option("header", "true")
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return rows.select("isic_id", "diagnosis_1")


def _recognised(metadata: DataFrame) -> DataFrame:
    target = None
    for name, folder in DIAGNOSES.items():
        hit = F.col("diagnosis_1") == name
        target = F.when(hit, F.lit(folder)) if target is None else target.when(hit, F.lit(folder))
    rows = metadata.select(F.concat("isic_id", F.lit(".jpg")).alias("filename"), target.alias("folder"))
    return rows.where("folder IS NOT NULL")


def route_by_diagnosis(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """``filename, folder`` of the files whose diagnosis is known; others are skipped."""
    return _recognised(metadata).join(files.select("filename").distinct(), "filename")


def missing_files(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with a known diagnosis but no file."""
    return _recognised(metadata).join(files.select("filename"), "filename", "left_anti")


def split_readable(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(readable, broken)``: a file that fails to decode is set aside, not fatal."""
    broken = F.coalesce(F.col("image.height"), F.lit(-1)) <= 0
    return images.where(~broken), images.where(broken).select("image_id")


def require_nonempty(images: DataFrame) -> None:
    if images.isEmpty():
        raise ValueError("neither class has a readable picture")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows of both classes, with 0 for a class without rows."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative")
    ).withColumn("ready", (F.col("positive") > 0) & (F.col("negative") > 0))


def require_both_classes(df: DataFrame, label: str = "label") -> None:
    if not class_counts(df, label).first()["ready"]:
        raise ValueError("Both melanoma and benign images are needed")


def stored_name(filename: Column, at: Column) -> Column:
    """Upload name with its time in front."""
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), filename)


def ingest(uploads: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(accepted, rejected with reason, counts)`` of uploads ``image_id, filename, at, readable``.

    ``saved`` counts every stored upload before validation, ``accepted`` what is left.
    """
    stored = uploads.withColumn("stored", stored_name(F.col("filename"), F.col("at")))
    judged = stored.join(verdicts, "image_id", "left").withColumn(
        "reason", F.when(~F.col("readable"), F.lit("Could not read image")).otherwise(F.col("reason"))
    )
    ok = F.col("readable") & F.coalesce("is_valid", F.lit(False))
    counts = judged.agg(
        F.count("*").alias("saved"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected")
    )
    return judged.where(ok).select("image_id", "stored"), judged.where(~ok).select("image_id", "stored", "reason"), counts
