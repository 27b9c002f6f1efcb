"""Scoring of newly arriving image files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumengraph.session import cut, scratch
from lumengraph.sources.images import IMAGE_SCHEMA, split_readable, with_id
from lumengraph.sources.tables import append_unique

Scorer = Callable[[DataFrame], DataFrame]


def arriving_images(spark: SparkSession, folder: str, bytes_per_batch: int = 1 << 30) -> DataFrame:
    """New files of a landing folder as ``image_id, image``.

    A batch takes files by their size: the jobs of a batch cost the same for few small files as
    for many, so a fixed number of files would make time grow with the number of batches.
    """
    stream = (
        spark.readStream.format("image")
        .schema(IMAGE_SCHEMA)
        .option("dropInvalid", "false")
        .option("recursiveFileLookup", "true")
        .option("maxBytesPerTrigger", bytes_per_batch)
    )
    return with_id(stream.load(folder))


def write_batch(batch: DataFrame, scorer: Scorer, results: str, quarantine: str) -> None:
    """Score one batch; valid images go to ``results``, all others to ``quarantine``.

    The key is the file, and keys already stored are left out, so a batch that runs
    again after a failure adds nothing twice. Tables written on the way go with the batch.
    """
    with scratch(batch.sparkSession):
        readable, broken = split_readable(batch)
        scored = cut(scorer(readable))
        now = F.current_timestamp()
        key = F.sha2(F.col("image_id"), 256).alias("analysis_id")
        name = F.element_at(F.split("image_id", "/"), -1).alias("filename")
        good = scored.where("is_valid").select(key, name, now.alias("timestamp"), "probability", F.col("image_id").alias("original_image_path"))
        bad = scored.where("NOT is_valid").select(key, name, now.alias("timestamp"), F.col("validation").alias("reason"))
        lost = broken.select(key, name, now.alias("timestamp"), F.lit("Could not read image").alias("reason"))
        append_unique(good, results, "analysis_id")
        append_unique(bad.unionByName(lost), quarantine, "analysis_id")


def score_stream(
    spark: SparkSession, folder: str, scorer: Scorer, results: str, quarantine: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Start scoring; ``once`` works off what is there and stops."""
    writer = (
        arriving_images(spark, folder)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _id: write_batch(batch, scorer, results, quarantine))
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
