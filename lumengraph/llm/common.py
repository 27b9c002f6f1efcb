"""What the operators share: column choice, folds and the text pattern of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of space and the characters 9 to 13, as a regular expression of Java and DuckDB.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts. Spark's default of 10,000 rows may be gigabytes.
BATCH_ROWS, _BATCH, _DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Keep batches of texts small for the session, unless it has a size of its own."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; null texts are empty, other columns cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fold(column: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; -1 for a null id, which is in no fold."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string")) % 5, F.lit(-1)).cast("int")
