"""Queries of sources, sinks, assembly and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph import flow
from lumengraph.operators import assemble, learn, raster, regions, results, shape, validate
from lumengraph.plans import sqlkit as sql
from lumengraph.plans import tables
from lumengraph.plans.feature_queries import _POINTS
from lumengraph.plans.registry import query, rounded
from lumengraph.plans.segment_queries import VERDICT_PARTS
from lumengraph.session import cut, shared_dir
from lumengraph.sources import images, tables as sinks
from lumengraph.streaming import score as streaming


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}_{uuid.uuid4().hex}"


def _path(folder: str) -> str:
    return folder.removeprefix("file://").removeprefix("file:")


def _bitmaps(spark: SparkSession, sf_dir: str) -> str:
    folder = _path(_folder(spark, "bitmaps"))
    tables.write_bitmaps(tables.discs(spark, sf_dir), folder)
    return folder


def _number(path: str) -> Column:
    return F.regexp_extract(path, r"img_(\d+)\.", 1).cast("int")


@query(
    "A1_scan_images",
    sql.with_(
        sql.DISCS,
        body="""SELECT image_id AS number, 64 AS height, 64 AS width, 3 AS channels, CAST(sum(r * (x + 1)) AS BIGINT) AS r, CAST(sum(g * (x + 1)) AS BIGINT) AS g,
  CAST(sum(b * (y + 1)) AS BIGINT) AS b FROM pix GROUP BY image_id""",
    ),
)
def scan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures written as files by Spark, decoded again and summed."""
    rows = cut(images.scan_images(spark, _bitmaps(spark, sf_dir)))
    moment = lambda c, w: F.aggregate(F.transform(c, w), F.lit(0).cast("bigint"), lambda a, v: a + v)
    by_x = lambda v, i: v * (i + 1)
    by_y = lambda v: v * (F.col("y") + 1)
    sums = raster.to_strips(rows).groupBy("image_id").agg(
        F.sum(moment("r", by_x)).alias("r"), F.sum(moment("g", by_x)).alias("g"), F.sum(moment("b", by_y)).alias("b")
    )
    size = rows.select("image_id", "image.height", "image.width", F.col("image.nChannels").alias("channels"))
    return size.join(sums, "image_id").select(_number("image_id").alias("number"), "height", "width", "channels", "r", "g", "b")


_EXT = "CASE n_chars % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' WHEN 3 THEN '.tiff' ELSE '.txt' END"


def _named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several types in class folders."""
    kind = F.col("n_chars") % 5
    ext = F.when(kind == 0, ".jpg").when(kind == 1, ".JPEG").when(kind == 2, ".png").when(kind == 3, ".tiff").otherwise(".txt")
    folder = F.when(F.col("lang") == "en", "melanoma").when(F.col("lang") == "de", "benign").otherwise("unsorted")
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/data/"), folder, F.lit("/D"), F.col("doc_id").cast("string"), ext).alias("path")
    )


_FILES = f"""named AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'melanoma' WHEN 'de' THEN 'benign' ELSE 'unsorted' END AS folder, {_EXT} AS ext,
  '/data/' || CASE lang WHEN 'en' THEN 'melanoma' WHEN 'de' THEN 'benign' ELSE 'unsorted' END || '/D' || CAST(doc_id AS VARCHAR) || {_EXT} AS path FROM documents)"""


@query("A2_filter_supported_format", sql.with_(_FILES, body="SELECT doc_id, path FROM named WHERE ext <> '.txt'"))
def filter_supported_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.filter_supported(_named_files(spark, sf_dir))


_LABELLED = "lab AS (SELECT doc_id, path, CASE folder WHEN 'melanoma' THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM named WHERE folder <> 'unsorted')"


@query("A3_label_from_directory", sql.with_(_FILES, _LABELLED, body="SELECT doc_id, path, label FROM lab"))
def label_from_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.label_from_directory(_named_files(spark, sf_dir))


@query(
    "A4_cap_per_class",
    sql.with_(
        _FILES, _LABELLED,
        body="""SELECT doc_id, path, label FROM (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY ((doc_id % 2147483648) * 2654435761 + 42 * 40503) % 4294967296, doc_id) AS k FROM lab) WHERE k <= 100""",
    ),
)
def cap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = images.label_from_directory(_named_files(spark, sf_dir))
    return images.cap_per_class(labelled, learn.shuffle_key(F.col("doc_id")), "doc_id", 100)


@query("A5_read_metadata", sql.with_(sql.META, body="SELECT isic_id, diagnosis_1 FROM meta"))
def read_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "metadata")
    tables.metadata(spark, sf_dir).write.option("header", "true").csv(folder)
    return images.read_metadata(spark, folder, images.METADATA_SCHEMA)


_RECOGNISED = """known AS (SELECT isic_id || '.jpg' AS filename, CASE diagnosis_1 WHEN 'Benign' THEN 'benign' ELSE 'melanoma' END AS folder
  FROM meta WHERE diagnosis_1 IN ('Benign', 'Malignant'))"""


@query("A6_route_by_diagnosis", sql.with_(sql.META, _RECOGNISED, body="SELECT k.filename, k.folder FROM known k JOIN files f ON f.filename = k.filename"))
def route_by_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.route_by_diagnosis(tables.metadata(spark, sf_dir), tables.listed_files(spark, sf_dir))


@query("A7_missing_files", sql.with_(sql.META, _RECOGNISED, body="SELECT filename, folder FROM known WHERE filename NOT IN (SELECT filename FROM files)"))
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.missing_files(tables.metadata(spark, sf_dir), tables.listed_files(spark, sf_dir))


@query(
    "A8_tolerate_bad_images",
    "SELECT doc_id AS image_id, n_chars < 100 AS broken FROM documents WHERE strlen(text) > 0",
)
def tolerate_bad_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents stand for files that failed to decode (height -1)."""
    rows = tables.document_images(spark, sf_dir).join(
        tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), "n_chars"), "image_id"
    )
    height = F.when(F.col("n_chars") < 100, F.lit(-1)).otherwise(F.col("image.height"))
    rows = rows.withColumn("image", F.col("image").withField("height", height))
    readable, broken = images.split_readable(rows)
    images.require_nonempty(readable)
    return readable.select("image_id", F.lit(False).alias("broken")).unionByName(
        broken.select("image_id", F.lit(True).alias("broken"))
    )


@query(
    "A9_require_both_classes",
    sql.with_(_FILES, _LABELLED, body="SELECT count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, count(DISTINCT label) = 2 AS ready FROM lab"),
)
def require_both_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = images.label_from_directory(_named_files(spark, sf_dir))
    images.require_both_classes(labelled)
    return images.class_counts(labelled)


@query(
    "A10_ingest_upload",
    sql.with_(
        *VERDICT_PARTS, recursive=True,
        body="""SELECT image_id, '20240301_101500_img_' || CAST(image_id AS VARCHAR) || '.bmp' AS stored,
  CASE WHEN reason <> 'Valid skin lesion image' THEN reason END AS reason FROM verdict""",
    ),
)
def ingest_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = cut(tables.discs(spark, sf_dir))
    verdict = validate.validate_images(validate.strips_shape(strips), strips)
    uploads = strips.select("image_id").distinct().select(
        "image_id",
        F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".bmp")).alias("filename"),
        F.lit("2024-03-01 10:15:00").cast("timestamp_ntz").alias("at"),
        F.lit(True).alias("readable"),
    )
    accepted, rejected, _ = images.ingest(uploads, verdict)
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query(
    "A11_write_feature_matrix",
    sql.with_(
        sql.FEATURES,
        body="SELECT label, " + ", ".join(f"{sql.r(f'avg(value) FILTER (WHERE name = $$f{i}$$)')} AS f{i}" for i in range(64)) + ", count(DISTINCT vec_id) AS n FROM feat GROUP BY label",
    ),
)
def write_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix written as CSV, read again and averaged per class."""
    folder = _folder(spark, "features")
    sinks.write_feature_matrix(tables.vector_features(spark, sf_dir), folder, 64)
    back = sinks.read_feature_matrix(spark, folder, 64)
    return rounded(back.groupBy("label").agg(*[F.avg(f"feature_{i}").alias(f"f{i}") for i in range(64)], F.count("*").alias("n")))


@query("A13_append_analysis_result", sql.with_(sql.RECORDS, body=f"SELECT analysis_id, filename, {sql.r('probability')} AS probability FROM rec"))
def append_analysis_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended twice; the second time nothing is new."""
    folder = _folder(spark, "analysis")
    rows = tables.analysis_records(spark, sf_dir).select(
        "analysis_id", "filename", F.col("timestamp"), results.prediction_label(F.col("predicted_class")).alias("prediction"), "probability"
    )
    sinks.append_analysis_results(rows, folder)
    sinks.append_analysis_results(rows, folder)
    return rounded(spark.read.parquet(folder).select("analysis_id", "filename", "probability"))


@query(
    "A14_append_training_record",
    sql.with_(
        sql.RECORDS,
        body=f"""SELECT batch AS classifier_type, CAST(sum(predicted_class) AS INT) AS melanoma_samples, CAST(count(*) - sum(predicted_class) AS INT) AS benign_samples,
  {sql.r('avg(probability)')} AS accuracy FROM rec GROUP BY batch""",
    ),
)
def append_training_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "training")
    runs = tables.analysis_records(spark, sf_dir).groupBy(F.col("batch").alias("classifier_type")).agg(
        F.sum("predicted_class").cast("int").alias("melanoma_samples"),
        (F.count("*") - F.sum("predicted_class")).cast("int").alias("benign_samples"),
        F.avg("probability").alias("accuracy"), F.max("timestamp").alias("timestamp"),
    )
    sinks.append_training_record(runs, folder)
    return rounded(spark.read.parquet(folder).drop("timestamp"))


# --- assembly ----------------------------------------------------------------------------------

_NAMES = [f"f{i}" for i in range(64)]
# Small values stand for features that could not be computed.
_HOLES = "CASE WHEN abs(value) >= 0.05 THEN value END"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = tables.long_features(spark, sf_dir)
    return long.where(F.abs("value") >= 0.05).select(F.col("vec_id").alias("image_id"), "name", "value")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vector_features(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "label")


@query("H14_texture_defaults", sql.with_(sql.FEATURES, body=f"SELECT vec_id AS image_id, name, {sql.r(f'coalesce({_HOLES}, 0.0)')} AS value FROM feat"))
def texture_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.complete(_holes(spark, sf_dir), _ids(spark, sf_dir), _NAMES))


@query(
    "I3_assemble_features",
    sql.with_(
        sql.FEATURES,
        body=f"""SELECT vec_id AS image_id, CAST(64 AS INT) AS size, {sql.r(f'sum(coalesce({_HOLES}, 0.0) * (CAST(substr(name, 2) AS INT) + 1))')} AS check_sum
FROM feat GROUP BY vec_id""",
    ),
)
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = assemble.assemble_features(_holes(spark, sf_dir), _NAMES)
    weighted = F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(matrix.select("image_id", F.size("features").alias("size"), weighted.alias("check_sum")))


@query(
    "I4_expand_list_features",
    sql.with_(
        _POINTS,
        body="SELECT image_id, 'centre_' || CAST(i AS VARCHAR) AS name, " + sql.r("CASE i WHEN 0 THEN m10 / m00 ELSE m01 / m00 END")
        + " AS value FROM mom, range(0, 2) AS t(i)",
    ),
)
def expand_list_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = shape.raw_moments(tables.discs(spark, sf_dir))
    lists = moments.select(
        "image_id", F.lit("centre").alias("name"),
        F.array(F.col("m10") / F.col("m00"), F.col("m01") / F.col("m00")).alias("values"),
    )
    return rounded(assemble.expand_lists(lists))


@query("I5_pad_ragged", sql.with_(sql.FEATURES, body=f"SELECT vec_id AS image_id, count(*) AS n, {sql.r(f'sum(coalesce({_HOLES}, 0.0))')} AS total FROM feat GROUP BY vec_id"))
def pad_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = assemble.complete(_holes(spark, sf_dir), _ids(spark, sf_dir), _NAMES)
    return rounded(full.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query("I6_nan_to_zero", sql.with_(sql.FEATURES, body=f"SELECT vec_id, name, {sql.r('CASE WHEN value > 0 THEN ln(value) ELSE 0.0 END')} AS value FROM feat"))
def nan_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms: undefined below 0 (NaN or null) and replaced."""
    raw = F.when(F.col("value") < 0, F.lit(float("nan"))).when(F.col("value") > 0, F.log("value"))
    long = tables.long_features(spark, sf_dir).withColumn("value", raw)
    return rounded(long.select("vec_id", "name", assemble.clean_value().alias("value")))


@query(
    "I7_named_feature_matrix",
    sql.with_(
        sql.FEATURES,
        body="SELECT vec_id AS image_id, CASE WHEN any_value(label) = 1 THEN 'melanoma' ELSE 'benign' END AS diagnosis, "
        + ", ".join(sql.r(f"coalesce(max({_HOLES}) FILTER (WHERE name = '{n}'), 0.0)") + f" AS {n}" for n in _NAMES)
        + " FROM feat GROUP BY vec_id",
    ),
)
def named_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.named_matrix(_holes(spark, sf_dir), _NAMES, _ids(spark, sf_dir)))


_GROUPS = {n: ("graph" if i < 16 else "color" if i < 40 else "texture") for i, n in enumerate(_NAMES)}


@query(
    "I8_feature_counts",
    sql.with_(
        sql.FEATURES,
        "seen AS (SELECT vec_id, CAST(substr(name, 2) AS INT) AS i FROM feat WHERE abs(value) >= 0.05)",
        body="""SELECT vec_id AS image_id, count(*) FILTER (WHERE i >= 16 AND i < 40) AS n_color, count(*) FILTER (WHERE i < 16) AS n_graph,
  count(*) FILTER (WHERE i >= 40) AS n_texture, count(*) FILTER (WHERE i >= 16) < 30 AS few FROM seen GROUP BY vec_id""",
    ),
)
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.feature_counts(_holes(spark, sf_dir), _GROUPS, 30)


@query("feature_matrix")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dataflow without resampling: one row of 983 features per raster."""
    matrix = flow.feature_matrix(tables.raster(spark, sf_dir))
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return matrix.select("image_id", F.size("features").alias("size"), total.alias("total"))


# --- streaming ---------------------------------------------------------------------------------


def _gate_scorer(rows: DataFrame) -> DataFrame:
    """Gates, and as score the share of the picture its largest dark region fills."""
    strips = cut(raster.to_strips(rows))
    verdict, largest = validate.gates(validate.strips_shape(strips), strips)
    share = largest.select("image_id", (F.col("area") / (64.0 * 64.0)).alias("probability"))
    return verdict.withColumnRenamed("reason", "validation").join(share, "image_id", "left")


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    source = _bitmaps(spark, sf_dir)
    good, bad, state = (_folder(spark, k) for k in ("scored", "quarantine", "stream"))
    running = streaming.score_stream(spark, source, _gate_scorer, good, bad, state, once=True)
    running.awaitTermination()
    return good, bad


@query(
    "M1_score_stream",
    sql.with_(
        *VERDICT_PARTS, recursive=True,
        body=f"""SELECT 'img_' || CAST(v.image_id AS VARCHAR) || '.bmp' AS filename, {sql.r('b.area / 4096.0')} AS probability
FROM verdict v JOIN big b USING (image_id) WHERE reason = 'Valid skin lesion image'""",
    ),
)
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.read.parquet(_streamed(spark, sf_dir)[0]).select("filename", "probability"))


@query(
    "M2_quarantine_stream",
    sql.with_(
        *VERDICT_PARTS, recursive=True,
        body="SELECT 'img_' || CAST(image_id AS VARCHAR) || '.bmp' AS filename, reason FROM verdict WHERE reason <> 'Valid skin lesion image'",
    ),
)
def quarantine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_streamed(spark, sf_dir)[1]).select("filename", "reason")
