"""Inputs of the registered queries, derived by Spark from the given tables.

Every table below is built from all rows of its source, so its size follows the
source: 50 consecutive vectors are one 64-wide raster, each supplier is one 64x64
picture, 20 consecutive vectors are the nodes of one graph, each document's bytes
are one image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RASTER_LINES = 50
RASTER_WIDTH = 64
DISC_SIDE = 64
GRAPH_NODES = 20
GRAPH_THRESHOLD = 0.75


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores before an expansion; the tables come in a few small files."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, 8), *keys)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of the vector rasters; each vector is one line of 64 pixels."""
    vectors = read(spark, sf_dir, "embeddings")
    line = F.col("vec_id") % RASTER_LINES
    byte = lambda v: F.least(
        F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 255.0 + 127.5).cast("int"))
    )
    turned = lambda by: F.concat(
        F.slice("embedding", by + 1, RASTER_WIDTH - by), F.slice("embedding", 1, by)
    )
    strips = vectors.select(
        F.floor(F.col("vec_id") / RASTER_LINES).cast("int").alias("image_id"),
        line.cast("int").alias("y"),
        F.transform("embedding", byte).alias("r"),
        F.transform(turned(21), byte).alias("g"),
        F.transform(turned(42), byte).alias("b"),
    )
    sizes = strips.groupBy("image_id").agg((F.max("y") + 1).alias("height"))
    return strips.join(sizes, "image_id").select(
        "image_id", "y", "height", F.lit(RASTER_WIDTH).alias("width"), "r", "g", "b"
    )


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips with a mask: a dark spot on skin for each supplier.

    Some pictures have other than skin around the spot, some spots have no texture,
    some have a bright hole, and some pictures a second, small spot.
    """
    n = DISC_SIDE
    k, y = F.col("image_id"), F.col("y")
    lines = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y")
    )
    # Half the width of a line's share of the spot and of its hole, -1 where there is none. Lines are put
    # together from stretches: a condition for each pixel would cost more than the queries.
    half = lambda square: F.when(square >= 0, F.floor(F.sqrt(square.cast("double")))).otherwise(F.lit(-1)).cast("int")
    off = (y - 32) * (y - 32)
    lines = spread(lines.select(
        "image_id", "y",
        half((k % 16 + 8) * (k % 16 + 8) - off).alias("spot"),
        F.when(k % 4 == 1, half(F.lit(9) - off)).otherwise(F.lit(-1)).alias("hole"),
        ((k % 3 == 2) & y.between(3, 7)).alias("second"),
    ), "image_id", "y")
    tones = {"r": (90, 32, 220, 60), "g": (50, 27, 170, 160), "b": (30, 23, 140, 220)}
    grain = spark.range(n).select(
        F.col("id").cast("int").alias("y"),
        *[F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x * 7 + F.col("id").cast("int") * 13) % m + inside).alias(f"{c}_grain") for c, (inside, m, _, _) in tones.items()],  # noqa: B023
    )
    lines = lines.join(F.broadcast(grain), "y")  # 64 rows
    spot, hole = F.col("spot"), F.col("hole")

    def stretches(dark: Column, light: Column) -> Column:
        """A line of ``light`` with ``dark`` in the spot but its hole, and in the second spot."""
        cut_out = lambda of, x0, x1: F.slice(of, x0 + 1, x1 - x0)
        plain = F.when(F.col("second"), F.concat(cut_out(light, F.lit(0), F.lit(3)), cut_out(dark, F.lit(3), F.lit(8)), cut_out(light, F.lit(8), F.lit(n)))).otherwise(light)
        left, right = F.lit(32) - spot, F.lit(33) + spot
        middle = F.when(hole < 0, cut_out(dark, left, right)).otherwise(
            F.concat(cut_out(dark, left, F.lit(32) - hole), cut_out(light, F.lit(32) - hole, F.lit(33) + hole), cut_out(dark, F.lit(33) + hole, right))
        )
        return F.when(spot < 0, plain).otherwise(F.concat(cut_out(plain, F.lit(0), left), middle, cut_out(plain, right, F.lit(n))))

    def tone(c: str) -> Column:
        inside, _, skin, other = tones[c]
        dark = F.when(k % 7 == 0, F.array_repeat(F.lit(inside), n)).otherwise(F.col(f"{c}_grain"))
        return stretches(dark, F.array_repeat(F.when(k % 5 == 3, F.lit(other)).otherwise(F.lit(skin)), n)).alias(c)

    outside = F.array_repeat(F.lit(False), n)
    share = F.concat(F.array_repeat(F.lit(False), 32 - spot), F.array_repeat(F.lit(True), spot * 2 + 1), F.array_repeat(F.lit(False), 31 - spot))
    return lines.select(
        "image_id",
        "y",
        F.lit(n).alias("height"),
        F.lit(n).alias("width"),
        *[tone(c) for c in tones],
        F.when(spot < 0, outside).otherwise(share).alias("mask"),
    )


def disc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures cut into 16 square cells: strips with ``seg``."""
    cell = F.transform(
        F.sequence(F.lit(0), F.lit(DISC_SIDE - 1)),
        lambda x: F.floor(F.col("y") / 16).cast("int") * 4 + F.floor(x / 16).cast("int"),
    )
    return discs(spark, sf_dir).withColumn("seg", cell)


#: First dimension, number of dimensions and scale of a node's values; together all 64 dimensions.
NODE_SHARES = {"l": (1, 13, 100.0), "a": (14, 13, 100.0), "b": (27, 13, 100.0), "cy": (40, 13, 1.0), "cx": (53, 12, 1.0)}
#: About the root of the dimensions in a share: sums spread like single dimensions.
NODE_SPREAD = 3.6


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with colour and position, each the scaled sum of its share of the vector's dimensions."""
    total = lambda first, n: F.aggregate(F.slice("embedding", first, n), F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / GRAPH_NODES).cast("int").alias("image_id"),
        (F.col("vec_id") % GRAPH_NODES).cast("int").alias("node"),
        *[(total(first, n) * by / NODE_SPREAD).alias(name) for name, (first, n, by) in NODE_SHARES.items()],
    )


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes as an image row, 48 bytes a line, zeros at the end.

    Every third document is a three-channel image, the others have one and four
    channels, so all three storage forms occur.
    """
    docs = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("raw")
    )
    channels = F.when(F.col("image_id") % 3 == 0, 3).when(F.col("image_id") % 3 == 1, 1).otherwise(4)
    height = F.ceil(F.length("raw") / 48).cast("int")
    padded = F.rpad("raw", (height * 48).cast("int"), F.unhex(F.lit("00")))
    return docs.where(F.length("raw") > 0).select(
        "image_id",
        F.struct(
            F.concat(F.lit("doc/"), F.col("image_id").cast("string"), F.lit(".png")).alias("origin"),
            height.alias("height"),
            F.floor(F.lit(48) / channels).cast("int").alias("width"),
            channels.cast("int").alias("nChannels"),
            padded.alias("data"),
        ).alias("image"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth from labels, a score from the document length (with ties)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    score = (F.col("n_chars") % 1000) / 1000.0
    return (
        read(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            F.col("quality").cast("int").alias("label"),
            score.alias("score"),
            (score > 0.5).cast("int").alias("prediction"),
            (F.col("doc_id") % 5).cast("int").alias("fold"),
            "lang",
        )
    )


def vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a feature matrix with a 0/1 label."""
    return read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        (F.col("label") % 2).cast("double").alias("label"),
    )


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrix as ``vec_id, label, name, value`` rows."""
    return vector_features(spark, sf_dir).select(
        "vec_id", "label", F.posexplode("features").alias("place", "value")
    ).select("vec_id", "label", F.concat(F.lit("f"), F.col("place").cast("string")).alias("name"), "value")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("isic_id"),
        F.when(kind == 0, "Benign").when(kind == 1, "Malignant").otherwise("Other").alias("diagnosis_1"),
    )


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename")
    )


def analysis_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of scored images."""
    p = F.col("value") / (F.col("value") + 100.0)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("analysis_id"),
        F.concat(F.lit("img_"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("filename"),
        F.col("ts").alias("timestamp"),
        p.alias("probability"),
        (p > 0.5).cast("int").alias("predicted_class"),
        F.col("event_type").alias("batch"),
    )


def write_bitmaps(strips: DataFrame, folder: str) -> None:
    """Write strips as BMP files ``<folder>/<class>/img_<id>.bmp`` from the tasks.

    The folder must be reachable as a path by every executor. A picture is one file,
    so its lines meet in one row.
    """
    line = F.flatten(F.transform(F.arrays_zip("b", "g", "r"), lambda s: F.array(s["b"], s["g"], s["r"])))
    whole = strips.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("y", line.alias("bytes")))).alias("lines"),
        F.max("width").alias("width"), F.max("height").alias("height"),
    )

    def save(rows) -> None:
        import os
        import struct

        for row in rows:
            w, h = row["width"], row["height"]
            pad = b"\0" * (-3 * w % 4)
            body = b"".join(bytes(r["bytes"]) + pad for r in reversed(row["lines"]))
            head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
            info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
            place = os.path.join(folder, "melanoma" if row["image_id"] % 2 else "benign")
            os.makedirs(place, exist_ok=True)
            with open(os.path.join(place, f"img_{row['image_id']}.bmp"), "wb") as out:
                out.write(head + info + body)

    whole.foreachPartition(save)
