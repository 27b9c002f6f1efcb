"""Exact duplicates by two passes over a Bloom filter of text hashes.

The first pass sets bits and notes which bits are set twice; the second lets every row whose
bits are not all noted pass straight through. Only possibly repeated rows are shuffled.

Null text counts as empty; empty texts are equal to each other. Of equal texts the row with
the smallest id stays; rows with a null id stay only when no other row of the group has an
id. When a row repeats id and text, one of the repeats stays. An empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.llm.common import GAP, texts
from lumengraph.session import cut

SLICE_BITS = 1 << 20
#: Bits of the filter for each row, and at most: 32 MB. Beyond that more rows count as
#: possibly repeated and shuffle, and results stay the same.
BITS_PER_ROW, MAX_BITS = 16, 1 << 28


def _places(sha: pa.Array, bits: int) -> np.ndarray:
    """Two filter places for each hash, from its first 16 hex digits."""
    raw = np.frombuffer("".join(sha.to_pylist()).encode(), np.uint8).reshape(-1, 64)[:, :16]
    digit = np.where(raw >= 97, raw - 87, raw - 48).astype(np.uint64)
    weight = np.uint64(1) << (np.arange(7, -1, -1, dtype=np.uint64) * np.uint64(4))
    return np.stack([digit[:, :8] @ weight, digit[:, 8:] @ weight]).astype(np.int64) & (bits - 1)


def _note(bits: int):
    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(bits, bool), np.zeros(bits, bool)
        empty = True
        for batch in batches:
            if not batch.num_rows:
                continue
            empty = False
            place, times = np.unique(_places(batch.column("text_sha256"), bits), return_counts=True)
            again[place[(times > 1) | seen[place]]] = True
            seen[place] = True
        if not empty:
            for start in range(0, bits, SLICE_BITS):
                part = slice(start, start + SLICE_BITS)
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([start // SLICE_BITS], pa.int32()), "seen": [np.packbits(seen[part]).tobytes()], "again": [np.packbits(again[part]).tobytes()]}
                )

    return note


def _fold_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the notes of each slice; rows arrive sorted by slice."""
    at, seen, again = None, None, None
    for batch in batches:
        for number, a, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "seen", "again")), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if number != at:
                if at is not None:
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "again": [again.tobytes()]})
                at, seen, again = number, a.copy(), b.copy()
            else:
                again |= b | (seen & a)
                seen |= a
    if at is not None:
        yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "again": [again.tobytes()]})


def repeated_bits(hashed: DataFrame, bits: int) -> np.ndarray:
    """The filter places set more than once by the column ``text_sha256``; ``bits`` / 8 bytes reach the driver."""
    notes = hashed.select("text_sha256").mapInArrow(_note(bits), "slice int, seen binary, again binary")
    merged = notes.repartition(max(1, bits // SLICE_BITS), "slice").sortWithinPartitions("slice").mapInArrow(_fold_slices, "slice int, again binary")
    filled = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():
        start = row["slice"] * SLICE_BITS // 8
        filled[start : start + SLICE_BITS // 8] = np.frombuffer(row["again"], np.uint8)
    return filled


def normal_hash(text: Column) -> Column:
    """SHA-256 of a text with every gap as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAP, " "), 256)


def possibly_repeated(hashed: DataFrame, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> Callable[[Column], Column]:
    """A test of a hash column: false only for hashes that ``hashed.text_sha256`` has once."""
    rows = hashed.count()
    bits = min(max_bits, max(SLICE_BITS, 1 << max(0, rows * bits_per_row - 1).bit_length()))
    shared = hashed.sparkSession.sparkContext.broadcast(repeated_bits(hashed, bits))

    @F.pandas_udf("boolean")
    def probe(sha: pd.Series) -> pd.Series:
        if not len(sha):
            return pd.Series([], dtype=bool)
        place = _places(pa.array(sha), bits)
        return pd.Series((shared.value[place >> 3] >> (7 - (place & 7)) & 1).astype(bool).all(axis=0))

    return probe


def exact_duplicates(docs: DataFrame, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    hashed = cut(texts(docs).select("doc_id", normal_hash(F.col("text")).alias("text_sha256")))
    probed = hashed.withColumn("maybe", possibly_repeated(hashed, bits_per_row, max_bits)(F.col("text_sha256")))
    alone = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # repeats of an id are told apart, so that one row of a group stays
    turn = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0)))
    maybe = probed.where("maybe").select("doc_id", "text_sha256", turn.alias("turn"))
    groups = probed.where("maybe").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    together = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), "text_sha256"
    )
    return alone.unionByName(together)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group of equal texts."""
    hashed = cut(texts(docs).select("doc_id", normal_hash(F.col("text")).alias("text_sha256")))
    keyed = docs.withColumn("__sha", normal_hash(F.col("text")))
    keyed = keyed.withColumn("__maybe", possibly_repeated(hashed)(F.col("__sha")))
    alone = keyed.where("not __maybe")
    first = hashed.groupBy(F.col("text_sha256").alias("__first_sha")).agg(F.min("doc_id").alias("__first"), F.count(F.lit(1)).alias("__size")).where("__size > 1")
    match = (F.col("__sha") == F.col("__first_sha")) & ~F.col("doc_id").cast("long").eqNullSafe(F.col("__first"))
    rest = keyed.where("__maybe").join(first, match, "left_anti").dropDuplicates(["__sha"])
    return alone.unionByName(rest).select(*docs.columns)
