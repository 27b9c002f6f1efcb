"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram vector binds (multiplies) the
letters' vectors, each permuted (rolled) by its place; a text or a language bundles (adds)
the vectors of its trigrams. A text takes the language whose prototype has the greatest
cosine with it.

The dot product of a text's bundle with a prototype is the sum, over its trigrams, of the
trigram vector's dot product with the prototype. These are tabled once for all trigrams, so
a text of any length costs a table look-up for each letter. The bundle's length is taken as
sqrt(dimensions * sum of squared trigram counts), its expectation, as random vectors are
nearly orthogonal; it is the same for all languages and cannot change a prediction.

Letters are lower-cased characters of Unicode's letter classes; a to z have vectors of their
own, others share 37 by a hash. Null texts and texts without letters are ``und`` with score
0, and so is everything when there is nothing to learn from. Ties go to the first language
by name. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import fold, small_batches
from lumengraph.llm.kernel import mix, seeded

UNKNOWN = "und"
DIMENSIONS = 2048
SYMBOLS, BITS = 64, 6
CODES = SYMBOLS**3
#: Texts of a slice hold about as many characters, or are one text.
SLICE_CHARS = 1 << 20
#: The pipeline rejects texts whose best cosine is below; unrelated text is near 0.
LEAST_COSINE = 0.05

_tables: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """The symbol of every code point: 0 for what is no letter."""
    if not _tables:
        table = np.zeros(0x110000, np.uint8)
        points = np.flatnonzero(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)).astype(np.uint64)
        table[points] = 27 + (mix(points) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _tables.append(table)
    return _tables[0]


def _trigrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, trigram codes, row of each code) of slices of the texts."""
    first = 0
    while first < len(texts):
        end, size = first, 0
        lowered = []
        while end < len(texts) and (end == first or size + len(texts[end] or "") <= SLICE_CHARS):
            lowered.append((texts[end] or "").lower())
            size += len(lowered[-1]) + 1
            end += 1
        points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = _symbols()[points]
        bounds = np.cumsum([len(x) + 1 for x in lowered])
        kept = symbol != 0
        kept[1:] |= symbol[:-1] != 0  # one gap after a word
        place = np.flatnonzero(kept)
        symbol = np.concatenate([[0], symbol[place]]).astype(np.int32)
        codes = (symbol[:-2] << 2 * BITS) | (symbol[1:-1] << BITS) | symbol[2:]
        inside = symbol[1:-1] != 0
        yield first, end, codes[inside], np.searchsorted(bounds, place[:-1][inside], side="right")
        first = end


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, code, n over all rows of ``docs`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, end, codes, row in _trigrams(batch.column("text").to_pylist()):
                own = langs[first:end]
                for lang in set(own):
                    counts = np.bincount(codes[(own == lang)[row]], minlength=CODES)
                    total[lang] = total.get(lang, 0) + counts
        for lang, counts in total.items():
            code = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(counts[code])], ["lang", "code", "n"])

    small_batches(docs.sparkSession)
    partial = docs.select("text", "lang").mapInArrow(count, "lang string, code int, n long")
    return partial.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    a, b, c = codes >> 2 * BITS, codes >> BITS & SYMBOLS - 1, codes & SYMBOLS - 1
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` (text, lang), and each trigram's dot product with their unit prototypes.

    What reaches the driver are trigram counts: at most 64**3 for each language.
    """
    rows = trigram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")).toPandas()
    langs = sorted(rows["lang"].unique())
    letters = (seeded(29, SYMBOLS * dimensions) >> np.uint64(63)).astype(np.int8).reshape(SYMBOLS, dimensions) * 2 - 1
    prototypes = np.zeros((len(langs), dimensions), np.float64)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        code, n = own["code"].to_numpy(), own["n"].to_numpy().astype(np.float64)
        for at in range(0, len(code), 4096):
            prototypes[i] += n[at : at + 4096] @ _vectors(code[at : at + 4096], letters)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)
    dots = np.zeros((CODES, len(langs)), np.float32)
    for at in range(0, CODES, 4096):
        dots[at : at + 4096] = _vectors(np.arange(at, at + 4096), letters).astype(np.float32) @ prototypes.T.astype(np.float32)
    return langs, dots


def _scored(texts: list[str | None], table: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number (the number of languages if none) and its cosine, of each text."""
    langs = table.shape[1]
    best, cosine = np.full(len(texts), langs), np.zeros(len(texts))
    for first, end, codes, row in _trigrams(texts) if langs else ():
        n = end - first
        sums = np.stack([np.bincount(row, table[codes, i], n) for i in range(langs)])
        kinds, times = np.unique(row.astype(np.int64) << 3 * BITS | codes, return_counts=True)
        squares = np.bincount(kinds >> 3 * BITS, times.astype(np.float64) ** 2, n)
        found = squares > 0
        best[first:end] = np.where(found, sums.argmax(axis=0), langs)
        cosine[first:end] = np.where(found, sums.max(axis=0) / np.sqrt(np.maximum(squares, 1) * dimensions), 0)
    return best, np.clip(cosine, 0, 1)


def identify(docs: DataFrame, langs: list[str], dots: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(dots)
    names = np.array([*langs, UNKNOWN], object)
    others = [f for f in docs.schema.fields if f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, cosine = _scored(batch.column("text").to_pylist(), shared.value, dimensions)
            columns = [*(batch.column(f.name) for f in others), pa.array(names[best], pa.string()), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in others), "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(score, f"{kinds}, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from labelled texts outside fold 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold() == 0).alias("held_out"), "lang")
    langs, dots = learn(rows.where(fold() > 0))
    return identify(rows.select("doc_id", "held_out", "text"), langs, dots)


def drop_unidentified(docs: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """The rows whose language is known: neither ``und`` nor with a cosine below ``least``."""
    langs, dots = learn(docs.where(fold("doc_id") > 0).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(dots)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        best, cosine = _scored(text.tolist(), shared.value, DIMENSIONS)
        return pd.Series((best < shared.value.shape[1]) & (cosine >= least))

    return docs.where(known(F.col("text")))
