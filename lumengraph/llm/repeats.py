"""Where a document's windows of symbols occur again, anywhere in the corpus.

A window's place is synchronised: of all short grams in it, the one of least hash is its
pick, so equal windows have equal picks. Neighbouring windows share a pick, which leaves one
pick for a few dozen windows. Then, in Spark,

1. picks are counted by gram; windows whose gram is alone are unique and drop out;
2. of picks with equal grams, those whose whole span (all windows with that pick) is equal
   repeat as a whole. One of each kind of span goes on, with its symbols, if its gram has
   spans of more than one kind;
3. inside such a gram the windows are told apart one by one, by the operator's own method.

Grams with many kinds of spans are split into pairs of bounded shards that cover all pairs
of spans. Texts are shuffled only when a bounded filter cannot rule out that they have
something to remove.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import texts
from lumengraph.llm.kernel import Sums, Words, anchors, byte_sums, slices
from lumengraph.session import cut

#: Kinds of spans of a gram in one shard.
SHARD = 1000
#: Bits of the filter of rows: 8 MB.
FILTER_BITS = 1 << 26
#: Symbols that a task tells apart at a time, about.
CHUNK = 1 << 19
#: Stands for a null id inside a run.
NO_ID = -(1 << 63)

#: Finds, for stretches of symbols of the same groups, which windows start in two of them:
#: (stretches, their groups, window) -> a mask of window starts for each.
Resolver = Callable[[list[np.ndarray], np.ndarray, int], list[np.ndarray]]


def _symbols(data: np.ndarray, bounds: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """(symbols of a slice, bounds of the rows in them, the words)."""
    if not words:
        return data, bounds, None
    found = Words(data, bounds)
    return found.hashes(data), found.first, found


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what tells rows apart: did, key. Rows that repeat both are alike in all results."""
    return texts(docs).withColumn("did", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("key", F.xxhash64("text"))


def _picks(rows: DataFrame, words: bool, window: int, gram: int) -> DataFrame:
    """gram, span, did, key, low, size of every pick."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, key = (batch.column(c).to_numpy() for c in ("did", "key"))
            for first, _, data, bounds in slices(batch.column("text")):
                symbols, edges, _ = _symbols(data, bounds, words)
                found = anchors(Sums(symbols) if words else byte_sums(symbols), edges, window, gram)
                row = found["row"]
                columns = [found["gram"].view(np.int64), found["span"].view(np.int64), did[first + row], key[first + row]]
                columns += [(found["low"] - edges[row]).astype(np.int32), (found["high"] - found["low"] + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "span", "did", "key", "low", "size"])

    return rows.select("did", "key", "text").mapInArrow(find, "gram long, span long, did long, key long, low int, size int")


def _place() -> Column:
    return F.pmod(F.xxhash64("did", "key"), F.lit(FILTER_BITS)).cast("int")


def _filter(wanted: DataFrame) -> Callable[[pa.Array | pd.Series], np.ndarray]:
    """A test of `_place`: false only for rows that are not among ``wanted``."""
    # the used bytes of a field of FILTER_BITS bits, however many rows there are
    used = wanted.select(_place().alias("place")).selectExpr("place div 8 AS byte", "shiftleft(1, place % 8) AS bit")
    found = used.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    field = np.zeros(FILTER_BITS >> 3, np.uint8)
    field[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = wanted.sparkSession.sparkContext.broadcast(field)
    return lambda place: (shared.value[(at := place.to_numpy()) >> 3] >> (at & 7) & 1).astype(bool)


def _maybe(test: Callable[[pa.Array | pd.Series], np.ndarray]) -> Column:
    @F.pandas_udf("boolean")
    def maybe(place: pd.Series) -> pd.Series:
        return pd.Series(test(place))

    return maybe(_place())


def _stretches(rows: DataFrame, kinds: DataFrame, words: bool, window: int) -> DataFrame:
    """``kinds`` (gram, did, key, low, size, alone) with the symbols of each span."""
    lists = cut(kinds.groupBy("did", "key").agg(F.collect_list(F.struct("low", "size", "gram", "alone")).alias("spans")))
    near = rows.where(_maybe(_filter(lists))).select("did", "key", "text").dropDuplicates(["did", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            spans = batch.column("spans").to_pylist()
            did, key = (batch.column(c).to_pylist() for c in ("did", "key"))
            for first, end, data, bounds in slices(batch.column("text")):
                symbols, edges, _ = _symbols(data, bounds, words)
                for i in range(first, end):
                    start = edges[i - first]
                    for s in spans[i]:
                        at = start + s["low"]
                        out.append((s["gram"], did[i], key[i], s["low"], s["alone"], symbols[at : at + s["size"] + window - 1].tobytes()))
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], ["gram", "did", "key", "low", "alone", "stretch"])

    return near.join(lists, ["did", "key"]).mapInArrow(read, "gram long, did long, key long, low int, alone boolean, stretch binary")


def _told_apart(stretches: DataFrame, kinds: DataFrame, words: bool, window: int, resolve: Resolver) -> DataFrame:
    """did, key, low, size of the runs of repeated windows in spans that are alone of their kind."""
    shards = kinds.groupBy("gram").agg((1 + F.floor((F.count(F.lit(1)) - 1) / SHARD)).cast("int").alias("shards"))
    dealt = stretches.join(shards, "gram").withColumn("own", F.pmod(F.xxhash64("did", "key", "low"), F.col("shards")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")
    dealt = dealt.select("gram", "own", other, "did", "key", "low", "alone", "stretch")
    dealt = dealt.select("gram", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "did", "key", "low", "alone", "stretch")
    dealt = dealt.repartition("gram", "one", "two").sortWithinPartitions("gram", "one", "two")
    kind = np.uint64 if words else np.uint8

    def work(held: list[tuple]) -> pa.RecordBatch:
        group, did, key, low, alone, raw = zip(*held, strict=True)
        masks = resolve([np.frombuffer(r, kind) for r in raw], np.array(group), window)
        out: list[tuple] = []
        for i, mask in enumerate(masks):
            if alone[i] and mask.any():
                edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                out += [(did[i], key[i], low[i] + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["did", "key", "low", "size"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, number, symbols = None, 0, 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("gram", "one", "two", "did", "key", "low", "alone", "stretch")), strict=True)
            for gram, one, two, *rest in rows:
                if (gram, one, two) != at:
                    if symbols > CHUNK:
                        yield work(held)
                        held, symbols = [], 0
                    at, number = (gram, one, two), number + 1
                held.append((number, *rest))
                symbols += len(rest[-1]) // kind().itemsize
        if held:
            yield work(held)

    return dealt.mapInArrow(stream, "did long, key long, low int, size int")


def repeated_runs(rows: DataFrame, words: bool, window: int, gram: int, resolve: Resolver) -> DataFrame:
    """did, key, runs: for each row with repeated windows the (low, size) runs of their starts."""
    picks = _picks(rows, words, window, gram)
    grams = picks.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).where("n > 1")
    # written first: a join right behind the sum could not split a gram with a large share of all picks
    grams = cut(grams.select("gram", (F.col("lo") != F.col("hi")).alias("mixed")))
    again = cut(picks.join(grams, "gram"))
    whole = again.where("not mixed").select("did", "key", "low", "size")
    mixed = again.where("mixed")
    kinds = cut(mixed.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "key", "low", "size")).alias("one")))
    whole_too = mixed.join(kinds.where("n > 1").select("gram", "span"), ["gram", "span"]).select("did", "key", "low", "size")
    kinds = kinds.select("gram", "one.*", (F.col("n") == 1).alias("alone"))
    apart = _told_apart(_stretches(rows, kinds, words, window), kinds, words, window, resolve)
    runs = whole.unionByName(whole_too).unionByName(apart)
    return runs.groupBy("did", "key").agg(F.collect_set(F.struct("low", "size")).alias("runs"))


def _covered(runs: list[list[dict] | None], edges: np.ndarray, window: int) -> np.ndarray:
    """The symbols of a slice that a repeated window covers."""
    steps = np.zeros(int(edges[-1]) + 1, np.int64)
    for i, own in enumerate(runs):
        for run in own or ():
            steps[edges[i] + run["low"]] += 1
            steps[edges[i] + run["low"] + run["size"] + window - 1] -= 1
    return np.cumsum(steps[:-1]) > 0


#: (bytes, bounds, covered symbols, bounds of rows in the symbols, words) -> a row for each text.
Reporter = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, "Words | None"], Iterator[tuple]]


def remove_repeats(docs: DataFrame, words: bool, window: int, gram: int, resolve: Resolver, report: Reporter, schema: str) -> DataFrame:
    """doc_id and what ``report`` says of each row."""
    rows = _keyed(docs)
    runs = cut(repeated_runs(rows, words, window, gram, resolve))
    test = _filter(runs)
    names = [part.split()[0] for part in schema.split(", ")]

    def tell(doc_id: pa.Array, text: pa.Array, own: list[list[dict] | None]) -> pa.RecordBatch:
        out: list[tuple] = []
        for first, end, data, bounds in slices(text):
            _, edges, found = _symbols(data, bounds, words)
            out += report(data, bounds, _covered(own[first:end], edges, window), edges, found)
        columns = [pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string() if n.endswith("256") else pa.int64()) for n in names]
        return pa.RecordBatch.from_arrays([doc_id, *columns], ["doc_id", *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = pa.array(~test(batch.column("place")))
            doc_id, text = (batch.column(c).filter(alone) for c in ("doc_id", "text"))
            yield tell(doc_id, text, [None] * len(text))

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield tell(batch.column("doc_id"), batch.column("text"), batch.column("runs").to_pylist())

    alone = rows.select("doc_id", "text", _place().alias("place")).mapInArrow(whole, f"doc_id long, {schema}")
    near = rows.where(_maybe(test)).join(runs, ["did", "key"], "left").select("doc_id", "text", "runs")
    return alone.unionByName(near.mapInArrow(partly, f"doc_id long, {schema}"))
