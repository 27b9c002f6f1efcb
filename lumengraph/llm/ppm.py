"""Code length of documents by prediction by partial matching.

A text is its lower-cased words, each closed by a gap, then one end. Bytes are predicted
from the seven bytes before them, back to the gap before the text. In each context an unseen
byte costs an escape, with probability q / 2n for q distinct bytes in n occurrences, and a
byte seen c times has (2c - 1) / 2n (method D); the next shorter context then leaves out the
bytes of the longer one (exclusion), down to all bytes being equally likely. A shorter
context counts a byte once for each longer context that has it (update exclusion). Counts
come from all training texts; one model scores every text, a training text's own bytes
being among those it has seen.

Tasks sum the leaves of the context trie (seven bytes and the next) over units of about
`UNIT_BYTES` of texts before they hand them on, sorted and packed, dealt out by the last three
bytes of the context, so that one task has all longer contexts of a leaf; contexts of two
bytes and fewer are small tables. Costs come back for each distinct leaf of a unit, in the same
order, as ranks in the list of the distinct 32-bit floats, and meet the unit's texts, which wait packed. Both shuffles go
slice after slice, `SLICES` each, whose files are deleted before the next, so that no table is twice on disk as a whole.

For the base score, frequent words, at most `FREQUENT`, go to the tasks as sorted arrays;
tokens of all other words are joined.

Null or empty text has no words and costs the end alone. Repeated rows are scored each. Rows
with a null id count as training texts. With no training rows all bytes are equally likely,
and the base score is that of its formula with N and V 0. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm.common import fold, texts
from lumengraph.llm.kernel import LOWER, Words, byte_sums, mix, slices
from lumengraph.session import cut, scratch, shared_dir

ORDER = 7
#: Contexts are dealt out by their last bytes, so many; counts of shorter ones go to all tasks.
SHORT = 3
GAP, END = 0x20, 0x0A
#: Words sent to all tasks, at most: 25 bytes each.
FREQUENT = 1 << 19
#: Distinct words of slices that a task keeps before it hands them on.
HELD = 1 << 20
#: Bytes of the texts whose leaves are summed together, about; and of all texts for each part of the contexts.
UNIT_BYTES, PART_BYTES = 10 << 20, 2 << 20
#: Shares of the parts, and of the units, that are shuffled one after the other.
SLICES = 4

#: The word that stands for the end of a text; no word has the byte.
END_WORD = bytes([END])


def end_hash() -> int:
    data = np.frombuffer(END_WORD, np.uint8)
    return int(byte_sums(data).of(np.array([0]), np.array([1])).view(np.int64)[0])


def word_counts(rows: DataFrame) -> DataFrame:
    """hash, n (in training texts), total of the distinct words of ``rows`` (text, training)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        hashes, n, total = (np.concatenate([h[i] for h in held]) for i in range(3))
        kinds, place = np.unique(hashes, return_inverse=True)
        sums = [np.bincount(place, x, len(kinds)).astype(np.int64) for x in (n, total)]
        return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *map(pa.array, sums)], ["hash", "n", "total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            training = np.array(batch.column("training").to_pylist(), bool)
            for first, end, data, bounds in slices(batch.column("text")):
                data = LOWER[data]
                words = Words(data, bounds)
                row = np.repeat(training[first:end], np.diff(words.first))
                kinds, place = np.unique(words.hashes(data), return_inverse=True)
                held.append((kinds, np.bincount(place, row, len(kinds)), np.bincount(place, minlength=len(kinds))))
                if sum(len(h[0]) for h in held) > HELD:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    parts = rows.mapInArrow(count, "hash long, n long, total long")
    return parts.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class _Counts:
    """Counts of (context, byte) pairs of one order, sorted by pair."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray):
        seen = n > 0
        pairs, n = context[seen] << np.uint64(8) | byte[seen], n[seen]
        if not (pairs[1:] > pairs[:-1]).all():
            pairs, place = np.unique(pairs, return_inverse=True)
            n = np.bincount(place, n, len(pairs))
        self._sum(pairs, n)

    def _sum(self, pairs: np.ndarray, n: np.ndarray) -> None:
        self.pairs, self.n, context = pairs, n, pairs >> np.uint64(8)
        new = np.append(True, context[1:] != context[:-1])[: len(pairs)]
        place = np.cumsum(new) - 1
        self.contexts = context[new]
        self.total = np.bincount(place, n, len(self.contexts))
        self.kinds = np.bincount(place, minlength=len(self.contexts)).astype(np.float64)

    def shorter(self, order: int) -> _Counts:
        """The counts one order lower: a byte counts once for each of the contexts here that has it."""
        out = object.__new__(_Counts)
        out._sum(*np.unique(self.pairs & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True))
        return out

    def of(self, context: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _look(self.pairs, self.n, context << np.uint64(8) | byte)

    def sums(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _look(self.contexts, self.total, context), _look(self.contexts, self.kinds, context)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def code_lengths(leaf: np.ndarray, n: np.ndarray, shorter: tuple[_Counts, ...]) -> np.ndarray:
    """log10 of the probability of each leaf's byte in its context.

    All leaves whose contexts share their last `SHORT` bytes must be given together; ``shorter``
    has the counts of the orders below over all leaves, from the longest down.
    """
    byte, history = leaf & np.uint64(255), leaf >> np.uint64(8)
    out, rest = np.zeros(len(leaf)), np.arange(len(leaf))  # rest: leaves that no longer context had
    above: _Counts | None = None
    for order in range(ORDER, -1, -1):
        context = history[rest] & np.uint64((1 << 8 * order) - 1)
        if order < SHORT:
            counts = shorter[SHORT - 1 - order]
        elif above is None:
            counts = _Counts(history, byte, n)
        else:
            counts = above.shorter(order)
        total, kinds = counts.sums(context)
        if above is not None:  # leave out the bytes of the longer context
            longer = above.pairs >> np.uint64(8)
            again = counts.of(longer & np.uint64((1 << 8 * order) - 1), above.pairs & np.uint64(255))
            left_out = np.bincount(np.searchsorted(above.contexts, longer), again, len(above.contexts))
            wanted = history[rest] & np.uint64((1 << 8 * (order + 1)) - 1)
            total = total - _look(above.contexts, left_out, wanted)
            kinds = kinds - _look(above.contexts, above.kinds, wanted)
        own = counts.of(context, byte[rest])
        hit, miss = (kinds > 0) & (own > 0), (kinds > 0) & (own == 0)
        out[rest[hit]] += np.log10((own[hit] - 0.5) / total[hit])
        out[rest[miss]] += np.log10(0.5 * kinds[miss] / total[miss])
        rest = rest[~hit]
        if not len(rest):
            return out
        above = counts
    out[rest] -= np.log10(np.maximum(256.0 - shorter[-1].kinds.sum(), 1.0))
    return out


def running_leaves(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of every byte of every text's running words and end, number of leaves of each text) of a lower-cased slice."""
    words = Words(data, bounds)
    rows = len(bounds) - 1
    # each text is a pad up to the gap before it, its words with their closing gaps, and the end
    edge = np.stack([words.first[:-1], words.first[1:]], axis=1).ravel()
    size = np.insert(words.end - words.start + 1, edge, np.tile([ORDER, 1], rows))
    source = np.insert(words.start, edge, 0)
    last = np.insert(np.full(len(words.start), GAP, np.uint8), edge, np.tile(np.array([GAP, END], np.uint8), rows))
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if rows else 0) + np.repeat(source - (stop - size), size)
    line = np.append(data, np.uint8(0))[np.minimum(at, len(data))]
    line[stop - 1] = last
    opening = edge[::2] + 2 * np.arange(rows)
    pad = ((stop - size)[opening][:, None] + np.arange(ORDER)).ravel()
    line[pad.reshape(-1, ORDER)[:, :-1].ravel()] = 0
    leaf = line.astype(np.uint64)
    for shift in (1, 2, 4):  # of 1, 2 and 4 bytes: eight together
        leaf[shift:] |= leaf[:-shift] << np.uint64(8 * shift)
    inside = np.ones(len(line), bool)
    inside[pad] = False
    return leaf[inside], np.diff(np.append((stop - size)[opening], len(line))) - ORDER


def _turned(leaf: np.ndarray) -> np.ndarray:
    """Leaves with their last context byte first, so that sorted ones share their beginnings; turned again, as they were."""
    return (leaf >> np.uint64(8)).byteswap() | (leaf & np.uint64(255))


def _packed(values: np.ndarray) -> bytes:
    """The values byte by byte, the first bytes of all, then the second; sorted ones shrink well."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(packed, size * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, size).T).view(kind).ravel()


def _ranked(values: np.ndarray, code: np.ndarray) -> tuple[int, bytes, bytes]:
    """``values[code]`` as the number of its distinct values, these by falling frequency, and their ranks; both packed."""
    times = np.bincount(code, minlength=len(values))
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    rank = np.empty(len(values), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return len(order), _packed(values[order]), _packed(rank[code])


def _dealt(kinds: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the sorted turned leaves by part, bounds of the parts in it); a part has all leaves of the last bytes of a context."""
    part = (mix(kinds >> np.uint64(64 - 8 * SHORT)) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


#: Columns of a unit, by kind: 0 are slices of its texts, 1 its leaves and their counts in training texts for each part,
#: 2 the ends of its training leaves, `SHORT` bytes and the next.
_UNIT = pa.schema(
    {
        "kind": pa.int32(), "slice": pa.int32(), "unit": pa.int64(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "text": pa.list_(pa.int64()), "bounds": pa.list_(pa.int64()),
        "body": pa.binary(), "part": pa.int32(), "size": pa.int32(), "leaf": pa.binary(), "n": pa.binary(),
    }
)
_UNIT_SQL = (
    "kind int, slice int, unit long, doc_id array<long>, held_out array<boolean>, text array<long>, bounds array<long>, body binary, part int, size int, leaf binary, n binary"
)


_COSTS_SQL = "slice int, unit long, part int, size int, listed int, values binary, cost binary"


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    """The distinct values of sorted arrays, sorted; runs are merged, where `np.unique` would hash all values."""
    leaf = np.concatenate(held or [np.zeros(0, np.uint64)])
    leaf.sort(kind="stable")
    return leaf[np.append(True, leaf[1:] != leaf[:-1])[: len(leaf)]]


def _kinds(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct leaves of ``held``, sorted, and how often each occurs; the list is emptied."""
    leaf = np.concatenate(held or [np.zeros(0, np.uint64)])
    held.clear()
    leaf.sort()
    first = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])[: len(leaf)])
    return leaf[first], np.diff(np.append(first, len(leaf)))


def _slice(unit: int, slices: int) -> int:
    """The slice of a unit: those of a task, and the first ones of all tasks, lie in all slices."""
    return ((unit >> 32) + (unit & 0xFFFFFFFF)) % slices


def _unit_rows(kind: int, slices: int, unit: int, rows: int, **columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows of `_UNIT`; those with a part lie in its slice, others in their unit's."""
    slice_ = columns["part"] % slices if "part" in columns else np.full(rows, _slice(unit, slices))
    columns |= {"kind": np.full(rows, kind), "slice": slice_, "unit": np.full(rows, unit)}
    made = [columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _UNIT]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, _UNIT, strict=True)], schema=_UNIT)


def _units(rows: DataFrame, parts: int) -> DataFrame:
    """`_UNIT` of the texts (doc_id, held_out, text)."""

    def summed(unit: int, held: tuple[list[np.ndarray], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """``held`` has the turned leaves of training texts, and of others."""
        own, n = _kinds(held[1])
        kinds = _distinct([own, _kinds(held[0])[0]])
        counts = np.zeros(len(kinds), np.uint32)
        counts[np.searchsorted(kinds, own)] = n
        ends = np.unique(_turned(own) & np.uint64((1 << 8 * (SHORT + 1)) - 1))
        order, bounds = _dealt(kinds, parts)
        kinds, counts = kinds[order], counts[order]
        own = np.flatnonzero(np.diff(bounds))
        pieces = [slice(bounds[p], bounds[p + 1]) for p in own]
        yield _unit_rows(1, SLICES, unit, len(own), part=own, size=np.diff(bounds)[own], leaf=[_packed(kinds[p]) for p in pieces], n=[_packed(counts[p]) for p in pieces])
        yield _unit_rows(2, SLICES, unit, 1, size=[len(ends)], leaf=[_packed(ends)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit, held, size = TaskContext.get().partitionId() << 32, ([], []), 0
        for batch in batches:
            doc, out = batch.column("doc_id"), batch.column("held_out")
            for first, end, data, bounds in slices(batch.column("text")):
                data = LOWER[data]
                leaf, sizes = running_leaves(data, bounds)
                trains = np.repeat(~np.array(out.slice(first, end - first).to_pylist(), bool), sizes)
                leaf = _turned(leaf)
                held[0].append(leaf[~trains])
                held[1].append(leaf[trains])
                size += len(leaf)
                text = byte_sums(data).of(bounds[:-1], bounds[1:]).view(np.int64)
                one = lambda x: [x.tolist() if isinstance(x, np.ndarray) else x.to_pylist()]
                yield _unit_rows(
                    0, SLICES, unit, 1, doc_id=one(doc.slice(first, end - first)), held_out=one(out.slice(first, end - first)), text=one(text), bounds=one(bounds),
                    body=[pa.Codec("zstd", compression_level=6).compress(data.tobytes(), asbytes=True)],
                )
                if size >= UNIT_BYTES:
                    yield from summed(unit, held)
                    unit, size = unit + 1, 0
        if size:
            yield from summed(unit, held)

    return rows.select("doc_id", "held_out", "text").mapInArrow(gather, _UNIT_SQL)


def _shorter(triple: np.ndarray, n: np.ndarray) -> tuple[_Counts, ...]:
    """Counts of the orders below `SHORT`, from the number of contexts of `SHORT` bytes for each context one shorter and next byte."""
    triple = triple.astype(np.uint64)
    counts = [_Counts(triple >> np.uint64(8), triple & np.uint64(255), n)]
    for order in range(SHORT - 2, -1, -1):
        counts.append(counts[-1].shorter(order))
    return tuple(counts)


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of the query that wrote them, not when the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def running_costs(rows: DataFrame) -> DataFrame:
    """doc_id, held_out, text, cost of each text (doc_id, held_out, text), whose bytes are predicted from the running text."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(1 + size // PART_BYTES)
    path = f"{shared_dir(spark)}/lumengraph/{uuid.uuid4().hex}"
    _units(rows, parts).write.partitionBy("kind", "slice").parquet(path)
    written = spark.read.schema(_UNIT_SQL).parquet(path)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, n in zip(*(batch.column(c).to_pylist() for c in ("leaf", "size")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(packed, n, np.uint64).view(np.int64))], ["end"])

    ends = written.where("kind = 2 AND size > 0").select("leaf", "size").mapInArrow(opened, "end long").distinct()
    # at most 2**24 rows, of which texts have some ten thousand
    short = ends.groupBy(F.col("end").bitwiseAND(F.lit((1 << 8 * SHORT) - 1)).alias("triple")).agg(F.count(F.lit(1)).alias("n"))
    with _tidied(spark):
        short = short.toPandas()
    shared = spark.sparkContext.broadcast(_shorter(short["triple"].to_numpy(), short["n"].to_numpy()))

    def cost(chunks: pa.Table) -> pa.Table:
        sizes = chunks.column("size").to_pylist()
        leaves, n = ([_unpacked(x, s, kind) for x, s in zip(chunks.column(c).to_pylist(), sizes, strict=True)] for c, kind in (("leaf", np.uint64), ("n", np.uint32)))
        kinds = _distinct(leaves)  # turned
        places = [np.searchsorted(kinds, x).astype(np.int32) for x in leaves]  # each sorted
        del leaves
        total = np.zeros(len(kinds), np.int64)
        for place, x in zip(places, n, strict=True):
            total[place] += x
        values, code = np.unique(code_lengths(_turned(kinds), total, shared.value).astype(np.float32), return_inverse=True)
        listed, values_, ranks = (list(x) for x in zip(*(_ranked(values, code[place]) for place in places), strict=True))
        units = chunks.column("unit")
        slice_ = pa.array([_slice(unit, SLICES) for unit in units.to_pylist()], pa.int32())
        columns = [slice_, units, *(chunks.column(c) for c in ("part", "size")), pa.array(listed, pa.int32()), pa.array(values_, pa.binary()), pa.array(ranks, pa.binary())]
        return pa.table(columns, ["slice", "unit", "part", "size", "listed", "values", "cost"])

    priced = f"{shared_dir(spark)}/lumengraph/{uuid.uuid4().hex}"
    for s in range(SLICES):  # of the parts
        leaves = written.where(f"kind = 1 AND slice = {s}").select("unit", "part", "size", "leaf", "n")
        with _tidied(spark):
            leaves.groupBy("part").applyInArrow(cost, _COSTS_SQL).write.mode("append").partitionBy("slice").parquet(priced)
        _delete(spark, f"{path}/kind=1/slice={s}")  # used up; its costs are written
    _delete(spark, f"{path}/kind=2")
    costs = spark.read.schema(_COSTS_SQL).parquet(priced)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for doc, held_out, text, bounds, body in zip(*(left.column(c).to_pylist() for c in ("doc_id", "held_out", "text", "bounds", "body")), strict=True):
            data = np.frombuffer(pa.decompress(body, bounds[-1], "zstd", asbytes=True), np.uint8)
            leaf, sizes = running_leaves(data, np.array(bounds))
            leaf = _turned(leaf)
            by = np.argsort(leaf)
            leaf = leaf[by]
            new = np.append(True, leaf[1:] != leaf[:-1])[: len(leaf)]
            place = np.empty(len(leaf), np.int32)  # of each byte's leaf among the slice's distinct ones
            place[by] = np.cumsum(new) - 1
            out.append((doc, held_out, text, leaf[new], place, sizes))
        kinds = _distinct([o[3] for o in out])
        order, edges = _dealt(kinds, parts)
        each = np.empty(len(kinds), np.float32)
        for p, n, listed, values, packed in zip(*(right.column(c).to_pylist() for c in ("part", "size", "listed", "values", "cost")), strict=True):
            each[order[edges[p] : edges[p + 1]]] = _unpacked(values, listed, np.float32)[_unpacked(packed, n, np.uint32)]
        sums = []
        for _, _, _, own, place, sizes in out:
            cost_ = each[np.searchsorted(kinds, own)].astype(np.float64)[place]
            sums.append(np.add.reduceat(cost_, np.cumsum(sizes) - sizes))
        flat = [[x for o in out for x in o[i]] for i in range(3)]
        kinds_ = [pa.int64(), pa.bool_(), pa.int64()]
        columns = [*(pa.array(c, k) for c, k in zip(flat, kinds_, strict=True)), pa.array(np.concatenate(sums or [np.zeros(0)]))]
        return pa.table(columns, ["doc_id", "held_out", "text", "cost"])

    bodies = spark.read.schema(_UNIT_SQL).parquet(path).where("kind = 0").select("slice", "unit", "doc_id", "held_out", "text", "bounds", "body")
    sums = []
    for s in range(SLICES):  # of the units
        left, right = (x.where(f"slice = {s}").drop("slice").groupBy("unit") for x in (bodies, costs))
        with _tidied(spark):
            sums.append(cut(left.cogroup(right).applyInArrow(add, "doc_id long, held_out boolean, text long, cost double")))
        _delete(spark, f"{path}/kind=0/slice={s}")
        _delete(spark, f"{priced}/slice={s}")
    return reduce(DataFrame.unionByName, sums)


def _frequent(words: DataFrame) -> int:
    """The least total count at which no more than `FREQUENT` words remain."""
    steps = words.groupBy("total").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("total").desc())
    room, least = FREQUENT, 1 << 62
    for row in steps.toLocalIterator():  # distinct counts, at most about sqrt(2 * tokens)
        room -= row["words"]
        if room < 0:
            break
        least = row["total"]
    return least


#: Columns of the parts of a text's base score: a row for each text with the sums over its frequent
#: words, and one for each distinct other word.
_PARTS = pa.schema(
    {
        "doc_id": pa.int64(), "held_out": pa.bool_(), "text": pa.int64(), "rows": pa.int64(), "n_tokens": pa.int64(), "known": pa.float64(), "base": pa.float64(),
        "hash": pa.int64(), "times": pa.int64(),
    }
)
_PARTS_SQL = "doc_id long, held_out boolean, text long, rows long, n_tokens long, known double, base double, hash long, times long"


def _part(batch: pa.RecordBatch, row: np.ndarray, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows of `_PARTS` for some rows of ``batch``; columns not given are null."""
    made = {"doc_id": batch.column("doc_id").take(pa.array(row)), "held_out": batch.column("held_out").take(pa.array(row)), **columns}
    return pa.RecordBatch.from_arrays([pa.array(made[f.name]) if isinstance(made.get(f.name), np.ndarray) else made.get(f.name, pa.nulls(len(row), f.type)) for f in _PARTS], schema=_PARTS)


def base_scores(rows: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, held_out, text, rows, n_tokens, known, base, cost (0) of the distinct texts (doc_id, held_out, text), and the tokens of the training texts."""
    found = word_counts(rows.select("text", (~F.col("held_out")).alias("training")))
    ends = rows.agg(F.count_if(~F.col("held_out")).alias("n"), F.count(F.lit(1)).alias("total")).where("total > 0")
    ends = ends.select(F.lit(end_hash()).alias("hash"), "n", "total")
    with _tidied(rows.sparkSession):
        words = cut(found.unionByName(ends))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    below = float(size["n"] + 0.5 * (size["v"] + 1))
    words = words.select("hash", "n", "total", F.log10((F.col("n") + 0.5) / F.lit(below)).alias("base"))
    least = _frequent(words)
    top = words.where(F.col("total") >= least).select("hash", (F.col("n") > 0).alias("known"), "base").toArrow()
    order = np.argsort(top.column("hash").to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("hash", "known", "base")))
    del top, order
    close = words.where(F.col("hash") == end_hash()).first()  # none without texts
    ending = [float(x) for x in (close["n"] > 0, close["base"])] if close else [0.0] * 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, base = shared.value
        for batch in batches:
            for first, last, data, bounds in slices(batch.column("text")):
                data = LOWER[data]
                words_ = Words(data, bounds)
                rows_, size_ = last - first, np.diff(words_.first)
                row = np.repeat(np.arange(rows_), size_)
                own = words_.hashes(data).view(np.int64)
                text = byte_sums(data).of(bounds[:-1], bounds[1:]).view(np.int64)
                at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
                hit = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
                each = [np.where(hit, x[at], 0.0) if len(hashes) else np.zeros(len(own)) for x in (known, base)]
                sums = [np.bincount(row, e, rows_) + x for e, x in zip(each, ending, strict=True)]
                yield _part(batch, np.arange(first, last), text=text, rows=np.ones(rows_, np.int64), n_tokens=size_ + 1, known=sums[0], base=sums[1])
                kinds, times = np.unique(np.stack([row[~hit], own[~hit]], axis=1), axis=0, return_counts=True)
                yield _part(batch, kinds[:, 0] + first, text=text[kinds[:, 0]], hash=kinds[:, 1].copy(), times=times)

    parts = cut(rows.mapInArrow(add, _PARTS_SQL))
    zero, nil = F.lit(0).cast("long"), F.lit(0.0)
    id_ = ["doc_id", "held_out", "text"]
    whole = parts.where("rows = 1").select(*id_, "rows", "n_tokens", "known", "base", nil.alias("cost"))
    rare = parts.where("hash IS NOT NULL").select(*id_, "hash", "times").join(words.where(F.col("total") < least).select("hash", "n", "base"), "hash")
    known = F.when(F.col("n") > 0, F.col("times")).otherwise(0).cast("double")
    rare = rare.select(*id_, zero.alias("rows"), zero.alias("n_tokens"), known.alias("known"), (F.col("base") * F.col("times")).alias("base"), nil.alias("cost"))
    whole = whole.unionByName(rare).groupBy(*id_).agg(*(F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "base", "cost")))
    return whole, size["n"]


def score_documents(docs: DataFrame, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; fold ``held`` is held out."""
    rows = texts(docs).withColumn("held_out", fold() == held)
    spark, id_ = docs.sparkSession, ["doc_id", "held_out", "text"]
    spelt = running_costs(rows)
    path = f"{shared_dir(spark)}/lumengraph/{uuid.uuid4().hex}"
    with scratch(spark):  # words and parts go when the base scores are written
        found, train_tokens = base_scores(rows)
        with _tidied(spark):
            found.write.parquet(path)
    zero, nil = F.lit(0).cast("long"), F.lit(0.0)
    read = spark.read.schema(found.schema).parquet(path)
    spelt = spelt.select(*id_, zero.alias("rows"), zero.alias("n_tokens"), nil.alias("known"), nil.alias("base"), "cost")
    sums = read.unionByName(spelt).groupBy(*id_).agg(*(F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "base", "cost")))
    each = lambda c: F.col(c) / F.col("rows")  # noqa: E731  rows that repeat id and text were added up
    return sums.select(
        "doc_id", "held_out", each("n_tokens").cast("long").alias("n_tokens"), F.round(each("known")).cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        each("base").alias("base_score"), each("cost").alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")
