"""Packing of token pieces into sequences: dominance reduction, then best fit.

The instance is the histogram of piece lengths, which has at most ``capacity`` entries
however many documents there are. Bins that provably belong to some best packing (a full
piece, a pair that fills a bin, a pair to which no other choice is superior) are fixed for
whole counts at once, the instance shrinks, and the rest goes by best fit in falling order,
again a whole count at a time. The plan says which ranks of a length go to which
sequences; pieces get their rank inside their length in Spark and look their place up.

Null or empty text is the closing id alone, a piece of length 1. A text longer than the
capacity is cut into full pieces and a rest. Repeated rows are packed as often as they
occur. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.llm.common import texts
from lumengraph.session import cut

CAPACITY = 2048
#: Rows of one length that share a rank bucket, on average.
BUCKET_ROWS = 20_000

#: A word of Latin letters that a gap or one of six marks follows, such marks before a gap, or all up to the
#: next gap. The tokenizer parts letters from marks, and none of those marks is in a special token.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x20\x09-\x0D.,;:!?]|\Z)|[.,;:!?]+(?=[\x20\x09-\x0D]|\Z)|[^\x20\x09-\x0D]+")
#: What the tokenizer never joins in lower-case ASCII text without apostrophes and special tokens.
_ASCII_PART = re.compile(r"[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")
#: Distinct parts whose ids a Python worker remembers; about 100 MB.
_REMEMBERED = 500_000


class _Ids(dict):
    """The ids of a part of a text, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():  # one word, and its bytes are its letters
            numbers = [token.id for token in self.model.tokenize(part.lower())]
        elif _WORD.fullmatch(part):  # one word, already composed
            numbers = [token.id for token in self.model.tokenize(self.bytes.pre_tokenize_str(part.lower())[0][0])]
        else:
            numbers = self.tokenizer.encode(part, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(numbers)}I", *numbers)
        if len(self) >= _REMEMBERED:
            self.clear()
        self[part] = ids
        return ids

    def of(self, text: str) -> bytes:
        plain = text.isascii() and "'" not in text and "<|" not in text
        return b"".join(map(self.__getitem__, _ASCII_PART.findall(text.lower()) if plain else _PART.findall(text)))


_known: dict[str, _Ids] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text.

    The tokenizer must lower case, drop white space, never join what white space parts, nor
    letters with marks, and take the bytes of a word of Latin letters to its model, so a
    text's ids are those of its parts one after the other.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _known:
            _known[tokenizer] = _Ids(tokenizer)
        ids = _known[tokenizer]
        end = np.array([closing], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = ids.of(text.as_py()) + end
                for number, at in enumerate(range(0, len(raw), step)):
                    piece = raw[at : at + step]
                    rows.append((doc, number, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if rows
                else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts(docs).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs of ranks: those of ``length`` from ``rank`` on go ``each`` to a sequence, from ``sequence`` and ``offset`` on."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left = {length: n for length, n in counts.items() if n}
        self.used = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], sequence, each, offset))
        self.used[length] += bins * each
        self.left[length] -= bins * each
        if not self.left[length]:
            del self.left[length]

    def open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins


def _best_pair(lengths: list[int], left: dict[int, int], most: int) -> int:
    """The largest sum up to ``most`` of two remaining pieces; 0 if none."""
    best, high = 0, len(lengths) - 1
    for low, a in enumerate(lengths):
        while high >= low and a + lengths[high] > most:
            high -= 1
        if high < low:
            break
        b = high if high > low or left[a] > 1 else -1
        if b >= low:
            best = max(best, a + lengths[b])
    return best


def reduce_by_dominance(plan: Plan) -> int:
    """Fix the bins of a largest piece that dominate all its other bins; the number of bins fixed.

    For a piece with free room r in its bin, and k the largest other piece that fits:
    nothing fits, then it stands alone; k fills r, then the pair is best, as whatever else
    could stand there can trade places with k; no two others fit together, then k is the
    best partner by the same trade; no three fit and no two exceed k, likewise.
    """
    fixed = 0
    for length in sorted(plan.left, reverse=True):
        while length in plan.left:
            room = plan.capacity - length
            others = sorted(k for k, n in plan.left.items() if k <= room and (k != length or n > 1))
            if not others:
                bins = plan.left[length]
                plan.put(length, bins, 1, plan.open(bins), 0)
                fixed += bins
                continue
            k = others[-1]
            small = [x for x in others[:3] for _ in range(min(3, plan.left[x] - (x == length)))][:3]
            alone = k == room or len(small) < 2 or small[0] + small[1] > room
            if not alone and (len(small) < 3 or sum(small) > room):
                alone = _best_pair(others, plan.left, room) <= k
            if not alone:
                break
            bins = plan.left[length] // 2 if k == length else min(plan.left[length], plan.left[k])
            if k != room and k != length:
                bins = 1  # what fits best may change with each bin
            start = plan.open(bins)
            plan.put(length, bins, 1, start, 0)
            plan.put(k, bins, 1, start, length)
            fixed += bins
    return fixed


def best_fit(plan: Plan) -> None:
    """Place what is left in falling order, each piece where the least room stays."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def give(room: int, start: int, bins: int) -> None:
        if bins and room:
            if room not in rooms:
                bisect.insort(order, room)
                rooms[room] = []
            rooms[room].append((start, bins))

    for length in sorted(plan.left, reverse=True):
        while length in plan.left:
            place = bisect.bisect_left(order, length)
            if place < len(order):
                room = order[place]
                start, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(place)
            else:
                room = plan.capacity
                bins = -(-plan.left[length] // (room // length))
                start = plan.open(bins)
            each, count = room // length, plan.left[length]
            full = min(bins, count // each)
            if full:
                plan.put(length, full, each, start, plan.capacity - room)
                give(room - each * length, start, full)
            if full < bins and count - full * each:
                rest = count - full * each
                plan.put(length, 1, rest, start + full, plan.capacity - room)
                give(room - rest * length, start + full, 1)
                full += 1
            give(room, start + full, bins - full)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(counts, capacity)
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (read twice; a written table) with sequence_id and offset of each."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))

    buckets = 1 + max(counts.values(), default=0) // BUCKET_ROWS
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    turn = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = keyed.withColumn("turn", turn).join(bases, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("turn") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            spots = [pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *spots], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(cut(token_pieces(docs, tokenizer, capacity)), capacity)
