"""Spelling variants: words one edit apart, found by search schemes over bidirectional FM-indexes.

Words are counted over all texts (summed in each task, then by word). A word is cut into a
left and a right half. Of two words one edit apart, one half of the first stands unchanged at
the same end of the second; so a word is filed under its beginnings and endings of the
lengths such a half may have, and a shard of the vocabulary holds all words filed under the
same ones. A beginning or ending with more words than a shard takes has several shards, and
asking words go to each of them.

A shard's words stand in one text, each between delimiters. Its FM-index is bidirectional: a
match is an interval of suffix ranks in the text and one in the reversed text, and grows to
either side. The scheme for the left half matches it from the middle to its delimiter and
then grows over the right half with one error; the scheme for the right half is the same
thing mirrored. All asking words of a shard advance together.

A word's form is its most frequent near word if that is at least twice as frequent; forms
at least double the count, so chains end, and roots are found by pointer jumping.

Null and empty texts have no words; a row without an id is counted with the empty id.
Repeated rows count as often as they occur. An empty table gives no words. Other columns are
not read. No word, however long or frequent, is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import texts
from lumengraph.llm.kernel import slices
from lumengraph.session import cut

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One word in so many (by hash) loses a letter, as the task asks.
DAMAGE = 97
#: Letters of a shard's words; its index takes some 600 bytes for each.
SHARD = 1 << 16
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18
_RUN = re.compile(r"[a-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# --- words ------------------------------------------------------------------------------------


def damaged(doc_id: int | None, run: str) -> str:
    """The run without one of its letters, if the hash of id and run asks for it."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1 :]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all words of that length and frequency, over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
            for first, end, data, bounds in slices(text):
                for i in range(first, end):
                    a, b = bounds[i - first], bounds[i - first + 1]
                    found = Counter(_RUN.findall(data[a:b].tobytes().translate(_LOWER).decode("utf-8", "replace")))
                    for run, n in found.items():
                        if len(run) >= least_length:
                            word = damaged(ids[i], run)
                            if len(word) >= least_length:
                                total[word] += n
                    if len(total) > HELD:
                        yield rows()
                        total = Counter()
        yield rows()

    counted = texts(docs).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- the index --------------------------------------------------------------------------------


class _Side:
    """Suffix ranks of a cyclic text: its rotations in order, and counts of the symbols before them."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            pair = rank * (n + symbols) + np.roll(rank, -step)
            self.suffix = np.argsort(pair, kind="stable")
            ordered = pair[self.suffix]
            rank = np.empty(n, np.int64)
            rank[self.suffix] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank[self.suffix[-1]] == n - 1 or step >= n:
                break
            step *= 2
        before = text[self.suffix - 1]
        #: less[i, c]: of the first i rotations, how many are preceded by a symbol below c
        self.less = np.zeros((n + 1, symbols + 1), np.int32)
        self.less[np.arange(1, n + 1), before + 1] = 1
        np.cumsum(self.less, axis=0, out=self.less)
        np.cumsum(self.less, axis=1, out=self.less)
        self.first = self.less[n].astype(np.int64)


class BidirectionalIndex:
    """An FM-index of words between delimiters (symbol 0) that grows matches to both sides.

    A match is (rank in one side, rank in the other side, size). Side 0 is the text, side 1
    the text reversed; growing to the left ranks in side 0, to the right in side 1.
    """

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.sizes = np.array([len(p) for p in points])
        self.letters, codes = np.unique(np.concatenate(points), return_inverse=True)
        self.codes = codes + 1
        self.begin = np.cumsum(self.sizes) - self.sizes
        text = np.zeros(len(codes) + len(words), np.int64)
        delimiter = self.begin + np.arange(len(words))
        is_letter = np.ones(len(text), bool)
        is_letter[delimiter] = False
        text[is_letter] = self.codes
        symbols = len(self.letters) + 1
        self.sides = (_Side(text, symbols), _Side(text[::-1].copy(), symbols))
        # The word after a delimiter of the text; in the reversed text, the word that ends before it.
        n = len(text)
        self.owner = (np.full(n, -1), np.full(n, -1))
        self.owner[0][delimiter] = np.arange(len(words))
        self.owner[1][n - 1 - delimiter] = np.arange(len(words)) - 1
        self.owner[1][n - 1 - delimiter[0]] = len(words) - 1

    def _grow(self, side: int, symbol: np.ndarray, match: np.ndarray) -> np.ndarray:
        """Matches (rows: rank here, rank in the other side, size) with one more symbol on this side."""
        here, there, size = match
        less, first = self.sides[side].less, self.sides[side].first
        below, upto = less[here, symbol], less[here, symbol + 1]
        below_end, upto_end = less[here + size, symbol], less[here + size, symbol + 1]
        inside = upto.astype(np.int64) - below
        return np.stack([first[symbol] + inside, there + below_end - below, (upto_end.astype(np.int64) - below_end) - inside])

    def near(self, asking: np.ndarray, half: np.ndarray, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asking word, word one edit away) whose first ``half`` symbols are equal.

        Mirrored, words are read from their ends, so that half is the right one.
        """
        length, begin = self.sizes[asking], self.begin[asking]
        out, back = (0, 1) if mirrored else (1, 0)  # the side that the open half grows to, and the other one
        start = np.zeros((3, len(asking)), np.int64)
        start[2] = len(self.sides[0].suffix)

        def symbol(which: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The symbol at a place of a word, the delimiter behind its last."""
            inside = np.clip(at, 0, length[which] - 1)
            place = begin[which] + (length[which] - 1 - inside if mirrored else inside)
            return np.where(at < length[which], self.codes[place], 0)

        # The half itself, from the middle to its delimiter.
        match = start
        for step in range(int(half.max(initial=-1)) + 1):
            going = np.flatnonzero(half >= step)
            read = np.where(half[going] > step, symbol(going, half[going] - 1 - step), 0)
            match[:, going] = self._grow(back, read, match[:, going])
        match = match[[1, 0, 2]]  # from now on growing to the other side
        # ``exact`` have met no error, ``bent`` one.
        exact, at = np.arange(len(asking)), half.copy()
        bent, bent_at, bent_match = exact[:0], at[:0], match[:, :0]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        less, first = self.sides[out].less, self.sides[out].first
        while len(exact) or len(bent):
            if len(bent):
                read = symbol(bent, bent_at)
                bent_match = self._grow(out, read, bent_match)
                alive = bent_match[2] > 0
                over = alive & (read == 0)
                if over.any():
                    # all between two delimiters: the rank in the other side begins with the first symbol read
                    place = self.sides[back].suffix[bent_match[1, over]]
                    pairs.append((bent[over], self.owner[back][place]))
                alive &= read != 0
                bent, bent_at, bent_match = bent[alive], bent_at[alive] + 1, bent_match[:, alive]
            if len(exact):
                here, there, size = match
                low = less[here]
                count = np.diff(less[here + size] - low, axis=1)
                wanted = symbol(exact, at)
                # a word behind this one in any other way than by its next symbol: in place of it, or before it
                other = count > 0
                other[:, 0] = False
                other[np.arange(len(exact)), wanted] = False
                row, with_ = np.nonzero(other)
                grown = self._grow(out, with_, match[:, row])
                replaced = wanted[row] > 0
                # one symbol fewer: of equal neighbours the last is left out
                fewer = np.flatnonzero((wanted > 0) & (symbol(exact, at + 1) != wanted))
                bent = np.concatenate([bent, exact[row], exact[row][replaced], exact[fewer]])
                bent_at = np.concatenate([bent_at, at[row], at[row][replaced] + 1, at[fewer] + 1])
                bent_match = np.concatenate([bent_match, grown, grown[:, replaced], match[:, fewer]], axis=1)
                match = self._grow(out, wanted, match)
                on = (wanted > 0) & (match[2] > 0)
                exact, at, match = exact[on], at[on] + 1, match[:, on]
        if not pairs:
            return exact[:0], exact[:0]
        which, word = (np.concatenate(x) for x in zip(*pairs, strict=True))
        both = np.unique(which * len(self.sizes) + word)
        return asking[both // len(self.sizes)], both % len(self.sizes)


def near_words(words: list[str], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers of ``words`` (distinct, in order) one edit apart, for words that ask by a half of theirs.

    ``left`` and ``right`` are the words that ask by their left or right half. A pair found by
    its right half is left out where the left halves are equal too, as that scheme finds it.
    """
    index = BidirectionalIndex(words)
    a, b = index.near(left, index.sizes[left] // 2, mirrored=False)
    c, d = index.near(right, index.sizes[right] - index.sizes[right] // 2, mirrored=True)
    new = [not words[y].startswith(words[x][: len(words[x]) // 2]) for x, y in zip(c.tolist(), d.tolist(), strict=True)]
    new = np.array(new, bool)
    return np.concatenate([a, c[new]]), np.concatenate([b, d[new]])


# --- shards -----------------------------------------------------------------------------------


def _filed(vocabulary: DataFrame, least_length: int) -> DataFrame:
    """``key, word, n, side, asks``: each word under the beginnings and endings it may be met by."""

    def filings(side: str) -> Column:
        size = F.length("word")
        half = (lambda x: F.floor(x / 2)) if side == "L" else (lambda x: x - F.floor(x / 2))
        lengths = F.array_distinct(F.transform(F.sequence(F.greatest(size - 1, F.lit(least_length)), size + 1), half))
        return F.transform(lengths, lambda h: F.struct(F.lit(side).alias("side"), h.cast("int").alias("half"), (h == half(size)).alias("asks")))

    rows = vocabulary.select("word", "n", F.explode(F.concat(filings("L"), filings("R"))).alias("f"))
    part = F.when(F.col("f.side") == "L", F.expr("substring(word, 1, f.half)")).otherwise(F.expr("right(word, f.half)"))
    return rows.select(F.concat("f.side", part).alias("key"), "word", "n", "f.side", "f.asks")


def _sharded(filed: DataFrame, shard: int) -> DataFrame:
    """``shard, word, n, side, asks, holds``: a key with more letters than a shard has shards of its own."""
    sizes = filed.groupBy("key").agg(F.sum(F.length("word") + 1).alias("letters"))
    total = sizes.agg(F.sum("letters")).first()[0] or 0
    parts = max(1, -(-total // shard))
    large = sizes.where(F.col("letters") > shard).select("key", F.ceil(F.col("letters") / shard).cast("int").alias("of"))
    rows = filed.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("of", F.lit(1))).cast("int"))
    visits = F.when(F.col("of").isNull() | ~F.col("asks"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("of") - 1))
    rows = rows.withColumn("nth", F.explode(visits))
    name = F.when(F.col("of").isNull(), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("string")).otherwise(F.concat_ws(" ", "key", F.col("nth").cast("string")))
    return rows.select(name.alias("shard"), "word", "n", "side", "asks", (F.col("nth") == F.col("own")).alias("holds"))


def _search(table: pa.Table) -> pa.Table:
    """For each asking word of a shard: its near words there, their number, and the most frequent."""
    table = table.combine_chunks()
    word = table.column("word").to_numpy()
    words, first, number = np.unique(word.astype(object), return_index=True, return_inverse=True)
    n = table.column("n").to_numpy()[first]
    side, asks = table.column("side").to_numpy() == "L", table.column("asks").to_numpy(zero_copy_only=False)
    holds = np.zeros(len(words), bool)
    holds[number[table.column("holds").to_numpy(zero_copy_only=False)]] = True
    left, right = np.unique(number[asks & side]), np.unique(number[asks & ~side])
    one, other = near_words(words.tolist(), left, right)
    held = holds[other]  # a word that only asks here is held by another shard of its key
    one, other = one[held], other[held]
    order = np.lexsort((other, -n[other], one))
    one, other = one[order], other[order]
    mine, at, many = np.unique(one, return_index=True, return_counts=True)
    n_near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    n_near[mine], best[mine] = many, other[at]
    own = np.union1d(left, right)
    none = best[own] < 0
    form = np.where(none, None, words[best[own]])
    form_n = pa.array(n[best[own]], pa.int64(), mask=none)
    return pa.table([pa.array(words[own], pa.string()), pa.array(n[own]), pa.array(n_near[own]), pa.array(form, pa.string()), form_n], ["word", "n", "n_near", "form", "form_n"])


def nearest_forms(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, shard: int = SHARD, factor: int = FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word of ``vocabulary`` (word, n; written or cheap to read twice)."""
    rows = _sharded(cut(_filed(vocabulary, least_length)), shard)
    part = rows.groupBy("shard").applyInArrow(_search, "word string, n long, n_near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))).alias("best")
    met = part.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    form_n = -F.col("best.less")
    chosen = form_n >= factor * F.col("n")
    return met.select("word", "n", "n_near", F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, form_n).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (word, form): each round follows twice as many forms."""
    reached = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not reached.where("moved").isEmpty():
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = F.col("next").isNotNull()
        reached = cut(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), moved.alias("moved")))
    return reached.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, shard: int = SHARD, factor: int = FACTOR) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of all texts."""
    forms = cut(nearest_forms(cut(count_words(docs, least_length, least_count)), least_length, shard, factor))
    found = forms.join(roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
