"""Periodic runs of words, found in a grammar of the texts.

Re-Pair replaces pairs of neighbouring symbols that occur twice or more in a text by new
symbols, the most frequent first. All texts of a slice are compressed side by side, each
with symbols of its own: a round counts the pairs of all, and replaces every pair that is
more frequent than the two pairs it overlaps. What a symbol stands for is the same
wherever it was put, so the runs across its border are looked for in one place and
translated to all others; what is left of a text in the end has borders of its own. A run
lies across the border of the smallest symbol that holds it, or across a border of what is
left, so none is missed; parts of it found inside smaller symbols are merged into it.

Across a border, half of a run lies on one side, at least 1.5 periods and 12 words. So a
stretch of max(4, half the period) words beside the border occurs again one period away:
candidates are the occurrences of that stretch at that distance, by doubling lengths of
the stretch. Each is extended word by word (by hashes), and its words are compared at last.

Empty and null texts have no words and no run. Rows are independent: repeated rows give a
row each, a row without an id is not rewritten, an empty table gives an empty result,
other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumengraph.llm.common import texts
from lumengraph.llm.kernel import Sums, Words, mix, slices
from lumengraph.llm.substring_dedup import kept_words

LEAST_WORDS, LEAST_PERIODS = 24, 3
SLICE = 1 << 20
#: Candidates extended at once.
AT_ONCE = 1 << 18
_GRAM = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def rewritten(doc_id: int | None, text: bytes) -> bytes | None:
    """The text whose words repeat from some place on, if the hash of its id asks for it."""
    if doc_id is None:
        return None
    chosen, g = zlib.crc32(str(doc_id).encode()) % 10, zlib.crc32(str(doc_id).encode()) // 10
    words = _WORD.findall(text) if chosen == 0 else []
    if not words:
        return None
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


def _as_read(doc_id: pa.Array, text: pa.Array) -> pa.Array:
    """The texts in which runs are looked for."""
    plain = pc.fill_null(text.cast(pa.large_binary()), b"")
    new = [rewritten(i.as_py(), t.as_py()) if i.is_valid and zlib.crc32(str(i).encode()) % 10 == 0 else None for i, t in zip(doc_id, plain, strict=True)]
    return pc.coalesce(pa.array(new, pa.large_binary()), plain)


class Grammar:
    """Re-Pair over symbols whose texts have no symbol in common.

    ``left`` are the symbols that remain, ``at`` the words where they begin. For each round,
    ``rounds`` has the symbols made in it, where the first word of each occurrence is, and for
    each symbol its first occurrence's begin, border and end.
    """

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        n = len(ids)
        self.words = int(ids.max()) + 1 if n else 0
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        symbol, at, size = ids.astype(np.int64), np.arange(n), np.ones(n, np.int64)
        made = self.words
        open_ = np.flatnonzero(text[1:] == text[:-1])  # pairs (i, i + 1) that may occur twice
        while len(open_):
            pair = symbol[open_] << 32 | symbol[open_ + 1]
            kinds, kind, count = np.unique(pair, return_inverse=True, return_counts=True)
            twice = count > 1
            # Ranks instead of counts: kinds of one frequency are told apart by a hash.
            rank = np.empty(len(kinds), np.int64)
            rank[np.lexsort((mix(kinds.astype(np.uint64)), count))] = np.arange(1, len(kinds) + 1)
            often = twice[kind]
            open_, kind = open_[often], kind[often]
            if not len(open_):
                break
            strength = np.zeros(len(symbol) + 1, np.int64)
            strength[open_] = rank[kind]
            own = strength[open_]
            before = np.where(open_ > 0, strength[open_ - 1], 0)
            # A symbol repeated on end gives equal pairs that overlap: of such a row, every other one.
            head = np.flatnonzero(before != own)
            row = np.cumsum(before != own) - 1
            tail = np.append(head[1:], len(open_)) - 1
            strongest = (before[head] < own[head]) & (strength[open_[tail] + 1] < own[head])
            chosen = strongest[row] & ((open_ - open_[head][row]) % 2 == 0)
            place, kind = open_[chosen], kind[chosen]
            _, first, new = np.unique(kind, return_index=True, return_inverse=True)
            border, end = at[place + 1], at[place + 1] + size[place + 1]
            self.rounds.append((new, at[place], np.stack([at[place], border, end])[:, first]))
            symbol[place] = made + new
            size[place] += size[place + 1]
            made += len(first)
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            touched = np.zeros(len(symbol) + 1, bool)
            touched[open_] = True
            touched[place], touched[place - 1] = True, True
            touched[place + 1] = False
            # the pair before a replaced one begins at the symbol left of it, which may itself have been cut
            previous = place - 1
            gone = (previous >= 0) & ~keep[np.maximum(previous, 0)]
            touched[np.maximum(previous[gone] - 1, 0)] = True
            symbol, at, size = symbol[keep], at[keep], size[keep]
            open_ = np.flatnonzero(touched[:-1][keep])
            open_ = open_[open_ < len(symbol) - 1]
            open_ = open_[text[at[open_]] == text[at[open_ + 1]]]
        self.left, self.at = symbol, at


class Finder:
    """Runs across borders in a sequence of word ids."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.n = len(ids)
        self._sums = Sums(mix(ids.astype(np.uint64) + np.uint64(1)))
        grams = self._sums.every(_GRAM)
        self._filed = {_GRAM: self._index(grams, np.arange(len(grams)))}

    def _index(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places whose hash another place has: themselves and a sort key, by hash and place, and the hash's number at each word."""
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        twice = ~new
        twice[:-1] |= ~new[1:]
        places, kind = places[order[twice]], (np.cumsum(new) - 1)[twice]
        number = np.full(self.n + 1, -1, np.int64)
        number[places] = kind
        return places, kind << 32 | places, number

    def _stretches(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of the repeated stretches of ``gram`` words, which is a power of two from ``_GRAM`` on."""
        if gram not in self._filed:
            shorter = self._stretches(gram // 2)[0]
            places = np.sort(shorter[shorter + gram <= self.n])
            self._filed[gram] = self._index(self._sums.of(places, places + gram), places)
        return self._filed[gram]

    def _same_ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, up to ``most``."""
        return self._same(a, b, most, 1)

    def _same_behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words up to ``a`` and ``b`` (both left out) are equal, up to ``most``."""
        return self._same(a, b, most, -1)

    def _same(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        have = np.zeros(len(a), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            try_ = np.flatnonzero(have + step <= most)
            if len(try_):
                x, y = a[try_] + way * have[try_], b[try_] + way * have[try_]
                low, high = (0, step) if way > 0 else (-step, 0)
                same = self._sums.raw(x + low, x + high) == self._sums.raw(y + low, y + high)
                have[try_[same]] += step
            step >>= 1
        return have

    def _extended(self, left: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> Runs:
        """(start, end, period) of the stretch around ``left`` in [low, high) whose words equal those ``q`` later."""
        ahead = self._same_ahead(left, left + q, high - left - q)
        behind = self._same_behind(left, left + q, left - low)
        return left - behind, left + q + ahead, q

    def across(self, low: np.ndarray, border: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, Runs]:
        """(number of the border, runs) across each border, inside [low, high)."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        width = 1
        while (fits := high - low >= max(LEAST_WORDS, LEAST_PERIODS * width)).any():
            gram = max(_GRAM, width // 2)
            places, keys, number = self._stretches(gram)
            if not len(places):
                break
            for back in (0, gram):  # the stretch behind the border, and the one before it
                at = border - back
                mine = np.flatnonzero(fits & (at >= low) & (at + gram <= high))
                mine = mine[number[at[mine]] >= 0]
                name, own = number[at[mine]] << 32, at[mine]
                if back:
                    lowest = np.maximum(own - 2 * width + 1, low[mine])
                    first, last = np.searchsorted(keys, name | lowest), np.searchsorted(keys, name | np.maximum(own - width, -1) + 1)
                    last = np.where(own - width < lowest, first, last)
                else:
                    highest = np.minimum(own + 2 * width, high[mine] - gram + 1)
                    first, last = np.searchsorted(keys, name | (own + width)), np.searchsorted(keys, name | np.maximum(highest, 0))
                many = np.maximum(last - first, 0)
                some = np.flatnonzero(many)
                cuts = np.searchsorted(np.cumsum(many[some]), np.arange(0, int(many.sum()) + AT_ONCE, AT_ONCE))
                for a, b in zip(cuts[:-1], np.maximum(cuts[1:], cuts[:-1]), strict=True):
                    part = some[a:b] if b < len(some) else some[a:]
                    if not len(part):
                        continue
                    which = np.repeat(part, many[part])
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                    other = places[first[which] + nth]
                    one, who = own[which], mine[which]
                    start, end, q = self._extended(np.minimum(one, other), np.abs(one - other), low[who], high[who])
                    good = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
                    found.append((who[good], start[good], end[good], q[good]))
            width *= 2
        if not found:
            none = np.zeros(0, np.int64)
            return none, (none, none, none)
        who, start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((q, end, start, who))  # the smallest period of each stretch
        who, start, end, q = who[order], start[order], end[order], q[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return who[new], (start[new], end[new], q[new])

    def same_words(self, runs: Runs) -> None:
        """Compare the words of the runs themselves; hashes that lied are an error."""
        for start, end, q in zip(*(x.tolist() for x in runs), strict=True):
            if not np.array_equal(self.ids[start : end - q], self.ids[start + q : end]):
                raise ArithmeticError("two stretches of words share a hash")


def merged(runs: Runs) -> Runs:
    """Maximal intervals: of one period, what overlaps in a period or more is one run."""
    start, end, q = runs
    if not len(start):
        return runs
    order = np.lexsort((end, start, q))
    start, end, q = start[order], end[order], q[order]
    far = int(end.max()) + 1
    _, kind = np.unique(q, return_inverse=True)
    reach = np.maximum.accumulate(end + kind * far)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + kind[1:] * far > reach[:-1] - q[1:]
    head = np.flatnonzero(new)
    start, q, end = start[head], q[head], np.maximum.reduceat(end, head)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    single = np.ones(len(start), bool)
    single[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[single], end[single], q[single]


def find_runs(ids: np.ndarray, text: np.ndarray, first: np.ndarray) -> Runs:
    """(start, end, period) of all runs of texts side by side, by start and period.

    ``ids`` are word ids that no two texts share, ``text`` the text of each word, and text i has
    the words ``first[i]`` to ``first[i + 1]``.
    """
    if not len(ids):
        return ids, ids, ids
    grammar = Grammar(ids, text)
    finder = Finder(ids)
    found: list[Runs] = []
    for symbol, at, (low, border, high) in grammar.rounds:
        long = np.flatnonzero(high - low >= LEAST_WORDS)
        who, (start, end, q) = finder.across(low[long], border[long], high[long])
        if not len(who):
            continue
        # from the first occurrence of a symbol to all of them
        who = long[who]
        start, end = start - low[who], end - low[who]
        order = np.argsort(symbol, kind="stable")
        many = np.bincount(symbol, minlength=len(low))
        opening = np.cumsum(many) - many
        run = np.repeat(np.arange(len(who)), many[who])
        nth = np.arange(len(run)) - np.repeat(np.cumsum(many[who]) - many[who], many[who])
        there = at[order[opening[who[run]] + nth]]
        found.append((there + start[run], there + end[run], q[run]))
    # Two plain words that stay neighbours occur as a pair only once: such a border is in no run by itself.
    plain = grammar.left < grammar.words
    border = grammar.at[1:]
    own = np.flatnonzero((text[border] == text[border - 1]) & ~(plain[1:] & plain[:-1])) if len(border) else border
    row = text[border[own]]
    found.append(finder.across(first[row], border[own], first[row + 1])[1])
    runs = merged(tuple(np.concatenate(x) for x in zip(*found, strict=True)))
    finder.same_words(runs)
    order = np.lexsort((runs[2], runs[0]))
    return tuple(x[order] for x in runs)


def _described(runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli and runs_sha256 of one text's runs, by start and period."""
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best: tuple[int, int, int] | None = None
    for run in runs:  # the first of equal exponents stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest()


def describe_slice(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
    """The columns of each text of a slice, without its id."""
    words = Words(data, bounds)
    n = len(words.start)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(words.first))
    _, ids = np.unique(mix(words.hashes(data) ^ mix(text.astype(np.uint64) + np.uint64(1))), return_inverse=True)
    start, end, q = find_runs(ids.astype(np.int64), text, words.first)
    dropped = np.zeros(n + 1, np.int64)
    np.add.at(dropped, start + q, 1)
    np.add.at(dropped, end, -1)
    kept = kept_words(data, bounds, np.cumsum(dropped[:-1]) > 0, words.first, words)
    edges = np.searchsorted(start, words.first)
    for i, (_, _, collapsed) in enumerate(kept):
        a, b, zero = int(edges[i]), int(edges[i + 1]), int(words.first[i])
        own = [(s - zero, e - s, p) for s, e, p in zip(start[a:b].tolist(), end[a:b].tolist(), q[a:b].tolist(), strict=True)]
        yield *_described(own), collapsed


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The digest of the runs of every row: their number, the one of greatest exponent, and hashes.

    ``start``, ``length`` and ``period`` count words; a text without a run has nulls there.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, end, data, bounds in slices(_as_read(ids, batch.column("text")), SLICE):
                columns = list(zip(*describe_slice(data, bounds), strict=True))
                kinds = [*[pa.int64()] * 5, *[pa.string()] * 2]
                own = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), *own], [c.split()[0] for c in SCHEMA.split(", ")])

    return texts(docs).mapInArrow(describe, SCHEMA)
