"""Token counts of whole texts by transducers compiled from a byte-level BPE file.

Two deterministic transducers do the work.

The *splitter* reads the class of each code point and marks where a piece begins. It is
small, so a chunk of a text is a map from each state it may be entered in to the state it
leaves; the maps of all chunks are composed by a parallel prefix scan, which gives every
chunk its own entry state, and a second reading writes the marks.

The *counter* reads the bytes of a piece. Each of its transitions carries the number of
tokens by which the encoding of the prefix grows (negative where a byte joins earlier
tokens into one), so the sum along a piece is its number of tokens. A state holds, for each
place from which a token may still run on, the token that ends there, the node of the
vocabulary trie reached since, and how many tokens fewer that place has. Two tokens may
follow each other if no merge across their border comes before the merges beside it.
States and transitions are compiled when first met and kept by the worker; a full table is
dropped and grows anew, so memory stays bounded and results are the same.

Nulls count as empty; an empty text has no tokens. Rows are independent: repeated rows and
null ids give a row each, an empty table an empty result, other columns are not read.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumengraph.llm.common import texts
from lumengraph.llm.kernel import slices

LIMIT = 1024
SLICE = 1 << 20
#: States of the counter before it starts anew; about 300 bytes each.
MOST_STATES = 1 << 18
#: Code points of a chunk; a multiple of the symbols read at once.
CHUNK, AT_ONCE = 60, 3

# --- the splitter -----------------------------------------------------------------------------

# The classes the pattern tells apart, and the states between two code points.
PAD, CLOSE, LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, SHORT, R, V, L, E = range(13)
CLASSES = 13
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
STATES = 12
_LETTERS = (LETTER, SHORT, R, V, L, E)
#: Marks: a piece begins at this code point, or at the one before.
HERE, BEFORE = 1, 2
#: ``'s 't 'm 'd`` are pieces of their own, as are ``'re 've 'll``.
_SHORT = "stmd"


def _opened(kind: int) -> int:
    """The state after a piece began with a code point of this class."""
    if kind in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: AFTER_QUOTE, BLANK: ONE_BLANK, SPACE: ONE_SPACE, CLOSE: START}[kind]


def _split_step(state: int, kind: int) -> tuple[int, int]:
    """(next state, marks) of the splitter."""
    if kind == PAD:
        return state, 0
    anew = (_opened(kind), 0 if kind == CLOSE else HERE)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (L if state == QUOTE_L else E):
            return START, 0
        # the quote stands alone and its letter began a word
        return (IN_LETTERS, BEFORE) if kind in _LETTERS else (anew[0], anew[1] | BEFORE)
    if state == AFTER_QUOTE:
        if kind == SHORT:
            return START, 0
        if kind in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
        return (IN_OTHERS, 0) if kind in (OTHER, QUOTE) else anew
    if state in (ONE_BLANK, ONE_SPACE, MORE_BLANK, MORE_SPACE):
        if kind in (BLANK, SPACE):
            return (MORE_BLANK if kind == BLANK else MORE_SPACE), 0
        if kind == CLOSE:
            return START, 0
        if state in (ONE_BLANK, MORE_BLANK):  # a blank joins what follows it
            joined = IN_OTHERS if kind == QUOTE else _opened(kind)
            return joined, (BEFORE if state == MORE_BLANK else 0)
        return anew[0], anew[1] | (BEFORE if state == MORE_SPACE else 0)
    same = {IN_LETTERS: _LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHERS: (OTHER, QUOTE)}.get(state, ())
    return (state, 0) if kind in same else anew


def split_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next states and marks by class and state, and next states of ``AT_ONCE`` classes read together."""
    step = np.array([[_split_step(s, k) for s in range(STATES)] for k in range(CLASSES)], np.uint8)
    following, marks = step[..., 0], step[..., 1]
    several = following
    for _ in range(AT_ONCE - 1):  # first the symbols so far, then one more
        several = following[:, several].transpose(1, 0, 2).reshape(-1, STATES)
    return following, marks, np.ascontiguousarray(several)


def code_point_classes(tokenizer) -> np.ndarray:
    """The class of each code point, as the library's own splitter sees it.

    Letters and numbers of two Unicode versions are compared, one older and one newer than
    the library's; where they differ, the library's splitter is asked.
    """
    letter, number, space = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    unsure = []
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        newer = "L" if letter.match(char) else "N" if number.match(char) else ""
        older = unicodedata.category(char)[0]
        if space.match(char):
            kinds[point] = SPACE
        elif newer:
            kinds[point] = LETTER if newer == "L" else NUMBER
            if newer != older:
                unsure.append(point)
    # Each doubtful code point stands between a letter and a digit.
    asked = tokenizer.pre_tokenizer.pre_tokenize_str("".join(f"\na{chr(point)}1" for point in unsure))
    begins = {span[0] for _, span in asked}
    for i, point in enumerate(unsure):
        joins_letter, joins_number = 4 * i + 2 not in begins, 4 * i + 3 not in begins
        kinds[point] = LETTER if joins_letter else NUMBER if joins_number else OTHER
    for char in _SHORT:
        kinds[ord(char)] = SHORT
    for char, kind in {"r": R, "v": V, "l": L, "e": E, "'": QUOTE, " ": BLANK}.items():
        kinds[ord(char)] = kind
    return kinds


def _code_points(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes; ``leads`` are the places of their first bytes."""
    first = data[leads].astype(np.int32)
    points = first.copy()
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        at, head = leads[wide], first[wide]
        low = [(padded[at + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        two, three = (head & 0x1F) << 6 | low[0], (head & 0x0F) << 12 | low[0] << 6 | low[1]
        four = (head & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2]
        points[wide] = np.where(head < 0xE0, two, np.where(head < 0xF0, three, four))
    return np.minimum(points, sys.maxunicode)


class Splitter:
    """Where the pieces of texts begin."""

    def __init__(self, kinds: np.ndarray):
        self.kinds = kinds
        self.next, self.marks, self.several = split_tables()

    def scan(self, chunks: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The state in which each chunk is entered; ``opens`` says which chunks begin a text.

        The map of a chunk has an exit for each entry; a chunk that begins a text has only one
        entry. Each round composes every map with that of the chunks twice as far back, until
        no exit depends on an entry any more.
        """
        n = len(chunks)
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
        flat = self.several.ravel()
        weights = CLASSES ** np.arange(AT_ONCE - 1, -1, -1)
        for at in range(0, CHUNK, AT_ONCE):
            read = chunks[:, at : at + AT_ONCE].astype(np.int32) @ weights
            maps = flat.take((read * STATES)[:, None] + maps)
        maps[opens] = maps[opens, START][:, None]
        reach = 1
        while reach < n and not (maps == maps[:, :1]).all():
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
            reach *= 2
        entries = np.full(n, START, np.uint8)
        entries[1:] = maps[:-1, 0]
        entries[opens] = START
        return entries

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each piece, and the text it belongs to; text i is ``data[bounds[i]:bounds[i + 1]]``."""
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(leads, bounds)
        kinds = self.kinds[_code_points(data, leads)]
        sizes = np.diff(first)
        filled = np.flatnonzero(sizes)  # each with one more place, where the text is closed
        n_chunks = -(-(sizes[filled] + 1) // CHUNK)
        opening = np.cumsum(n_chunks) - n_chunks
        if not len(filled):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.arange(len(leads)) + np.repeat(opening * CHUNK - first[filled], sizes[filled])
        symbols = np.zeros(int(n_chunks.sum()) * CHUNK, np.uint8)
        symbols[place] = kinds
        symbols[opening * CHUNK + sizes[filled]] = CLOSE
        chunks = symbols.reshape(-1, CHUNK)
        opens = np.zeros(len(chunks), bool)
        opens[opening] = True
        state = self.scan(chunks, opens).astype(np.int32)
        by_place = np.ascontiguousarray(chunks.T).astype(np.int32) * STATES
        marks = np.empty_like(by_place, np.uint8)
        following, marked = self.next.ravel(), self.marks.ravel()
        for at in range(CHUNK):
            read = by_place[at] + state
            marks[at] = marked.take(read)
            state = following.take(read).astype(np.int32)
        written = np.ascontiguousarray(marks.T).ravel()
        begins = (written & HERE).astype(bool)
        begins[:-1] |= (written[1:] & BEFORE) > 0
        mine = np.flatnonzero(begins[place])
        return leads[mine], np.searchsorted(first, mine, side="right") - 1


# --- the counter ------------------------------------------------------------------------------

_FREE = -1
_NO_TOKEN = 0
_NEVER = 1 << 60
#: A transition is filed as one number: the next state, and the change of tokens above ``-_ZERO``.
_MORE_BITS, _ZERO = 16, 1 << 15
#: Few pieces that are longer than this are read byte by byte.
_LONG, _FEW = 2048, 8


def vocabulary(path: str) -> tuple[list[tuple[bytes, bytes]], list[bytes]]:
    """(merges in order as pairs of byte strings, special strings) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    # The printable stand-ins of the bytes in such files.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
    spell = lambda text: bytes(byte[c] for c in text)
    special = []
    for token in described["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
            raise ValueError("special tokens that look around them are not supported")
        special.append(token["content"].encode())
    return [(spell(a), spell(b)) for a, b in pairs], special


class Counter:
    """Counts the tokens of byte strings; transitions are compiled when first met."""

    def __init__(self, merges: list[tuple[bytes, bytes]], most_states: int = MOST_STATES):
        self.most = most_states
        number = {bytes([b]): b + 1 for b in range(256)}  # 0 is no token
        self._rank: dict[tuple[int, int], int] = {}
        self._made: list[tuple[int, int] | None] = [None] * 257
        self._edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        for rank, (a, b) in enumerate(merges):
            pair = (number[a], number[b])
            self._rank[pair] = rank
            if a + b not in number:
                number[a + b] = len(self._made)
                self._made.append(pair)
        # the trie: (node, byte) to node; the token that ends at a node; whether it goes on
        self._child: dict[int, int] = {}
        ends, inner = [_NO_TOKEN], [True]
        for token, mark in number.items():
            node = 0
            for b in token:
                inner[node] = True
                there = self._child.get(node << 8 | b)
                if there is None:
                    there = self._child[node << 8 | b] = len(ends)
                    ends.append(_NO_TOKEN)
                    inner.append(False)
                node = there
            ends[node] = mark
        self._ends, self._inner = ends, inner
        self._clear()

    def _clear(self) -> None:
        self._may: dict[tuple[int, int], bool] = {}
        self._number: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._size = 1 << 16
        self._keys = np.full(self._size, _FREE, np.int64)
        self._values = np.zeros(self._size, np.int64)
        self._used = 0
        self.start = self._state(((_NO_TOKEN, 0, 0),))

    def trim(self) -> None:
        """Start anew if the table is full; states from before are void."""
        if len(self._states) > self.most:
            self._clear()

    def _state(self, places: tuple) -> int:
        found = self._number.get(places)
        if found is None:
            found = self._number[places] = len(self._states)
            self._states.append(places)
        return found

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while it is merged, each with the rank that absorbs it."""
        known = self._edges[side].get(token)
        if known is None:
            known, absorbed, inner = [(token, _NEVER)], _NEVER, token
            while (made := self._made[inner]) is not None:
                absorbed, inner = self._rank[made], made[side]
                known.append((inner, absorbed))
            self._edges[side][token] = known
        return known

    def follows(self, before: int, after: int) -> bool:
        """Whether the border between two tokens stays when their bytes are encoded together."""
        known = self._may.get((before, after))
        if known is None:
            known, rank, rights = True, self._rank, self._edge(after, 0)
            for a, gone in self._edge(before, 1):
                for b, lost in rights:
                    merged = rank.get((a, b))
                    if merged is not None and merged < gone and merged <= lost:
                        known = False
            self._may[before, after] = known
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, how many tokens more) of a transition."""
        alive, last, fewer = [], _NO_TOKEN, 0
        for token, node, behind in self._states[state]:
            node = self._child.get(node << 8 | byte)
            if node is None:
                continue
            end = self._ends[node]
            if end and (not token or self.follows(token, end)):
                last, fewer = end, behind + 1
            if self._inner[node]:
                alive.append((token, node, behind))
        places = (*((token, node, behind - fewer) for token, node, behind in alive), (last, 0, 0))
        return self._state(places), fewer

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._size.bit_length() + 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, or the free slot where it belongs, and what the slot holds."""
        slot = self._slot(keys)
        held = self._keys.take(slot)
        open_ = np.flatnonzero((held != keys) & (held != _FREE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self._size - 1)
            held[open_] = self._keys.take(slot[open_])
            open_ = open_[(held[open_] != keys[open_]) & (held[open_] != _FREE)]
        return slot, held

    def _grow(self) -> None:
        used = self._keys != _FREE
        keys, values = self._keys[used], self._values[used]
        self._size *= 4
        self._keys = np.full(self._size, _FREE, np.int64)
        self._values = np.zeros(self._size, np.int64)
        self._used = 0
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """File keys that are not in the table; of those that meet in a slot, one is filed in each round."""
        self._used += len(keys)
        while len(keys):
            slot, _ = self._find(keys)
            _, first = np.unique(slot, return_index=True)
            self._keys[slot[first]], self._values[slot[first]] = keys[first], values[first]
            keys, values = np.delete(keys, first), np.delete(values, first)

    def transitions(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, how many tokens more) of many transitions at once."""
        keys = states << 8 | read
        slot, held = self._find(keys)
        new = np.unique(keys[held == _FREE])
        if len(new):
            while (self._used + len(new)) * 2 > self._size:
                self._grow()
            made = [self._compile(key >> 8, key & 255) for key in new.tolist()]
            self._put(new, np.array([there << _MORE_BITS | (more + _ZERO) for there, more in made], np.int64))
            slot, held = self._find(keys)
        value = self._values.take(slot)
        return value >> _MORE_BITS, (value & (2 * _ZERO - 1)) - _ZERO

    def _rest(self, state: int, data: np.ndarray) -> int:
        """How many tokens more the rest of a long piece brings."""
        met: dict[int, tuple[int, int]] = {}
        total = 0
        for byte in data.tobytes():
            step = met.get(state << 8 | byte)
            if step is None:
                there, more = self.transitions(np.array([state]), np.array([byte]))
                step = met[state << 8 | byte] = int(there[0]), int(more[0])
            state = step[0]
            total += step[1]
        return total

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The tokens of each piece ``data[start:start + size]``; all pieces advance by a byte together."""
        self.trim()
        order = np.argsort(-sizes, kind="stable")
        starts, falling = starts[order], -sizes[order]
        state = np.full(len(order), self.start, np.int64)
        total = np.zeros(len(order), np.int64)
        at = 0
        while (n := int(np.searchsorted(falling, -at, side="left"))) > 0:
            if at >= _LONG and n <= _FEW:
                for i in range(n):
                    total[i] += self._rest(int(state[i]), data[starts[i] + at : starts[i] - falling[i]])
                break
            state[:n], more = self.transitions(state[:n], data[starts[:n] + at])
            total[:n] += more
            at += 1
        out = np.empty_like(total)
        out[order] = total
        return out


class Transducers:
    """Both transducers of one vocabulary, and its special strings."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[bytes], kinds: np.ndarray):
        self.special = special
        self.splitter, self.counter = Splitter(kinds), Counter(merges)

    def _without_special(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds of segments, row of each segment or -1 for a special string, special strings of each row)."""
        n = len(bounds) - 1
        raw, found = data.tobytes(), []
        if any(s in raw for s in self.special):
            pattern = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
            for i in range(n):
                found += [(m.start(), m.end(), i) for m in pattern.finditer(raw, int(bounds[i]), int(bounds[i + 1]))]
        if not found:
            return bounds, np.arange(n), np.zeros(n, np.int64)
        begin, end, row = (np.array(x) for x in zip(*found, strict=True))
        edges = np.concatenate([bounds, begin, end])
        rows = np.concatenate([np.arange(n + 1), np.full(len(row), -1), row])
        # where places are equal, an earlier row's segment comes first and a special string last but its end
        order = np.lexsort((np.concatenate([np.zeros(n + 1), np.full(len(row), 1), np.full(len(row), -1)]), edges))
        edges, rows = edges[order], rows[order]
        return edges, rows[:-1], np.bincount(row, minlength=n)

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The tokens of each row of a slice."""
        edges, rows, total = self._without_special(data, bounds)
        starts, segment = self.splitter.pieces(data, edges)
        ends = np.append(starts[1:], len(data))
        ends = np.minimum(ends, edges[segment + 1])
        row = rows[segment]
        own = np.flatnonzero(row >= 0)
        tokens = self.counter.counts(data, starts[own], (ends - starts)[own])
        return total + np.bincount(row[own], tokens, len(bounds) - 1).astype(np.int64)


#: The transducers of this worker, by the vocabulary they were compiled from.
_compiled: dict[str, Transducers] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``path`` is a byte-level BPE vocabulary with the usual pattern of seven alternatives, read on
    the driver; what is broadcast is that file's merges and a table of code points.
    """
    from tokenizers import Tokenizer

    merges, special = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((merges, special, code_point_classes(Tokenizer.from_file(path))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _compiled:
            _compiled[path] = Transducers(*shared.value)
        own = _compiled[path]
        for batch in batches:
            n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, bounds in slices(batch.column("text"), SLICE):
                n_bytes.append(np.diff(bounds))
                n_tokens.append(own.counts(data, bounds))
            tokens = np.concatenate(n_tokens)
            columns = [batch.column("doc_id"), pa.array(np.concatenate(n_bytes)), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
