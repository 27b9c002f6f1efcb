"""Repeated passages of words, with suffix automata of reference shards.

Candidate spans come from `repeats`: the corpus against itself, by synchronised picks. The
spans of one gram are a reference shard of bounded size; its suffix automaton is built in
the task that has the shard, and the same spans, and those of the gram's other shards, are
streamed through it. Their matching statistics say at each word how long a passage ends
there that the shard has too; a state knows in how many spans its passages occur. Windows
with a second occurrence are removed, as maximal covered runs of words.

Sending every shard's automaton to all tasks would grow with the square of the corpus, so a
shard goes only where documents share one of its grams.

Words are compared by 64-bit hashes. Null, empty and blank texts have no words and keep the
hash of nothing. A row that occurs twice repeats itself and loses all its windows. Rows with
a null id take part. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lumengraph.llm.kernel import SEPARATOR, Words
from lumengraph.llm.repeats import remove_repeats

#: Words of a window, and of the gram that synchronises it.
WINDOW, GRAM = 35, 10


class SuffixAutomaton:
    """All stretches of the added sequences; ``count`` is how many places of them each state ends at."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _clone(self, state: int, before: int, symbol: int, length: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.count.append(0)
        self.link[state] = copy
        while before >= 0 and self.next[before].get(symbol) == state:
            self.next[before][symbol] = copy
            before = self.link[before]
        return copy

    def add(self, sequence: list[int]) -> None:
        link, length, step = self.link, self.length, self.next
        last = 0
        for symbol in sequence:
            there = step[last].get(symbol)
            if there is not None:  # the stretch is known already
                last = there if length[there] == length[last] + 1 else self._clone(there, last, symbol, length[last] + 1)
            else:
                new, before = len(step), last
                step.append({})
                length.append(length[last] + 1)
                link.append(0)
                self.count.append(0)
                while before >= 0 and symbol not in step[before]:
                    step[before][symbol] = new
                    before = link[before]
                if before >= 0:
                    there = step[before][symbol]
                    link[new] = there if length[there] == length[before] + 1 else self._clone(there, before, symbol, length[before] + 1)
                last = new
            self.count[last] += 1

    def finish(self) -> None:
        """Hand the counts on to all shorter endings."""
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list[int], window: int) -> list[bool]:
        """Of each place where a window of ``sequence`` ends, whether the automaton has it in two places."""
        link, length, step, count = self.link, self.length, self.next, self.count
        state, matched, out = 0, 0, []
        for place, symbol in enumerate(sequence, 1):
            while state and symbol not in step[state]:
                state = link[state]
                matched = length[state]
            there = step[state].get(symbol)
            if there is not None:
                state, matched = there, matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if place >= window:
                out.append(matched >= window and count[state] > 1)
        return out


def by_automaton(stretches: list[np.ndarray], groups: np.ndarray, window: int) -> list[np.ndarray]:
    """Which window starts of each stretch occur in another stretch of its group."""
    _, numbers = np.unique(np.concatenate(stretches), return_inverse=True)
    edges = np.cumsum([0, *map(len, stretches)])
    spelt = [numbers[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out: list[np.ndarray] = []
    change = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1)).tolist()
    for a, b in zip(change, [*change[1:], len(groups)], strict=True):
        shard = SuffixAutomaton()
        for sequence in spelt[a:b]:
            shard.add(sequence)
        shard.finish()
        out += [np.array(shard.repeated(sequence, window), bool) for sequence in spelt[a:b]]
    return out


def kept_words(data: np.ndarray, bounds: np.ndarray, covered: np.ndarray, edges: np.ndarray, words: Words) -> Iterator[tuple]:
    """(n_words, n_removed, kept_sha256) of each text of a slice."""
    # each kept word goes with the byte behind it, made a space
    inside = np.zeros(len(data) + 1, np.int8)
    starts, ends = words.start[~covered], words.end[~covered]
    row_end = bounds[np.searchsorted(bounds, starts, side="right")]
    inside[starts] += 1
    np.add.at(inside, np.minimum(ends + 1, row_end), -1)
    kept = np.cumsum(inside[:-1], dtype=np.int8) > 0
    plain = np.where(SEPARATOR[data], np.uint8(0x20), data)
    for i in range(len(bounds) - 1):
        own = slice(bounds[i], bounds[i + 1])
        text = plain[own][kept[own]].tobytes().removesuffix(b" ")
        a, b = int(edges[i]), int(edges[i + 1])
        yield b - a, int(covered[a:b].sum()), hashlib.sha256(text).hexdigest()


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return remove_repeats(docs, True, window, gram, by_automaton, kept_words, "n_words long, n_removed long, kept_sha256 string")
