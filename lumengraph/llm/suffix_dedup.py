"""Repeated byte strings by distributed prefix doubling.

Positions are ranked by growing prefixes, and those whose rank is unique drop out. Ranking
every byte in Spark would shuffle some 20 bytes for each byte of text and round, so the
first rounds rank synchronised positions only (see `repeats`): by the 48 bytes from a
position, where most become unique, and then by pairs of that rank and the rank of the whole
span around it, where copies are settled as a whole. Spark deals what is left out by rank,
and there every window start is ranked by pairs (rank here, rank at the offset), at offsets
25, 50 and 100, until its rank is unique or the threshold of 200 bytes is reached.

Null and empty texts have no bytes and keep the hash of nothing. A row that occurs twice
repeats itself. Rows with a null id take part. An empty table gives no rows. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lumengraph.llm.kernel import Words, byte_sums
from lumengraph.llm.repeats import remove_repeats

#: Bytes of a window, and of the gram that synchronises it.
WINDOW, GRAM = 200, 48
#: Longest prefix that the first ranks of a group are made of.
START = 32


def by_doubling(stretches: list[np.ndarray], groups: np.ndarray, window: int) -> list[np.ndarray]:
    """Which window starts of each stretch occur in another stretch of its group."""
    data = np.concatenate(stretches)
    edges = np.cumsum([0, *map(len, stretches)])
    owner = np.repeat(np.arange(len(stretches)), np.diff(edges))
    length = window
    while length > START:
        length = -(-length // 2)
    # rank 0 is of positions that dropped out or are too near the end
    rank = np.zeros(len(data), np.int64)
    inside = np.flatnonzero(np.arange(len(data)) + length <= edges[owner + 1])
    names = byte_sums(data).every(length)[inside]
    rank[inside] = _ranks(names, groups[owner[inside]])
    while length < window:
        step = min(length, window - length)
        live = np.flatnonzero(rank > 0)
        live = live[live + step + length <= edges[owner[live] + 1]]
        live = live[rank[live + step] > 0]
        new = np.zeros_like(rank)
        new[live] = _ranks(rank[live], rank[live + step])
        rank, length = new, length + step
    starts = edges[1:] - edges[:-1] - window + 1
    return [rank[a : a + n] > 0 for a, n in zip(edges[:-1].tolist(), starts.tolist(), strict=True)]


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The rank of each pair, from 1; 0 for pairs that occur once."""
    if not len(first):
        return np.zeros(0, np.int64)
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.cumsum(new)
    number[np.bincount(number)[number] == 1] = 0
    out = np.zeros(len(a), np.int64)
    out[order] = number
    return out


def kept_bytes(data: np.ndarray, bounds: np.ndarray, covered: np.ndarray, edges: np.ndarray, words: Words | None) -> Iterator[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text of a slice."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        gone = covered[a:b]
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)) if b > a else 0
        yield b - a, int(gone.sum()), spans, hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest()


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return remove_repeats(docs, False, window, gram, by_doubling, kept_bytes, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
