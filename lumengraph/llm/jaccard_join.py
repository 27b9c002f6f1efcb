"""Exact self-join of documents by Jaccard similarity of word shingles, as components of links.

A T-occurrence problem: the documents that share at least T of a document's shingles, where
T follows from the sizes. Equal sets are one node from the start. Then

1. prefixes: under one order of all shingles, linked sets share one of the first
   n - ceil(0.8 n) + 1 of each. Shingles with long lists in a first count come last in the
   order, so that prefixes are made of rare ones;
2. inverted lists of the prefixes: a short list gives its pairs of fitting sizes, a long one
   only ties its members together. Pairs are tested by bitmaps that bound the overlap from
   above. What remains ties candidates into groups;
3. T-occurrence search inside the groups, DivideSkip: for a document as the query, its
   shorter lists are merged by counting, members that cannot reach T by the longer lists are
   dropped, and the others are looked up in the longer lists by binary search. Pairs that
   links join already are not looked at. Groups of any size are worked on in blocks of a
   bounded number of sets: each block by itself, then one set of each component, then the
   sets outside of the largest component against all others.

No pair of linked sets is lost: step 2 keeps all that can be linked, and step 3 leaves out
only pairs that are already connected, which cannot change a component.

Null and empty texts, and texts without words, have the empty set and are linked with
nothing. Rows with a null id take part; a component of only such rows has a null id. Rows
that repeat an id are rows of their own. An empty table gives no rows. Only ``doc_id`` and
``text`` are read. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.llm.common import texts
from lumengraph.llm.components import components
from lumengraph.llm.kernel import LOWER, Sums, Words, mix, slices
from lumengraph.session import cut

WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
#: The longest list whose pairs are listed; shingles put last in the order, at most (8 MB).
SHORT, LAST = 16, 1 << 20
#: Long lists are counted over so many prefixes' lengths, as prefixes reach further without them.
AHEAD = 2
#: Sets of a block of the search, and their shingles, on average at most.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20
#: Bits of the filter that says which sets' shingles are fetched: 8 MB.
FILTER_BITS = 1 << 26


def _sets(text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for first, end, data, bounds in slices(text):
        data = LOWER[data]
        words = Words(data, bounds)
        sums = Sums(words.hashes(data))
        grams = sums.every(WORDS)
        for i in range(end - first):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= WORDS:
                yield first + i, np.unique(grams[a : b - WORDS + 1])
            else:
                yield first + i, sums.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def _node(shingles: np.ndarray) -> int:
    return int((mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))).view(np.int64))


def _bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles at each of 256 to 65536 places, about two for each shingle."""
    bits = 1 << min(16, max(8, (2 * len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _can_link(a: bytes, b: bytes, total: int) -> bool:
    """False only if the sets behind two bitmaps differ too much for their sizes' sum."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    differ = int(np.bitwise_count(x ^ y).sum())
    # overlap is (total - differ) / 2 at most
    return 100 * (total - differ) >= PERCENT * (total + differ)


def _prefix(shingles: np.ndarray, last: np.ndarray, times: int = 1) -> np.ndarray:
    """The shingles of a prefix, or ``times`` as many."""
    n = len(shingles)
    if len(last) and n:
        late = last[np.minimum(np.searchsorted(last, shingles), len(last) - 1)] == shingles
        shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[: times * (n - -(-PERCENT * n // 100) + 1)] if n else shingles


def document_sets(rows: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), node (null for an empty set), n, bitmap."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_node(s), len(s), _bitmap(s)) if len(s) else (None, 0, None) for _, s in _sets(batch.column("text"))]
            node, n, bitmap = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(bitmap, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "n", "bitmap"])

    return rows.withColumn("key", F.xxhash64("text")).mapInArrow(describe, "doc_id long, key long, node long, n long, bitmap binary")


def _prefixes(rows: DataFrame, last: np.ndarray, with_node: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(last)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            tokens, nodes, sizes = [np.zeros(0, np.uint64)], [], []
            for _, shingles in _sets(batch.column("text")):
                node = _node(shingles) if len(shingles) else None
                if node is None or node in seen:  # the same set once for a batch
                    continue
                seen.add(node)
                tokens.append(_prefix(shingles, shared.value, 1 if with_node else AHEAD))
                nodes.append(node)
                sizes.append(len(shingles))
            token = pa.array(np.concatenate(tokens).view(np.int64))
            if not with_node:
                yield pa.RecordBatch.from_arrays([token], ["token"])
                continue
            times = [len(t) for t in tokens[1:]]
            columns = [token, pa.array(np.repeat(np.array(nodes, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int64), times).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n"])

    return rows.select("text").mapInArrow(emit, "token long" + ", node long, n int" * with_node)


def long_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted shingles with long lists in prefixes by hash; at most `LAST`, those with the longest.

    They only set an order: any set of shingles here gives the same result.
    """
    counts = _prefixes(rows, np.zeros(0, np.uint64), False).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHORT)
    counts = cut(counts)
    if counts.count() > LAST:
        steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.col("n").desc())
        room, least = LAST, 1 << 62
        for row in steps.toLocalIterator():
            room -= row["tokens"]
            if room < 0:
                break
            least = row["n"]
        counts = counts.where(F.col("n") >= least)
    return np.sort(counts.select("token").toPandas()["token"].to_numpy().astype(np.int64).view(np.uint64))


def _fits(a: int, b: int) -> bool:
    return 100 * min(a, b) >= PERCENT * max(a, b)


def candidates(rows: DataFrame, last: np.ndarray) -> DataFrame:
    """a, b, long: pairs of nodes from short lists, and ties of a long list's nodes to its first."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, first, size = None, [], None, 0
        out: list[tuple[int, int, bool]] = []

        def close() -> None:
            if 1 < size <= SHORT:
                out.extend((min(a, b), max(a, b), False) for i, (a, n) in enumerate(members) for b, m in members[:i] if _fits(n, m))

        for batch in batches:
            token, node, n = (batch.column(c).to_numpy() for c in ("token", "node", "n"))
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            edges = np.append(np.flatnonzero(new), len(token))
            wanted = edges[1:] - edges[:-1] > 1  # others are alone, unless the batch cuts their list
            wanted[:1] = wanted[-1:] = True
            for a, b in zip(edges[:-1][wanted].tolist(), edges[1:][wanted].tolist(), strict=True):
                if token[a] != at:
                    close()
                    at, members, first, size = token[a], [], None, 0
                for x, m in dict(zip(node[a:b].tolist(), n[a:b].tolist(), strict=True)).items():
                    if members and members[-1][0] == x or first == x:
                        continue
                    first = x if first is None else first
                    size += 1
                    if size <= SHORT:
                        members.append((x, m))
                    else:
                        if size == SHORT + 1:
                            out.extend((first, y, True) for y, _ in members[1:])
                        members[-1:] = [(x, m)]
                        out.append((first, x, True))
            if out:
                yield _edges(out)
                out = []
        close()
        if out:
            yield _edges(out)

    postings = _prefixes(rows, last, True)
    dealt = postings.repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(lists, "a long, b long, long boolean").distinct()


def _edges(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    a, b, long = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(long, pa.bool_())], ["a", "b", "long"])


def _passing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps let them be linked."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = (batch.column(c).to_pylist() for c in ("x", "y", "n"))
            fit = pa.array([_can_link(*v) for v in zip(x, y, n, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(fit), batch.column("b").filter(fit)], ["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("bitmap").alias("x"), F.col("n").alias("m"))
    right = nodes.select(F.col("node").alias("b"), F.col("bitmap").alias("y"), F.col("n").alias("o"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", (F.col("m") + F.col("o")).alias("n"))
    return both.mapInArrow(test, "a long, b long")


class _Forest:
    def __init__(self, labels: np.ndarray):
        """Members with equal labels are joined."""
        _, first, place = np.unique(labels, return_index=True, return_inverse=True)
        self.root = first[place].copy()

    def join(self, x: int, others: np.ndarray) -> list[int]:
        """Join ``x`` with the components of ``others``; one of each that was apart."""
        met = []
        for y in others.tolist():
            if self.root[y] != self.root[x]:
                self.root[self.root == self.root[y]] = self.root[x]
                met.append(y)
        return met


def t_occurrences(sets: list[np.ndarray], labels: np.ndarray, queries: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all linked sets, where one of a pair is among ``queries``; sets with equal labels count as joined."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")  # lists hold places in the order of size
    sets, size, labels, queries = [sets[i] for i in order], size[order], labels[order], queries[order]
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    by_token = np.lexsort((owner, tokens))
    tokens, owner = tokens[by_token], owner[by_token]
    forest, out = _Forest(labels), []
    for x in np.flatnonzero(queries):
        n = size[x]
        low, high = np.searchsorted(size, -(-PERCENT * n // 100)), np.searchsorted(size, 100 * n // PERCENT, side="right")
        open_ = np.zeros(len(sets), bool)
        open_[low:high] = forest.root[low:high] != forest.root[x]
        if not open_.any():
            continue
        need = -(-PERCENT * (n + size) // (100 + PERCENT))  # least overlap with a set of each size
        start, end = np.searchsorted(tokens, sets[x]), np.searchsorted(tokens, sets[x], side="right")
        by_length = np.argsort(end - start, kind="stable")
        start, end = start[by_length], end[by_length]
        least = int(need[open_].min())
        longest = int(end[-1] - start[-1])
        long = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1))) if longest > 32 else 0
        short = len(start) - long
        length = (end - start)[:short]
        place = np.repeat(start[:short] - np.cumsum(length) + length, length) + np.arange(length.sum())
        count = np.bincount(owner[place], minlength=len(sets))
        left = np.flatnonzero(open_ & (count + long >= need))
        count = count[left]
        for nth, (a, b) in enumerate(zip(start[short:].tolist(), end[short:].tolist(), strict=True), 1):
            at = np.searchsorted(owner[a:b], left)
            count = count + (owner[a:b][np.minimum(at, b - a - 1)] == left)
            fit = count + long - nth >= need[left]
            left, count = left[fit], count[fit]
            if not len(left):
                break
        out += [(int(order[x]), int(order[y])) for y in forest.join(x, left)]
    return out


def _search(blocks: DataFrame) -> DataFrame:
    """a, b: links found in each block of ``blocks`` (block columns, node, label, query, shingles)."""

    def find(table: pa.Table) -> pa.Table:
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        query = np.array(table.column("query").to_pylist(), bool)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        links = t_occurrences(sets, label, query)
        return pa.table({"a": pa.array([int(node[a]) for a, _ in links], pa.int64()), "b": pa.array([int(node[b]) for _, b in links], pa.int64())})

    return blocks.groupBy("grp", "part", "other").applyInArrow(find, "a long, b long")


def _fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the nodes of ``wanted``: rows pass a bounded filter before they are shuffled."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique((batch.column("node").to_numpy() & (FILTER_BITS - 1)) >> 6))], ["word"])

    # which 64-bit words of the filter are in use: at most FILTER_BITS / 64 numbers
    words = wanted.select("node").mapInArrow(mark, "word long").distinct().toPandas()["word"].to_numpy()
    used = np.zeros(FILTER_BITS >> 6, bool)
    used[words] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(used))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_use = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            out: dict[int, bytes] = {}
            for _, shingles in _sets(batch.column("text")):
                if len(shingles) and in_use[((node := _node(shingles)) & (FILTER_BITS - 1)) >> 6]:
                    out[node] = shingles.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["node", "shingles"])

    found = rows.select("text").mapInArrow(emit, "node long, shingles binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])



def set_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: links that connect the same nodes as all links do."""
    ties = cut(candidates(rows, long_shingles(rows)))
    near = cut(_passing(ties.where("not long").select("a", "b"), nodes).unionByName(ties.where("long").select("a", "b")))
    groups = components(near).select("node", F.col("label").alias("grp"))
    sets = cut(groups.join(_fetch(rows, groups), "node").select("node", "grp", "shingles"))
    parts = F.greatest(F.floor((F.count(F.lit(1)) - 1) / BLOCK), F.floor(F.sum(F.length("shingles")) / (8 * BLOCK_SHINGLES)))
    sizes = sets.groupBy("grp").agg((1 + parts).cast("int").alias("parts"))
    dealt = sets.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = cut(dealt)
    # each block by itself
    links = cut(_search(dealt.withColumns({"other": F.lit(0), "label": F.col("node"), "query": F.lit(True)})))
    large = dealt.where("parts > 1")
    if not large.limit(1).count():
        return links

    def labelled(known: DataFrame) -> DataFrame:
        return large.join(components(known), "node", "left").withColumn("label", F.coalesce("label", "node"))

    # one set of each component of each block
    heads = labelled(links).withColumn("head", F.row_number().over(Window.partitionBy("grp", "part", "label").orderBy("node")) == 1).where("head")
    count = heads.groupBy("grp").agg((1 + F.floor((F.count(F.lit(1)) - 1) / BLOCK)).cast("int").alias("head_parts"))
    heads = heads.join(count, "grp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("head_parts")).cast("int"))
    links = cut(links.unionByName(_search(heads.withColumns({"other": F.lit(-1), "query": F.lit(True)}))))
    # what is outside of a group's largest component against all others
    now = cut(labelled(links))
    share = now.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = share.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("apart")).where("apart > 0")
    now = now.join(main.withColumn("others", (1 + F.floor((F.col("apart") - 1) / BLOCK)).cast("int")), "grp")
    apart = now.where("label <> main").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.hash("node"), F.col("others")).alias("other"), "node", "label", F.lit(True).alias("query"), "shingles"
    )
    everyone = now.select("grp", "part", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "node", "label", F.lit(False).alias("query"), "shingles")
    return links.unionByName(_search(apart.unionByName(everyone)))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, component_id of every row, and ``first``: whether it is its component's first row."""
    rows = texts(docs)
    described = cut(document_sets(rows))
    nodes = cut(described.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap")))
    found = components(set_links(rows, nodes))
    labelled = described.drop("bitmap").join(found, "node", "left")
    labelled = cut(labelled.withColumn("label", F.coalesce("label", "node")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("least"))
    joined = labelled.where("label IS NOT NULL").join(firsts, "label").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), (F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.key") == F.col("key"))).alias("first")
    )
    empty = labelled.where("label IS NULL").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return joined.unionByName(empty)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first row of each component, with all columns of ``docs``; rows that repeat id and text stay or go together."""
    gone = jaccard_components(docs).where("not first").select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (F.col("__key") == F.col("__gone_key"))
    return keyed.join(gone, match, "left_anti").select(*docs.columns)
