"""The operators against plain Python on a small corpus with every odd case."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengraph.llm import exact_dedup, jaccard_join, language_id, mixing, packing, ppm, queries, substring_dedup, suffix_dedup, topk, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string, lang string, source string, score string, kept string, text_sha256 string, component_id string, label string"


def corpus(rng) -> list[tuple]:
    vocabulary = [f"w{i}" if i % 3 else f"Été{i}" for i in range(300)]
    some = lambda n: [vocabulary[i] for i in rng.integers(0, 300, n)]
    passage, base = some(60), some(200)
    texts: list[str | None] = [None, "", "  \t\n", "a", "A", "one two", "x" * 300, "ab" * 400, " ".join(some(4000))]
    for i in range(12):  # near copies
        own = list(base)
        own[(13 * i) % 200] = f"edit{i}"
        texts.append(" ".join(own))
    texts += [" ".join(some(30) + passage + some(40)) for _ in range(6)]
    texts += [" ".join(some(int(n))) for n in rng.integers(1, 120, 20)]
    texts += ["same text here"] * 3 + ["same\n text  here", " same text here"]
    rows = [(i, t, ("en", "fr", None)[i % 3], (f"src{i % 4}", None)[i % 7 == 6], "s", "k", "t", "c", "l") for i, t in enumerate(texts)]
    rows.append((None, "without an id", None, None, None, None, None, None, None))
    return [*rows, rows[-3], rows[-3]]  # repeated rows


@pytest.fixture(scope="module")
def rows(rng):
    return corpus(rng)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def test_exact(docs, none, rows):
    normal = [re.sub(rb"[\x20\x09-\x0D]+", b" ", raw(r[1])) for r in rows]
    keep, size = {}, Counter(normal)
    for r, n in zip(rows, normal, strict=True):
        keep[n] = min((x for x in (keep.get(n), r[0]) if x is not None), default=None)
    got = exact_dedup.exact_duplicates(docs).collect()
    key = lambda x: tuple(map(str, x))
    want = [(r[0], keep[n], size[n], hashlib.sha256(n).hexdigest()) for r, n in zip(rows, normal, strict=True)]
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=key) == sorted(want, key=key)
    assert sorted(g.text_sha256 for g in got if g.kept) == sorted({w[3] for w in want})
    # a filter of the least size lets more rows through and changes nothing
    small = exact_dedup.exact_duplicates(docs, max_bits=exact_dedup.SLICE_BITS).collect()
    assert sorted(map(key, small)) == sorted(map(key, got))
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(size)
    assert exact_dedup.exact_duplicates(none).count() == 0


def components(rows) -> dict:
    sets = []
    for r in rows:
        w = WORD.findall(raw(r[1]).translate(LOW))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[(r[0], len(sets[i]), min(ids, default=None))] += 1
    return out


def test_jaccard(docs, none, rows, monkeypatch):
    want = components(rows)
    got = jaccard_join.jaccard_components(docs)
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got.collect()) == want
    # long lists and groups of many blocks
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    got = jaccard_join.jaccard_components(docs)
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got.collect()) == want
    assert jaccard_join.jaccard_components(none).count() == 0


def test_t_occurrences(rng):
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 120).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(120) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 1 << 60, 120), base).astype(np.uint64)) for _ in range(50)]
        links = jaccard_join.t_occurrences(sets, np.arange(50), np.ones(50, bool))
        want, got = jaccard_join._Forest(np.arange(50)), jaccard_join._Forest(np.arange(50))
        for i in range(50):
            near = [j for j in range(50) if (c := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - c)]
            want.join(i, np.array(near))
        for a, b in links:
            got.join(a, np.array([b]))
        assert len(np.unique(np.stack([want.root, got.root]), axis=1).T) == len(np.unique(want.root)) == len(np.unique(got.root))


def removed(symbols: list, window: int) -> list[np.ndarray]:
    grams = [[tuple(s[k : k + window]) for k in range(len(s) - window + 1)] for s in symbols]
    count = Counter(g for own in grams for g in own)
    out = []
    for s, own in zip(symbols, grams, strict=True):
        mask = np.zeros(len(s), bool)
        for k, g in enumerate(own):
            if count[g] > 1:
                mask[k : k + window] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("window, gram", [(35, 10), (6, 3)])
def test_passages(docs, none, rows, window, gram):
    words = [WORD.findall(raw(r[1])) for r in rows]
    want = Counter()
    for r, w, m in zip(rows, words, removed(words, window), strict=True):
        want[(r[0], len(w), int(m.sum()), hashlib.sha256(b" ".join(x for x, gone in zip(w, m, strict=True) if not gone)).hexdigest())] += 1
    assert Counter(map(tuple, substring_dedup.remove_repeated_passages(docs, window, gram).collect())) == want
    assert substring_dedup.remove_repeated_passages(none).count() == 0


@pytest.mark.parametrize("window, gram, shard", [(200, 48, 1000), (20, 8, 3)])
def test_byte_strings(docs, none, rows, window, gram, shard, monkeypatch):
    from lumengraph.llm import repeats

    monkeypatch.setattr(repeats, "SHARD", shard)
    texts = [raw(r[1]) for r in rows]
    want = Counter()
    for r, t, m in zip(rows, texts, removed(texts, window), strict=True):
        spans = int((np.diff(m.astype(int), prepend=0) == 1).sum())
        want[(r[0], len(t), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.remove_repeated_bytes(docs, window, gram).collect())) == want
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    capacity = 64
    pieces = packing.pack_documents(docs, queries.tokenizer_path(), capacity).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            want[(r[0], n, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    sequences: dict[int, list] = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    assert len(sequences) <= 1.05 * math.ceil(sum(p.length for p in pieces) / capacity) + 1
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


def test_plan(rng):
    for _ in range(200):
        capacity = int(rng.integers(4, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 120)))
        plan = packing.make_plan(dict(Counter(lengths.tolist())), capacity)
        assert not plan.left and plan.used == dict(Counter(lengths.tolist()))
        fill = Counter()
        for length, _, sequence, each, _ in plan.runs:
            assert each >= 1 and sequence < plan.sequences
        order = sorted(plan.runs, key=lambda r: (r[0], r[1]))
        for i, (length, rank, sequence, each, _) in enumerate(order):
            end = order[i + 1][1] if i + 1 < len(order) and order[i + 1][0] == length else plan.used[length]
            for k in range(rank, end):
                fill[sequence + (k - rank) // each] += length
        assert max(fill.values()) <= capacity and len(fill) == plan.sequences
        loose = sum(-(-c * n // capacity) for n, c in Counter(lengths.tolist()).items())
        assert plan.sequences <= max(loose, 1.3 * -(-int(lengths.sum()) // capacity) + 1)


def test_mixing(docs, none, rows):
    got = mixing.mix(docs).collect()
    used = Counter()
    for g in got:
        used[(g.domain, g.lang, g.source)] += g.copies * g.n_tokens
    total = sum(len(WORD.findall(raw(r[1]))) for r in rows)
    budget = {(g.domain, g.lang, g.source): g.budget for g in got}
    assert sum(budget.values()) <= mixing.SHARE * total + 1e-6
    assert all(used[k] <= budget[k] for k in budget)
    once = mixing.mix_documents(docs)
    assert once.columns == docs.columns and once.count() <= len(rows)
    assert mixing.mix(none).count() == 0


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10, 1), ("d0", "en", "b", 500, 1), ("d1", "en", "a", 1000, 1)], "domain string, lang string, source string, tokens long, docs long")
    out = {(r.domain, r.source): r.budget for r in mixing.allocate(leaves, {}, 0.4, 1).collect()}
    assert out == {("d0", "a"): 10, ("d0", "b"): 292, ("d1", "a"): 302}  # b takes what a lacks
    out = {(r.domain, r.source): r.budget for r in mixing.allocate(leaves, {}, 0.8, 1).collect()}
    assert out == {("d0", "a"): 10, ("d0", "b"): 500, ("d1", "a"): 698}  # then the other domain


def test_language(docs, none, rows, spark):
    got = {(g.doc_id, g.lang_pred, round(g.score, 9)) for g in language_id.predict_languages(docs).collect()}
    assert len(got) == len({r[0] for r in rows})
    pred = {g[0]: g for g in got}
    assert all(pred[r[0]][1] == "und" and pred[r[0]][2] == 0 for r in rows if not re.search(r"[^\W\d_]", r[1] or ""))
    spoken = [(i, t, x, None) for i in range(40) for t, x in ((f"the cat sat on that mat {i}", "en"), (f"der hund und die katze {i}", "de"))]
    spoken = [(2 * i + (x == "de"), t, x, s) for i, t, x, s in spoken]
    out = language_id.predict_languages(spark.createDataFrame(spoken, "doc_id long, text string, lang string, source string")).collect()
    assert {g.lang_pred for g in out if g.doc_id % 2} == {"de"} and {g.lang_pred for g in out if not g.doc_id % 2} == {"en"}
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1 for g in out)
    assert language_id.predict_languages(none).count() == 0
    assert language_id.drop_unidentified(docs).columns == docs.columns


def test_cosines_match_bundles(spark):
    texts = ["abc abd", "une phrase", "x"]
    langs, dots = language_id.learn(spark.createDataFrame([(t, f"l{i}") for i, t in enumerate(texts)], "text string, lang string"), 256)
    letters = (language_id.seeded(29, language_id.SYMBOLS * 256) >> np.uint64(63)).astype(np.int8).reshape(-1, 256) * 2 - 1
    bundles = [language_id._vectors(c, letters).astype(float).sum(axis=0) for t in texts for _, _, c, _ in language_id._trigrams([t])]
    for i, bundle in enumerate(bundles):
        for _, _, codes, _ in language_id._trigrams(["abd phrase"]):
            want = language_id._vectors(codes, letters).astype(float).sum(axis=0) @ bundle / np.linalg.norm(bundle)
            assert abs(dots[codes, i].sum() - want) < 1e-3 * max(1, abs(want))


def best_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """By definition: the best stretch, shortest first, then the same left and right of it."""
    found = [(round(float(scores[a:b].sum()), 9), a - b, -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    best = max(found, default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[3:]
    return best_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in best_segments(scores[b:])]


def test_segments(rng):
    for _ in range(200):
        scores = np.round(rng.normal(-0.3, 1, int(rng.integers(1, 25))), 3)
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == best_segments(scores)


def test_toxicity(spark, docs, none):
    rows = [(i, f"some words number{i} and more" + (" vile rude words" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, None if i == 7 else int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(frame, labels)
    out = toxicity.score_documents(frame, model).collect()
    assert all((g.score >= 0.5) == (g.doc_id % 4 == 0) == bool(g.predicted) for g in out)
    spans = toxicity.toxic_passages(frame, model).collect()
    assert {s.doc_id for s in spans} == set(range(0, 400, 4)) and all((s.start, s.end) == (5, 7) for s in spans)
    assert all(0 <= g.score <= 1 for g in toxicity.score_documents(docs, model).collect())
    blank = toxicity.learn(none, labels.limit(0))
    assert toxicity.score_documents(none, blank).count() == 0 and toxicity.score_documents(docs, blank).count() == docs.count()


def test_topk(spark, rng):
    vectors = [(i, [float(x) for x in rng.integers(-8, 9, 6) / 16]) for i in range(150)] + [(i, [0.25] * 6) for i in range(150, 190)]
    odd = [(200, None), (201, [None] + [1.0] * 5), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (0, vectors[0][1]), (204, [0.5])]
    twice = [*vectors[1:30:2], *vectors[40:44] * 25]  # copies take a rank each
    got = topk.search(spark.createDataFrame(vectors + odd + twice, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")), F.col("vec_id") % 20 == 0, 20, 64.0).collect()
    whole = {i: np.floor(64 * np.array(v)) for i, v in [*vectors, (204, [0.5, 0, 0, 0, 0, 0])]}
    want = set()
    ids = [*whole, 0, *(i for i, _ in twice)]
    for q in range(0, 190, 20):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in ids if i != q)[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(order)}
    assert {tuple(g) for g in got} == want and len(got) == len(want)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, 64.0).count() == 0


def spelt(leaves: Counter, history: bytes, byte: int) -> float:
    """PPM as defined, one byte at a time."""
    tables = {ppm.ORDER: leaves}
    for order in range(ppm.ORDER - 1, -1, -1):
        tables[order] = Counter({k: 1 for k in set()})
        for context, b in tables[order + 1]:
            tables[order][(context[1:], b)] += 1
    out, gone = 0.0, set()
    for order in range(ppm.ORDER, -1, -1):
        context = history[ppm.ORDER - order :]
        seen = {b: n for (c, b), n in tables[order].items() if c == context and b not in gone}
        if not seen:
            continue
        if byte in seen:
            return out + math.log10((seen[byte] - 0.5) / sum(seen.values()))
        out += math.log10(0.5 * len(seen) / sum(seen.values()))
        gone |= set(seen)
    return out - math.log10(256 - len({b for _, b in tables[0]}))


def running_steps(text: str | None) -> list[tuple[bytes, int]]:
    line = b"\0" * (ppm.ORDER - 1) + b" " + b"".join(w + b" " for w in WORD.findall(raw(text).translate(LOW))) + b"\n"
    return [(line[i : i + ppm.ORDER], line[i + ppm.ORDER]) for i in range(len(line) - ppm.ORDER)]


def test_ppm(docs, none, rows, monkeypatch):
    """One model of all training texts, whatever the units and parts."""
    training = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    tokens = lambda r: [*WORD.findall(raw(r[1]).translate(LOW)), b"\n"]
    count = Counter(w for r in training for w in tokens(r))
    n, v = sum(count.values()), len(count)
    leaves = Counter(s for r in training for s in running_steps(r[1]))
    short = [r for r in rows if len(raw(r[1])) < 60]
    want = {r[0]: sum(spelt(leaves, *s) for s in running_steps(r[1])) for r in short}
    for frequent, unit, part in ((ppm.FREQUENT, ppm.UNIT_BYTES, ppm.PART_BYTES), (5, 500, 2000)):
        monkeypatch.setattr(ppm, "FREQUENT", frequent)
        monkeypatch.setattr(ppm, "UNIT_BYTES", unit)
        monkeypatch.setattr(ppm, "PART_BYTES", part)
        found = ppm.score_documents(docs).collect()
        assert len(found) == len(rows)
        got = {g.doc_id: g for g in found}
        for r in rows:
            g, t = got[r[0]], tokens(r)
            assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
            assert g.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        for r in short:
            assert got[r[0]].score == pytest.approx(want[r[0]], rel=1e-5)
    assert ppm.score_documents(none).count() == 0


def test_registered_scoring_sees_word_order(spark, rng, tmp_path):
    """A shuffled training text costs more than a running one."""
    line = "the cat sat on the mat and then the dog ran to the old house by the sea".split()
    texts = [" ".join(line * 6) for _ in range(60)]
    shuffled, clean = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    texts[shuffled] = " ".join(rng.permutation(line * 6))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g for g in queries.op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[shuffled].base_score == pytest.approx(got[clean].base_score)
    assert got[shuffled].score < got[clean].score - 20


def test_registered_scoring_tells_noise_from_text(spark, rng, tmp_path):
    """A held-out text of noise costs more than a clean one of as many words, and a held-out copy of a training text less."""
    line = "the cat sat on the mat and then the dog ran to the old house by the sea".split()
    texts = [" ".join(rng.permutation(line * 6)) for _ in range(60)]
    noise, clean, copy = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    texts[copy] = texts[next(i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1)]
    texts[noise] = " ".join("".join(rng.choice(list("qxzjkvw"), 3)) for _ in range(6 * len(line)))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g for g in queries.op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[noise].n_tokens == got[clean].n_tokens
    assert got[noise].score < got[clean].score - 100 and got[clean].score < got[copy].score - 5


def test_ids_of_parts_are_those_of_the_text():
    """Words that skip the tokenizer's own splitting get its ids, whatever stands around them."""
    import random

    ids, dice = packing._Ids(queries.tokenizer_path()), random.Random(3)
    signs = [*"abzAZ019 .,;:!?'<>|#\t\n\x0b\x00\x1c\x85éÉÿÀ×÷İŉǰßΣςσ́̇\xa0　漢字йЙ😀½²ªº\xad", "<|endoftext|>", "<|startoftext|>", "'s", "'ll"]
    for _ in range(5000):
        text = "".join(dice.choice(signs) for _ in range(dice.randint(1, 14)))
        assert ids.of(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
