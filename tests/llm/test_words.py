"""Spelling variants, token counts and periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from test_operators import DOCS, WORD, corpus, raw

from lumengraph.llm import periodic_runs, queries, spelling, token_counts
from lumengraph.llm.kernel import slices


@pytest.fixture(scope="module")
def rows(rng):
    rows = corpus(rng)
    letters = "abcdé"
    rand = random.Random(11)
    base = ["".join(rand.choice(letters) for _ in range(rand.randint(4, 9))) for _ in range(60)]
    near = [w[: (i := rand.randrange(len(w)))] + rand.choice(letters) + w[i + rand.randint(0, 1) :] for w in base * 3]
    extra = [" ".join(rand.choices(base, k=200) + rand.choices(near, k=120)) for _ in range(40)]
    extra += ["Don't we'll 'RE they've it's 'r 'v x'll'd", "a  b \n\n\n c 　 \t", "tail  ", "\n\n", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|x"]
    extra += ["½ 3٣ ४५ 中文字 한국어 😀😀 \U00010940Ᲊ²x", "x" * 5000 + "y", "ab " * 2000, " ".join(["u v w"] * 9), " ".join("abcabd" * 5)]
    extra += [" ".join(rand.choices("ab", k=600)), " ".join(str(i) for i in range(40)) * 4, "word " * 23 + "word"]
    extra += [" ".join(w for i, w in enumerate(["zzzza", "zzzzb", "zzzbb", "zzbbb"]) for _ in range(3 * 3**i))]  # a chain of forms
    return [*rows, *[(1000 + i, t, "en", "s", "s", "k", "t", "c", "l") for i, t in enumerate(extra)]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows) -> list[tuple]:
    n: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w for w in n if len(w) >= 5 and n[w] >= 3}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("shard", [spelling.SHARD, 40])
def test_spelling(docs, none, rows, shard):
    """Shards of a few words make keys that have several."""
    want = variants(rows)
    assert sum(w[1] is not None for w in want) > 10 and sum(w[2] != w[1] is not None for w in want) > 0
    got = spelling.spelling_variants(docs, shard=shard).collect()
    assert sorted((g.word, g.form, g.root, g.n, g.n_near, g.form_n) for g in got) == want
    if shard == 40:
        assert spelling.spelling_variants(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_near_words(seed):
    rand = random.Random(seed)
    for _ in range(40):
        letters = "abcé"[: rand.randint(1, 4)]
        words = sorted({"".join(rand.choice(letters) for _ in range(rand.randint(1, 8))) for _ in range(rand.randint(1, 50))})
        every = np.arange(len(words))
        got = sorted(zip(*(x.tolist() for x in spelling.near_words(words, every, every)), strict=True))
        assert got == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a != b and one_edit(a, b)]


def test_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("w21", None), ("x", "w7")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w21" for i in range(21)}, "x": "w21"}


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def test_tokens(docs, none, rows, tokenizer):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    want = [(r[0], len(raw(r[1])), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    got = token_counts.count_tokens(docs, path).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((g.doc_id, g.n_bytes, g.n_tokens) for g in got), key=key) == sorted(want, key=key)
    assert all(g.over_limit == (g.n_tokens > 1024) for g in got) and any(g.over_limit for g in got)
    assert token_counts.count_tokens(none, path).count() == 0


def test_transducers(tokenizer):
    """Random texts of awkward symbols, a text above a slice, and a counter that starts anew all the time."""
    import pyarrow as pa

    merges, special = token_counts.vocabulary(queries.tokenizer_path("byte_bpe_50k.json"))
    own = token_counts.Transducers(merges, special, token_counts.code_point_classes(tokenizer))
    rand = random.Random(3)
    awkward = [*" \n\t'stmdrevlaxyz019!?-é中 　\U00010940Ᲊ😀\x85", "<|endoftext|>", "<|"]
    texts = ["".join(rand.choices(awkward, k=rand.randint(0, 200))) for _ in range(1500)]
    texts += [" ".join(rand.choices(["the", "naïve", "x9", "--", "don't"], k=400_000)), "z" * 300_000, "ab" * 9000 + "c"]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    count = lambda: [int(n) for _, _, data, bounds in slices(pa.array(texts), token_counts.SLICE) for n in own.counts(data, bounds)]
    assert count() == want
    own.counter.most = 10
    assert count() == want


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def described(doc_id, text) -> tuple:
    words = WORD.findall(raw(text))
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *shown, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_runs(docs, none, rows):
    got = [tuple(g) for g in periodic_runs.periodic_runs(docs).collect()]
    key = lambda x: tuple(map(str, x))
    want = [described(r[0], r[1]) for r in rows]
    assert sum(w[1] > 0 for w in want) > 5
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic_runs.periodic_runs(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_find_runs(seed):
    rand = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rand.randint(1, 5)):
            words = [rand.randrange(rand.choice([1, 2, 3, 30])) for _ in range(rand.randint(0, 300))]
            for _ in range(rand.randint(0, 3) if len(words) > 10 else 0):
                a = rand.randrange(len(words))
                p = rand.randint(1, max(1, (len(words) - a) // 3))
                for i in range(a, min(len(words), a + p * rand.randint(2, 9))):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        number: dict = {}
        ids = np.array([number.setdefault((i, w), len(number)) for i, words in enumerate(texts) for w in words], np.int64)
        first = np.cumsum([0, *map(len, texts)])
        start, end, q = periodic_runs.find_runs(ids, np.repeat(np.arange(len(texts)), np.diff(first)), first)
        for i, words in enumerate(texts):
            own = (start >= first[i]) & (start < first[i + 1])
            got = list(zip((start[own] - first[i]).tolist(), (end - start)[own].tolist(), q[own].tolist(), strict=True))
            assert got == brute_runs(words)


def test_long_text():
    """A text above a slice, periodic as a whole but for one word."""
    words = [f"w{i % 97}" for i in range(400_000)]
    words[250_000] = "other"
    text = " ".join(words).encode()
    assert len(text) > periodic_runs.SLICE
    (row,) = periodic_runs.describe_slice(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert row[:5] == (2, 0, 250_000, 97, 1000 * 250_000 // 97)
    assert row[-1] == hashlib.sha256(" ".join([*words[:97], "other", *words[250_001 : 250_001 + 97]]).encode()).hexdigest()
