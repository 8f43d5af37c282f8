import math
import re
from collections import Counter

import numpy as np
import pytest

from loomsight.llm import lexical

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """The contract, document by document."""
    have = [(d, Counter(low(t))) for d, t in docs]
    have = [(d, c) for d, c in have if c]
    n, length = len(have), sum(c.total() for _, c in have)
    df = Counter(t for _, c in have for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(low(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, c in have:
            m = 25 + (75 * c.total() * n) // length
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in words.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, shard=lexical.SHARD, block=lexical.BLOCK):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, term string, rank int").repartition(3)
    q = spark.createDataFrame([(a, b, 7) for a, b in items], "item_id long, text string, score long")
    size = lexical.sizes(d)
    got = lexical.search(spark, lexical.index(d, size, shard, block), size[0], q)
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["Éa", "漢字", "Ab", "x9"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(int(k), " ".join(rng.choice(words, int(rng.integers(0, 90)), p=p / p.sum()))) for k in rng.permutation(n)]
    items = [(k, ", ".join(rng.choice(words, int(rng.integers(1, 12))))) for k in range(12)]
    return docs, items


@pytest.mark.parametrize("shard,block", [(1 << 20, 128), (700, 4), (1, 1)])
def test_against_every_document(spark, shard, block):
    docs, items = corpus()
    if shard == 1:
        docs = docs[:60]
    assert run(spark, docs, items, shard=shard, block=block) == plain(docs, items)


def test_parts_and_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART", 2)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    docs, items = corpus(200, 2)
    assert run(spark, docs, items, shard=300, block=8) == plain(docs, items)


def test_edges(spark):
    long = "very long " * 300_000
    docs = [(1, None), (2, ""), (3, "--- !"), (None, "same words here"), (5, "same words here"), (4, "same words here"), (4, "same words here"), (6, long), (7, "a\0b A\x7fB c_d"), (8, "ÀÉ é")]
    items = [(1, "same words"), (1, "here"), (2, None), (3, "nowhere"), (None, "long b d"), (4, "ÀÉ"), (5, "àé")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, "!")], items) == []


def test_numbers_as_bytes():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) + 5, 3])
    raw, end = lexical.packed(values)
    assert lexical.unpacked(raw).tolist() == values.tolist() and end[-1] == len(raw)


def test_blocks_below_the_bound_stay_closed():
    n, block = 4096, 64
    m = np.full(n, 100)
    times = np.ones(n, np.int64)
    times[1000] = 50
    at = np.arange(0, n, block)
    step = np.diff(np.arange(n), prepend=0)
    step[at] = 0
    raw, end = lexical.packed(np.stack([step, times], 1).ravel())
    top = np.maximum.reduceat(lexical.impact(times, m), at)
    x = lexical.Postings(at, at + block - 1, top, end[2 * (at + block) - 1], raw.tobytes(), m)
    doc, score = lexical.best([x], [3], n, 1)
    assert doc.tolist() == [1000] and score[0] == 3 * top.max() and len(x.seen) <= lexical.FIRST
