import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomsight.llm import suffixtree as st

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, shared=st.SHARED):
    """The model by dicts, document by document."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in docs]
    texts = [low(t) for _, t in docs]
    counts = Counter(w for t, h in zip(texts, held) if not h for w in t)
    n_docs = held.count(False)
    n, v = counts.total() + n_docs, len(counts) + (n_docs > 0)
    own = sorted((w for w in counts if counts[w] >= st.LEAST and len(w.encode()) <= st.LONGEST), key=lambda w: (-counts[w], w.encode()))[:shared]
    symbol = {w: k for k, w in enumerate(own, st.WORDS)}
    rare_n, rare_v = n - n_docs - sum(counts[w] for w in own), max(0, v - len(own) - (n_docs > 0))
    c0 = {st.END: n_docs, st.RARE: rare_n, **{symbol[w]: counts[w] for w in own}}
    root = {s: (c + 0.5) / (n + 0.5 * len(c0)) for s, c in c0.items()}
    lines = [[symbol.get(w, st.RARE) for w in t] + [st.END] for t in texts]
    follow = defaultdict(Counter)
    for line, h in zip(lines, held):
        if not h:
            before = [st.START] * st.DEPTH
            for s in line:
                for k in range(1, st.DEPTH + 1):
                    follow[tuple(before[-k:])][s] += 1
                before.append(s)
    kept, memory = {}, {}

    def chance(context, s):
        if not context:
            return root[s]
        if (context, s) not in memory:
            memory[context, s] = smoothed(context, s, follow[context][s]) if is_kept(context) else chance(context[1:], s)
        return memory[context, s]

    def smoothed(context, s, c):
        have = follow[context]
        return (max(c - st.DISCOUNT, 0) + st.DISCOUNT * len(+have) * chance(context[1:], s)) / have.total()

    def is_kept(context):
        if context not in kept:
            have = +follow[context]
            total, kinds = have.total(), len(have)
            gain = 0.0
            if total > 1:
                for s, c in have.items():
                    suffix = chance(context[1:], s)
                    out = (max(c - 1 - st.DISCOUNT, 0) + st.DISCOUNT * (kinds - (c == 1)) * suffix) / (total - 1)
                    gain += c * math.log(out / suffix)
            kept[context] = total > 1 and gain > st.KEEP
        return kept[context]

    out = []
    for (d, _), words, line, h in zip(docs, texts, lines, held):
        before, score = [st.START] * st.DEPTH, 0.0
        for k, s in enumerate(line):
            score += math.log10(chance(tuple(before[-st.DEPTH :]), s))
            if s == st.RARE:
                score += math.log10((counts[words[k]] + 0.5) / (rare_n + 0.5 * (rare_v + 1)))
            before.append(s)
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in words), n_docs])
        out.append((d, h, len(words) + 1, sum(counts[w] > 0 for w in words) + (n_docs > 0), n, base, score))
    return out, chance, [*c0], sum(kept.values())


def corpus(n=300, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)]
    docs = []
    for d in range(n):
        at, text = int(rng.integers(40)), []
        for _ in range(int(rng.integers(0, 60))):
            at = int((at * 7 + rng.integers(0, 3)) % 40) if rng.random() < 0.8 else int(rng.integers(40))
            text.append(words[at] if rng.random() < 0.95 else f"odd{rng.integers(500)}")
        docs.append((d, " ".join(text)))
    return docs + [(n, "W1 \t w1\n w1 " * 200), (n + 1, None), (n + 2, " "), (n + 3, "unseen unseen words"), (None, "w1 w2"), (5, "w3"), (5, "w3"), (n + 9, "x" * 5000 + " x" * 3)]


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


@pytest.mark.parametrize("hot,bucket,shared", [(1 << 19, 1 << 19, 1 << 19), (40, 200, 1 << 19), (5, 50, 12)])
def test_against_a_model_of_dicts(spark, hot, bucket, shared, monkeypatch):
    monkeypatch.setattr(st, "PACK", 700)
    monkeypatch.setattr(st, "TALLY", 50)
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, row int, word string").repartition(3)
    want, *_, kept = plain(docs, shared)
    compare(st.score(df, shared, hot, bucket).collect(), want)
    assert kept > 20


def test_chances_sum_to_one_and_beat_the_base():
    rows, chance, symbols, _ = plain(corpus())
    for context in [(st.START,) * 3, (5, 6, 7), (7,), (st.RARE, 5)]:
        assert sum(chance(context, s) for s in symbols) == pytest.approx(1, abs=1e-9)
    held = [r for r in rows if r[1] and r[2] > 10]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held) * 0.85


def test_none_and_nothing_learned(spark):
    assert st.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    r = st.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert r.held_out and r.n_tokens == 3 and r.n_known == r.train_tokens == 0 and r.base_score == 0


def test_a_hot_context_is_dealt_over_buckets():
    rng = np.random.default_rng(1)
    keys = [np.full(5000, 7), 7 << st.BITS | rng.integers(3, 100, 5000), np.zeros(5000, np.int64)]
    keys[2] = keys[1] << st.BITS | rng.integers(3, 100, 5000)
    hot = [(np.array([7]), np.array([5000]))]
    bucket = st._bucket(keys, np.arange(5000), hot, 500, 1000)
    assert 5 < len(set(bucket.tolist())) <= 10
    assert set(bucket.tolist()) <= set(st._destinations(hot, 500, 1000).column("bucket").to_pylist())
    for key in set(keys[1].tolist()):
        assert len(set(bucket[keys[1] == key].tolist())) == 1
