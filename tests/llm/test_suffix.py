import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomsight.llm import suffix as s


def brute(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[i : i + s.LENGTH] for _, r in raws for i in range(len(r) - s.LENGTH + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - s.LENGTH + 1):
            if seen[r[i : i + s.LENGTH]] > 1:
                gone[i : i + s.LENGTH] = b"\1" * s.LENGTH
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.choice([30, 45, 60, 90])) for _ in range(8)]
    rows = [(k, text(rnd.randint(1, 120))) for k in range(40)]
    for k in range(40, 120):
        rows.append((k, " ".join([text(rnd.randint(0, 60)), rnd.choice(shared)[rnd.randint(0, 40) :], text(rnd.randint(0, 60)), *rnd.choices(shared, k=rnd.randint(0, 2))])))
    rows += [(500 + k, rows[k % 3][1]) for k in range(9)]
    rows += [(600, "a" * 700), (601, "ab" * 150 + "c"), (602, "ab" * 150), (603, None), (604, ""), (605, "x" * 200), (606, "x" * 199), (607, "é" * 130)]
    return rows + [rows[50], (rows[51][0], rows[52][1])]


@pytest.mark.parametrize("crowd", [200, 2])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(s, "CROWD", crowd)
    rows = corpus(crowd)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, h int")
    assert sorted(map(tuple, s.digests(docs).collect()), key=str) == brute(rows)


def test_column_bwt_orders_suffixes():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(5, 30))) for _ in range(60)]
    place = np.array([rnd.randint(0, len(x) - 1) for x in strings])
    group = np.sort(np.array([rnd.randint(0, 4) for _ in strings]))
    index = s.ColumnBwt(strings, place, group)
    for q, order, common in index.rounds():
        suffixes = [(group[i], strings[i][place[i] + q :]) for i in order]
        assert suffixes == sorted(suffixes)
        assert sorted(order) == [i for i in range(60) if -place[i] <= q < len(strings[i]) - place[i]]
        for k in range(1, len(order)):
            (ga, a), (gb, b) = suffixes[k - 1 : k + 1]
            n = 0
            while ga == gb and n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert common[k] == n, (q, k)


def test_cut_texts_keep_whole_characters_and_columns(spark):
    passage = "é" * 120
    docs = spark.createDataFrame([(1, "aa" + passage + "b", 7), (2, passage + "ccc", 8), (3, None, 9), (4, "short", None)], "doc_id long, text string, runs int")
    assert sorted(map(tuple, s.without_repeats(docs).collect())) == [(1, "aab", 7), (2, "ccc", 8), (3, None, 9), (4, "short", None)]
    assert s.without_repeats(docs.limit(0)).count() == 0
