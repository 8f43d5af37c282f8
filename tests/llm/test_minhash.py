import random
import re
from itertools import combinations

import numpy as np
import pytest

from loomsight.llm import minhash as m
from loomsight.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def corpus(seed, groups=12, largest=40):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}É" if k % 9 == 0 else f"w{k}" for k in range(3000)]
    rows, d = [], 0
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 12, 80, 200]))]
        for _ in range(rnd.randint(1, largest)):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((d * 3 % 1009, rnd.choice([" ", "\t", "\n ", " "]).join(text).replace("w1", "W1")))
            d += 1
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b \x1c"), (5004, "a b \x1c")]


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_against_brute_force(spark, seed, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, sig string")
    got = sorted(map(tuple, m.near_duplicates(docs, percent).collect()))
    assert got == brute(rows, percent)


def test_hub_whose_copies_are_not_linked_to_each_other(spark):
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = [(700, " ".join(base))]
    for k in range(300):
        text = list(base)
        for i in rnd.sample(range(5, 145), 2):
            text[i] = f"x{k}-{i}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.near_duplicates(docs, 85).collect())) == brute(rows, 85)


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, m.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True), (None, 1, None, True)], key=str)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 9), (9, 7), (7, 7), (3, 2), (2, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 161)}, 1: 1, 9: 1, 7: 1, 3: 2, 2: 2}


def test_crowded_regions_lose_no_pair(spark, monkeypatch):
    # signatures that have about two thirds of their values from one boilerplate; planted pairs share whole prefixes of
    # it alone: every place with values of their own begins with one that differs
    monkeypatch.setattr(m, "REGION", 32)
    monkeypatch.setattr(m, "OVERLAP", 4)
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 16, m.HASHES)
    sig = np.where(rng.random((3000, m.HASHES)) < 0.65, common, rng.integers(0, 1 << 16, (3000, m.HASHES)))
    for a in range(0, 60, 2):
        own = rng.permutation(m.HASHES // m.DEPTH)
        sig[a] = common
        for place in own[:18]:
            sig[a, place * 4 : place * 4 + 4] = rng.integers(0, 1 << 16, 4)
        sig[a + 1] = sig[a]
        sig[a + 1, own[:18] * 4] = rng.integers(0, 1 << 16, 18)
    order = rng.permutation(3000)
    reps = spark.createDataFrame([(int(order[k]), bytearray(s.astype(">u2").tobytes())) for k, s in enumerate(sig)], "rep long, sig binary")
    root = dict(map(tuple, components(m.forest_edges(reps)).collect()))
    assert [a for a in range(0, 60, 2) if root.get(int(order[a]), -1) != root.get(int(order[a + 1]), -2)] == []
    assert len(root) < 100


def test_agreement_follows_the_limit(spark):
    assert [m.agreement(p) for p in (80, 85, 100)] == [81, 90, 128]
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 1 << 16, (2, m.HASHES))
    sig[1, :85] = sig[0, :85]
    reps = spark.createDataFrame([(k, bytearray(s.astype(">u2").tobytes())) for k, s in enumerate(sig)], "rep long, sig binary")
    assert [m.forest_edges(reps, p).count() for p in (80, 85)] == [1, 0]


def test_components_by_rounds_and_at_once(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1080)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, two = (sorted(map(tuple, components(df, at_once=n).collect())) for n in (10_000, 0))
    assert one == two and dict(one)[1080] == 1000
    assert components(df.limit(0)).count() == 0
