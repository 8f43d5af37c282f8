import random
import re
from collections import Counter
from math import log2, sqrt

import numpy as np

from loomsight.llm import divergence as d

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def rows(seed=1):
    rnd = random.Random(seed)
    w = ["the", "of", "Été", "a", "x<", "y|", "z\x1c", "#", "día", "mañana", "in", "to"]
    out = [(k, rnd.choice("ab"), "".join(rnd.choice(w) + rnd.choice([" ", " ", "\n", "\t", "  \n"]) for _ in range(rnd.randint(0, 120)))) for k in range(150)]
    line = "one two three four five six seven eight nine\n"
    return out + [(200, "a", line * 5), (201, None, line + "tail"), (202, "a", None), (203, None, ""), (204, "zz", "\n\n"), (0, out[0][1], out[0][2])]


def test_base_counts(spark):
    r = rows()
    docs = spark.createDataFrame([(a, b, c, 1) for a, b, c in r], "doc_id long, lang string, text string, kept int")
    got = sorted((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in d.measure(docs).collect())
    assert got == sorted((a, *base(c)) for a, _, c in r)
    assert all(not x.kept for x in d.measure(docs).filter("base_failed").collect())
    assert d.measure(docs.limit(0)).count() == 0


def test_distance():
    p, q = np.array([0.5, 0.5, 0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    want = sqrt(sum(a * log2(a / b) for x in (p, q) for a, b in zip(x, m) if a) / 2)
    assert abs(d.distance(p, q) - want) < 1e-12 and d.distance(p, p) == 0 and d.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_references_and_verdict(spark):
    rnd = random.Random(2)
    words = {"a": ["the", "of", "and", "cat", "dog"], "b": ["der", "die", "und", "hund", "tag"]}
    text = lambda k: " ".join(rnd.choice(words[k]) for _ in range(80)) + "."
    r = [(k, "ab"[k % 2], text("ab"[k % 2])) for k in range(100)] + [(900, "a", " ".join(f"{w}%%%" for w in text("a").split())), (901, "a", text("b"))]
    docs = spark.createDataFrame(r, "doc_id long, lang string, text string")
    refs = d.references(docs)
    counts = Counter(w.lower() for _, k, t in r if k == "b" for w in t.split())
    assert refs["b"].n_words == sum(counts.values()) and abs(refs["b"].shares.sum() - 1) < 1e-9
    assert sorted(refs["b"].shares, reverse=True)[0] == max(counts.values()) / sum(counts.values())
    verdict = {x.doc_id: x.kept for x in d.measure(docs, refs).collect()}
    assert [k for k, v in verdict.items() if not v and not base(dict((a, c) for a, _, c in r)[k])[-1]] == [900, 901]


def test_many_languages_by_broadcast_and_by_join(spark, monkeypatch):
    rnd = random.Random(5)
    words = {k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "xyzuvw"] for k in range(260)}
    text = lambda k: " ".join(rnd.choice(words[k]) for _ in range(180))
    r = [(k, f"l{k % 260}", text(k % 260)) for k in range(260 * 12)] + [(9000 + k, f"l{k}", text((k + 1) % 260)) for k in range(255, 260)] + [(9900, None, text(7)), (9901, "once", text(7))]
    docs = spark.createDataFrame(r, "doc_id long, lang string, text string").repartition(3)
    near = {x.doc_id: x for x in d.measure(docs).collect()}
    assert len(near) == len(r) and all(near[k].kept for k in range(260 * 12))
    assert not any(near[9000 + k].kept for k in range(255, 260))  # languages beyond any fixed number have their own reference
    monkeypatch.setattr(d, "BROADCAST_LANGS", 10)
    far = {x.doc_id: x for x in d.measure(docs).collect()}
    assert all(tuple(near[k]) == tuple(far[k]) for k in near)
