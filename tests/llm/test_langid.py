import numpy as np
from pyspark.sql import functions as F

from loomsight.llm import langid as g

SETS = {"en": "the cat sat on the mat and they were there with that", "de": "der hund und die katze sind nicht auf dem tisch", "fr": "le chat est sur la table et les enfants sont là"}


def docs(spark, n=120):
    rows = []
    for k in range(n):
        lang = sorted(SETS)[k % 3]
        w = SETS[lang].split()
        rows.append((k, " ".join(w[(k * 7 + j * (k % 5 + 1)) % len(w)] for j in range(30)), lang if k % 11 else None, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_probabilities_sum_to_one():
    texts = ["abracadabra bra", "cab dab"]
    key, bounds, has = g.runs(texts)
    kinds, n = np.unique(key, return_counts=True)
    letters = np.unique(kinds & np.uint64(0xFFFF))
    m = g.Model(kinds, n, len(letters))
    for context in {int(k) >> 16 for k in kinds} | {0x0041_0042_0043}:
        total = np.exp(m.log_p(np.array([context << 16 | int(c) for c in letters], np.uint64))).sum()
        assert abs(total - 1) < 1e-9
    assert bounds[-1] == len(key) and has.all()


def test_kneser_ney_by_hand():
    # unigram share of "b" counts the contexts it follows, not its occurrences
    key, _, _ = g.runs(["ab ab ab cb"])
    kinds, n = np.unique(key, return_counts=True)
    m = g.Model(kinds, n, 5)
    share = dict(zip(m.share[3][0].tolist(), m.share[3][1].tolist()))
    two = m.share[2][0].tolist()
    assert len([k for k in two if k & 0xFFFF == ord("b")]) == 2 and share[ord("b")] > share[ord("c")]


def test_runs_do_not_cross_texts():
    alone = [g.runs([t])[0].tolist() for t in ("One", "two 3", "", None)]
    key, bounds, has = g.runs(["One", "two 3", "", None])
    assert [key[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == alone and has.tolist() == [True, True, False, False]


def test_held_out_accuracy_and_odd_rows(spark):
    d = docs(spark)
    fitted = g.fit(d)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "", None, "x"), (3, "12 34 !!", None, "x"), (4, "ΩΩΩ ЖЖЖ " * 30, None, "x"), (5, "the", None, "x")], d.schema)
    got = {r.doc_id: r for r in g.identify(odd, fitted).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and not got[4].accepted and got[5].lang_pred == "en" and got[5].accepted
    seen = g.identify(d, fitted).withColumn("out", g.held_out(F.col("doc_id"))).collect()
    out = [r for r in seen if r.out and r.lang]
    assert len(out) > 15 and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in out) and all(r.accepted for r in seen)
    assert g.identify(d.limit(0), fitted).count() == 0 and g.identify(odd, g.fit(d.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_bounded_model(spark):
    d = docs(spark)
    small = g.fit(d, most_runs=60)
    assert sum(len(m.share[0][0]) for m in small.models) <= 60


def kneser_ney(texts):
    """Plain counting: the probability of a letter after three others, by dictionaries."""
    from collections import Counter, defaultdict

    level = Counter()
    for t in texts:
        code = ["^", "^"] + list(" " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " ")
        if code[2:] == [" ", " "]:
            code = ["^", "^", " "]
        level.update(tuple(code[i : i + 4]) for i in range(len(code) - 3))
    letters = {k[-1] for k in level}
    orders = []
    for _ in range(4):
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for k, v in level.items():
            total[k[:-1]] += v
            kinds[k[:-1]] += 1
        orders.append((dict(level), d, total, kinds))
        level = Counter(k[1:] for k in level)

    def p(run, k=0):
        if k == 4:
            return 1 / (len(letters) + 1)
        counts, d, total, kinds = orders[k]
        if not total.get(run[:-1]):
            return p(run[1:], k + 1)
        return max(counts.get(run, 0) - d, 0) / total[run[:-1]] + d * kinds[run[:-1]] / total[run[:-1]] * p(run[1:], k + 1)

    return p


def test_against_plain_kneser_ney():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdé  "), rng.integers(1, 40))) for _ in range(60)]
    texts += texts[:5]  # repeated rows count each
    key, _, _ = g.runs(texts)
    kinds, n = np.unique(key, return_counts=True)
    m = g.Model(kinds, n, len(np.unique(kinds & np.uint64(0xFFFF))) + 1)
    p = kneser_ney(texts)
    asked = [tuple(rng.choice(list("abcdéx "), 4)) for _ in range(500)] + [("^", "^", " ", "a"), ("^", " ", "b", "c")]
    codes = np.array([sum((1 if c == "^" else ord(c)) << 16 * (3 - i) for i, c in enumerate(r)) for r in asked], np.uint64)
    assert np.allclose(np.exp(m.log_p(codes)), [p(r) for r in asked], rtol=1e-12)


def test_tables_agree_with_arrays(spark):
    d = docs(spark).union(docs(spark, 9))
    arrays, tables = g.fit(d), g.fit(d, broadcast_runs=10)
    assert isinstance(tables, g.Tables) and tables.names == arrays.names and np.allclose(tables.limits, arrays.limits)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "", None, "x"), (3, "12 34 !!", None, "x"), (4, "ΩΩΩ ЖЖЖ " * 30, None, "x"), (5, "the", None, "x")], d.schema)
    both = d.union(odd)
    a, b = (sorted(g.identify(both, m).collect(), key=lambda r: (r.doc_id, r.text or "")) for m in (arrays, tables))
    assert len(a) == len(b) == 134
    for x, y in zip(a, b):
        assert (x.doc_id, x.lang_pred, x.accepted) == (y.doc_id, y.lang_pred, y.accepted) and abs(x.score - y.score) < 1e-9
        assert (x.entropy is None) == (y.entropy is None) and (x.entropy is None or abs(x.entropy - y.entropy) < 1e-9)


def test_limits_of_languages_with_few_documents(spark):
    rows = [(k, "the cat sat on the mat and they were there with that dog " * 2, "en") for k in range(60)] + [(100 + k, "le chat est sur la table et les enfants sont là " * 2, "fr") for k in range(8)]
    m = g.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.names == ["en", "fr"] and np.isfinite(m.limits).all() and abs(m.limits[1] + np.log(m.models[1].floor)) < 1e-12
    # even a language of few documents turns away what is none of its letters
    odd = spark.createDataFrame([(1, "ΩΩΩ ЖЖЖ ЩЩ " * 30), (2, "le chat est sur la table et les enfants " * 3)], "doc_id long, text string")
    assert {r.doc_id: r.accepted for r in g.identify(odd, m).collect()} == {1: False, 2: True}


def test_ties_and_a_long_text():
    key, _, _ = g.runs(["abc abc"])
    kinds, n = np.unique(key, return_counts=True)
    same = g.Identifier(["aa", "bb"], [g.Model(kinds, n, 5), g.Model(kinds, n, 5)], np.array([9.0, 9.0]))
    assert [x[0] for x in same.predict(["abc", "zzz"])] == ["aa", "aa"]
    (lang, score, _, h), = same.predict(["abc " * 700_000])
    assert lang == "aa" and abs(score - 0.5) < 1e-12 and np.isfinite(h)
