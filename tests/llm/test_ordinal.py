import random

import numpy as np

from loomsight.llm import ordinal as o


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 60))]
        kind = k % 3
        if kind == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["nasty", "vile", "Nasty!!"]))
        if kind == 1:
            words = [w.upper() + "##" for w in words]
        docs.append((k, " ".join(words), "x"))
        labels.append((k, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return docs, labels


def test_held_out_grades(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    lab = spark.createDataFrame([x for x in labels if x[0] < 400] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    m = o.fit(d, lab)
    assert (np.diff(m.cuts) > 0).all()
    new = [r for r in o.rate(d, m).collect() if r.doc_id >= 400]
    right = sum(r.kept == (r.doc_id % 3 == 2) for r in new)
    assert right >= 0.97 * len(new)
    mean = [np.mean([r.expected_grade for r in new if r.doc_id % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and all(0 <= r.p_select <= 1 and 0 <= r.expected_grade <= 2 for r in new)


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 5000, "x"), (None, "z", "x"), (1, None, "x")], "doc_id long, text string, p_select string")
    m = o.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = o.rate(d, m).collect()
    assert len(got) == 5 and all(r.kept for r in got)
    assert o.rate(d.limit(0), m).count() == 0


def test_likelihood_is_the_models_own():
    m = o.Model(cuts=np.array([-1.0, 0.5]))
    p = m.grades(np.array([0.0, 3.0]))
    assert np.allclose(p.sum(1), 1) and np.allclose(p[0], [1 / (1 + np.e), 1 / (1 + np.exp(-0.5)) - 1 / (1 + np.e), 1 - 1 / (1 + np.exp(-0.5))])
