"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (poor) and 2 (good). One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score: P(grade <= k) = logistic(threshold_k - score). The result is the expected grade and the tail
probability P(grade >= SELECT), by which documents are selected.

Weights are zero or below: a feature can be evidence of a fault, none makes up for one, and a short text without faults
is as good as a long one. Features are the presence of hashed lower-case words and shares of word shapes. The model is fitted on the driver on at
most about ``MOST_FIT`` labelled documents, drawn by hash of their id; it has ``BUCKETS`` weights whatever the corpus.

Defined results: null or empty text has no features and gets the thresholds' own probabilities; rows without a label, or
with a null quality and no toxicity, are not learned from; several labels of one document count each; a null ``doc_id``
has no label; without any labels the model keeps everything; repeated rows agree; other columns stay; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.llm.common import LOWER, chunks, pick, prefix_hash, span_hash, table, words

BUCKETS, GRADES, SELECT = 1 << 20, 3, 2
#: Bytes of the beginnings of words that are features too.
BEGIN = 5
#: Bound of the sample the model is fitted on.
MOST_FIT = 8000
#: Rounds of choosing features and of fitting those chosen, the penalty that chooses and the one that stays, and documents a feature needs.
CHOOSE, REFIT, SPARSE, RIDGE, LEAST_DOCS = 100, 300, 3e-3, 1e-5, 12

_UP = np.zeros(256, bool)
_UP[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&|<>!^~=+@{}[]\\"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Shape features: shares of words without lower-case letters, with signs, with digits, of very long ones, and that repeat the word before.
SHAPES = 5
SCALE = 8.0


def features(batches):
    """Per row of a table with ``text``: the rows of a block, and for each of its rows buckets and values."""
    for rows, data, offsets in chunks(batches, "text"):
        start, end, bounds = words(data, offsets)
        low = LOWER[data]
        h = span_hash(prefix_hash(low), start, end)
        bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64) + SHAPES
        total = lambda m: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(m)]))
        up, sign, digit, small = total(_UP[data]), total(_SIGN[data]), total(_DIGIT[data]), total((data >= 97) & (data < 123))
        # signs at a word's end hide the word itself: its stem is a feature too
        stem = end - np.minimum(end - start - 1, total(_SIGN[data] | np.isin(data, [44, 46, 58, 59, 63])))
        bare = (span_hash(prefix_hash(low), start, stem) & np.uint64(BUCKETS - 1)).astype(np.int64) + SHAPES
        begin = span_hash(prefix_hash(low), start, np.minimum(start + BEGIN, stem)) ^ np.uint64(BEGIN)
        begin = (begin & np.uint64(BUCKETS - 1)).astype(np.int64) + SHAPES
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = max(1, int(b - a))
            known = np.unique(np.concatenate([bucket[a:b], bare[a:b], begin[a:b]]))
            shape = np.array([((up[a:b] > 1) & (small[a:b] == 0)).sum(), (sign[a:b] > 0).sum(), (digit[a:b] > 0).sum(), ((end - start)[a:b] > 40).sum(), (h[a + 1 : b] == h[a : b - 1]).sum()]) / n if b > a else np.zeros(SHAPES)
            out.append((np.concatenate([np.arange(SHAPES), known]), np.concatenate([shape * SCALE, np.ones(len(known))])))
        yield rows, out


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + SHAPES))
    cuts: np.ndarray = field(default_factory=lambda: np.array([-20.0, -19.0]))

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1), axis=1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray) -> Model:
    """Maximum likelihood with a penalty on absolute weights, by adaptive proximal steps, then without it on the
    features that kept a weight; rare grades weigh more.

    Thresholds are the first one and the logarithms of the gaps, so they stay in order.
    """
    if not len(rows):
        return Model()
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    # buckets of a few documents say nothing general
    seen = np.bincount(index, minlength=BUCKETS + SHAPES)
    use = (seen[index] >= LEAST_DOCS) | (index < SHAPES)
    known, index = np.unique(index[use], return_inverse=True)
    value, row = value[use], row[use]
    n = np.bincount(grade, minlength=GRADES)
    weight = (len(grade) / (GRADES * np.maximum(n, 1)))[grade] ** 0.5
    share = np.cumsum(np.bincount(grade, weight, GRADES))[:-1] / weight.sum()
    share = np.clip(share, 0.01, 0.99)
    first = np.log(share / (1 - share))
    m = Model(np.zeros(len(known)), np.maximum.accumulate(first + np.arange(len(first)) * 1e-3))
    free = np.concatenate([[m.cuts[0]], np.log(np.diff(m.cuts))])
    g2w, g2c = np.full(len(m.weights), 1e-8), np.full(len(free), 1e-8)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for k in range(CHOOSE + REFIT):
        if k == CHOOSE:
            use = m.weights[index] != 0
            index, value, row = index[use], value[use], row[use]
            g2w, g2c = np.full(len(m.weights), 1e-8), np.full(len(free), 1e-8)
        m.cuts = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
        score = np.bincount(row, value * m.weights[index], len(rows))
        edge = np.concatenate([[-np.inf], m.cuts, [np.inf]])
        hi, lo = logistic(edge[grade + 1] - score), logistic(edge[grade] - score)
        hi, lo = np.where(grade == GRADES - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        dscore = dhi - dlo  # of minus log likelihood
        dw = np.bincount(index, value * dscore[row], len(m.weights)) / len(rows)
        dcut = np.array([(-(dhi * (grade == c)) + dlo * (grade == c + 1)).sum() for c in range(GRADES - 1)]) / len(rows)
        dfree = np.concatenate([[dcut.sum()], np.cumsum(dcut[::-1])[::-1][1:] * np.exp(free[1:])])
        g2w, g2c = g2w + dw * dw, g2c + dfree * dfree
        step = 0.3 / np.sqrt(g2w)
        moved = m.weights - step * dw
        m.weights = np.minimum(moved + step * (SPARSE if k < CHOOSE else RIDGE), 0)
        free -= 0.3 * dfree / np.sqrt(g2c)
    m.cuts = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
    weights = np.zeros(BUCKETS + SHAPES)
    weights[known] = m.weights
    m.weights = weights
    return m


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT) -> Model:
    """Learns from the labelled documents of a hash sample of about ``most``."""
    graded = pick(labels, "doc_id", "quality", "toxic").withColumn("grade", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)).filter("grade is not null and doc_id is not null")
    share = min(1.0, most / max(1, graded.count()))
    some = graded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("doc_id", "grade")
    rows = pick(docs, "doc_id", "text").join(some, "doc_id").select("doc_id", "grade", "text")

    def run(batches):
        for block, found in features(batches):
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in found]), pa.array([v.astype("<f4").tobytes() for _, v in found])], ["doc_id", "grade", "i", "v"])

    got = rows.mapInArrow(run, "doc_id long, grade int, i binary, v binary").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    pairs = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for i, v in zip(got["i"].to_pylist(), got["v"].to_pylist())]
    return train(pairs, got["grade"].to_numpy().astype(np.int64))


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_select`` and ``kept``."""
    new = ["expected_grade", "p_select", "kept"]
    docs = pick(docs, *[c for c in docs.columns if c not in new])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for block, found in features(batches):
            p = m.grades(np.array([float((m.weights[i] * v).sum()) for i, v in found]))
            tail = p[:, SELECT:].sum(1)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(p @ np.arange(GRADES)), pa.array(tail), pa.array(tail >= 0.5)], [*block.schema.names, *new])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "expected_grade double, p_select double, kept boolean"])
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rate(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
