"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters and single spaces. The four-letter runs of all training documents are counted per
language; every lower order follows from them as continuation counts. A model is a set of sorted arrays of 64-bit keys
(four 16-bit letters, so the key is its own hash) with discounted shares and back-off weights beside them. A document
gets the language of the lowest cross-entropy per letter. Documents whose best cross-entropy lies beyond a limit are not
accepted. The limit is set from the cross-entropies of all training documents of that language, as a histogram; a
language with fewer than ``FEW`` of them rejects what it predicts worse than letters drawn evenly.

All runs are kept, however many. Up to ``BROADCAST_RUNS`` of them the models are arrays that are sent to the tasks
(``Identifier``); beyond that they stay tables (``Tables``): shares and weights are worked out by aggregates, the
different runs of the documents meet them by joins, and the documents' runs meet the runs' probabilities. Both ways give
the same languages, scores and limits.

Defined results: null text, or text without a letter, is ``und`` with score 0 and is not accepted; without training
documents all is ``und``; equal cross-entropies go to the language that sorts first; rows without a language are not
learned from, and neither are rows whose ``crc32(doc_id as text) mod 4`` is 2; a null ``doc_id`` is not held out; repeated
rows count each; other columns pass unread; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.llm.common import pick, staged, table

ORDER = 4
PAD, SPACE_CODE = 1, 32
#: Runs of all models together up to which they are broadcast: 12 bytes each and as much again for lower orders.
BROADCAST_RUNS = 4_000_000
#: Limit in deviations over the median; letters below which none is rejected; documents below which a language has no
#: spread of its own; bins of a nat in the histogram.
DEVIATIONS, LEAST_LETTERS, FEW, BINS = 8.0, 40, 20, 1024
#: Parts a run's probabilities are repeated for, so that a run of nearly all documents is no single task's.
SALTS = 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to its 16-bit letter: lower case, marks kept, all else a space."""
    out = np.full(0x110000, SPACE_CODE, np.uint16)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = ord(chr(c).lower()[0])
            out[c] = low if low < 0x10000 else max(2, (low ^ (low >> 16) * 0x9E37) & 0xFFFF)
    return out


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.frombuffer(bytes(unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool)


def runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the runs of all texts, where each text's begin (one more entry than texts), and which texts have letters."""
    size = np.array([len(t) if t else 0 for t in texts], np.int64)
    flat = np.frombuffer(("\0\0 " + " \0\0 ".join(t or "" for t in texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size + 4) - size - 4
    code = letters()[flat]
    code[start] = code[start + 1] = PAD
    code[start + 2] = SPACE_CODE
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != SPACE_CODE) | (code[:-1] != SPACE_CODE)
    alpha = np.concatenate([[0], np.cumsum(is_letter()[flat])])
    has = alpha[start + size + 3] > alpha[start + 3]
    at = np.concatenate([[0], np.cumsum(keep)])
    bounds = at[np.append(start, len(code))]
    code = code[keep].astype(np.uint64)
    key = code[:-3] << np.uint64(48) | code[1:-2] << np.uint64(32) | code[2:-1] << np.uint64(16) | code[3:]
    # the last letter of a run is what is predicted: those three from each text's start on have no whole context
    whole = np.ones(len(code), bool)
    for k in range(3):
        whole[bounds[:-1] + k] = False
    number = np.concatenate([[0], np.cumsum(whole)])
    return key[whole[3:]], number[bounds], has


class Model:
    """One language."""

    def __init__(self, key: np.ndarray, count: np.ndarray, letters_known: int):
        self.floor = 1.0 / letters_known
        order = np.argsort(key)
        key, count = key[order], count[order].astype(np.float64)
        self.share, self.rest = [], []
        for k in range(ORDER, 0, -1):
            ones, twos = float((count == 1).sum()), float((count == 2).sum())
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            context = key >> np.uint64(16)
            known, first = np.unique(context, return_index=True)
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.append(first, len(key)))
            self.share.append((key, (count - d) / np.repeat(total, kinds)))
            self.rest.append((known, d * kinds / np.maximum(total, 1)))
            mask = np.uint64((1 << (16 * (k - 1))) - 1)
            key, count = np.unique(key & mask, return_counts=True)
            count = count.astype(np.float64)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, other: float) -> np.ndarray:
        known, value = table
        if not len(known):
            return np.full(len(key), other)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.where(known[at] == key, value[at], other)

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each run's last letter after its first ones."""
        p, weight = np.zeros(len(key)), np.ones(len(key))
        for k in range(ORDER):
            part = key & np.uint64((1 << (16 * (ORDER - k))) - 1)
            p += weight * self._find(self.share[k], part, 0.0)
            weight *= self._find(self.rest[k], part >> np.uint64(16), 1.0)
        return np.log(p + weight * self.floor)


@dataclass
class Identifier:
    """Models by language, in order of their names, and the limits of cross-entropy."""

    names: list[str]
    models: list[Model]
    limits: np.ndarray

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per letter by text and language, the number of runs, and which texts have letters."""
        key, bounds, has = runs(texts)
        n = np.diff(bounds)
        out = np.full((len(texts), len(self.names)), np.inf)
        some = np.flatnonzero(n > 0)
        if len(some):
            kinds, back = np.unique(key, return_inverse=True)
            for k, m in enumerate(self.models):
                out[some, k] = -np.add.reduceat(m.log_p(kinds)[back], bounds[some]) / n[some]
        return out, n, has

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """Language, score, whether it is accepted, and cross-entropy."""
        if not self.names:
            return [(UNKNOWN, 0.0, False, None)] * len(texts)
        h, n, has = self.entropies(texts)
        best = h.argmin(1)
        out = []
        for i, k in enumerate(best):
            if not has[i]:
                out.append((UNKNOWN, 0.0, False, None))
                continue
            score = 1.0 / float(np.exp(-(h[i] - h[i, k]) * min(int(n[i]), 100)).sum())
            out.append((self.names[k], score, bool(n[i] < LEAST_LETTERS or h[i, k] <= self.limits[k]), float(h[i, k])))
        return out


def text_blocks(texts, most: int = 1 << 20):
    """Ranges of rows with at most that many letters, or one row."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield at, k
            at, size = k, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _merge(parts):
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key)
    key, count = key[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def count_runs(docs: DataFrame) -> DataFrame:
    """``lang, key, n`` over all rows of ``(lang, text)``: summed within each task, then over tasks."""

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for a, b in text_blocks(texts):
                key, bounds, _ = runs(texts[a:b])
                lang = np.array(langs[a:b], object)
                for name in set(langs[a:b]):
                    own = np.repeat(lang == name, np.diff(bounds))
                    held.setdefault(name, []).append(np.unique(key[own], return_counts=True))
                    if len(held[name]) > 24:
                        held[name] = [_merge(held[name])]
        for name, parts in held.items():
            key, count = _merge(parts)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key)), pa.array(key.view(np.int64)), pa.array(count)], ["lang", "key", "n"])

    return docs.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Tables:
    """Models too large to broadcast: by order, highest first, ``(lang, key, share)`` and ``(lang, context, rest)``."""

    names: list[str]
    share: list[DataFrame]
    rest: list[DataFrame]
    floor: float
    limits: np.ndarray

    def entropies(self, docs: DataFrame) -> DataFrame:
        """``digest, n, has, h`` of the different texts of ``docs``: ``h`` the cross-entropies by language, in order."""
        texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text").dropDuplicates(["digest"])

        def run(batches):
            for batch in batches:
                digest, texts = (batch.column(i).to_pylist() for i in (0, 1))
                for a, b in text_blocks(texts):
                    key, bounds, has = runs(texts[a:b])
                    for k in range(b - a):
                        own, n = np.unique(key[bounds[k] : bounds[k + 1]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([digest[a + k]] * len(own), pa.string()), pa.array([bool(has[k])] * len(own), pa.bool_()), pa.array(own.view(np.int64)), pa.array(n)], ["digest", "has", "key", "n"])

        seen = staged(texts.mapInArrow(run, "digest string, has boolean, key long, n long"), "document-runs")
        p = seen.select("key").distinct().withColumn("lang", F.explode(F.array(*[F.lit(x) for x in self.names])))
        for k, (share, rest) in enumerate(zip(self.share, self.rest)):
            part = F.col("key").bitwiseAND(F.lit((1 << (16 * (ORDER - k))) - 1)) if k else F.col("key")
            p = p.withColumn("part", part).withColumn("before", F.shiftrightunsigned(part, 16))
            p = p.join(share.select("lang", F.col("key").alias("part"), F.col("share").alias(f"s{k}")), ["lang", "part"], "left")
            p = p.join(rest.select("lang", F.col("context").alias("before"), F.col("rest").alias(f"r{k}")), ["lang", "before"], "left").drop("part", "before")
        total, weight = F.lit(0.0), F.lit(1.0)
        for k in range(ORDER):
            total = total + weight * F.coalesce(f"s{k}", F.lit(0.0))
            weight = weight * F.coalesce(f"r{k}", F.lit(1.0))
        by_key = p.select("key", "lang", F.log(total + weight * F.lit(self.floor)).alias("log_p")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("lang", "log_p"))), lambda x: x["log_p"]).alias("log_p"))
        by_key = by_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = seen.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(by_key, ["key", "salt"])
        sums = [F.sum(F.col("n") * F.col("log_p")[i]).alias(f"h{i}") for i in range(len(self.names))]
        return met.groupBy("digest").agg(F.sum("n").alias("n"), F.max("has").alias("has"), *sums).select("digest", "n", "has", F.array(*[-F.col(f"h{i}") / F.col("n") for i in range(len(self.names))]).alias("h"))


def tables(counts: DataFrame) -> Tables:
    """The models of ``(lang, key, n)`` as tables."""
    share, rest, level = [], [], counts
    for k in range(ORDER, 0, -1):
        level = staged(level, f"runs-{k}")
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        d = F.when(ones + twos > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(0.5)
        cut = F.broadcast(level.groupBy("lang").agg(d.alias("d")))  # a row a language
        held = level.withColumn("context", F.shiftrightunsigned("key", 16))
        total = held.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        share.append(held.join(total, ["lang", "context"]).join(cut, "lang").select("lang", "key", ((F.col("n") - F.col("d")) / F.col("total")).alias("share")))
        rest.append(total.join(cut, "lang").select("lang", "context", (F.col("d") * F.col("kinds") / F.col("total")).alias("rest")))
        level = level.groupBy("lang", F.col("key").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1)).alias("key")).agg(F.count("*").alias("n"))
    names = sorted(r.lang for r in counts.select("lang").distinct().collect())
    known = counts.select(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("letter")).distinct().count() + 1
    return Tables(names, share, rest, 1.0 / known, np.full(len(names), np.inf))


def _limits(bins: list, names: list[str], floor: float) -> np.ndarray:
    """Limits from rows ``(lang, bin, n)`` of the cross-entropies of training documents under their own language."""
    out = np.full(len(names), -np.log(floor))
    for k, name in enumerate(names):
        own = sorted((r.bin, r.n) for r in bins if r.lang == name)
        upto = np.cumsum([n for _, n in own])
        if len(own) and upto[-1] >= FEW:
            at = lambda q: (own[int(np.searchsorted(upto, q * upto[-1]))][0] + 1) / BINS
            out[k] = max(at(0.5) + DEVIATIONS * max(at(0.84) - at(0.5), 0.02), at(0.999) * 1.1)
    return out


def fit(docs: DataFrame, most_runs: int | None = None, broadcast_runs: int = BROADCAST_RUNS) -> Identifier | Tables:
    """Learns from the rows that have a language and are not held out.

    ``most_runs``, unset by default, keeps runs seen least out of the models by count until no more than that are left.
    """
    train = pick(docs, "doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    counts = staged(count_runs(train), "runs")
    if most_runs is not None:
        sizes = {r.size: r.runs for r in counts.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("runs")).collect()}
        cut = 0
        while sum(v for k, v in sizes.items() if k >= cut) > most_runs:
            cut += 1
        counts = counts.filter(F.col("n") >= 1 << cut)
    if counts.count() > broadcast_runs:
        out = tables(counts)
        own = F.md5(F.coalesce("text", F.lit("")))
        by = F.create_map(*[x for k, name in enumerate(out.names) for x in (F.lit(name), F.lit(k))])
        seen = train.select("lang", own.alias("digest")).join(out.entropies(train), "digest").filter(F.col("n") >= LEAST_LETTERS).select("lang", F.get(F.col("h"), by[F.col("lang")]).alias("h"))
        bins = seen.groupBy("lang", F.floor(F.col("h") * BINS).alias("bin")).agg(F.count("*").alias("n")).collect()
        out.limits = _limits(bins, out.names, out.floor)
        return out
    rows = counts.toArrow().combine_chunks()
    lang = np.array(rows["lang"].to_pylist(), object)
    key, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    names = sorted(set(lang))
    known = len(np.unique(key & np.uint64(0xFFFF))) + 1
    out = Identifier(names, [Model(key[lang == x], n[lang == x], known) for x in names], np.full(len(names), np.inf))
    if names:
        out.limits = _limits(_binned(train, out), names, 1.0 / known)
    return out


def _binned(rows: DataFrame, identifier: Identifier) -> list:
    """How many rows of each language have a cross-entropy in each bin under that language's model."""
    held = rows.sparkSession.sparkContext.broadcast(identifier)

    def run(batches):
        own, found = held.value, {}
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for a, b in text_blocks(texts):
                key, bounds, _ = runs(texts[a:b])
                n = np.diff(bounds)
                for k, name in enumerate(own.names):
                    mine = np.flatnonzero((np.array(langs[a:b], object) == name) & (n >= LEAST_LETTERS))
                    if not len(mine):
                        continue
                    kinds, back = np.unique(np.concatenate([key[bounds[i] : bounds[i + 1]] for i in mine]), return_inverse=True)
                    to = np.cumsum(n[mine])
                    h = -np.add.reduceat(own.models[k].log_p(kinds)[back], to - n[mine]) / n[mine]
                    for at, many in zip(*np.unique(np.floor(h * BINS).astype(np.int64), return_counts=True)):
                        found[name, int(at)] = found.get((name, int(at)), 0) + int(many)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([x for _, x in found]), pa.array(list(found.values()))], ["lang", "bin", "n"])

    return rows.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()


def _by_tables(docs: DataFrame, models: Tables) -> DataFrame:
    found = models.entropies(docs)
    best = F.array_position(F.col("h"), F.array_min("h")).cast("int") - 1
    low = F.array_min("h")
    score = 1.0 / F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(-(x - low) * F.least(F.col("n"), F.lit(100))))
    limit = F.get(F.array(*[F.lit(float(x)) for x in models.limits]), best)
    name = F.get(F.array(*[F.lit(x) for x in models.names]), best)
    found = found.filter("has").select("digest", name.alias("lang_pred"), score.alias("score"), ((F.col("n") < LEAST_LETTERS) | (low <= limit)).alias("accepted"), low.alias("entropy"))
    out = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")))).join(found.withColumnRenamed("digest", "__digest"), "__digest", "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("accepted", F.lit(False)).alias("accepted"), "entropy")


def identify(docs: DataFrame, identifier: Identifier | Tables | None = None) -> DataFrame:
    """``docs`` with ``lang_pred, score, accepted, entropy``; the models are learned from ``docs`` unless given."""
    new = ["lang_pred", "score", "accepted", "entropy"]
    identifier = identifier or fit(docs)
    docs = pick(docs, *[c for c in docs.columns if c not in new])
    if isinstance(identifier, Tables):
        return _by_tables(docs, identifier)
    held = docs.sparkSession.sparkContext.broadcast(identifier)
    at = docs.columns.index("text")

    def run(batches):
        own = held.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = [x for a, b in text_blocks(texts) for x in own.predict(texts[a:b])]
            if out:
                types = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(zip(*out), types)]], [*batch.schema.names, *new])

    from pyspark.sql import types as T

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType(), T.DoubleType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(new, kinds)]]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(pick(docs, "doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
