"""Quality rules: divergence of a document's histograms from those of its language.

Base rules count words, symbols, repeated lines and repeated eight-word windows. Beyond them a document is held against
the reference of its language, gathered over all documents: the shares of character classes and the shares of the
language's commonest words with all others as one. The distance is the Jensen-Shannon distance (base 2, 0 to 1); each
histogram has a least length below which it says nothing.

A reference is small whatever the corpus: ``CLASSES`` sums and ``COMMON`` words, of every language there is, found by one
aggregate for all of them. Up to ``BROADCAST_LANGS`` references go to every task; beyond, documents meet theirs in a join.
Both ways are tested to agree. Documents without a language use the reference of all.

Defined results: null or empty text has no words, so the base rules fail it; ties among common words go to the lesser
hash; repeated rows count each; a language whose reference has too few words uses that of all; other columns pass
unread; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsight.llm.common import LOWER, chunks, pick, prefix_hash, span_hash, staged, table, windows, words

COMMON, WINDOW = 64, 8
#: References up to which they are broadcast, in some 80 MB.
BROADCAST_LANGS = 1 << 16
#: Distances beyond which a document diverges, and the words or characters from which on a histogram counts.
CLASS_LIMIT, WORD_LIMIT, LEAST_WORDS, LEAST_CHARS = 0.32, 0.44, 50, 200
#: A reference with fewer words than this says nothing of its language.
LEAST_REFERENCE = 2000

#: Character classes of a byte; code points beyond ASCII count once, at their first byte, as letters.
LETTER, UPPER, DIGIT, BLANK, LINE, STOP, MARK, SYMBOL, OTHER = range(9)
CLASSES = 9
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[97:123] = LETTER
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[32, 9, 11, 12]] = BLANK
_CLASS[[10, 13]] = LINE
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = STOP
_CLASS[[ord(c) for c in "!"]] = MARK
_CLASS[[ord(c) for c in "#*$%&|<>@^~=+_/\\[]{}`"]] = SYMBOL
_CLASS[194:245] = LETTER
_CLASS[128:194] = CLASSES  # bytes within a code point: not counted
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Reference:
    """Of one language: class shares, its commonest words (sorted hashes) and their shares, the rest's last."""

    classes: np.ndarray
    common: np.ndarray
    shares: np.ndarray
    n_words: int


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of equal length, each of which sums to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: float(np.where(a > 0, a * np.log2(a / m), 0).sum())
        return float(np.sqrt(min(1.0, max(0.0, (kl(p) + kl(q)) / 2))))


def _blocks(batches):
    """Per block of rows: the rows, bytes, offsets, word starts and ends, and bounds by row."""
    for rows, data, offsets in chunks(batches, "text"):
        start, end, bounds = words(data, offsets)
        yield rows, data, offsets, start, end, bounds


def _histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class counts of each row."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(row * (CLASSES + 1) + _CLASS[data], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def _counted(batches):
    """Class and word counts by language, summed within the task: ``lang, kind, key, n``."""
    classes: dict[str | None, np.ndarray] = {}
    held: dict[str | None, list] = {}

    def merge(parts):
        key, n = (np.concatenate(x) for x in zip(*parts))
        kinds, back = np.unique(key, return_inverse=True)
        return kinds, np.bincount(back, n, len(kinds)).astype(np.int64)

    for rows, data, offsets, start, end, bounds in _blocks(batches):
        lang = np.array(rows.column(1).to_pylist(), object)
        h = span_hash(prefix_hash(LOWER[data]), start, end)
        table_ = _histograms(data, offsets)
        for name in set(lang):
            own = np.array([x == name for x in lang])
            classes[name] = classes.get(name, 0) + table_[own].sum(0)
            held.setdefault(name, []).append(np.unique(h[np.repeat(own, np.diff(bounds))], return_counts=True))
            if len(held[name]) > 16:
                held[name] = [merge(held[name])]
    for name in classes:
        key, n = merge(held[name])
        keys, ns = np.concatenate([np.arange(CLASSES), key.view(np.int64)]), np.concatenate([classes[name], n])
        kind = np.repeat([0, 1], [CLASSES, len(key)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(kind), pa.array(keys), pa.array(ns)], ["lang", "kind", "key", "n"])


def reference_rows(docs: DataFrame) -> DataFrame:
    """``name, classes, top, total``: a row for each language (``=`` and it) and one for all (``*``), as counts."""
    counts = staged(pick(docs, "doc_id", "lang", "text").mapInArrow(_counted, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "histograms")
    by_lang = counts.filter("lang is not null").select(F.concat(F.lit("="), "lang").alias("name"), "kind", "key", "n")
    both = by_lang.unionByName(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit("*").alias("name"), "kind", "key", "n"))
    words = both.filter("kind = 1")
    first = Window.partitionBy("name").orderBy(F.desc("n"), "key")
    top = words.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= COMMON).groupBy("name").agg(F.collect_list(F.struct("key", "n")).alias("top"))
    total = words.groupBy("name").agg(F.sum("n").alias("total"))
    classes = both.filter("kind = 0").groupBy("name").agg(F.collect_list(F.struct("key", "n")).alias("classes"))
    return staged(classes.join(total, "name", "left").join(top, "name", "left"), "references")


def _reference(classes, top, total) -> Reference:
    cls = np.zeros(CLASSES)
    for c in classes or ():
        cls[c["key"]] = c["n"]
    pairs = sorted((c["key"] % (1 << 64), c["n"]) for c in top or ())
    common, n = np.array([k for k, _ in pairs], np.uint64), np.array([x for _, x in pairs], np.float64)
    total = int(total or 0)
    return Reference(cls / max(1.0, cls.sum()), common, np.append(n, max(0.0, total - n.sum())) / max(1, total), total)


def _collected(rows: DataFrame) -> dict[str | None, Reference]:
    found = {None if r["name"] == "*" else r["name"][1:]: _reference(r["classes"], r["top"], r["total"]) for r in rows.toArrow().to_pylist()}
    return {None: _reference(None, None, 0)} | found


def references(docs: DataFrame) -> dict[str | None, Reference]:
    """The references by language; that of all documents under ``None``."""
    return _collected(reference_rows(docs))


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


def _repeat_words(h: np.ndarray) -> int:
    """Words in eight-word windows that stand twice or more."""
    runs = windows(h, WINDOW)
    if len(runs) < 2:
        return 0
    _, back, n = np.unique(runs, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[back] > 1)
    if not len(at):
        return 0
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, known: dict[str | None, Reference] | None = None) -> DataFrame:
    """``docs`` with the base counts, both distances (null where the text is too short) and the verdict ``kept``."""
    rows = None
    if not known:
        rows = reference_rows(docs)
        known = _collected(rows if rows.count() <= BROADCAST_LANGS else rows.filter("name = '*'"))
        rows = None if rows.count() <= BROADCAST_LANGS else rows.select("name", F.struct("classes", "top", "total").alias("__own"))
    held = docs.sparkSession.sparkContext.broadcast(known)
    new = [x.split()[0] for x in _OUT.split(", ")]
    docs = pick(docs, *[c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [_OUT])
    width, lang_at = len(docs.columns), docs.columns.index("lang") if "lang" in docs.columns else None
    if rows is not None:
        docs = docs.join(rows, F.concat(F.lit("="), docs["lang"]) == rows["name"], "left").drop("name")

    def run(batches):
        refs = held.value
        for rows, data, offsets, start, end, bounds in _blocks(batches):
            n = rows.num_rows
            inner = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            chars = np.concatenate([[0], np.cumsum(inner[end] - inner[start])])[bounds]
            symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])[offsets]
            prefix = prefix_hash(data)
            h = span_hash(prefix, start, end)
            low = span_hash(prefix_hash(LOWER[data]), start, end)
            table_ = _histograms(data, offsets)
            raw = data.tobytes()
            langs = rows.column(lang_at).to_pylist() if lang_at is not None else [None] * n
            own = rows.column(width).to_pylist() if rows.num_columns > width else [None] * n
            out = []
            for i in range(n):
                a, b = int(bounds[i]), int(bounds[i + 1])
                repeat = _repeat_words(h[a:b])
                failed = b - a < 20 or 100 * repeat > 30 * (b - a)
                ref = refs.get(langs[i]) if own[i] is None else _reference(*own[i].values())
                if ref is None or ref.n_words < LEAST_REFERENCE:
                    ref = refs[None]
                by_class = by_word = None
                total = int(table_[i].sum())
                if total >= LEAST_CHARS:
                    by_class = distance(table_[i] / total, ref.classes)
                if b - a >= LEAST_WORDS and len(ref.common):
                    at = np.minimum(np.searchsorted(ref.common, low[a:b]), len(ref.common) - 1)
                    at[ref.common[at] != low[a:b]] = len(ref.common)
                    by_word = distance(np.bincount(at, minlength=len(ref.common) + 1) / (b - a), ref.shares)
                far = (by_class or 0) > CLASS_LIMIT or (by_word or 0) > WORD_LIMIT
                out.append((b - a, int(chars[i + 1] - chars[i]), int(symbols[i + 1] - symbols[i]), _dup_lines(raw[offsets[i] : offsets[i + 1]]), repeat, failed, by_class, by_word, not failed and not far))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*rows.columns[:width], *[pa.array(c, t) for c, t in zip(zip(*out), types)]], [*rows.schema.names[:width], *new])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return measure(pick(docs, "doc_id", "lang", "text")).drop("lang", "text")
