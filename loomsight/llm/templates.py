"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation. Numbers, units and names become typed placeholders, so a question whose figures
or names were exchanged has the same template. Windows of ``WINDOW`` template words of the benchmark are hashed; the
documents' windows are joined with them by hash. Along each alignment of a document with an item the slots must be
consistent: what stands for one value of the item is the same value everywhere, and different values stay different;
where they are not, the text asks something else, and only windows that stand there with the item's own values count. Alignments that follow each other in item and document and agree in their values add up,
so inserted or deleted words only cost the windows across them. A document is contaminated by an item if consistent
windows cover at least ``COVER`` of the item's words.

A name is a capitalised word within a sentence; a unit is a word of ``UNITS`` after a number, or glued to one. Template
windows need ``LITERAL`` or more words that are no placeholder, or such a window beside them in the same alignment.
Every window is also looked up with its values in place, so verbatim copies match however many placeholders they have,
and whether or not their names are taken for names where they stand. An item shorter than the window is one window of
its own. Words all in capitals match as a verbatim window only where the item has them so, too.

The benchmark's index is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of item text, however large the
benchmark; the documents flow through one step per block in a single stage, without a shuffle.

Defined results: null or empty texts match nothing, and such items are skipped; items with a null id are skipped; a
repeated item is one item; every row of ``docs`` is judged alone, so repeated rows agree; other columns stay; an empty
benchmark leaves every document clean; empty ``docs`` give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsight.llm.common import pick, table

WINDOW, LITERAL, COVER = 10, 5, 0.5
BLOCK_BYTES = 32 << 20
#: Units that follow a figure. Fixed values.
UNITS = frozenset("mm cm m km in ft yd mi g kg mg lb oz t ml l s sec min h hr hrs day days week weeks month months year years usd eur gbp dollars euros pounds cents percent degrees meters metres miles inches feet hours minutes seconds grams kilograms liters litres kmh mph hz khz mhz ghz kb mb gb tb w kw v a".split())
NUMBER, UNIT, NAME = "\0num", "\0unit", "\0name"
_TRIM = regex.compile(r"^[^\p{L}\p{N}$€£%]+|[^\p{L}\p{N}%]+$")
_NUMBER = regex.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_GLUED = regex.compile(r"([$€£]?[+-]?\d[\d.,:/]*)(\p{L}+|%)")
_SLOT = regex.compile(r"\d|\p{Lu}")
#: Entries of a worker's cache of trimmed words.
CACHE = 500_000


class _Trimmed(dict):
    """Word as written to the word alone, or to None if it may be a placeholder."""

    def __missing__(self, raw: str) -> str | None:
        if len(self) >= CACHE:
            self.clear()
        word = _TRIM.sub("", raw)
        self[raw] = word = None if _SLOT.search(word) else word
        return word


_trimmed = _Trimmed()


def template(text: str | None) -> tuple[list[str], dict[int, str]]:
    """Template words, and the value of each placeholder by its place."""
    return forms(text)[:2]


def forms(text: str | None) -> tuple[list[str], dict[int, str], dict[int, str]]:
    """Template words, the value of each placeholder, and words all in capitals as they are written, by their places."""
    raw = (text or "").split()
    out = [_trimmed[w] for w in raw]
    if "" in out:
        raw, out = [w for w, x in zip(raw, out) if x != ""], [x for x in out if x != ""]
    slots: dict[int, str] = {}
    capitals: dict[int, str] = {}
    glued: list[tuple[int, str]] = []
    at = -1
    for _ in range(out.count(None)):
        at = out.index(None, at + 1)
        word = _TRIM.sub("", raw[at])
        low = word.lower()
        if _NUMBER.fullmatch(word):
            slots[at], out[at] = low, NUMBER
            unit = out[at + 1] if at + 1 < len(out) else None
            if unit in UNITS:
                slots[at + 1], out[at + 1] = unit, UNIT
        elif (parts := _GLUED.fullmatch(word)) and (parts[2].lower() in UNITS or parts[2] == "%"):
            slots[at], out[at] = parts[1], NUMBER
            glued.append((at, parts[2].lower()))
        elif at and word[0].isupper() and not word.isupper() and raw[at - 1][-1] not in ".!?:":
            slots[at], out[at] = low, NAME
        else:
            out[at] = low
            if len(word) > 1 and word.isupper():
                capitals[at] = word
    if glued:  # their units are words of their own
        units, words, moved, higher = dict(glued), [], {}, {}
        for k, w in enumerate(out):
            if k in slots:
                moved[len(words)] = slots[k]
            elif k in capitals:
                higher[len(words)] = capitals[k]
            words.append(w)
            if k in units:
                moved[len(words)] = units[k]
                words.append(UNIT)
        out, slots, capitals = words, moved, higher
    return out, slots, capitals


def plain(words: list[str], *values: dict[int, str]) -> list[str]:
    """The words with those values at their places."""
    out = list(words)
    for value in values:
        for k, v in value.items():
            out[k] = v
    return out


class Index:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.short, self.where, self.poor = {}, [], defaultdict(list), defaultdict(list)
        for item, text in items:
            words, slots, capitals = forms(text)
            if not words:
                continue
            whole = plain(words, slots)
            written = plain(whole, capitals)
            self.items[item] = (words, slots)
            if len(words) < WINDOW:
                self.short.append(len(words))
            for at in range(max(1, len(words) - WINDOW + 1)):
                run, same, exact = (tuple(x[at : at + WINDOW]) for x in (words, whole, written))
                keys = {same, exact}
                if sum(w[0] != "\0" for w in run) >= min(LITERAL, len(run)):
                    keys.add(run)
                else:
                    self.poor[item].append(at)
                for key in keys:
                    self.where[key].append((item, at))
        self.short = sorted(set(self.short))
        self.where = dict(self.where)
        self.firsts = {run[:2] for run in self.where}  # a cheap first test

    def hits(self, words: list[str], slots: dict[int, str], capitals: dict[int, str]) -> list[tuple[int, float, int]]:
        """``(item, share of its words, place)`` of the items that contaminate a document."""
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        firsts, where = self.firsts, self.where
        odd = {**slots, **capitals}
        same = plain(words, odd) if odd else words
        starts = [at for at, pair in enumerate(zip(words, words[1:])) if pair in firsts]
        if odd:
            more = {at for k in odd for at in (k - 1, k) if at >= 0 and tuple(same[at : at + 2]) in firsts}
            starts = sorted(more.union(starts)) if more else starts
        for at in starts:
            for size in (WINDOW, *self.short):
                run, exact = tuple(words[at : at + size]), tuple(same[at : at + size])
                for key in (run,) if run == exact else (run, exact):
                    for item, place in where.get(key, ()):
                        found[item, at - place].add(place)
        if 1 in self.short:
            for at, (w, x) in enumerate(zip(words, same)):
                for key in (w,) if w == x else (w, x):
                    for item, place in where.get((key,), ()):
                        found[item, at - place].add(place)
        best: dict[int, tuple[float, int]] = {}
        pieces: dict[int, list] = defaultdict(list)
        for (item, shift), places in found.items():
            own, values = self.items[item]
            size = min(WINDOW, len(own))
            for p in self.poor.get(item, ()):  # windows of few plain words count beside one that was found
                if p not in places and p + shift >= 0 and words[p + shift : p + shift + size] == own[p : p + size]:
                    places.add(p)
            covered = {k for p in places for k in range(p, p + size)}
            there: dict[str, str] = {}
            back: dict[str, str] = {}
            bad = set()
            for k in sorted(covered):
                if k in values:
                    a, b = own[k] + values[k], own[k] + slots.get(k + shift, words[k + shift])
                    if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                        bad.add(k)
            if bad:  # another question of the same form: only what stands there word by word counts
                places = {p for p in places if all(slots.get(q + shift, words[q + shift]) == values[q] for q in range(p, p + size) if q in values)}
            good = {k for p in places for k in range(p, p + size)}
            share = len(good) / len(own)
            if share >= COVER:
                best[item] = max(best.get(item, (0.0, 0)), (share, -shift))
            if good and share < 1:
                pieces[item].extend(self._pieces(item, shift, sorted(good), words, slots))
        for item, parts in pieces.items():
            if len(parts) > 1 and best.get(item, (0.0, 0))[0] < 1:
                n, shift = _chain(parts)
                share = n / len(self.items[item][0])
                if share >= COVER:
                    best[item] = max(best.get(item, (0.0, 0)), (share, -shift))
        return [(item, share, -shift) for item, (share, shift) in sorted(best.items())]


    def _pieces(self, item: int, shift: int, good: list[int], words: list[str], slots: dict[int, str]) -> list:
        """Unbroken covered stretches of an alignment: ``(first, end, shift, values by the item's)``."""
        own, values = self.items[item]
        out, at = [], 0
        for k in range(1, len(good) + 1):
            if k == len(good) or good[k] != good[k - 1] + 1:
                a, b = good[at], good[k - 1] + 1
                out.append((a, b, shift, {own[q] + values[q]: own[q] + slots.get(q + shift, words[q + shift]) for q in range(a, b) if q in values}))
                at = k
        return out


def _chain(parts: list) -> tuple[int, int]:
    """Most item words that stretches cover which follow each other in item and document, and the first one's shift.

    A stretch joins the best chain before it whose values agree with its own; overlaps count once.
    """
    parts = sorted(parts, key=lambda x: (x[0] + x[2], x[0]))
    done: list[tuple[int, int, dict, dict]] = []
    for i, (a, b, shift, values) in enumerate(parts):
        top = (b - a, shift, values, {y: x for x, y in values.items()})
        for j in range(i):
            c, d, other, _ = parts[j]
            # what both stretches claim, in the item or in the document, counts for the first
            n = b - max(a, d, d + other - shift)
            if c < a and b > d and n > 0 and done[j][0] + n > top[0]:
                _, first, there, back = done[j]
                if all(there.get(x, y) == y and back.get(y, x) == x for x, y in values.items()):
                    top = (done[j][0] + n, first, {**there, **values}, {**back, **{y: x for x, y in values.items()}})
        done.append(top)
    return max(((n, shift) for n, shift, _, _ in done), key=lambda x: (x[0], -x[1]))


def _blocks(benchmark: DataFrame) -> list:
    """Broadcast item lists, each of at most about ``BLOCK_BYTES``; one block is on the driver at a time."""
    items = pick(benchmark, "item_id", "text").filter("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    spark = benchmark.sparkSession
    return [spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())) for k in range(n)]


_indexes: dict[str, Index] = {}


def _index(items: list) -> Index:
    key = hashlib.sha1(repr(items).encode()).hexdigest()
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items)
    return _indexes[key]


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("place", T.LongType())]))
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("place", pa.int64())]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``hits`` (items, covered shares, places in template words) and ``contaminated``."""
    docs = pick(docs, *[c for c in docs.columns if c not in ("hits", "contaminated")])
    out = docs.withColumn("hits", F.array().cast(HITS))
    at = docs.columns.index("text")
    for block in _blocks(benchmark):

        def run(batches, block=block):
            index = _index(block.value)
            for batch in batches:
                last = batch.num_columns - 1
                hits = [(old or []) + [dict(zip(("item_id", "share", "place"), h)) for h in index.hits(*forms(text))] for text, old in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(hits, _HITS)], batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.withColumn("contaminated", F.size("hits") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a leak is not kept and carries its items."""
    out = contaminated(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.transform("hits", lambda h: h["item_id"])
    return out.select("doc_id", "contaminated", (~F.col("contaminated")).alias("kept"), ids.alias("item_ids"), F.array_max(F.transform("hits", lambda h: h["share"])).alias("share"))
