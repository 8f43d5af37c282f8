"""Ranked lexical search: Block-Max WAND over compressed posting blocks.

Documents become shards of about ``SHARD`` postings where they are read; nothing is shuffled to build the index, and one
row of it is one term of one shard. Its postings stand in blocks of ``BLOCK``: per block the first and the last document,
the greatest impact, and where its bytes end. The bytes (steps between documents, occurrences) are opened only if the
block can matter.

A question walks a shard by its terms' block borders. Between two borders no pointer leaves its block, so the weighted
greatest impacts of the blocks at hand bound every document there: the shallow moves, made for all borders at once
without opening a block. Stretches are opened from the highest bound on, until no bound left reaches the ``k``-th best
score so far. What equals that score is opened too, since the lower ``doc_id`` wins; so the result is exact.

Questions meet the index by term: a term that all shards hold is dealt over parts of ``PART`` shards, and questions go
in blocks of ``ITEMS``, so a task holds one shard's lists of one block of questions, whatever the sizes.

Defined results: a null text has no terms; documents without terms are not counted and never found. Rows of one ``doc_id``
are documents of their own; a null ``doc_id`` stands last among equals. Rows of one ``item_id``, null too, are one item
with the terms of all. An item that no document meets has no rows; empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsight.llm.common import chunks, pick, staged, table

#: Postings of a shard and of a block; questions of a block, shards of a part of a term.
SHARD, BLOCK, ITEMS, PART = 1 << 20, 128, 256, 64
#: Stretches that are opened first; each further step opens twice as many.
FIRST = 4

_IN_TERM = np.ones(256, bool)
_IN_TERM[:48] = _IN_TERM[58:65] = _IN_TERM[91:97] = _IN_TERM[123:128] = False
_LOW = bytes(b + 32 if 65 <= b < 91 else b if _IN_TERM[b] else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: letters and digits, and everything beyond ASCII; A-Z lower-cased."""
    return text.translate(_LOW).split()


def _sizes(batches) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in chunks(batches, "text"):
        inside = _IN_TERM[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        at = offsets[offsets < len(data)]
        begin[at] = inside[at]
        n = np.diff(np.concatenate([[0], np.cumsum(begin)])[offsets])
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["n", "l"])


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents that have a term, and all their terms with repeats."""
    one = pick(docs, "text").mapInArrow(_sizes, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return one[0] or 0, one[1] or 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last of each below 128; and where each number ends."""
    size = 1 + sum((values >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[end[has] - size[has] + k] = values[has] >> 7 * k & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, end


def unpacked(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 8 * m)


_INDEX = "shard long, term binary, n long, first array<int>, last array<int>, top array<int>, end array<int>, body binary, doc_ids array<long>, m array<long>"


def index(docs: DataFrame, size: tuple[int, int], shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The index of ``docs`` (``doc_id``, ``text``), whose ``sizes`` are known. A shard's row without a term has its documents."""
    n_docs, n_terms = size
    names = [c.split()[0] for c in _INDEX.split(", ")]
    i32 = pa.int32()

    def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, i32), pa.array(values.astype(np.int32)))

    def rows(number: int, words: dict, found: list, times: list, ids: list, lengths: list) -> Iterator[pa.RecordBatch]:
        m = 25 + 75 * np.array(lengths, np.int64) * n_docs // n_terms
        head = {"shard": number, "term": b"", "n": 0, "doc_ids": ids, "m": m.tolist()}
        kinds = {"shard": pa.int64(), "term": pa.binary(), "n": pa.int64(), "body": pa.binary(), "doc_ids": pa.list_(pa.int64()), "m": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_pylist([{c: head.get(c) for c in names}], pa.schema([(c, kinds.get(c, pa.list_(i32))) for c in names]))
        word, doc = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(word, kind="stable")
        word, doc, tf = word[order], doc[order], np.concatenate(times)[order]
        n = np.bincount(word, minlength=len(words))
        begin = np.cumsum(n) - n
        blocks = -(-n // block)
        at = np.flatnonzero((np.arange(len(word)) - begin[word]) % block == 0)
        top = np.maximum.reduceat(impact(tf, m[doc]), at)
        upto = np.append(at[1:], len(word))
        step = np.diff(doc, prepend=0)
        step[at] = 0
        raw, end = packed(np.stack([step, tf], 1).ravel())
        stop = end[2 * upto - 1]
        own = np.concatenate([[0], np.cumsum(blocks)])
        body = np.concatenate([[0], stop[own[1:] - 1]])
        bodies = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(body.astype(np.int32)), pa.py_buffer(raw)])
        columns = [pa.array(np.full(len(words), number)), pa.array(list(words), pa.binary()), pa.array(n), *(lists(x, own) for x in (doc[at], doc[upto - 1], top, stop - np.repeat(body[:-1], blocks))), bodies, *(pa.nulls(len(words), pa.list_(pa.int64())) for _ in range(2))]
        all_ = pa.RecordBatch.from_arrays(columns, names)
        for k in range(0, len(words), 1 << 13):
            yield all_.slice(k, 1 << 13)

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        fresh = lambda: (defaultdict(), [], [], [], [])
        held, size = fresh(), 0
        held[0].default_factory = held[0].__len__
        for part, data, offsets in chunks(batches, "text"):
            raw = data.tobytes()
            for k, doc in enumerate(part.column(0).to_pylist()):
                have = Counter(terms(raw[offsets[k] : offsets[k + 1]]))
                if not have:
                    continue
                words, found, times, ids, lengths = held
                found.append(np.fromiter(map(words.__getitem__, have), np.int64, len(have)))
                times.append(np.fromiter(have.values(), np.int64, len(have)))
                ids.append(doc)
                lengths.append(have.total())
                size += len(have)
                if size >= shard:
                    yield from rows(number, *held)
                    number, held, size = number + 1, fresh(), 0
                    held[0].default_factory = held[0].__len__
        if size:
            yield from rows(number, *held)

    return pick(docs, "doc_id", "text").mapInArrow(run, _INDEX)


class Postings:
    """One term's list in one shard; ``opened`` counts the blocks that were unpacked."""

    def __init__(self, first, last, top, end, body, m: np.ndarray):
        self.first, self.last, self.top, self.end, self.body, self.m = first, last, top.astype(np.int64), end, body, m
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.seen:
            pairs = unpacked(np.frombuffer(self.body, np.uint8)[self.end[b - 1] if b else 0 : self.end[b]]).reshape(-1, 2)
            doc = self.first[b] + np.cumsum(pairs[:, 0])
            self.seen[b] = doc, impact(pairs[:, 1], self.m[doc])
        return self.seen[b]


def best(lists: list[Postings], weights: list[int], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of one shard with a score above 0 that reach its ``k``-th best, ties included, and their scores."""
    border = np.unique(np.concatenate([x.last for x in lists]))
    bound = np.zeros(len(border), np.int64)
    stands = np.full((len(lists), len(border)), -1)
    for x, weight, own in zip(lists, weights, stands):
        b = np.searchsorted(x.last, border)
        near = np.minimum(b, len(x.last) - 1)
        there = (b < len(x.last)) & (x.first[near] <= border)
        bound += np.where(there, weight * x.top[near], 0)
        own[there] = near[there]
    order = np.argsort(-bound, kind="stable")
    falling = -bound[order]
    score, least, at, step = np.zeros(n_docs, np.int64), 1, 0, FIRST
    while True:
        to = min(at + step, int(np.searchsorted(falling, -least, "right")))
        if to <= at:
            break
        part = order[at:to]
        chosen = np.zeros(len(border), bool)
        chosen[part] = True
        for x, weight, own in zip(lists, weights, stands):
            need = np.unique(own[part])
            if need[0] < 0:
                need = need[1:]
            if not len(need):
                continue
            doc, worth = (np.concatenate(c) for c in zip(*(x.block(b) for b in need.tolist())))
            in_part = chosen[np.searchsorted(border, doc)]
            score[doc[in_part]] += weight * worth[in_part]
        if n_docs >= k:
            least = max(1, int(np.partition(score, n_docs - k)[n_docs - k]))
        at, step = to, 2 * step
    doc = np.flatnonzero(score >= least)
    return doc, score[doc]


def _answers(k: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        terms_ = rows.column("term").to_pylist()
        head = terms_.index(b"")
        doc_ids = rows.column("doc_ids")[head].values
        m = np.array(rows.column("m")[head].as_py(), np.int64)
        columns = [[x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in rows.column(c)] for c in ("first", "last", "top", "end")]
        bodies, weights = rows.column("body"), rows.column("w").to_pylist()
        asked: dict[int | None, list[tuple[int, int]]] = defaultdict(list)
        lists: dict[int, Postings] = {}
        for i, items in enumerate(rows.column("items").to_pylist()):
            if i != head:
                lists[i] = Postings(*(c[i] for c in columns), bodies[i].as_py(), m)
                for item in items:
                    asked[item["item_id"]].append((i, weights[i] * item["times"]))
        out: list[tuple] = []
        for item, uses in asked.items():
            doc, score = best([lists[i] for i, _ in uses], [w for _, w in uses], len(m), k)
            ids = doc_ids.take(pa.array(doc)).to_pylist()
            ranked = sorted(zip(ids, score.tolist()), key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
            out += [(item, d, s) for d, s in ranked]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["item_id", "doc_id", "score"])

    return run


def _asked(batches) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in chunks(batches, "text"):
        raw = data.tobytes()
        for k, item in enumerate(part.column(0).to_pylist()):
            have = Counter(terms(raw[offsets[k] : offsets[k + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(have), pa.int64()), pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())], ["item_id", "term", "times"])


def search(spark: SparkSession, indexed: DataFrame, n_docs: int, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item (``item_id``, ``text``)."""
    asked = pick(items, "item_id", "text").mapInArrow(_asked, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    asked = staged(asked, "asked")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // ITEMS))
    parts = max(1, -(-indexed.where("n = 0").count() // PART))
    held = indexed.where("n > 0").select("term", "n").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")
    by = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).join(held.select("term", weight), "term")
    uses = by.groupBy("block", "term", "w").agg(F.collect_list(F.struct("item_id", "times")).alias("items"))
    heads = by.select("block").distinct().select("block", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("w"), F.array().cast(uses.schema["items"].dataType).alias("items"))
    dealt = uses.union(heads).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = indexed.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int")).join(dealt, ["term", "part"]).drop("part")
    found = met.groupBy("shard", "block").applyInArrow(_answers(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = sizes(docs)
    return search(spark, staged(index(docs, size), "postings"), size[0], table(spark, sf_dir, "benchmark"))


SQL = r"""
with tokens as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
held as (select doc_id, term, count(*)::bigint as tf from tokens group by all),
sizes as (select doc_id, sum(tf)::bigint as n from held group by doc_id),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
norms as (select doc_id, 25 + (75 * n * n_docs) // n_terms as m from sizes, total),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from held, total group by term),
asked as (
  select item_id, term, count(*)::bigint as times
  from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark)
  group by all),
scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (term) join held using (term) join norms using (doc_id)
  group by all),
ranked as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10"""
