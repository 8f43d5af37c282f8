"""LM scoring: a probabilistic suffix tree over words, contexts of up to ``DEPTH`` words kept by a divergence test.

A context is kept if what follows it diverges from what follows its longest kept suffix: the leave-one-out log-likelihood
that its own distribution gains over the suffix's, summed over its training occurrences, must exceed ``KEEP`` nats. Kept
distributions are smoothed by absolute discounting into their suffix's, down to the root. A word is scored in the longest
kept suffix of what stands before it. The ``SHARED`` most frequent words that occur ``LEAST`` times have symbols of their
own; all others share one, whose chance in its context is the tree's and whose word is then told by its own count. So an
unseen word is scored like the rare ones, every distribution sums to one, and no word needs a broadcast.

Every position of every document (training or not) goes once through one shuffle, in packed blocks, to the bucket of the
word before it; there all longer contexts are at hand, the tree's branch is counted, tested and smoothed, and the bucket's
positions are scored. A context with ``HOT`` positions or more is dealt over parts by the next word back, and so on; a
full-length one by its rows. What follows such contexts is counted apart, with sums in each task, and told to the parts:
never more than one entry for each symbol. So no task holds more than about ``HOT`` positions, whatever repeats.

Defined results: a null or empty text is its end alone; a null ``doc_id`` counts as the empty text and so is learned
from; every row is a document. Repeated rows all count. An empty table gives no rows; with nothing learned, every token
has the chance of the formula at zero counts. Other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.llm.common import LOWER, chunks, mix, pick, staged, table

DEPTH, KEEP, DISCOUNT = 3, 2.0, 0.75
#: Words with symbols of their own: at most so many, each this often and of so many bytes at most.
SHARED, LEAST, LONGEST = 1 << 19, 3, 64
#: Positions of a bucket, and of a context that is dealt over several.
BUCKET, HOT = 1 << 18, 1 << 18
#: Buckets that one task scores, one after the other.
SHELF = 8
#: Positions that a task packs at once, and counts it holds before it hands them on.
PACK, TALLY = 1 << 19, 1 << 20

START, END, RARE, WORDS = range(4)
#: Bits of a symbol; the highest value stands for no word.
BITS = 20
NONE = (1 << BITS) - 1
_LOW = LOWER.tobytes()


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    return text.translate(_LOW).split()


def numbered(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), "text")


def _counted(batches) -> Iterator[pa.RecordBatch]:
    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for _, data, offsets in chunks(batches, "text"):
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            held.update(words(raw[a:b]))
        if len(held) > TALLY // 2:
            yield out()
            held = Counter()
    yield out()


class Words:
    """The shared words, in order of frequency, and what is counted in training."""

    def __init__(self, shared: pa.Table, n_docs: int, n: int, v: int):
        self.words, counts = shared.column("word").combine_chunks(), shared.column("n").to_numpy()
        self.n, self.v = n, v
        rare = n - n_docs - int(counts.sum())
        self.rare_n, self.rare_v = rare, max(0, v - len(counts) - (n_docs > 0))
        c = np.concatenate([[0, n_docs, rare], counts]).astype(np.float64)
        self.root = (c + 0.5) / (n + 0.5 * (len(c) - 1))
        self.base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        self.known = c > 0


def learned(rows: DataFrame, shared: int = SHARED) -> tuple[DataFrame, Words]:
    """``word, n`` of all training words, and the shared ones."""
    train = rows.where("not held_out")
    counts = staged(train.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    n_docs, one = train.count(), counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where((F.col("n") >= LEAST) & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(shared)
    return counts, Words(top.toArrow(), n_docs, one[0] + n_docs, one[1] + (n_docs > 0))


def encoded(rows: DataFrame, known: Words) -> DataFrame:
    """``row, doc_id, held_out, n_tokens, n_known, base, ids, rare``: symbols with the end, base score and known tokens of
    all but the words that share a symbol, and these words."""
    told = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        model = told.value
        symbol = {w: i for i, w in enumerate(model.words.to_pylist(), WORDS)}
        base = model.base.copy()
        base[RARE] = 0
        counts = model.known.copy()
        counts[RARE] = False
        for part, data, offsets in chunks(batches, "text"):
            raw = data.tobytes()
            ids, rare, sums, seen = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                text = words(raw[a:b])
                own = np.empty(len(text) + 1, np.int32)
                own[:-1] = np.fromiter(map(symbol.get, text, repeat(RARE)), np.int32, len(text))
                own[-1] = END
                ids.append(own)
                rare.append([text[k] for k in np.flatnonzero(own == RARE).tolist()])
                sums.append(float(base[own].sum()))
                seen.append(int(counts[own].sum()))
            n = [len(x) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(sums), lists, pa.array(rare, pa.list_(pa.binary()))], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids", "rare"])

    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, ids array<int>, rare array<binary>")


def _positions(batches, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows' numbers, each position's place among them, its symbol, and the keys of its contexts of 1 to ``DEPTH`` words, the nearest
    word in the highest bits. A row in training has its number plus one below zero."""
    for batch in batches:
        lists = batch.column(2)
        off = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        rows = np.where(batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(), ~batch.column(0).to_numpy())
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            sym = flat[off[at] : off[to]].astype(np.int64)
            own = np.repeat(np.arange(to - at), np.diff(off[at : to + 1]))
            pos = np.arange(len(sym)) - (off[at:to] - off[at])[own]
            keys, key = [], np.zeros(len(sym), np.int64)
            for k in range(1, DEPTH + 1):
                back = np.full(len(sym), START)
                back[k:] = np.where(pos[k:] >= k, sym[:-k], START)
                key = key << BITS | back
                keys.append(key)
            yield rows[at:to], own, sym, keys
            at = to


class _Tally:
    """Counts of keys within a task, handed on when there are many."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(keys):
            self.held.append(np.unique(keys, return_counts=True))
            self.size += len(self.held[-1][0])
        if self.size > TALLY:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])
            if self.size > TALLY // 2:
                yield from self.rest()

    def merged(self):
        key, n = (np.concatenate(x) for x in zip(*self.held))
        kinds, back = np.unique(key, return_inverse=True)
        return kinds, np.bincount(back, n, len(kinds)).astype(np.int64)

    def rest(self):
        if self.held:
            yield self.merged()
        self.held, self.size = [], 0


def _among(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 for what is not there."""
    if not len(sorted_):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return np.where(sorted_[at] == keys, at, -1)


Hot = tuple[np.ndarray, np.ndarray]


def hot_contexts(held: DataFrame, hot: int) -> tuple[list[Hot], list[DataFrame]]:
    """By length: keys and counts of the contexts that ``hot`` positions have, and ``context, sym, n``, what follows the
    ``context``-th of them in training."""
    found: list[Hot] = []
    follow: list[DataFrame] = []
    for k in range(1, DEPTH + 2):
        last = found[-1][0] if found else None

        def run(batches, k=k, last=last) -> Iterator[pa.RecordBatch]:
            kinds = (_Tally(), _Tally())

            def out(kind, pair):
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[0]), kind, np.int32)), *map(pa.array, pair)], ["kind", "key", "n"])

            for rows, own, sym, keys in _positions(batches, PACK):
                among = np.zeros(len(sym), np.int64) if last is None else _among(keys[k - 2], last)
                inside = among >= 0
                new = [keys[k - 1][inside]] if k <= DEPTH else [np.zeros(0, np.int64)]
                new.append((among << BITS | sym)[inside & (rows < 0)[own]] if last is not None else np.zeros(0, np.int64))
                for kind, x in enumerate(new):
                    for pair in kinds[kind].add(x):
                        yield out(kind, pair)
            for kind in (0, 1):
                for pair in kinds[kind].rest():
                    yield out(kind, pair)

        counts = staged(held.select("row", "held_out", "ids").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where(F.expr(f"kind = 1 or n >= {hot}")), f"contexts-{k}")
        if last is not None:
            follow.append(counts.where("kind = 1").select(F.shiftright("key", BITS).alias("context"), F.col("key").bitwiseAND(F.lit(NONE)).cast("int").alias("sym"), "n"))
        if k <= DEPTH:
            some = counts.where("kind = 0").orderBy("key").select("key", "n").toArrow()
            found.append((some.column("key").to_numpy(), some.column("n").to_numpy()))
            if not len(found[-1][0]):
                break
    return found, follow


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(level << 61)) >> np.uint64(1)).astype(np.int64)


def _bucket(keys: list[np.ndarray], rows: np.ndarray, hot: list[Hot], size: int, buckets: int) -> np.ndarray:
    """The bucket of each position: that of its nearest word, or a part of that of its longest hot context."""
    out = _hash(keys[0], 1) % buckets
    for k, (sorted_, n) in enumerate(hot, 1):
        at = _among(keys[k - 1], sorted_)
        own = np.flatnonzero(at >= 0)
        if len(own):
            parts = -(-n[at[own]] // size)
            after = _hash(keys[k][own], k + 1) if k < DEPTH else _hash(rows[own], 0)
            out[own] = (_hash(keys[k - 1][own], k) + after % parts) % buckets
    return out


def _destinations(hot: list[Hot], size: int, buckets: int) -> pa.Table:
    """Where what follows a hot context is told: ``level, context, bucket``, its parts' buckets and those of all hot contexts below it."""
    out = []
    for k, (keys, n) in enumerate(hot, 1):
        parts = -(-n // size)
        own = np.repeat(np.arange(len(keys)), parts)
        bucket = (_hash(keys, k)[own] + np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)) % buckets
        for level in range(1, k + 1):
            context = _among(keys >> BITS * (k - level), hot[level - 1][0])[own]
            out.append((np.full(len(own), level), context, bucket))
    # ranges meet: each bucket is told once
    level, context, bucket = np.unique(np.concatenate([np.stack(x) for x in out], 1), axis=1) if out else np.zeros((3, 0), np.int64)
    return pa.table([pa.array(level, pa.int32()), pa.array(context, pa.int64()), pa.array(bucket, pa.int32())], ["level", "context", "bucket"])


_BLOCK = "bucket int, level int, key long, block binary, sym array<int>, n array<long>"


def _blocks(told, size: int, buckets: int):
    """Positions by bucket: of each the row, whether it trains, the contexts and the symbol, as bytes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for rows, own, sym, keys in _positions(batches, PACK):
            bucket = _bucket(keys, np.abs(rows)[own], told.value, size, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            columns = [x[order].astype(np.int32) for x in (own, sym, *(keys[-1] >> BITS * (DEPTH - k) & NONE for k in range(1, DEPTH + 1)))]
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
                local = columns[0][a:b]
                used, place = np.unique(local, return_inverse=True)
                planes = [np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes() for x in (np.diff(place.astype(np.int32), prepend=np.int32(0)), *(c[a:b] for c in columns[1:]))]
                out.append(z.compress(b"".join([np.array([len(used), b - a], "<i8").tobytes(), np.diff(rows[used], prepend=0).astype("<i8").tobytes(), *planes])))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(np.zeros(len(out), np.int32)), pa.nulls(len(out), pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(out), pa.list_(pa.int32())), pa.nulls(len(out), pa.list_(pa.int64()))], ["bucket", "level", "key", "block", "sym", "n"])

    return run


def _opened(raw: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each position (below zero in training), then its symbol and the words before it."""
    rows, n = np.frombuffer(raw, "<i8", 2)
    of = np.cumsum(np.frombuffer(raw, "<i8", rows, 16))
    planes = np.frombuffer(raw, np.uint8, offset=16 + 8 * rows).reshape(DEPTH + 2, 3, n)
    columns = [p[0].astype(np.int64) | p[1].astype(np.int64) << 8 | p[2].astype(np.int64) << 16 for p in planes]
    step = columns[0]
    step[step >= 1 << 23] -= 1 << 24
    return of[np.cumsum(step)], columns[1:]


def scored(sym: np.ndarray, keys: list[np.ndarray], weights: list[np.ndarray], root: np.ndarray, keep: float = KEEP) -> np.ndarray:
    """The chance of each position's symbol in its longest kept context.

    ``keys``: by length, the contexts; ``weights``: by length, how often the position counts for its context of that
    length. All positions that count for a context are here.
    """
    now = root[sym]
    active = np.arange(len(sym))
    for key, weight in zip(keys, weights):
        context, back = np.unique(key[active], return_inverse=True)
        entry, first, at = np.unique(back << BITS | sym[active], return_index=True, return_inverse=True)
        of = entry >> BITS
        c = np.bincount(at, weight[active], len(entry))
        n, kinds = np.bincount(of, c, len(context)), np.bincount(of, c > 0, len(context))
        suffix = now[active[first]]
        total, many = np.maximum(n, 1)[of], kinds[of]
        own = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * many * suffix) / total
        # what the context would have said of each occurrence without having seen it
        seen = np.flatnonzero((c > 0) & (n[of] > 1))
        out = (np.maximum(c[seen] - 1 - DISCOUNT, 0) + DISCOUNT * (many[seen] - (c[seen] == 1)) * suffix[seen]) / (total[seen] - 1)
        gain = np.bincount(of[seen], c[seen] * np.log(out / suffix[seen]), len(context))
        kept = (n > 1) & (gain > keep)
        now[active] = np.where(kept[of], own, suffix)[at]
        active = active[(n > 1)[back]]  # a longer context has no more occurrences than this one
        if not len(active):
            break
    return now


#: Sums are handed on in whole multiples of this: of what a document's score adds up from, each is off by 3e-8 at most.
STEP = 2.0**-24


def _packed(rows: np.ndarray, sums: np.ndarray) -> bytes:
    """Ascending rows and their sums, byte by byte of equal weight, so that they compress."""
    columns = np.diff(rows, prepend=0).astype("<i8"), (np.round(sums / STEP) * STEP).astype("<f8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns))


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(2, 8, -1)
    rows, sums = (np.ascontiguousarray(p.T).view(kind).ravel() for p, kind in zip(planes, ("<i8", "<f8")))
    return np.cumsum(rows), sums


def _of_bucket(blocks: list[bytes], told: list[tuple[int, int, np.ndarray, np.ndarray]], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a bucket's positions, and the sums of their logarithms. ``told``: length, key, symbols and counts of contexts
    that are counted apart."""
    row, columns, weights = [], [[] for _ in range(DEPTH + 1)], [[] for _ in range(DEPTH)]
    z = zstandard.ZstdDecompressor()
    for block in blocks:
        of, found = _opened(z.decompress(block))
        row.append(of)
        for held, x in zip(columns, found):
            held.append(x)
        for held in weights:
            held.append((of < 0).astype(np.int64))
    for level, key, sym, n in told:
        row.append(np.full(len(sym), 1 << 62))
        columns[0].append(sym.astype(np.int64))
        for k in range(1, DEPTH + 1):
            columns[k].append(np.full(len(sym), key >> BITS * (level - k) & NONE if k <= level else NONE))
            weights[k - 1].append(n if k == level else np.zeros(len(sym), np.int64))
    row, weights = np.concatenate(row), [np.concatenate(w) for w in weights]
    sym, *back = (np.concatenate(p) for p in columns)
    del columns
    keys, key = [], np.zeros(len(sym), np.int64)
    own = row < 1 << 62
    for k in range(DEPTH):
        key = key << BITS | back[k]
        keys.append(key)
        apart = np.sort(np.array([x[1] for x in told if x[0] == k + 1], np.int64))
        weights[k][own & (_among(key, apart) >= 0)] = 0
    del back
    chance = np.log10(scored(sym, keys, weights, root)[own])
    rows, at = np.unique(np.where(row < 0, ~row, row)[own], return_inverse=True)
    return rows, np.bincount(at, chance, len(rows))


def _scores(root, parts: int):
    def run(table_: pa.Table) -> pa.Table:
        table_ = table_.combine_chunks()
        bucket, level = table_.column("bucket").to_numpy(), table_.column("level").to_numpy()
        key, block, sym, n = (table_.column(c) for c in ("key", "block", "sym", "n"))
        out = []
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            blocks = [block[i].as_py() for i in own[level[own] == 0].tolist()]
            if blocks:
                told = [(int(level[i]), key[i].as_py(), sym[i].values.to_numpy(), n[i].values.to_numpy()) for i in own[level[own] > 0].tolist()]
                out.append(_of_bucket(blocks, told, root.value))
        if not out:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["part", "block"])
        rows, sums = (np.concatenate(x) for x in zip(*out))
        rows, at = np.unique(rows, return_inverse=True)
        sums = np.bincount(at, sums, len(rows))
        part = _hash(rows, 0) % parts
        order = np.argsort(part, kind="stable")
        kinds, first = np.unique(part[order], return_index=True)
        packed = [_packed(rows[k], sums[k]) for k in np.split(order, first[1:])]
        return pa.table([pa.array(kinds), pa.array(packed, pa.binary())], ["part", "block"])

    return run


def _summed(blocks: pa.Table) -> pa.Table:
    """The sum of each row of a part over all shelves."""
    rows, sums = (np.concatenate(x) for x in zip(*(_unpacked(b.as_py()) for b in blocks.column("block"))))
    rows, at = np.unique(rows, return_inverse=True)
    return pa.table([pa.array(rows), pa.array(np.bincount(at, sums, len(rows)))], ["row", "tree"])


def score(docs: DataFrame, shared: int = SHARED, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    rows = numbered(docs)
    counts, known = learned(rows, shared)
    held = staged(encoded(rows, known), "encoded")
    positions = held.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-positions // bucket))
    found, follow = hot_contexts(held, hot)
    told, root = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(known.root)
    dealt = held.select("row", "held_out", "ids").mapInArrow(_blocks(told, hot, buckets), _BLOCK)
    to = spark.createDataFrame(_destinations(found, hot, buckets))
    for level, (after, (keys, _)) in enumerate(zip(follow, found), 1):
        lists = after.groupBy("context").agg(F.collect_list(F.struct("sym", "n")).alias("s"))
        named = spark.createDataFrame(pa.table([pa.array(np.arange(len(keys))), pa.array(keys)], ["context", "key"]))
        sent = lists.join(to.where(F.col("level") == level), "context").join(named, "context")
        dealt = dealt.union(sent.select("bucket", F.lit(level).alias("level"), "key", F.lit(None).cast("binary").alias("block"), F.col("s.sym").alias("sym"), F.col("s.n").alias("n")))
    # a shelf of buckets hands on the sums of its rows by part, as many parts as shelves, a block for each
    shelves = -(-buckets // SHELF)
    by_part = dealt.withColumn("shelf", F.floor(F.col("bucket") / SHELF)).groupBy("shelf").applyInArrow(_scores(root, shelves), "part long, block binary")
    sums = by_part.groupBy("part").applyInArrow(_summed, "row long, tree double")
    rare = held.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times")).join(counts, "word", "left")
    c, times = F.coalesce("n", F.lit(0)) + 0.5, F.col("times")
    apart = rare.groupBy("row").agg(
        F.sum(times * F.log10(c / (known.n + 0.5 * (known.v + 1)))).alias("rare_base"),
        F.sum(times * F.log10(c / (known.rare_n + 0.5 * (known.rare_v + 1)))).alias("rare_tree"),
        F.sum(F.when(F.col("n") > 0, times).otherwise(0)).alias("rare_known"),
    )
    out = held.drop("ids", "rare").join(sums, "row").join(apart, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(known.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("tree") + F.coalesce("rare_tree", zero)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
