"""Shared pieces: staged tables, byte-level hashing over Arrow batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Two primes below 2**31, and for each a base drawn once at random. Modulo a prime no two words are alike
#: for every base, as they are modulo 2**64 (the Thue-Morse word of 1,024 letters and its complement).
_PRIMES = (2147483647, 2147483629)
_BASES = (1273642419, 718035921)
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; unset, one of this machine if all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or "file:///tmp/checkpoints"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    A lost executor then costs the tasks it was running, never the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomsight/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables staged so far. Call it once the results built on them are written."""
    while _staged:
        spark, path = _staged.pop()
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches, column: str, max_bytes: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches with at most ``max_bytes`` of text, or one row.

    Yields the slice, its text as UTF-8 bytes and the rows' offsets in them. A null text is empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        if col.null_count:
            col = col.fill_null(b"")
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=8)
def _table(base: int, prime: int, bits: int) -> np.ndarray:
    """Powers of ``base`` modulo ``prime``, ``2**bits`` of them, by doubling."""
    out = np.ones(1 << bits, np.uint32)
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k].astype(np.uint64) * np.uint64(pow(base, 1 << k, prime)) % np.uint64(prime)
    return out


def _lanes(n: int):
    """Per prime: it, and at least ``n`` powers of its base and of the base's inverse."""
    bits = max(16, int(n).bit_length())
    for base, prime in zip(_BASES, _PRIMES):
        yield np.uint64(prime), _table(base, prime, bits), _table(pow(base, -1, prime), prime, bits)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Per prime a row P with P[i] = sum of (data[j] + 1) * (base**j mod prime) over j < i, modulo the prime in long data alone."""
    out = np.zeros((len(_PRIMES), len(data) + 1), np.uint64)
    for row, (prime, up, _) in zip(out, _lanes(len(data) + 1)):
        terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
        if len(data) > 1 << 22:
            terms %= prime
        np.cumsum(terms, out=row[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], by content alone: 31 bits for each of two primes, mixed."""
    out = np.zeros(np.shape(start), np.uint64)
    for row, (prime, _, down) in zip(prefix, _lanes(prefix.shape[1])):
        out = out << np.uint64(31) | (row[end] - row[start]) % prime * down[start] % prime
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, none across rows, and each row's first word: ``bounds`` has one more entry than rows."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    left = np.empty(len(data), bool)
    left[0] = True
    left[1:] = ~solid[:-1]
    right = np.empty(len(data), bool)
    right[-1] = True
    right[:-1] = ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    left[inner] = True
    right[inner - 1] = True
    start = np.flatnonzero(solid & left)
    end = np.flatnonzero(solid & right) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = _powers(0xD6E8FEB86659FD93, k)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * up[j]
    return mix(out)


#: Distinct edges up to which one task takes a graph, in some tens of megabytes.
EDGES_AT_ONCE = 1_000_000


def _settled(batches):
    """The components of all edges that come, by hooking the larger root under the smaller until nothing moves."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while (after != after[after]).any():
            after = after[after]
        if (after == root).all():
            break
        root = after
    for k in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 16)]), pa.array(ids[root[k : k + (1 << 16)]])], ["node", "root"])


def components(edges: DataFrame, name: str = "components", rounds: int = 60, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """Connected components of an edge table ``(a, b)``: ``(node, root)``, root the smallest node reachable.

    A graph whose distinct edges are counted to be at most ``at_once`` is one task's, for a round of shuffles costs more
    than all of it. A larger one goes by rounds: each takes the smallest root among a node and its neighbours, hangs the
    old root under it, and then follows roots once, so that chains halve. Rounds are staged in the shared folder; the
    driver gets counts alone. Self-loops are allowed, repeated edges too; no edges give no rows. Both ways agree.
    """
    once = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if once.count() <= at_once:
        return staged(once.coalesce(1).mapInArrow(_settled, "node long, root long"), f"{name}-settled")
    both = staged(once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), f"{name}-0")
    for k in range(1, rounds):
        near = both.join(roots.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        low = roots.join(near.groupBy("node").agg(F.min("root").alias("low")), "node", "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("low"))
        hung = low.select(F.col("root").alias("node"), "low").union(low.select("node", "low")).groupBy("node").agg(F.min("low").alias("root"))
        jump = hung.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = hung.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"))
        after = staged(after.join(roots.withColumnRenamed("root", "was"), "node", "left"), f"{name}-{k}")
        roots, done = after.select("node", "root"), after.filter("root <> was").isEmpty()
        if done:
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Keys that are dealt over several tasks at most, and rows of one such key in each.
HOT_KEYS, HOT_ROWS = 1000, 1 << 12


def spread_join(rows: DataFrame, told: DataFrame, key: str, *apart: str) -> DataFrame:
    """``rows`` with what ``told`` says of their ``key``: ``count``, rows of each key, and further columns.

    A key that holds a large share of all rows would be one task's. The ``HOT_KEYS`` largest, a bounded list, are dealt
    over parts by the digest of the columns ``apart`` and told to each part; no other key can hold a thousandth of the rows.
    """
    hot = told.filter(F.col("count") > HOT_ROWS).orderBy(F.desc("count"), key).limit(HOT_KEYS).select(key, F.least(F.ceil(F.col("count") / HOT_ROWS), F.lit(1 << 14)).cast("int").alias("__parts"))
    hot = F.broadcast(staged(hot, "hot-keys"))
    own = F.pmod(F.xxhash64(*apart), F.col("__parts")).cast("int")
    left = rows.join(hot, key, "left").withColumn("__part", F.coalesce(own, F.lit(0))).drop("__parts")
    right = told.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Those columns alone, so that further ones with clashing names cannot meet."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def hex_id(c: Column) -> Column:
    return F.lower(F.hex(c))
