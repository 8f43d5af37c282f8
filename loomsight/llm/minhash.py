"""Near-duplicate documents by an LSH forest over word shingles.

Every document gets its set of distinct five-word shingles, a digest of the set and ``HASHES`` minimum hashes. Copies
of one set are one representative from here on. Each of ``TREES`` trees sorts the representatives by the signature
rotated to its own start; sets that share at least ``DEPTH`` leading values are candidates. A region of one prefix
with up to ``REGION`` sets is compared whole. A larger one is first walked in sorted order in overlapping blocks, which
joins hot groups of copies; if its sets are then still in different clusters, it is split by ``DEPTH`` further values
at each later place of the signature, again and again, until every part is compared whole or lies in one cluster:
depth follows density, in all orders at once. Candidates whose signatures agree in ``agreement(percent)`` values or more join a
candidate cluster (links that span it are kept, not all pairs). These links are confirmed on full sets first; where a
cluster is not one group of copies by then, all sets outside its largest group meet all its sets, block by block. The
confirmed links make the components.

With similarity s a pair shares no prefix in any tree with probability (1 - s**DEPTH)**TREES: 4e-7 at 0.85, 3e-5 at
0.80. If every prefix it shares is crowded and split k times, it needs k + 1 shared places of the ``HASHES // DEPTH``:
it has fewer with probability 1e-9, 2e-8, 2e-7 for k = 1, 2, 3 at 0.85, 1e-6, 1e-5, 9e-5 at 0.80. Its signatures
agree in too few places with probability 7e-6 at 0.85 for links at 85, and 4e-6 at 0.80 for links at 80.

Defined results: null or empty text, or text without words, has no shingles, is its own component and is kept; with
fewer than five words the whole sequence is the one shingle; repeated rows share their component and ``kept`` holds
for each row whose ``doc_id`` is the component's; rows that share a ``doc_id`` but not a text count as one document's texts;
a null ``doc_id`` takes its component from its copies, if any, and is kept without; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.llm.common import LOWER, chunks, components, mix, pick, prefix_hash, span_hash, staged, table, windows, words

WIDTH, HASHES, TREES, DEPTH = 5, 128, 20, 4
#: A pair at the limit is dropped for its signatures with at most this probability.
MISS = 8e-6
#: Trees that are walked before the others.
EARLY = 2
#: Representatives compared whole in the forest, the overlap of such blocks, and sets in a block of the confirmation.
REGION, OVERLAP, BLOCK = 256, 32, 48
#: Sets, about, of a crowded region's largest cluster that one part of the comparison with the other sets holds.
PART = 4096


def shingle_sets(batches, width: int = WIDTH):
    """Per row of ``(doc_id, text)``: the id and its sorted distinct shingle hashes."""
    for rows, data, offsets in chunks(batches, "text"):
        low = LOWER[data]
        start, end, bounds = words(low, offsets)
        h = span_hash(prefix_hash(low), start, end)
        runs = windows(h, width)
        for doc, a, b in zip(rows.column(0).to_pylist(), bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield doc, np.unique(runs[a : b - width + 1])
            elif b > a:
                yield doc, mix(np.array([windows(h[a:b], int(b - a))[0] ^ np.uint64(b - a)]))
            else:
                yield doc, np.zeros(0, np.uint64)


_RNG = np.random.default_rng(20240131)
_MULTIPLY = _RNG.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, 16 bits each."""
    low = np.full(HASHES, ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (_MULTIPLY[:, None] * shingles[None, at : at + 4096] + _ADD[:, None]).min(1), out=low)
    return (mix(low) >> np.uint64(48)).astype(">u2")


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, sig`` of every row."""

    def run(batches):
        import hashlib

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "n_shingles", "digest", "sig"])

        rows = []
        for doc, s in shingle_sets(batches):
            rows.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes() if len(s) else None))
            if len(rows) == 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _labels(link: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each under a symmetric boolean matrix."""
    n = len(link)
    link = link | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None, :], n).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _spanning(link: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links, as ends and ends, that connect what a symmetric boolean matrix connects, beside members of one ``group``."""
    n, left, right = len(link), [], []
    together = _labels(group[:, None] == group[None, :]) if group is not None else np.arange(n)
    while True:
        away = link & (together[:, None] != together[None, :])
        if not away.any():
            break
        # every group takes its link to the least other group, once
        other = np.where(away, together[None, :], n)
        to = other.argmin(1)
        best = other[np.arange(n), to]
        order = np.lexsort((np.arange(n), best, together))
        first = order[np.concatenate([[True], together[order[1:]] != together[order[:-1]]])]
        first = first[best[first] < n]
        left.append(first)
        right.append(to[first])
        joined = together[:, None] == together[None, :]
        near = np.zeros((n, n), bool)
        near[first, to[first]] = near[to[first], first] = True
        together = _labels(joined | near)
    if not left:
        return (np.zeros(0, np.int64),) * 2
    ends = np.stack([np.concatenate(left), np.concatenate(right)])
    return tuple(np.unique(np.sort(ends, 0), axis=1))


def agreement(percent: int) -> int:
    """Equal signature values that a candidate pair needs, for links at ``percent``: 90 at 85, 81 at 80."""
    p, below, k = percent / 100, 0.0, 0
    while k < HASHES and (below := below + comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)) <= MISS:
        k += 1
    return k


def forest_edges(reps: DataFrame, percent: int = 85) -> DataFrame:
    """Links ``(a, b)`` of sets alike in ``agreement(percent)`` places that span the candidate clusters of ``(rep, sig)``.

    The first ``EARLY`` trees are walked alone. What they connect is one group in the other trees, whose links only
    join groups: the links of a set that many trees find are few.
    """
    least = agreement(percent)
    size = 2 * DEPTH
    keys = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * size + 1, F.lit(size)).alias("prefix")))).alias("k")).select("rep", "k.*")
    shared = keys.groupBy("tree", "prefix").agg((F.count("*") > REGION).alias("crowded"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = keys.join(shared, ["tree", "prefix"]).select("rep", "tree", "crowded").join(reps, "rep")
    label = F.concat(F.substring("sig", F.col("tree") * size + 1, F.lit(2 * HASHES)), F.substring("sig", F.lit(1), F.col("tree") * size))
    rows = staged(placed.select("rep", "tree", label.alias("label"), "crowded"), "forest")

    def run(batches):
        carry = None
        for batch in chain(batches, [None]):
            if batch is None:
                if carry is not None:
                    yield from edges(carry)
                return
            rep, group = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            tree = batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").astype(np.uint16).reshape(-1, HASHES)
            if carry is not None:
                rep, tree, sig, group = (np.concatenate(x) for x in zip(carry, (rep, tree, sig, group)))
            new = np.flatnonzero((tree[1:] != tree[:-1]) | (sig[1:, :DEPTH] != sig[:-1, :DEPTH]).any(1)) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from edges((rep[:last], tree[:last], sig[:last], group[:last]))
            carry = (rep[last:], tree[last:], sig[last:], group[last:])
            if len(carry[0]) > 8 * REGION:  # a crowded region: what is settled goes
                yield from edges(carry)
                carry = tuple(x[-OVERLAP:] for x in carry)

    def edges(part):
        rep, tree, sig, group = part
        cut = np.flatnonzero((tree[1:] != tree[:-1]) | (sig[1:, :DEPTH] != sig[:-1, :DEPTH]).any(1)) + 1
        left, right = [], []
        for a, b in zip([0, *cut], [*cut, len(rep)]):
            for at in range(a, max(a + 1, b - OVERLAP), REGION - OVERLAP):
                to = min(b, at + REGION)
                s, r, g = sig[at:to], rep[at:to], group[at:to]
                if len(s) < 2 or (g == g[0]).all():
                    continue
                one, two = _spanning(np.stack([(s == x).sum(1) for x in s]) >= least, g)
                left.append(np.minimum(r[one], r[two]))
                right.append(np.maximum(r[one], r[two]))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    def walk(part: DataFrame, name: str) -> DataFrame:
        # a region that is compared whole has one key and stays together; a crowded one is dealt by its whole order
        order = F.when(F.col("crowded"), F.col("label")).otherwise(F.substring("label", F.lit(1), F.lit(size)))
        dealt = part.select("rep", "tree", "label", "group", order.alias("order")).repartitionByRange("tree", "order").sortWithinPartitions("tree", "label", "rep")
        return staged(dealt.select("rep", "tree", "label", "group").mapInArrow(run, "a long, b long").distinct(), name)

    early = walk(rows.filter(F.col("tree") < EARLY).withColumn("group", F.col("rep")), "walked-early")
    groups = components(early, "early").select(F.col("node").alias("rep"), F.col("root").alias("group"))
    late = walk(rows.filter(F.col("tree") >= EARLY).join(groups, "rep", "left").withColumn("group", F.coalesce("group", "rep")), "walked-late")
    walked = early.union(late)
    hot = rows.filter("crowded").select("rep", F.col("tree").alias("place"), F.concat(F.encode(F.col("tree").cast("string"), "utf-8"), F.substring("label", F.lit(1), F.lit(size))).alias("region"))
    if hot.isEmpty():
        return walked
    return walked.union(crowded_edges(hot, reps, components(walked, "walks"), least)).distinct()


def crowded_edges(hot: DataFrame, reps: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Edges within crowded regions ``(rep, place, region)`` whose sets are in different clusters ``(node, root)``.

    ``place`` is the last place of ``DEPTH`` values that the sets of a region share. A split at every later place keeps
    the sets that share the values there. A region is crowded while more than ``REGION`` of its sets lie outside its
    largest cluster, and is then split again; all others, and those where no place is left, are compared whole.
    """
    size, places = 2 * DEPTH, HASHES // DEPTH
    known = staged(reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "sig", F.coalesce("root", "rep").alias("root")), "crowded-sets")

    def sizes(parts: DataFrame) -> DataFrame:
        """Of each region with more than one cluster: its largest cluster, its sets and those outside that cluster."""
        each = parts.join(known.select("rep", "root"), "rep").groupBy("region", "root").agg(F.count("*").alias("n"))
        found = each.groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n"))
        return staged(found.filter("n > most").select("region", "top", "n", (F.col("n") - F.col("most")).alias("others")), "crowded-sizes")

    def run(batches):
        held: list = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(pa.Table.from_batches([batch]))
                rows = pa.concat_tables(held).combine_chunks()
                region = np.array(rows["region"].to_pylist(), object)
                cut = np.flatnonzero(region[1:] != region[:-1]) + 1
                last = int(cut[-1]) if len(cut) else 0
                held = [rows.slice(last)]
                rows = rows.slice(0, last)
            else:
                rows = pa.concat_tables(held) if held else None
            if rows is None or not rows.num_rows:
                continue
            region = np.array(rows["region"].to_pylist(), object)
            rep, root = rows["rep"].to_numpy(), rows["root"].to_numpy()
            other = np.array(rows["other"].to_pylist(), bool)
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), ">u2").astype(np.uint16).reshape(-1, HASHES)
            cut = np.flatnonzero(region[1:] != region[:-1]) + 1
            left, right = [], []
            for a, b in zip([0, *cut], [*cut, len(rep)]):
                for k in a + np.flatnonzero(other[a:b]):
                    own = a + np.flatnonzero(((sig[a:b] == sig[k]).sum(1) >= least) & (root[a:b] != root[k]))
                    own = own[np.unique(root[own], return_index=True)[1]]  # a link to each other cluster
                    left.append(np.full(len(own), rep[k]))
                    right.append(rep[own])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    found = []
    while True:
        # sets outside a region's largest cluster meet all its sets, which are dealt into parts of bounded size
        size_of = sizes(hot)
        end = F.col("place") == places - 1
        near = hot.join(size_of.filter(F.col("others") <= REGION).unionByName(size_of.filter(F.col("others") > REGION).join(hot.filter(end).select("region").distinct(), "region", "left_semi")), "region")
        near = near.join(known, "rep").withColumn("other", F.col("root") != F.col("top")).withColumn("deals", F.ceil(F.col("n") / PART).cast("int"))
        deal = F.when(F.col("other"), F.sequence(F.lit(0), F.col("deals") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("deals")).cast("int")))
        near = near.select("rep", "sig", "root", "other", "region", F.explode(deal).alias("deal")).withColumn("region", F.concat("region", F.encode(F.col("deal").cast("string"), "utf-8")))
        found.append(staged(near.select("rep", "sig", "root", "other", "region").repartition("region").sortWithinPartitions("region", "rep").mapInArrow(run, "a long, b long").distinct(), "crowded-edges"))
        crowded = size_of.filter(F.col("others") > REGION).select("region")
        rest = hot.filter(~end).join(crowded, "region")
        if rest.isEmpty():
            break
        to = F.explode(F.sequence(F.col("place") + 1, F.lit(places - 1))).alias("to")
        value = F.substring("sig", F.col("to") * size + 1, F.lit(size))
        parts = rest.join(known.select("rep", "sig"), "rep").select("rep", "sig", "region", to)
        hot = staged(parts.select("rep", F.col("to").alias("place"), F.unhex(F.md5(F.concat("region", F.encode(F.col("to").cast("string"), "utf-8"), value))).alias("region")), "crowded-parts")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def confirmed(found: DataFrame, clusters: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` that span the links of ``100 * intersection >= percent * union`` inside clusters ``(node, root)``.

    The candidate links ``found`` are confirmed one by one, which settles groups of copies with as many checks as they
    have sets. A cluster may then hold several groups; sets outside its largest one meet all its sets, as rows of two
    blocks dealt by hash, and a cluster that is one group needs nothing further.
    """

    def sets(batches):
        for batch in batches:
            doc = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "text"])
            own = [s.tobytes() for _, s in shingle_sets([doc])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.binary())], ["rep", "root", "shingles"])

    def check(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.array([_alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    def run(batches):
        for batch in batches:
            left, right = [], []
            for row in batch.to_pylist():
                both = row["one"] + row["two"]
                s = [np.frombuffer(x["shingles"], np.uint64) for x in both]
                n = np.array([len(x) for x in s])
                ids = np.unique(np.concatenate(s), return_inverse=True)[1]
                m = np.zeros((len(s), int(ids.max()) + 1), np.float32)
                m[np.repeat(np.arange(len(s)), n), ids] = 1
                common = np.rint(m @ m.T).astype(np.int64)
                rep, group = np.array([x["rep"] for x in both]), np.array([x["own"] for x in both])
                one, two = _spanning(100 * common >= percent * (n[:, None] + n[None, :] - common), group)
                left.append(rep[one])
                right.append(rep[two])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    members = docs.select(F.col("doc_id").alias("node"), "text").join(clusters, "node").select("node", "text", "root")
    known = staged(members.mapInArrow(sets, "rep long, root long, shingles binary"), "sets")
    one = known.select(F.col("rep").alias("a"), F.col("shingles").alias("one"))
    two = known.select(F.col("rep").alias("b"), F.col("shingles").alias("two"))
    first = staged(found.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(check, "a long, b long").distinct(), "confirmed")
    groups = components(first, "groups").select(F.col("node").alias("rep"), F.col("root").alias("own"))
    told = staged(known.select("rep", "root").join(groups, "rep", "left").withColumn("own", F.coalesce("own", "rep")), "told-apart")
    sizes = told.groupBy("root", "own").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("own", F.struct("n", "own")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n"))
    left = staged(sizes.filter("n > most").select("root", "top", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "unsettled")
    if left.isEmpty():
        return first
    rows = known.join(told.select("rep", "own"), "rep").join(left, "root").withColumn("i", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    item = F.struct("rep", "own", "shingles")
    dealt = staged(rows.groupBy("root", "blocks", "i").agg(F.collect_list(item).alias("one"), F.collect_list(F.when(F.col("own") != F.col("top"), item)).alias("two")), "blocks")
    # block pairs differ in size alone by their sets: they are dealt by both numbers, so a large cluster spreads
    others = dealt.filter(F.size("two") > 0).select("root", "two", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    pairs = dealt.select("root", "i", "one").join(others, ["root", "i"]).select("one", "two")
    return first.union(pairs.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; documents are linked at ``percent`` or more."""
    docs = pick(docs, "doc_id", "text")
    seen = staged(features(docs), "features")
    reps = staged(seen.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")).filter("rep is not null"), "representatives")
    found = staged(forest_edges(reps.select("rep", "sig"), percent), "candidates")
    clusters = components(found, "clusters")
    roots = components(confirmed(found, clusters, docs, percent), "links")
    own = reps.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    found = seen.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(own, "digest", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)
