"""Repeated substrings by column-wise construction of a collection's Burrows-Wheeler transform.

Every string of ``LENGTH`` bytes that starts at two or more places of the corpus is to be found. The text is first dealt
into short strings that the transform can take side by side: each window of ``LENGTH`` bytes has one anchor, its
least-hashed ``ANCHOR``-byte word, and neighbouring windows with one anchor form a segment. Equal windows have equal
anchors at equal places, so

* a segment whose anchor occurs once in the corpus holds no repeat and goes no further;
* the rest meet by anchor, equal segments as one with a weight, aligned at their anchors. Then ``ColumnBwt`` inserts one
  symbol of each string a round, from the right end to the left, and keeps the order of all suffixes and their longest
  common prefixes. Symbols are tagged with group and column, so a round's insertions are one block at the end of the
  transform: columns, transform and common prefixes are files that are read or written from front to back, and only the
  order of the strings stays in memory. A window is repeated if its weight is two or more or the common prefix with a
  neighbour reaches ``LENGTH``;
* an anchor with more than ``CROWD`` different segments (the edge of a passage in a great many documents) would land in
  one task. Its segments are dealt again by the digest of what a step of neighbouring windows has in common, and where steps
  differ beyond that, again by narrower ones down to the window; these are counted with partial sums, so no key is large.

Defined results: null or empty text has nothing to remove; texts shorter than ``LENGTH`` bytes neither; rows that repeat
are occurrences like any other; a null ``doc_id`` and repeated ``doc_id`` are allowed, rows are told apart by their text;
columns beyond ``doc_id`` and ``text`` are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.llm.common import chunks, mix, pick, prefix_hash, span_hash, spread_join, staged, table

LENGTH, ANCHOR = 200, 32
REACH = LENGTH - ANCHOR + 1
#: Different segments of one anchor that one task compares; strings the transform takes at once.
CROWD, STRINGS = 200, 16_384
#: Widths of the steps, in windows, by which crowded anchors are taken apart; the last must be one window.
STEPS = {"wide": 16, "near": 4, "single": 1}


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(keys)
    full = np.full(-(-n // width) * width, ~np.uint64(0))
    full[:n] = keys
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray):
    """Segments of the rows in ``data``: row, first window, windows, anchor's place in it, anchor hash, content hash."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hash(data)
    at = np.arange(len(data) - ANCHOR + 1)
    h = span_hash(prefix, at, at + ANCHOR)
    least = _least((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), REACH)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
    whole = np.arange(len(anchor)) + LENGTH <= offsets[row + 1]
    first = np.flatnonzero(whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]]))
    # a segment ends where the next one starts or where its row has no further whole window
    end = np.minimum(np.concatenate([first[1:], [len(anchor)]]), offsets[row[first] + 1] - LENGTH + 1)
    n, place, row = end - first, anchor[first] - first, row[first]
    g = span_hash(prefix, first, end - 1 + LENGTH)
    g ^= (place * 512 + n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row, first - offsets[row], n, place, h[anchor[first]], mix(g)


class ColumnBwt:
    """Transform and common prefixes of strings aligned at column 0, built from the right, one column a round.

    ``strings`` start at column ``-place``. ``group`` is non-decreasing; suffixes of different groups are not compared.
    ``rounds`` yields, per column, the strings in suffix order and the length each has in common with the one before it
    in its group. A finished column's symbols and common prefixes are appended to two files, in the order in which they were made.
    """

    def __init__(self, strings: list[bytes], place: np.ndarray, group: np.ndarray):
        self.n, self.place, self.group = len(strings), place.astype(np.int64), group
        size = np.fromiter(map(len, strings), np.int64, self.n)
        self.left, self.right = int(self.place.max(initial=0)), int((size - self.place).max(initial=0))
        self.end = size - self.place
        self.columns, self.bwt, self.lcp = (tempfile.TemporaryFile() for _ in range(3))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        off = np.concatenate([[0], np.cumsum(size)])
        for q in range(self.right - 1, -self.left - 1, -1):
            inside = (q >= -self.place) & (q < self.end)
            column = np.zeros(self.n, np.uint8)
            column[inside] = flat[(off[:-1] + q + self.place)[inside]]
            self.columns.write(column.tobytes())

    def rounds(self):
        self.columns.seek(0)
        order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for q in range(self.right - 1, -self.left - 1, -1):
            column = np.frombuffer(self.columns.read(self.n), np.uint8)
            stay = np.flatnonzero(q >= -self.place[order])
            if len(stay) < len(order):  # strings that have come to their first symbol leave
                common = np.minimum.reduceat(common, np.concatenate([[0], stay[:-1] + 1])) if len(stay) else common[:0]
                order = order[stay]
            new = np.flatnonzero(self.end == q + 1)
            if len(new):  # an empty suffix stands before all others of its group
                at = np.searchsorted(self.group[order], self.group[new], "left")
                order, common = np.insert(order, at, new), np.insert(common, at, 0)
                follows = at + np.arange(len(at)) + 1
                common[follows[follows < len(common)]] = 0
            if not len(order):
                continue
            key = self.group[order] * 256 + column[order]
            to = np.argsort(key, kind="stable")
            same = np.concatenate([[False], key[to[1:]] == key[to[:-1]]])
            after = np.zeros(len(order), np.int64)
            t = np.flatnonzero(same)
            if len(t):
                ends = np.stack([to[t - 1] + 1, to[t] + 1], 1).ravel()
                after[t] = 1 + np.minimum.reduceat(np.append(common, 0), ends)[::2]
            order, common = order[to], after
            self.bwt.write(column[order].tobytes())
            self.lcp.write(common.astype("<u2").tobytes())
            yield q, order, common

    def close(self) -> None:
        for f in (self.columns, self.bwt, self.lcp):
            f.close()


def repeated(strings: list[bytes], place: np.ndarray, windows: np.ndarray, weight: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string and each of its windows, whether it is repeated; a matrix with a column per window."""
    out = np.zeros((len(strings), int(windows.max(initial=0))), bool)
    many = weight > 1
    index = ColumnBwt(strings, place, group)
    try:
        for q, order, common in index.rounds():
            if q > 0:
                continue
            j = index.place[order] + q
            near = common >= length
            near[:-1] |= near[1:]
            hit = (near | many[order]) & (j >= 0) & (j < windows[order])
            out[order[hit], j[hit]] = True
    finally:
        index.close()
    return out


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of every run of true cells."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1] - start


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


_KEY = "d long, u long"
_SEGMENT = "d long, u long, a int, n int, place int, h long, g long"


def anchors(docs: DataFrame) -> DataFrame:
    """Every segment of ``(d, u, text)``."""

    def run(batches):
        for rows, data, offsets in chunks(batches, "text"):
            row, a, n, place, h, g = segments(data, offsets)
            if len(row):
                i32 = [pa.array(x.astype(np.int32)) for x in (a, n, place)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)), *i32, _signed(h), _signed(g)], ["d", "u", "a", "n", "place", "h", "g"])

    return docs.select("d", "u", "text").mapInArrow(run, _SEGMENT)


def _cut(batches):
    """Texts with their list of segments to the segments' bytes."""
    names = ["h", "g", "n", "place", "c", "crowded", "bytes"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for text, segs in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = text.as_py().encode()
            for s in segs:
                for k, name in enumerate(names[:-1]):
                    out[k].append(s[name])
                out[-1].append(raw[s["a"] : s["a"] + s["n"] - 1 + LENGTH])
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def _verdict(h, g, row, lo, n) -> pa.RecordBatch:
    pick_row = pa.array(row)
    return pa.RecordBatch.from_arrays([h.take(pick_row), g.take(pick_row), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "g", "lo", "n"])


def _compare(batches):
    """Segments sorted by anchor to the runs of repeated windows in each."""

    def settle(batch):
        h = batch.column(0).to_numpy()
        group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        marks = repeated(batch.column(5).to_pylist(), batch.column(3).to_numpy(), batch.column(2).to_numpy(), batch.column(4).to_numpy(), group)
        return _verdict(batch.column(0), batch.column(1), *_runs(marks))

    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows < STRINGS:
                continue
        if held is None:
            return
        cut = held.num_rows
        if batch is not None:  # the last anchor may go on
            h = held.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
        if cut:
            yield settle(held.slice(0, cut))
            held = held.slice(cut)


def _steps(width: int, whole: bool):
    """A function that cuts pieces ``(h, g, lo, n, at, c, bytes)`` into steps of ``width`` windows.

    Steps are aligned at the anchor (``at`` is the first window's place from it), so equal windows fall into equal steps,
    be their pieces of unequal extent. A step has the digest of the bytes that all windows of a full step share and the
    digest of all its own; its bytes go along if ``whole``.
    """

    def run(batches):
        for batch in batches:
            raw = batch.column(6).to_pylist()
            off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
            prefix = prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
            low, n, at = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
            first = at // width
            count = (at + n - 1) // width - first + 1
            rows = np.repeat(np.arange(len(raw)), count)
            step = (np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + first[rows]) * width - at[rows]
            a, b = np.maximum(step, 0), np.minimum(step + width, n[rows])
            core = span_hash(prefix, off[rows] + step + width - 1, off[rows] + step + LENGTH)
            own = span_hash(prefix, off[rows] + a, off[rows] + b - 1 + LENGTH) ^ (a - step + width * (b - a)).astype(np.uint64)
            r, i32 = pa.array(rows), lambda x: pa.array(x.astype(np.int32))
            columns = [batch.column(0).take(r), batch.column(1).take(r), i32(low[rows] + a), i32(b - a), i32(at[rows] + a), batch.column(5).take(r), _signed(core), _signed(mix(own))]
            names = ["h", "g", "lo", "n", "at", "c", "core", "own"]
            if whole:
                columns.append(pa.array([raw[k][i : j - 1 + LENGTH] for k, i, j in zip(rows.tolist(), a.tolist(), b.tolist())], pa.binary()))
                names.append("bytes")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _crowded(cut: DataFrame) -> DataFrame:
    """Runs of repeated windows of crowded anchors: ``h, g, lo, n``."""
    pieces = cut.select("h", "g", F.lit(0).alias("lo"), "n", (-F.col("place")).alias("at"), "c", "bytes")
    return _closer(pieces, list(STEPS.items())).select("h", "g", F.explode("runs").alias("r")).select("h", "g", "r.lo", "r.n")


def _closer(pieces: DataFrame, steps: list[tuple[str, int]]) -> DataFrame:
    """Per piece, told apart by ``h`` and ``g``, its runs of repeated windows: ``h, g, runs (lo, n)``.

    Pieces are cut into steps and equal steps become one with their weights summed, so copies cost nothing further on. A
    step whose core no other step shares holds no repeat; one whose core only ever has the same bytes around it is
    repeated whole; the others are looked at closer, with the next width.
    """
    (name, width), rest = steps[0], steps[1:]
    own, core = f"{name}_bytes", f"{name}_core"
    schema = "h long, g long, lo int, n int, at int, c long, core long, own long"
    where = pieces.mapInArrow(_steps(width, False), schema).select("h", "g", "lo", F.col("own").alias(own))
    cut = pieces.mapInArrow(_steps(width, True), schema + ", bytes binary").withColumnsRenamed({"own": own, "core": core})
    kinds = staged(cut.groupBy(own).agg(F.sum("c").alias("c"), *[F.min(x).alias(x) for x in (core, "n", "at", "bytes")]), f"kinds-{name}")
    shared = kinds.groupBy(core).agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).filter("total > 1").select(core, "kinds")
    kinds = staged(kinds.join(shared, core).select(F.col(own).alias("h"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("lo"), "n", "at", "c", "bytes", "kinds"), f"shared-{name}")
    verdict = kinds.filter("kinds = 1").select("h", F.array(F.struct("lo", "n")).alias("runs"))
    if rest:
        verdict = verdict.unionByName(_closer(kinds.filter("kinds > 1").drop("kinds"), rest).select("h", "runs"))
    found = where.join(verdict.withColumnRenamed("h", own), own)
    runs = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("lo")).alias("lo"), r["n"].alias("n")))
    return staged(found.select("h", "g", runs.alias("runs")).groupBy("h", "g").agg(F.flatten(F.collect_list("runs")).alias("runs")), f"runs-{name}")


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("d"), F.xxhash64("text").alias("u"), "doc_id", "text")


def repeats(docs: DataFrame) -> DataFrame:
    """``d, u, runs``: per row with repeats, the runs (first window, windows) of its repeated windows."""
    docs = _keyed(docs)
    all_segments = anchors(docs.filter(F.octet_length("text") >= LENGTH))
    shared = staged(all_segments.groupBy("h").count().filter("count > 1"), "anchors")
    found = staged(spread_join(all_segments, shared, "h", "d", "u", "a").drop("count"), "segments")
    kinds = staged(found.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("d", "u", "a", "n", "place")).alias("at")), "kinds")
    per = staged(kinds.groupBy("h").count(), "kinds-of-anchors")
    kinds = spread_join(kinds, per, "h", "g").withColumnRenamed("count", "kinds")
    sole = kinds.filter("kinds = 1").select("h", "g", F.lit(0).alias("lo"), F.col("at.n").alias("n"))
    item = F.struct("h", "g", F.col("at.a").alias("a"), F.col("at.n").alias("n"), F.col("at.place").alias("place"), "c", (F.col("kinds") > CROWD).alias("crowded"))
    wanted = kinds.filter("kinds > 1").groupBy(F.col("at.d").alias("d"), F.col("at.u").alias("u")).agg(F.collect_list(item).alias("segs"))
    texts = docs.select("d", "u", "text").join(wanted, ["d", "u"]).select("text", "segs")
    cut = staged(texts.mapInArrow(_cut, "h long, g long, n int, place int, c long, crowded boolean, bytes binary"), "cut")
    compared = cut.filter("not crowded").drop("crowded").repartition("h").sortWithinPartitions("h", "g").mapInArrow(_compare, "h long, g long, lo int, n int")
    runs = staged(compared.unionByName(_crowded(cut.filter("crowded"))).unionByName(sole).groupBy("h", "g").agg(F.collect_list(F.struct("lo", "n")).alias("runs")), "verdicts")
    placed = found.select("d", "u", "a", "h", "g").join(runs, ["h", "g"]).select("d", "u", F.transform("runs", lambda r: F.struct((r["lo"] + F.col("a")).alias("at"), r["n"].alias("n"))).alias("runs"))
    return placed.groupBy("d", "u").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _spans(size: int, runs: list[dict] | None) -> list[tuple[int, int]]:
    """The bytes that repeated windows cover, as maximal spans in order."""
    out: list[list[int]] = []
    for at, n in sorted((r["at"], r["n"]) for r in runs or ()):
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at + n - 1 + LENGTH)
        else:
            out.append([at, at + n - 1 + LENGTH])
    return [(a, min(b, size)) for a, b in out]


def _joined(docs: DataFrame, *more: str) -> DataFrame:
    found = staged(repeats(docs), "repeats")
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("__d"), F.xxhash64("text").alias("__u"), "doc_id", "text", *more)
    return keyed.join(found.select(F.col("d").alias("__d"), F.col("u").alias("__u"), F.col("runs").alias("__runs")), ["__d", "__u"], "left").drop("__d", "__u")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                spans = _spans(len(raw), runs.as_py())
                kept, at = hashlib.sha256(), 0
                for a, b in [*spans, (len(raw), len(raw))]:
                    kept.update(raw[at:a])
                    at = b
                out.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(pick(docs, "doc_id", "text")).select("doc_id", "text", "__runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut from ``text``; whole characters only, other columns as they are."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches):
        for batch in batches:
            k, r = batch.schema.get_field_index("text"), batch.schema.get_field_index("__runs")
            texts = []
            for text, runs in zip(batch.column(k).to_pylist(), batch.column(r).to_pylist()):
                if text is not None and runs:
                    raw, kept, at = text.encode(), [], 0
                    for a, b in _spans(len(raw), runs):
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        kept.append(raw[at:a])
                        at = b
                    text = b"".join([*kept, raw[at:]]).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == k else c for i, c in enumerate(batch.columns) if i != r]
            yield pa.RecordBatch.from_arrays(columns, [n for i, n in enumerate(batch.schema.names) if i != r])

    joined = _joined(docs, *[F.col(f"`{c}`") for c in more])
    out = joined.drop("__runs").schema
    return joined.mapInArrow(run, out).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
