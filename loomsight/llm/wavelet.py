"""Token ids in wavelet-matrix shard files: access, counting and occurrence lookup from one compressed file.

Texts are encoded where they are read. The ids, not the texts, are then dealt by ranges of ``doc_id``, and each run of
about ``SHARD`` ids becomes one file: a header, the document lengths, and one bit-plane per bit of an id, highest first.
At each level the ids whose bit is 0 go, in order, before those whose bit is 1; ranks over the planes then answer every
query. A plane is stored in blocks of ``BLOCK`` bits, each compressed alone, with a directory of the ranks before each
block and of where it stands: ``access``, ``count`` and ``find`` read the directory and the blocks they need, no more.

Files travel as binary cells of a table in the shared folder, one file a row, so any store that Spark writes will do.

Defined results: a null or empty text is its end id alone; rows of one ``doc_id`` follow their ids, repeated rows each
have their place, and a ``doc_id`` that many rows share, null included, is dealt over several parts; a null ``doc_id``
comes first; other columns are ignored; an empty table gives no files and no rows. A very long document is encoded in
pieces and makes its file longer; it is never cut.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsight.llm.common import chunks, pick, prefix_hash, span_hash, staged, table

MAGIC = b"LWM2"
HEAD = struct.Struct("<4sBQQQ")
#: Ids after which a shard file ends, at the end of a document.
SHARD = 1 << 20
#: Bits of a block of a plane, and opened blocks that a reader keeps.
BLOCK, OPEN = 1 << 15, 256
END_ID = 0
#: Bytes of text that are encoded at once, and pieces whose ids a worker keeps (at most half of the slots).
TEXT_BYTES, PIECES = 1 << 20, 1 << 20
#: Parts for each shuffle partition, so that they spread evenly.
PARTS = 4


def pack(ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    """A shard file of ``ids``, which are below ``2**bits``, and the lengths of the documents they belong to."""
    z = zstandard.ZstdCompressor(level=1)
    kind = np.uint16 if bits <= 16 else np.uint32
    docs = z.compress(lengths.astype("<u8").tobytes())
    out, now = [HEAD.pack(MAGIC, bits, len(ids), len(lengths), len(docs)), docs], ids.astype(kind)
    for level in range(bits - 1, -1, -1):
        one = (now & kind(1 << level)) != 0
        raw = np.packbits(one).tobytes()
        blocks = []
        for at in range(0, len(raw), BLOCK // 8):
            part = raw[at : at + BLOCK // 8]
            small = z.compress(part)
            blocks.append(small if len(small) < len(part) else part)
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(one, np.arange(0, len(one), BLOCK), dtype=np.int64))]) if len(one) else np.zeros(1)
        places = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        out += [np.stack([ranks, places]).astype("<u8").tobytes(), *blocks]
        now = np.concatenate([now.take(np.flatnonzero(~one)), now.take(np.flatnonzero(one))])
    return b"".join(out)


class WaveletMatrix:
    """A shard file: its header and directories are read at once, blocks of the planes when they are needed."""

    def __init__(self, blob: bytes):
        magic, self.bits, self.n, docs, size = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.blob, self.opened, at = blob, {}, HEAD.size + size
        self.zstd = zstandard.ZstdDecompressor()
        self.lengths = np.frombuffer(self.zstd.decompress(blob[HEAD.size : at]), "<u8").astype(np.int64)
        assert len(self.lengths) == docs
        entries = -(-self.n // BLOCK) + 1
        self.ranks, self.places = [], []
        for _ in range(self.bits):
            ranks, places = np.frombuffer(blob, "<u8", 2 * entries, at).astype(np.int64).reshape(2, entries)
            at += 16 * entries
            self.ranks.append(ranks)
            self.places.append(places + at)
            at += int(places[-1])
        self.zeros = [self.n - int(r[-1]) for r in self.ranks]

    def _read(self, level: int, block: int) -> bytes:
        a, b = self.places[level][block : block + 2].tolist()
        size = (min(BLOCK, self.n - block * BLOCK) + 7) // 8
        part = self.blob[a:b]
        return part if b - a == size else self.zstd.decompress(part, max_output_size=size)

    def _block(self, level: int, block: int) -> np.ndarray:
        found = self.opened.get((level, block))
        if found is None:
            if len(self.opened) >= OPEN:
                self.opened.clear()
            found = self.opened[level, block] = np.frombuffer(self._read(level, block), np.uint8)
        return found

    def ids(self) -> np.ndarray:
        """All ids in order: places go down the levels as the ids did, and take the bits they meet along."""
        now, place = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32), np.arange(self.n, dtype=np.uint32 if self.n < 1 << 32 else np.int64)
        for level in range(self.bits):
            plane = b"".join(self._read(level, k) for k in range(len(self.ranks[level]) - 1))
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n).view(bool)
            now = now << now.dtype.type(1) | one
            to = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            now, place = now.take(to), place.take(to)
        out = np.empty_like(now)
        out[place] = now
        return out

    def _rank1(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        n = int(self.ranks[level][block])
        if not rest:
            return n
        plane = self._block(level, block)
        n += int(np.bitwise_count(plane[: rest // 8]).sum(dtype=np.int64))
        return n + (int(plane[rest // 8]) >> (8 - rest % 8)).bit_count() if rest % 8 else n

    def _bit(self, level: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        return int(self._block(level, block)[rest // 8]) >> (7 - rest % 8) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _walk(self, token: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, i), self._rank1(level, j)
            if token >> (self.bits - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often ``token`` stands in positions ``i`` to ``j``."""
        if token >> self.bits:
            return 0
        a, b = self._walk(token, i, self.n if j is None else j)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) such bit of a plane."""
        ranks = self.ranks[level]
        seen = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(seen, k, "right")) - 1
        part = np.unpackbits(self._block(level, block))
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(seen[block])])

    def find(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._walk(token, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                i = self._select(level, 1, i - self.zeros[level])
            else:
                i = self._select(level, 0, i)
        return i


class _Seen:
    """Digests of pieces to numbers, in open addressing; looked up and filled by whole arrays."""

    def __init__(self):
        self.bits = (2 * PIECES - 1).bit_length()
        self.key, self.number, self.n = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers, -1 for what is not there. A key is never 0."""
        slot, mask = (key >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        there = self.key.take(slot)
        out = np.where(there == key, self.number.take(slot), -1)
        left = np.flatnonzero((there != key) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            there = self.key[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.number[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, key: np.ndarray) -> None:
        """Numbers new, distinct keys in their order."""
        slot, mask = (key >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            free = self.key[at] == 0
            self.key[at[free]] = key[left[free]]
            won = self.key[at] == key[left]
            self.number[at[won]] = self.n + left[won]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask
        self.n += len(key)


#: Kinds of bytes by which texts are cut: letters, digits, signs, apostrophe, blank, line end; all else is 0.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BLANK, _LINE = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3:0xC9] = _LETTER
_KIND[39], _KIND[32], _KIND[10] = _APOSTROPHE, _BLANK, _LINE
#: Whether a piece may begin between two kinds. Kind 0 is never cut beside, an apostrophe never behind.
_CUT = np.zeros(64, bool)
for _a in range(1, 5):
    for _b in range(1, 7):
        _CUT[_a << 3 | _b] = _b >= _BLANK or _a != _b and _a != _APOSTROPHE and (_b != _APOSTROPHE or _a != _SIGN)


def cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in UTF-8 ``data`` whose rows begin at ``starts``, and the kinds of the bytes.

    Byte-level files of this family split a text into blanks with the letters, digits or signs behind them. Pieces begin
    only where such a split is certain from the bytes beside it, so each encodes alone as it does in its text.
    """
    kind = _KIND.take(data)
    if len(data) and data.max() > 127:
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
        lead = lead[lead + 1 < len(data)]
        sign = (data[lead] == 0xC3) & np.isin(data[lead + 1], (0x97, 0xB7))
        kind[lead[sign]] = 0
        kind[lead[~sign] + 1] = _LETTER
    begin = np.zeros(len(data), bool)
    begin[1:] = _CUT.take(kind[:-1] << 3 | kind[1:])
    begin[starts[starts < len(data)]] = True
    line = np.flatnonzero(kind == _LINE)
    line = line[line + 1 < len(data)]
    behind = kind[line + 1]
    line = line[begin[line] & (behind > 0) & (behind < _BLANK)]
    begin[line + 1] = True
    return np.flatnonzero(begin), kind


class ByteTokens:
    """The tokenizers library on a byte-level file, asked once for each different piece while a worker remembers it.

    Texts are cut into pieces (``cuts``); pieces are told apart by 64-bit digests of their bytes. Those new to the worker
    go to the library, in one call where its splitting is still to be done, and to its model where a piece is one
    blank at most and one kind of characters. What is remembered is bounded; when full, it starts afresh.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        from loomsight.llm.bpe import byte_letters

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError("not a plain byte-level file")
        # the library's model without its cache, which locks and would only repeat the one here
        self.model = BPE(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], cache_capacity=0, ignore_merges=model.get("ignore_merges", False))
        self.library.no_padding()
        self.library.no_truncation()
        self.bits = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u4")
        self._forget()

    def _forget(self) -> None:
        self.seen = _Seen()
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.first, self.many = np.zeros(PIECES, np.int64), np.zeros(PIECES, np.int64)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def _new(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        """The ids of new pieces."""
        bare = start + ((kind[start] == _BLANK) & (end - start > 1))
        change = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])
        plain = (kind[bare] >= _LETTER) & (kind[bare] <= _SIGN) & (change[end - 1] == change[bare])
        text, tokenize = self.letters.take(data).tobytes().decode("utf-32-le"), self.model.tokenize
        out: list = [[t.id for t in tokenize(text[a:b])] if p else None for a, b, p in zip(start.tolist(), end.tolist(), plain.tolist())]
        odd = np.flatnonzero(~plain)
        if len(odd):
            asked = [data[a:b].tobytes().decode() for a, b in zip(start[odd].tolist(), end[odd].tolist())]
            for k, found in zip(odd.tolist(), self.library.encode_batch_fast(asked, add_special_tokens=False)):
                out[k] = found.ids
        return out

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows that begin at ``starts``, and how many ids each row has."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(starts), np.int64)
        start, kind = cuts(data, starts)
        end = np.append(start[1:], len(data))
        key = span_hash(prefix_hash(data), start, end)
        key[key == 0] = 1
        number = self.seen.find(key)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            if self.seen.n + len(new) > PIECES:
                self._forget()
                miss = np.arange(len(key))
                new, first, back = np.unique(key, return_index=True, return_inverse=True)
            found = self._new(data, kind, start[miss[first]], end[miss[first]])
            many = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), self.kind, int(many.sum()))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), self.kind)])
            self.ids[self.used : self.used + len(flat)] = flat
            own = slice(self.seen.n, self.seen.n + len(new))
            self.first[own], self.many[own] = self.used + np.cumsum(many) - many, many
            number[miss] = self.seen.n + back
            self.used += len(flat)
            self.seen.add(new)
        many = self.many.take(number)
        to = np.cumsum(many)
        at = np.repeat(self.first.take(number) - (to - many), many) + np.arange(int(to[-1]))
        upto = np.concatenate([[0], to])
        bound = upto[np.searchsorted(start, np.append(starts, len(data)))]
        return self.ids.take(at), np.diff(bound)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The ids of a long text, in stretches that end where pieces do."""
        out, at = [np.zeros(0, self.kind)], 0
        while at < len(data):
            size = TEXT_BYTES
            while True:
                part = data[at : at + size]
                if at + size >= len(data):
                    to = len(part)
                    break
                # what stands beside the end is not seen here: the last piece waits for it
                start = cuts(part, np.zeros(1, np.int64))[0]
                to = int(start[start < len(part) - 2][-1])
                if to:
                    break
                size *= 2
            out.append(self._pieces(part[:to], np.zeros(1, np.int64))[0])
            at += to
        return np.concatenate(out)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each with the end id behind it, and how many ids each row has."""
        raw = data.tobytes()
        alone: dict[int, np.ndarray] = {}
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if row not in alone:
                    alone[row] = self._whole(raw[offsets[row] : offsets[row + 1]])
                at = raw.find(special, int(offsets[row + 1]))
        if len(offsets) == 2:
            ids = alone[0] if alone else self._long(data)
            return np.append(ids, self.kind.type(END_ID)), np.array([len(ids) + 1])
        ids, many = self._pieces(data, offsets[:-1])
        out = np.insert(ids, np.cumsum(many), self.kind.type(END_ID))
        many += 1
        if alone:
            parts = np.split(out, np.cumsum(many)[:-1])
            for row, found in alone.items():
                parts[row] = np.append(found, self.kind.type(END_ID))
                many[row] = len(parts[row])
            out = np.concatenate(parts)
        return out, many

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.rows(raw, np.array([0, len(raw)]))[0][:-1].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteTokens:
    return ByteTokens(path)


def _binaries(flat: np.ndarray, many: np.ndarray) -> pa.Array:
    """Rows of ``many`` numbers each as one binary cell a row."""
    off = np.concatenate([[0], np.cumsum(many)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``part, doc_id, ids``: each text's ids with the end id, and the part of the range of ``doc_id`` it belongs to.

    Parts are ranges between approximate quantiles of ``doc_id``; a value that fills several of them is dealt over these
    by the digest of its ids, and a null ``doc_id`` over parts of its own before all others.
    """
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    bounds = np.array(docs.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0] or [], np.int64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = load(path)
        for rows, data, offsets in chunks(batches, "text", TEXT_BYTES):
            ids, many = tokens.rows(data, offsets)
            doc = rows.column(0)
            known = doc.fill_null(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
            null = doc.is_null().to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(many)])
            for k in np.flatnonzero(null | (high > low)).tolist():
                digest = zlib.crc32(ids[off[k] : off[k + 1]].tobytes())
                low[k] = -1 - digest % parts if null[k] else low[k] + digest % (high[k] - low[k] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(low.astype(np.int64)), doc, _binaries(ids, many)], ["part", "doc_id", "ids"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "part long, doc_id long, ids binary")


def write_shards(docs: DataFrame, path: str, shard: int = SHARD, name: str = "wavelet") -> DataFrame:
    """Encodes and writes; the table of files ``part, seq, before, n_tokens, doc_ids, file``, ``before`` counting the part's ids before the file's."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = load(path)
        kinds = [("part", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("file", pa.binary())]
        part, seq, before, held, doc_ids, size = None, 0, 0, [], [], 0

        def file() -> pa.RecordBatch:
            lengths = np.array([len(x) // tokens.kind.itemsize for x in held])
            blob = pack(np.frombuffer(b"".join(held), tokens.kind), lengths, tokens.bits)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_tokens": size, "doc_ids": doc_ids, "file": blob}], pa.schema(kinds))

        for batch in batches:
            for own, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and (own != part or size >= shard):
                    yield file()
                    seq, before, held, doc_ids, size = seq + 1, before + size, [], [], 0
                if own != part:
                    part, seq, before = own, 0, 0
                held.append(ids.as_py())
                doc_ids.append(doc)
                size += len(held[-1]) // tokens.kind.itemsize
        if held:
            yield file()

    ordered = encoded(docs, path).repartition("part").sortWithinPartitions("part", "doc_id", "ids")
    return staged(ordered.mapInArrow(run, "part long, seq long, before long, n_tokens long, doc_ids array<long>, file binary"), name)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    A file knows the ids before it in its part; only the sums by part, a few for each shuffle partition, are broadcast.
    """
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    parts = sizes.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    placed = shards.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "file")

    def run(batches):
        for batch in batches:
            for base, doc_ids, file in zip(*(batch.column(k) for k in range(3))):
                m = WaveletMatrix(file.as_py())
                raw, ends = memoryview(m.ids().astype("<u4")).cast("B"), np.cumsum(m.lengths)
                starts = ends - m.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(starts + base.as_py()), pa.array(m.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
