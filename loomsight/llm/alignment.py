"""Cross-tokenizer alignment: where two tokenizers end tokens at the same byte, and which ids that links.

Python tokenises and numbers the bytes of a text at which tokens end; a token is one number, of that place and the ids that
end there. All that follows is Spark's array and higher-order functions. What both sides have (``array_intersect``) are the
cuts that part a text into groups, with their last tokens; what no cut is (``array_except``) stands in groups with more than
one token on a side, and only those are taken apart, by place: no search, no square. Links are the pairs within a group.
Counts of id pairs over documents are one aggregate; each document's links meet them as a broadcast of at most
``BROADCAST_PAIRS`` counted pairs, or, beyond, in a join whose common pairs are dealt over parts. Both ways are tested to agree.

Defined results: a text that is null or empty, or whose tokens do not join to a blank and the text on either side (one
that holds U+2581 itself), has no tokens: zeros and an empty digest. Special tokens' strings are plain text. Every row is
a document, repeated and null ``doc_id`` too. Other columns are ignored; an empty table gives none. Texts are never cut:
a row's tokens, groups and links are that row's task's. A file with more ids than ``2**ID_BITS - 1``, or a text with
more ends than ``2**PLACE_BITS``, is an error.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.llm import wavelet
from loomsight.llm.common import chunks, pick, prefix_hash, span_hash, spread_join, staged, table

#: Counted id pairs up to which they are broadcast, in some 80 MB.
BROADCAST_PAIRS = 1 << 21
#: Bits of an id and of a place in one number; an id of ones alone stands for none.
ID_BITS, PLACE_BITS = 18, 27
NONE, PAIR = (1 << ID_BITS) - 1, (1 << 2 * ID_BITS) - 1
#: Words whose pieces a worker remembers (at most half of the slots), and bytes of text encoded at once.
WORDS, TEXT_BYTES = wavelet.PIECES, 1 << 18
#: Ids that a worker remembers.
IDS = 1 << 23

_BLANK = "▁"


class PieceTokens:
    """A sentencepiece BPE file whose pieces hold blanks at their begin alone, so words encode alone as in their text.

    Words, with the blanks before them, are told apart by 64-bit digests and looked up by whole arrays. What is remembered
    is bounded; when full, it starts afresh.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError("pieces with blanks inside")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.fromiter(map(len, self.bytes), np.int32, len(pieces))
        self._forget()

    def _forget(self) -> None:
        self.seen, self.used = wavelet._Seen(), 0
        self.flat, self.first, self.many, self.odd = np.zeros(1 << 12, np.int32), *(np.zeros(1 << 10, t) for t in (np.int64, np.int64, bool))

    def _learn(self, words: list[bytes]) -> None:
        """The pieces of words that have none, by one call of the library."""
        # the library puts the first blank back, but before nothing
        blank, number = [self.library.piece_to_id(_BLANK)], self.seen.n
        found = [ids if len(w) > 1 else blank for w, ids in zip(words, self.library.encode([w[1:].decode() for w in words], num_threads=1))]
        many = np.fromiter(map(len, found), np.int64, len(found))
        while self.used + int(many.sum()) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while number + len(words) > len(self.first):
            self.first, self.many, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.many, self.odd))
        own = slice(number, number + len(words))
        self.first[own], self.many[own] = self.used + np.cumsum(many) - many, many
        self.odd[own] = [b"".join([self.bytes[i] for i in ids]) != w for w, ids in zip(words, found)]
        self.flat[self.used : self.used + int(many.sum())] = [i for ids in found for i in ids]
        self.used += int(many.sum())

    def _words(self, raw: bytes, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of at most ``WORDS`` words, how many each has, and whether they differ from it when joined."""
        number = self.seen.find(key)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            if self.seen.n + len(new) > WORDS or self.used > IDS:
                self._forget()
                miss = np.arange(len(key))
                new, first, back = np.unique(key, return_index=True, return_inverse=True)
            self._learn([raw[x:y] for x, y in zip(start[miss[first]].tolist(), end[miss[first]].tolist())])
            number[miss] = self.seen.n + back
            self.seen.add(new)
        many = self.many.take(number)
        at = np.repeat(self.first.take(number) - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return self.flat.take(at), many, self.odd.take(number)

    def rows(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, how many each has, and whether they join to a blank and the text."""
        full = np.flatnonzero(np.diff(offsets))
        good = np.ones(len(offsets) - 1, bool)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(good), np.int64), good
        data = np.insert(np.frombuffer(raw, np.uint8), offsets[full], 32)
        rows = offsets[full] + np.arange(len(full))
        begin = data == 32
        begin[1:] &= ~begin[:-1]
        begin[rows] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        key = span_hash(prefix_hash(data), start, end)
        key[key == 0] = 1
        text = data.tobytes()
        parts = [self._words(text, key[k : k + WORDS], start[k : k + WORDS], end[k : k + WORDS]) for k in range(0, len(start), WORDS)]
        ids, many, odd = (np.concatenate(x) for x in zip(*parts))
        of = full[np.searchsorted(rows, start, "right") - 1]
        for k in np.unique(of[odd]).tolist():
            own = ids[np.repeat(of == k, many)]
            good[k] = b"".join(self.bytes[i] for i in own.tolist()) == b" " + raw[offsets[k] : offsets[k + 1]]
        keep = good[of]
        return ids[np.repeat(keep, many)], np.bincount(of[keep], many[keep], len(good)).astype(np.int64), good


class ByteSide:
    """A byte-level file on a blank and the text, special tokens' strings as plain text."""

    def __init__(self, path: str):
        self.tokens = wavelet.ByteTokens(path)
        self.tokens.library.encode_special_tokens = True
        self.tokens.specials = []
        vocabulary = self.tokens.library.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int32)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # a character is a byte

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, many = self.tokens.rows(np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets)))
        own = np.ones(len(ids), bool)
        own[np.cumsum(many) - 1] = False
        return ids[own].astype(np.int32), many - 1


@lru_cache(maxsize=2)
def _sides(a: str, b: str) -> tuple[ByteSide, PieceTokens]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    left, right = ByteSide(a), PieceTokens(b)
    if max(len(left.size), len(right.size)) > NONE:
        raise ValueError(f"more than {NONE} ids")
    return left, right


TOKENS = "row long, doc_id long, a array<bigint>, b array<bigint>, ends array<bigint>"


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def tokenised(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``row, doc_id``, each side's tokens and all ends of every row; ``a`` a byte-level file, ``b`` a sentencepiece model.

    An end is a byte at which a token ends, on either side: from the highest bit on its place among the row's ends, the id
    of ``a`` and the id of ``b`` that end there, ``NONE`` for none. A side's tokens are the ends that have its id.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        left, right = _sides(a, b)
        for rows, data, offsets in chunks(batches, "text", TEXT_BYTES):
            b_ids, b_many, good = right.rows(data.tobytes(), offsets)
            a_ids, a_many = left.rows(data, offsets)
            keep = good & (np.diff(offsets) > 0)
            a_ids, a_many = a_ids[np.repeat(keep, a_many)], a_many * keep
            # rows that are kept are as long on either side, so the last bytes of their tokens are told over all rows at once
            bytes_ = np.concatenate([[0], np.cumsum((np.diff(offsets) + 1) * keep)])
            by_byte = np.full(int(bytes_[-1]), PAIR, np.int64)
            by_byte[np.cumsum(left.size[a_ids], dtype=np.int64) - 1] = a_ids.astype(np.int64) << ID_BITS | NONE
            by_byte[np.cumsum(right.size[b_ids], dtype=np.int64) - 1] += b_ids.astype(np.int64) - NONE
            at = np.flatnonzero(by_byte != PAIR)
            ends, upto = by_byte[at], np.searchsorted(at, bytes_)
            if np.diff(upto).max(initial=0) > 1 << PLACE_BITS:
                raise ValueError(f"a text with more than {1 << PLACE_BITS} ends")
            of_a, of_b = ends >> ID_BITS != NONE, ends & NONE != NONE
            ends |= (np.arange(len(ends)) - np.repeat(upto[:-1], np.diff(upto))) << 2 * ID_BITS
            lists = [_lists(np.concatenate([[0], np.cumsum(a_many)]), ends[of_a]), _lists(np.concatenate([[0], np.cumsum(b_many)]), ends[of_b]), _lists(upto, ends)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], ["row", "doc_id", "a", "b", "ends"])

    numbered = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, TOKENS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def grouped(tokens: DataFrame) -> DataFrame:
    """``row, doc_id, g`` with ``g.n_a, g.n_b, g.n_groups, g.n_links, g.groups_sha256``, ``g.pairs``: a pair's ids in one
    number, the first above ``ID_BITS`` bits, an entry for each link.

    A group ends at a cut, where both sides end a token. Ends that are none (``loose``) stand in runs of neighbouring places,
    and such a run with the cut behind it is a group of more than two tokens; the other groups are a token on either side,
    and their cut alone tells both: the text is put together from stretches of these and the larger groups between them.

    Each step is a projection of its own, so that what comes next reads plain arrays. Lambdas are kept to few nodes.
    """
    left, right = lambda x: F.shiftright(x, ID_BITS).bitwiseAND(F.lit(NONE)), lambda x: x.bitwiseAND(F.lit(NONE))
    cut = tokens.select("*", F.array_intersect("a", "b").alias("cut"))
    loose = cut.select("*", F.transform("cut", lambda x: x.bitwiseAND(F.lit(PAIR))).alias("last"), F.transform(F.array_except("ends", "cut"), lambda x: F.shiftright(x, 2 * ID_BITS).cast("int")).alias("loose"))
    # where a run begins: its first place, and how many loose ends and how many cuts stand before it
    met = loose.select("*", F.transform("loose", lambda k, n: F.struct(k.alias("place"), n.alias("nth"), (k - n).alias("cuts"))).alias("met"))
    run = let(F.concat(F.array(F.lit(-2)), "loose"), lambda was: F.filter("met", lambda x: x["place"] - F.get(was, x["nth"]) != 1))
    runs = met.select("row", "doc_id", "a", "b", "ends", "last", F.size("loose").alias("n_loose"), run.alias("runs"))

    def group(runs: Column, x: Column, k: Column) -> Column:
        own = F.slice("ends", x["place"] + 1, F.coalesce(F.get(runs, k + 1)["nth"], "n_loose") - x["nth"] + 1)
        of = lambda side: F.array_remove(F.transform(own, side), F.lit(NONE).cast("long"))
        return F.struct(of(left).alias("a"), of(right).alias("b"))

    rest = let(F.col("runs"), lambda runs: F.transform(runs, lambda x, k: group(runs, x, k)))
    stretch = lambda runs, g, k: F.slice("last", F.coalesce(F.get(runs, k - 1)["cuts"] + 2, F.lit(1)), g - F.coalesce(F.get(runs, k - 1)["cuts"] + 1, F.lit(0)))
    told = lambda p: F.concat(F.shiftright(p, ID_BITS).cast("string"), F.lit("|"), right(p).cast("string"))
    between = let(F.col("runs"), lambda runs: F.transform(F.concat(F.transform(runs, lambda x: x["cuts"]), F.array(F.size("last"))), lambda g, k: F.array_join(F.transform(stretch(runs, g, k), told), ";")))
    parts = runs.select("row", "doc_id", "a", "b", "last", rest.alias("rest"), between.alias("between"))
    joined = lambda x: F.array_join(x.cast("array<string>"), ",")
    others = F.concat(F.transform("rest", lambda x: F.concat(joined(x["a"]), F.lit("|"), joined(x["b"]))), F.array(F.lit("")))
    text = F.array_join(F.array_remove(F.flatten(F.zip_with("between", others, lambda x, y: F.array(x, y))), ""), ";")
    # each group's pair of last tokens, then the other pairs of the groups with more than one
    crossed = lambda x: F.flatten(F.transform(x["a"], lambda i: F.transform(x["b"], lambda j: F.shiftleft(i, ID_BITS) + j)))
    more = F.flatten(F.transform("rest", lambda x: let(crossed(x), lambda c: F.slice(c, F.lit(1), F.size(c) - 1))))
    links = F.aggregate("rest", F.size("last") - F.size("rest"), lambda n, x: n + F.size(x["a"]) * F.size(x["b"]))
    digest = F.when(F.size("a") == 0, "").otherwise(F.sha2(text, 256))
    g = F.struct(F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.size("last").cast("long").alias("n_groups"), links.cast("long").alias("n_links"), digest.alias("groups_sha256"), F.concat("last", more).alias("pairs"))
    return parts.select("row", "doc_id", g.alias("g"))


def aligned(docs: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    held = staged(grouped(tokenised(docs, a, b)), "alignment")
    counts = held.select(F.explode(F.array_distinct("g.pairs")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = staged(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("count").alias("most"))
    told = staged(counts.withColumn("a", F.shiftright("pair", ID_BITS)).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs-told")
    links = held.select("row", F.explode("g.pairs").alias("pair"))
    if counts.count() <= broadcast_pairs:
        met = links.join(F.broadcast(told), "pair").withColumn("times", F.lit(1))
    else:
        met = spread_join(links.groupBy("row", "pair").agg(F.count("*").alias("times")), told, "pair", "row")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = held.select("row", "doc_id", "g.n_a", "g.n_b", "g.n_groups", "g.n_links", "g.groups_sha256").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
