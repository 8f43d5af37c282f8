"""Byte-pair encoding by a bounded-lookahead transducer, and decoding by an incremental byte-to-text machine.

The merge list alone fixes how many symbols to the right can still change a token (``sufficient_lookahead``). The
transducer reads symbols, and once more than that many lie behind a token it is final and leaves: memory stays constant
however long a word is. Texts are cut into words as the tokenizer file says (special strings first, then canonical
composition, lower case, words); words seen lately come from a bounded cache of the transducer's own results.

Defined results: a null or empty text has no ids and decodes to the empty text; rows are independent, so repeated rows
and ties need no rule; other columns pass by unused; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomsight.llm.common import pick, table

#: Entries of each bounded cache of a worker.
CACHE = 300_000


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], lengths: dict[int, int]) -> int:
    """Symbols right of a token that can decide whether it stays, for merges ``(left, right, made)`` in rank order.

    A token x that stands until rank r can lose its end to a merge (s, y) of lower rank, s being x or a right end inside
    it that is not yet used up; for that y must itself form and stand, which looks further right under a lower rank.
    Ranks fall along the chain, so one pass in rank order finds the longest.
    """
    ranks: dict[int, list[int]] = {}
    reach: dict[int, list[int]] = {}
    made_by: dict[int, list[tuple[int, int]]] = {}

    def look(x: int, rank: int) -> int:
        k = bisect_left(ranks.get(x, ()), rank)
        best = reach[x][k - 1] if k else 0
        for right, at in made_by.get(x, ()):
            if at < rank:
                best = max(best, look(right, at))
        return best

    for rank, (left, right, made) in enumerate(merges):
        far = lengths[right] + look(right, rank)
        ranks.setdefault(left, []).append(rank)
        reach.setdefault(left, []).append(max(far, reach[left][-1] if reach.get(left) else 0))
        made_by.setdefault(made, []).append((right, rank))
    return max((look(x, len(merges)) for x in lengths), default=0)


class Transducer:
    """Reads symbol ids, returns the ids of tokens that no further symbol can change."""

    def __init__(self, merges: list[tuple[int, int, int]], lengths: dict[int, int]):
        #: rank << 20 | made token, so that the least number is the first merge
        self.merges = {(a, b): rank << 20 | made for rank, (a, b, made) in reversed(list(enumerate(merges)))}
        self.lengths = lengths
        self.lookahead = sufficient_lookahead(merges, lengths)
        self.step = 2 * self.lookahead + 32
        self.pending: list[int] = []

    def _merge(self, ids: list[int]) -> list[int]:
        ids, none, get = list(ids), 1 << 60, self.merges.get
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != none:
            k = pairs.index(best)
            token = ids[k] = best & 0xFFFFF
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = get((ids[k - 1], token), none)
            if k < len(pairs):
                pairs[k] = get((token, ids[k + 1]), none)
        return ids

    def feed(self, symbols: list[int]) -> Iterator[int]:
        """Takes symbols; yields the tokens that are now final."""
        for at in range(0, len(symbols), self.step):
            self.pending += symbols[at : at + self.step]
            if len(self.pending) < self.step:
                continue
            final, done = len(self.pending) - self.lookahead, 0
            for token in self._merge(self.pending):
                if done + self.lengths[token] > final:
                    break
                done += self.lengths[token]
                yield token
            del self.pending[:done]

    def finish(self) -> list[int]:
        """The end of the word: what is pending is final."""
        out, self.pending = self._merge(self.pending), []
        return out


class _Cache(dict):
    """A mapping that fills itself and starts afresh when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Decoder:
    """Token ids to text, a token at a time, keeping at most an unfinished character.

    ``text`` mode gives the words themselves, a word's end as one space; ``joined`` mode gives the token strings with a
    space between, as a tokenizer file without a decoder does.
    """

    def __init__(self, bpe: WordBpe, mode: str = "text"):
        self.strings, self.bytes, self.mode = bpe.strings, bpe.bytes, mode
        self.reset()

    def reset(self) -> None:
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: list[int], final: bool = False) -> str:
        if self.mode == "text":
            return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)), final)
        out = (b"" if self.first or not ids else b" ") + b" ".join(map(self.strings.__getitem__, ids))
        self.first = self.first and not ids
        return self.machine.decode(out, final)


class WordBpe:
    """A tokenizer file of the kind BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = max(*vocab.values(), *(t["id"] for t in spec["added_tokens"])) + 1
        self.strings, self.bytes, back = [b""] * n, [b""] * n, {c: b for b, c in byte_letters().items()}
        lengths = {}
        for s, i in vocab.items():
            body = s[: -len(self.end)] if self.end and s.endswith(self.end) and s != self.end else s
            self.strings[i] = s.encode()
            self.bytes[i] = bytes(back[c] for c in body if c in back) + (b" " if body != s else b"")
            lengths[i] = len(body)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.specials.items():
            self.strings[i] = self.bytes[i] = s.encode()
        self.at_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.special_start = min(self.specials, default="\0")[:2]
        self.word = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}+")
        self.odd = regex.compile("[\x1c-\x1f]")
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.end] for b in range(256)]
        self.transducer = Transducer([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], lengths)
        self.of_word = _Cache(self._word)
        self.of_run = _Cache(self._run)

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        out = list(self.transducer.feed(symbols)) + self.transducer.finish()
        return np.array(out, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        return b"".join([self.of_word[w] if len(w) < 64 else self._word(w) for w in self.word.findall(run)])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case letter by letter: no rule for the end of a word
        text = text.lower()
        runs = self.blank.split(text) if self.odd.search(text) else text.split()
        return b"".join([self.of_run[r] if len(r) < 64 else self._run(r) for r in runs])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if self.special_start not in text:
            return np.frombuffer(self._plain(text), "<u4")
        parts = [np.array([self.specials[p]], "<u4").tobytes() if p in self.specials else self._plain(p) for p in self.at_specials.split(text) if p]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids, mode: str = "text") -> str:
        return Decoder(self, mode).feed(list(map(int, ids)), final=True)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) and ``n_tokens`` to each row; the columns of ``docs`` stay."""
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens")]
    names = [f.name for f in kept]
    docs = pick(docs, *names)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            rows = [bpe.encode(t) for t in batch.column(names.index(text)).to_pylist()]
            flat = pa.array(np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32))
            off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(off), flat), pa.array(np.diff(off).astype(np.int64))], [*names, "ids", "n_tokens"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: the ids' number and digest, and the digest of what they decode to, token strings joined."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text)
                said = Decoder(bpe, "joined").feed(ids.tolist(), final=True)
                out.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())
