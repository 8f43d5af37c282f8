"""Words of text that has no blanks between them: the best path through the words of a dictionary that stand in it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a dictionary holds at most: it goes to every task whole.
MOST_WORDS = 1_000_000
#: Runs that are looked up in the dictionary; letters and digits beside them are words as they stand.
HAN = re.compile(r"([㐀-䶿一-鿿豈-﫿]+)")
OTHER = re.compile(r"[A-Za-z0-9]+(?:[.+#_-][A-Za-z0-9]+)*")


class Dictionary:
    """Words with their frequencies, and all their beginnings: a prefix tree by its nodes' texts."""

    def __init__(self, words: dict[str, float]):
        self.total = math.log(max(1.0, sum(words.values())))
        self.worth = {w: math.log(max(n, 1.0)) - self.total for w, n in words.items() if w}
        self.begins = {w[:k] for w in self.worth for k in range(1, len(w) + 1)}
        self.alone = -self.total  # a letter that is no word

    def words_at(self, text: str, at: int) -> Iterator[int]:
        """Where the words end that begin at a place."""
        to = at + 1
        while to <= len(text) and text[at:to] in self.begins:
            if text[at:to] in self.worth:
                yield to
            to += 1

    def path(self, run: str) -> list[str]:
        """The words of the path with the greatest product of frequencies; of equal ones that with the longer first word."""
        n = len(run)
        best = [(0.0, n)] * (n + 1)
        for at in range(n - 1, -1, -1):
            ways = [(self.worth[run[at:to]] + best[to][0], to) for to in self.words_at(run, at)]
            if run[at] not in self.worth:
                ways.append((self.alone + best[at + 1][0], at + 1))
            best[at] = max(ways)
        out, at = [], 0
        while at < n:
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out

    def cut(self, text: str) -> list[str]:
        out = []
        for k, part in enumerate(HAN.split(text)):
            out += self.path(part) if k % 2 else OTHER.findall(part)
        return out


def dictionary(words: DataFrame, custom: DataFrame | None = None) -> dict[str, float]:
    """``word, n`` as a dictionary, custom words in place of others; one of more than ``MOST_WORDS`` is an error.

    A custom word without a frequency gets what lets it win against its own letters: the dictionary's total.
    """
    rows = words.select("word", F.col("n").cast("double").alias("n"))
    if custom is not None:
        total = rows.agg(F.sum("n")).first()[0] or 1.0
        own = custom.select("word", F.coalesce(F.col("n").cast("double"), F.lit(total)).alias("n"))
        rows = rows.join(own.select("word"), "word", "left_anti").union(own)
    found = rows.groupBy("word").agg(F.sum("n").alias("n")).limit(MOST_WORDS + 1).toArrow()
    if found.num_rows > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))


def segmented(df: DataFrame, text: str, words: dict[str, float], out: str = "words") -> DataFrame:
    """UX-08: ``df`` with the words of ``text`` in order; none for a null text."""
    told = df.sparkSession.sparkContext.broadcast(words)

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Dictionary(told.value)
        for batch in batches:
            cut = [known.cut(x) if x else [] for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.list_(pa.string()))], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def word_counts(df: DataFrame, text: str, words: dict[str, float], stop: list[str], top: int | None = None, least: int = 2) -> DataFrame:
    """AGG-17: words of ``least`` letters or more that are no stop words, by frequency."""
    found = segmented(df.select(text), text, words).select(F.explode("words").alias("word"))
    counts = found.where(~F.col("word").isin(stop) & (F.char_length("word") >= least)).groupBy("word").agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "word").limit(top)
