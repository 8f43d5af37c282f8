"""ST-15, TOP-10: log lines for several readers at once, and the last lines for one that comes late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsight.functions import scalars as S
from loomsight.streaming.store import Change, Store


def levelled(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with their level; blank ones go."""
    return lines.where(S.filled(F.col(line)).isNotNull()).withColumn("level", S.log_level(F.col(line)))


def recent(most: int, pos: str = "pos") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A fold that keeps the ``most`` last lines of each stream, as a ring buffer does: ``stream`` is the key."""
    last = Window.partitionBy("stream").orderBy(F.desc(pos))

    def fold(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new).withColumn("__rank", F.row_number().over(last))
        return both.where(F.col("__rank") <= most).drop("__rank")

    return fold


def fan_out(store: Store, readers: dict[str, Callable[[DataFrame], DataFrame]], most: int = 500, pos: str = "pos") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: every reader's rows of a batch, each through its own filter, and the last lines.

    All are one commit of the store, so a batch that is run again after a failure reaches each reader once.
    ``<reader>_lines`` holds what a reader has been sent; ``last_lines`` the buffer. Batches have ``stream``, ``line`` and ``pos``,
    and a line is told apart by stream and ``pos``.
    """

    def apply(batch: DataFrame, number: int) -> None:
        lines = levelled(batch)
        sent = {f"{name}_lines": Change(keep(lines), ["stream", pos]) for name, keep in readers.items()}
        store.commit("lines", number, sent | {"last_lines": Change(lines, ["stream"], recent(most, pos))})

    return apply
