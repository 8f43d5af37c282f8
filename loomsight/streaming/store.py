"""Keyed tables in buckets by key hash behind one pointer: a batch rewrites the buckets it touches, several tables at once.

A table is ``buckets`` folders, each of the version that wrote it last. A commit reads the buckets its rows fall into,
folds the rows in, writes these buckets anew and then replaces the file ``CURRENT``, which names a folder for every bucket
of every table, in a single step. Readers see all tables before a commit or all after it; a run that fails before that
step leaves no trace but unnamed folders, which ``vacuum`` deletes. A batch that is run again after its commit is
passed over, so a stream's batches count once. One writer commits at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsight.operators.scheduling import upsert
from loomsight.sources import sinks

#: Column of the folders' names.
BUCKET = "__bucket"

Fold = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Change:
    """Rows for a table with that key. ``fold`` takes the stored rows of the buckets at hand, none at first, and the new
    ones, and returns what these buckets hold then; unset, the new rows win by key. ``drop`` names stored rows that go
    first, in whichever bucket they are."""

    rows: DataFrame
    key: list[str]
    fold: Fold | None = None
    #: The table's schema where it is not that of the rows.
    schema: T.StructType | None = None
    drop: Column | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        hadoop, conf = sinks._hadoop(self.spark)
        at = hadoop.Path(path)
        return at.getFileSystem(conf), at

    def manifest(self) -> dict:
        """``sources`` by name with their last number, ``tables`` by name with schema, key and the folder of each bucket."""
        fs, at = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(at):
            return {"sources": {}, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first().value)

    def _read(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{folder}/{BUCKET}={b}" for b, folder in table["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self._read(self.manifest()["tables"][name])

    def _present(self, folder: str) -> list[int]:
        """The buckets of a written folder."""
        fs, at = self._fs(folder)
        return [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith(f"{BUCKET}=")]

    def _bucket(self, key: list[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _written(self, df: DataFrame, key: list[str], folder: str) -> list[int]:
        own = df.withColumn(BUCKET, self._bucket(key))
        own.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return self._present(folder)

    def commit(self, source: str, number: int, changes: dict[str, Change]) -> bool:
        """Folds the changes in as one step, unless ``source`` has committed ``number`` or a later one before."""
        now = self.manifest()
        if number <= now["sources"].get(source, -1):
            return False
        run = uuid.uuid4().hex
        for name, change in changes.items():
            table = now["tables"].get(name) or {"schema": (change.schema or change.rows.schema).jsonValue(), "key": change.key, "buckets": {}}
            if table["key"] != change.key:
                raise ValueError(f"{name} is keyed by {table['key']}")
            incoming = f"{self.root}/incoming/{name}-{run}"
            coming = touched = self._written(change.rows, change.key, incoming)
            if change.drop is not None:
                going = self._read(table).where(change.drop).select(self._bucket(change.key)).distinct()
                touched = sorted({*touched, *(r[0] for r in going.collect())})  # no more than there are buckets
            old = self._read(table, touched)
            old = old if change.drop is None else old.where(~F.coalesce(change.drop, F.lit(False)))
            rows = self.spark.read.schema(change.rows.schema).parquet(*[f"{incoming}/{BUCKET}={b}" for b in coming]) if coming else self.spark.createDataFrame([], change.rows.schema)
            new = change.fold(old, rows) if change.fold else upsert(old, rows, change.key)
            folder = f"{self.root}/data/{name}-{run}"
            held = set(self._written(new.select(*old.columns), change.key, folder)) if touched else set()
            if not held <= set(touched):
                raise ValueError(f"the fold of {name} made keys that are not its rows'")
            table["buckets"] = {b: f for b, f in table["buckets"].items() if int(b) not in touched} | {str(b): folder for b in sorted(held)}
            now["tables"][name] = table
        now["sources"][source] = number
        sinks.publish_file(self.spark.createDataFrame([(json.dumps(now),)], "value string"), f"{self.root}/CURRENT", "text")
        fs, at = self._fs(f"{self.root}/incoming")
        fs.delete(at, True)
        return True

    def vacuum(self) -> int:
        """Deletes the folders that no table names any more; readers of an earlier state must have ended. Returns how many."""
        used = {f for t in self.manifest()["tables"].values() for f in t["buckets"].values()}
        fs, at = self._fs(f"{self.root}/data")
        gone = [f.getPath() for f in fs.listStatus(at) if f"{self.root}/data/{f.getPath().getName()}" not in used] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def batches(self, source: str, changes: Callable[[DataFrame], dict[str, Change]]) -> Callable[[DataFrame, int], None]:
        """SNK-05, ST-16: a ``foreachBatch`` function that commits what ``changes`` makes of a batch."""

        def apply(batch: DataFrame, number: int) -> None:
            self.commit(source, number, changes(batch))

        return apply


def history(store: Store, name: str, rows: DataFrame, key: list[str], bucket_type: str, run: str, number: int) -> bool:
    """SNK-05: the current rows of one bucket type and the history of all runs, in one step.

    In ``<name>`` the rows take the place of all of that type; ``<name>_history`` gains them under ``run``, and a run that is
    repeated under a later number replaces its own. Rows spread over the buckets by ``key``.
    """
    typed = rows.withColumn("bucket_type", F.lit(bucket_type))
    of_run = typed.withColumn("run_id", F.lit(run))
    same = F.col("bucket_type") == bucket_type
    return store.commit(f"{name}-{bucket_type}", number, {
        name: Change(typed, ["bucket_type", *key], drop=same),
        f"{name}_history": Change(of_run, ["run_id", "bucket_type", *key], drop=same & (F.col("run_id") == run)),
    })


def partial_series(rows: DataFrame, time: str, keys: list[str], value: str, evidence: str, hours: int = 12) -> DataFrame:
    """ST-03, ST-04: partial aggregates of a batch by key and bucket, which add up: sum, count, first evidence."""
    t = F.col(time).cast("timestamp_ntz")
    start = F.date_trunc("day", t).cast("timestamp_ntz") + F.make_dt_interval(hours=F.floor(F.hour(t) / hours).cast("int") * hours)
    return rows.groupBy(*keys, start.alias("bucket_start")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(F.struct(t.alias("at"), F.col(evidence).alias("id"))).alias("first"))


def merged_series(keys: list[str]) -> Fold:
    """Partial aggregates of both sides as one; late rows count in the bucket of their own time."""

    def fold(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*keys, "bucket_start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first").alias("first"))

    return fold


def series(store: Store, name: str, digits: int = 8) -> DataFrame:
    """The series as it stands: mean and first evidence of every bucket."""
    return store.table(name).withColumns({"avg_value": F.round(F.col("total") / F.col("n"), digits), "evidence": F.col("first.id")}).drop("total", "first")
