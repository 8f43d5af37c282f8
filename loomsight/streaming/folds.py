"""The streams of ``stateful`` for batches of many keys: state is a table that joins, groups and windows take on.

A processor is called for each key and each timer, and each call to its state is a message between Python and the JVM; that
suits few keys a batch. Here a batch is a DataFrame, what a stream holds is another, and a step makes of both what comes
out and what is held next, for all keys at once. A batch rewrites what is held, which the watermark bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsight.operators.scheduling import TASK_EVENTS

#: Later than all times, in microseconds.
NEVER = 1 << 62

#: ``(rows, now)`` to ``(out, held)``: held and new rows, the watermark in microseconds.
Step = Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]


def batches(path: str, time: str, keys: list[str], late: timedelta, first: Callable[[DataFrame], DataFrame], step: Step) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. ``first`` makes rows to hold of a batch, which has ``us``, its time in microseconds.

    The watermark is the latest time so far less ``late``; rows that it has passed are dropped. Rows whose keys are all null
    are ticks. What comes out is written to ``batch=`` folders. Of what is held there are two tables, of this batch and of
    the one before, so that a batch that is run again finds what it found.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, after = f"{path}.held/{(number - 1) % 2}", f"{path}.held/{number % 2}"
        was = spark.read.parquet(f"{before}/seen").first().us if number else None
        marked = batch.where(F.col(time).isNotNull()).withColumn("us", F.unix_micros(time))
        seen = max((x for x in (was, marked.agg(F.max("us")).first()[0]) if x is not None), default=None)
        behind = int(late.total_seconds() * 1_000_000)
        new = marked.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
        new = first(new if was is None else new.where(F.col("us") > was - behind))
        rows = spark.read.parquet(f"{before}/rows").unionByName(new) if number else new
        out, held = step(rows, -NEVER if seen is None else seen - behind)
        held.write.mode("overwrite").parquet(f"{after}/rows")
        spark.createDataFrame([(seen,)], "us long").write.mode("overwrite").parquet(f"{after}/seen")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def units(keys: list[str]) -> tuple[Callable[[DataFrame], DataFrame], Step]:
    """ST-06: what ``UnitState`` gives: after each batch the units that it has events of.

    A unit is one row: the latest event, success and end, and failures after the success, as a count for those that the
    watermark has passed, one by one for the others, since a late success may still come before them.
    """
    order = ("us", "pos")

    def first(batch: DataFrame) -> DataFrame:
        when = lambda kind, *c: F.when(F.col("event").isin(*kind), F.struct(*order, *c))
        due = F.col("us") + 60_000_000 * F.when(F.col("event") == "success", F.col("revisit_minutes")).otherwise(F.col("cooldown_minutes"))
        return batch.groupBy(*keys).agg(
            F.count("*").alias("n"), F.max(F.struct(*order, "event")).alias("last"), F.max(when(["success", "failure"], due.alias("due"))).alias("ended"), F.max(when(["success"])).alias("ok"),
            F.lit(0).cast("long").alias("settled"), F.collect_list(when(["failure"])).alias("failures"), F.lit(True).alias("new"),
        )

    def step(rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        # a success that is new is later than all that the watermark had passed, so than all settled failures
        settled = F.when(F.max(F.when(F.col("new"), F.col("ok"))).isNull(), F.sum("settled")).otherwise(0)
        one = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("ended").alias("ended"), F.max("ok").alias("ok"), settled.alias("settled"), F.flatten(F.collect_list("failures")).alias("failures"), F.bool_or("new").alias("new"))
        one = one.withColumn("failures", F.when(F.col("ok").isNull(), F.col("failures")).otherwise(F.filter("failures", lambda f: f > F.col("ok"))))
        out = one.where("new").select(*keys, F.col("n").alias("n_events"), F.col("last.event").alias("last_event"), (F.col("settled") + F.size("failures")).alias("failure_count"), F.col("ended.due").alias("next_due_us"))
        passed = F.size(F.filter("failures", lambda f: f["us"] <= now))
        held = one.select(*keys, "n", "last", "ended", "ok", (F.col("settled") + passed).alias("settled"), F.filter("failures", lambda f: f["us"] > now).alias("failures"), F.lit(False).alias("new"))
        return out, held

    return first, step


def tasks(keys: list[str]) -> tuple[Callable[[DataFrame], DataFrame], Step]:
    """ST-12: what ``TaskState`` gives: after each batch the tasks that it has events of."""
    levels = ("info", "success", "error", "warning")

    def first(batch: DataFrame) -> DataFrame:
        known = F.col("event").isin(*TASK_EVENTS)
        pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for e, v in TASK_EVENTS.items() for x in (e, v[k])]), F.col("event"))
        latest = lambda test, *c: F.max(F.when(known & test, F.struct("us", "pos", *c)))
        level = F.when(known, pick(1))
        return batch.groupBy(*keys).agg(latest(F.lit(True), F.when(known, pick(0)).alias("status")).alias("last"), latest(F.col("event") == "start").alias("start"), latest(F.col("event") != "start").alias("end"), *[F.count_if(level == x).alias(x) for x in levels], F.lit(True).alias("new"))

    def step(rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        one = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("last", "start", "end")], *[F.sum(x).alias(x) for x in levels], F.bool_or("new").alias("new"))
        out = one.where("new").select(*keys, F.coalesce("last.status", F.lit("pending")).alias("status"), F.col("start.us").alias("started_us"), F.col("end.us").alias("ended_us"), *[F.col(x).alias(f"{x}_logs") for x in levels])
        return out, one.withColumn("new", F.lit(False))

    return first, step


def cache(keys: list[str]) -> tuple[Callable[[DataFrame], DataFrame], Step]:
    """ST-14: what ``Cache`` gives: a row for each read, once the watermark has passed it. Held: rows still ahead, and of
    each key the latest write, until it expires."""
    columns = [*keys, "us", "pos", "kind", "value", "expires_us"]
    write = F.col("kind") == "write"

    def step(rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        passed = rows.where(F.col("us") <= now)
        entry = F.last(F.when(write, F.struct("value", "expires_us")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("us", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = F.col("entry").isNotNull() & (F.col("entry.expires_us").isNull() | (F.col("entry.expires_us") > F.col("us")))
        out = passed.withColumn("entry", entry).where(~write).select("pos", *keys, F.when(hit, F.col("entry.value")).alias("value"), hit.alias("hit"))
        rest = [c for c in columns if c not in (*keys, "us", "pos")]
        latest = passed.where(write).groupBy(*keys).agg(F.max(F.struct("us", "pos", *rest)).alias("r")).select(*keys, "r.*").where(F.col("expires_us").isNull() | (F.col("expires_us") > now))
        return out, rows.where(F.col("us") > now).unionByName(latest)

    return lambda batch: batch.select(*columns), step


def until(task: list[str], horizon: Column) -> Column:
    """The last time at which a task's event counts: before its next event, and within its horizon."""
    after = F.lead("us").over(Window.partitionBy(*task).orderBy("us", "pos"))
    return F.least(F.coalesce(after - 1, F.lit(NEVER)), horizon)


def recent_duplicates(keys: list[str], within_hours: int = 168, cooldown_hours: int = 24) -> tuple[Callable[[DataFrame], DataFrame], Step]:
    """ST-05: what ``RecentDuplicates`` gives: a row for each candidate, once the watermark has passed it.

    Each task's event counts up to a time of its own; a candidate has a recent task if the latest such time of all events
    up to it is not before it: one running maximum a key, no pairs. Held: rows still ahead and events that still count.
    """
    hour = 3_600_000_000
    columns = [*keys, "us", "pos", "task_id", "status", "candidate_id"]
    asked = F.col("candidate_id").isNotNull()
    ends = F.when(F.col("status").isin("pending", "running"), F.lit(NEVER)).when(F.col("status") == "completed", F.col("us") + within_hours * hour).when(F.col("status") == "failed", F.col("us") + cooldown_hours * hour)

    def step(rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
        near = rows.repartition(*keys)
        # an event that does not count ends the one before it all the same
        counted = near.withColumn("until", F.when(~asked, until([*keys, "task_id", "candidate_id"], F.coalesce(ends, F.lit(-NEVER)))))
        best = F.max("until").over(Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        passed = F.col("us") <= now
        out = counted.where(passed).withColumn("best", best).where(asked).select("candidate_id", *keys, F.coalesce(F.col("best") >= F.col("us"), F.lit(False)).alias("is_duplicate"))
        return out, counted.where(~passed | (F.col("until") >= now)).select(*columns)

    return lambda batch: batch.select(*columns), step
