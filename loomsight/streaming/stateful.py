"""Streams with state of their own: query units, tasks, a cache that expires, candidates against recent tasks.

Each is a ``StatefulProcessor`` over ``groupBy(key).transformWithState``; its state is kept by key in the state store, so
it spreads with the keys and survives restarts. Events may come in any order within the watermark: what a processor emits
does not depend on how they fall into batches. Time is event time throughout; timers run when the watermark passes them.
A stream's last rows wait for the watermark: a row of ``tick`` with a later time, which belongs to no key, moves it.

The session needs ``spark.sql.streaming.stateStore.providerClass`` of a store that supports such state (``configure``).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomsight.operators.scheduling import TASK_EVENTS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ms(us: int) -> int:
    """The first millisecond, which timers count, that is not before."""
    return -(-us // 1000)


class _Keyed(StatefulProcessor):
    """Shared by all: rows in their order, nothing to close."""

    handle: StatefulProcessorHandle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done: tuple[int | None, set] = (None, set())

    def _first(self, key, now: int) -> bool:
        """Whether this is the key's first timer at this watermark, which takes all that has passed; timers that other
        batches left find nothing more."""
        if self.done[0] != now:
            self.done = (now, set())
        was = key in self.done[1]
        self.done[1].add(key)
        return not was

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


class UnitState(_Keyed):
    """ST-06: what ``scheduling.fold_state`` makes of a unit's events, after every batch.

    Kept: the last event, the last success or failure with its intervals, the last success, and failures after it: as a
    count for those the watermark has passed, one by one for the others, since a late success may still come before them.
    A timer at each failure's own time plus ``late`` moves it to the count.
    """

    OUT = "query_unit_key string, n_events long, last_event string, failure_count long, next_due_us long"

    def __init__(self, late: timedelta = timedelta()):
        self.late = int(late.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.unit = handle.getValueState("unit", "n long, last_us long, last_pos long, last_event string, end_us long, end_pos long, due_us long, ok_us long, ok_pos long, settled long")
        self.failures = handle.getListState("failures", "us long, pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.unit.get() if self.unit.exists() else None
        n, last, last_event, end, due, ok, settled = 0, None, None, None, None, None, 0
        if held:
            n, last, last_event, due, settled = held[0], (held[1], held[2]), held[3], held[6], held[9]
            end = None if held[4] is None else (held[4], held[5])
            ok = None if held[7] is None else (held[7], held[8])
        failures = {tuple(f) for f in self.failures.get()} if self.failures.exists() else set()
        new = False
        for r in rows:
            order = (r.us, r.pos)
            n += 1
            if last is None or order > last:
                last, last_event = order, r.event
            if r.event not in ("success", "failure"):
                continue
            if end is None or order > end:
                end, due = order, r.us + 60_000_000 * (r.revisit_minutes if r.event == "success" else r.cooldown_minutes)
            if r.event == "success" and (ok is None or order > ok):
                ok, new = order, True
                settled = 0  # all settled failures are older than the watermark, and so than this success
            elif r.event == "failure":
                failures.add(order)
                new = True
                self.handle.registerTimer(-(-r.us // 1000) + self.late)
        if new:
            self._keep({f for f in failures if ok is None or f > ok})
        self.unit.update((n, *last, last_event, *(end or (None, None)), due, *(ok or (None, None)), settled))
        yield self._row(key, n, last_event, settled + sum(ok is None or f > ok for f in failures), due)

    def _keep(self, failures) -> None:
        if failures:
            self.failures.put(sorted(failures))
        else:
            self.failures.clear()

    def _row(self, key, n, last_event, failed, due) -> Row:
        return Row(query_unit_key=key[0], n_events=n, last_event=last_event, failure_count=failed, next_due_us=due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() - self.late
        failures = [tuple(f) for f in self.failures.get()] if self.failures.exists() else []
        old = [f for f in failures if f[0] <= passed * 1000]
        if old:
            held = self.unit.get()
            self.unit.update((*held[:9], held[9] + len(old)))
            self._keep([f for f in failures if f[0] > passed * 1000])
        return iter(())


class TaskState(_Keyed):
    """ST-12: what ``scheduling.task_states`` makes of a task's events, after every batch: times, positions and counts alone."""

    OUT = "task_id long, status string, started_us long, ended_us long, info_logs long, success_logs long, error_logs long, warning_logs long"
    LEVELS = ("info", "success", "error", "warning")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.task = handle.getValueState("task", "status string, us long, pos long, start_us long, start_pos long, end_us long, end_pos long, info long, success long, error long, warning long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.task.get() if self.task.exists() else ("pending", *[None] * 6, 0, 0, 0, 0)
        status, marks, counts = held[0], [None if held[k] is None else (held[k], held[k + 1]) for k in (1, 3, 5)], list(held[7:])
        for r in rows:
            if r.event not in TASK_EVENTS:
                continue
            order, (after, level) = (r.us, r.pos), TASK_EVENTS[r.event]
            counts[self.LEVELS.index(level)] += 1
            if marks[0] is None or order > marks[0]:
                marks[0], status = order, after
            k = 1 if r.event == "start" else 2
            if marks[k] is None or order > marks[k]:
                marks[k] = order
        self.task.update((status, *[x for m in marks for x in (m or (None, None))], *counts))
        first = [m and m[0] for m in marks]
        yield Row(**dict(zip([c.split()[0] for c in self.OUT.split(", ")], [key[0], status, first[1], first[2], *counts])))


class Cache(_Keyed):
    """ST-14: writes of a key with a time to live, and reads of it.

    The latest write holds until it expires; a timer then deletes it. Writes and reads are taken by time once the
    watermark has passed them, so a read sees exactly the writes before it, whichever batch brought them. Every read gives a
    row, with no value where nothing is held. A batch sets one timer a key, for the first of its rows; when it goes off, all
    that the watermark has passed is taken, and one timer is set for what comes next.
    """

    OUT = "pos long, key string, value string, hit boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "value string, expires_us long")
        self.waiting = handle.getListState("waiting", "us long, pos long, kind string, value string, expires_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, r.pos, r.kind, r.value, r.expires_us) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(_ms(min(x[0] for x in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if not self._first(key, now):
            return iter(())
        waiting = [tuple(x) for x in self.waiting.get()]
        entry = was = self.entry.get()
        out = []
        for us, pos, kind, value, expires in sorted(x for x in waiting if x[0] <= now):
            if kind == "write":
                entry = (value, expires)
                continue
            hit = entry is not None and (entry[1] is None or entry[1] > us)
            out.append(Row(pos=pos, key=key[0], value=entry[0] if hit else None, hit=hit))
        rest = [x for x in waiting if x[0] > now]
        if len(rest) < len(waiting):
            self.waiting.put(rest) if rest else self.waiting.clear()
        if entry is not None and entry[1] is not None and entry[1] <= now:
            entry = None
        if entry is None and was is not None:
            self.entry.clear()
        elif entry != was:
            self.entry.update(entry)
        again = [x[0] for x in rest] + ([entry[1]] if entry is not None and entry[1] is not None else [])
        if again:
            self.handle.registerTimer(_ms(min(again)))
        return iter(out)


class RecentDuplicates(_Keyed):
    """ST-05: whether a candidate has a recent task of its key, as ``scheduling.recent_duplicates`` has it at the candidate's time.

    Events of tasks (``task_id, status``) and candidates share the key. A candidate waits until the watermark has passed it;
    then a task that was pending or running at its time counts always, a completed one for ``within`` hours, a failed one
    for ``cooldown``. An interval join has one bound for all rows, this has one by status: a task's row goes once its
    own horizon has passed or a later event of the task has, at the latest when those of all that came with it have, and an
    open task stays as long as it is open. Timers are set as in ``Cache``, one a key and batch.
    """

    OUT = "candidate_id long, keyword_id long, dedup_key string, is_duplicate boolean"

    def __init__(self, within_hours: int = 168, cooldown_hours: int = 24):
        self.horizon = {"completed": within_hours * 3_600_000_000, "failed": cooldown_hours * 3_600_000_000}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tasks = handle.getListState("tasks", "us long, pos long, task_id long, status string")
        self.waiting = handle.getListState("waiting", "us long, candidate_id long")

    def _counts(self, status: str, us: int, now: int) -> bool:
        return status in ("pending", "running") or (status in self.horizon and us >= now - self.horizon[status])

    def _again(self, tasks: list, waiting: list) -> int | None:
        """When a key is to be looked at again: at its first candidate's time, else when all its tasks' horizons have passed."""
        if waiting:
            return _ms(min(c[0] for c in waiting))
        return _ms(max(t[0] + self.horizon.get(t[3], 0) for t in tasks)) + 1 if tasks else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tasks, candidates = [], []
        for us, pos, task, status, candidate in ((r.us, r.pos, r.task_id, r.status, r.candidate_id) for r in rows):
            candidates.append((us, candidate)) if candidate is not None else tasks.append((us, pos, task, status))
        if tasks:
            self.tasks.appendList(tasks)
        if candidates:
            self.waiting.appendList(candidates)
        self.handle.registerTimer(self._again(tasks, candidates))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if not self._first(key, now):
            return iter(())
        tasks = sorted(tuple(t) for t in self.tasks.get())
        waiting = [tuple(c) for c in self.waiting.get()]
        ready, out, at, last = sorted(c for c in waiting if c[0] <= now), [], 0, {}
        for us, candidate in ready:
            while at < len(tasks) and tasks[at][0] <= us:
                last[tasks[at][2]] = tasks[at]
                at += 1
            # a task that counts no more does so again only after another event
            last = {k: t for k, t in last.items() if self._counts(t[3], t[0], us)}
            out.append(Row(candidate_id=candidate, keyword_id=key[0], dedup_key=key[1], is_duplicate=bool(last)))
        rest = [c for c in waiting if c[0] > now]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        newest = {t[2]: t for t in tasks if t[0] <= now}
        kept = [t for t in tasks if t[0] > now or (newest[t[2]] == t and self._counts(t[3], t[0], now))]
        if len(kept) < len(tasks):
            self.tasks.put(kept) if kept else self.tasks.clear()
        # open tasks that nothing follows so far are looked at with what comes next
        again = self._again([t for t in kept if t[0] > now or t[3] in self.horizon], rest)
        if again is not None:
            self.handle.registerTimer(again)
        return iter(out)


def run(events: DataFrame, time: str, keys: list[str], processor: _Keyed, late: str = "0 seconds", timed: bool = True) -> DataFrame:
    """A stream of the processor's rows. ``time`` becomes ``us``, microseconds, for the processor; rows whose keys are all
    null are ticks: they move the watermark and reach a key of their own that holds nothing."""
    marked = events.withWatermark(time, late).withColumn("us", F.unix_micros(time))
    # the test names the time too, or it would be moved below the watermark, which then never saw a tick
    keyed = marked.where(F.when(F.col(time).isNotNull(), F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()).otherwise(False))
    return keyed.groupBy(*keys).transformWithState(processor, processor.OUT, "Update" if not timed else "Append", "EventTime")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of rows written by batch (``batch`` in the path), each key's last."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("r")).select(*keys, "r.*")


def by_batch(path: str):
    """A ``foreachBatch`` function that writes each batch to a folder of its own; a batch that is run again replaces it."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply
