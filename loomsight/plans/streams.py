"""Registered queries that run as streams: a table arrives in three parts, out of order, with a restart between them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.plans.adapters import read
from loomsight.plans.more import TS, _text, query, scratch
from loomsight.streaming import folds, stateful, store

#: Days by which rows are out of order, and those that a watermark waits.
MIXED, LATE = 60, timedelta(days=90)
#: A time after all others.
END = "2100-01-01 00:00:00"


def _parts(df: DataFrame, time: str, pos: str, mixed: int) -> list[DataFrame]:
    """Three parts by time, the border of each row moved by up to ``mixed`` days."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        return [df] * 3
    third = (high - low) / 3
    moved = F.col(time) + F.make_dt_interval(days=F.pmod(F.xxhash64(pos), F.lit(mixed + 1)).cast("int"))
    part = F.when(moved < F.lit(low + third), 0).when(moved < F.lit(low + 2 * third), 1).otherwise(2)
    return [df.where(part == k) for k in range(3)]


def _replayed(spark: SparkSession, parts: list[DataFrame], time: str, build: Callable[[DataFrame], DataFrame], each, at: str) -> None:
    """Lets the parts arrive one by one; the stream ends and starts anew from its checkpoint in between."""
    stateful.configure(spark)
    for part in parts:
        part.withColumn(time, F.col(time).cast("timestamp")).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
        build(stream).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _tick(df: DataFrame, time: str, *keys: str) -> DataFrame:
    """One row of that schema without keys, at the end of time."""
    one = df.sparkSession.range(1)
    return one.select(*[F.lit(END).cast(t).alias(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])


@query(
    """
with e as (
  select o_custkey as k, o_orderdate as tm, epoch_us(o_orderdate)::hugeint * 1000000000 + o_orderkey as o,
    case o_orderstatus when 'F' then 'success' when 'O' then 'failure' else 'schedule' end as ev
  from orders),
ok as (
  select k, max(o) filter (where ev = 'success') as last_ok, count(*) as n, max_by(ev, o) as last_event,
    max_by(case when ev = 'success' then tm + interval 720 minute else tm + interval 1440 minute end, o) filter (where ev <> 'schedule') as due
  from e group by k)
select ok.k::varchar as query_unit_key, n as n_events, last_event, count(e.k) as failure_count, strftime(due, '%Y-%m-%d %H:%M:%S') as next_due_at
from ok left join e on e.k = ok.k and e.ev = 'failure' and (last_ok is null or e.o > last_ok)
group by all"""
)
def stream_query_state(spark: SparkSession, sf: str) -> DataFrame:
    """ST-06, ST-08."""
    events = read(spark, sf, "orders").selectExpr(
        "cast(o_custkey as string) as query_unit_key", "case o_orderstatus when 'F' then 'success' when 'O' then 'failure' else 'schedule' end as event",
        "o_orderdate as at", "720L as revisit_minutes", "1440L as cooldown_minutes", "o_orderkey as pos",
    )
    at = scratch(spark)
    _replayed(spark, _parts(events, "at", "pos", MIXED), "at", lambda s: s, folds.batches(f"{at}/out", "at", ["query_unit_key"], LATE, *folds.units(["query_unit_key"])), at)
    return stateful.latest(spark, f"{at}/out", ["query_unit_key"]).select("query_unit_key", "n_events", "last_event", "failure_count", F.date_format(F.timestamp_micros("next_due_us"), TS).alias("next_due_at"))


@query(
    """
with e as (
  select o_custkey as task_id, o_orderdate as tm, epoch_us(o_orderdate)::hugeint * 1000000000 + o_orderkey as o,
    case o_orderkey % 5 when 0 then 'start' when 1 then 'complete' when 2 then 'fail' when 3 then 'cancel' else 'noted' end as ev
  from orders)
select task_id,
  coalesce(max_by(case ev when 'start' then 'running' when 'complete' then 'completed' when 'fail' then 'failed' else 'cancelled' end, o) filter (where ev <> 'noted'), 'pending') as status,
  strftime(max_by(tm, o) filter (where ev = 'start'), '%Y-%m-%d %H:%M:%S') as started_at,
  strftime(max_by(tm, o) filter (where ev in ('complete', 'fail', 'cancel')), '%Y-%m-%d %H:%M:%S') as completed_at,
  count(*) filter (where ev = 'start') as info_logs, count(*) filter (where ev = 'complete') as success_logs,
  count(*) filter (where ev = 'fail') as error_logs, count(*) filter (where ev = 'cancel') as warning_logs
from e group by task_id"""
)
def stream_task_states(spark: SparkSession, sf: str) -> DataFrame:
    """ST-12."""
    events = read(spark, sf, "orders").selectExpr("o_custkey as task_id", "element_at(array('start', 'complete', 'fail', 'cancel', 'noted'), cast(o_orderkey % 5 as int) + 1) as event", "o_orderdate as at", "o_orderkey as pos")
    at = scratch(spark)
    _replayed(spark, _parts(events, "at", "pos", MIXED), "at", lambda s: s, folds.batches(f"{at}/out", "at", ["task_id"], LATE, *folds.tasks(["task_id"])), at)
    text = lambda c, n: F.date_format(F.timestamp_micros(c), TS).alias(n)
    return stateful.latest(spark, f"{at}/out", ["task_id"]).select("task_id", "status", text("started_us", "started_at"), text("ended_us", "completed_at"), "info_logs", "success_logs", "error_logs", "warning_logs")


@query(
    """
with e as (
  select event_id as pos, user_id::varchar as key, ts, event_type in ('view', 'signup', 'purchase') as is_write, event_type || '-' || event_id as value,
    case when event_id % 4 <> 0 then ts + to_hours((event_id % 30)::int) end as expires
  from events),
w as (
  select *, last_value(case when is_write then pos end ignore nulls) over (partition by key order by ts, pos rows between unbounded preceding and current row) as held
  from e)
select r.pos, r.key, case when b.pos is not null and (b.expires is null or b.expires > r.ts) then b.value end as value,
  b.pos is not null and (b.expires is null or b.expires > r.ts) as hit
from w r left join e b on b.pos = r.held
where not r.is_write"""
)
def stream_cache(spark: SparkSession, sf: str) -> DataFrame:
    """ST-14."""
    rows = read(spark, sf, "events").selectExpr(
        "event_id as pos", "cast(user_id as string) as key", "ts as at", "case when event_type in ('view', 'signup', 'purchase') then 'write' else 'read' end as kind", "concat(event_type, '-', event_id) as value",
        "case when event_id % 4 <> 0 then ts + make_dt_interval(0, cast(event_id % 30 as int)) end as expires",
    )
    rows = rows.withColumn("expires_us", F.unix_micros(F.col("expires").cast("timestamp"))).drop("expires")
    at = scratch(spark)
    parts = [*_parts(rows, "at", "pos", 2), _tick(rows, "at")]
    _replayed(spark, parts, "at", lambda s: s, folds.batches(f"{at}/out", "at", ["key"], timedelta(days=4), *folds.cache(["key"])), at)
    return spark.read.parquet(f"{at}/out").select("pos", "key", "value", "hit")


@query(
    """
with t as (
  select o_custkey as k, o_custkey * 10 + o_orderkey % 3 as task_id, o_orderkey as pos, o_orderdate as tm,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'pending' end as status
  from orders),
c as (select o_custkey as k, o_orderkey as candidate_id, o_orderdate + to_hours((o_orderkey % 300)::int) as tm from orders),
seen as (
  select candidate_id, c.tm as asked, t.tm, t.status
  from c join t on t.k = c.k and t.tm <= c.tm
  qualify row_number() over (partition by candidate_id, task_id order by t.tm desc, t.pos desc) = 1),
hits as (
  select distinct candidate_id from seen
  where status = 'pending' or (status = 'completed' and tm >= asked - interval 168 hour) or (status = 'failed' and tm >= asked - interval 24 hour))
select candidate_id, k as keyword_id, k || '-x' as dedup_key, candidate_id in (select candidate_id from hits) as is_duplicate
from c"""
)
def stream_recent_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """ST-05, JOIN-06."""
    orders = read(spark, sf, "orders")
    key = ["o_custkey as keyword_id", "concat(o_custkey, '-x') as dedup_key"]
    tasks = orders.selectExpr(*key, "o_orderdate as at", "o_orderkey as pos", "o_custkey * 10 + o_orderkey % 3 as task_id", "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'pending' end as status", "cast(null as bigint) as candidate_id")
    asked = orders.selectExpr(*key, "o_orderdate + make_dt_interval(0, cast(o_orderkey % 300 as int)) as at", "o_orderkey as pos", "cast(null as bigint) as task_id", "cast(null as string) as status", "o_orderkey as candidate_id")
    both = tasks.unionByName(asked)
    at = scratch(spark)
    parts = [*_parts(both, "at", "pos", MIXED), _tick(both, "at")]
    keys = ["keyword_id", "dedup_key"]
    _replayed(spark, parts, "at", lambda s: s, folds.batches(f"{at}/out", "at", keys, LATE, *folds.recent_duplicates(keys)), at)
    return spark.read.parquet(f"{at}/out").select("candidate_id", "keyword_id", "dedup_key", "is_duplicate")


@query(
    """
select event_type, strftime(date_trunc('day', ts) + case when hour(ts) >= 12 then interval 12 hour else interval 0 hour end, '%Y-%m-%d %H:%M:%S') as bucket_start,
  count(value) as n, round(avg(value), 10) as avg_value, arg_min(event_id, (ts, event_id)) as evidence
from events group by all"""
)
def stream_series_full(spark: SparkSession, sf: str) -> DataFrame:
    """ST-03, ST-04, ST-16: partial aggregates in a store that late rows update; every window comes out."""
    rows = read(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    at = scratch(spark)
    held = store.Store(spark, f"{at}/store", 16)
    keys = ["event_type"]
    changes = lambda b: {"series": store.Change(store.partial_series(b, "ts", keys, "value", "event_id"), [*keys, "bucket_start"], store.merged_series(keys))}
    _replayed(spark, _parts(rows, "ts", "event_id", 5), "ts", lambda s: s, held.batches("events", changes), at)
    return store.series(held, "series", 10).select("event_type", _text("bucket_start"), "n", "avg_value", "evidence")
