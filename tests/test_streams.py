"""Stateful streams against their batch forms, and the bucketed store."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsight.operators import scheduling
from loomsight.streaming import jobs, stateful, store

T0 = datetime(2026, 1, 1)


def replay(spark, tmp_path, parts, schema, time, build, each, mode="update"):
    stateful.configure(spark)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        build(stream).writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()


def test_units_in_any_order_with_restarts(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"u{rng.integers(6)}", ["schedule", "success", "failure", "failure"][rng.integers(4)], T0 + timedelta(minutes=int(k + rng.integers(-30, 30))), 60, 240, k) for k in range(300)]
    schema = "query_unit_key string, event string, at timestamp, revisit_minutes long, cooldown_minutes long, pos long"
    parts = [rows[:100], rows[100:200], rows[200:]]
    build = lambda s: stateful.run(s, "at", ["query_unit_key"], stateful.UnitState(timedelta(hours=2)), "2 hours", timed=False)
    for k, part in enumerate(parts):
        replay(spark, tmp_path, [part], schema, "at", build, stateful.by_batch(f"{tmp_path}/out"))
        df = spark.createDataFrame(rows[: 100 * (k + 1)], schema)
        want = scheduling.fold_state(df).withColumn("next_due_us", F.unix_micros("next_due_at")).drop("next_due_at")
        got = stateful.latest(spark, f"{tmp_path}/out", ["query_unit_key"]).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tasks_and_unknown_events(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(9)), ["start", "complete", "fail", "cancel", "note"][rng.integers(5)], T0 + timedelta(seconds=int(rng.integers(500))), k) for k in range(120)] + [(99, "note", T0, 500)]
    schema = "task_id long, event string, at timestamp, pos long"
    build = lambda s: stateful.run(s, "at", ["task_id"], stateful.TaskState(), "1 hour", timed=False)
    replay(spark, tmp_path, [rows[:50], rows[50:60], rows[60:]], schema, "at", build, stateful.by_batch(f"{tmp_path}/out"))
    want = scheduling.task_states(spark.createDataFrame(rows, schema))
    want = want.na.fill(0).withColumns({"started_us": F.unix_micros("started_at"), "ended_us": F.unix_micros("completed_at")}).drop("started_at", "completed_at")
    got = stateful.latest(spark, f"{tmp_path}/out", ["task_id"]).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_cache_holds_what_is_live_at_every_batch(spark, tmp_path):
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    rows, at = [], T0
    rng = np.random.default_rng(4)
    for k in range(90):
        at += timedelta(seconds=int(rng.integers(1, 40)))
        ends = us(at + timedelta(seconds=int(rng.integers(10, 400)))) if rng.random() < 0.7 else None
        rows.append((k, f"k{rng.integers(5)}", at, "write" if rng.random() < 0.5 else "read", f"v{k}", ends))
    schema = "pos long, key string, at timestamp, kind string, value string, expires_us long"
    build = lambda s: stateful.run(s, "at", ["key"], stateful.Cache(), "0 seconds")
    for k in range(3):
        tick = (None, None, rows[30 * k + 29][2] + timedelta(seconds=1), None, None, None)
        replay(spark, tmp_path, [rows[30 * k : 30 * (k + 1)] + [tick]], schema, "at", build, stateful.by_batch(f"{tmp_path}/out"))
        writes = [(r[1], r[4], r[5], r[0]) for r in rows[: 30 * (k + 1)] if r[3] == "write"]
        live = jobs.live(spark.createDataFrame(writes, "key string, value string, expires_at long, pos long"), F.lit(us(tick[2])))
        held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "entry").load()
        kept = {r.key["key"]: r.value["value"] for r in held.collect()}
        assert kept == {r.key: r.value for r in live.collect()}
    got = {r.pos: r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for pos, key, at, kind, *_ in rows:
        if kind == "read":
            before = [r for r in rows if r[1] == key and r[3] == "write" and r[0] < pos]
            last = before[-1] if before else None
            want[pos] = last[4] if last and (last[5] is None or last[5] > us(at)) else None
    assert got == want


HORIZONS = [(167, "completed", True), (169, "completed", False), (23, "failed", True), (25, "failed", False), (5000, "running", True), (5000, "pending", True), (1, "cancelled", False)]


def test_horizons_by_status(spark, tmp_path):
    schema = "keyword_id long, dedup_key string, at timestamp, pos long, task_id long, status string, candidate_id long"
    then = T0 + timedelta(hours=6000)
    tasks = [(k, "a", then - timedelta(hours=h), k, 10, status, None) for k, (h, status, _) in enumerate(HORIZONS)]
    asked = [(k, "a", then, 100 + k, None, None, k) for k in range(len(HORIZONS) + 1)]
    parts = [tasks, asked, [(None, None, then + timedelta(days=1), None, None, None, None)]]
    build = lambda s: stateful.run(s, "at", ["keyword_id", "dedup_key"], stateful.RecentDuplicates(), "300 days")
    replay(spark, tmp_path, [*parts, [(None, None, then + timedelta(days=400), None, None, None, None)]], schema, "at", build, stateful.by_batch(f"{tmp_path}/out"))
    got = {r.candidate_id: r.is_duplicate for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: d for k, (_, _, d) in enumerate(HORIZONS)} | {len(HORIZONS): False}
    stored = spark.createDataFrame([(r[0], "a", r[5], r[2], None, None) for r in tasks], "keyword_id long, dedup_key string, status string, created_at timestamp, completed_at timestamp, updated_at timestamp")
    keys = spark.createDataFrame([(r[0], "a") for r in asked], "keyword_id long, dedup_key string")
    found = {r.keyword_id for r in scheduling.recent_duplicates(keys, stored, F.lit(then).cast("timestamp"))[1].collect()}
    assert found == {k for k, d in got.items() if d}


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def data_files(root):
    return {p for p in (root / "data").rglob("*.parquet")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", 32)
    s.commit("a", 0, {"t": store.Change(keyed(spark, [(k, "old") for k in range(500)]), ["k"])})
    before = data_files(tmp_path / "s")
    assert s.commit("a", 1, {"t": store.Change(keyed(spark, [(3, "new"), (1000, "new")]), ["k"])})
    new = data_files(tmp_path / "s") - before
    assert 1 <= len(new) <= 2
    assert not s.commit("a", 1, {"t": store.Change(keyed(spark, [(3, "again")]), ["k"])})
    got = {r.k: r.v for r in s.table("t").collect()}
    assert len(got) == 501 and got[3] == got[1000] == "new" and got[4] == "old"
    assert s.vacuum() == 0 or s.table("t").count() == 501


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", 4)
    s.commit("a", 0, {"t": store.Change(keyed(spark, [(1, "x")]), ["k"]), "u": store.Change(keyed(spark, [(1, "x")]), ["k"])})
    boom = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception):
        s.commit("a", 1, {"t": store.Change(keyed(spark, [(1, "y")]), ["k"]), "u": store.Change(keyed(spark, [(1, "y")]).withColumn("v", boom("v")), ["k"])})
    assert [r.v for r in s.table("t").collect()] == ["x"] == [r.v for r in s.table("u").collect()]
    assert s.commit("a", 1, {"t": store.Change(keyed(spark, [(1, "y")]), ["k"])}) and s.vacuum() >= 1
    assert [r.v for r in s.table("t").collect()] == ["y"]


def test_current_and_history_of_a_bucket_type(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", 8)
    for n, (kind, run, rows) in enumerate([("1d", "r1", [(1, "a"), (2, "b")]), ("12h", "r2", [(5, "c")]), ("1d", "r3", [(9, "d")])]):
        assert store.history(s, "series", keyed(spark, rows), ["k"], kind, run, n)
    assert sorted((r.bucket_type, r.k) for r in s.table("series").collect()) == [("12h", 5), ("1d", 9)]
    assert sorted((r.run_id, r.k) for r in s.table("series_history").collect()) == [("r1", 1), ("r1", 2), ("r2", 5), ("r3", 9)]
    assert store.history(s, "series", keyed(spark, [(k, "e") for k in range(40)]), ["k"], "1d", "r1", 9)
    assert s.table("series").where("bucket_type = '1d'").count() == 40 and s.table("series").count() == 41
    assert s.table("series_history").where("run_id = 'r1'").count() == 40 and s.table("series_history").count() == 42
    assert len(s.manifest()["tables"]["series"]["buckets"]) > 4  # rows of one type are not one bucket's


def test_late_rows_count_in_their_own_bucket(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", 4)
    schema = "id long, kind string, at timestamp_ntz, value double"
    rows = [(1, "a", T0 + timedelta(hours=13), 2.0), (2, "a", T0, 4.0), (3, "a", T0 + timedelta(hours=1), None), (4, "a", T0 + timedelta(days=40), 8.0), (5, "a", T0 + timedelta(minutes=1), 1.0)]
    apply = s.batches("x", lambda b: {"series": store.Change(store.partial_series(b, "at", ["kind"], "value", "id"), ["kind", "bucket_start"], store.merged_series(["kind"]))})
    for number, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        apply(spark.createDataFrame(part, schema), number)
        apply(spark.createDataFrame(part, schema), number)  # run again after its commit
    got = sorted((r.bucket_start, r.n, r.avg_value, r.evidence) for r in store.series(s, "series").collect())
    assert got == [(T0, 2, 2.5, 2), (T0 + timedelta(hours=12), 1, 2.0, 1), (T0 + timedelta(days=40), 1, 8.0, 4)]
