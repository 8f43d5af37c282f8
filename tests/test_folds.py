"""Streams whose state is a table, against brute force, out of order and with every batch run twice."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsight.operators import scheduling
from loomsight.plans import catalogue
from loomsight.streaming import folds, stateful

T0 = datetime(2026, 1, 1)
HOUR = 3_600_000_000


def us(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)


def arrive(spark, tmp_path, parts, schema, keys, late, fold, twice=True):
    apply = folds.batches(f"file://{tmp_path}/out", "at", keys, late, *fold)
    for number, part in enumerate(parts):
        for _ in range(1 + twice):
            apply(spark.createDataFrame(part, schema).coalesce(1), number)
    return spark.read.parquet(f"{tmp_path}/out")


def test_recent_duplicates(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        key, at = int(rng.integers(5)), T0 + timedelta(hours=int(k * 3 + rng.integers(-20, 20)))
        status = ["completed", "failed", "failed", "cancelled", "pending", "running"][rng.integers(6)]
        rows.append((key, at, k, *((None, None, k) if rng.random() < 0.5 else (key * 10 + int(rng.integers(3)), status, None))))
    rows += [(0, T0 + timedelta(hours=167 + 6), 900, None, None, 900), (9, T0, 901, 90, "completed", None), (9, T0 + timedelta(hours=168), 902, None, None, 902), (9, T0 + timedelta(hours=168, seconds=1), 903, None, None, 903)]
    rows.sort(key=lambda r: r[2] % 900)
    parts = [rows[:80], rows[80:81], rows[81:160], [], rows[160:], [(None, T0 + timedelta(days=400), None, None, None, None)]]
    schema = "keyword_id long, at timestamp, pos long, task_id long, status string, candidate_id long"
    got = {r.candidate_id: r.is_duplicate for r in arrive(spark, tmp_path, parts, schema, ["keyword_id"], timedelta(days=60), folds.recent_duplicates(["keyword_id"])).collect()}
    want = {}
    for key, at, *_, candidate in rows:
        if candidate is not None:
            last = {}
            for r in sorted((r for r in rows if r[0] == key and r[5] is None and r[1] <= at), key=lambda r: (r[1], r[2])):
                last[r[3]] = (r[4], (at - r[1]) / timedelta(hours=1))
            want[candidate] = any(s in ("pending", "running") or (s == "completed" and h <= 168) or (s == "failed" and h <= 24) for s, h in last.values())
    assert got == want and 0 < sum(want.values()) < len(want)
    assert want[902] and not want[903]


def test_cache(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(90):
        at = T0 + timedelta(seconds=int(k * 20 + rng.integers(-60, 60)))
        rows.append((k, f"k{rng.integers(5)}", at, "write" if rng.random() < 0.5 else "read", f"v{k}", us(at) + int(rng.integers(10, 400)) * 1_000_000 if rng.random() < 0.7 else None))
    parts = [rows[:30], rows[30:60], rows[60:], [(None, None, T0 + timedelta(days=1), None, None, None)]]
    got = {r.pos: (r.value, r.hit) for r in arrive(spark, tmp_path, parts, "pos long, key string, at timestamp, kind string, value string, expires_us long", ["key"], timedelta(minutes=5), folds.cache(["key"])).collect()}
    want = {}
    for pos, key, at, kind, *_ in rows:
        if kind == "read":
            last = max((r for r in rows if r[1] == key and r[3] == "write" and (r[2], r[0]) < (at, pos)), key=lambda r: (r[2], r[0]), default=None)
            hit = last is not None and (last[5] is None or last[5] > us(at))
            want[pos] = (last[4] if hit else None, hit)
    assert got == want


def test_units_and_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"u{rng.integers(6)}", ["schedule", "success", "failure", "failure"][rng.integers(4)], T0 + timedelta(minutes=int(k + rng.integers(-30, 30))), 60, 240, k) for k in range(300)]
    schema = "query_unit_key string, event string, at timestamp, revisit_minutes long, cooldown_minutes long, pos long"
    out = arrive(spark, tmp_path / "u", [rows[:100], rows[100:200], rows[200:]], schema, ["query_unit_key"], timedelta(hours=2), folds.units(["query_unit_key"]))
    for k in range(3):
        want = scheduling.fold_state(spark.createDataFrame(rows[: 100 * (k + 1)], schema)).withColumn("next_due_us", F.unix_micros("next_due_at")).drop("next_due_at")
        assert sorted(map(tuple, out.where(f"batch = {k}").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    rows = [(int(rng.integers(9)), ["start", "complete", "fail", "cancel", "note"][rng.integers(5)], T0 + timedelta(seconds=int(rng.integers(500))), k) for k in range(120)] + [(99, "note", T0, 500)]
    schema = "task_id long, event string, at timestamp, pos long"
    arrive(spark, tmp_path / "t", [rows[:50], rows[50:60], rows[60:]], schema, ["task_id"], timedelta(hours=1), folds.tasks(["task_id"]))
    want = scheduling.task_states(spark.createDataFrame(rows, schema)).na.fill(0).withColumns({"started_us": F.unix_micros("started_at"), "ended_us": F.unix_micros("completed_at")}).drop("started_at", "completed_at")
    got = stateful.latest(spark, f"{tmp_path}/t/out", ["task_id"]).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["stream_recent_duplicates", "stream_cache", "stream_query_state", "stream_task_states"])
def test_streams_of_many_keys_call_no_processor(spark, monkeypatch, name):
    def called(*_, **__):
        raise AssertionError("a processor is called for each key and timer")

    monkeypatch.setattr(stateful, "run", called)
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
