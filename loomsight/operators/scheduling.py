"""Due keywords, query state, duplicates of tasks, batch items and their audit. Every function takes its clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsight.functions import fixed
from loomsight.functions import scalars as S


def priority_rank(c: Column) -> Column:
    """TOP-02."""
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def due_keywords(keywords: DataFrame, now: Column, platform: str | None = None) -> DataFrame:
    """FLT-03, FLT-04: never crawled, or longer ago than the period type allows; unknown types are due once."""
    df = keywords.where(F.coalesce(F.col("is_active"), F.lit(False))) if "is_active" in keywords.columns else keywords
    df = df.where(F.col("suggested_platforms").like(f"%{platform}%")) if platform else df
    days = S.lookup(fixed.DUE_DAYS, F.col("signal_period_type"))
    return df.where(F.col("last_crawled_at").isNull() | F.coalesce(F.col("last_crawled_at") < now - F.make_dt_interval(days=days), F.lit(False)))


def due_units(states: DataFrame, now: Column, limit: int = 3) -> DataFrame:
    """FLT-06, TOP-03: per keyword and platform the units due longest."""
    w = Window.partitionBy("keyword_id", "platform_code").orderBy("next_due_at", "query_state_id")
    return states.where(F.col("is_active") & (F.col("next_due_at") <= now)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def schedule_candidates(due: DataFrame, registry: DataFrame, planned: DataFrame) -> DataFrame:
    """JOIN-03, KX-10: due units that are in the approved registry, with the plan's values where there is one."""
    approved = registry.where("status = 'approved' and review_status = 'approved'")
    out = due.join(approved.select("query_unit_key", F.col("expanded_query").alias("reg_query"), F.col("expansion_type").alias("reg_type")), "query_unit_key")
    out = out.join(planned.select("query_unit_key", "expanded_query", "expansion_type"), "query_unit_key", "left")
    return out.withColumns({"expanded_query": F.coalesce("expanded_query", "reg_query"), "expansion_type": F.coalesce("expansion_type", "reg_type")}).drop("reg_query", "reg_type")


def recent_duplicates(candidates: DataFrame, tasks: DataFrame, now: Column, within_hours: int = 168, cooldown_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """JOIN-06, ST-05: candidates with no recent task of their key, and those that have one."""
    ended = F.coalesce("completed_at", "updated_at", "created_at")
    recent = (
        F.col("status").isin("pending", "running")
        | ((F.col("status") == "completed") & (ended >= now - F.make_dt_interval(hours=F.lit(within_hours))))
        | ((F.col("status") == "failed") & (ended >= now - F.make_dt_interval(hours=F.lit(cooldown_hours))))
    )
    hits = tasks.where(recent).select("keyword_id", "dedup_key").distinct()
    return candidates.join(hits, ["keyword_id", "dedup_key"], "left_anti"), candidates.join(hits, ["keyword_id", "dedup_key"], "left_semi")


def missing(requested: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """JOIN-07, FLT-11."""
    return requested.select(key).distinct().join(present.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """SNK-10, SNK-11, JOIN-05, ST-07: merge by natural key. The new side wins, except columns in ``keep``; with ``only``,
    rows that exist take those columns alone."""
    a = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o__"))
    b = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n__"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = F.col("o__") & F.col("n__")
    stays = lambda c: c in key or c in (keep or []) or (only is not None and c not in only)
    value = lambda c: F.when(F.col("n__").isNull(), F.col(f"o_{c}")).when(both, F.col(f"o_{c}") if stays(c) else F.col(f"n_{c}")).otherwise(F.col(f"n_{c}"))
    return a.join(b, cond, "full_outer").select(*[value(c).alias(c) for c in old.columns])


def active_registry(registry: DataFrame, keyword: Column | None = None, codes: list[str] | None = None) -> DataFrame:
    """FLT-05: active, approved rows of a keyword, in order; platform codes stand for all their labels."""
    out = registry.where("is_active and status = 'approved'")
    out = out.where(F.col("keyword_db_id") == keyword) if keyword is not None else out
    labels = sorted(k for k, v in fixed.PLATFORM_CODES.items() if v in set(codes or ()) and k not in fixed.PLATFORM_CODES.values())
    return (out.where(F.col("platform").isin(labels)) if labels else out).orderBy("platform", "expanded_query")


def _merged(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, Column, Column]:
    """Both sides as structs ``o`` and ``n``; whether a row is old, and whether it is new."""
    a = old.select(*[F.col(c).alias(f"__{c}") for c in key], F.struct("*").alias("o"))
    b = new.select(*[F.col(c).alias(f"__{c}") for c in key], F.struct("*").alias("n"))
    return a.join(b, [f"__{c}" for c in key], "full_outer"), F.col("o").isNotNull(), F.col("n").isNotNull()


#: ST-07: what an operator's decision locks.
LOCKED = ["source_type", "review_status", "status", "is_active"]
REFRESHED = ["expansion_type", "based_on", "notes"]


def registry_upsert(registry: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """ST-07: rows merged by keyword, platform and query. Lifetimes are always refreshed; a status only while no operator
    has decided it.

    Both sides: keyword_db_id, platform, expanded_query, ``LOCKED`` (but is_active on the new side), ``REFRESHED``,
    ttl_days; the registry has is_active, expires_at and last_seen_at too. New rows are distinct by key.
    """
    key = ["keyword_db_id", "platform", "expanded_query"]
    days = F.when(F.coalesce("ttl_days", F.lit(0)) == 0, 30).otherwise(F.col("ttl_days"))
    fresh = rows.select(*key, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("source_type", "manual"), ("review_status", "approved"), ("status", "approved"))], *REFRESHED, days.alias("ttl_days"))
    fresh = fresh.withColumns({"is_active": F.col("status") != "deprecated", "expires_at": now + F.make_dt_interval(days=F.col("ttl_days")), "last_seen_at": now})
    both, was, comes = _merged(registry, fresh, key)
    locked = F.col("o.review_status").isin("approved", "rejected") | F.col("o.status").isin("approved", "deprecated")

    def value(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in REFRESHED:
            merged = F.coalesce(new, old)
        elif c in LOCKED:
            merged = F.when(locked, old).otherwise(new)
        else:
            merged = new
        return F.when(~was, new).when(~comes, old).otherwise(merged).alias(c)

    return both.select(*[value(c) for c in [*key, *LOCKED, *REFRESHED, "ttl_days", "expires_at", "last_seen_at"]])


#: ST-08: what a known unit takes anew.
RETIMED = ["tier", "risk_level", "revisit_minutes", "cooldown_minutes", "is_active"]


def state_ensure(states: DataFrame, units: DataFrame, now: Column) -> DataFrame:
    """ST-08: units without a state get one that is due now; known ones take tier, risk, intervals and activity, and keep
    the time they are due. Both sides: query_unit_key, ``RETIMED``; states have next_due_at. Units are distinct by key."""
    both, was, comes = _merged(states, units, ["query_unit_key"])
    new = [F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in RETIMED]
    return both.select(F.col("__query_unit_key").alias("query_unit_key"), *new, F.when(was, F.col("o.next_due_at")).otherwise(now).alias("next_due_at"))


#: ST-12: the status that an event gives a task, and the level of its log row.
TASK_EVENTS = {"start": ("running", "info"), "complete": ("completed", "success"), "fail": ("failed", "error"), "cancel": ("cancelled", "warning")}


def task_states(events: DataFrame) -> DataFrame:
    """ST-12: a task after its events, ``pending`` before any: status, when it started and ended, its log rows by level.

    ``events``: task_id, event, at, pos. The last event decides; unknown events change nothing.
    """
    known = events.where(F.col("event").isin(*TASK_EVENTS))
    status = S.lookup({k: v[0] for k, v in TASK_EVENTS.items()}, F.col("event"))
    level = S.lookup({k: v[1] for k, v in TASK_EVENTS.items()}, F.col("event"))
    at = F.struct("at", "pos")
    folded = known.withColumns({"s": status, "level": level}).groupBy("task_id").agg(
        F.max_by("s", at).alias("status"),
        F.max_by(F.when(F.col("event") == "start", F.col("at")), F.when(F.col("event") == "start", at)).alias("started_at"),
        F.max_by(F.when(F.col("event") != "start", F.col("at")), F.when(F.col("event") != "start", at)).alias("completed_at"),
        *[F.count_if(F.col("level") == x).alias(f"{x}_logs") for x in ("info", "success", "error", "warning")],
    )
    out = events.select("task_id").distinct().join(folded, "task_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("pending")))


def fold_state(events: DataFrame) -> DataFrame:
    """ST-06, ST-08, ST-12: per unit the state after its events: schedule, success, failure.

    ``events``: query_unit_key, event, at, revisit_minutes, cooldown_minutes, pos. Failures count since the last success.
    """
    order = F.struct("at", "pos")
    last_ok = F.max(F.when(F.col("event") == "success", order))
    ends = F.col("event").isin("success", "failure")
    one = events.groupBy("query_unit_key").agg(F.count("*").alias("n_events"), last_ok.alias("ok"), F.max_by(F.when(ends, F.struct("event", "at", "revisit_minutes", "cooldown_minutes")), F.when(ends, order)).alias("last"), F.max_by("event", order).alias("last_event"))
    fails = events.where("event = 'failure'").join(one.select("query_unit_key", "ok"), "query_unit_key").where(F.col("ok").isNull() | (F.struct("at", "pos") > F.col("ok"))).groupBy("query_unit_key").agg(F.count("*").alias("failures"))
    minutes = F.when(F.col("last.event") == "success", F.col("last.revisit_minutes")).otherwise(F.col("last.cooldown_minutes"))
    out = one.join(fails, "query_unit_key", "left")
    return out.select("query_unit_key", "n_events", "last_event", F.coalesce("failures", F.lit(0)).alias("failure_count"), (F.col("last.at") + F.make_dt_interval(mins=minutes)).alias("next_due_at"))


def item_transition(status: Column, success: Column, cleaned: Column, signals: Column, error: Column) -> Column:
    """ST-09: a finished item; success without output is a terminal failure."""
    empty = (F.coalesce(cleaned, F.lit(0)) == 0) | (F.coalesce(signals, F.lit(0)) == 0)
    return F.when(success & ~empty, "succeeded").when(success, "failed_terminal").when(S.retryable(error), "failed_retryable").otherwise("failed_terminal")


def reconcile(items: DataFrame, tasks: DataFrame, now: Column, minutes: int = 45) -> DataFrame:
    """ST-10, JOIN-04: open items without a heartbeat for a while get their task's end, or go back to the plan."""
    open_ = F.col("item_status").isin("running", "dispatched", "planned")
    stale = open_ & (F.col("last_heartbeat_at").isNull() | (F.col("last_heartbeat_at") <= now - F.make_dt_interval(mins=F.lit(minutes))))
    df = items.join(tasks.select(F.col("task_id"), F.col("status").alias("task_status"), "error_message"), "task_id", "left")
    action = (
        F.when(~stale, None)
        .when(F.col("task_status") == "completed", "close_as_succeeded")
        .when(F.col("task_status").isin("failed", "cancelled"), F.when(S.retryable(F.col("error_message")), "mark_failed_retryable").otherwise("mark_failed_terminal"))
        .otherwise("requeue_planned")
    )
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("close_as_succeeded", "succeeded", "mark_failed_retryable", "failed_retryable", "mark_failed_terminal", "failed_terminal", "requeue_planned", "planned")]), F.col("action"))
    return df.withColumn("action", action).withColumn("item_status", F.coalesce(status, F.col("item_status")))


def demoted(items: DataFrame) -> DataFrame:
    """ST-11: succeeded items whose task's summary shows no output count as terminal failures."""
    empty = (F.coalesce("cleaned_count", F.lit(0)) == 0) | (F.coalesce("signal_count", F.lit(0)) == 0)
    return items.withColumn("item_status", F.when((F.col("item_status") == "succeeded") & empty, "failed_terminal").otherwise(F.col("item_status")))


def audit(items: DataFrame, key: str = "run_id") -> DataFrame:
    """AGG-12, ST-11: counts by state and what they make of the batch."""
    count = lambda *s: F.count_if(F.col("item_status").isin(*s))
    out = items.groupBy(key).agg(F.count("*").alias("total"), count("succeeded").alias("succeeded"), count("failed_retryable").alias("retryable"), count("failed_terminal").alias("terminal"), count("planned", "dispatched", "running").alias("running"))
    return out.withColumn("classification", F.when((F.col("total") == 0) | (F.col("succeeded") == F.col("total")), "completed_full").when((F.col("succeeded") > 0) & (F.col("terminal") > 0) & (F.col("retryable") == 0) & (F.col("running") == 0), "completed_partial").otherwise("failed"))


def least_used(accounts: DataFrame, platform: str) -> DataFrame:
    """TOP-08."""
    return accounts.where((F.col("platform") == platform) & (F.col("status") == "active")).orderBy("usage_count", "id").limit(1)


def pick_account(accounts: DataFrame, platform: str) -> DataFrame:
    """TOP-08: all accounts, the least used one of the platform counted once more."""
    one = least_used(accounts, platform).select("id", F.lit(1).alias("__more"))
    return accounts.join(F.broadcast(one), "id", "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("__more", F.lit(0))).drop("__more")


def requeue(items: DataFrame, limit: int) -> DataFrame:
    """TOP-09."""
    return items.where(F.col("item_status").isin("planned", "failed_retryable")).orderBy("created_at", "id").limit(limit)


def newest(df: DataFrame, time: str, pos: str, limit: int, offset: int = 0) -> DataFrame:
    """TOP-07, TOP-10, TOP-12."""
    return df.orderBy(F.desc(time), F.desc(pos)).offset(offset).limit(limit)


def by_priority(rows: DataFrame, limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """TOP-02: high, medium, low, then all others, by key within; a page of them."""
    out = rows.orderBy(priority_rank(F.col("priority")), key)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def head(rows: DataFrame, pos: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """TOP-11: the first rows in input order, of all or of each group; ``pos`` is the order and theirs alone."""
    if not by:
        return rows.orderBy(pos).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(pos))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


#: ST-01: when a platform is crawled, in the time of ``SCHEDULE_ZONE``. Fixed values.
DAILY = {"xhs": (8, 0), "dy": (8, 30), "bili": (9, 0), "wb": (9, 30)}
SCHEDULE_ZONE = "Asia/Shanghai"


def due_runs(spark, after: Column, until: Column, daily: dict[str, tuple[int, int]] | None = None, zone: str = SCHEDULE_ZONE) -> DataFrame:
    """ST-01: the runs whose time lies behind ``after`` and not behind ``until`` (timestamps): ``platform, run_at``.

    A trigger that comes late or not at all leaves nothing out: it asks from the last run that was made.
    """
    day = F.explode(F.sequence(F.to_date(after) - F.expr("interval 1 day"), F.to_date(until) + F.expr("interval 1 day")))
    times = F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(f"{h:02d}:{m:02d}:00").alias("at")) for p, (h, m) in (daily or DAILY).items()])
    runs = spark.range(1).select(day.alias("day")).select("day", F.explode(times).alias("t"))
    local = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), "t.at"))
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return runs.select("t.platform", at.alias("run_at")).where((F.col("run_at") > after) & (F.col("run_at") <= until))
