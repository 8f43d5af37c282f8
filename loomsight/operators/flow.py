"""KX-10: one scheduling run over registry, query states, tasks and events, committed as one step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsight.operators import scheduling
from loomsight.sources.sinks import scratch
from loomsight.streaming.store import Change, Store

REGISTRY_KEY = ["keyword_db_id", "platform", "expanded_query"]
REGISTRY = "keyword_db_id long, platform string, expanded_query string, source_type string, review_status string, status string, is_active boolean, expansion_type string, based_on string, notes string, ttl_days int, expires_at timestamp_ntz, last_seen_at timestamp_ntz"
STATES = "query_unit_key string, keyword_id long, platform_code string, tier string, risk_level string, revisit_minutes int, cooldown_minutes int, is_active boolean, next_due_at timestamp_ntz, last_task_id string, last_scheduled_at timestamp_ntz"
TASKS = "task_id string, keyword_id long, platform string, task_keyword string, dedup_key string, status string, query_origin string, created_at timestamp_ntz, completed_at timestamp_ntz, updated_at timestamp_ntz"
EVENTS = "event_id string, event_type string, keyword_id long, platform string, task_keyword string, task_id string, at timestamp_ntz, message string"


@dataclass(frozen=True)
class Options:
    """Due units of a keyword and platform that become tasks at most, and how long tasks count as duplicates."""

    per_unit: int = 3
    within_hours: int = 168
    cooldown_hours: int = 24


def dedup_key(keyword: Column, platform: Column, query: Column) -> Column:
    return F.concat_ws("|", keyword.cast("string"), platform, F.lower(F.trim(query)))


def create(store: Store) -> None:
    """The four tables, empty, unless they are there."""
    have = store.manifest()["tables"]
    empty = {"registry": (REGISTRY, REGISTRY_KEY), "states": (STATES, ["query_unit_key"]), "tasks": (TASKS, ["task_id"]), "events": (EVENTS, ["event_id"])}
    missing = {n: Change(store.spark.createDataFrame([], s), k) for n, (s, k) in empty.items() if n not in have}
    if missing:
        store.commit("create", 0, missing)


def _held(df: DataFrame) -> DataFrame:
    """Written once, since several tables follow from it."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def schedule(store: Store, planned: DataFrame, now: Column, run: str, number: int, options: Options = Options()) -> bool:
    """One run: registry upsert, states for approved units, due units, those that are registered, no recent duplicates, tasks and events.

    ``planned``: keyword_id, query_unit_key, platform, platform_code, expanded_query, expansion_type, based_on, source_type,
    review_status, status, notes, ttl_days, tier, risk_level, revisit_minutes, cooldown_minutes; distinct by unit. Only
    keywords of the plan are scheduled. All four tables change together; a run that fails changes none, and one that is
    repeated after its commit nothing. Events: ``scheduled``, ``skipped_duplicate``, and ``no_task_candidates`` for a
    keyword of which nothing is due.
    """
    planned = _held(planned)
    registry, states, tasks = (store.table(n) for n in ("registry", "states", "tasks"))
    rows = planned.select(F.col("keyword_id").alias("keyword_db_id"), "platform", "expanded_query", "source_type", "review_status", "status", "expansion_type", "based_on", "notes", "ttl_days")
    # only keys of the plan change
    touched = scheduling.registry_upsert(registry.join(rows.select(*REGISTRY_KEY), REGISTRY_KEY, "left_semi"), rows, now)
    touched = _held(touched.withColumn("ttl_days", F.col("ttl_days").cast("int")))
    approved = touched.where("is_active and status = 'approved'").select(F.col("keyword_db_id").alias("keyword_id"), "platform", "expanded_query", "review_status", "status")
    units = planned.drop("review_status", "status").join(approved, ["keyword_id", "platform", "expanded_query"])

    of_plan = states.join(planned.select("keyword_id").distinct(), "keyword_id", "left_semi")
    fresh = units.select("query_unit_key", "tier", "risk_level", "revisit_minutes", "cooldown_minutes", F.lit(True).alias("is_active"))
    ensured = scheduling.state_ensure(of_plan.select("query_unit_key", *scheduling.RETIMED, "next_due_at"), fresh, now)
    known = of_plan.select("query_unit_key", "keyword_id", "platform_code", "last_task_id", "last_scheduled_at")
    new = units.select("query_unit_key", "keyword_id", "platform_code").join(known.select("query_unit_key"), "query_unit_key", "left_anti")
    ensured = _held(ensured.join(known.unionByName(new, allowMissingColumns=True), "query_unit_key"))

    due = scheduling.due_units(ensured.withColumn("query_state_id", F.col("query_unit_key")), now, options.per_unit)
    listed = units.select("query_unit_key", "expanded_query", "expansion_type", "status", "review_status")
    candidates = scheduling.schedule_candidates(due.select("query_unit_key", "keyword_id", "platform_code"), listed, planned.select("query_unit_key", "expanded_query", "expansion_type"))
    candidates = _held(candidates.withColumn("dedup_key", dedup_key(F.col("keyword_id"), F.col("platform_code"), F.col("expanded_query"))))
    free, taken = scheduling.recent_duplicates(candidates, tasks, now, options.within_hours, options.cooldown_hours)

    task_id = F.concat(F.lit("task_"), F.substring(F.md5(F.concat_ws("|", F.lit(run), "dedup_key")), 1, 16))
    none = F.lit(None).cast("timestamp_ntz")
    made = _held(free.select("query_unit_key", task_id.alias("task_id"), "keyword_id", F.col("platform_code").alias("platform"), F.col("expanded_query").alias("task_keyword"), "dedup_key", F.lit("pending").alias("status"), F.col("expansion_type").alias("query_origin"), now.alias("created_at"), none.alias("completed_at"), none.alias("updated_at")))
    event = lambda kind, *parts: F.concat(F.lit("event_"), F.substring(F.md5(F.concat_ws("|", F.lit(run), F.lit(kind), *parts)), 1, 16)).alias("event_id")
    text = F.lit(None).cast("string")
    scheduled = made.select(event("scheduled", "dedup_key"), F.lit("scheduled").alias("event_type"), "keyword_id", "platform", "task_keyword", "task_id", now.alias("at"), F.concat(F.lit("Scheduled task "), "task_id", F.lit(" for query "), "task_keyword").alias("message"))
    skipped = taken.select(event("skipped_duplicate", "dedup_key"), F.lit("skipped_duplicate").alias("event_type"), "keyword_id", F.col("platform_code").alias("platform"), F.col("expanded_query").alias("task_keyword"), text.alias("task_id"), now.alias("at"), F.lit("Skipped duplicate task").alias("message"))
    idle = planned.select("keyword_id").distinct().join(candidates.select("keyword_id"), "keyword_id", "left_anti")
    idle = idle.select(event("no_task_candidates", F.col("keyword_id").cast("string")), F.lit("no_task_candidates").alias("event_type"), "keyword_id", text.alias("platform"), text.alias("task_keyword"), text.alias("task_id"), now.alias("at"), F.lit("No crawlable task candidates after policy filtering").alias("message"))

    marked = ensured.join(made.select("query_unit_key", F.col("task_id").alias("__task")), "query_unit_key", "left")
    marked = marked.withColumns({"last_task_id": F.coalesce("__task", "last_task_id"), "last_scheduled_at": F.when(F.col("__task").isNotNull(), now).otherwise(F.col("last_scheduled_at"))})
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    return store.commit("schedule", number, {
        "registry": Change(touched.select(*names(REGISTRY)), REGISTRY_KEY), "states": Change(marked.select(*names(STATES)), ["query_unit_key"]),
        "tasks": Change(made.select(*names(TASKS)), ["task_id"]), "events": Change(scheduled.unionByName(skipped).unionByName(idle).select(*names(EVENTS)), ["event_id"]),
    })
