"""The way from task files to the published signals: which runs, which files, which rows, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsight.functions import scalars as S
from loomsight.operators.sampling import numbered

#: JOIN-02: what a keyword tells of the signals of its tasks.
META = ["keyword_id", "normalized_keyword", "topic_cluster", "trend_type", "report_id", "signal_period_type", "signal_period_label", "source_scope", "confidence", "risk_flag"]


def with_metadata(cleaned: DataFrame, tasks: DataFrame, keywords: DataFrame) -> DataFrame:
    """JOIN-02: rows with their keyword's values as ``meta_`` columns, by task; null where either is unknown.

    ``tasks``: task_id and keyword (its key in ``keywords``). ``keywords``: id and any of ``META``.
    """
    known = [c for c in META if c in keywords.columns]
    of_task = tasks.select(F.col("task_id").alias("crawl_task_id"), F.col("keyword").alias("__k"))
    of_keyword = keywords.select(F.col("id").alias("__k"), *[F.col(c).alias(f"meta_{c}") for c in known])
    return cleaned.join(of_task.join(of_keyword, "__k", "left").drop("__k"), "crawl_task_id", "left")


def runtime_events(runs: DataFrame, events: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """FLT-11: task-completed events of completed runtime runs; runs that were asked for and are not there are an error."""
    done = runs.where("run_type = 'int002_runtime' and status = 'completed'")
    if requested:
        done = done.where(F.col("run_id").isin(requested))
        there = {r.run_id for r in done.select("run_id").distinct().limit(len(set(requested))).collect()}
        if gone := [r for r in requested if r not in there]:
            raise ValueError(f"no completed runtime runs: {', '.join(gone)}")
    return events.where("event_type = 'task_completed'").join(done.select("run_id").distinct(), "run_id", "left_semi")


def source_files(events: DataFrame, reports: DataFrame, legacy: DataFrame, explicit: bool = False) -> DataFrame:
    """SET-10: the files to read, ``path, mode, pos``: those of events, then those that only reports name, in order.

    All three tables hold ``path`` and ``pos``; blank paths go. ``mode`` is ``batch_reports`` as soon as a report names a
    file that no event names. Where neither names any, the legacy files are taken, latest names first, unless runs were
    asked for: that is an error.
    """
    named = events.select("path", "pos", F.lit(0).alias("rank")).union(reports.select("path", "pos", F.lit(1).alias("rank")))
    first = named.where(S.filled(F.col("path")).isNotNull()).groupBy("path").agg(F.min(F.struct("rank", "pos")).alias("at"))
    all_of = first.agg(F.coalesce(F.max("at.rank"), F.lit(-1)).alias("top"))
    mode = F.when(F.col("top") == 1, "batch_reports").otherwise("batch_events")
    out = first.crossJoin(F.broadcast(all_of)).select("path", mode.alias("mode"), F.struct("at.rank", "at.pos").alias("o"))
    none = F.col("top") == -1
    asked = F.raise_error(F.lit("no signal files for the requested runs")).cast("boolean") if explicit else F.lit(True)
    old = all_of.where(none).where(asked).crossJoin(legacy.select("path").distinct()).select("path", F.lit("legacy_filesystem").alias("mode"))
    place = (F.col("__n") + 1).cast("int").alias("pos")
    ranked = numbered(out, "o", "path").select("path", "mode", place)
    return ranked.unionByName(numbered(old, F.desc("path")).select("path", "mode", place))


def export_order(signals: DataFrame) -> DataFrame:
    """TOP-06: latest first, then keyword, platform and id, all descending."""
    return signals.orderBy(*[F.desc(c) for c in ("observed_at", "normalized_keyword", "source_platform", "signal_id")])


def export_rows(signals: DataFrame, platform: str | None = None, keyword: str | None = None, limit: int = 100) -> DataFrame:
    """FLT-02: the first ``limit`` signals, in order of ``pos``, of a platform by any of its names and of a keyword."""
    out = signals.where(F.col("normalized_keyword") == keyword) if keyword else signals
    out = out.where(F.col("source_platform") == S.signal_platform(F.lit(platform))) if platform else out
    return out.orderBy("pos").limit(limit)


def run_totals(results: DataFrame, *by: str) -> DataFrame:
    """AGG-13: tasks, ends, and sums of what they made, of a run. ``results``: success, signal_count, cleaned_count, platform."""
    failed = F.count_if(~F.coalesce(F.col("success"), F.lit(False)))
    return results.groupBy(*by).agg(
        F.count_distinct("platform").alias("platform_count"),
        F.count("*").alias("scheduled_task_count"),
        F.count_if(F.coalesce(F.col("success"), F.lit(False))).alias("completed_task_count"),
        failed.alias("failed_task_count"),
        F.coalesce(F.sum("signal_count"), F.lit(0)).alias("generated_signal_count"),
        F.coalesce(F.sum("cleaned_count"), F.lit(0)).alias("cleaned_row_count"),
        (failed == 0).alias("success"),
    )


def keyword_checks(tasks: DataFrame, check: Column) -> DataFrame:
    """AGG-19: tasks of each keyword, and whether ``check`` holds for all of them."""
    return tasks.groupBy("keyword_id").agg(F.count("*").alias("task_count"), F.bool_and(F.coalesce(check, F.lit(False))).alias("all_pass"))


def group_sizes(rows: DataFrame, by: str, source: str) -> DataFrame:
    """AGG-16: rows and distinct sources of each group, largest first."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(source).alias("sources")).orderBy(F.desc("n"), by)


def task_rollup(rows: DataFrame, by: list[str], time: str, done: Column) -> DataFrame:
    """AGG-20: rows, the latest of them and those that are done, by task, platform and keyword."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.max(time).alias("last_created"), F.count_if(done).alias("completed"))


def sentiments(rows: DataFrame, by: list[str]) -> DataFrame:
    """D-06: how often each sentiment comes up, as a map with all three."""
    kinds = ("positive", "neutral", "negative")
    counts = [F.count_if(F.col("sentiment") == k) for k in kinds]
    return rows.groupBy(*by).agg(F.create_map(*[x for k, n in zip(kinds, counts) for x in (F.lit(k), n)]).alias("sentiment_distribution"))


def bucket_extras(signals: DataFrame, bucket: Column) -> DataFrame:
    """D-05: per bucket the keywords that no earlier bucket has, and signals by platform."""
    rows = signals.select(bucket.alias("bucket_start"), "normalized_keyword", "source_platform")
    first = rows.groupBy("normalized_keyword").agg(F.min("bucket_start").alias("bucket_start")).groupBy("bucket_start").agg(F.count("*").alias("new_term_count"))
    each = rows.groupBy("bucket_start", "source_platform").agg(F.count("*").alias("n"))
    by_platform = each.groupBy("bucket_start").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_platform", "n")))).alias("platform_distribution"))
    return by_platform.join(first, "bucket_start", "left").withColumn("new_term_count", F.coalesce("new_term_count", F.lit(0)))
