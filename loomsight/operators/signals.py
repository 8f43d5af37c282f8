"""Cleaned content to deduplicated trend signals, their time series, and summaries.

Every operator is a function of DataFrames with an explicit clock and explicit order keys. Groups are reduced by
aggregates that combine before the shuffle; only evidence ids, which are the result, are collected whole.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsight.functions import scalars as S

KEY = ["normalized_keyword", "topic_cluster", "trend_type", "source_platform"]


def raw_scan(sources: dict[str, DataFrame], keyword: str | None = None, since=None) -> DataFrame:
    """SRC-14, SET-05: per platform frames of one canonical schema; a time limit except on weibo."""
    out = None
    for code, df in sources.items():
        df = df if keyword is None else df.where(F.col("source_keyword") == keyword)
        df = df if since is None or code == "wb" else df.where(F.col("created_at") >= since)
        df = df.withColumn("platform_code", F.lit(code)).withColumn("source_type", F.lit("note" if code in ("xhs", "wb") else "video"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def clean(rows: DataFrame, keyword: str = "source_keyword") -> DataFrame:
    """FLT-10, S-07..S-12: rows with a title or text get a score, summary, topics and sentiment; flagged noise goes."""
    rows = rows.where((S.filled(F.col("title")).isNotNull()) | (S.filled(F.col("desc")).isNotNull()))
    rows = rows.where(~F.coalesce(F.col("noise"), F.lit(False))) if "noise" in rows.columns else rows
    summary, sentiment = S.analysis(F.coalesce("title", F.lit("")), F.coalesce("desc", F.lit("")), F.col(keyword))
    score = S.engagement(*[F.col(c) for c in ("liked_count", "collected_count", "comment_count", "share_count")])
    return rows.withColumns({"summary": summary, "sentiment": sentiment, "topics": F.col(keyword), "trend_score": score, "title": F.left(F.coalesce("title", F.lit("")), F.lit(500))})


def query_cleaned(df: DataFrame, keyword=None, platform=None, sentiment=None, min_score=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """FLT-01, TOP-01: arguments that are unset do not filter."""
    for name, value in (("keyword", keyword), ("source_platform", platform), ("sentiment", sentiment)):
        df = df.where(F.col(name) == value) if value else df
    df = df.where(F.col("trend_score") >= min_score) if min_score else df
    return df.orderBy(F.desc("trend_score"), "id").offset(offset).limit(limit)


def _fields(cleaned: DataFrame, meta: dict | None):
    """Of a signal's fields, by name, what the rows or ``meta`` say."""
    meta = {k: v for k, v in (meta or {}).items() if v}
    have = set(cleaned.columns)

    def field(c: str):
        if c in meta:
            return F.lit(meta[c])
        own = [F.nullif(F.col(x), F.lit("")) for x in (f"meta_{c}", c) if x in have]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    return field


def keyed_rows(cleaned: DataFrame, meta: dict | None = None) -> DataFrame:
    """Cleaned rows with the columns by which signals are grouped and ranked."""
    field = _fields(cleaned, meta)
    fallback = F.col("keyword") if "keyword" in cleaned.columns else F.lit("")
    return cleaned.withColumns(
        {
            "normalized_keyword": F.coalesce(field("normalized_keyword"), fallback),
            "topic_cluster": F.coalesce(field("topic_cluster"), fallback),
            "trend_type": F.coalesce(field("trend_type"), F.lit("category")),
            "source_platform": S.signal_platform(F.col("source_platform")),
            "score": F.coalesce(F.col("trend_score"), F.lit(0.0)),
            "risk": S.risk_of_topics(F.col("topics")),
            "iso": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        }
    )


def trend_evidence(cleaned: DataFrame, meta: dict | None = None, by_task: bool = False) -> DataFrame:
    """AGG-07: the evidence of every signal as a table of its own: the key, ``id`` and ``rank``, best first.

    For signals whose evidence is long: no row holds a group; ranks come from a sort that can spill.
    """
    group = [*KEY, "crawl_task_id"] if by_task else KEY
    best = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("iso"), F.desc("id"))
    return keyed_rows(cleaned, meta).select(*group, "id", F.row_number().over(best).alias("rank"))


def trend_signals(cleaned: DataFrame, meta: dict | None = None, freshness_days: int = 7, by_task: bool = False, evidence: bool = True) -> DataFrame:
    """AGG-01..07: a signal per keyword, cluster, type and platform, and per task if ``by_task``.

    ``cleaned``: id, keyword and key columns, crawl_task_id, title, summary, topics, trend_score, created_at (timestamp),
    raw_data (JSON), confidence, risk_flag. ``meta`` overrides keys, confidence, risk and report columns where set; so do
    ``meta_`` columns of the rows (``export.with_metadata``), each for its own rows. Without ``evidence`` the ids of a
    signal's rows are left out, which ``trend_evidence`` has as a table: the form for groups of any size.
    """
    group = [*KEY, "crawl_task_id"] if by_task else KEY
    meta = {k: v for k, v in (meta or {}).items() if v}
    have, field = set(cleaned.columns), _fields(cleaned, meta)
    rows = keyed_rows(cleaned, meta)
    task_keyword = F.nullif(F.col("meta_keyword_id").cast("string"), F.lit("")) if "meta_keyword_id" in have else F.lit(None).cast("string")
    extra = ["report_id", "signal_period_type", "signal_period_label", "source_scope", "confidence", "risk_flag"]
    rank = F.struct("score", "iso", "id")
    snippet = F.concat_ws(" | ", *[S.filled(F.col(c)) if c in have else F.lit(None).cast("string") for c in ("title", "summary", "topics")])
    url = S.source_url(F.col("raw_data"), F.col("source_id") if "source_id" in have else F.col("id"), F.col("source_platform"))
    head = F.struct("id", "crawl_task_id", url.alias("url"), task_keyword.alias("keyword_id"), *[field(c).alias(c) for c in extra])
    # one ranked pass: the three best rows' texts by a window that stops at rank three, the rest by plain aggregates
    best = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("iso"), F.desc("id"))
    top = rows.withColumn("rn", F.row_number().over(best)).where("rn <= 3").groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rn", snippet.alias("s")))).alias("top"))
    groups = rows.groupBy(*group).agg(
        F.count("*").alias("support_count"),
        F.max("score").alias("most"),
        F.max_by(head, rank).alias("head"),
        F.max("created_at").alias("observed_at"),
        F.bool_or(F.col("risk") == "high").alias("any_high"),
        F.bool_or(F.col("risk") == "medium").alias("any_medium"),
        (F.sort_array(F.collect_list(F.struct("score", "iso", "id")), asc=False) if evidence else F.array().cast("array<struct<id:string>>")).alias("ranked"),
    )
    n, most = F.col("support_count"), F.col("most")
    score = F.round(F.least(F.lit(100.0), F.when(most > 100, most / 4).otherwise(most) + F.least(F.greatest(n - 1, F.lit(0)), F.lit(5)) * 5), 1)
    stated = F.col("head.confidence")
    confidence = F.when(stated.isin("low", "medium", "high"), stated).when((n >= 3) & (F.col("trend_score") >= 70), "high").when((n >= 2) & (F.col("trend_score") >= 45), "medium").when(F.col("trend_score") >= 65, "medium").otherwise("low")
    flag = F.col("head.risk_flag")
    risk = F.when((flag == "high") | F.col("any_high"), "high").when((flag == "medium") | F.col("any_medium"), "medium").otherwise("low")
    same = reduce(and_, [F.col(f"g.{k}").eqNullSafe(F.col(f"t.{k}")) for k in group])
    joined = groups.alias("g").join(top.alias("t"), on=same, how="left").select("g.*", "t.top")
    keyword_id = F.lit(meta["keyword_id"]) if "keyword_id" in meta else F.coalesce("head.keyword_id", F.concat(F.lit("KW_TASK_"), F.col("head.crawl_task_id").cast("string")))
    return joined.withColumn("trend_score", score).select(
        F.concat(F.lit("TS_"), F.date_format("observed_at", "yyyyMMdd"), F.lit("_"), F.col("head.crawl_task_id").cast("string"), F.lit("_"), F.col("head.id").cast("string")).alias("signal_id"),
        keyword_id.alias("keyword_id"),
        F.col("head.crawl_task_id").alias("crawl_task_id"),
        *KEY,
        F.concat("normalized_keyword", F.lit(" 在 "), "source_platform", F.lit(" 聚合出 "), n.cast("string"), F.lit(" 条相关信号，代表性主题为"), "topic_cluster", F.lit("。")).alias("signal_summary"),
        F.left(F.array_join(F.filter(F.transform("top", lambda x: x["s"]), lambda x: x != ""), " || "), F.lit(800)).alias("signal_evidence"),
        F.col("head.url").alias("source_url"),
        "trend_score",
        confidence.alias("confidence"),
        risk.alias("risk_flag"),
        "observed_at",
        (F.col("observed_at") + F.make_dt_interval(days=F.lit(freshness_days))).alias("fresh_until"),
        *[F.col(f"head.{c}").alias(c) for c in extra[:4]],
        n.cast("int").alias("support_count"),
        F.transform("ranked", lambda r: F.concat(F.lit("CTD_"), r["id"].cast("string"))).alias("evidence_ids"),
        F.lit("grouped_signal_v1").alias("aggregation_method"),
        F.lit("v0.2").alias("version"),
    )


def signal_totals(cleaned: DataFrame, signals: DataFrame) -> DataFrame:
    """AGG-08."""
    return signals.agg(F.count("*").alias("signal_count"), F.coalesce(F.max("support_count"), F.lit(0)).alias("max_support")).crossJoin(cleaned.agg(F.count("*").alias("input_count")))


def latest(rows: DataFrame, key: str, time: str, pos: str) -> DataFrame:
    """SET-01: the latest row of each key; of equal times the later row; null times are the epoch's."""
    names = [c for c in rows.columns if c != key]
    at = F.coalesce(F.col(time), F.lit(0).cast("timestamp").cast(rows.schema[time].dataType))
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(at, pos)).alias("r")).select(key, "r.*")


def first_rows(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """SET-02: the first row of each key by position."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*names), pos).alias("r")).select(key, "r.*")


def series_members(signals: DataFrame, kind: str = "1d") -> DataFrame:
    """AGG-09: the distinct signals and tasks of every bucket as a table: ``normalized_keyword, source_platform, bucket_start, member, kind``."""
    rows = signals.where((F.trim(F.coalesce("normalized_keyword", F.lit(""))) != "") & (F.trim(F.coalesce("source_platform", F.lit(""))) != ""))
    key = [F.trim("normalized_keyword").alias("normalized_keyword"), F.trim("source_platform").alias("source_platform"), S.bucket_start(F.col("observed_at"), kind).alias("bucket_start")]
    member = F.explode(F.array(F.struct(F.col("signal_id").alias("member"), F.lit("signal").alias("kind")), F.struct(F.col("crawl_task_id").cast("int").cast("string").alias("member"), F.lit("task").alias("kind"))))
    return rows.select(*key, member.alias("m")).select("normalized_keyword", "source_platform", "bucket_start", "m.member", "m.kind").where("member is not null").distinct()


def series(signals: DataFrame, kind: str = "1d", emerging: float = 10.0, digits: int = 2) -> DataFrame:
    """AGG-09, WIN-01, WIN-02: mean score by keyword, platform and bucket, against the bucket before that has rows.

    ``signals``: signal_id, crawl_task_id, normalized_keyword, source_platform, trend_score, observed_at, signal_evidence, pos.
    """
    rows = signals.where((F.trim(F.coalesce("normalized_keyword", F.lit(""))) != "") & (F.trim(F.coalesce("source_platform", F.lit(""))) != ""))
    key = [F.trim("normalized_keyword").alias("normalized_keyword"), F.trim("source_platform").alias("source_platform"), S.bucket_start(F.col("observed_at"), kind).alias("bucket_start")]
    buckets = rows.groupBy(*key).agg(
        F.array_sort(F.collect_set("signal_id")).alias("signal_ids"),
        F.array_sort(F.collect_set(F.col("crawl_task_id").cast("int"))).alias("task_ids"),
        F.round(F.avg(F.coalesce("trend_score", F.lit(0.0))), digits).alias("avg_trend_score"),
        F.min_by("signal_evidence", "pos").alias("top_evidence"),
    )
    w = Window.partitionBy("normalized_keyword", "source_platform").orderBy("bucket_start")
    delta = F.round(F.col("avg_trend_score") - F.coalesce(F.lag("avg_trend_score").over(w), F.lit(0.0)), digits)
    span = F.expr("interval 12 hours" if kind == "12h" else "interval 1 day")
    return buckets.withColumns({"delta": delta, "prev_bucket_start": F.lag("bucket_start").over(w)}).select(
        F.concat_ws("__", "normalized_keyword", "source_platform", F.lit(kind), F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ss")).alias("series_key"),
        "*",
        (F.col("bucket_start") + span).alias("bucket_end"),
        F.lit(kind).alias("bucket_type"),
        F.size("signal_ids").alias("signal_count"),
        F.when(F.col("delta") >= emerging, "emerging").when(F.col("delta") <= -emerging, "cooling").otherwise("stable").alias("status"),
    )


def rolling(df: DataFrame, key: str, day: str, value: str, days: int = 7) -> DataFrame:
    """D-05: per key and day, sum and count over the last ``days`` days that day included."""
    daily = df.groupBy(key, F.datediff(F.col(day), F.lit("1970-01-01")).alias("d")).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("d").rangeBetween(-(days - 1), 0)
    return daily.select(key, F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias("day"), F.sum("n").over(w).alias("n_rolling"), F.round(F.sum("s").over(w), 2).alias("sum_rolling"))


def insight(df: DataFrame, top: int = 100) -> DataFrame:
    """AGG-10: sentiment counts (all three present) and mean score of the best ``top`` rows, beside the count of all."""
    best = df.orderBy(F.desc("trend_score"), "id").limit(top)
    one = best.agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")], F.round(F.coalesce(F.avg("trend_score"), F.lit(0.0)), 2).alias("avg_score"))
    return one.crossJoin(df.agg(F.count("*").alias("total")))


def top_topics(df: DataFrame, top: int = 100, n: int = 10) -> DataFrame:
    """AGG-10, TOP-05: commonest topics of the best rows, ties by first appearance."""
    w = Window.orderBy(F.desc("trend_score"), "id")
    best = df.orderBy(F.desc("trend_score"), "id").limit(top).withColumn("rn", F.row_number().over(w))
    words = best.select("rn", F.posexplode(F.split("topics", ","))).select(F.struct("rn", "pos").alias("at"), F.trim("col").alias("topic")).where("topic <> ''")
    return words.groupBy("topic").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy(F.desc("n"), "at").limit(n).select("topic", "n")


def word_frequency(texts: DataFrame, column: str, stop: list[str] | None = None, n: int | None = 20, pattern: str = r"[\p{L}\p{N}_]+") -> DataFrame:
    """AGG-17, UX-08: words of two letters or more without stop words; the tokenizer is a pattern, to be replaced at will."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(f"({pattern})"))).alias("word")).where("length(word) > 1")
    words = words.where(~F.col("word").isin(stop)) if stop else words
    out = words.groupBy("word").agg(F.count("*").alias("n"))
    return out if n is None else out.orderBy(F.desc("n"), "word").limit(n)
