"""The registered queries of the trend-signal part and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsight.functions import scalars as S
from loomsight.operators import delivery, export, planner, retrieval, scheduling, signals, vendor
from loomsight.plans import further, more, streams  # noqa: F401  (they register their queries)
from loomsight.plans.adapters import NOW, SQL_CLEANED, cleaned, keywords, lines, read, sql_plan
from loomsight.sources import sinks
from loomsight.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}
TS = "yyyy-MM-dd HH:mm:ss"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _text(c: str):
    return F.date_format(c, TS).alias(c)


@query("""select l_orderkey, l_linenumber, least(floor(l_quantity + 0.5)::bigint + 2.0 * l_linenumber + 1.5 * floor(l_discount * 100 + 0.5)::bigint + 3.0 * floor(l_tax * 100 + 0.5)::bigint, 10000.0)::double as score from lineitem""")
def engagement_score(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda c: F.floor(c + 0.5).cast("string")
    score = S.engagement(whole(F.col("l_quantity")), F.col("l_linenumber"), whole(F.col("l_discount") * 100), whole(F.col("l_tax") * 100))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query(f"""with {SQL_CLEANED} select plat as platform, case when plat in ('xiaohongshu', 'weibo') then 'note' else 'video' end as source_type, count(*) as n from cleaned
where kw <> 'error' and (plat = 'weibo' or created_at >= timestamp '2024-01-10') group by 1, 2""")
def platform_raw_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaned(spark, sf).where("keyword <> 'error'")
    parts = {p: rows.where(F.col("source_platform") == p) for p in ("xhs", "dy", "bili", "wb", "ks")}
    out = signals.raw_scan(parts, since=F.lit("2024-01-10").cast("timestamp_ntz"))
    return out.groupBy(S.signal_platform(F.col("platform_code")).alias("platform"), "source_type").agg(F.count("*").alias("n"))


@query(f"""with {SQL_CLEANED} select id, kw as keyword, score from cleaned where kw = 'view' and plat = 'douyin' and score >= 10 order by score desc, id limit 20 offset 5""")
def cleaned_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    return signals.query_cleaned(cleaned(spark, sf), "view", "dy", None, 10, 20, 5).select("id", "keyword", F.col("trend_score").alias("score"))


def _keyword_dates(spark, sf):
    last = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_crawled_at"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("monthly", "annual", "special_topic", "cross_period", "other")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rank = F.when(F.col("c_acctbal") > 6000, "high").when(F.col("c_acctbal") > 2000, "medium").otherwise("low")
    base = read(spark, sf, "customer").withColumns({"signal_period_type": kind, "priority": rank, "suggested_platforms": F.col("c_mktsegment")})
    return base.join(last, "c_custkey", "left")


_KEYWORDS = """k as (select c_custkey, c_mktsegment, (['monthly','annual','special_topic','cross_period','other'])[(c_custkey % 5 + 1)::int] as kind, case when c_acctbal > 6000 then 0 when c_acctbal > 2000 then 1 else 2 end as prio, d.last
 from customer left join (select o_custkey, max(o_orderdate) as last from orders group by 1) d on o_custkey = c_custkey), n as (select max(o_orderdate) + interval 1 day as now from orders)"""


@query(f"""with {_KEYWORDS} select c_custkey, kind as signal_period_type, prio as priority_rank from k, n where c_mktsegment like '%U%' and (last is null
 or (kind = 'monthly' and last < now - interval 30 day) or (kind = 'annual' and last < now - interval 365 day) or (kind = 'special_topic' and last < now - interval 90 day) or (kind = 'cross_period' and last < now - interval 180 day))""")
def due_keywords(spark: SparkSession, sf: str) -> DataFrame:
    clock = read(spark, sf, "orders").agg((F.max("o_orderdate") + F.expr("interval 1 day")).alias("now"))
    rows = _keyword_dates(spark, sf).crossJoin(F.broadcast(clock))
    return scheduling.due_keywords(rows, F.col("now"), "U").select("c_custkey", "signal_period_type", scheduling.priority_rank(F.col("priority")).alias("priority_rank"))


@query(f"""with {SQL_CLEANED}, r as (select *, row_number() over (partition by kw, plat order by score desc, created_at desc, id desc) as rn from cleaned),
g as (select kw, plat, count(*) as n, max(score) as most, max(created_at) as seen, max(case when rn = 1 then id end) as id, max(case when rn = 1 then task end) as task, string_agg(case when rn <= 3 then 'note ' || kw || ' | ' || kw end, ' || ' order by rn) as ev,
 string_agg('CTD_' || id, ',' order by rn) as ids from r group by kw, plat),
s as (select *, round(least(100.0, (case when most > 100 then most / 4 else most end) + least(greatest(n - 1, 0), 5) * 5), 1) as sc from g)
select 'TS_' || strftime(seen, '%Y%m%d') || '_' || task || '_' || id as signal_id, 'KW_TASK_' || task as keyword_id, kw as normalized_keyword, plat as source_platform, left(ev, 800) as signal_evidence, sc as trend_score,
 case when n >= 3 and sc >= 70 then 'high' when n >= 2 and sc >= 45 then 'medium' when sc >= 65 then 'medium' else 'low' end as confidence, 'low' as risk_flag, strftime(seen, '%Y-%m-%d %H:%M:%S') as observed_at,
 strftime(seen + interval 7 day, '%Y-%m-%d %H:%M:%S') as fresh_until, n::int as support_count, md5(ids) as evidence_md5, 'about:source/' || plat || '/' || id as source_url,
 kw || ' 在 ' || plat || ' 聚合出 ' || n || ' 条相关信号，代表性主题为' || kw || '。' as signal_summary from s""")
def trend_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.trend_signals(cleaned(spark, sf))
    return out.select("signal_id", "keyword_id", "normalized_keyword", "source_platform", "signal_evidence", "trend_score", "confidence", "risk_flag", _text("observed_at"), _text("fresh_until"), "support_count", F.md5(F.array_join("evidence_ids", ",")).alias("evidence_md5"), "source_url", "signal_summary")


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def signal_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return signals.latest(read(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def _series(spark, sf, kind):
    rows = cleaned(spark, sf).select(F.concat(F.lit("S"), (F.col("id") % 500).cast("string")).alias("signal_id"), "crawl_task_id", "normalized_keyword", S.signal_platform(F.col("source_platform")).alias("source_platform"), "trend_score", F.col("created_at").alias("observed_at"), F.concat(F.lit("E"), F.col("id").cast("string")).alias("signal_evidence"), F.col("id").alias("pos"))
    out = signals.series(rows, kind, digits=6)
    return out.select("series_key", "normalized_keyword", "source_platform", _text("bucket_start"), _text("bucket_end"), "signal_count", F.array_join("signal_ids", ",").alias("signal_ids"), F.size("task_ids").alias("n_tasks"), "avg_trend_score", "delta", "status", _text("prev_bucket_start"), "top_evidence")


def _series_sql(kind):
    start = "date_trunc('day', created_at)" + (" + case when hour(created_at) >= 12 then interval 12 hour else interval 0 hour end" if kind == "12h" else "")
    f = "'%Y-%m-%d %H:%M:%S'"
    return f"""with {SQL_CLEANED}, b as (select kw, plat, {start} as st, count(distinct 'S' || id % 500)::int as c, string_agg(distinct 'S' || id % 500, ',' order by 'S' || id % 500) as sids, count(distinct task)::int as t, round(avg(score), 6) as a, 'E' || min(id) as e from cleaned group by 1, 2, 3),
 w as (select *, round(a - coalesce(lag(a) over (partition by kw, plat order by st), 0), 6) as d, lag(st) over (partition by kw, plat order by st) as p from b)
 select kw || '__' || plat || '__{kind}__' || strftime(st, '%Y-%m-%dT%H:%M:%S') as series_key, kw as normalized_keyword, plat as source_platform, strftime(st, {f}) as bucket_start, strftime(st + interval {"12 hour" if kind == "12h" else "1 day"}, {f}) as bucket_end, c as signal_count, sids as signal_ids, t as n_tasks, a as avg_trend_score, d as delta,
 case when d >= 10 then 'emerging' when d <= -10 then 'cooling' else 'stable' end as status, strftime(p, {f}) as prev_bucket_start, e as top_evidence from w"""


@query(_series_sql("1d"))
def series_1d(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf, "1d")


@query(_series_sql("12h"))
def series_12h(spark: SparkSession, sf: str) -> DataFrame:
    return _series(spark, sf, "12h")


def _insight(spark, sf):
    return read(spark, sf, "documents").selectExpr("doc_id as id", "n_chars * 1.0D as trend_score", "element_at(array('positive','negative','neutral'), cast(doc_id % 3 as int) + 1) as sentiment", "concat(lang, ', ', source, ',') as topics")


@query("""with b as (select * from documents order by n_chars desc, doc_id limit 100) select count(*) filter (where doc_id % 3 = 0) as positive, count(*) filter (where doc_id % 3 = 1) as negative, count(*) filter (where doc_id % 3 = 2) as neutral, round(avg(n_chars), 2) as avg_score, (select count(*) from documents) as total from b""")
def insight_summary(spark: SparkSession, sf: str) -> DataFrame:
    return signals.insight(_insight(spark, sf))


@query("""with b as (select *, row_number() over (order by n_chars desc, doc_id) as rn from documents qualify rn <= 100), t as (select lang as topic, rn, 0 as p from b union all select source, rn, 1 from b)
select topic, count(*) as n from t group by topic order by n desc, min(rn * 2 + p) limit 10""")
def insight_topics(spark: SparkSession, sf: str) -> DataFrame:
    return signals.top_topics(_insight(spark, sf))


@query(f"""with {sql_plan()} select keyword_id, platform, code as platform_code, pos::int as pos, query as expanded_query, type as expansion_type, based_on, goal_name as crawl_goal, risk_flag = 'high' or confidence <> 'high' as review_needed, keyword_id || '__' || platform || '__' || query as dedup_key from planned""")
def keyword_plan(spark: SparkSession, sf: str) -> DataFrame:
    return planner.plan(keywords(spark, sf)).select("keyword_id", "platform", "platform_code", "pos", "expanded_query", "expansion_type", "based_on", "crawl_goal", "review_needed", "dedup_key")


@query(f"""with {sql_plan()}, f as (select *, row_number() over (partition by keyword_id order by platform_pos, pos) as o, row_number() over (partition by keyword_id, lower(query) order by platform_pos, pos) as u from planned)
select keyword_id, string_agg(query, '|' order by o) filter (where u = 1) as merged_keywords, string_agg(query, ',' order by o) filter (where o <= lim) as keywords_for_crawler from f group by keyword_id""")
def plan_totals(spark: SparkSession, sf: str) -> DataFrame:
    return planner.plan_totals(planner.plan(keywords(spark, sf)))


@query(f"""with {sql_plan()}, t as (select *, case when goal_name = 'risk_monitoring' or priority = 'high' then 'watchlist-hot' when priority = 'low' then 'discovery' else 'watchlist-normal' end as tier from planned)
select norm || '__' || platform || '__' || lower(trim(query)) as query_unit_key, keyword_id, platform, expanded_query_ as expanded_query, 'manual' as source_type, 'approved' as status, tier as watchlist_tier, case tier when 'watchlist-hot' then 14 when 'watchlist-normal' then 30 else 60 end as ttl_days,
 case when code = 'xhs' then case tier when 'watchlist-hot' then 1440 when 'watchlist-normal' then 2880 else 10080 end else case tier when 'watchlist-hot' then 720 when 'watchlist-normal' then 1440 else 4320 end end as revisit_minutes,
 case when code = 'xhs' then 4320 else case tier when 'discovery' then 720 else 1440 end end as cooldown_minutes from (select *, query as expanded_query_ from t)""")
def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    return planner.registry_rows(planner.plan(keywords(spark, sf))).select("query_unit_key", "keyword_id", "platform", "expanded_query", "source_type", "status", "watchlist_tier", "ttl_days", "revisit_minutes", "cooldown_minutes")


@query("""with k as (select p_partkey as keyword_id, trim(p_name) as w, p_brand as v, case p_partkey % 3 when 0 then 'taobao' when 2 then 'industry_news' end as source, (['trend_discovery','market_validation','risk_monitoring'])[(p_size % 3 + 1)::int] as g from part where p_partkey % 3 <> 1)
select keyword_id, source, w || case when lower(v) = lower(w) then '' else '|' || v end || '|' || w || ' ' || case source || '/' || g when 'taobao/trend_discovery' then '精华' when 'taobao/market_validation' then '产品' when 'taobao/risk_monitoring' then '护肤品' when 'industry_news/trend_discovery' then '行业趋势' when 'industry_news/market_validation' then '市场洞察' else '法规' end as queries from k""")
def reference_packages(spark: SparkSession, sf: str) -> DataFrame:
    return planner.reference_packages(keywords(spark, sf))


@query("""select keyword_id, source_split from (select p_partkey as keyword_id, case p_partkey % 3 when 0 then 'xiaohongshu,douyin/taobao/' when 1 then 'bilibili,xiaohongshu//unknown' else 'douyin/industry_news/' end as source_split from part)""")
def platform_scopes(spark: SparkSession, sf: str) -> DataFrame:
    names = ("crawl_targets", "reference_sources", "unsupported_sources")
    return planner.scopes(keywords(spark, sf)).select("keyword_id", F.concat_ws("/", *[F.array_join(n, ",") for n in names]).alias("source_split"))


def _states(spark, sf):
    return read(spark, sf, "orders").selectExpr("o_orderkey as query_state_id", "o_custkey as keyword_id", "o_orderpriority as platform_code", "o_orderdate as next_due_at", "o_orderstatus <> 'P' as is_active")


@query("""select query_state_id, keyword_id, platform_code, rn::int as rn from (select o_orderkey as query_state_id, o_custkey as keyword_id, o_orderpriority as platform_code, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as rn from orders where o_orderstatus <> 'P' and o_orderdate <= timestamp '1998-01-01') where rn <= 3""")
def due_topn_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return scheduling.due_units(_states(spark, sf), F.lit("1998-01-01").cast("timestamp_ntz"), 3).select("query_state_id", "keyword_id", "platform_code", "rn")


@query(f"""with {sql_plan()}, reg as (select distinct norm || '__' || platform || '__' || lower(trim(query)) as k, query, type from planned where keyword_id % 4 <> 0),
due as (select norm || '__' || platform || '__' || lower(trim(query)) as k, keyword_id, pos from planned where pos = 0)
select due.keyword_id, k as query_unit_key, query as expanded_query, type as expansion_type from due join reg using (k)""")
def schedule_candidates(spark: SparkSession, sf: str) -> DataFrame:
    planned = planner.plan(keywords(spark, sf)).withColumn("query_unit_key", S.unit_key(F.col("normalized_keyword"), F.col("platform"), F.col("expanded_query")))
    registry = planner.registry_rows(planned.drop("query_unit_key")).where("keyword_id % 4 <> 0").select("query_unit_key", "expanded_query", "expansion_type", "status", "review_status").distinct()
    due = planned.where("pos = 0").select("query_unit_key", "keyword_id")
    own = planned.where("keyword_id % 2 = 0").select("query_unit_key", "expanded_query", "expansion_type").distinct()
    return scheduling.schedule_candidates(due, registry, own).select("keyword_id", "query_unit_key", "expanded_query", "expansion_type")


def _tasks(spark, sf):
    return read(spark, sf, "orders").selectExpr("o_orderkey as task_id", "o_custkey as keyword_id", "concat(o_custkey, '-', o_orderpriority) as dedup_key", "case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'pending' end as status", "o_orderdate as created_at", "cast(null as timestamp_ntz) as completed_at", "cast(null as timestamp_ntz) as updated_at", "o_orderpriority as error_message")


@query("""with n as (select max(o_orderdate) + interval 1 day as now from orders), c as (select distinct o_custkey as keyword_id, o_custkey || '-' || o_orderpriority as dedup_key from orders),
h as (select distinct o_custkey as keyword_id, o_custkey || '-' || o_orderpriority as dedup_key from orders, n where o_orderstatus = 'P' or (o_orderstatus = 'F' and o_orderdate >= now - interval 168 hour) or (o_orderstatus = 'O' and o_orderdate >= now - interval 24 hour))
select c.* from c anti join h using (keyword_id, dedup_key)""")
def recent_duplicate_anti(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _tasks(spark, sf)
    clock = tasks.agg((F.max("created_at") + F.expr("interval 1 day")).alias("now"))
    return scheduling.recent_duplicates(tasks.select("keyword_id", "dedup_key").distinct(), tasks.crossJoin(F.broadcast(clock)), F.col("now"))[0]


@query("select c_custkey as o_custkey from customer where c_custkey not in (select o_custkey from orders)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return scheduling.missing(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), read(spark, sf, "orders"), "o_custkey")


def _halves(spark, sf):
    e = read(spark, sf, "events").selectExpr("user_id", "event_type", "value", "event_id as add_ts", "event_id as mtime")
    one = lambda d: signals.latest(d.withColumn("k", F.concat_ws("-", "user_id", "event_type")).withColumn("t", F.lit(None).cast("timestamp_ntz")), "k", "t", "add_ts").drop("t")
    return one(e.where("add_ts % 3 <> 0")), one(e.where("add_ts % 3 = 0"))


_HALVES = """e as (select user_id || '-' || event_type as k, user_id, event_type, value, event_id from events),
o as (select k, max(event_id) as id, max_by(value, event_id) as v from e where event_id % 3 <> 0 group by k), n as (select k, max(event_id) as id, max_by(value, event_id) as v from e where event_id % 3 = 0 group by k)"""


@query(f"with {_HALVES} select coalesce(o.k, n.k) as k, coalesce(n.v, o.v) as value, coalesce(o.id, n.id) as add_ts, coalesce(n.id, o.id) as mtime from o full join n on o.k = n.k")
def upsert_full(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return scheduling.upsert(old, new, ["k"], keep=["add_ts"]).select("k", "value", "add_ts", "mtime")


@query(f"with {_HALVES} select coalesce(o.k, n.k) as k, coalesce(o.v, n.v) as value, coalesce(o.id, n.id) as add_ts, coalesce(n.id, o.id) as mtime from o full join n on o.k = n.k")
def upsert_partial(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return scheduling.upsert(old, new, ["k"], only=["mtime"]).select("k", "value", "add_ts", "mtime")


@query("""with e as (select o_custkey as k, o_orderdate as tm, o_orderkey as pos, case o_orderstatus when 'F' then 'success' when 'O' then 'failure' else 'schedule' end as ev, epoch_us(o_orderdate)::hugeint * 1000000000 + o_orderkey as o from orders),
ok as (select k, max(o) filter (where ev = 'success') as last_ok, count(*) as n, max_by(ev, o) as last_event, max_by(case when ev = 'success' then tm + interval 720 minute else tm + interval 1440 minute end, o) filter (where ev <> 'schedule') as due from e group by k)
select ok.k::varchar as query_unit_key, n as n_events, last_event, count(e.k) as failure_count, strftime(due, '%Y-%m-%d %H:%M:%S') as next_due_at from ok left join e on e.k = ok.k and e.ev = 'failure' and (last_ok is null or e.o > last_ok) group by all""")
def query_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "orders").selectExpr("cast(o_custkey as string) as query_unit_key", "case o_orderstatus when 'F' then 'success' when 'O' then 'failure' else 'schedule' end as event", "o_orderdate as at", "720 as revisit_minutes", "1440 as cooldown_minutes", "o_orderkey as pos")
    return scheduling.fold_state(e).select("query_unit_key", "n_events", "last_event", "failure_count", _text("next_due_at"))


def _items(spark, sf):
    items = read(spark, sf, "lineitem").selectExpr("l_suppkey % 50 as run_id", "l_orderkey as task_id", "l_linenumber as n", "l_shipdate as last_heartbeat_at", "case when l_returnflag = 'R' then 'running' when l_returnflag = 'A' then 'planned' else 'succeeded' end as item_status")
    return items, _tasks(spark, sf).select("task_id", "status", "error_message")


_ACTION = """i as (select l_suppkey % 50 as run_id, l_orderkey, l_linenumber, case l_returnflag when 'R' then 'running' when 'A' then 'planned' else 'succeeded' end as st, l_shipdate as hb from lineitem),
a as (select i.*, case when st = 'succeeded' or hb > timestamp '1997-06-01' - interval 45 minute then null when o_orderstatus = 'F' then 'close_as_succeeded' when o_orderstatus = 'O' then case when lower(o_orderpriority) like '%rate%' or lower(o_orderpriority) like '%network%' or lower(o_orderpriority) like '%timeout%' or lower(o_orderpriority) like '%connection%' or lower(o_orderpriority) like '%temporary%' or lower(o_orderpriority) like '%retry%' then 'mark_failed_retryable' else 'mark_failed_terminal' end else 'requeue_planned' end as action from i left join orders on o_orderkey = l_orderkey),
b as (select *, coalesce(case action when 'close_as_succeeded' then 'succeeded' when 'mark_failed_retryable' then 'failed_retryable' when 'mark_failed_terminal' then 'failed_terminal' when 'requeue_planned' then 'planned' end, st) as item_status from a)"""


@query(f"with {_ACTION} select action, item_status, count(*) as n from b group by 1, 2")
def stale_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    items, tasks = _items(spark, sf)
    return scheduling.reconcile(items, tasks, F.lit("1997-06-01").cast("timestamp_ntz")).groupBy("action", "item_status").agg(F.count("*").alias("n"))


@query(f"""with {_ACTION}, c as (select run_id, count(*) as total, count(*) filter (where item_status = 'succeeded') as succeeded, count(*) filter (where item_status = 'failed_retryable') as retryable, count(*) filter (where item_status = 'failed_terminal') as terminal, count(*) filter (where item_status in ('planned', 'dispatched', 'running')) as running from b group by 1)
select *, case when succeeded = total then 'completed_full' when succeeded > 0 and terminal > 0 and retryable = 0 and running = 0 then 'completed_partial' else 'failed' end as classification from c""")
def batch_audit(spark: SparkSession, sf: str) -> DataFrame:
    items, tasks = _items(spark, sf)
    return scheduling.audit(scheduling.reconcile(items, tasks, F.lit("1997-06-01").cast("timestamp_ntz")))


def _retrieval(spark, sf):
    asked = read(spark, sf, "conversations").where("role = 'user'").selectExpr("concat(conv_id, '-', turn) as query_id", "text as query").dropDuplicates(["query_id"])
    store = read(spark, sf, "benchmark").selectExpr("concat('B', item_id) as signal_id", "lower(split(text, ' ')[0]) as normalized_keyword", "'c' as topic_cluster", "'t' as trend_type", "text as signal_summary", "'' as signal_evidence", "'xiaohongshu' as source_platform", "item_id * 7 % 100 * 1.0D as trend_score", "element_at(array('low','medium','high'), cast(item_id % 3 as int) + 1) as confidence", "element_at(array('low','medium','high','low'), cast(item_id % 4 as int) + 1) as risk_flag", "timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(cast(item_id % 5 as int)) as fresh_until", "item_id as pos")
    return asked, store


_RETRIEVAL = """q as (select distinct on (conv_id, turn) conv_id || '-' || turn as query_id, text as query, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as low from conversations where role = 'user'),
s as (select 'B' || item_id as signal_id, lower(split_part(text, ' ', 1)) as k, lower(lower(split_part(text, ' ', 1)) || ' c t ' || text || ' ') as txt, item_id * 7 % 100 * 1.0 as sc, (['low','medium','high'])[(item_id % 3 + 1)::int] as conf, (['low','medium','high','low'])[(item_id % 4 + 1)::int] as risk, timestamp '2024-02-01' - (item_id % 5) * interval 1 day as fresh, item_id as pos from benchmark),
p as (select q.query_id, q.query, s.*, len(list_filter(list_filter(regexp_split_to_array(low, '\\s+'), lambda t: t <> ''), lambda t: contains(txt, t))) + case when contains(low, k) then 2 when low <> '' and contains(k, low) then 1 else 0 end as ov from q, s),
r as (select *, ov * 100.0 + sc as match_score, row_number() over (partition by query_id order by ov * 100.0 + sc desc, pos) as rank from p where ov > 0),
e as (select *, fresh < timestamp '2024-01-31' as stale, conf = 'low' as weak, sc < 30 as lo, risk = 'high' as high from r where rank <= 5),
v as (select *, not (stale or weak or lo or high) as usable, nullif(concat_ws(',', case when stale then 'stale' end, case when weak then 'low_confidence' end, case when lo then 'low_trend_score' end, case when high then 'high_risk_blocked' end), '') as reason from e)"""


@query(f"with {_RETRIEVAL} select query_id, signal_id, rank::int as rank, match_score::double as match_score, usable, reason as rejection_reason from v")
def retrieval_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked, store = _retrieval(spark, sf)
    return retrieval.retrieve(asked, store, _now()).select("query_id", "signal_id", "rank", "match_score", "usable", "rejection_reason")


@query(f"""with {_RETRIEVAL}, g as (select query_id, min(rank) filter (where usable) as u, bool_or(high) as h, count(*) as n, max(case when rank = 1 then reason end) as tr from v group by 1)
select q.query_id, case when u is not null then 'trend_supported' when coalesce(h, false) then 'trend_filtered_for_safety' else 'trend_weak_or_missing' end as behavior_flag, coalesce(n, 0) as n_evidence, tr as top_rejection_reason,
 case when u is not null then 'Selected ' || (select k from v where v.query_id = q.query_id and rank = u) || ' trend evidence from xiaohongshu.' when coalesce(h, false) then 'Trend evidence was retrieved but filtered from the strong-evidence path.' else 'No strong trend evidence was selected; downstream QA should degrade gracefully.' end as summary from q left join g using (query_id)""")
def context_behavior(spark: SparkSession, sf: str) -> DataFrame:
    asked, store = _retrieval(spark, sf)
    return retrieval.answer(asked, retrieval.retrieve(asked, store, _now())).select("query_id", "behavior_flag", "n_evidence", "top_rejection_reason", "summary")


@query("""select sum(n)::bigint as row_count, sum(n - 1)::bigint as duplicate_keys, sum(b1)::bigint as blank_source, sum(b2)::bigint as blank_lang, sum(n)::bigint as blank_missing from (select n_chars, count(*) as n, count(*) filter (where coalesce(trim(source), '') = '') as b1, count(*) filter (where coalesce(trim(lang), '') = '') as b2 from documents group by 1)""")
def quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.quality_profile(read(spark, sf, "documents"), "n_chars", ["source", "lang", "missing"])


@query("""with t as (select count(*) as n, count(distinct user_id) as u, count(ts) as v, max(ts) as m, count(*) filter (where trim(event_type) = '') as b from events)
select 'unique' as gate, round(1 - (n - u) / n, 6) as value, (n - u) = 0 as passed from t union all select 'complete', round(1 - b / n, 6), 1 - b / n >= 0.95 from t union all select 'duplicates', round(1 - (n - u) / n, 6), 1 - (n - u) / n >= 0.98 from t
union all select 'timestamps', round(v / n, 6), v / n >= 0.98 from t union all select 'fresh', case when m >= timestamp '2024-01-24' then 1.0 else 0.0 end, m >= timestamp '2024-01-24' from t""")
def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.quality_gates(read(spark, sf, "events"), "user_id", ["event_type"], "ts", _now())


@query("""with f as (select l_suppkey, v, c, min(p) as p from (select l_suppkey, l_returnflag as v, 'a' as c, l_orderkey * 10 + l_linenumber as p from lineitem union all select l_suppkey, l_linestatus, 'b', l_orderkey * 10 + l_linenumber from lineitem) group by 1, 2, 3),
r as (select l_suppkey, string_agg(v, '|' order by p, v) filter (where c = 'a') as flags, string_agg(v, '|' order by p, v) filter (where c = 'b') as statuses from f group by 1) select s_suppkey, s_name, flags as l_returnflag, statuses as l_linestatus from supplier left join r on s_suppkey = l_suppkey""")
def collapse_left_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").selectExpr("l_suppkey", "l_orderkey * 10 + l_linenumber as p", "l_returnflag", "l_linestatus")
    flat = delivery.collapse(rows, "l_suppkey", "p", ["l_returnflag", "l_linestatus"])
    s = read(spark, sf, "supplier")
    return s.join(flat, s.s_suppkey.eqNullSafe(flat.l_suppkey), "left").select("s_suppkey", "s_name", "l_returnflag", "l_linestatus")


@query("""with e as (select event_id, 'trend_' || left(sha1(event_type || '|' || strftime(ts, '%Y-%m-%d')), 12) as b from events) select event_id, case when n > 0 then b || '_' || n else b end as row_id from (select *, row_number() over (partition by b order by event_id) - 1 as n from e)""")
def trend_id_suffix(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return delivery.suffixed_ids(rows, ["event_type", "day"], "event_id").select("event_id", "row_id")


@query("""with l as (select p_partkey, unnest(regexp_split_to_array(p_type || '、' || p_brand || ' / ' || p_name || ';' || p_type, '[，,、/|；;]')) as t, generate_subscripts(regexp_split_to_array(p_type || '、' || p_brand || ' / ' || p_name || ';' || p_type, '[，,、/|；;]'), 1) as i from part),
f as (select p_partkey, trim(t) as t, min(i) as i from l where trim(t) <> '' group by 1, 2) select p_partkey, string_agg(t, '|' order by i) as tags from f group by 1""")
def tags_normalize(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.concat("p_type", F.lit("、"), "p_brand", F.lit(" / "), "p_name", F.lit(";"), "p_type")
    return read(spark, sf, "part").select("p_partkey", S.normalize_tags(tags).alias("tags"))


@query("""select p_partkey, p_size::double as low, case when p_partkey % 2 = 0 then p_retailprice else p_size::double end as high from part""")
def price_band(spark: SparkSession, sf: str) -> DataFrame:
    band = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("￥"), F.col("p_size").cast("string"), F.lit("-"), F.col("p_retailprice").cast("string"), F.lit("元"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("元起")))
    low, high = S.price_band(band)
    return read(spark, sf, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query(r"""select p_partkey, case when regexp_matches(p_name, '^\s*[+-]?\d+\s*$') then p_name::bigint else 0 end as from_name, p_size::bigint as from_size, coalesce(try_cast(regexp_extract(p_brand, '(\d+)', 1) as bigint), 0) as first_digits from part""")
def safe_int(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", S.safe_int(F.col("p_name")).alias("from_name"), S.safe_int(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).alias("from_size"), S.first_int(F.col("p_brand")).alias("first_digits"))


@query(r"""select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g')) as text_md5 from pages""")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(S.html_text(F.col("html"))).alias("text_md5"))


@query(r"""select page_id, regexp_extract(url, '^\w+://([^/]+)', 1) as host, (page_id % 7)::varchar as a, case when page_id % 3 = 0 then null else 'x y' end as b, regexp_extract(url, '([^/]*)$', 1) as last_segment from pages""")
def url_params(spark: SparkSession, sf: str) -> DataFrame:
    full = F.concat("url", F.lit("?a=0&b="), F.when(F.col("page_id") % 3 == 0, "").otherwise("x+y"), F.lit("&a="), (F.col("page_id") % 7).cast("string"), F.lit("&c#f"))
    p = S.url_params(full)
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^\w+://([^/]+)", 1).alias("host"), F.element_at(p, F.lit("a")).alias("a"), F.element_at(p, F.lit("b")).alias("b"), S.trace_id(F.col("url")).alias("last_segment"))


@query("""select event_id, (props->>'$.k')::bigint as k, 'about:source/' || event_type || '/' || event_id as url from events""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return read(spark, sf, "events").select("event_id", S.json_object(fenced, "k bigint")["k"].alias("k"), S.source_url(F.col("props"), F.col("event_id"), F.col("event_type")).alias("url"))


@query(r"""select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from documents) where length(word) > 1 and word not in ('the', 'und') group by word order by n desc, word limit 20""")
def word_freq(spark: SparkSession, sf: str) -> DataFrame:
    return signals.word_frequency(read(spark, sf, "documents"), "text", ["the", "und"])


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
h as (select doc_id, pos, trim(regexp_replace(regexp_replace(case when pos % 11 = 5 then '第三章 ' || t when pos % 4 = 1 then '第二条 ' || t when pos % 7 = 3 then '2024年1月2日' else t end, '[\s\x{a0}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g')) as line from l),
f as (select * from h where line not in ('', '附件', '附件1', '附件2') and not regexp_matches(line, '^20\d{2}年\d{1,2}月\d{1,2}日$')),
m as (select *, regexp_matches(line, '^第[一二三四五六七八九十百零]+章') as ch, nullif(regexp_extract(line, '^(第[一二三四五六七八九十百零]+条|[一二三四五六七八九十]+、|\d+\.)', 1), '') as ar from f),
s as (select *, sum(case when ch or ar is not null then 1 else 0 end) over w as seg, last_value(case when ch then line end ignore nulls) over w as chapter from m window w as (partition by doc_id order by pos rows unbounded preceding)),
g as (select doc_id, seg, coalesce(chapter, '') as chapter, coalesce(max(ar), 'preamble') as article_no, min(pos) as first_pos, string_agg(line, ' ' order by pos) as txt from s where not ch group by doc_id, seg, chapter)
select doc_id, first_pos::int as first_pos, chapter, article_no, md5(txt) as text_md5, 'rule_' || left(sha1(doc_id || '|' || chapter || '|' || article_no || '|' || txt), 16) as rule_id from g""")
def clause_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = delivery.clauses(lines(spark, sf), "doc_id", "pos", "line")
    return out.select("doc_id", "first_pos", "chapter", "article_no", F.md5("requirement_text").alias("text_md5"), "rule_id")


@query("""select conv_id, string_agg(id, ',' order by turn, k) as ids from (select conv_id, turn, 0 as k, 't' || turn as id from conversations where role = 'user' union all select conv_id, turn, 1, 'g' || turn from conversations where turn % 2 = 0) group by conv_id""")
def nested_card_flatten(spark: SparkSession, sf: str) -> DataFrame:
    card = F.struct("turn", F.when(F.col("role") == "user", 9).otherwise(11).alias("card_type"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.array(F.struct(F.when(F.col("turn") % 2 == 0, 9).otherwise(4).alias("card_type"), F.concat(F.lit("g"), F.col("turn").cast("string")).alias("id"))).alias("card_group"))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(card)).alias("cards"))
    out = vendor.cards(rows, "cards").where(F.size("cards") > 0)
    return out.select("conv_id", F.array_join(F.transform("cards", lambda c: c["id"]), ",").alias("ids"))


@query("""with d as (select *, ts::date as day, row_number() over (partition by event_type, ts::date order by ts, event_id) as dr from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-21' qualify dr <= 5) select event_type, event_id, dr::int as day_rank, tr::int as total_rank from (select *, row_number() over (partition by event_type order by day, dr) as tr from d) where tr <= 60""")
def day_range_capped(spark: SparkSession, sf: str) -> DataFrame:
    days = vendor.day_range("2024-01-05", "2024-01-20", spark)
    rows = read(spark, sf, "events").withColumn("day", F.to_date("ts")).join(F.broadcast(days.select("day")), "day")
    return vendor.capped_by_day(rows, "event_type", "day", ["ts", "event_id"], 5, 60).select("event_type", "event_id", "day_rank", "total_rank")


def _files(spark, sf):
    return read(spark, sf, "documents").selectExpr("concat('data/', element_at(array('xhs','dy_bili','KS','other'), cast(doc_id % 4 as int) + 1), '/', source, '/', doc_id, element_at(array('.json','.csv','.txt'), cast(doc_id % 3 as int) + 1)) as path", "n_chars as length", "doc_id as modified")


@query("""select case doc_id % 4 when 0 then 'xhs' when 1 then 'dy' when 2 then 'ks' else 'other' end as platform, case doc_id % 3 when 0 then 'json' when 1 then 'csv' else 'txt' end as file_type, count(*) as files, sum(n_chars)::bigint as bytes from documents group by 1, 2""")
def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vendor.catalog_stats(_files(spark, sf))


@query("""select 'data/KS/' || source || '/' || doc_id || '.csv' as path from documents where doc_id % 4 = 2 and doc_id % 3 = 1""")
def catalog_list(spark: SparkSession, sf: str) -> DataFrame:
    return vendor.catalog(_files(spark, sf), "ks", "CSV").select("path")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in _TABLES))
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    whole = sinks.manifest({t: read(spark, sf, t) for t in _TABLES})
    return delivery.replace_rows(whole, sinks.manifest({"events": read(spark, sf, "events")}), "table_name")


@query("""select c_mktsegment as platform, o_orderpriority as keyword, count(*) as n_rows, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as last_created, count(*) filter (where o_orderstatus = 'F') as completed from orders left join customer on c_custkey = o_custkey group by 1, 2""")
def task_rollup(spark: SparkSession, sf: str) -> DataFrame:
    tasks = read(spark, sf, "orders").join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    rows = tasks.select(F.col("c_mktsegment").alias("platform"), F.col("o_orderpriority").alias("keyword"), "o_orderdate", "o_orderstatus")
    return export.task_rollup(rows, ["platform", "keyword"], "o_orderdate", F.col("o_orderstatus") == "F").withColumn("last_created", F.date_format("last_created", TS))


def _scores(spark, sf):
    lab, docs = read(spark, sf, "labels"), read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return lab.join(docs, "doc_id").selectExpr("source as question_type", "quality * 2 as correctness", "quality * 2 as completeness", "(1 - toxic) * 2 as safety", "toxic as violation", "n_chars / 1000.0D as latency")


_SCORES = "s as (select source, quality * 2 as c, (1 - toxic) * 2 as f, toxic as v, n_chars / 1000.0 as l from labels join documents using (doc_id))"


@query(f"with {_SCORES} select source as question_type, count(*) as n, round(avg(c), 4) as correctness, round(avg(f), 4) as safety, sum(v)::bigint as violations, round(quantile_cont(l::double, 0.95), 6) as p95_latency from s group by 1")
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.eval_rollup(_scores(spark, sf), "question_type").withColumn("p95_latency", F.round("p95_latency", 6))


@query(f"""with {_SCORES}, t as (select avg(c) as c, avg(f) as f, sum(v)::double as v, quantile_cont(l::double, 0.95) as p from s) select 'correctness' as gate, round(c, 4) as value, c >= 1.4 as passed from t union all select 'completeness', round(c, 4), c >= 1.2 from t union all select 'safety', round(f, 4), f >= 1.8 from t union all select 'violations', v, v = 0 from t union all select 'latency_p95', round(p, 4), p <= 5 from t""")
def release_gate(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.release_gates(_scores(spark, sf))


@query("""select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) as rn from documents) where rn <= 25""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.stratified(read(spark, sf, "documents"), "lang", "doc_id", 25).select("lang", "doc_id")


@query("""select doc_id, case when ('0x' || left(md5(doc_id::varchar), 6))::int % 100 < 25 then 'holdout' else 'dev' end as split from documents""")
def dev_split(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.split(read(spark, sf, "documents"), "doc_id").select("doc_id", "split")


@query("""with d as (select event_type, ts::date as day, count(*) as n, sum(value) as s from events group by 1, 2) select event_type, day, sum(n) over w::bigint as n_rolling, round(sum(s) over w, 2) as sum_rolling from d window w as (partition by event_type order by day range between interval 6 day preceding and current row)""".replace("sum(n) over w::bigint", "(sum(n) over w)::bigint"))
def rolling_7d(spark: SparkSession, sf: str) -> DataFrame:
    return signals.rolling(read(spark, sf, "events"), "event_type", "ts", "value")


@query("""with w as (select event_type, time_bucket(interval 12 hour, ts) as st, count(*) as n, round(avg(value), 8) as a from events group by 1, 2) select event_type, strftime(st, '%Y-%m-%d %H:%M:%S') as bucket_start, n, a as avg_value from w where st + interval 12 hour <= (select max(ts) - interval 1 day from events)""")
def stream_series_12h(spark: SparkSession, sf: str) -> DataFrame:
    at, rows = more.scratch(spark), jobs.read(spark, sf, "events.parquet", "ts")
    out = jobs.run_once(jobs.bucket_series(rows, "ts", ["event_type"], "value"), f"{at}/out", f"{at}/state")
    return out.select("event_type", _text("bucket_start"), "n", "avg_value")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    at, rows = more.scratch(spark), jobs.read(spark, sf, "events.parquet", "ts")
    return jobs.run_once(jobs.deduplicated(rows, "ts", ["user_id", "event_type"], "1000 hours").select("user_id", "event_type"), f"{at}/out", f"{at}/state")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The best trend signals."""
    return trend_signals(spark, sf).orderBy(F.desc("trend_score"), "signal_id").limit(20)


def queries() -> dict:
    return {**QUERIES, **more.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **more.SQL}
