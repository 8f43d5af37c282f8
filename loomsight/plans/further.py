"""Registered queries of sources and stores of their own kind, samples by quota, the scheduling run, pages, people, checklists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsight.functions import scalars as S
from loomsight.functions import segment
from loomsight.operators import agents, delivery, flow, sampling, scheduling, signals, vendor
from loomsight.plans import streams
from loomsight.plans.adapters import SQL_CLEANED, cleaned, read
from loomsight.plans.more import QUERIES, TS, query, scratch
from loomsight.sources import forum, paged, readers, sinks
from loomsight.streaming import logs
from loomsight.streaming.store import Change, Store


def _folder(spark: SparkSession) -> str:
    return scratch(spark)


# --- paged sources and stores

_PART = "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"


def _pages(spark: SparkSession, sf: str, size: int = 100):
    paged.register(spark)
    at = _folder(spark)
    paged.write_pages(read(spark, sf, "part").selectExpr(*[c.split()[0] for c in _PART.split(", ")]), at, "p_partkey", size)
    return spark.read.format("pages").schema(_PART).option("span", 4), at


@query("select p_partkey, p_name, round(p_retailprice, 2) as price from part where p_brand = 'Brand#12' and p_size > 10")
def paged_scan(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-19: pages in parallel, the equality asked of the source, the rest filtered here."""
    reader, at = _pages(spark, sf)
    return reader.load(at).where("p_brand = 'Brand#12' and p_size > 10").select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("price"))


@query("select p_partkey, p_name from part order by p_partkey limit 150")
def paged_limit(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-19: the scan ends with the page that completes ``limit``."""
    reader, at = _pages(spark, sf, 40)
    return reader.option("limit", 150).option("page_size", 40).load(at).select("p_partkey", "p_name")


@query("select p_brand, count(*) as n, sum(p_size)::bigint as total from part group by 1")
def paged_stream(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-19, ST-01: pages as a stream whose offset is the cursor."""
    _, at = _pages(spark, sf)
    rows, out = spark.readStream.format("pages").schema(_PART).option("span", 4).load(at), _folder(spark)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(_PART).parquet(f"{out}/rows").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("select c_custkey, c_name, c_nationkey, round(c_acctbal, 2) as balance from customer where c_mktsegment = 'BUILDING'")
def sqlite_store(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-08, SNK-15, SRC-15: two appends by tasks, read back a file a task, the equality within sqlite."""
    paged.register(spark)
    at, rows = _folder(spark), read(spark, sf, "customer")
    for k in (0, 1):
        rows.where(F.col("c_custkey") % 2 == k).write.format("sqlite").mode("append").save(at)
    return spark.read.format("sqlite").load(at).where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("balance"))


@query("select s_suppkey, s_name from supplier where s_nationkey = 7 order by s_suppkey desc limit 5")
def json_store_find(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-09, SRC-16: JSON arrays by tasks; find many with order and limit."""
    paged.register(spark)
    at = _folder(spark)
    read(spark, sf, "supplier").write.format("json_array").mode("append").save(at)
    return paged.mongo_find(spark, at, 5, "-s_suppkey", s_nationkey=7).select("s_suppkey", "s_name")


# --- samples


@query(
    """
with strata as (
  select a.t, b.z, a.w * b.w as w
  from (values ('A', 0.5), ('B', 0.3), ('C', 0.2)) a(t, w), (values ('small', 0.6), ('large', 0.4)) b(z, w)),
ideal as (select t, z, round(200 * w / sum(w) over (), 9) as x from strata),
quota as (
  select t, z, (floor(x) + case when row_number() over (order by x - floor(x) desc, t, z) <= 200 - sum(floor(x)) over () then 1 else 0 end)::int as q
  from ideal),
rows_ as (
  select p_partkey, q, md5(p_partkey::varchar) as h, p_retailprice > 1500 as trend,
    (['A', 'B', 'C'])[(p_partkey % 3 + 1)::int] as t, case when p_size <= 25 then 'small' else 'large' end as z
  from part join quota on t = (['A', 'B', 'C'])[(p_partkey % 3 + 1)::int] and z = case when p_size <= 25 then 'small' else 'large' end),
own as (select *, row_number() over (partition by t, z, trend order by h, p_partkey) as r from rows_),
last as (select *, row_number() over (partition by t, z order by not (trend and r <= ceil(q * 20 / 100)), h, p_partkey) as k from own)
select p_partkey, t as grade, z as size_class, trend from last where k <= q"""
)
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """D-02: two dimensions by largest remainder, a fifth of each quota from the trend as far as it goes."""
    rows = read(spark, sf, "part").selectExpr("p_partkey", "element_at(array('A', 'B', 'C'), cast(p_partkey % 3 as int) + 1) as grade", "case when p_size <= 25 then 'small' else 'large' end as size_class", "p_retailprice > 1500 as trend")
    quota = sampling.quotas(spark, {"grade": {"A": 0.5, "B": 0.3, "C": 0.2}, "size_class": {"small": 0.6, "large": 0.4}}, 200)
    return sampling.by_quota(rows, quota, ["grade", "size_class"], "p_partkey", F.col("trend"))


@query(
    """
with d as (
  select doc_id, lang, source, row_number() over (partition by lang, source order by md5(doc_id::varchar), doc_id) as r, count(*) over (partition by lang, source) as n
  from documents)
select doc_id, lang, source, case when r <= case when n < 2 then 0 else greatest(1, round(n * 25 / 100.0)) end then 'holdout' else 'dev' end as split
from d"""
)
def stratum_split(spark: SparkSession, sf: str) -> DataFrame:
    """D-07: both sides cover every stratum."""
    return sampling.stratified_split(read(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


# --- the scheduling run

NOW_RUN = "2024-02-01 00:00:00"


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").selectExpr("p_partkey as keyword_id", "lower(p_name) as word", "explode(array(' a', ' b', ' c', ' d')) as suffix", "p_size")
    rows = rows.withColumns({"platform": F.lit("xiaohongshu"), "platform_code": F.lit("xhs"), "expanded_query": F.concat("word", "suffix")})
    # parts of one name share their units: the first has them
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("expanded_query").orderBy("keyword_id"))).where("first = 1")
    return rows.select(
        "keyword_id", S.unit_key(F.col("word"), F.col("platform"), F.col("expanded_query")).alias("query_unit_key"), "platform", "platform_code", "expanded_query", F.lit("seed").alias("expansion_type"), F.col("word").alias("based_on"),
        F.lit("manual").alias("source_type"), F.lit("approved").alias("review_status"), F.lit("approved").alias("status"), F.lit("").alias("notes"), F.lit(30).alias("ttl_days"), F.lit("hot").alias("tier"), F.lit("low").alias("risk_level"), F.lit(720).alias("revisit_minutes"), F.lit(1440).alias("cooldown_minutes"),
    )


def _scheduled(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, _folder(spark), 8)
    flow.create(store)
    planned, now = _planned(spark, sf), F.lit(NOW_RUN).cast("timestamp_ntz")
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    of = F.substring("expanded_query", -1, 1)
    locked = planned.where((F.col("keyword_id") % 7 == 0) & (of == "a")).select(F.col("keyword_id").alias("keyword_db_id"), "platform", "expanded_query", "source_type", F.lit("rejected").alias("review_status"), F.lit("deprecated").alias("status"), F.lit(False).alias("is_active"), "expansion_type", "based_on", "notes", "ttl_days", now.alias("expires_at"), now.alias("last_seen_at"))
    later = planned.where((F.col("keyword_id") % 3 == 0) & (of == "b")).select("query_unit_key", "keyword_id", "platform_code", "tier", "risk_level", "revisit_minutes", "cooldown_minutes", F.lit(True).alias("is_active"), (now + F.expr("interval 1 day")).alias("next_due_at"), F.lit(None).cast("string").alias("last_task_id"), F.lit(None).cast("timestamp_ntz").alias("last_scheduled_at"))
    key = flow.dedup_key(F.col("keyword_id"), F.col("platform_code"), F.col("expanded_query"))
    status = F.when(F.col("keyword_id") % 5 == 0, "pending").when(F.col("keyword_id") % 5 == 1, "completed").when(F.col("keyword_id") % 5 == 2, "failed")
    hours = F.when(F.col("keyword_id") % 2 == 0, 20).otherwise(100)
    old = planned.where((of == "c") & status.isNotNull()).select(F.concat(F.lit("old_"), F.col("keyword_id").cast("string")).alias("task_id"), "keyword_id", F.col("platform_code").alias("platform"), F.col("expanded_query").alias("task_keyword"), key.alias("dedup_key"), status.alias("status"), F.col("expansion_type").alias("query_origin"), (now - F.make_dt_interval(hours=hours)).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    store.commit("seed", 0, {"registry": Change(locked.select(*names(flow.REGISTRY)), flow.REGISTRY_KEY), "states": Change(later.select(*names(flow.STATES)), ["query_unit_key"]), "tasks": Change(old.select(*names(flow.TASKS)), ["task_id"])})
    flow.schedule(store, planned, now, "run", 0)
    flow.schedule(store, planned, now, "run", 0)  # repeated after its commit: nothing more
    return store


_SCHEDULED = """
u as (
  select p_partkey as k, lower(p_name) || ' ' || s as q, s, lower(p_name) || '__xiaohongshu__' || lower(p_name) || ' ' || s as unit
  from part, (values ('a'), ('b'), ('c'), ('d')) x(s)
  qualify row_number() over (partition by unit order by p_partkey) = 1),
due as (
  select *, row_number() over (partition by k order by unit) as r
  from u
  where not (k % 7 = 0 and s = 'a') and not (k % 3 = 0 and s = 'b')),
candidate as (
  select *, s = 'c' and (k % 5 = 0 or k % 5 = 1 or (k % 5 = 2 and k % 2 = 0)) as dup
  from due where r <= 3)"""


@query(f"with {_SCHEDULED} select k as keyword_id, q as task_keyword, 'pending' as status, 'xhs|' || q as key_tail from candidate where not dup")
def scheduled_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """KX-10: the tasks of one run."""
    tasks = _scheduled(spark, sf).table("tasks").where("task_id like 'task_%'")
    return tasks.select("keyword_id", "task_keyword", "status", F.regexp_replace("dedup_key", r"^\d+\|", "").alias("key_tail"))


@query(f"with {_SCHEDULED} select case when dup then 'skipped_duplicate' else 'scheduled' end as event_type, k as keyword_id, count(*) as n from candidate group by all")
def scheduled_events(spark: SparkSession, sf: str) -> DataFrame:
    """KX-10: the events of the same run."""
    return _scheduled(spark, sf).table("events").groupBy("event_type", "keyword_id").agg(F.count("*").alias("n"))


# --- pages, people, words


@query(
    r"""
with l as (
  select page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="[^"]*">[^<]*</a></li>')) as a,
    generate_subscripts(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li><a href="[^"]*">[^<]*</a></li>'), 1) - 1 as pos
  from pages)
select page_id, pos, trim(regexp_extract(a, 'href="([^"]*)"', 1)) as href, trim(regexp_extract(a, '>([^<]+)</a>', 1)) as text
from l"""
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """S-32: the links of every page's navigation, by steps down its tree."""
    link = forum.step("a")
    return forum.elements(read(spark, sf, "pages"), (forum.step("nav"), forum.step("li")), {"href": forum.one(link, take="href"), "text": forum.one(link)})


@query(
    """
with c as (select *, case c_custkey % 6 when 0 then 'ks' when 1 then 'xhs' when 2 then 'bili' when 3 then 'dy' when 4 then 'wb' else 'zhihu' end as p from customer)
select p as platform, c_custkey::varchar as comment_id, c_name as content, c_nationkey::varchar as user_id, c_mktsegment as nickname,
  case when c_custkey % 4 = 0 then '0' else (c_custkey % 4)::varchar end as sub_comment_count
from c"""
)
def comment_tables(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-03: comments of six platforms, each in its own shape."""
    c = read(spark, sf, "customer")
    key, text, user, name, count = F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 4)
    n = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in x.items()]))
    s = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    raw = {
        "ks": n(commentId=key, content=text, authorId=user, authorName=name, subCommentCount=count),
        "xhs": n(id=key, content=text, user_info=s(user_id=user, nickname=name), sub_comment_count=count, pictures=F.array(s(url_default=F.lit("a")), s(url_default=F.lit("b")))),
        "bili": n(rpid=key, content=s(message=text), member=s(mid=user, uname=name), rcount=count),
        "dy": n(cid=key, aweme_id=key, text=text, user=s(uid=user, nickname=name), reply_comment_total=count),
        "wb": n(id=key, text=F.concat(F.lit("<a href='x'>"), text, F.lit("</a>")), user=s(id=user, screen_name=name), total_number=count, created_at=F.lit("Mon Jan 01 10:00:00 +0800 2024"), source=F.lit("来自广东")),
        "zhihu": n(id=key, content=text, author=s(id=user, name=name), child_comment_count=count),
    }
    out = None
    for k, p in enumerate(raw):
        one = vendor.comment_rows(c.where(key % 6 == k).select(key.alias("asked"), raw[p].alias("raw")), p, asked="asked")
        one = one.withColumnRenamed("user_nickname", "nickname") if p == "zhihu" else one
        one = one.select(F.lit(p).alias("platform"), "comment_id", "content", "user_id", "nickname", "sub_comment_count")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """
select 'xhs' as platform, s_name as nickname, case s_suppkey % 3 when 0 then 'Male' when 1 then 'Female' end as gender, s_nationkey::varchar as fans, '7' as follows from supplier
union all
select 'dy', s_name, case s_suppkey % 3 when 1 then 'Male' when 2 then 'Female' else 'Unknown' end, s_nationkey::varchar, '0' from supplier
union all
select 'wb', s_name, case when s_suppkey % 2 = 0 then 'Female' else 'Male' end, s_nationkey::varchar, '0' from supplier
union all
select 'ks', s_name, case when s_suppkey % 2 = 0 then 'Female' else 'Male' end, s_nationkey::varchar, '3' from supplier"""
)
def creator_tables(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-03, S-36, S-37: people of four platforms; a repeated count's last entry holds."""
    d = read(spark, sf, "supplier")
    name, k, fans = F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    n = lambda **x: F.to_json(F.struct(*[v.alias(c) for c, v in x.items()]))
    s = lambda **x: F.struct(*[v.alias(c) for c, v in x.items()])
    count = lambda t, v: s(type=F.lit(t), count=v)
    raw = {
        "xhs": n(basicInfo=s(nickname=name, gender=k % 3), interactions=F.array(count("follows", F.lit("1")), count("fans", fans), count("follows", F.lit("7")))),
        "dy": n(user=s(nickname=name, gender=k % 3, max_follower_count=fans)),
        "wb": n(screen_name=name, gender=F.when(k % 2 == 0, "f").otherwise("m"), followers_count=fans, source=F.lit("来自上海")),
        "ks": n(profile=s(user_name=name, gender=F.when(k % 2 == 0, "F").otherwise("M")), ownerCount=s(follow=F.lit(3), fan=fans)),
    }
    out = None
    for p, r in raw.items():
        one = vendor.creator_rows(d.select(k.alias("id"), r.alias("raw")), p)
        one = one.select(F.lit(p).alias("platform"), "nickname", "gender", "fans", "follows")
        out = one if out is None else out.unionByName(one)
    return out


def segmented_names(spark: SparkSession, sf: str) -> DataFrame:
    """UX-08, AGG-17: titles of Chinese words without blanks, made from the table's rows, cut by a dictionary of the same words."""
    stems = ["外泌体", "胶原蛋白", "胶原", "蛋白", "眼膜", "冰晶", "精华", "抗老", "修护", "面霜", "成分", "敏感肌"]
    pick = lambda c: F.element_at(F.array(*[F.lit(x) for x in stems]), (c % len(stems) + 1).cast("int"))
    rows = read(spark, sf, "part").select("p_partkey", F.concat(pick(F.col("p_partkey")), pick(F.col("p_size")), F.lit("的"), pick(F.col("p_partkey") + F.col("p_size")), F.lit(" SPF50")).alias("title"))
    words = spark.createDataFrame([(w, 100 + 7 * k) for k, w in enumerate(stems)] + [("的", 5000)], "word string, n long")
    return segment.word_counts(rows, "title", segment.dictionary(words), ["的"])


# --- checklists and repeated names


@query(
    """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at, event_type as status, 'k-' || user_id as task_dedup_key, user_id % 7 = 0 as review_needed, user_id % 10 as per_page
from events
where event_type <> 'view'
order by ts desc, event_id desc
limit 20"""
)
def task_config_checklist(spark: SparkSession, sf: str) -> DataFrame:
    """D-09: the newest tasks with what their configuration says, read from a variant column."""
    config = F.parse_json(F.to_json(F.struct(F.concat(F.lit("k-"), F.col("user_id").cast("string")).alias("task_dedup_key"), F.struct((F.col("user_id") % 7 == 0).alias("review_needed"), (F.col("user_id") % 10).alias("per_page")).alias("options"))))
    tasks = read(spark, sf, "events").where("event_type <> 'view'").withColumn("config", config)
    newest = tasks.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    get = lambda path, kind: F.variant_get("config", f"$.{path}", kind)
    return newest.select("event_id", F.date_format("ts", TS).alias("created_at"), F.col("event_type").alias("status"), get("task_dedup_key", "string").alias("task_dedup_key"), get("options.review_needed", "boolean").alias("review_needed"), get("options.per_page", "bigint").alias("per_page"))


@query(
    """
select s_suppkey, s_name as user_name, s_nationkey::bigint as fans_count, null::varchar as missing, 'aB":c' as kept
from supplier"""
)
def page_state(spark: SparkSession, sf: str) -> DataFrame:
    """S-34: the state JSON of a page, names with underscores, ``undefined`` as null."""
    state = F.concat(F.lit('{"noteDetail":{"userName":"'), F.col("s_name"), F.lit('","fansCount":'), F.col("s_nationkey").cast("string"), F.lit(',"isMissing":undefined,"keptText":"aB\\":c"}}'))
    page = F.concat(F.lit("<html><script>window.__INITIAL_STATE__="), state, F.lit("</script></html>"))
    v = F.try_parse_json(S.decamelized(S.state_text(page, "__INITIAL_STATE__")))
    get = lambda path, kind="string": F.try_variant_get(v, f"$.note_detail.{path}", kind)
    return read(spark, sf, "supplier").select("s_suppkey", get("user_name").alias("user_name"), get("fans_count", "bigint").alias("fans_count"), get("is_missing").alias("missing"), get("kept_text").alias("kept"))


@query(
    """
select n_nationkey, n_name as cookie, 2 as n_cookies, n_nationkey::bigint as fans, 'zzzzzzzzzzzzz' as long_text, null::bigint as beyond, 170581728179578208255::hugeint::varchar as wide, n_name as cell
from nation"""
)
def repeated_entries(spark: SparkSession, sf: str) -> DataFrame:
    """S-31, S-36, S-39, SRC-11: repeated names end no query, the last one holds; long numbers are null or wide."""
    n = read(spark, sf, "nation")
    jar = S.cookies(F.concat(F.lit("a=1; b=2; a="), "n_name"))
    kind = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("long").alias("count"))
    counts = S.counts_by_type(F.array(kind("fans", F.lit(9)), kind("fans", F.col("n_nationkey"))))
    text = F.lit("zzzzzzzzzzzzz")
    sheet = n.select("n_nationkey", F.posexplode(F.array(F.array(F.lit("h"), F.lit("h"), F.lit("k")), F.array(F.lit("first"), F.col("n_name"), F.lit("x")))).alias("row", "values"))
    cells = delivery.header_rows(sheet, 3, ["n_nationkey"]).select("n_nationkey", F.col("cells")["h"].alias("cell"))
    return n.join(cells, "n_nationkey").select("n_nationkey", jar["a"].alias("cookie"), F.size(jar).alias("n_cookies"), counts["fans"].alias("fans"), text.alias("long_text"), S.from_base36(text).alias("beyond"), S.from_base36_wide(text).cast("string").alias("wide"), "cell")


@query(
    """
with a as (select case when c_custkey % 10 = 0 then null else c_custkey end as k, c_name as v, null::varchar as w from customer where c_custkey <= 20 and c_custkey % 20 <> 10),
b as (select case when c_custkey % 10 = 0 then null else c_custkey end as k, null::varchar as v, c_mktsegment as w from customer where c_custkey <= 20 and c_custkey % 20 <> 0)
select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v, coalesce(b.w, a.w) as w
from a full join b on a.k is not distinct from b.k"""
)
def null_key_merge(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-12: a null key is a key."""
    c = read(spark, sf, "customer").where("c_custkey <= 20")
    k = F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k")
    none = F.lit(None).cast("string")
    old = c.where("c_custkey % 20 <> 10").select(k, F.col("c_name").alias("v"), none.alias("w"))
    new = c.where("c_custkey % 20 <> 0").select(k, none.alias("v"), F.col("c_mktsegment").alias("w"))
    return sinks.field_merge(old, new, "k")


@query(
    """
select 't' || p_partkey as trend_id, p_name as keyword, p_type as topic_cluster, (p_size * 10)::bigint as heat_index, case when p_size % 2 = 0 then p_size / 2.0 end as growth_monthly,
  case when p_size % 3 = 0 then 'taobao' else 'xhs' end as platform, strftime(timestamp '2024-01-01' + to_days(p_size), '%Y-%m-%d %H:%M:%S') as captured_at
from part"""
)
def trend_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-01: the trend table from its raw headers."""
    p = read(spark, sf, "part")
    raw = p.selectExpr("concat('t', p_partkey) as a", "p_name as b", "p_type as c", "cast(p_size * 10 as string) as d", "case when p_size % 2 = 0 then cast(p_size / 2 as string) else 'n/a' end as e", "case when p_size % 3 = 0 then ' ' else 'xhs' end as f", "date_format(date_add(date'2024-01-01', p_size), 'yyyy/MM/dd') as g")
    out = delivery.trend_table(raw.toDF(*delivery.TREND))
    return out.withColumn("captured_at", F.date_format("captured_at", TS) if dict(out.dtypes)["captured_at"].startswith("timestamp") else F.col("captured_at"))


@query(
    """
with r as (select n_regionkey, n_nationkey, trim(n_name) as v, 'use ' || n_nationkey % 2 as u from nation),
f as (select n_regionkey, u, min(n_nationkey) as p from r group by all)
select r.n_regionkey::varchar as ingredient_id, string_agg(v, '|' order by n_nationkey) as name_cn, (select string_agg(u, '|' order by p) from f where f.n_regionkey = r.n_regionkey) as use_purpose_2023
from r group by r.n_regionkey"""
)
def ingredient_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-01, AGG-14: ingredients with uses joined in order of first appearance."""
    n = read(spark, sf, "nation").selectExpr("n_nationkey as pos", "cast(n_regionkey as string) as `成分编号`", "n_name as `成分名称`", "concat('use ', n_nationkey % 2) as `最新使用目的(2023)`")
    return delivery.ingredient_table(n, "pos").select("ingredient_id", "name_cn", "use_purpose_2023")


@query("select distinct n_regionkey::varchar as ingredient_id, 'effect ' || n_nationkey % 2 as efficacy_relation, 'm' as mechanism_legacy from nation where n_nationkey % 5 <> 0")
def relation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-01: ingredient and effect, rows without an effect go."""
    n = read(spark, sf, "nation").selectExpr("cast(n_regionkey as string) as `成分编号`", "case when n_nationkey % 5 = 0 then ' ' else concat(' effect ', n_nationkey % 2) end as `功效`", "'m' as `机理（旧）`")
    return delivery.relation_table(n)


# --- pages of rows, reports, checks, logs, steps with a model


@query(
    """
select p_partkey as id, case p_partkey % 4 when 0 then 'high' when 1 then 'low' when 2 then 'medium' else 'x' end as priority
from part
order by case p_partkey % 4 when 0 then 0 when 2 then 1 when 1 then 2 else 3 end, p_partkey
limit 40 offset 30"""
)
def priority_page(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-02: a page of keywords by priority."""
    rows = read(spark, sf, "part").selectExpr("p_partkey as id", "element_at(array('high', 'low', 'medium', 'x'), cast(p_partkey % 4 as int) + 1) as priority")
    return scheduling.by_priority(rows, 40, 30)


@query(
    """
with s as (
  select o_orderpriority as question_type, o_orderstatus as risk, case when o_orderkey % 13 = 0 then 9 else o_orderkey % 3 end as c, o_orderkey % 2 + 1 as f, o_orderkey % 11 = 0 as h, (o_orderkey % 97 = 0)::int as v, o_totalprice / 1000 as l
  from orders)
select question_type, risk, count(*) as n, round(avg(c) filter (where c between 0 and 2), 4) as correctness, round(avg(f), 4) as safety, round(avg(h::int), 4) as hallucination_rate,
  sum(v)::bigint as violations, round(quantile_cont(l, 0.95), 3) as p95_latency
from s group by rollup (question_type, risk)"""
)
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """D-03: by question type and risk, with the totals."""
    s = read(spark, sf, "orders").selectExpr("o_orderpriority as question_type", "o_orderstatus as risk", "case when o_orderkey % 13 = 0 then 9 else o_orderkey % 3 end as correctness", "o_orderkey % 2 + 1 as safety", "o_orderkey % 11 = 0 as hallucination", "cast(o_orderkey % 97 = 0 as int) as violation", "o_totalprice / 1000 as latency")
    return delivery.eval_report(s, ["question_type", "risk"]).withColumn("p95_latency", F.round("p95_latency", 3))


@query(
    """
select p_partkey,
  concat_ws(',', case when p_brand not in ('Brand#11', 'Brand#12', 'Brand#13') then 'p_brand' end, case when p_size < 5 or p_size > 40 then 'p_size' end, case when length(p_name) > 20 then 'p_name' end) as faults
from part"""
)
def validated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-16: members, ranges and lengths."""
    rows = delivery.validated(read(spark, sf, "part"), {"p_brand": ["Brand#11", "Brand#12", "Brand#13"]}, {"p_size": (5, 40)}, {"p_name": (1, 20)})
    return rows.select("p_partkey", F.array_join("faults", ",").alias("faults"))


@query(
    """
with l as (
  select event_type as stream, event_id as pos, case when event_id % 5 = 0 then 'Task failed: ' || event_id else 'started ' || event_id end as line, case when event_id % 5 = 0 then 'error' else 'info' end as level
  from events)
select 'errors' as reader, stream, pos, line, level from l where level = 'error'
union all
select 'last', stream, pos, line, level from l qualify row_number() over (partition by stream order by pos desc) <= 30"""
)
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """ST-15, TOP-10: a reader of errors, and the last lines of each stream."""
    lines = read(spark, sf, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("pos"), F.concat(F.when(F.col("event_id") % 5 == 0, "Task failed: ").otherwise("started "), F.col("event_id").cast("string")).alias("line"), "ts")
    at = _folder(spark)
    store = Store(spark, f"{at}/store", 8)
    each = logs.fan_out(store, {"errors": lambda df: df.where("level = 'error'")}, 30)
    streams._replayed(spark, streams._parts(lines, "ts", "pos", 5), "ts", lambda s: s.drop("ts"), each, at)
    one = lambda name, table: store.table(table).select(F.lit(name).alias("reader"), "stream", "pos", "line", "level")
    return one("errors", "errors_lines").unionByName(one("last", "last_lines"))


@query("select n_nationkey, case when n_nationkey % 3 = 0 then n_name else upper(n_name) || '!' end as summary, case when n_nationkey % 3 = 0 then n_name else 'model' end as topic, case when n_nationkey % 3 = 1 then 'positive' else 'neutral' end as sentiment, n_nationkey % 3 = 2 as noise from nation")
def model_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """UX-03, UX-04: a step with a model whose answers are partly no JSON, or name a mood that there is not."""

    def model(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            title, kind, _ = p.split("\n")
            good = {"summary": title.upper() + "!", "topics": ["model"], "sentiment": "positive" if kind == "1" else "great", "noise": kind == "2"}
            out.append("no answer" if kind == "0" else "Here: " + json.dumps(good))
        return out

    rows = read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("title"), (F.col("n_nationkey") % 3).cast("string").alias("desc"), F.col("n_name").alias("keyword"))
    done = agents.execute([agents.Step("cleaning", lambda df: agents.cleaning(df, model), ("title", "desc", "keyword"))], rows).rows
    summary = F.when(F.col("n_nationkey") % 3 == 0, F.element_at(F.split("summary", " 0$"), 1)).otherwise(F.col("summary"))
    return done.select("n_nationkey", summary.alias("summary"), F.col("topics")[0].alias("topic"), "sentiment", "noise")


@query("select n_nationkey, case n_nationkey % 3 when 0 then 'You are ' || n_name when 1 then 'plain ' || n_name else 'fallback' end as prompt from nation")
def prompt_sections(spark: SparkSession, sf: str) -> DataFrame:
    """UX-06: the prompt of a Markdown file: a block, a paragraph, or none."""
    name = F.col("n_name")
    block = F.concat(F.lit("# Skill\n\n### System Prompt\n\n```text\nYou are "), name, F.lit("\n```\n## Next\n```\nno\n```"))
    plain = F.concat(F.lit("### System Prompt\nplain "), name, F.lit("\n\n## Next\nmore"))
    text = F.when(F.col("n_nationkey") % 3 == 0, block).when(F.col("n_nationkey") % 3 == 1, plain).otherwise(F.concat(F.lit("# Other\n"), name))
    return read(spark, sf, "nation").select("n_nationkey", agents.section(text, fallback="fallback").alias("prompt"))


@query("select c_mktsegment as segment, c_custkey::varchar as custkey, c_name as name from customer")
def workbook_files(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-13, SRC-09, SRC-11: a workbook for every segment and 100 rows, written by tasks; read back by the header of each."""
    at = _folder(spark)
    rows = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), "c_acctbal")
    sinks.workbooks(rows, at, ["segment"], "custkey", 100).count()
    cells = readers.workbooks(spark, f"{at}/*/*.xlsx")
    by = delivery.header_rows(cells, 3, ["path", "sheet"])
    segment = F.regexp_extract("path", "segment=([^/]*)/", 1)
    return by.select(segment.alias("segment"), F.col("cells")["custkey"].alias("custkey"), F.col("cells")["name"].alias("name"))


# --- texts, urls, schedules, context


@query(
    r"""
select s_suppkey, left(repeat(s_name || ' ', 80), 500) as title, 'spectrum/' || s_suppkey as trace,
  'https://sns-img-bd.xhscdn.com/spectrum/' || s_suppkey || '?imageView2/format/png' as third_url,
  case when s_suppkey % 2 = 0 then 'b' || s_suppkey else 'c' end as video, s_name || ',x' as images, case when s_suppkey % 3 = 0 then s_name else '' end as topics,
  s_nationkey::varchar as token, case when s_nationkey % 2 = 0 then 'name:' || s_name || '; ' else '' end || 'nation:' || s_nationkey as remark
from supplier"""
)
def text_picks(spark: SparkSession, sf: str) -> DataFrame:
    """S-10, S-30, S-35, S-38, S-42."""
    k, name, nation = F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string")
    trace = S.trace_id(F.concat(F.lit("https://x.y/spectrum/"), k))
    first = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("a"), F.concat(F.lit("b"), k))).otherwise(F.array(F.lit(" ")))
    tag = lambda kind, n: F.struct(F.lit(kind).alias("type"), n.alias("name"))
    tags = F.when(F.col("s_suppkey") % 3 == 0, F.array(tag("topic", name), tag("place", F.lit("z")))).otherwise(F.array(tag("place", name)))
    return read(spark, sf, "supplier").select(
        "s_suppkey", S.kept_letters(F.repeat(F.concat(name, F.lit(" ")), 80), "title").alias("title"), trace.alias("trace"), S.image_urls(trace)[2].alias("third_url"), S.first_filled(first, F.array(F.lit("c"))).alias("video"),
        S.joined(F.array(name, F.lit(""), F.lit("x"))).alias("images"), S.topics(tags).alias("topics"), S.last_token(F.concat(F.lit("a_b_"), nation)).alias("token"), S.remarks({"name": F.when(F.col("s_nationkey") % 2 == 0, name), "nation": nation}).alias("remark"),
    )


@query("select event_type, event_id, user_id from (select *, row_number() over (partition by event_type order by event_id) as r from events) where r <= 7")
def head_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-11: the first rows of each group in input order."""
    return scheduling.head(read(spark, sf, "events").select("event_type", "event_id", "user_id"), "event_id", 7, ["event_type"])


@query(
    """
with b as (select min(ts) as lo, max(ts) as hi from events),
d as (select unnest(generate_series(lo::date - interval 1 day, hi::date + interval 1 day, interval 1 day)) as day, lo, hi from b),
r as (select p as platform, day + t::interval - interval 8 hour as run_at, lo, hi from d, (values ('xhs', '08:00:00'), ('dy', '08:30:00'), ('bili', '09:00:00'), ('wb', '09:30:00')) x(p, t))
select platform, strftime(run_at, '%Y-%m-%d %H:%M:%S') as run_at from r where run_at > lo and run_at <= hi"""
)
def schedule_runs(spark: SparkSession, sf: str) -> DataFrame:
    """ST-01: the daily runs between the first and the last event."""
    low, high = read(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    runs = scheduling.due_runs(spark, F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))
    return runs.select("platform", F.date_format("run_at", TS).alias("run_at"))


@query(
    f"""
with {SQL_CLEANED}
select kw as normalized_keyword, plat as source_platform, id, row_number() over (partition by kw, plat order by score desc, created_at desc, id desc)::int as rank
from cleaned"""
)
def trend_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-07: the evidence of every signal as a table."""
    return signals.trend_evidence(cleaned(spark, sf)).select("normalized_keyword", "source_platform", "id", "rank")


@query(
    f"""
with {SQL_CLEANED},
b as (select kw, plat, date_trunc('day', created_at) as st, 'S' || id % 500 as s, task from cleaned)
select distinct kw as normalized_keyword, plat as source_platform, strftime(st, '%Y-%m-%d %H:%M:%S') as bucket_start, s as member, 'signal' as kind from b
union all
select distinct kw, plat, strftime(st, '%Y-%m-%d %H:%M:%S'), task::varchar, 'task' from b"""
)
def series_members(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-09: who is in a bucket, as a table."""
    rows = cleaned(spark, sf).select("normalized_keyword", S.signal_platform(F.col("source_platform")).alias("source_platform"), F.concat(F.lit("S"), (F.col("id") % 500).cast("string")).alias("signal_id"), "crawl_task_id", F.col("created_at").alias("observed_at"))
    return signals.series_members(rows).withColumn("bucket_start", F.date_format("bucket_start", TS))


#: No SQL: the best path through a lattice is tested against all paths.
QUERIES["segmented_names"] = segmented_names
