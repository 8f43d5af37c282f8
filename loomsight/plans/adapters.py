"""Domain relations over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of the registered queries.
NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr(
        "event_id as id", "event_type as keyword", "event_type as normalized_keyword", "event_type as topic_cluster", "'category' as trend_type",
        "element_at(array('xhs','dy','bili','wb','ks'), cast(user_id % 5 as int) + 1) as source_platform", "user_id as crawl_task_id", "value as trend_score",
        "ts as created_at", "props as raw_data", "concat('note ', event_type) as title", "'' as summary", "event_type as topics",
    )


SQL_CLEANED = """cleaned as (select event_id as id, event_type as kw, case user_id % 5 when 0 then 'xiaohongshu' when 1 then 'douyin' when 2 then 'bilibili' when 3 then 'weibo' else 'kuaishou' end as plat,
  user_id as task, coalesce(value, 0) as score, ts as created_at from events)"""


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").selectExpr(
        "p_partkey as keyword_id", "p_name as keyword", "lower(p_name) as normalized_keyword", "concat(p_brand, '|', p_type, '|', lower(p_brand)) as query_variants",
        "element_at(array('xhs|douyin|taobao', 'bilibili|XHS|unknown', 'douyin|industry_news|dy'), cast(p_partkey % 3 as int) + 1) as suggested_platforms",
        "element_at(array('trend_discovery','market_validation','risk_monitoring'), p_size % 3 + 1) as crawl_goal",
        "element_at(array('ingredient','claim','category','scenario','risk_compliance'), p_size % 5 + 1) as trend_type",
        "element_at(array('low','high'), p_size % 2 + 1) as risk_flag",
        "element_at(array('high','medium','low'), cast(p_partkey % 3 as int) + 1) as priority", "element_at(array('high','medium','high'), p_size % 3 + 1) as confidence",
    )


def _values(table: dict) -> str:
    return ", ".join(f"('{a}', '{b}', {k}, '{t}', '{s}')" for (a, b), pairs in table.items() for k, (t, s) in enumerate(pairs))


def sql_plan() -> str:
    """The plan as CTEs up to ``planned``."""
    from loomsight.functions import fixed

    return f"""
goal(k, platform, pos, type, suffix) as (values {_values(fixed.GOAL_SUFFIXES)}),
kind(k, platform, pos, type, suffix) as (values {_values(fixed.TYPE_SUFFIXES)}),
kw as (select p_partkey as keyword_id, trim(p_name) as word, lower(trim(p_name)) as norm, p_brand as v1, p_type as v2, lower(p_brand) as v3, p_partkey % 3 as pl,
  (['trend_discovery','market_validation','risk_monitoring'])[(p_size % 3 + 1)::int] as goal_name, (['ingredient','claim','category','scenario','risk_compliance'])[(p_size % 5 + 1)::int] as type_name,
  (['low','high'])[(p_size % 2 + 1)::int] as risk_flag, (['high','medium','low'])[(p_partkey % 3 + 1)::int] as priority, (['high','medium','high'])[(p_size % 3 + 1)::int] as confidence from part),
targets(pl, platform_pos, platform, code) as (values (0, 0, 'xiaohongshu', 'xhs'), (0, 1, 'douyin', 'dy'), (1, 0, 'bilibili', 'bili'), (1, 1, 'xiaohongshu', 'xhs'), (2, 0, 'douyin', 'dy')),
base as (select kw.*, platform_pos, platform, code, case when priority = 'low' or confidence = 'low' then 1 when priority = 'medium' or confidence = 'medium' then 2 else 3 end as lim from kw join targets using (pl)),
cand as (
  select *, 0 as stage, 0 as p, 'seed' as type, word as query, word as based_on from base
  union all select *, 0, 1, 'seed_variant', norm, norm from base
  union all select base.*, 1, g.pos, g.type, word || ' ' || g.suffix, word from base join goal g on g.k = goal_name and g.platform = base.platform
  union all select base.*, 2, t.pos, t.type, word || ' ' || t.suffix, word from base join kind t on t.k = type_name and t.platform = base.platform
  union all select *, 3, 0, '{fixed.EXTRA_RISK[0]}', word || ' {fixed.EXTRA_RISK[1]}', word from base where risk_flag = 'high' and goal_name <> 'risk_monitoring'
  union all select *, 4, 0, 'seed_variant', v1, v1 from base union all select *, 4, 1, 'seed_variant', v2, v2 from base union all select *, 4, 2, 'seed_variant', v3, v3 from base),
once as (select *, row_number() over (partition by keyword_id, platform, lower(query) order by stage, p) as dup from cand where query <> ''),
planned as (select *, row_number() over (partition by keyword_id, platform order by stage, p) - 1 as pos from once where dup = 1 qualify pos < lim)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents, some made into chapter and article heads."""
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.when(F.col("pos") % 11 == 5, F.concat(F.lit("第三章 "), "line")).when(F.col("pos") % 4 == 1, F.concat(F.lit("第二条 "), "line")).when(F.col("pos") % 7 == 3, F.lit("2024年1月2日"))
    return rows.select("doc_id", "pos", F.coalesce(head, F.col("line")).alias("line"))
