"""Keyword rows to capped, deduplicated query plans per platform, and the registry rows they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsight.functions import fixed
from loomsight.functions import scalars as S

_ITEM = "array<struct<type:string,query:string,based_on:string>>"


def _tokens(c: Column) -> Column:
    return S.unique(F.transform(S.unique_ignoring_case(F.split(F.coalesce(c, F.lit("")), r"\|")), lambda x: S.let(F.lower(x), lambda low: F.coalesce(S.lookup(fixed.PLATFORM_LABELS, low), low))))


def scopes(df: DataFrame, override: list[str] | None = None) -> DataFrame:
    """KX-01, SET-07, SET-08: platform tokens dealt into crawl targets, reference sources and unsupported ones."""
    tokens = _tokens(F.col("suggested_platforms"))
    is_ref = lambda x: x.isin(*fixed.REFERENCE_SOURCES)
    known = lambda x: x.isin(*fixed.PLATFORM_CODES)
    crawl = F.filter(tokens, lambda x: known(x) & ~is_ref(x))
    if override:
        crawl = F.filter(_tokens(F.lit("|".join(override))), lambda x: known(x) & ~is_ref(x))
    return df.withColumns({"crawl_targets": crawl, "reference_sources": F.filter(tokens, is_ref), "unsupported_sources": F.filter(tokens, lambda x: ~known(x) & ~is_ref(x))})


def _dimension(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit("/".join(k)), F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("suffix")) for t, s in v]))])
    return F.coalesce(F.element_at(pairs, key), F.array().cast("array<struct<type:string,suffix:string>>"))


def plan(keywords: DataFrame, override: list[str] | None = None, supplements: str | None = None) -> DataFrame:
    """KX-02..06, KX-08: a row per planned query, in order of platform and fill.

    ``keywords``: keyword_id, keyword, normalized_keyword, query_variants, suggested_platforms, crawl_goal, trend_type,
    risk_flag, priority, confidence. ``supplements`` names an array column of further queries, used last.
    """
    meta = scopes(keywords, override)
    word, norm = S.strip(F.coalesce("keyword", F.lit(""))), S.strip(F.coalesce("normalized_keyword", F.lit("")))
    limit = F.when((F.col("priority") == "low") | (F.col("confidence") == "low"), 1).when((F.col("priority") == "medium") | (F.col("confidence") == "medium"), 2).otherwise(3)
    meta = meta.withColumns({"word": word, "norm": norm, "limit": limit, "review_needed": (F.col("risk_flag") == "high") | (F.col("confidence") != "high")})
    rows = meta.select("*", F.posexplode("crawl_targets").alias("platform_pos", "platform"))
    item = lambda kind, q, base: F.struct(kind.cast("string").alias("type"), q.alias("query"), base.alias("based_on"))
    seeds = F.array(item(F.lit("seed"), F.col("word"), F.col("word")), item(F.lit("seed_variant"), F.col("norm"), F.col("norm")))
    goal = _dimension(fixed.GOAL_SUFFIXES, F.concat_ws("/", "crawl_goal", "platform"))
    kind = _dimension(fixed.TYPE_SUFFIXES, F.concat_ws("/", "trend_type", "platform"))
    extra = F.when((F.col("risk_flag") == "high") & (F.col("crawl_goal") != "risk_monitoring"), F.array(F.struct(F.lit(fixed.EXTRA_RISK[0]).alias("type"), F.lit(fixed.EXTRA_RISK[1]).alias("suffix")))).otherwise(F.array().cast("array<struct<type:string,suffix:string>>"))
    rules = F.transform(F.array_distinct(F.concat(goal, kind, extra)), lambda s: item(s["type"], F.when(F.col("word") != "", F.concat_ws(" ", F.col("word"), s["suffix"])).otherwise(""), F.col("word")))
    variants = F.transform(S.unique_ignoring_case(F.split(F.coalesce("query_variants", F.lit("")), r"\|")), lambda v: item(F.lit("seed_variant"), v, v))
    parts = [seeds.cast(_ITEM), rules.cast(_ITEM), variants.cast(_ITEM)]
    if supplements:
        parts.append(F.transform(F.coalesce(supplements, F.array().cast("array<string>")), lambda v: item(F.lit("llm_supplement"), S.strip(v), F.col("word"))).cast(_ITEM))
    # every stage stops at the cap and skips spellings already taken, so the first of each spelling, capped, is the same
    every = F.filter(F.concat(*parts), lambda x: x["query"] != "")
    firsts = lambda e, low: F.filter(e, lambda x, i: F.array_position(low, F.lower(x["query"])) == i + 1)
    taken = F.slice(S.let(every, lambda e: S.let(F.transform(e, lambda x: F.lower(x["query"])), lambda low: firsts(e, low))), 1, F.col("limit"))
    out = rows.withColumn("items", taken).select("*", F.posexplode("items").alias("pos", "item"))
    return out.select(
        "keyword_id", "platform_pos", "pos", "platform", S.platform_code(F.col("platform")).alias("platform_code"), F.col("item.query").alias("expanded_query"), F.col("item.type").alias("expansion_type"),
        F.col("item.based_on").alias("based_on"), "crawl_goal", "priority", "confidence", "review_needed", "limit", F.col("norm").alias("normalized_keyword"), F.concat_ws("__", "keyword_id", "platform", "item.query").alias("dedup_key"),
    )


def plan_totals(planned: DataFrame) -> DataFrame:
    """KX-08: per keyword the flattened queries and the crawler's string. A plan has at most 3 queries a platform."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("platform_pos", "pos", "expanded_query"))), lambda x: x["expanded_query"])
    one = planned.groupBy("keyword_id").agg(ordered.alias("q"), F.max("limit").alias("limit"))
    return one.select("keyword_id", F.array_join(S.unique_ignoring_case(F.col("q")), "|").alias("merged_keywords"), F.array_join(F.slice("q", 1, F.col("limit")), ",").alias("keywords_for_crawler"))


def reference_packages(keywords: DataFrame) -> DataFrame:
    """KX-07: keyword, first variant and goal suffixes, unique, three at most."""
    meta = scopes(keywords).select("*", F.explode("reference_sources").alias("source"))
    word = S.strip(F.coalesce("keyword", F.lit("")))
    suffixes = F.create_map(*[x for k, v in fixed.REFERENCE_SUFFIXES.items() for x in (F.lit("/".join(k)), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.element_at(suffixes, F.concat_ws("/", "source", "crawl_goal")), F.array().cast("array<string>"))
    first = F.slice(S.unique_ignoring_case(F.split(F.coalesce("query_variants", F.lit("")), r"\|")), 1, 1)
    every = F.concat(F.array(word), first, F.when(word != "", F.transform(own, lambda s: F.concat_ws(" ", word, s))).otherwise(F.array().cast("array<string>")))
    return meta.select("keyword_id", "source", F.array_join(F.slice(S.unique_ignoring_case(every), 1, 3), "|").alias("queries"))


def registry_rows(planned: DataFrame) -> DataFrame:
    """KX-09, S-16, S-18."""
    model = F.col("expansion_type") == "llm_supplement"
    t = S.tier(F.col("priority"), F.col("crawl_goal"))
    revisit, cooldown = S.tier_minutes(t, F.col("platform_code"))
    return planned.select(
        S.unit_key(F.col("normalized_keyword"), F.col("platform"), F.col("expanded_query")).alias("query_unit_key"), "keyword_id", "platform", "platform_code", "expanded_query", "expansion_type", "based_on",
        F.when(model, "llm").otherwise("manual").alias("source_type"), F.when(model, "pending").otherwise("approved").alias("review_status"), F.when(model, "candidate").otherwise("approved").alias("status"),
        t.alias("watchlist_tier"), S.lookup(fixed.TTL_DAYS, t).alias("ttl_days"), revisit.alias("revisit_minutes"), cooldown.alias("cooldown_minutes"),
    )
