"""Delivery tables: quality profiles and gates, collapsed relations, ids, clauses, samples, evaluation roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsight.functions import scalars as S


def quality_profile(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """AGG-15: rows, repeats of the key beyond its first, and blanks by required column; a missing column is all blank."""
    blank = lambda c: F.count_if(F.coalesce(S.strip(F.col(c).cast("string")), F.lit("")) == "") if c in df.columns else F.count("*")
    keys = df.groupBy(key).agg(F.count("*").alias("n"), *[blank(c).alias(f"blank_{c}") for c in required])
    return keys.agg(F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicate_keys"), *[F.sum(f"blank_{c}").alias(f"blank_{c}") for c in required])


def quality_gates(df: DataFrame, key: str, required: list[str], time: str | None = None, now=None) -> DataFrame:
    """D-01: a row per gate with its value, limit and verdict."""
    n = F.greatest(F.col("row_count"), F.lit(1))
    p = quality_profile(df, key, required)
    gates = [F.struct(F.lit("unique").alias("gate"), (1 - F.col("duplicate_keys") / n).alias("value"), F.lit(1.0).alias("least"))]
    full = sum((F.col(f"blank_{c}") for c in required), F.lit(0))
    gates.append(F.struct(F.lit("complete").alias("gate"), (1 - full / (n * max(1, len(required)))).alias("value"), F.lit(0.95).alias("least")))
    gates.append(F.struct(F.lit("duplicates").alias("gate"), (1 - F.col("duplicate_keys") / n).alias("value"), F.lit(0.98).alias("least")))
    if time:
        t = df.agg(F.avg(F.col(time).isNotNull().cast("int")).alias("valid"), F.max(time).alias("last"))
        p = p.crossJoin(t)
        gates.append(F.struct(F.lit("timestamps").alias("gate"), F.col("valid").alias("value"), F.lit(0.98).alias("least")))
        gates.append(F.struct(F.lit("fresh").alias("gate"), (F.col("last") >= now - F.make_dt_interval(days=F.lit(7))).cast("double").alias("value"), F.lit(1.0).alias("least")))
    return p.select(F.explode(F.array(*gates)).alias("g")).select("g.gate", F.round("g.value", 6).alias("value"), (F.col("g.value") >= F.col("g.least")).alias("passed"))


def collapse(df: DataFrame, key: str, pos: str, columns: list[str], sep: str = "|") -> DataFrame:
    """AGG-14: per key the distinct values of each column, joined in order of first appearance; null keys are one key."""
    out = None
    for c in columns:
        one = df.where(S.filled(F.col(c).cast("string")).isNotNull()).groupBy(key, F.trim(F.col(c).cast("string")).alias("v")).agg(F.min(pos).alias("p"))
        one = one.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]), sep).alias(c))
        keyed = one.withColumnRenamed(key, f"__{c}")
        base = df.select(key).distinct() if out is None else out
        out = base.join(keyed, base[key].eqNullSafe(keyed[f"__{c}"]), "left").drop(f"__{c}").withColumn(c, F.coalesce(c, F.lit("")))
    return out


def suffixed_ids(df: DataFrame, parts: list[str], pos: str, prefix: str = "trend_", length: int = 12) -> DataFrame:
    """S-06, WIN-03: ids of the parts; from the second row of one id on, numbered in order of position."""
    rows = df.withColumn("base_id", S.short_id(prefix, length, *[F.col(p).cast("string") for p in parts]))
    n = F.row_number().over(Window.partitionBy("base_id").orderBy(pos)) - 1
    return rows.withColumn("n", n).withColumn("row_id", F.when(F.col("n") > 0, F.concat_ws("_", "base_id", F.col("n").cast("string"))).otherwise(F.col("base_id"))).drop("n", "base_id")


def clauses(lines: DataFrame, source: str, pos: str, text: str, titles: tuple[str, ...] = ("附件", "附件1", "附件2")) -> DataFrame:
    """WIN-06, S-46: lines of each source folded into clauses; a chapter holds until the next, an article until either."""
    line = S.normalize_text(F.col(text))
    w = Window.partitionBy(source).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    is_chapter = F.col("line").rlike(S.CHAPTER)
    article = F.nullif(F.regexp_extract("line", S.ARTICLE, 1), F.lit(""))
    marked = lines.select(source, pos, line.alias("line")).withColumns({"is_chapter": is_chapter, "article": F.when(~is_chapter, article)})
    marked = marked.withColumns({"segment": F.sum((F.col("is_chapter") | F.col("article").isNotNull()).cast("int")).over(w), "chapter": F.coalesce(F.last(F.when(F.col("is_chapter"), F.col("line")), ignorenulls=True).over(w), F.lit(""))})
    # lines that go open nothing; behind the window their test reads the line as it is there, before it every test would make it anew
    marked = marked.where((F.col("line") != "") & ~F.col("line").isin(*titles) & ~F.col("line").rlike(S.DATE_LINE))
    body = marked.where(~F.col("is_chapter")).groupBy(source, "segment", "chapter").agg(F.sort_array(F.collect_list(F.struct(pos, "line"))).alias("l"), F.max("article").alias("article_no"), F.min(pos).alias("first_pos"))
    out = body.select(source, "first_pos", "chapter", F.coalesce("article_no", F.lit("preamble")).alias("article_no"), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("requirement_text"))
    return out.withColumn("rule_id", S.hashed_id("rule_", 16, S.normalize_text(F.col(source).cast("string")), F.col("chapter"), F.col("article_no"), F.col("requirement_text")))


def header_rows(cells: DataFrame, least: int = 3, sheet: list[str] | None = None) -> DataFrame:
    """SRC-11: from sheets of ``(row, values)``, the rows under the first with ``least`` filled cells, as maps by its names;
    of a repeated header the last cell holds. ``sheet``: the columns that tell sheets apart, none for a single one."""
    by = sheet or []
    full = F.size(F.filter("values", lambda v: S.filled(v).isNotNull()))
    head = cells.where(full >= least).groupBy(*by).agg(F.min_by("values", "row").alias("names"), F.min("row").alias("at"))
    rows = (cells.join(head, by) if by else cells.crossJoin(F.broadcast(head))).where((F.col("row") > F.col("at")) & (full > 0))
    pairs = F.transform("names", lambda n, i: F.struct(n.alias("k"), F.coalesce(F.get(F.col("values"), i), F.lit("")).alias("v")))
    return rows.select(*by, "row", S.last_of(pairs).alias("cells"))


def replace_rows(manifest: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SET-06: rows of the new keys go, the new ones follow."""
    return manifest.join(new.select(key), key, "left_anti").unionByName(new)


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-09: columns ``(table, column, type)`` added, deleted or modified from ``a`` to ``b``."""
    both = a.withColumnRenamed("type", "old").join(b.withColumnRenamed("type", "new"), ["table", "column"], "full_outer")
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("same"))


def stratified(df: DataFrame, stratum: str, key: str, quota: int) -> DataFrame:
    """D-02: a deterministic sample of ``quota`` rows of each stratum, by hash of the key."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota).drop("rn")


def split(df: DataFrame, key: str, holdout_percent: int = 25) -> DataFrame:
    """D-07: dev or holdout by hash of the key."""
    return df.withColumn("split", F.when(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("int") % 100 < holdout_percent, "holdout").otherwise("dev"))


def eval_rollup(scores: DataFrame, by: str) -> DataFrame:
    """D-03: mean scores, violations and high latency by question type."""
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("correctness"), 4).alias("correctness"), F.round(F.avg("safety"), 4).alias("safety"), F.sum("violation").alias("violations"), F.expr("percentile(latency, 0.95)").alias("p95_latency"))


def release_gates(scores: DataFrame) -> DataFrame:
    """D-04."""
    one = scores.agg(F.avg("correctness").alias("c"), F.avg("completeness").alias("k"), F.avg("safety").alias("s"), F.sum("violation").alias("v"), F.expr("percentile(latency, 0.95)").alias("p"))
    gate = lambda name, value, ok: F.struct(F.lit(name).alias("gate"), F.round(value.cast("double"), 4).alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"))
    c = F.col
    rows = [gate("correctness", c("c"), c("c") >= 1.4), gate("completeness", c("k"), c("k") >= 1.2), gate("safety", c("s"), c("s") >= 1.8), gate("violations", c("v"), c("v") == 0), gate("latency_p95", c("p"), c("p") <= 5.0)]
    return one.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


#: PRJ-01: headers of the raw workbooks and their names. Fixed values.
PRODUCT = {"spu_id（商品id）": "product_id", "brand（品牌）": "brand", "category_lv1（一级类目）": "category_lv1", "category_lv2（二级类目）": "category_lv2", "price_band（价格带）": "price_band", "launch_date（上架日期）": "launch_date", "core_claims（核心卖点）": "core_claims"}
REVIEW = {"review_id（评论id）": "review_id", "spu_id（商品id）": "product_id", "source（来源渠道,默认taobao）": "source", "rating_bucket（评分，1-5分）": "rating_bucket", "sentiment_tag（情感标签，好坏）": "sentiment_tag", "effect_tags（效果标签）": "effect_tags", "issue_tags（问题标签）": "issue_tags", "content（评论内容）": "content", "created_at（评论时间）": "created_at"}
TREND = {"trend_id（趋势id）": "trend_id", "keyword（趋势词）": "keyword", "topic_cluster（话题簇）": "topic_cluster", "heat_index（热度指数）": "heat_index", "growth_md（月增长率）": "growth_monthly", "platform（平台,默认taobao）": "platform", "captured_at（采集时间）": "captured_at"}
INGREDIENT = {"成分编号": "ingredient_id", "成分名称": "name_cn", "INCI 名称": "inci_name", "CAS号": "cas_no", "同义词，多个逗号分隔": "synonyms", "最新使用目的(2023)": "use_purpose_2023", "功效（2023）": "efficacy_2023", "文献验证功效": "literature_evidence"}
RELATION = {"成分编号": "ingredient_id", "功效": "efficacy_relation", "机理（旧）": "mechanism_legacy", "机理序号1": "mechanism_id_1", "参考资料": "reference_1", "机理序号2": "mechanism_id_2", "参考资料2": "reference_2"}


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """PRJ-01: the named columns alone, in the order of ``names``; those that are not there are left out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns])


def product_table(df: DataFrame) -> DataFrame:
    """PRJ-01: products with the price band taken apart, dates and claims normalised."""
    out = renamed(df, PRODUCT)
    low, high = S.price_band(F.col("price_band"))
    return out.select("product_id", "brand", "category_lv1", "category_lv2", "price_band", low.alias("price_min"), high.alias("price_max"), S.normalize_timestamp(F.col("launch_date")).alias("launch_date"), S.normalize_tags(F.col("core_claims")).alias("core_claims"))


def review_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-02: the same reviews without and with their text."""
    out = renamed(df, REVIEW).withColumns({"rating_bucket": F.coalesce(F.col("rating_bucket").cast("string"), F.lit("unknown")), "effect_tags": S.normalize_tags(F.col("effect_tags")), "issue_tags": S.normalize_tags(F.col("issue_tags")), "created_at": S.normalize_timestamp(F.col("created_at")), "content": S.normalize_text(F.col("content"))})
    full = out.select("review_id", "product_id", "source", "rating_bucket", "sentiment_tag", "effect_tags", "issue_tags", "content", "created_at")
    return full.drop("content"), full


def union_all(parts: list[DataFrame]) -> DataFrame:
    """SET-05: rows of tables whose columns differ, as text, blank where a table lacks a column."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    return reduce(DataFrame.unionByName, [p.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in p.columns else F.lit("").alias(c) for c in names]) for p in parts])


def seeded(seeds: DataFrame, reports: DataFrame) -> DataFrame:
    """JOIN-12: seed keywords of registered reports that can be read."""
    return seeds.join(reports.where("extractability in ('high', 'medium')").drop("extractability"), "report_id")


def trend_table(df: DataFrame) -> DataFrame:
    """PRJ-01: trends, numbers as numbers and the time normalised."""
    out = renamed(df, TREND)
    return out.select("trend_id", "keyword", "topic_cluster", F.col("heat_index").try_cast("bigint").alias("heat_index"), F.col("growth_monthly").try_cast("double").alias("growth_monthly"), F.coalesce(S.filled(F.col("platform")), F.lit("taobao")).alias("platform"), S.normalize_timestamp(F.col("captured_at")).alias("captured_at"))


def ingredient_table(df: DataFrame, pos: str) -> DataFrame:
    """PRJ-01: a row for each ingredient, its uses, effects and evidence of all rows joined in order of first appearance."""
    out = df.select(pos, *[F.col(f"`{old}`").alias(new) for old, new in INGREDIENT.items() if old in df.columns])
    kept = out.where(S.filled(F.col("ingredient_id").cast("string")).isNotNull())
    return collapse(kept, "ingredient_id", pos, [c for c in out.columns if c not in (pos, "ingredient_id")])


def relation_table(df: DataFrame) -> DataFrame:
    """PRJ-01: ingredient and effect with mechanisms and references; rows without either go, equal rows are one."""
    out = renamed(df, RELATION)
    text = out.select(*[S.normalize_text(F.col(c)).alias(c) for c in out.columns])
    return text.where("ingredient_id <> '' and efficacy_relation <> ''").distinct()


def eval_report(scores: DataFrame, by: list[str]) -> DataFrame:
    """D-03: of each group and of all (nulls) the mean scores of 0 to 2, the share of hallucinations, violations and P95 latency.

    Scores outside 0 to 2 count as missing; a group without any has a null mean.
    """
    kept = lambda c: F.when(F.col(c).between(0, 2), F.col(c))
    means = [F.round(F.avg(kept(c)), 4).alias(c) for c in ("correctness", "completeness", "safety", "freshness", "explainability") if c in scores.columns]
    rate = F.round(F.avg(F.coalesce(F.col("hallucination"), F.lit(False)).cast("int")), 4).alias("hallucination_rate")
    return scores.rollup(*by).agg(F.count("*").alias("n"), *means, rate, F.sum("violation").alias("violations"), F.expr("percentile(latency, 0.95)").alias("p95_latency"))


def validated(rows: DataFrame, enums: dict[str, list[str]] | None = None, ranges: dict[str, tuple[float | None, float | None]] | None = None, lengths: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """FLT-16: ``rows`` with ``faults``, the columns whose value is no member, out of range or of the wrong length, in order.

    A null is a fault of a length whose least is above 0, and of nothing else.
    """
    checks: list[tuple[str, Column]] = [(c, ~F.col(c).isin(*values)) for c, values in (enums or {}).items()]
    for c, (low, high) in (ranges or {}).items():
        out = F.lit(False) if low is None else F.col(c) < low
        checks.append((c, out if high is None else out | (F.col(c) > high)))
    for c, (least, most) in (lengths or {}).items():
        checks.append((c, ~F.char_length(F.coalesce(F.col(c), F.lit(""))).between(least, most)))
    return rows.withColumn("faults", F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(c)) for c, bad in checks]))))
