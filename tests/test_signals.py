"""Goldens of the signal, retrieval and planning semantics on a few rows."""

from pyspark.sql import functions as F

from loomsight.operators import planner, retrieval, scheduling, signals

ROWS = [
    (1001, "xhs", "外泌体", "ingredient_frontier", "ingredient", "外泌体修护精华讨论升温", "多条内容将外泌体与修护和抗衰场景绑定。", "外泌体,修护,抗衰", 82.4, '{"note_url": "https://example.com/1"}', "2026-04-15T10:30:00", 184, None, None),
    (1002, "xhs", "外泌体", "ingredient_frontier", "ingredient", "外泌体与屏障修护共现", "讨论重点集中在屏障维稳和精华场景。", "外泌体,屏障,维稳", 76.0, '{"note_url": "https://example.com/2"}', "2026-04-15T11:15:00", 184, None, None),
    (1003, "dy", "猛药焕肤", "risk_hype", "risk_compliance", "高刺激焕肤话题升温", " ", "高浓度,焕肤,功效,治疗", 67.0, '{"share_url": "https://example.com/3"}', "2026-04-15T11:00:00", 185, None, "high"),
    (1004, "dy", "猛药焕肤", "risk_hype", "risk_compliance", "快速见效焕肤内容扩散", None, "刷酸,快速见效,功效,治疗", 61.0, None, "2026-04-15T11:10:00", 185, None, "high"),
    (1005, "xhs", "胶原蛋白", "ingredient_hype", "ingredient", "胶原蛋白内容热度提升", "相关内容存在", "胶原蛋白,口服,噪声", 78.0, '{"note_url": "https://example.com/5"}', "2026-04-15T09:00:00", 186, "low", None),
    (1006, "taobao", "冰晶眼膜", "concept", "category", "冰晶眼膜历史窗口热度提升", "历史数据", "冰晶眼膜,冷感", 72.0, "{}", "2026-03-01T00:00:00", 187, None, None),
]
COLUMNS = "id long, source_platform string, normalized_keyword string, topic_cluster string, trend_type string, title string, summary string, topics string, trend_score double, raw_data string, at string, crawl_task_id int, confidence string, risk_flag string"


def built(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS).withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    return signals.trend_signals(rows)


def test_four_signals(spark):
    got = {r.signal_id: r for r in built(spark).collect()}
    assert {k: (r.source_platform, r.trend_score, r.confidence, r.risk_flag, r.support_count) for k, r in got.items()} == {
        "TS_20260301_187_1006": ("taobao", 72.0, "medium", "low", 1),
        "TS_20260415_184_1001": ("xiaohongshu", 87.4, "medium", "medium", 2),
        "TS_20260415_185_1003": ("douyin", 72.0, "medium", "high", 2),
        "TS_20260415_186_1005": ("xiaohongshu", 78.0, "low", "low", 1),
    }
    one = got["TS_20260415_184_1001"]
    assert one.signal_summary == "外泌体 在 xiaohongshu 聚合出 2 条相关信号，代表性主题为ingredient_frontier。"
    assert one.evidence_ids == ["CTD_1001", "CTD_1002"] and one.source_url == "https://example.com/1" and str(one.fresh_until) == "2026-04-22 11:15:00"
    assert got["TS_20260415_185_1003"].signal_evidence == "高刺激焕肤话题升温 | 高浓度,焕肤,功效,治疗 || 快速见效焕肤内容扩散 | 刷酸,快速见效,功效,治疗"
    assert got["TS_20260301_187_1006"].source_url == "about:source/taobao/1006"


def test_meta_comes_first(spark):
    rows = spark.createDataFrame(ROWS[:2], COLUMNS).withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    r = signals.trend_signals(rows, {"keyword_id": "KW_1", "confidence": "high", "risk_flag": "", "normalized_keyword": "x"}).first()
    assert (r.keyword_id, r.confidence, r.risk_flag, r.normalized_keyword) == ("KW_1", "high", "medium", "x")


def test_behaviors(spark):
    store = built(spark).withColumn("pos", F.col("crawl_task_id"))
    asked = spark.createDataFrame([("a", "最近外泌体很火，值得跟吗"), ("b", "最近胶原蛋白很火，值得跟吗"), ("c", "最近猛药焕肤很火，值得跟吗"), ("d", "最近冰晶眼膜很火，值得跟吗"), ("e", "none"), ("f", " ")], "query_id string, query string")
    now = F.lit("2026-04-15 12:00:00").cast("timestamp_ntz")
    want = {"a": ("trend_supported", None), "b": ("trend_weak_or_missing", "low_confidence"), "c": ("trend_filtered_for_safety", "high_risk_blocked"), "d": ("trend_weak_or_missing", "stale"), "e": ("trend_weak_or_missing", None), "f": ("trend_weak_or_missing", None)}
    for config in (retrieval.Config(), retrieval.Config(block=2)):
        out = retrieval.answer(asked, retrieval.retrieve(asked, store, now, config=config), lambda r: F.concat(F.lit("hook:"), r["behavior_flag"]))
        got = {r.query_id: r for r in out.collect()}
        assert {k: (r.behavior_flag, r.top_rejection_reason) for k, r in got.items()} == want
        assert got["c"].policy_output == "hook:trend_filtered_for_safety"
        assert got["a"].summary == "Selected 外泌体 trend evidence from xiaohongshu."


def test_plans(spark):
    cols = "keyword_id string, keyword string, normalized_keyword string, query_variants string, suggested_platforms string, crawl_goal string, trend_type string, risk_flag string, priority string, confidence string"
    rows = [
        ("KW_0002", "外泌体", "外泌体", "外泌体|EXOSOMES|exosome|胞外囊泡", "xiaohongshu|douyin|industry_news", "trend_discovery", "ingredient", "medium", "high", "high"),
        ("KW_0040", "快速美白", "快速美白", "快速美白|7天美白|28天焕白", "douyin|xiaohongshu|taobao", "risk_monitoring", "claim", "high", "high", "medium"),
        ("KW_9", "Abc", "abc", "ABC|x|X", "XHS| xhs |bilibili|foo", "none", "none", "low", "high", "high"),
    ]
    kw = spark.createDataFrame(rows, cols)
    plan = planner.plan(kw)
    got = {}
    for r in plan.orderBy("keyword_id", "platform_pos", "pos").collect():
        got.setdefault((r.keyword_id, r.platform), []).append(r.expanded_query)
    assert got == {
        ("KW_0002", "xiaohongshu"): ["外泌体", "外泌体 护肤", "外泌体 趋势"],
        ("KW_0002", "douyin"): ["外泌体", "外泌体 趋势", "外泌体 成分"],
        ("KW_0040", "douyin"): ["快速美白", "快速美白 风险"],
        ("KW_0040", "xiaohongshu"): ["快速美白", "快速美白 风险"],
        ("KW_9", "xiaohongshu"): ["Abc", "x"],
        ("KW_9", "bilibili"): ["Abc", "x"],
    }
    refs = {(r.keyword_id, r.source): r.queries for r in planner.reference_packages(kw).collect()}
    assert refs == {("KW_0002", "industry_news"): "外泌体|外泌体 行业趋势|外泌体 原料创新", ("KW_0040", "taobao"): "快速美白|快速美白 护肤品|快速美白 功效"}
    assert {r.keyword_id: (r.crawl_targets, r.unsupported_sources) for r in planner.scopes(kw).collect()}["KW_9"] == (["xiaohongshu", "bilibili"], ["foo"])
    assert planner.plan(kw, override=["bili"]).select("platform").distinct().collect()[0][0] == "bilibili"
    reg = {r.keyword_id: r for r in planner.registry_rows(plan).collect()}
    assert (reg["KW_0040"].watchlist_tier, reg["KW_0040"].ttl_days) == ("watchlist-hot", 14)


def test_supplements_come_last_and_wait_for_review(spark):
    kw = spark.createDataFrame([("K", "Abc", "abc", "", "dy", "none", "none", "low", "high", "high", ["ABC", " q ", "r", "s"])], "keyword_id string, keyword string, normalized_keyword string, query_variants string, suggested_platforms string, crawl_goal string, trend_type string, risk_flag string, priority string, confidence string, more array<string>")
    plan = planner.plan(kw, supplements="more")
    assert [(r.expanded_query, r.status) for r in planner.registry_rows(plan.orderBy("pos")).collect()] == [("Abc", "approved"), ("q", "candidate"), ("r", "candidate")]


def test_series_first_bucket_and_gaps(spark):
    rows = [("s1", 1, "k", "p", 20.0, "2026-01-01T01:00:00", "e1", 1), ("s1", 1, "k", "p", 40.0, "2026-01-01T13:00:00", "e2", 2), ("s2", 2, "k", "p", 22.0, "2026-01-05T00:00:00", "e3", 3), ("s3", 2, " ", "p", 99.0, "2026-01-05T00:00:00", "e4", 4)]
    df = spark.createDataFrame(rows, "signal_id string, crawl_task_id int, normalized_keyword string, source_platform string, trend_score double, at string, signal_evidence string, pos long").withColumn("observed_at", F.col("at").cast("timestamp_ntz"))
    day = signals.series(df, "1d").orderBy("bucket_start").collect()
    assert [(r.avg_trend_score, r.delta, r.status, r.signal_count) for r in day] == [(30.0, 30.0, "emerging", 1), (22.0, -8.0, "stable", 1)]
    half = signals.series(df, "12h").orderBy("bucket_start").collect()
    assert [(str(r.bucket_start), r.delta, r.status) for r in half] == [("2026-01-01 00:00:00", 20.0, "emerging"), ("2026-01-01 12:00:00", 20.0, "emerging"), ("2026-01-05 00:00:00", -18.0, "cooling")]


def test_dedupe_is_idempotent_and_the_later_row_wins(spark):
    df = spark.createDataFrame([("a", None, 1, "x"), ("a", "2026-01-01", 2, "y"), ("a", "2026-01-01", 3, "z"), ("b", None, 4, "w")], "signal_id string, t string, pos long, v string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    one = signals.latest(df, "signal_id", "t", "pos")
    assert sorted((r.signal_id, r.v) for r in one.collect()) == [("a", "z"), ("b", "w")]
    assert sorted(map(tuple, signals.latest(one, "signal_id", "t", "pos").collect())) == sorted(map(tuple, one.collect()))


def test_state_and_audit(spark):
    ev = [("u", "schedule", "2026-01-01 00:00:00", 720, 1440, 1), ("u", "success", "2026-01-01 01:00:00", 720, 1440, 2), ("u", "failure", "2026-01-02 01:00:00", 720, 4320, 3), ("u", "failure", "2026-01-03 01:00:00", 720, 4320, 4), ("u", "schedule", "2026-01-04 00:00:00", 720, 4320, 5)]
    df = spark.createDataFrame(ev, "query_unit_key string, event string, at string, revisit_minutes int, cooldown_minutes int, pos long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    r = scheduling.fold_state(df).first()
    assert (r.n_events, r.last_event, r.failure_count, str(r.next_due_at)) == (5, "schedule", 2, "2026-01-06 01:00:00")
    items = spark.createDataFrame([("r1", "succeeded"), ("r1", "failed_terminal"), ("r2", "succeeded"), ("r3", "succeeded"), ("r3", "failed_retryable"), ("r3", "running")], "run_id string, item_status string")
    assert {x.run_id: x.classification for x in scheduling.audit(items).collect()} == {"r1": "completed_partial", "r2": "completed_full", "r3": "failed"}
