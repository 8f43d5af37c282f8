"""Operators of the export, the registry, retrieval and the sinks beyond what SQL compares."""

import random

import pytest
from pyspark.sql import functions as F

from loomsight.operators import export, retrieval, scheduling, signals
from loomsight.plans import more
from loomsight.sources import readers, sinks
from loomsight.streaming import jobs

SIGNAL = "signal_id string, normalized_keyword string, topic_cluster string, trend_type string, signal_summary string, signal_evidence string, source_platform string, trend_score double, confidence string, risk_flag string, fresh_until timestamp_ntz, pos long"


def scored(question, signal):
    low = question.strip().lower()
    key = signal[1].lower()
    text = " ".join(x or "" for x in signal[1:6]).lower()
    points = sum(t in text for t in low.split())
    return points + (2 if key in low else 1 if low and low in key else 0)


def test_retrieval_against_every_pair(spark):
    rnd = random.Random(3)
    words = ["a", "of", "retinol", "skin", "皮肤", "敏感 肌", "spf", "sun cream", "", "serum", "in"]
    stock = [(f"S{k}", rnd.choice(words), rnd.choice(words), "t", " ".join(rnd.choices(words, k=4)), None, "x", float(rnd.randint(0, 90)), "high", "low", None, k) for k in range(60)]
    asked = [(f"q{k}", rnd.choice(["", " "]) + " ".join(rnd.choices(words, k=rnd.randint(0, 4)))) for k in range(40)] + [("again", "a a SKIN"), ("again2", "a a skin")]
    got = retrieval.retrieve(spark.createDataFrame(asked, "query_id string, query string"), spark.createDataFrame(stock, SIGNAL), F.lit("2024-01-01").cast("timestamp_ntz"))
    want = []
    for q, text in asked:
        best = sorted(((-(scored(text, s) * 100 + s[7]), s[11]) for s in stock if scored(text, s) > 0))[:5]
        want += [(q, f"S{pos}", k + 1, -score) for k, (score, pos) in enumerate(best)]
    assert sorted((r.query_id, r.signal_id, r["rank"], r.match_score) for r in got.collect()) == sorted(want)


def test_retrieval_makes_no_pairs_by_nested_loops(spark):
    df = retrieval.retrieve(spark.createDataFrame([("q", "x")], "query_id string, query string"), spark.createDataFrame([], SIGNAL), F.lit("2024-01-01").cast("timestamp_ntz"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and df.count() == 0


def shuffled_rows(df):
    df.collect()

    def of(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(of(plan.children().apply(k)) for k in range(plan.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_retrieval_shuffles_no_pairs(spark):
    rnd = random.Random(4)
    words = ["of", "a", "retinol", "skin", "皮肤", "spf", "sun cream", "serum", "in", ""]
    stock = [(f"S{k}", rnd.choice(words), "of", "t", " ".join(rnd.choices(words, k=4)), None, "x", None if k % 9 == 0 else float("nan") if k == 200 else float(rnd.randint(0, 90)), "high", "low", None, k) for k in range(400)]
    asked = [(f"q{k}", f"of {rnd.choice(words)} {rnd.choice(words)} n{k}") for k in range(120)] + [("none", None), ("blank", " "), ("key", "su")]
    made = spark.createDataFrame(asked, "query_id string, query string"), spark.createDataFrame(stock, SIGNAL)
    df = retrieval.retrieve(*made, F.lit("2024-01-01").cast("timestamp_ntz"), config=retrieval.Config(block=64))
    # every question shares a word with every signal
    assert 0 < shuffled_rows(df) < 120 * 400 / 4
    order = lambda s: (0 if s[7] != s[7] else 2 if s[7] is None else 1)
    want = []
    for q, text in asked:
        best = sorted((order(s), -(scored(text, s) * 100 + s[7]) if order(s) == 1 else 0, s[11]) for s in stock if text is not None and scored(text, s) > 0)[:5]
        want += [(q, f"S{pos}", k + 1) for k, (_, _, pos) in enumerate(best)]
    assert sorted((r.query_id, r.signal_id, r["rank"]) for r in df.collect()) == sorted(want)


def test_files_of_runs(spark):
    made = lambda *paths: spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, pos long")
    rows = lambda df: [(r.path, r["mode"]) for r in df.orderBy("pos").collect()]
    assert rows(export.source_files(made("b", "a", "b", " "), made("a"), made("z"))) == [("b", "batch_events"), ("a", "batch_events")]
    assert rows(export.source_files(made("b"), made("c", "b"), made("z"))) == [("b", "batch_reports"), ("c", "batch_reports")]
    assert rows(export.source_files(made(), made(), made("y", "z"))) == [("z", "legacy_filesystem"), ("y", "legacy_filesystem")]
    with pytest.raises(Exception, match="no signal files"):
        export.source_files(made(), made(), made("y"), explicit=True).collect()


def test_requested_runs_must_be_there(spark):
    runs = spark.createDataFrame([("r1", "int002_runtime", "completed"), ("r2", "int002_runtime", "failed")], "run_id string, run_type string, status string")
    events = spark.createDataFrame([("r1", "task_completed"), ("r2", "task_completed"), ("r1", "started")], "run_id string, event_type string")
    assert export.runtime_events(runs, events, ["r1"]).count() == 1
    with pytest.raises(ValueError, match="r2"):
        export.runtime_events(runs, events, ["r1", "r2"])


def test_json_lists_under_any_name(spark, tmp_path):
    for k, text in enumerate(['{"trend_signals": [{"signal_id": "A", "support_count": 3}]}', '{"signals": [{"signal_id": "B"}, {"signal_id": " "}]}', '{"results": [{"signal_id": "C"}]}', '{"trend_signals": 4}', "{broken"]):
        (tmp_path / f"{k}.json").write_text(text)
    got = readers.json_signals(spark, [str(tmp_path)]).collect()
    assert sorted(r.signal_id for r in got) == ["A", "B", "C"]
    with pytest.raises(Exception):
        readers.json_signals(spark, [str(tmp_path / "4.json")], strict=True).collect()


def test_manifest_by_first_folder(spark, tmp_path):
    for p in ("a/b/c/x.txt", "d/y.txt", "z.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    assert {r.file_name: r.category for r in readers.file_manifest(spark, str(tmp_path)).collect()} == {"x.txt": "a", "y.txt": "d", "z.txt": "root"}


def test_pages_end_with_the_cursor_or_the_bound(spark):
    asked = []

    def fetch(cursor):
        asked.append(cursor)
        at = int(cursor or 0)
        return [{"id": at * 2 + k} for k in range(2)], str(at + 1) if at < 4 else None

    assert readers.pages(fetch, spark, "id long").count() == 10 and asked == ["", "1", "2", "3", "4"]
    asked.clear()
    assert readers.pages(fetch, spark, "id long", 3).count() == 3 and asked == ["", "1"]


def test_files_are_replaced_and_runs_repeated(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "k long")
    for n in (1, 2):
        sinks.publish_file(one.withColumn("v", F.lit(n)), f"{tmp_path}/f.csv", "csv", header="true")
    assert (tmp_path / "f.csv").read_text() == "k,v\n1,2\n" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["f.csv"]
    for _ in range(2):
        sinks.export(one, f"{tmp_path}/x", "run")
    assert spark.read.parquet(f"{tmp_path}/x/history").count() == 1
    sinks.publish_version(one, f"{tmp_path}/v", "a")
    sinks.publish_version(one.union(one), f"{tmp_path}/v", "b")
    assert sinks.published(spark, f"{tmp_path}/v").count() == 2
    assert sinks.markdown(spark.range(1500)).count("\n") == 1501


def test_workbook_and_media(spark, tmp_path):
    df = spark.createDataFrame([("a<b&", [1, 2]), (None, None)], "k string, v array<int>")
    (tmp_path / "b.xlsx").write_bytes(sinks.workbook({"one": df, "none": df.limit(0), **{f"s{k}": df for k in range(9)}}))
    got = readers.workbooks(spark, str(tmp_path / "b.xlsx")).collect()
    assert [r["values"] for r in got if r.sheet == "one"] == [["k", "v"], ["a<b&", "[1,2]"], ["", ""]] and {r.sheet for r in got} == {"one", "s0", "s1", "s2", "s3"}
    media = spark.createDataFrame([("images", "n1", "1.jpg", bytearray(b"x"))], "kind string, id string, file string, content binary")
    assert sinks.media(media, f"{tmp_path}/m", "xhs").first().place.endswith("xhs/media/kind=images/n1/1.jpg") and spark.read.parquet(f"{tmp_path}/m/xhs/media").count() == 1


def test_registry_keeps_decisions(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    base = spark.createDataFrame([(1, "dy", "q", "manual", "approved", "approved", True, "seed", "b", None, 30), (1, "dy", "r", "manual", "pending", "pending", True, "seed", "b", "n", 30)], "keyword_db_id long, platform string, expanded_query string, source_type string, review_status string, status string, is_active boolean, expansion_type string, based_on string, notes string, ttl_days int").withColumns({"expires_at": at, "last_seen_at": at})
    new = base.drop("is_active", "expires_at", "last_seen_at").withColumns({"status": F.lit("deprecated"), "review_status": F.lit("rejected"), "ttl_days": F.lit(0), "notes": F.lit(None).cast("string")})
    got = {r.expanded_query: r for r in scheduling.registry_upsert(base, new, F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert (got["q"].status, got["q"].is_active, str(got["q"].expires_at)) == ("approved", True, "2024-03-02 00:00:00")
    assert (got["r"].status, got["r"].review_status, got["r"].is_active, got["r"].notes) == ("deprecated", "rejected", False, "n")


def test_a_stream_goes_on(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    q = jobs.follow(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_metadata_of_each_task(spark):
    df = more.signals_with_metadata(spark, "/root/testdata/sf0.001")
    got = {(r.crawl_task_id % 4 == 3, r.keyword_id.startswith("KW_TASK_")) for r in df.collect()}
    assert got == {(True, True), (False, False)}
    assert signals.signal_totals(spark.createDataFrame([], "id long"), spark.createDataFrame([], "support_count int")).first().max_support == 0


def test_a_delivery_is_many_files(spark, tmp_path):
    df = spark.range(0, 100, 1, 2).select("id", F.concat(F.lit('a "b",\n'), "id").alias("t"))
    for _ in range(2):
        sinks.delivery_parts(df, f"{tmp_path}/d.csv", 20)
    files = [p.read_text(encoding="utf-8") for p in (tmp_path / "d.csv").glob("*.csv")]
    assert len(files) == 6 and all(f.startswith("\ufeffid,t\n") for f in files)
    got = readers.csv_text(spark, f"{tmp_path}/d.csv")
    assert got.columns == ["id", "t"] and sorted(map(tuple, got.collect())) == sorted((str(k), f'a "b",\n{k}') for k in range(100))
