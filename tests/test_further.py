"""Paged sources, stores by tasks, quotas, segmentation, the scheduling run, repeated names."""

import itertools
import json
import math
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsight.functions import scalars as S
from loomsight.functions import segment
from loomsight.operators import delivery, flow, sampling, vendor
from loomsight.plans import further
from loomsight.sources import paged, sinks
from loomsight.streaming.store import Store

SCHEMA = "id long, name string, tags array<string>, at timestamp_ntz, score double"


def rows(n):
    return [(k, None if k % 7 == 0 else f"n{k % 5}", [f"t{k}"], datetime(2026, 1, 1 + k % 28), k / 2) for k in range(n)]


def test_pages(spark, tmp_path):
    paged.register(spark)
    df = spark.createDataFrame(rows(95), SCHEMA).repartition(4)
    paged.write_pages(df, f"{tmp_path}/p", "id", 10)
    assert len(list((tmp_path / "p").glob("*.json"))) == 10
    last = json.loads((tmp_path / "p" / "00000009.json").read_text())
    assert len(last["items"]) == 5 and not last["has_more"] and json.loads((tmp_path / "p" / "00000000.json").read_text())["cursor"] == 1
    reader = lambda: spark.read.format("pages").schema(SCHEMA).option("span", 3)
    got = reader().load(f"{tmp_path}/p")
    assert got.rdd.getNumPartitions() == 4 and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert reader().load(f"{tmp_path}/p").where("name = 'n3'").count() == df.where("name = 'n3'").count()
    for n in (0, 1, 10, 25, 95, 400):
        assert sorted(r.id for r in reader().option("limit", n).option("page_size", 10).load(f"{tmp_path}/p").collect()) == list(range(min(n, 95)))
    (tmp_path / "none").mkdir()
    assert reader().load(f"{tmp_path}/none").count() == 0


def test_pages_as_a_stream(spark, tmp_path):
    paged.register(spark)
    paged.write_pages(spark.createDataFrame(rows(30), SCHEMA), f"{tmp_path}/p", "id", 10)

    def more():
        s = spark.readStream.format("pages").schema(SCHEMA).load(f"{tmp_path}/p")
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").count()

    assert more() == 30
    (tmp_path / "p" / "00000003.json").write_text(json.dumps({"items": [{"id": 99}], "cursor": 4, "has_more": False}))
    assert more() == 31 and more() == 31


@pytest.mark.parametrize("kind", ["sqlite", "json_array"])
def test_stores(spark, tmp_path, kind):
    paged.register(spark)
    df = spark.createDataFrame([*rows(40), (None, 'q"uo\'te', None, None, None)], SCHEMA)
    at = f"{tmp_path}/s"
    df.repartition(3).write.format(kind).mode("append").save(at)
    assert len(list((tmp_path / "s").glob("part-*"))) == 3
    got = spark.read.format(kind).load(at)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    df.limit(5).write.format(kind).mode("append").save(at)
    assert spark.read.format(kind).load(at).count() == 46
    assert spark.read.format(kind).load(at).where("name = 'n3'").count() == got.where("name = 'n3'").count()
    before = paged.manifest(at)
    bad = df.withColumn("name", F.udf(lambda v: v if v != "n3" else 1 / 0, "string")("name"))
    with pytest.raises(Exception):
        bad.repartition(3).write.format(kind).mode("append").save(at)
    assert paged.manifest(at) == before and spark.read.format(kind).load(at).count() == 46
    df.limit(2).write.format(kind).mode("overwrite").save(at)
    assert spark.read.format(kind).load(at).count() == 2
    with pytest.raises(Exception):
        df.select("id").write.format(kind).mode("append").save(at)


def test_find(spark, tmp_path):
    paged.register(spark)
    spark.createDataFrame(rows(40), SCHEMA).write.format("json_array").mode("append").save(f"{tmp_path}/s")
    assert [r.id for r in paged.mongo_find(spark, f"{tmp_path}/s", 3, "-id", 1, name="n1").collect()] == [31, 26, 16]


def test_row_numbers(spark):
    df = spark.createDataFrame([(k * 7919 % 500, k) for k in range(500)], "a long, b long").repartition(7)
    got = sampling.numbered(df, "a").collect()
    assert sorted(r["__n"] for r in got) == list(range(500)) and all(r.a == r["__n"] for r in got)
    assert [r["__n"] for r in sampling.numbered(df, F.desc("a")).orderBy(F.desc("a")).limit(3).collect()] == [0, 1, 2]
    assert sampling.numbered(df.limit(0), "a").count() == 0


def test_quotas_are_exact(spark):
    quota = sampling.quotas(spark, {"a": {"x": 1, "y": 1, "z": 1}, "b": {"p": 0.5, "q": 0.5}}, 20)
    assert {(r.a, r.b): r.quota for r in quota.collect()} == {("x", "p"): 4, ("x", "q"): 4, ("y", "p"): 3, ("y", "q"): 3, ("z", "p"): 3, ("z", "q"): 3}
    df = spark.createDataFrame([(k, "xyz"[k % 3], "pq"[k // 3 % 2], k % 7 == 0) for k in range(600)] + [(1000, "x", "p", None)], "k long, a string, b string, hot boolean")
    got = sampling.by_quota(df, quota, ["a", "b"], "k", F.col("hot"), 50)
    assert Counter((r.a, r.b) for r in got.collect()) == {(r.a, r.b): r.quota for r in quota.collect()}
    assert all(n >= math.ceil(q / 2) for n, q in [(got.where(f"a = '{r.a}' and b = '{r.b}' and hot").count(), r.quota) for r in quota.collect()])
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in sampling.by_quota(df.repartition(5), quota, ["a", "b"], "k", F.col("hot"), 50).collect())
    few = df.where("a <> 'x' or k < 7")
    assert sampling.by_quota(few, quota, ["a", "b"], "k").where("a = 'x'").count() == few.where("a = 'x'").count()


def test_split_covers_every_stratum(spark):
    df = spark.createDataFrame([(k, "big") for k in range(103)] + [(200, "two"), (201, "two"), (300, "one"), (400, None), (401, None)], "k long, s string")
    got = {(r.s, r.split): r["count"] for r in sampling.stratified_split(df, ["s"], "k").groupBy("s", "split").count().collect()}
    assert got == {("big", "holdout"): 26, ("big", "dev"): 77, ("two", "holdout"): 1, ("two", "dev"): 1, ("one", "dev"): 1, (None, "holdout"): 1, (None, "dev"): 1}


def every_path(d, run):
    """The best of all ways to cut a run, the longer first word before others of equal worth."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        words, start = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                words.append(run[start:k])
                start = k
        words.append(run[start:])
        if all(w in d.worth or len(w) == 1 for w in words):
            worth = 0.0
            for w in reversed(words):
                worth = d.worth.get(w, d.alone) + worth
            key = (worth, [len(w) for w in words])
            if best is None or key > best[0]:
                best = (key, words)
    return best[1]


def test_best_path_against_all_paths():
    rng = np.random.default_rng(6)
    letters = "外泌体胶原蛋白"
    words = {"".join(rng.choice(list(letters), rng.integers(1, 4))): int(rng.integers(1, 50)) for _ in range(25)}
    d = segment.Dictionary(words)
    for _ in range(200):
        run = "".join(rng.choice(list(letters), rng.integers(1, 9)))
        assert d.path(run) == every_path(d, run)
    assert d.cut("") == [] and segment.Dictionary({}).cut("胶原 AB-12 x") == ["胶", "原", "AB-12", "x"]


def test_word_frequency_with_custom_words(spark):
    base = spark.createDataFrame([("胶原", 50), ("蛋白", 60), ("胶原蛋白", 10), ("眼膜", 5), ("的", 900)], "word string, n long")
    df = spark.createDataFrame([("胶原蛋白的眼膜 SPF50",), ("冰晶眼膜",), (None,), ("",)], "t string")
    plain = {r.word: r.n for r in segment.word_counts(df, "t", segment.dictionary(base), ["的"]).collect()}
    assert plain == {"胶原蛋白": 1, "眼膜": 2, "SPF50": 1}
    custom = segment.dictionary(base, spark.createDataFrame([("冰晶眼膜", None)], "word string, n long"))
    assert {r.word: r.n for r in segment.word_counts(df, "t", custom, ["的"]).collect()} == {"胶原蛋白": 1, "眼膜": 1, "冰晶眼膜": 1, "SPF50": 1}
    assert [r.words for r in segment.segmented(df.where("t like '冰%'"), "t", custom).collect()] == [["冰晶眼膜"]]


def test_a_failed_run_leaves_the_old_state(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 4)
    flow.create(store)
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    planned = further._planned(spark, "/root/testdata/sf0.001").where("keyword_id <= 6")
    assert flow.schedule(store, planned, now, "r1", 0) and not flow.schedule(store, planned, now, "r1", 0)
    before = store.manifest()
    tasks = store.table("tasks").count()
    assert tasks == store.table("events").count() == 3 * planned.select("keyword_id").distinct().count()
    assert store.table("states").where("last_task_id is not null").count() == tasks
    bad = planned.withColumn("notes", F.udf(lambda v: 1 / 0, "string")("notes"))
    with pytest.raises(Exception):
        flow.schedule(store, bad, now, "r2", 1)
    assert store.manifest() == before
    # the next run finds the first one's tasks
    assert flow.schedule(store, planned, now + F.expr("interval 1 hour"), "r2", 1)
    assert store.table("tasks").count() == tasks and store.table("events").where("event_type = 'skipped_duplicate'").count() == tasks


def test_repeated_names(spark):
    one = spark.range(1)
    r = one.select(S.cookies(F.lit("a=1; a=2; b=; =x; c=1=2")).alias("c"), S.cookies(F.lit(None).cast("string")).alias("n"), S.from_base36(F.lit("000zz")).alias("s"), S.from_base36(F.lit("1y2p0ij32e8e8")).alias("l"), S.from_base36_wide(F.lit("1y2p0ij32e8e8")).cast("string").alias("w"), S.from_base36_wide(F.lit("a-b")).alias("x")).first()
    assert r.c == {"a": "2", "b": "", "": "x"} and r.n == {} and r.s == 1295 and r.l is None and r.w == str(int("1y2p0ij32e8e8", 36)) and r.x is None
    with pytest.raises(Exception):
        one.select(S.content_id(F.lit("/no/id/"), S.ID_PATTERNS, strict=True)).collect()
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    new = spark.createDataFrame([(None, "c"), (2, None)], "k long, v string")
    assert sorted(map(str, (tuple(x) for x in sinks.field_merge(old, new, "k").collect()))) == ["(1, 'b')", "(2, None)", "(None, 'c')"]


def test_state_of_pages(spark):
    page = '<script>window.__INITIAL_STATE__={"userInfo":{"nickName":"aB","userID":1,"x":[undefined,2]},"noteId":undefined};</script>'
    text = spark.range(1).select(S.decamelized(S.state_text(F.lit(page), "__INITIAL_STATE__"))).first()[0]
    assert json.loads(text) == {"user_info": {"nick_name": "aB", "user_id": 1, "x": [None, 2]}, "note_id": None}
    other = '<p><script id="js-initialData" type="text/json">{"initialState":{"a":1}}</script>'
    assert spark.range(1).select(F.variant_get(S.script_json(F.lit(other), "js-initialData"), "$.initialState.a", "int")).first()[0] == 1


def test_vendor_comments(spark):
    raw = json.dumps({"id": 5, "content": "c", "user_info": {"user_id": "u", "nickname": "n"}, "pictures": [{"url_default": "a"}, {"url_default": "b"}], "target_comment": {"id": 9}})
    bare = json.dumps({"id": 6, "content": "d", "pictures": [{"url_default": "a"}]})
    got = {r.comment_id: r for r in vendor.comment_rows(spark.createDataFrame([(raw,), (bare,)], "raw string"), "xhs").collect()}
    assert (got["5"].pictures, got["5"].parent_comment_id, got["5"].sub_comment_count, got["6"].pictures, got["6"].parent_comment_id) == ("a,b", "9", "0", "a", "0")
    dy = spark.createDataFrame([("1", json.dumps({"cid": 1, "aweme_id": 1})), ("1", json.dumps({"cid": 2, "aweme_id": 2}))], "asked string, raw string")
    assert [r.comment_id for r in vendor.comment_rows(dy, "dy", asked="asked").collect()] == ["1"]


def test_delivery_tables(spark):
    raw = spark.createDataFrame([("1", " A ", "x"), ("1", "B", "x"), (None, "C", "y")], "`成分编号` string, `成分名称` string, `功效（2023）` string").withColumn("pos", F.monotonically_increasing_id())
    assert [tuple(r) for r in delivery.ingredient_table(raw, "pos").collect()] == [("1", "A|B", "x")]


def test_steps_with_a_model(spark):
    from loomsight.operators import agents

    df = spark.createDataFrame([("t1", "推荐", "k"), ("t2", None, "k2"), (None, None, "k3")], "title string, desc string, keyword string")
    plain = agents.execute([agents.Step("c", agents.cleaning, ("title",))], df)
    assert plain.success and [r.summary for r in plain.rows.orderBy("keyword").collect()] == ["t1 推荐", "t2", "k3"]
    broken = agents.execute([agents.Step("a", lambda d: d), agents.Step("b", lambda d: d, ("nothing",))], df)
    assert not broken.success and broken.done == ["a"] and "nothing" in broken.error

    def fails(prompts):
        raise OSError

    assert [r.sentiment for r in agents.cleaning(df, fails).orderBy("keyword").collect()] == ["positive", "neutral", "neutral"]
    words = agents.supplements(df, lambda ps: [json.dumps({"expanded_keywords": [p, " ", p, "b", "c"]}) for p in ps], "about {keyword}")
    assert {r.keyword: r.supplements for r in words.collect()} == {"k": ["about k", "b"], "k2": ["about k2", "b"], "k3": ["about k3", "b"]}
    assert agents.supplements(df).first().supplements == []


def test_documents_in_order(spark, tmp_path):
    import zipfile

    from loomsight.sources import readers

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('d')}</w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('first')}<w:p/>{table}{p('last')}<w:sectPr/></w:body></w:document>")
    got = readers.docx_blocks(spark, f"file://{tmp_path}/x.docx").orderBy("pos", "row").collect()
    assert [(r.pos, r.kind, r.row, r.cells) for r in got] == [(0, "paragraph", 0, ["first"]), (1, "table", 0, ["a", "b\nc"]), (1, "table", 1, ["d", ""]), (2, "paragraph", 0, ["last"])]


def test_workbooks_by_tasks(spark, tmp_path):
    from loomsight.sources import readers

    df = spark.createDataFrame([("a/b" if k % 3 else "c", k, [k]) for k in range(20)], "g string, k long, xs array<long>")
    files = sinks.workbooks(df, f"{tmp_path}/w", ["g"], "k", 6).collect()
    assert sorted((r.g, r.part, r.n_rows) for r in files) == [("a/b", 0, 6), ("a/b", 1, 6), ("a/b", 2, 1), ("c", 0, 6), ("c", 1, 1)]
    cells = delivery.header_rows(readers.workbooks(spark, f"file://{tmp_path}/w/*/*.xlsx"), 2, ["path", "sheet"]).collect()
    assert sorted(int(r.cells["k"]) for r in cells) == list(range(20)) and all(r.cells["xs"] == f"[{r.cells['k']}]" for r in cells)


def test_log_readers_and_last_lines(spark, tmp_path):
    from loomsight.streaming import logs

    store = Store(spark, f"file://{tmp_path}/s", 4)
    each = logs.fan_out(store, {"errors": lambda d: d.where("level = 'error'"), "all": lambda d: d}, 3)
    batch = lambda a, b: spark.createDataFrame([("s", k, " " if k == 4 else "error" if k % 3 == 0 else "ok") for k in range(a, b)], "stream string, pos long, line string")
    for number, part in enumerate((batch(0, 5), batch(5, 9))):
        each(part, number)
        each(part, number)
    assert sorted(r.pos for r in store.table("errors_lines").collect()) == [0, 3, 6]
    assert store.table("all_lines").count() == 8 and sorted(r.pos for r in store.table("last_lines").collect()) == [6, 7, 8]


def test_policies(spark):
    profiles = {"safe": {"default": {"a": 1, "b": 2}, "xhs": {"b": 3}}}
    assert S.resolved_policy(profiles, "xhs", "safe", {"a": None, "c": 9}) == {"a": 1, "b": 3, "c": 9, "platform": "xhs", "profile_name": "safe"}
    with pytest.raises(ValueError):
        S.resolved_policy(profiles, "xhs", "other")


def test_previews(spark, tmp_path):
    from loomsight.sources import readers

    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,b\n3,c\n')
    rows, total = readers.file_preview(spark, f"{tmp_path}/a.csv", 2)
    assert [tuple(r) for r in rows.collect()] == [("1", "two\nlines"), ("2", "b")] and total == 3
    (tmp_path / "b.json").write_text(json.dumps([{"x": k} for k in range(5)]))
    rows, total = readers.file_preview(spark, f"{tmp_path}/b.json", 2)
    assert [r.x for r in rows.collect()] == [0, 1] and total == 5
    (tmp_path / "c.xlsx").write_bytes(sinks.sheet_bytes("s", ["h"], [["1"], ["2"], ["3"]]))
    rows, total = readers.file_preview(spark, f"file://{tmp_path}/c.xlsx", 2)
    assert [r.cells for r in rows.collect()] == [{"h": "1"}, {"h": "2"}] and total == 3
    with pytest.raises(ValueError):
        readers.file_preview(spark, "x.bin")


def test_context_blocks_and_pages_of_a_search(spark):
    from loomsight.operators import retrieval
    from tests.test_signals import built

    stored = built(spark).withColumn("pos", F.col("crawl_task_id"))
    asked = spark.createDataFrame([("a", "最近外泌体很火，值得跟吗"), ("e", "none")], "query_id string, query string")
    now = F.lit("2026-04-15 12:00:00").cast("timestamp_ntz")
    got = {r.query_id: r for r in retrieval.context_blocks(asked, retrieval.retrieve(asked, stored, now), 1).collect()}
    items = json.loads(got["a"]["items"])
    assert got["a"].behavior_flag == "trend_supported" and len(items) == 1 and items[0]["normalized_keyword"] == "外泌体" and "T" in items[0]["fresh_until"]
    assert got["a"].block.startswith("## 最近外泌体") and "\n- 外泌体 (" in got["a"].block and json.loads(got["e"]["items"]) == [] or got["e"].behavior_flag
    page = [r.signal_id for r in retrieval.search(stored, now, limit=2, offset=1).collect()]
    assert page == [r.signal_id for r in stored.orderBy(F.desc("observed_at"), "signal_id").collect()][1:3]
