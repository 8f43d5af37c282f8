import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loomsight.functions import scalars as S
from loomsight.operators import delivery, scheduling, vendor
from loomsight.sources import readers, sinks
from loomsight.streaming import jobs


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "f,value,want",
    [
        (S.normalize_text, "　a \n b　", "a b"),
        (S.normalize_text, None, ""),
        (S.normalize_tags, "a，b、 a/ |c；;", "a|b|c"),
        (S.normalize_timestamp, "202603", "2026-03-01 00:00:00"),
        (S.normalize_timestamp, "2026/03/04", "2026-03-04 00:00:00"),
        (S.normalize_timestamp, "soon", ""),
        (S.safe_int, "12 ", 12),
        (S.safe_int, "1.5", 0),
        (S.safe_int, "1万", 0),
        (S.safe_int, "1_000", 0),
        (S.safe_int, None, 0),
        (S.first_int, "a 37 b 4", 37),
        (S.risk_of_topics, "修护,抗衰", "medium"),
        (S.risk_of_topics, "功效,治疗", "high"),
        (S.risk_of_topics, None, "low"),
        (S.signal_platform, "XHS", "XHS"),
        (S.platform_label, " XHS ", "xiaohongshu"),
        (S.platform_code, "Weibo", "wb"),
        (S.html_text, "<p>a<script>var x='</p>';</script><style>p{}</style> b</p>", "a b"),
        (S.inline_text, "a<i>b</i>", "ab"),
        (S.base36, 46655, "ZZZ"),
        (S.log_level, "Task 完成", "success"),
        (S.log_level, "warn: x", "warning"),
        (S.date_in, "公告 2024年3月5日", "2024-03-05"),
        (S.title_in, "附《规范》", "规范"),
        (S.zhihu_kind, "https://z/question/1/answer/2", "answer"),
        (S.paging_offset, "a?limit=2&offset=x1&b", "x1"),
        (S.trace_id, "http://h/spectrum/ab", "spectrum/ab"),
        (S.retryable, "Connection reset", True),
        (S.unix_of, "bad", 0),
    ],
)
def test_scalars(spark, f, value, want):
    kind = "string" if isinstance(value, str) or value is None else "long"
    assert one(spark, f(F.lit(value).cast(kind))) == want


def test_more_scalars(spark):
    low, high = S.price_band(F.lit("￥1,234.5-99元"))
    assert one(spark, low) == 1.0 and one(spark, S.price_band(F.lit("7起"))[1]) == 7.0
    assert one(spark, S.url_params(F.lit("http://h/p?a=1&b=&a=2&c=x%20y&d#z"))) == {"a": "2", "c": "x y"}
    assert one(spark, S.cookies(F.lit("a=1; b=2=3; c=4"))) == {"a": "1", "c": "4"}
    assert str(one(spark, S.wall_clock(F.lit("2026-04-15T11:15:00+08:00")))) == "2026-04-15 11:15:00"
    right, wall = S.rfc2822(F.lit("Sat Dec 23 17:12:54 +0800 2023"))
    assert one(spark, wall) - one(spark, right) == 8 * 3600
    assert one(spark, S.json_object(F.lit('text {"k": 3} more'), "k bigint"))["k"] == 3
    assert one(spark, S.json_object(F.lit("no json"), "k bigint")) is None
    assert one(spark, S.content_id(F.lit("https://b/video/BV1xx?x=1"), S.ID_PATTERNS)) == "BV1xx"
    assert one(spark, S.gender(F.lit(1), "xhs")) == "Female" and one(spark, S.gender(F.lit(1), "zhihu")) == "Male"
    assert one(spark, S.engagement(*[F.lit(x) for x in ("10", "2", "x", "1")])) == 17.0
    assert one(spark, S.unix_text(F.lit(1700000000000))) == "2023-11-14 22:13:20"
    summary, mood = S.analysis(F.lit(" 避雷 "), F.lit("推荐"), F.lit("k"))
    assert (one(spark, summary), one(spark, mood)) == ("避雷 推荐", "negative")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, add_ts long")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30), ], "k long, v string, add_ts long")
    assert sorted(map(tuple, scheduling.upsert(old, new, ["k"], keep=["add_ts"]).collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]
    assert sorted(map(tuple, scheduling.upsert(old, new, ["k"], only=["v"]).collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]


def workbook() -> bytes:
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>note</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>p</t></is></c><c r="C2" t="inlineStr"><is><t>q</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>5</v></c></row><row r="4"><c r="B4"/></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {m}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    cells = readers.workbooks(spark, str(tmp_path), "S1")
    assert [(r.row, r["values"]) for r in cells.orderBy("row").collect()] == [(1, ["note"]), (2, ["name", "p", "q"]), (3, ["ab", "", "5"]), (4, ["", ""])]
    assert [r.cells for r in delivery.header_rows(cells).collect()] == [{"name": "ab", "p": "", "q": "5"}]


def test_contract_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿signal_id,normalized_keyword,trend_score,confidence,risk_flag,observed_at,fresh_until\nA,k,72.0,High,LOW,2026-03-01T00:00:00+08:00,\n,x,1,,,,\n', encoding="utf-8")
    rows = readers.contract_signals(readers.csv_text(spark, str(tmp_path / "s.csv"))).collect()
    assert [(r.signal_id, r.trend_score, r.confidence, r.risk_flag, str(r.fresh_until)) for r in rows] == [("A", 72.0, "high", "low", "2026-03-08 00:00:00")]
    with pytest.raises(ValueError):
        readers.contract_signals(spark.createDataFrame([("x",)], "a string"))
    (tmp_path / "t.json").write_text('{"results": [{"signal_id": "B", "trend_score": "3", "fresh_until": null, "observed_at": "2026-01-01"}, {"x": 1}]}')
    (tmp_path / "u.json").write_text("{broken")
    got = readers.contract_signals(readers.json_signals(spark, [str(tmp_path / "t.json"), str(tmp_path / "u.json")])).collect()
    assert [(r.signal_id, r.trend_score, str(r.fresh_until)) for r in got] == [("B", 3.0, "2026-01-08 00:00:00")]
    assert readers.json_signals(spark, [str(tmp_path / "none.json")]).count() == 0
    legacy = spark.createDataFrame([("T", "k", "c", "1500", "20", "taobao", "2026-02-01 00:00:00")], "trend_id string, keyword string, topic_cluster string, heat_index string, growth_monthly string, platform string, captured_at string")
    r = readers.legacy_signals(legacy).first()
    assert (r.trend_score, r.confidence, r.risk_flag) == (16.0, "high", "medium")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "k long, ids array<string>, t string")
    assert sinks.export(df, f"{tmp_path}/x", "run1").first().row_count == 1
    sinks.export(df.union(df), f"{tmp_path}/x", "run2")
    assert spark.read.parquet(f"{tmp_path}/x/current").count() == 2 and spark.read.parquet(f"{tmp_path}/x/history").count() == 3
    sinks.delivery_csv(df, f"{tmp_path}/c")
    assert readers.csv_text(spark, f"{tmp_path}/c").first() == ("1", '["a","b"]', None)
    for kind in sinks.STORES:
        assert spark.read.format(sinks.STORES[kind]).load(sinks.store(df, f"{tmp_path}/s", "xhs", kind, "contents", "2026-01-01")).count() >= 1
    with pytest.raises(ValueError):
        sinks.store(df, f"{tmp_path}/s", "xhs", "nope", "contents", "d")
    both = spark.createDataFrame([("1d", 1), ("12h", 2)], "bucket_type string, v int")
    sinks.snapshot(both, f"{tmp_path}/n")
    sinks.snapshot(both.where("v = 1").withColumn("v", F.lit(5)), f"{tmp_path}/n")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/n").collect()) == [2, 5]
    assert "| k |" in sinks.markdown(df.select("k"))
    assert '"run":"r"' in sinks.envelope(df, run="r").first().value


def test_vendor_rows(spark):
    df = spark.createDataFrame([('{"id": 1, "commentId": "c9", "content": "", "timestamp": 5}',)], "raw string")
    assert vendor.flatten(df, "raw", vendor.COMMENT["ks"]).first().comment_id == "c9"
    with pytest.raises(ValueError):
        vendor.day_range("2024-01-02", "2024-01-01", spark)
    assert [(r.last_second - r.first_second) for r in vendor.day_range("2024-01-01", "2024-01-02", spark).collect()] == [86399, 86399]
    pages = spark.createDataFrame([(1, "<ul><li data-field='{\"id\": 7}'>a<b>c</b></li><li data-field='bad'>x</li></ul>"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.field, r.text) for r in readers.page_fields(pages).collect()] == [(1, '{"id": 7}', "ac")]


def test_stream_merge(spark, tmp_path):
    schema = "k long, v string"
    for i, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    fold = jobs.merge_into(f"{tmp_path}/state", ["k"], lambda b: b.select("k", "v"))
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/state").where("version = 1")
    assert sorted(r.k for r in last.collect()) == [1, 2, 3]
