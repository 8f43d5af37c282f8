"""Readers of contract files: CSV and JSON signals, keywords, workbooks, documents, pages, catalogs."""

from __future__ import annotations

import html.parser
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsight.functions import scalars as S

SIGNAL_COLUMNS = "signal_id keyword_id crawl_task_id normalized_keyword topic_cluster trend_type signal_summary signal_evidence source_platform source_url trend_score confidence risk_flag observed_at fresh_until".split()
EXTENSIONS = "report_id signal_period_type signal_period_label source_scope support_count evidence_ids aggregation_method version".split()
KEYWORD_COLUMNS = "keyword_id keyword normalized_keyword topic_cluster trend_type report_id report_publish_date signal_period_type signal_period_label time_granularity source_scope priority confidence suggested_platforms query_variants crawl_goal risk_flag notes".split()
KEYWORD_DEFAULTS = {"trend_type": "ingredient", "priority": "medium", "confidence": "medium", "crawl_goal": "trend_discovery", "risk_flag": "low"}


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: all columns text, a byte-order mark allowed, header required."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def contract_signals(rows: DataFrame, freshness_days: int = 7) -> DataFrame:
    """SRC-02, SRC-03: the signal contract from text columns; ``signal_id`` is required, a missing ``fresh_until`` follows
    from ``observed_at``."""
    if "signal_id" not in rows.columns:
        raise ValueError("no signal_id: not a trend_signal file")
    text = lambda c: S.filled(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("string")
    observed = S.wall_clock(text("observed_at"))
    fresh = F.coalesce(S.wall_clock(text("fresh_until")), observed + F.make_dt_interval(days=F.lit(freshness_days)))
    special = {"trend_score": F.coalesce(text("trend_score").try_cast("double"), F.lit(0.0)), "confidence": F.lower(F.coalesce(text("confidence"), F.lit("low"))), "risk_flag": F.lower(F.coalesce(text("risk_flag"), F.lit("low"))), "observed_at": observed, "fresh_until": fresh}
    return rows.where(text("signal_id").isNotNull()).select(*[special.get(c, F.coalesce(text(c), F.lit(""))).alias(c) for c in SIGNAL_COLUMNS])


_SIGNAL = T.StructType([T.StructField(c, T.StringType()) for c in SIGNAL_COLUMNS + EXTENSIONS])
#: Names under which files list their signals.
LISTS = ("results", "trend_signals", "signals")


def json_signals(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """SRC-03, SRC-05, SRC-06: rows of the files' lists (``LISTS``) that have a ``signal_id``. Missing files give none;
    so do files that are broken or hold no list, unless ``strict``: then a broken file is an error when it is read."""
    envelope = T.StructType([T.StructField(x, T.StringType()) for x in LISTS])
    try:
        df = spark.read.schema(envelope).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _SIGNAL)
    # a list is read from its own text, so that a file whose list is something else spoils nothing
    rows = F.coalesce(*[F.from_json(x, T.ArrayType(_SIGNAL)) for x in LISTS])
    return df.select(F.explode(rows).alias("r")).select("r.*").where(S.filled(F.col("signal_id")).isNotNull())


def legacy_signals(rows: DataFrame, freshness_days: int = 7) -> DataFrame:
    """SRC-04: the older table's heat and growth as a score; risk is medium."""
    heat, growth = F.coalesce(F.col("heat_index").try_cast("double"), F.lit(0.0)), F.coalesce(F.col("growth_monthly").try_cast("double"), F.lit(0.0))
    at = S.wall_clock(F.col("captured_at"))
    return rows.select(
        F.col("trend_id").alias("signal_id"), F.col("keyword").alias("normalized_keyword"), "topic_cluster", F.col("platform").alias("source_platform"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), heat / 100 + growth / 20)).alias("trend_score"), F.when(heat >= 1000, "high").when(heat >= 200, "medium").otherwise("low").alias("confidence"),
        F.lit("medium").alias("risk_flag"), at.alias("observed_at"), (at + F.make_dt_interval(days=F.lit(freshness_days))).alias("fresh_until"),
    )


def keywords(rows: DataFrame) -> DataFrame:
    """SRC-07, FLT-16: typed keyword rows with defaults; rows whose enumerations are unknown go to ``reject``."""
    text = lambda c: S.filled(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    out = rows.select(*[F.coalesce(text(c), F.lit(KEYWORD_DEFAULTS.get(c, ""))).alias(c) for c in KEYWORD_COLUMNS])
    level = lambda c: F.col(c).isin("low", "medium", "high")
    return out.withColumn("reject", ~(level("priority") & level("confidence") & level("risk_flag") & (F.col("keyword") != "")))


def first_keywords(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """SRC-08: keyword rows in the file's order, the first ``limit`` of them where that is set."""
    rows = csv_text(spark, path)
    if limit is not None:
        rows = rows.withColumn("__pos", F.monotonically_increasing_id()).orderBy("__pos").limit(limit).drop("__pos")
    return keywords(rows)


def pages(fetch: Callable[[str], tuple[list[dict], str | None]], spark: SparkSession, schema: str, most: int | None = None) -> DataFrame:
    """SRC-19: rows of a source that hands them out page by page. ``fetch`` takes a cursor, blank at first, and returns
    rows and the next cursor, or None after the last page; no more pages are asked for once ``most`` rows are there."""
    rows, cursor = [], ""
    while cursor is not None and (most is None or len(rows) < most):
        found, cursor = fetch(cursor)
        rows += found
    return spark.createDataFrame(rows if most is None else rows[:most], schema)


def _cells(raw: bytes):
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for sheet in book.find("m:sheets", ns):
            target = relations[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for k, row in enumerate(root.iter(f"{{{ns['m']}}}row")):
                values: list[str] = []
                for cell in row.findall("m:c", ns):
                    column = 0
                    for c in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                        column = column * 26 + ord(c) - 64
                    at = column - 1 if column else len(values)
                    values += [""] * (at + 1 - len(values))
                    v = cell.find("m:v", ns)
                    if cell.get("t") == "inlineStr":
                        values[at] = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
                    elif v is not None and v.text is not None:
                        values[at] = strings[int(v.text)] if cell.get("t") == "s" else v.text
                yield sheet.get("name"), int(row.get("r") or k + 1), values


def workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """SRC-09, SRC-10: cells of the sheets of workbooks, as text, by the standard library: ``path, sheet, row, values``."""

    def run(batches):
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(p, *r) for r in _cells(raw)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if k < 3 else pa.array(c, pa.list_(pa.string())) for k, c in enumerate(zip(*rows))], ["path", "sheet", "row", "values"])

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row long, values array<string>")
    return df.where(F.col("sheet") == sheet) if sheet else df


def docx_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: paragraphs and table cells of docx files in order: ``path, pos, line``."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(batches):
        for batch in batches:
            rows = []
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
                lines = ["".join(t.text or "" for t in par.iter(f"{w}t")) for par in root.iter(f"{w}p")]
                rows += [(p, k, x) for k, x in enumerate(x for x in lines if x.strip())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "pos", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, line string")


def docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: paragraphs and tables of docx files in their order: ``path, pos, kind, row, cells``.

    A paragraph is one cell of row 0; a table has a row for each of its rows, ``pos`` the table's. A table within a cell is
    part of that cell's text. Blank paragraphs go, blank cells stay.
    """
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text = lambda e: "\n".join(x for x in ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in e.iter(f"{w}p")) if x.strip())

    def run(batches):
        for batch in batches:
            rows = []
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
                pos = 0
                for block in body if body is not None else ():
                    if block.tag == f"{w}p":
                        line = "".join(t.text or "" for t in block.iter(f"{w}t"))
                        if not line.strip():
                            continue
                        rows.append((p, pos, "paragraph", 0, [line]))
                    elif block.tag == f"{w}tbl":
                        rows += [(p, pos, "table", k, [text(c) for c in r.findall(f"{w}tc")]) for k, r in enumerate(block.findall(f"{w}tr"))]
                    else:
                        continue
                    pos += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k < 4 else pa.array(c, pa.list_(pa.string())) for k, c in enumerate(zip(*rows))], ["path", "pos", "kind", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos long, kind string, row long, cells array<string>")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: files under a folder with their category, the folder right under ``path``; ``root`` for those in it itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    base = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    under = F.split(F.element_at(F.split("path", F.concat(F.lit("/"), F.lit(re.escape(base)), F.lit("/")), 2), -1), "/")
    return files.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).withColumn("category", F.when(F.size(under) > 1, under[0]).otherwise("root"))


def env_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: ``key=value`` lines; blank lines, comments and lines without ``=`` go."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#') and contains(v, '=')")
    parts = F.split("v", "=", 2)
    return lines.select(F.trim(parts[0]).alias("key"), F.regexp_replace(F.trim(parts[1]), "^['\"]|['\"]$", "").alias("value"))


def preview(df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """SRC-17: some rows of a table, and how many it has."""
    return df.limit(n), df.count()


def file_preview(spark: SparkSession, path: str, n: int = 100) -> tuple[DataFrame, int]:
    """SRC-17: the first rows of a JSON list, CSV file or workbook in the file's order, and how many records it has.

    A CSV's records are counted, not its lines, so line ends within quotes count once. JSON that is no list is one row.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        from loomsight.operators.delivery import header_rows

        rows = header_rows(workbooks(spark, path), 1, ["path", "sheet"])
        return rows.orderBy("sheet", "row").limit(n).select("cells"), rows.count()
    if kind not in ("csv", "json", "jsonl"):
        raise ValueError(f"no preview of {kind}")
    df = csv_text(spark, path) if kind == "csv" else spark.read.option("multiLine", kind == "json").json(path)
    placed = df.withColumn("__pos", F.monotonically_increasing_id())
    return placed.orderBy("__pos").limit(n).drop("__pos"), df.count()


def comment_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: text of comments in lines, or of a whole ``.json`` array; broken lines go."""
    whole = path.endswith(".json")
    df = spark.read.schema("content string, comment_text string, text string").option("multiLine", whole).option("mode", "DROPMALFORMED").json(path)
    return df.select(F.coalesce(*[S.filled(F.col(c)) for c in ("content", "comment_text", "text")]).alias("content")).where("content is not null")


class _Fields(html.parser.HTMLParser):
    """S-32: elements that carry ``data-field`` JSON, with the text inside them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: list[tuple[str, int | None]] = []

    def handle_starttag(self, tag, attrs):
        field = dict(attrs).get("data-field")
        at = None
        if field is not None:
            try:
                json.loads(field)
                self.found.append([field, ""])
                at = len(self.found) - 1
            except ValueError:
                pass
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.open.append((tag, at))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for _, at in self.open:
            if at is not None:
                self.found[at][1] += data


def page_fields(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """S-32, S-33: a row per element with embedded JSON: ``key, pos, field, text``."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = _Fields()
                p.feed(page or "")
                rows += [(k, i, f, t.strip()) for i, (f, t) in enumerate(p.found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [key, "pos", "field", "text"])

    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, pos long, field string, text string")
