"""Writers: atomic publication with history, envelopes, snapshots by bucket type, stores by name."""

from __future__ import annotations

import io
import uuid
import zipfile
from functools import reduce
from itertools import chain
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share; one of this machine only if all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named or 'file:///tmp/checkpoints'}/loomsight/files-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def _rename(df: DataFrame, source: str, target: str) -> None:
    """Puts a folder in another's place; the one that was there steps aside first and goes last."""
    hadoop, conf = _hadoop(df.sparkSession)
    old, aside = hadoop.Path(target), hadoop.Path(f"{target.rstrip('/')}.{uuid.uuid4().hex}")
    fs = old.getFileSystem(conf)
    was = fs.exists(old) and fs.rename(old, aside)
    if not fs.rename(hadoop.Path(source), old):
        if was:
            fs.rename(aside, old)
        raise OSError(f"cannot rename {source} to {target}")
    if was:
        fs.delete(aside, True)


def publish(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """SNK-01 of a folder: written beside and renamed, so readers never see a part of a table. Between the two renames
    there is none for a moment; readers that must not see that use ``publish_version``."""
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(beside)
    _rename(df, beside, path)


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """One file in another's place, in a single step."""
    hadoop, conf = _hadoop(spark)
    to = hadoop.Path(target)
    context = hadoop.FileContext.getFileContext(to.getFileSystem(conf).getUri(), conf)
    over = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(hadoop.Path(source), to, over)


def publish_file(df: DataFrame, path: str, kind: str, **options) -> None:
    """SNK-01: one file for other systems, replaced in a single step: readers see the old or the new one."""
    spark = df.sparkSession
    hadoop, conf = _hadoop(spark)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.coalesce(1).write.format(kind).options(**options).save(beside)
    at = hadoop.Path(beside)
    fs = at.getFileSystem(conf)
    part = next(str(f.getPath()) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    if fs.exists(hadoop.Path(path)) and fs.getFileStatus(hadoop.Path(path)).isDirectory():
        fs.delete(hadoop.Path(path), True)
    _replace(spark, part, path)
    fs.delete(at, True)


def publish_version(df: DataFrame, root: str, version: str) -> None:
    """SNK-01 of a table of any size: a version of its own, then the file ``CURRENT`` that names it is replaced in a
    single step. Writing a version again replaces it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/versions/{version}")
    publish_file(spark.createDataFrame([(version,)], "value string"), f"{root}/CURRENT", "text")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that ``CURRENT`` names."""
    return spark.read.parquet(f"{root}/versions/{spark.read.text(f'{root}/CURRENT').first().value}")


def _flat(df: DataFrame) -> list:
    return [F.coalesce((F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")), F.lit("")).alias(c) for c, t in df.dtypes]


def flat(df: DataFrame) -> DataFrame:
    """PRJ-06, SNK-01: arrays, maps and structs as JSON text, nulls as empty text."""
    return df.select(*_flat(df))


def export(df: DataFrame, root: str, run_id: str) -> DataFrame:
    """SNK-02: history of this run, then the current table; returns the manifest row. A run that is repeated replaces its
    own history."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/history")
    publish(df, f"{root}/current")
    return df.sparkSession.read.parquet(f"{root}/current").agg(F.lit(run_id).alias("run_id"), F.count("*").alias("row_count"))


def envelope(df: DataFrame, name: str = "results", **meta: str) -> DataFrame:
    """SNK-03, SNK-04, PRJ-05: one JSON document of a task's rows, which are few."""
    return df.agg(F.collect_list(F.struct("*")).alias(name), F.count("*").alias("count")).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], "count", name)).alias("value"))


def envelopes(df: DataFrame, by: list[str], order: list[str], name: str = "trend_signals") -> DataFrame:
    """SNK-03: a JSON document for each task, ``by`` and ``value``; a document has one task's rows, in ``order``."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("__row")))), lambda x: x["__row"])
    return df.groupBy(*by).agg(F.count("*").alias("count"), rows.alias(name)).select(*by, F.to_json(F.struct(*by, "count", name)).alias("value"))


def snapshot(df: DataFrame, path: str, by: str = "bucket_type") -> None:
    """SNK-05: replaces the partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _delivered(df: DataFrame) -> DataFrame:
    first, *rest = df.columns
    return flat(df).toDF("\ufeff" + first, *rest)


def delivery_csv(df: DataFrame, path: str) -> None:
    """SNK-06: one CSV table with header and byte-order mark in its first name, as one file, which one task writes."""
    publish_file(_delivered(df), path, "csv", header="true", escape="\"")


def delivery_parts(df: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """SNK-06 of a table of any size: a folder of such files of at most ``rows`` rows, each task its own."""
    publish(_delivered(df), path, "csv", header="true", escape="\"", maxRecordsPerFile=rows)


def markdown(profile: DataFrame) -> str:
    """SNK-07: a report table, all its rows; a profile has a row for each table or column."""
    rows = profile.toLocalIterator()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(profile.columns), line(["---"] * len(profile.columns)), *map(line, rows)])


#: SNK-08: formats by store name.
STORES = {"csv": "csv", "json": "json", "jsonl": "json", "db": "parquet", "postgres": "parquet", "sqlite": "parquet", "mongodb": "parquet", "excel": "csv"}


def store(df: DataFrame, root: str, platform: str, kind: str, item: str, date: str) -> str:
    """SNK-08, SNK-09, SNK-15: appends to the place of platform, format, item type and date."""
    if kind not in STORES:
        raise ValueError(f"unknown store {kind}; one of {', '.join(STORES)}")
    path = f"{root}/{platform}/{kind}/{item}_{date}"
    (flat(df) if STORES[kind] == "csv" else df).write.mode("append").format(STORES[kind]).options(**({"header": "true"} if STORES[kind] == "csv" else {})).save(path)
    return path


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-22."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in tables.items()])


def field_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-12: the new side's fields where they are set, else the old's."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    pickd = lambda c: F.coalesce(*[F.col(f"{t}.{c}") for t, df in (("b", new), ("a", old)) if c in df.columns]).alias(c)
    return joined.select(*[pickd(c) for c in names])




def workbook(sheets: dict[str, DataFrame], most: int = 5) -> bytes:
    """SNK-13: a workbook of up to ``most`` sheets with bold headers, as an exporter for people; empty sheets are left out.

    Arrays, maps and structs are JSON text. The rows pass the driver one by one; the format itself ends at 1,048,576 a sheet.
    """
    out, names = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in sheets.items():
            rows = flat(df).toLocalIterator()
            first = next(rows, None)
            if first is None or len(names) == most:
                continue
            names.append(name[:31])
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for k, row in enumerate(chain([df.columns, first], rows)):
                    cells = "".join(f'<c t="inlineStr" s="{int(k == 0)}"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in row)
                    f.write(f"<row>{cells}</row>".encode())
                f.write(b"</sheetData></worksheet>")
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        numbered = list(enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in numbered) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in numbered) + f'<Relationship Id="s" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="b" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k, _ in numbered) + "</Types>")
    return out.getvalue()


def media(df: DataFrame, root: str, platform: str) -> DataFrame:
    """SNK-14: bytes as a table by platform and kind, ``id, file, content``, which any shared store can hold; returns places."""
    at = f"{root}/{platform}/media"
    df.select("kind", "id", "file", "content").write.mode("append").partitionBy("kind").parquet(at)
    return df.select(F.concat_ws("/", F.lit(at), F.concat(F.lit("kind="), "kind"), "id", "file").alias("place"))


#: Rows that a sheet of the format has beside its header.
SHEET_ROWS = 1_048_575


def workbooks(df: DataFrame, root: str, by: list[str], order: str, most: int = SHEET_ROWS) -> DataFrame:
    """SNK-13: a workbook for each group of ``by``, written by tasks; of a group with more than ``most`` rows several, in order.

    Arrays, maps and structs are JSON text. Returns ``by``, ``part``, ``path`` and ``n_rows`` of the files that are there.
    Rows are numbered over the whole table first, so a file's rows are a stretch of the order and no task holds more.
    """
    from loomsight.operators.sampling import numbered
    from loomsight.sources.paged import _write

    names = [c for c in df.columns if c not in by]
    placed = numbered(df.select(*_flat(df.select(*by, *names)), F.col(order).alias("__order")), *by, "__order")
    first = placed.groupBy(*by).agg(F.min("__n").alias("__first"))
    parts = placed.join(first, by).withColumn("part", F.floor((F.col("__n") - F.col("__first")) / most).cast("int"))

    def write(key, table):
        import pyarrow as pa

        rows = table.sort_by("__n")
        columns = [rows.column(c).to_pylist() for c in names]
        path = "/".join([root.rstrip("/"), *(f"{c}={str(v.as_py()).replace('/', '_')}" for c, v in zip(by, key)), f"part-{key[-1].as_py():05d}.xlsx"])
        _write(path, sheet_bytes("rows", names, zip(*columns)))
        return pa.table({**{c: [v.as_py()] for c, v in zip(by, key)}, "part": pa.array([key[-1].as_py()], pa.int32()), "path": [path], "n_rows": pa.array([rows.num_rows], pa.int64())})

    return parts.groupBy(*by, "part").applyInArrow(write, ", ".join(f"`{c}` string" for c in by) + ", part int, path string, n_rows long")


def sheet_bytes(name: str, header: list[str], rows) -> bytes:
    """A workbook of one sheet with a bold header, cells as text."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {main}><sheetData>".encode())
            for k, row in enumerate(chain([header], rows)):
                cells = "".join(f'<c t="inlineStr" s="{int(k == 0)}"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in row)
                f.write(f"<row>{cells}</row>".encode())
            f.write(b"</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="{escape(name[:31])}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="s" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="b" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
    return out.getvalue()
