"""Data sources of their own kind: pages behind a cursor, and stores whose files the tasks write.

``register`` makes the formats known to a session:

* ``pages`` reads a source that hands out rows page by page. Partitions are runs of cursors, read in parallel; equality
  filters go with the request, columns that are not asked for are never parsed into rows, and ``limit`` ends the scan at
  the page that completes it. As a stream its offset is the cursor.
* ``sqlite`` and ``json_array`` write one file for each partition, by the tasks; the driver then names them in a manifest in
  a single step. A run that fails leaves the manifest, and so what readers see, as it was. Reading is a partition a file,
  for sqlite with the filters in its ``where``.

Folders are what ``pyarrow.fs`` can open: local and shared paths, and the stores it knows by their scheme. sqlite files are
built in the task's temporary folder and then copied.
"""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(path: str, raw: bytes) -> None:
    """A file in a single step: written beside, then moved."""
    store, at = _fs(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    beside = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as f:
        f.write(raw)
    store.move(beside, at)


def _bytes(path: str) -> bytes:
    store, at = _fs(path)
    with store.open_input_stream(at) as f:
        return f.read()


def _names(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _fs(path)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File)


def _typed(value, kind: T.DataType):
    """A JSON or SQL value as Spark wants it."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _typed(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return value


def _plain(value):
    """A row's value as JSON has it."""
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


# --- pages


class Pages:
    """What a paged source is asked: here a folder with a JSON document a page, ``<cursor>.json``, with ``items``, ``cursor``
    of the next page and ``has_more``. Another source needs these two methods, and a name to ``PAGERS``."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def cursors(self) -> list[int]:
        """The cursors that there are, in order."""
        return sorted(int(n[:-5]) for n in _names(self.path) if n.endswith(".json") and n[:-5].isdigit())

    def fetch(self, cursor: int, where: dict[str, object]) -> tuple[list[dict], int | None]:
        """A page's items that meet ``where``, and the next cursor, None after the last."""
        page = json.loads(_bytes(f"{self.path}/{cursor:08d}.json"))
        items = page["items"]
        if where:
            items = [x for x in items if all(x.get(k) == v for k, v in where.items())]
        return items, page["cursor"] if page["has_more"] else None


PAGERS = {"folder": Pages}


@dataclass
class Run(InputPartition):
    """Cursors of one task, and how many rows it may give."""

    cursors: list[int]
    most: int | None = None


class PagesReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.where: dict[str, object] = {}

    def pushFilters(self, filters):
        """Equality with a plain value goes with the request; the rest stays with Spark."""
        kinds = (T.StringType, T.LongType, T.IntegerType, T.BooleanType)
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(self.schema[f.attribute[0]].dataType, kinds) and "limit" not in self.options:
                self.where[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Run]:
        cursors, span = PAGERS[self.options.get("pager", "folder")](self.options).cursors(), int(self.options.get("span", 8))
        if "limit" not in self.options:
            return [Run(cursors[k : k + span]) for k in range(0, len(cursors), span)] or [Run([])]
        # pages but the last have ``page_size`` rows, so the limit is told before any is read
        most, size = int(self.options["limit"]), int(self.options["page_size"])
        cursors = cursors[: -(-most // size)]
        return [Run(cursors[k : k + span], most - k * size) for k in range(0, len(cursors), span)] or [Run([])]

    def read(self, partition: Run) -> Iterator[tuple]:
        pager, left = PAGERS[self.options.get("pager", "folder")](self.options), partition.most
        for cursor in partition.cursors:
            items, _ = pager.fetch(cursor, self.where)
            for item in items if left is None else items[:left]:
                yield tuple(_typed(item.get(f.name), f.dataType) for f in self.schema.fields)
            if left is not None and (left := left - len(items)) <= 0:
                return


class PagesStream(DataSourceStreamReader):
    """Pages as they come: the offset is the cursor after the last page read."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.inner = PagesReader(schema, {k: v for k, v in options.items() if k != "limit"})
        self.options = options

    def _pager(self) -> Pages:
        return PAGERS[self.options.get("pager", "folder")](self.options)

    def initialOffset(self) -> dict:
        return {"cursor": int(self.options.get("from", 0))}

    def latestOffset(self) -> dict:
        cursors = self._pager().cursors()
        return {"cursor": max(cursors) + 1 if cursors else int(self.options.get("from", 0))}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        cursors, span = [c for c in self._pager().cursors() if start["cursor"] <= c < end["cursor"]], int(self.options.get("span", 8))
        return [Run(cursors[k : k + span]) for k in range(0, len(cursors), span)]

    def read(self, partition: Run) -> Iterator[tuple]:
        return self.inner.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PagesSource(DataSource):
    """SRC-19: ``spark.read.format("pages").schema(...).option("limit", n).option("page_size", m).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self):
        raise ValueError("pages are read with a schema: .schema(...)")

    def reader(self, schema: T.StructType) -> PagesReader:
        return PagesReader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> PagesStream:
        return PagesStream(schema, dict(self.options))


# --- stores


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int


def manifest(path: str) -> dict:
    """Files and schema of a store; none before its first commit."""
    try:
        return json.loads(_bytes(f"{path}/MANIFEST"))
    except FileNotFoundError:
        return {"files": [], "schema": None}


def _sql_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "integer"
    return "real" if isinstance(kind, (T.DoubleType, T.FloatType)) else "text"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sql_value(value):
    value = _plain(value)
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else int(value) if isinstance(value, bool) else value


class StoreWriter(DataSourceWriter):
    """Files by the tasks, one for each; visible once the driver has named them."""

    def __init__(self, kind: str, path: str, schema: T.StructType, overwrite: bool):
        self.kind, self.path, self.schema, self.overwrite = kind, path, schema, overwrite
        self.run = uuid.uuid4().hex

    def _sqlite(self, rows) -> tuple[bytes, int]:
        names = self.schema.names
        with tempfile.TemporaryDirectory() as at:
            con = sqlite3.connect(f"{at}/part")
            con.execute(f"create table rows ({', '.join(f'{_quoted(f.name)} {_sql_type(f.dataType)}' for f in self.schema.fields)})")
            con.executemany(f"insert into rows values ({', '.join('?' * len(names))})", ([_sql_value(v.asDict(True) if hasattr(v, "asDict") else v) for v in r] for r in rows))
            n = con.execute("select count(*) from rows").fetchone()[0]
            con.commit()
            con.close()
            with open(f"{at}/part", "rb") as f:
                return f.read(), n

    def _json(self, rows) -> tuple[bytes, int]:
        lines = [json.dumps(_plain(r.asDict(True)), ensure_ascii=False) for r in rows]
        return ("[" + ",\n".join(lines) + "]").encode(), len(lines)

    def write(self, iterator) -> Part:
        raw, n = (self._sqlite if self.kind == "sqlite" else self._json)(iterator)
        file = f"part-{self.run}-{uuid.uuid4().hex}.{'sqlite' if self.kind == 'sqlite' else 'json'}"
        if n:
            _write(f"{self.path}/{file}", raw)
        return Part(file, n)

    def commit(self, messages) -> None:
        was = manifest(self.path)
        if was["schema"] and not self.overwrite and T.StructType.fromJson(was["schema"]) != self.schema:
            raise ValueError("rows of another schema cannot be appended")
        files = [m.file for m in messages if m is not None and m.rows]
        _write(f"{self.path}/MANIFEST", json.dumps({"files": files if self.overwrite else was["files"] + files, "schema": self.schema.jsonValue()}).encode())

    def abort(self, messages) -> None:
        store, at = _fs(self.path)
        for name in _names(self.path):
            if name.startswith(f"part-{self.run}-"):
                store.delete_file(f"{at}/{name}")


@dataclass
class File(InputPartition):
    name: str


class StoreReader(DataSourceReader):
    def __init__(self, kind: str, path: str, schema: T.StructType):
        self.kind, self.path, self.schema = kind, path, schema
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        kinds = (T.StringType, T.IntegralType)
        for f in filters:
            if self.kind == "sqlite" and isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(self.schema[f.attribute[0]].dataType, kinds):
                self.where.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[File]:
        return [File(f) for f in manifest(self.path)["files"]] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.name:
            return
        raw = _bytes(f"{self.path}/{partition.name}")
        fields = self.schema.fields
        if self.kind == "json_array":
            for item in json.loads(raw):
                yield tuple(_typed(item.get(f.name), f.dataType) for f in fields)
            return
        nested = (T.StructType, T.ArrayType, T.MapType)
        con = sqlite3.connect(":memory:")
        con.deserialize(raw)
        where = " and ".join(f"{_quoted(c)} = ?" for c, _ in self.where)
        rows = con.execute(f"select {', '.join(_quoted(f.name) for f in fields)} from rows{' where ' + where if where else ''}", [v for _, v in self.where])
        for row in rows:
            yield tuple(_typed(json.loads(v) if v is not None and isinstance(f.dataType, nested) else v, f.dataType) for v, f in zip(row, fields))
        con.close()


class _Store(DataSource):
    KIND = ""

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> T.StructType:
        held = manifest(self.options["path"])["schema"]
        if held is None:
            raise ValueError(f"no store at {self.options['path']}")
        return T.StructType.fromJson(held)

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(self.KIND, self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.KIND, self.options["path"], schema, overwrite)


class SqliteStore(_Store):
    """SNK-08, SNK-15, SRC-15: ``df.write.format("sqlite").mode("append").save(folder)``, and ``read`` of the same."""

    KIND = "sqlite"


class JsonArrayStore(_Store):
    """SNK-09: JSON arrays, one file a partition."""

    KIND = "json_array"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PagesSource, SqliteStore, JsonArrayStore):
        spark.dataSource.register(source)


def write_pages(df, folder: str, order: str, page_size: int) -> None:
    """A table as such pages, for sources that are mirrored and for tests: page ``k`` has the rows from ``k * page_size`` on.

    Rows are numbered by ranges, and each task writes whole pages; a page is a group of ``page_size`` rows.
    """
    from pyspark.sql import functions as F

    from loomsight.operators.sampling import numbered

    placed = numbered(df, order)
    last = placed.agg(F.max("__n")).first()[0]
    if last is None:
        return
    final = last // page_size

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["__n"])
        page = rows[0]["__n"] // page_size
        items = [{k: _plain(v) for k, v in r.items() if k not in ("__n", "__page")} for r in rows]
        _write(f"{folder}/{page:08d}.json", json.dumps({"items": items, "cursor": page + 1, "has_more": page < final}, ensure_ascii=False).encode())
        return pa.table({"page": pa.array([page], pa.int64())})

    paged = placed.withColumn("__page", F.floor(F.col("__n") / page_size))
    if paged.groupBy("__page").applyInArrow(write, "page long").count() != final + 1:
        raise OSError("pages are missing")


def mongo_find(spark: SparkSession, folder: str, limit: int | None = None, sort: str | None = None, skip: int = 0, **equal):
    """SRC-16: rows of a JSON array store by equality, in order, from ``skip`` on, ``limit`` at most."""
    from pyspark.sql import functions as F

    df = spark.read.format("json_array").load(folder)
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    if sort:
        df = df.orderBy(F.desc(sort[1:]) if sort.startswith("-") else F.asc(sort))
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)
