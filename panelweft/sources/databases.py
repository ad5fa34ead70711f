"""SQLite and paged REST as data sources: planned partitions, pushed filters, stream offsets.

register(spark) makes the formats `panelweft_sqlite` and `panelweft_pages` known to a session.
SQLite files are opened where they lie, so their folder has to be one that driver and executors
share as files; a folder of databases is one table, a database a task that wrote it.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from panelweft.session import by_value, ship

#: Rows of one batch that a task reads.
BATCH = 4096


def register(spark: SparkSession) -> None:
    ship(spark)
    by_value(__name__)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Sqlite, Pages):
        spark.dataSource.register(source)


def _local(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"SQLite opens files, not {at.scheme} paths: {path}")
    return unquote(at.path) if at.scheme else path


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def condition(f: Filter) -> tuple[str, list] | None:
    """SQL and its parameters for a filter, or None where SQLite may see it otherwise than Spark."""
    ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    column = _name(".".join(f.attribute)) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    plain = lambda v: isinstance(v, int | float | str) and not isinstance(v, bool)
    if column is None:
        return None
    if type(f) in ops and plain(f.value):
        return f"{column} {ops[type(f)]} ?", [f.value]
    if isinstance(f, In) and all(map(plain, f.value)):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL", []
    if isinstance(f, IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, StringStartsWith) and f.value:
        return f"substr({column}, 1, {len(f.value)}) = ?", [f.value]
    return None


_AFFINITY = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "binary": "BLOB"}


class Sqlite(DataSource):
    """Options: path (a database or a folder of them), table, and rows (of one partition, a million by default)."""

    @classmethod
    def name(cls) -> str:
        return "panelweft_sqlite"

    def schema(self) -> T.StructType:
        files = _databases(self.options["path"])
        if not files:
            raise ValueError(f"no database at {self.options['path']}")
        kinds = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BLOB": T.BinaryType()}
        with _open(files[0]) as con:
            found = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {files[0]}")
        return T.StructType([T.StructField(r[1], kinds.get(r[2].upper(), T.StringType())) for r in found])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SqliteWriter(self.options, schema, overwrite)


def _databases(path: str) -> list[str]:
    at = _local(path)
    return sorted(glob.glob(os.path.join(glob.escape(at), "*.sqlite"))) if os.path.isdir(at) else [at] if os.path.exists(at) else []


@dataclass
class Rows(InputPartition):
    """Rows of one database by rowid, low included, high not (None: no bound)."""

    file: str
    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.table, self.rows, self.schema = options["path"], options["table"], int(options.get("rows", 1_000_000)), schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes the filters that SQL says alike; the others stay Spark's."""
        text = {f.name for f in self.schema.fields if f.dataType == T.StringType()}
        for f in filters:
            # Texts compare by bytes in both; a number against a text column doesn't.
            same = not hasattr(f, "value") or all(isinstance(v, str) == (f.attribute[0] in text) for v in (f.value if isinstance(f, In) else [f.value]))
            said = condition(f) if same else None
            if said is None:
                yield f
            else:
                self.where.append(said[0])
                self.values += said[1]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in _databases(self.path):
            with _open(file) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            if low is None:
                continue
            cuts = list(range(low, high + 1, self.rows))
            out += [Rows(file, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        return out or [Rows("", None, None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        if not partition.file:
            return
        where = [*self.where, *([f"rowid >= {partition.low}"] if partition.low is not None else []), *([f"rowid < {partition.high}"] if partition.high is not None else [])]
        said = f"SELECT {', '.join(_name(f.name) for f in kinds)} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        con = _open(partition.file)
        try:
            got = con.execute(said, self.values)
            while rows := got.fetchmany(BATCH):
                cells = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([None if v is None else bool(v) if pa.types.is_boolean(f.type) else v for v in c], f.type) for c, f in zip(cells, kinds, strict=True)], schema=kinds)
        finally:
            con.close()


@dataclass
class Written(WriterCommitMessage):
    file: str


class SqliteWriter(DataSourceArrowWriter):
    """Each task writes a database of its own beside the others; names count only once the job commits."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.folder, self.table, self.schema, self.overwrite = _local(options["path"]), options["table"], schema, overwrite
        for f in schema.fields:
            if f.dataType.simpleString() not in (*_AFFINITY, "string"):
                raise ValueError(f"SQLite has no type for {f.name}: {f.dataType.simpleString()}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        file = os.path.join(self.folder, f".{uuid.uuid4().hex}.writing")
        con = sqlite3.connect(file)
        columns = ", ".join(f"{_name(f.name)} {_AFFINITY.get(f.dataType.simpleString(), 'TEXT')}" for f in self.schema.fields)
        con.execute(f"CREATE TABLE {_name(self.table)} ({columns})")
        for batch in iterator:
            con.executemany(f"INSERT INTO {_name(self.table)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
        con.commit()
        con.close()
        return Written(file)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        old = _databases(self.folder) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.file, os.path.join(self.folder, os.path.basename(m.file)[1:].replace(".writing", ".sqlite")))
        for file in old:
            os.remove(file)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


@dataclass
class Page(InputPartition):
    offset: int


class Pages(DataSource):
    """A REST source that is read by offset and limit: rows (offset, value), value being a page's payload.

    Options: url with {offset} and {limit}; limit (1,000); total, the number of records, for
    reading in one go (a partition a page); records (the payload's key of its records), for
    streams, whose offset is the number of records read; retries (3).
    """

    @classmethod
    def name(cls) -> str:
        return "panelweft_pages"

    def schema(self) -> str:
        return "offset long, value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagesReader(self.options)

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return PagesStream(self.options)


def fetched(options: dict, offset: int, open_url=urllib.request.urlopen) -> str:
    """A page's payload; a failure is tried again after 1, 2, 4 ... seconds."""
    url, retries = options["url"].replace("{offset}", str(offset)).replace("{limit}", str(options.get("limit", 1000))), int(options.get("retries", 3))
    for k in range(retries + 1):
        try:
            with open_url(url) as stream:
                return stream.read().decode()
        except OSError:
            if k == retries:
                raise
            time.sleep(2**k)
    raise AssertionError


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Page(i) for i in range(0, max(int(self.options["total"]), 1), int(self.options.get("limit", 1000)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.offset, fetched(self.options, partition.offset)


class PagesStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"read": 0}

    def _page(self, at: int) -> tuple[str, int]:
        page = fetched(self.options, at)
        return page, len(json.loads(page).get(self.options.get("records", "records"), []))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page, n = self._page(start["read"])
        return iter([(start["read"], page)] if n else []), {"read": start["read"] + n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        at = start["read"]
        while at < end["read"]:
            page, n = self._page(at)
            yield at, page
            at += n
