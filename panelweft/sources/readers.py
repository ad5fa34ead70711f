"""Readers: typed files, payload parsers, feeds, document folders."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweft.functions.exprs import parse_time, short_id, strip_tags, to_number, unescaped
from panelweft.session import ship

#: What a cell without a value may hold.
NA_TEXT = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A")

#: Bytes a core up to which a table of few files is dealt over the cores.
CORE_BYTES = 32 << 20


def csv(spark: SparkSession, path, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A headed CSV as text columns (or by schema), missing-value marks as null; only the columns asked for are parsed.

    multi_line is for cells with line breaks: such a file can't be split, so one task reads it.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    df = df.select(*[c for c in df.columns if columns is None or c in columns])
    text = [f.name for f in df.schema.fields if f.dataType == T.StringType()]
    return df.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(*NA_TEXT), F.col(f"`{c}`")) for c in text}) if text else df


def quoted_csv(spark: SparkSession, path: str, schema: T.StructType | str, *, has_header: bool = True) -> DataFrame:
    """A CSV whose quoted cells may hold line breaks, read in as many tasks as its size asks for; cells are typed by schema, marks of no value are null.

    Tasks read ranges of bytes line by line.  Whether a line begins inside a quoted cell is told
    by the number of quotes before it: a pass counts each range's, and their sums over the
    ranges before, a row a range, are handed to the pass that parses.  Records of one line are
    parsed where they are read, and only the lines of longer ones meet in a shuffle.  A quote in
    a cell is doubled; line breaks are read as \\n; each file has a header, which is its first record.
    """
    ship(spark)
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    ranges = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")).collect()  # a row a range
    inside, before = {}, {}
    for r in sorted(ranges, key=lambda r: (r["file"], r["start"])):
        inside[r["file"], r["start"]] = before.get(r["file"], 0)
        before[r["file"]] = (before.get(r["file"], 0) + r["odd"]) % 2
    shared = spark.sparkContext.broadcast(inside)  # 128 MB of input are a range, and some bytes here

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, open_, no, record = None, 0, 0, 0
        for batch in batches:
            odd = np.asarray(pc.bit_wise_and(pc.count_substring(batch.column(0), '"'), 1))
            files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n = len(odd)
            whole, of, line = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k in range(n):
                if (files[k], starts[k]) != at:
                    at = files[k], starts[k]
                    open_, no, record = shared.value[at], 0, -1
                if not open_:
                    record = no  # the line that its record begins with; -1: in a range before
                whole[k] = not open_ and not odd[k]
                of[k], line[k] = record, no
                open_ ^= int(odd[k])
                no += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole), pa.array(of), pa.array(line)], ["value", "file", "start", "whole", "record", "line"])

    read = lines.mapInArrow(run, "value string, file string, start long, whole boolean, record long, line long")
    one = read.filter("whole").select("value", "file", "start", "line")
    # A record that began in a range before belongs to the last one that began there.
    part = read.filter("NOT whole")
    begun = part.filter("record >= 0").groupBy("file", "start").agg(F.max("record").alias("last"))
    heads = part.select("file", "start").distinct().join(begun, ["file", "start"], "left").withColumn("from", F.last(F.when(F.col("last").isNotNull(), F.struct("start", "last")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)))
    placed = part.join(heads, ["file", "start"]).withColumn("own", F.when(F.col("record") >= 0, F.struct("start", F.col("record").alias("last"))).otherwise(F.col("from")))
    many = placed.groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("start", "line", "value"))).alias("x")).select(F.array_join("x.value", "\n").alias("value"), "file", F.col("own.start").alias("start"), F.col("own.last").alias("line"))
    records = one.unionByName(many)
    if has_header:
        records = records.filter("NOT (start = 0 AND line = 0)")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds.fields])
    cells = records.filter("trim(value) <> ''").select(F.from_csv("value", text.simpleString()[len("struct<") : -1].replace(":", " "), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
    return cells.select(*[F.when(~F.trim(F.col(f"`{f.name}`")).isin(*NA_TEXT), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in kinds.fields])


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, dealt over all cores if its files are fewer than these and small.

    A file of one row group is read by one task however many cores there are.  Such a table is at
    most a partition's bytes a core, so dealing it out costs little; any other is left as it lies.
    """
    df, sc = spark.read.parquet(path), spark.sparkContext
    cores, at = sc.defaultParallelism, sc._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(at, True)
    n = size = 0
    while n < cores and listed.hasNext():  # as many files as cores tell enough of a table of any size
        f = listed.next()
        if not f.getPath().getName().startswith(("_", ".")):
            n, size = n + 1, size + f.getLen()
    return df.repartition(cores) if 0 < n < cores and size <= cores * CORE_BYTES else df


def jsonl(spark: SparkSession, path, schema: T.StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones fail or (tolerant) are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def or_empty(spark: SparkSession, path: str, schema: T.StructType | str, read) -> DataFrame:
    """read(path), or an empty frame where nothing is there."""
    return read(path) if exists(spark, path) else spark.createDataFrame([], schema)


def first_of(readers: Sequence) -> DataFrame:
    """The first reader that gives rows: an ordered chain of fallbacks."""
    failed = []
    for read in readers:
        try:
            df = read()
            if not df.isEmpty():
                return df
        except Exception as e:  # the next source may do
            failed.append(str(e))
    raise ValueError(f"no source gave rows: {failed}")


def excel(spark: SparkSession, path: str, sheet) -> DataFrame:
    """A sheet by way of pandas, which needs openpyxl."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet).astype(str))


def indicator_payloads(raw: DataFrame, column: str = "value") -> DataFrame:
    """World Bank pages [meta, [{...}]] as rows; an error page (one element) gives none."""
    item = "struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,countryiso3code:string,date:string,value:double>"
    body = F.from_json(F.get_json_object(column, "$[1]"), f"array<{item}>")
    return raw.select(F.explode(body).alias("r")).select(F.col("r.indicator.id").alias("indicator_code"), F.col("r.indicator.value").alias("indicator_name"), F.col("r.countryiso3code").alias("iso3c"), F.col("r.country.value").alias("country_name"), to_number("r.date").cast("int").alias("year"), F.col("r.value").alias("value")).filter("iso3c IS NOT NULL AND iso3c <> ''")


def country_payloads(raw: DataFrame, column: str = "value") -> DataFrame:
    """Country lists (nested names, capital and coordinates as arrays) as rows."""
    item = "struct<cca3:string,name:struct<common:string,official:string>,region:string,subregion:string,population:bigint,independent:boolean,capital:array<string>,latlng:array<double>>"
    r = raw.select(F.explode(F.from_json(column, f"array<{item}>")).alias("r"))
    return r.select(F.col("r.cca3").alias("iso3c"), F.col("r.name.common").alias("country_name"), F.col("r.name.official").alias("country_official_name"), "r.region", "r.subregion", "r.population", "r.independent", F.get("r.capital", 0).alias("capital"), F.get("r.latlng", 0).alias("lat"), F.get("r.latlng", 1).alias("lon")).filter("iso3c IS NOT NULL")


def country_pages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Pages {data: {objects: [...]}} of a country list, as rows."""
    item = "struct<codes:struct<alpha_3:string>,names:struct<common:string,official:string>,region:string,subregion:string,population:bigint,capitals:array<struct<name:string>>,coordinates:struct<lat:double,lng:double>>"
    r = raw.select(F.explode(F.from_json(F.get_json_object(column, "$.data.objects"), f"array<{item}>")).alias("r"))
    return r.select(F.col("r.codes.alpha_3").alias("iso3c"), F.col("r.names.common").alias("country_name"), F.col("r.names.official").alias("country_official_name"), "r.region", "r.subregion", "r.population", F.get("r.capitals", 0)["name"].alias("capital"), F.col("r.coordinates.lat").alias("lat"), F.col("r.coordinates.lng").alias("lon")).filter("iso3c IS NOT NULL")


def wb_country_payloads(raw: DataFrame, column: str = "value") -> DataFrame:
    """World Bank country lists; aggregates (ids that begin with X) are left out."""
    item = "struct<id:string,iso2Code:string,name:string,region:struct<value:string>,capitalCity:string,latitude:string,longitude:string>"
    r = raw.select(F.explode(F.from_json(F.get_json_object(column, "$[1]"), f"array<{item}>")).alias("r"))
    return r.filter(~F.col("r.iso2Code").startswith("X")).select(F.col("r.id").alias("iso3c"), F.col("r.name").alias("country_name"), F.col("r.region.value").alias("region"), F.col("r.capitalCity").alias("capital"), to_number("r.latitude").alias("lat"), to_number("r.longitude").alias("lon"))


def feed_entries(raw: DataFrame, column: str = "value", *, source: str = "source_id", most: int = 30) -> DataFrame:
    """RSS items and Atom entries: id, title, summary, url, published_at; at most so many a feed, in order."""
    item = F.regexp_extract_all(column, F.lit(r"(?s)<(?:\w+:)?(?:item|entry)\b.*?</(?:\w+:)?(?:item|entry)>"), F.lit(0))
    one = raw.select(source, F.posexplode(F.slice(item, 1, most)).alias("ordinal", "x"))

    def tag(*names):
        got = F.lit("")
        for n in reversed(names):
            v = F.regexp_extract("x", rf"(?s)<(?:\w+:)?{n}\b[^>]*>(.*?)</(?:\w+:)?{n}>", 1)
            got = F.when(v != "", v).otherwise(got)
        got = F.regexp_replace(got, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        return unescaped(got)

    link = F.trim(tag("link"))
    href = F.regexp_extract("x", r"<(?:\w+:)?link\b(?![^>]*rel=[\"'](?:self|edit|enclosure)[\"'])[^>]*href=[\"']([^\"']+)[\"']", 1)
    out = one.select(source, "ordinal", strip_tags(tag("title")).alias("title"), strip_tags(tag("description", "summary", "content")).alias("summary"), F.when(link != "", link).otherwise(href).alias("url"), parse_time(tag("pubDate", "published", "updated", "date")).alias("published_at"))
    return out.filter("title <> '' AND url <> ''").withColumn("article_id", short_id("url", "title"))


def search_feed_url(query, base: str = "https://news.google.com/rss/search?q=", suffix: str = "&hl=en"):
    return F.concat(F.lit(base), F.url_encode(query), F.lit(suffix))


def documents(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Files under a folder, a row each: path, name, content; names that begin with _ are skipped."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return df.withColumn("name", name).filter(~F.col("name").startswith("_"))


def excerpt(path: str, content: str):
    """What is read of a file by its kind: the first 100 lines of a table, 5,000 characters of JSON, all of a text, else a mark."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "txt", "html", "yml", "yaml"), F.col(content)).when(ext == "csv", F.array_join(F.slice(F.split(content, "\n"), 1, 100), "\n")).when(ext == "json", F.substring(content, 1, 5000)).otherwise(F.concat(F.lit("[binary file: "), F.col(path), F.lit("]")))


def digests(spark: SparkSession, path: str, piece: int = 1 << 20) -> DataFrame:
    """(path, sha256, length) of every file under path that isn't empty (Spark lists no others), read in pieces where it is: files of any size."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            sums = []
            for uri in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(uri) if not uri.startswith("file:") else (fs.LocalFileSystem(), "/" + unquote(uri[len("file:") :]).lstrip("/"))
                h = hashlib.sha256()
                with system.open_input_stream(at, compression=None) as f:
                    while block := f.read(piece):
                        h.update(block)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string()), batch.column(1)], ["path", "sha256", "length"])

    return files.mapInArrow(run, "path string, sha256 string, length long")


SIDECAR = "original_name string, tags array<string>, title string, category string, source string, compiled boolean"


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, SIDECAR) of the files <name>.meta.yml or <name>.meta.json under path: path is the file that they are about.

    A name that the sidecar doesn't give is the file's; YAML needs PyYAML on the executors.
    """
    ship(spark)
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.{yml,yaml,json}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value")

    def run(batches):
        import pyarrow as pa
        import yaml

        for batch in batches:
            bodies = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                meta = json.loads(text or "{}") if at.endswith(".json") else yaml.safe_load(text or "")
                bodies.append(json.dumps(meta if isinstance(meta, dict) else {}, default=str))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], ["at", "body"])

    about = F.regexp_replace("at", r"\.meta\.(yml|yaml|json)$", "")
    m = texts.mapInArrow(run, "at string, body string").select(about.alias("path"), F.from_json("body", SIDECAR).alias("m")).select("path", "m.*")
    return m.withColumn("original_name", F.coalesce("original_name", F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)))).withColumn("compiled", F.coalesce("compiled", F.lit(False)))


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """Files with digest and size, and from the sidecars beside them tags, title and whether they are compiled; sidecars aren't files."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = digests(spark, path).filter(~F.col("path").rlike(r"\.meta\.(yml|yaml|json)$")).select(name.alias("original_name"), "path", "sha256", F.col("length").alias("size_bytes"), F.current_timestamp().alias("ingested_at"))
    side = sidecars(spark, path).select("path", "tags", "title", "compiled")
    return files.join(side, "path", "left").select(*files.columns, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "title", F.coalesce("compiled", F.lit(False)).alias("compiled"))


def download(spark: SparkSession, url: str, target: str, fetch=None) -> str:
    """Bytes of a URL written to the shared file system, where every executor can read them; fetch(url) gives a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        with (fetch or urllib.request.urlopen)(url) as stream:
            while block := stream.read(1 << 20):
                out.write(bytearray(block))
    finally:
        out.close()
    return target


def paged(spark: SparkSession, n_rows: int, fetch, limit: int = 1000) -> DataFrame:
    """(offset, value): payloads of a REST source, a page each; fetch(offset, limit) runs on the executors."""
    pages = spark.range(0, max(1, -(-n_rows // limit))).select((F.col("id") * limit).alias("offset"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fetch(i, limit) for i in batch.column(0).to_pylist()], pa.string())], ["offset", "value"])

    return pages.repartition(max(1, min(200, -(-n_rows // limit)))).mapInArrow(run, "offset long, value string")


def records(raw: DataFrame, schema: str, column: str = "value", key: str = "records") -> DataFrame:
    """Rows of paged payloads {key: [{...}]}; a page without them gives none."""
    return raw.select(F.explode(F.from_json(F.get_json_object(column, f"$.{key}"), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def table(spark: SparkSession, name: str, jdbc: str | None = None, **options) -> DataFrame:
    """A catalog table, or a table or query of a database by JDBC; its partitioning is in the options."""
    return spark.read.format("jdbc").options(url=jdbc, dbtable=name, **options).load() if jdbc else spark.table(name)


def config(spark: SparkSession, path: str) -> dict:
    """A JSON (or, with PyYAML, YAML) configuration; an empty or missing file is an empty one."""
    if not exists(spark, path):
        return {}
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    if path.endswith(".json"):
        return json.loads(text or "{}")
    import yaml

    return yaml.safe_load(text) or {}


def normal_header(name: str) -> str:
    """A header's letters and digits in lower case, by underscores."""
    return "_".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def resolve(columns: Sequence[str], candidates: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> str | None:
    """The first column that is a candidate, else the first that has all tokens of include and none of exclude."""
    by = {normal_header(c): c for c in columns}
    for c in candidates:
        if normal_header(c) in by:
            return by[normal_header(c)]
    for n, c in by.items():
        if include and all(t in n for t in include) and not any(t in n for t in exclude):
            return c
    return None


def enabled(config: dict, key: str = "sources") -> list[dict]:
    return [s for s in config.get(key, []) if s.get("enabled", True)]
