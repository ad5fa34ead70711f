"""Databases, paged REST, downloads, documents and configurations."""

import io
import json
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan, StringContains, StringStartsWith

from panelweft.functions import exprs as X
from panelweft.functions import hooks
from panelweft.operators import verify
from panelweft.plans import queries as library
from panelweft.sources import databases, readers, sinks
from panelweft.streaming import live

ROWS = [(i, None if i % 7 == 0 else f"n{i % 5}'s", i / 4, i % 2 == 0, bytes([i % 256])) for i in range(1000)]


def test_sqlite_there_and_back(spark, tmp_path):
    databases.register(spark)
    df = spark.createDataFrame(ROWS, "id long, `a \"name\"` string, x double, yes boolean, raw binary")
    path = f"file://{tmp_path}/db"
    df.repartition(3).write.format("panelweft_sqlite").option("path", path).option("table", "t").mode("append").save()
    read = lambda rows=150: spark.read.schema(df.schema).format("panelweft_sqlite").option("path", path).option("table", "t").option("rows", rows).load()
    assert sorted(tuple(map(repr, r)) for r in read().collect()) == sorted(tuple(map(repr, r)) for r in df.collect())
    assert read().rdd.getNumPartitions() >= 6
    for where in ("id > 990", "id IN (3, 5) AND x < 1", '`a "name"` = "n3\'s" AND id >= 500', '`a "name"` IS NULL', "startswith(`a \"name\"`, 'n1')", "yes AND id < 9", "id % 2 = 1 AND id < 10", '`a "name"` > "n3"'):
        assert sorted(r["id"] for r in read().filter(where).collect()) == sorted(r["id"] for r in df.filter(where).collect()), where
    df.limit(5).write.format("panelweft_sqlite").option("path", path).option("table", "t").mode("overwrite").save()
    assert read().count() == 5
    assert read().select("x").schema.fieldNames() == ["x"]
    with pytest.raises(Exception, match="no database"):
        spark.read.format("panelweft_sqlite").option("path", f"{tmp_path}/none").option("table", "t").load()


def test_filters_reach_the_database(tmp_path):
    """What is pushed is in the statement that SQLite runs; what isn't stays with Spark."""
    file = tmp_path / "one.sqlite"
    with sqlite3.connect(file) as con:
        con.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"n{i}") for i in range(100)])
    source = databases.Sqlite({"path": str(file), "table": "t", "rows": "30"})
    reader = source.reader(source.schema())
    kept = list(reader.pushFilters([GreaterThan(("id",), 50), LessThan(("id",), 70), In(("name",), ("n60", "n61", "n99")), IsNotNull(("id",)), StringContains(("name",), "6"), EqualTo(("name",), 5), StringStartsWith(("name",), "n6")]))
    assert [type(f) for f in kept] == [StringContains, EqualTo]
    parts = reader.partitions()
    assert len(parts) == 4
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()) == [60, 61]
    with pytest.raises(ValueError, match="not hdfs"):
        databases._databases("hdfs://x/y.sqlite")


def test_pages(spark, tmp_path, monkeypatch):
    databases.register(spark)
    for at in range(0, 40, 10):
        (tmp_path / f"{at}.json").write_text(json.dumps({"records": [{"n": i} for i in range(at, min(at + 10, 35))]}))
    (tmp_path / "35.json").write_text('{"records": []}')
    url = f"file://{tmp_path}/{{offset}}.json"
    got = spark.read.format("panelweft_pages").option("url", url).option("limit", 10).option("total", 35).load()
    assert got.rdd.getNumPartitions() == 4
    assert sorted(r["n"] for r in readers.records(got, "n:bigint").collect()) == list(range(35))
    stream = databases.PagesStream({"url": url, "limit": "10"})
    at, seen = stream.initialOffset(), []
    for _ in range(6):  # the last turns find nothing new, and the offset stays
        rows, end = stream.read(at)
        seen += [r for _, p in rows for r in json.loads(p)["records"]]
        assert list(stream.readBetweenOffsets(at, end)) == list(stream.read(at)[0])
        at = end
    assert [r["n"] for r in seen] == list(range(35)) and at == {"read": 35}
    q = spark.readStream.format("panelweft_pages").option("url", url).option("limit", 10).load().writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("pages").count() == 4:
                break
    finally:
        q.stop()
    assert sorted(r["n"] for r in readers.records(spark.table("pages"), "n:bigint").collect()) == list(range(35))
    tries = []
    monkeypatch.setattr(databases.time, "sleep", tries.append)

    def shaky(u):
        if len(tries) < 2:
            raise OSError("busy")
        return io.BytesIO(b"ok")

    assert databases.fetched({"url": "x"}, 0, shaky) == "ok" and tries == [1, 2]
    with pytest.raises(OSError):
        databases.fetched({"url": "x", "retries": "1"}, 0, lambda u: (_ for _ in ()).throw(OSError("gone")))


def test_sql_functions(spark):
    hooks.register(spark, shout=F.udf(lambda x: x.upper()))
    ts = [0.0, 0.3, -1.96, 2.7, 2.9, 6.0, -12.0, None, float("nan")]
    got = spark.createDataFrame([(t,) for t in ts], "t double").selectExpr("t", "normal_p_value(t) AS p").collect()
    for t, (_, p) in zip(ts, got, strict=True):
        assert p is None if t is None or t != t else p == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), rel=1e-10)
    rows = spark.sql("SELECT * FROM word_chunks('a b  c d e', 2, 1)").collect()
    assert [(r["no"], r["chunk"]) for r in rows] == [(0, "a b"), (1, "b c"), (2, "c d"), (3, "d e")]
    assert spark.sql("SELECT * FROM word_chunks('', 2, 1)").count() == 0 and spark.sql("SELECT shout('x')").first()[0] == "X"
    plan = library.QUERIES["normal_p_values"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_documents_and_excerpts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.md", "# A"), ("_skip.md", "no"), ("sub/b.md", "# B"), ("c.txt", "text")):
        (tmp_path / name).write_text(body)
    got = {r["name"]: r["content"] for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "# A", "b": "# B"}
    table, long = "\n".join(map(str, range(200))), "x" * 6000
    df = spark.createDataFrame([("a.csv", table), ("b.JSON", long), ("c.md", long), ("d.png", "?")], "path string, content string")
    cut = {r["path"]: r["e"] for r in df.select("path", readers.excerpt("path", "content").alias("e")).collect()}
    assert cut["a.csv"].count("\n") == 99 and len(cut["b.JSON"]) == 5000 and cut["c.md"] == long and cut["d.png"] == "[binary file: d.png]"


def test_downloads_configs_and_outputs(spark, tmp_path):
    readers.download(spark, "any://x", f"file://{tmp_path}/got.csv", fetch=lambda url: io.BytesIO(b"a,b\n1,2\n"))
    assert [tuple(r) for r in readers.csv(spark, f"{tmp_path}/got.csv").collect()] == [("1", "2")]
    (tmp_path / "c.yml").write_text("sources:\n- {name: a}\n- {name: b, enabled: false}\n")
    (tmp_path / "c.json").write_text('{"k": 1}')
    config = readers.config(spark, f"{tmp_path}/c.yml")
    assert [s["name"] for s in readers.enabled(config)] == ["a"]
    assert readers.config(spark, f"{tmp_path}/c.json") == {"k": 1} and readers.config(spark, f"{tmp_path}/none.yml") == {}
    names = ["State Name", "Total  Bank-Credit (Rs.)", "other"]
    assert readers.resolve(names, ["x", "state_name"]) == "State Name" and readers.resolve(names, include=("bank", "credit"), exclude=("x",)) == "Total  Bank-Credit (Rs.)" and readers.resolve(names, ["q"]) is None
    assert readers.normal_header(" A-b  (C) ") == "a_b_c"
    assert sinks.key_values({"changed": True, "n": 3}) == "changed=true\nn=3"


def test_character_references(spark):
    cases = {"it&#8217;s": "it’s", "&#x1F600;&#X41;": "😀A", "&amp;lt; &lt;b&gt;": "&lt; <b>", "&#0; &#99999999; &#xD800; &no;": "&#0; &#99999999; &#xD800; &no;", "a&nbsp;&mdash;&#39;&#39;": "a —''", "": ""}
    got = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", X.unescaped("t").alias("u")).collect()
    assert {r["t"]: r["u"] for r in got} == cases | {None: None}


def test_audit_has_packages_and_reasons(spark):
    audit = verify.Audit("p", packages=("pyspark", "no-such-package"))
    df = spark.createDataFrame([(1, None), (2, 5), (-1, None), (-2, 7), (3, 8)], "a int, b int")
    kept = audit.filtered("clean", df, {"negative": F.col("a") < 0, "no_b": F.col("b").isNull(), "never": F.col("a") > 100})
    assert sorted(r["a"] for r in kept.collect()) == [2, 3] and kept.columns == ["a", "b"]
    stage = audit.manifest["stages"][0]
    assert (stage["rows_in"], stage["rows_out"], stage["rows_dropped"], stage["drop_reasons"]) == (5, 2, 3, {"negative": 2, "no_b": 1}) and "accounting_warning" not in stage
    assert list(audit.manifest["environment"]["packages"]) == ["pyspark"]


def test_suppression_and_activity(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text("".join(json.dumps({"k": k, "t": f"2024-01-01T00:{m:02}:{s:02}Z"}) + "\n" for k, m, s in (("a", 0, 0), ("a", 0, 30), ("b", 0, 5), ("a", 59, 0), ("b", 59, 30))))
    stream = spark.readStream.schema("k string, t timestamp").json(str(folder))
    runs = {}
    for name, s, mode in (("kept", live.suppressed(stream, key="k", time="t", seconds=120), "append"), ("acts", live.activity(stream, time="t", by="k"), "complete")):
        q = s.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(200)
        runs[name] = spark.table(name).collect()
    assert {r["k"] for r in runs["kept"]} == {"a", "b"} and len(runs["kept"]) == 2  # within one trigger the watermark stands still
    assert {(r["k"], r["n"]) for r in runs["acts"]} == {("a", 3), ("b", 2)}


def test_csv_with_line_breaks_is_read_in_many_tasks(spark, tmp_path):
    """Cells with breaks, quotes and separators, some longer than a range of bytes: the same as Spark's own reader of whole files."""
    rng = random.Random(6)
    cell = lambda: rng.choice(["plain", "", 'say ""hi""', "two\nlines", "a, b", "x\n\n\ny", "é\n" * rng.randrange(1, 40), '""\n""', "NA"])
    folder = tmp_path / "csv"
    folder.mkdir()
    for k in range(2):
        rows = [f'{i},"{cell()}",{i / 8},"{cell()}"' for i in range(600)]
        rows[300] = f'300,"{"long line" * 30}\n{"more, " * 900}\nend",1.5,"z"'
        (folder / f"{k}.csv").write_text("id,a,x,b\n" + "\n".join(rows) + "\n")
    schema = "id int, a string, x double, b string"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = readers.quoted_csv(spark, str(folder), schema)
        assert got.rdd.getNumPartitions() > 4
        want = readers.csv(spark, str(folder), "id int, a string, x double, b string", multi_line=True)
        key = lambda r: repr(tuple(r))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() == 1200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
