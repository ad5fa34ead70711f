"""Further queries: sources, sinks, expressions, knowledge base, views, change detection, surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweft.functions import exprs as X
from panelweft.functions import hooks
from panelweft.functions import stats as S
from panelweft.operators import changes, econometrics, knowledge, panel, spatial, survey, text, verify, views
from panelweft.plans import tracks
from panelweft.plans.queries import _ELIG, _NEWS, _PLACES, _TOK, BASE, KEYWORDS, LONG, R, _news, _responses, _round, _t, _wide, base, long, query
from panelweft.session import scratch
from panelweft.sources import databases, readers, sinks
from panelweft.streaming import live


# Sources and sinks

@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_scan(spark, d):
    path = scratch(spark)
    sinks.csv(_t(spark, d, "nation"), path)
    return readers.csv(spark, path, columns=["n_nationkey", "n_name"])


@query("SELECT doc_id, CASE WHEN trim(text) NOT IN ('', 'NA', 'N/A', 'NaN', 'nan', 'null', 'NULL', 'None', '#N/A') THEN md5(text) END AS text_md5 FROM documents")
def csv_with_line_breaks(spark, d):
    """Texts as quoted cells, read back by ranges of bytes."""
    path = scratch(spark)
    _t(spark, d, "documents").select("doc_id", "text").write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.quoted_csv(spark, path, "doc_id long, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT * FROM (VALUES ('r_regionkey'), ('r_name')) v(name)")
def csv_header(spark, d):
    path = scratch(spark)
    sinks.csv(_t(spark, d, "region").select("r_regionkey", "r_name"), path)
    return spark.createDataFrame([(c,) for c in readers.header(spark, path)], "name string")


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0")
def jsonl_append(spark, d):
    path, e = scratch(spark), _t(spark, d, "events").select("event_id", "user_id", "event_type")
    sinks.jsonl(e, path)
    sinks.jsonl(e.filter("event_id % 2 = 0"), path)
    return readers.jsonl(spark, path, "event_id long, user_id long, event_type string")


@query("SELECT event_id, user_id FROM events WHERE event_id % 7 <> 0")
def jsonl_tolerant(spark, d):
    path = scratch(spark)
    line = F.to_json(F.struct("event_id", "user_id"))
    _t(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 14)).otherwise(line).alias("value")).write.text(path)
    return readers.jsonl(spark, path, "event_id long, user_id long", tolerant=True)


@query("SELECT 'I' || n_regionkey AS indicator_code, 'R' || n_regionkey AS indicator_name, 'C' || n_nationkey AS iso3c, n_name AS country_name, CAST(2000 + n_nationkey AS INTEGER) AS year, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey / 2.0e0 END AS value FROM nation WHERE n_regionkey <> 4")
def indicator_payload_rows(spark, d):
    k, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    item = F.struct(F.struct(F.concat(F.lit("I"), r).alias("id"), F.concat(F.lit("R"), r).alias("value")).alias("indicator"), F.struct(k.cast("string").alias("id"), F.col("n_name").alias("value")).alias("country"), F.concat(F.lit("C"), k.cast("string")).alias("countryiso3code"), (k + 2000).cast("string").alias("date"), F.when(k % 4 != 0, k / 2.0).alias("value"))
    pages = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(item)).alias("j"))  # a page a region
    raw = pages.select(F.when(F.col("n_regionkey") == 4, '[{"message":[{"id":"120"}]}]').otherwise(F.concat(F.lit('[{"page":1},'), "j", F.lit("]"))).alias("value"))
    return readers.indicator_payloads(raw)


@query("SELECT 'N' || n_nationkey AS iso3c, n_name AS country_name, r_name AS region, CAST(n_nationkey * 10 AS BIGINT) AS population, 'Cap ' || n_name AS capital, n_nationkey / 2.0e0 AS lat FROM nation JOIN region ON n_regionkey = r_regionkey")
def country_page_rows(spark, d):
    k = F.col("n_nationkey")
    item = F.struct(F.struct(F.concat(F.lit("N"), k.cast("string")).alias("alpha_3")).alias("codes"), F.struct(F.col("n_name").alias("common"), F.col("n_name").alias("official")).alias("names"), F.col("r_name").alias("region"), F.lit("s").alias("subregion"), (k * 10).alias("population"), F.array(F.struct(F.concat(F.lit("Cap "), "n_name").alias("name"))).alias("capitals"), F.struct((k / 2.0).alias("lat"), (k / 4.0).alias("lng")).alias("coordinates"))
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = n.groupBy("r_name").agg(F.concat(F.lit('{"data":{"objects":'), F.to_json(F.collect_list(item)), F.lit("}}")).alias("value"))  # a page a region
    return readers.country_pages(raw).select("iso3c", "country_name", "region", "population", "capital", "lat")


@query("SELECT n_nationkey AS source_id, CAST(i AS INTEGER) AS ordinal, n_name || ' & ' || i AS title, 'http://x.org/' || n_nationkey || '/' || i AS url, TIMESTAMP '2024-02-05 10:30:00' AS published_at FROM nation, range(0, 30) t(i)")
def feed_rows(spark, d):
    item = F.transform(F.sequence(F.lit(0), F.lit(34)), lambda i: F.concat(F.lit("<item><title><![CDATA["), F.col("n_name"), F.lit(" & "), i.cast("string"), F.lit("]]></title><link>http://x.org/"), F.col("n_nationkey").cast("string"), F.lit("/"), i.cast("string"), F.lit("</link><description>&lt;p&gt;text&lt;/p&gt;</description><pubDate>Mon, 05 Feb 2024 10:30:00 GMT</pubDate></item>")))
    raw = _t(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.concat(F.lit("<rss><channel>"), F.array_join(item, "\n"), F.lit("</channel></rss>")).alias("value"))
    return readers.feed_entries(raw).select("source_id", "ordinal", "title", "url", "published_at")


@query("SELECT n_nationkey, 'https://s/?q=' || replace(url_encode(n_name || ' news'), '%20', '+') || '&hl=en' AS url FROM nation")
def search_urls(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", readers.search_feed_url(F.concat("n_name", F.lit(" news")), "https://s/?q=").alias("url"))


@query("SELECT r_regionkey, r_name FROM region")
def first_available(spark, d):
    """The first source is missing, the second empty, the third has rows."""
    region = _t(spark, d, "region").select("r_regionkey", "r_name")
    return readers.first_of([lambda: spark.read.parquet(f"{d}/missing.parquet"), lambda: readers.or_empty(spark, f"{d}/missing.csv", region.schema, spark.read.csv), lambda: region])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def snapshot_latest(spark, d):
    path, o = scratch(spark), _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    sinks.snapshot_and_latest(o.filter("o_orderkey % 2 = 0"), path, "20240101T000000Z")
    sinks.snapshot_and_latest(o.filter("o_orderkey % 3 = 0"), path, "20240102T000000Z")
    return spark.read.parquet(f"{path}/latest")


@query("SELECT r_regionkey AS k, CASE WHEN r_regionkey = 2 THEN 'new' ELSE r_name END AS v FROM region")
def replaced_partitions(spark, d):
    path, r = scratch(spark), _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("v"))
    sinks.replaced_rows(r, path, "k")
    sinks.replaced_rows(r.filter("k = 2").withColumn("v", F.lit("new")), path, "k")
    return spark.read.schema("v string, k long").parquet(path)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def catalog_scan(spark, d):
    _t(spark, d, "nation").createOrReplaceTempView("panelweft_nation")
    return readers.table(spark, "panelweft_nation").filter("n_regionkey = 1").select("n_nationkey", "n_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 25 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_partkey IS NOT NULL")
def sqlite_scan(spark, d):
    """The table written to a folder of SQLite databases and read back with the filters pushed down."""
    databases.register(spark)
    path = scratch(spark)
    _t(spark, d, "part").select("p_partkey", "p_brand", "p_size").repartition(3, "p_partkey").write.format("panelweft_sqlite").option("path", path).option("table", "part").mode("append").save()
    return spark.read.format("panelweft_sqlite").option("path", path).option("table", "part").option("rows", 1000).load().filter("p_size > 25 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')").select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_name FROM customer")
def paged_records(spark, d):
    """A REST source that is read by offset and limit on the executors; the pages come from a database of the table."""
    databases.register(spark)
    path = scratch(spark)
    rows = _t(spark, d, "customer").select("c_custkey", "c_name")
    rows.coalesce(1).write.format("panelweft_sqlite").option("path", path).option("table", "customer").mode("append").save()

    def fetch(offset, limit):
        import json
        import sqlite3

        with sqlite3.connect(databases._databases(path)[0]) as con:
            return json.dumps({"records": [{"c_custkey": k, "c_name": n} for k, n in con.execute("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT ? OFFSET ?", (limit, offset))]})

    return readers.records(readers.paged(spark, rows.count(), fetch, 1000), "c_custkey:bigint,c_name:string")


# Expressions

@query("SELECT n_name, CAST(NULL AS VARCHAR) AS missing, n_nationkey FROM nation")
def select_or_null(spark, d):
    return panel.select_or_null(_t(spark, d, "nation"), ["n_name", "missing", "n_nationkey"])


@query("SELECT n_name AS name FROM nation")
def select_available(spark, d):
    return panel.select_available(_t(spark, d, "nation"), {"n_name": "name", "absent": "gone"})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS level, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS oriented FROM orders")
def recoded(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", X.replaced("o_orderstatus", {"F": "done", "O": "open"}).alias("status"), X.ordinal("o_orderstatus", {"F": 2, "O": 1}).alias("level"), X.oriented("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, " Negative").otherwise("positive")).alias("oriented"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey % 3 = 0 AS flag, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey / 4.0e0 END AS x FROM orders")
def typed_text(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select("o_orderkey", F.concat(F.year("o_orderdate"), F.lit("-99 (p)")).alias("period"), F.when(k % 3 == 0, " YES ").otherwise("no").alias("b"), F.when(k % 5 == 0, "1,5x").otherwise(F.concat(F.lit(" "), (k / 4.0).cast("decimal(20,2)").cast("string"))).alias("t"))
    return o.select("o_orderkey", X.year_of_period("period").alias("y"), X.to_bool("b").alias("flag"), X.to_number("t").alias("x"))


@query("SELECT c_custkey, substr(sha256(c_name || '|' || c_custkey), 1, 24) AS id, sha256('salt:' || c_name) AS hashed FROM customer")
def stable_ids(spark, d):
    return _t(spark, d, "customer").select("c_custkey", X.short_id("c_name", "c_custkey").alias("id"), X.salted_hash(F.concat(F.lit(" "), "c_name"), "salt").alias("hashed"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def parsed_times(spark, d):
    """ISO-8601 and RFC-2822 text in turn."""
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("t"))
    return e.select("event_id", X.parse_time("t").alias("at"))


_WORDS = "list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda w: w <> '')"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, list_filter(range(1, greatest(len(w), 1) + 1, 90), lambda i: len(w) > 0 AND (i = 1 OR i + 10 <= len(w))) AS s FROM w) SELECT doc_id, CAST(len(s) AS INTEGER) AS n, CASE WHEN len(s) > 0 THEN array_to_string(w[s[-1]:s[-1] + 99], ' ') END AS last FROM s")
def text_chunks(spark, d):
    c = _t(spark, d, "documents").select("doc_id", X.word_chunks("text", 100, 10).alias("c"))
    return c.select("doc_id", F.size("c").alias("n"), F.try_element_at("c", F.lit(-1)).alias("last"))


@query("SELECT n_nationkey, lower(replace(replace(n_name, ' ', '-'), '_', '-')) AS slug FROM nation")
def slugs(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", X.slug(F.concat(F.lit("  "), F.replace("n_name", F.lit(" "), F.lit("_ ")), F.lit("! "))).alias("slug"))


@query(r"""WITH p AS (SELECT doc_id, text, list_min(list_filter([instr(lower(text), 'que'), instr(lower(text), 'und')], lambda i: i > 0)) AS i FROM documents)
SELECT doc_id, trim(regexp_replace(substr(text, greatest(coalesce(i, 1) - 15, 1), 60), '\s+', ' ', 'g')) AS s FROM p""")
def snippets(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.snippet("text", ["que", "und"], 60).alias("s"))


# Two-sided p-values by the error function's series: |t| is at most 3 here, so 60 terms do.
@query("WITH e AS (SELECT event_id, (event_id % 601 - 300) / 100.0e0 AS t FROM events), k AS (SELECT event_id, t, abs(t) / sqrt(2.0e0) AS x FROM e) SELECT event_id, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda n: pow(-1, n) * pow(x, 2 * n + 1) / (gamma(n + 1.0e0) * (2 * n + 1)))), 6) + 0.0e0 AS p FROM k")
def normal_p_values(spark, d):
    """The function for SQL users, on a table."""
    hooks.register(spark)
    _t(spark, d, "events").createOrReplaceTempView("panelweft_events")
    return spark.sql("SELECT event_id, round(normal_p_value((event_id % 601 - 300) / 100.0D), 6) + 0.0D AS p FROM panelweft_events")


# Statistics

@query(f"WITH {BASE} SELECT {R('corr(revenue, gap)')} AS corr FROM p WHERE gap IS NOT NULL")
def pearson(spark, d):
    return _round(base(spark, d).agg(S.correlation("revenue", "gap").alias("corr")))


@query(f"WITH {BASE}, c AS (SELECT corr(revenue, qty) AS r FROM p) SELECT code, round(1 / (1 - r * r), 4) + 0.0e0 AS vif FROM c, (VALUES ('revenue'), ('qty')) v(code)")
def vif_of_two(spark, d):
    got = S.vif(base(spark, d), ["revenue", "qty"])
    return _round(spark.createDataFrame(list(got.items()), "code string, vif double"), 4)


@query(f"""WITH {BASE}, v AS (SELECT revenue - avg(revenue) OVER (PARTITION BY entity) - avg(revenue) OVER (PARTITION BY yr) + avg(revenue) OVER () AS y, CAST(n_orders AS DOUBLE) - avg(n_orders) OVER (PARTITION BY entity) - avg(n_orders) OVER (PARTITION BY yr) + avg(n_orders) OVER () AS x, entity, yr FROM p),
s AS (SELECT sum(x * y) / sum(x * x) AS b, sum(y * y) AS yy, count(*) AS n, count(DISTINCT entity) AS g, count(DISTINCT yr) AS t FROM v), e AS (SELECT sum((y - b * x) * (y - b * x)) AS ssr FROM v, s)
SELECT round(1 - ssr / yy, 6) + 0.0e0 AS r2, round(1 - ssr / yy * (n - 1) / (n - g - t), 6) + 0.0e0 AS adj_r2, round((1 - ssr / yy) / (ssr / yy / (n - g - t)), 3) + 0.0e0 AS f, round(sqrt(ssr / (n - g - t)), 4) + 0.0e0 AS residual_sd, CAST(n - g - t AS BIGINT) AS df FROM s, e""")
def ols_fit_metrics(spark, d):
    p = base(spark, d).withColumn("n_orders", F.col("n_orders").cast("double"))
    f = econometrics.ols(p, "revenue", ["n_orders"], "entity", "yr")
    return spark.createDataFrame([(*(round(float(x), k) for x, k in ((f.r2, 6), (f.adj_r2, 6), (f.f, 3), (f.residual_sd, 4))), f.df_residual)], "r2 double, adj_r2 double, f double, residual_sd double, df long")


@query(f"WITH {BASE} SELECT yr, count(*) AS n, count(gap) AS n_gap, {R('sum(qty)', 4)} AS qty, {R('min(qty)')} AS least, {R('max(qty)')} AS most, {R('sum(gap)', 4)} AS gap FROM p GROUP BY yr")
def placebo_keeps_values(spark, d):
    """What permutations within times can't change."""
    p = econometrics.placebo(base(spark, d).select("entity", "yr", "qty", "gap"), ["qty", "gap"], "entity", "yr", 2026)
    return _round(p.groupBy("yr").agg(F.count("*").alias("n"), F.count("gap").alias("n_gap"), F.sum("qty").alias("qty"), F.min("qty").alias("least"), F.max("qty").alias("most"), F.sum("gap").alias("gap")), 6, qty=4, gap=4)


@query(f"WITH {BASE} SELECT yr, count(*) AS n, {R('count(*) * (count(*) + 1) / 2.0e0', 4)} AS total_rank FROM p GROUP BY yr")
def rank_totals(spark, d):
    """Mean ranks over weight draws add up to what ranks add up to."""
    r = econometrics.rank_stability(base(spark, d), ["qty", "gap", "ret"], "entity", "yr", draws=50)
    return _round(r.groupBy("yr").agg(F.count("*").alias("n"), F.sum("mean_rank").alias("total_rank")), 4)


@query(f"WITH {BASE} SELECT DISTINCT yr, 40 AS n, 40.0e0 AS total, true AS inside FROM p")
def weight_draws(spark, d):
    w = econometrics.weight_draws(base(spark, d), "yr", ["a", "b", "c"], 40, 7)
    return _round(w.groupBy("yr").agg(F.count("*").cast("int").alias("n"), F.sum(F.col("w_a") + F.col("w_b") + F.col("w_c")).alias("total"), F.bool_and((F.col("w_a") > 0) & (F.col("w_b") > 0) & (F.col("w_c") > 0)).alias("inside")))


@query(f"""WITH {LONG}, c AS (SELECT a.code AS a, b.code AS b, count(*) AS n, covar_pop(a.value, b.value) / NULLIF(stddev_pop(a.value) * stddev_pop(b.value), 0) AS corr FROM lg a JOIN lg b ON a.entity = b.entity AND a.yr = b.yr AND a.code < b.code WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2) SELECT a, b, n, {R('corr')} AS corr FROM c ORDER BY abs(corr) DESC NULLS LAST, a, b LIMIT 3""")
def strongest_pairs(spark, d):
    return _round(verify.correlation_report(long(spark, d), "code", ["entity", "yr"], "value").limit(3))


@query()
def exact_effects(spark, d):
    """Two-way effects with a constant by alternating projections."""
    p = base(spark, d).withColumn("n_orders", F.col("n_orders").cast("double"))
    f, constant = econometrics.ols_with_constant(p, "revenue", ["n_orders"], "entity", "yr")
    return spark.createDataFrame([("n_orders", float(f.coef[0]), float(f.se[0])), ("const", float(constant), None)], "term string, coef double, se double")


@query("WITH n AS (SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang) SELECT category, n, round(n / (SELECT avg(n) FROM n), 6) AS ratio FROM n")
def category_balance(spark, d):
    return _round(text.category_balance(_t(spark, d, "documents"), "lang"))


@query("SELECT count(*) AS n_rows, true AS same FROM lineitem")
def fingerprint_of_any_order(spark, d):
    """The digest doesn't depend on order or partitions, and one changed cell changes it."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    cols = ["l_orderkey", "l_linenumber", "l_quantity"]
    first = li.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("k")).first()["k"]
    a, b = changes.fingerprint(li, cols), changes.fingerprint(li.repartition(7, "l_quantity"), cols)
    c = changes.fingerprint(li.withColumn("l_quantity", F.when((F.col("l_orderkey") == first[0]) & (F.col("l_linenumber") == first[1]), -1.0).otherwise(F.col("l_quantity"))), cols)
    one = a.join(b.select("n_rows", F.col("xor").alias("x2"), F.col("total").alias("t2")), "n_rows").join(c.select("n_rows", F.col("total").alias("t3")), "n_rows")
    return one.select("n_rows", ((F.col("xor") == F.col("x2")) & (F.col("total") == F.col("t2")) & (F.col("total") != F.col("t3"))).alias("same"))


# News and search

@query(f"""WITH {_NEWS}, r AS (SELECT doc_id, primary_domain, greatest("ACC", "ECO", "OUT") AS top, "ACC" + "ECO" + "OUT" AS total, CAST("ACC" > 0 AS INTEGER) + CAST("ECO" > 0 AS INTEGER) + CAST("OUT" > 0 AS INTEGER) AS k FROM m) SELECT doc_id, primary_domain, CAST(greatest(k - 1, 0) AS INTEGER) AS n_secondary, CAST(total AS INTEGER) AS n_matched, CASE WHEN total > 0 THEN round(top / CAST(total AS DOUBLE), 3) ELSE 0 END AS confidence FROM r""")
def keyword_details(spark, d):
    m = _news(spark, d)
    return m.select("doc_id", "primary_domain", F.size("secondary_domains").alias("n_secondary"), F.json_array_length("matched_keywords").alias("n_matched"), F.round("confidence", 3).alias("confidence"))


@query(f"""WITH {_TOK}, tt AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(trim(regexp_replace(lower(left(coalesce(text, ''), 40)), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', ' ', 'g')), '\\s+')) AS t FROM documents), q AS (SELECT * FROM (VALUES ('idiot'), ('que')) v(t)), tf AS (SELECT doc_id, t, count(*) AS tf FROM tokens WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t)
SELECT tf.doc_id, round(sum((1 + ln(CAST(tf AS DOUBLE))) * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE)) * CASE WHEN tt.t IS NOT NULL THEN 2.0e0 ELSE 1.0e0 END), 3) AS score FROM tf JOIN df USING (t) LEFT JOIN tt ON tt.doc_id = tf.doc_id AND tt.t = tf.t GROUP BY tf.doc_id ORDER BY score DESC, tf.doc_id LIMIT 20""")
def tfidf_boosted(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", F.left("text", F.lit(40)).alias("title"))
    return text.search(docs, "idiot que", id_col="doc_id", text_col="text", title_col="title")


# A knowledge base of the nations: each links to the next one, some to nothing that exists.

def _kb(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nxt = _t(spark, d, "nation").select((F.col("n_nationkey") - 1).alias("_k"), F.col("n_name").alias("_next"))
    n = n.join(nxt, F.col("n_nationkey") == F.col("_k"), "left")
    k = F.col("n_nationkey")
    links = F.concat(F.coalesce(F.concat(F.lit("See [["), "_next", F.lit("]]. ")), F.lit("")), F.when(k % 5 == 0, "Also [[Nowhere|there]].").otherwise(""))
    content = F.concat(F.lit("# "), F.col("n_name"), F.lit("\n\n"), F.when(k % 3 == 0, "> **Summary**: A nation of some size and no small merit.\n\n").otherwise(""), links)
    return knowledge.articles(n.select(F.concat(F.when(k % 8 == 7, "concepts/").otherwise(F.concat(F.lit("wiki/"), F.col("r_name"), F.lit("/"))), "n_name", F.lit(".md")).alias("path"), content.alias("content"), "r_name", "n_nationkey").withColumnRenamed("r_name", "category"))


_KB = """kb AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 8 = 7 THEN 'concepts/' ELSE 'wiki/' || r_name || '/' END || n_name || '.md' AS path, n_name AS title, r_name AS category, n_nationkey % 3 = 0 AS has_summary FROM nation JOIN region ON n_regionkey = r_regionkey),
links AS (SELECT a.path, a.title AS src, b.title AS link FROM kb a JOIN kb b ON b.k = a.k + 1 UNION ALL SELECT path, title, 'Nowhere' FROM kb WHERE k % 5 = 0)"""


@query(f"WITH {_KB} SELECT path, title, category, has_summary, CAST((SELECT count(*) FROM links l WHERE l.path = kb.path) AS INTEGER) AS n_links FROM kb")
def kb_articles(spark, d):
    return _kb(spark, d).select("path", "title", "category", "has_summary", F.size("links").alias("n_links"))


@query(f"""WITH {_KB}, n AS (SELECT category, count(*) AS n FROM kb GROUP BY 1)
SELECT 'orphan_detection' AS "check", 'warning' AS severity, path AS item, title AS detail FROM kb WHERE path NOT LIKE 'concepts/%' AND title NOT IN (SELECT link FROM links)
UNION ALL SELECT 'broken_links', 'error', path, link FROM links WHERE link NOT IN (SELECT title FROM kb)
UNION ALL SELECT 'missing_summaries', 'warning', path, title FROM kb WHERE NOT has_summary AND path NOT LIKE 'concepts/%'
UNION ALL SELECT 'stale_sources', 'info', 'raw/' || r_name, r_name FROM region WHERE r_regionkey % 2 = 0
""")
def lint_findings(spark, d):
    sources = _t(spark, d, "region").select(F.col("r_name").alias("original_name"), (F.col("r_regionkey") % 2 == 1).alias("compiled"))
    return knowledge.lint(_kb(spark, d), sources, duplicates=False)


_WIKI = """a0 AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_nationkey FROM customer),
a AS (SELECT k, CASE WHEN k = 7 THEN 'solo/' WHEN k % 50 = 3 THEN '' WHEN k % 40 = 1 THEN 'concepts/' WHEN k % 3 = 0 THEN lower(c_mktsegment) || '/x/' ELSE 'wiki' || c_nationkey % 2 || '/' END || k || '.md' AS path, CASE WHEN k % 9 = 0 THEN lower(c_name) ELSE c_name END AS title, 'Customer#' || lpad(CAST(k + CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS VARCHAR), 9, '0') AS link, k % 5 = 0 AS has_summary, k % 6 < 4 AS linked FROM a0),
f AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS folder, count(*) AS n FROM a GROUP BY 1)"""


@query(f"""WITH {_WIKI} SELECT 'orphan_detection' AS "check", 'warning' AS severity, path AS item, title AS detail FROM a WHERE path NOT LIKE 'concepts/%' AND title NOT IN (SELECT link FROM a WHERE linked)
UNION ALL SELECT 'broken_links', 'error', path, link FROM a WHERE linked AND link NOT IN (SELECT title FROM a)
UNION ALL SELECT 'missing_summaries', 'warning', path, title FROM a WHERE NOT has_summary AND path NOT LIKE 'concepts/%'
UNION ALL SELECT 'category_balance', 'info', folder, CAST(n AS VARCHAR) FROM f WHERE (SELECT count(*) FROM f) > 1 AND (n = 1 AND (SELECT avg(n) FROM f) > 3 OR n > 4 * (SELECT avg(n) FROM f) AND n > 10)""")
def wiki_lint(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    folder = F.when(k == 7, "solo/").when(k % 50 == 3, "").when(k % 40 == 1, "concepts/").when(k % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit("/x/"))).otherwise(F.concat(F.lit("wiki"), (F.col("c_nationkey") % 2).cast("string"), F.lit("/")))
    title = F.when(k % 9 == 0, F.lower("c_name")).otherwise(F.col("c_name"))
    link = F.concat(F.lit("Customer#"), F.lpad((k + F.when(k % 4 == 0, 2).otherwise(1)).cast("string"), 9, "0"))
    content = F.concat(F.lit("# "), title, F.lit("\n\n"), F.when(k % 5 == 0, "> **Summary**: of one customer\n\n").otherwise("## Summary\n\n"), F.when(k % 6 < 4, F.concat(F.lit("See [["), link, F.lit("]]."))).otherwise(""))
    return knowledge.lint(knowledge.articles(c.select(F.concat(folder, k.cast("string"), F.lit(".md")).alias("path"), content.alias("content"))), duplicates=False)


@query(r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}\p{Pc}]{3,}')) AS s FROM documents), u AS (SELECT doc_id, unnest(s) AS w FROM t), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL),
r AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM t) SELECT 'duplicate_content' AS "check", CAST(a AS VARCHAR) AS item, CAST(b AS VARCHAR) AS detail FROM x JOIN r p ON p.doc_id = a JOIN r q ON q.doc_id = b WHERE CAST(c AS DOUBLE) / (p.n + q.n - c) >= 0.85 AND p.rep = a AND (q.rep = b OR q.rep = a)""")
def wiki_duplicates(spark, d):
    docs = _wide(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return text.jaccard_pairs(docs.select("path", knowledge.token_set("content").alias("t")), "path", "t").select(F.lit("duplicate_content").alias("check"), F.col("a").cast("string").alias("item"), F.col("b").cast("string").alias("detail"))


@query(f"WITH {_KB} SELECT count(*) AS n_docs, CAST((SELECT count(*) FROM links) AS BIGINT) AS n_links, CAST((SELECT count(*) FROM kb WHERE path NOT IN (SELECT path FROM links)) AS BIGINT) AS n_without_links, CAST(1 AS BIGINT) AS n_broken, (SELECT string_agg(category || ': ' || n, ';' ORDER BY n DESC, category) FROM (SELECT category, count(*) AS n FROM kb GROUP BY 1)) AS top_categories FROM kb")
def kb_statistics(spark, d):
    s = text.kb_stats(_kb(spark, d), "title", "content", "links", "category")
    return s.select("n_docs", "n_links", "n_without_links", "n_broken", F.array_join("top_categories", ";").alias("top_categories"))


@query("SELECT 'concepts/' || lower(replace(replace(r_name, ' ', '-'), '_', '-')) || '.md' AS path, r_name AS concept, count(*) AS n, '# ' || r_name || chr(10) || chr(10) || string_agg('- [[' || n_name || ']]', chr(10) ORDER BY n_name) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) >= 5")
def concept_stubs(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return knowledge.concept_stubs(n.select("n_name", F.array("r_name", "r_name").alias("c")), "n_name", "c", 5)


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0")
def pending_sources(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha256"))
    return knowledge.pending(c, c.filter("c_custkey % 4 = 0")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def anti_customers(spark, d):
    c = _t(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey")
    return c.join(_t(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# Views

@query(f"""WITH {BASE}, y AS (SELECT yr, avg(revenue) AS m, count(DISTINCT entity) AS k, arg_max(entity, revenue) AS best, arg_min(entity, revenue) AS worst FROM p GROUP BY yr) SELECT y.yr, {R('y.m', 3)} AS mean_score, k AS n_entities, best, worst, {R('y.m - b.m', 3)} AS delta FROM y LEFT JOIN (SELECT yr + 1 AS yr, m FROM y) b USING (yr)""")
def kpis_by_time(spark, d):
    return _round(views.kpis(base(spark, d), "entity", "yr", "revenue"), 3)


@query(f"WITH {BASE} SELECT entity, 'gap' AS domain, {R('gap')} AS score FROM p WHERE yr = 1996 AND entity = 'NATION_3' AND gap IS NOT NULL UNION ALL SELECT entity, 'qty', {R('qty')} FROM p WHERE yr = 1996 AND entity = 'NATION_3'")
def profile_view(spark, d):
    return _round(views.profile(base(spark, d), "entity", "yr", ["gap", "qty"], "NATION_3", 1996).select(F.lit("NATION_3").alias("entity"), "domain", "score"))


@query(f"WITH {BASE} SELECT entity, yr, {R('gap')} AS gap FROM p WHERE entity IN ('NATION_3', 'NATION_7') AND gap IS NOT NULL")
def trends_view(spark, d):
    return _round(views.trends(base(spark, d), "entity", "yr", "gap", ["NATION_3", "NATION_7"]))


@query(f"WITH {BASE} SELECT entity, {R('qty')} AS qty, {R('disc')} AS disc FROM p WHERE yr = 1997")
def heat_map_view(spark, d):
    return _round(views.heat_map(base(spark, d), "entity", "yr", ["qty", "absent", "disc"], 1997))


@query(f"WITH {BASE} SELECT entity, {R('avg(qty)')} AS mean_score, {R('min(qty)')} AS lowest, {R('max(qty)')} AS highest, {R('max(qty) - min(qty)')} AS spread FROM p GROUP BY entity ORDER BY max(qty) - min(qty) DESC, entity LIMIT 5")
def spread_view(spark, d):
    return _round(views.spread(base(spark, d), "entity", "qty", 5))


@query(f"WITH {BASE}, h AS (SELECT entity, nk / 2.0e0 AS lat, nk * 1.0e0 AS lon, qty FROM p WHERE yr = 1995 AND nk % 2 = 0) SELECT entity, lat, lon, {R('qty')} AS qty, {R('qty - (SELECT min(qty) FROM h) + 0.05e0')} AS size FROM h")
def marker_map_view(spark, d):
    places = _t(spark, d, "nation").select(F.col("n_name").alias("entity"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 2.0).alias("lat"), (F.col("n_nationkey") * 1.0).cast("double").alias("lon"))
    return _round(views.marker_map(base(spark, d), places, "entity", "yr", "qty", 1995))


@query(f"WITH {BASE}, r AS (SELECT entity, yr, row_number() OVER (PARTITION BY yr ORDER BY revenue DESC, entity) AS rank FROM p) SELECT entity, yr, CAST(rank AS INTEGER) AS rank, CAST(lag(rank) OVER (PARTITION BY entity ORDER BY yr) - rank AS INTEGER) AS moved FROM r")
def running_rank_view(spark, d):
    return views.running_rank(base(spark, d), "yr", "entity", "revenue")


@query(f"WITH {BASE} SELECT yr, {R('avg(disc) * 100')} AS mean_coverage_pct, {R('median(qty)')} AS median_observed, {R('median(gap)')} AS median_imputed, {R('avg(CASE WHEN nk % 3 = 0 THEN 1.0e0 ELSE 0 END) * 100')} AS high_trust_pct FROM p GROUP BY yr")
def coverage_view(spark, d):
    p = base(spark, d).withColumn("tier", F.when(F.col("nk") % 3 == 0, "High").when(F.col("nk") % 3 == 1, "Low"))
    return _round(views.coverage_view(p, "yr", ratio="disc", observed="qty", imputed="gap", tier="tier"))


@query(f"WITH {BASE}, s AS (SELECT entity, list(yr ORDER BY yr) AS x, list(round(gap, 4) ORDER BY yr) AS y FROM p WHERE gap IS NOT NULL GROUP BY entity) SELECT entity AS series, array_to_string(x, ',') AS x, len(y) AS n FROM s")
def chart_series_view(spark, d):
    return views.chart_series(base(spark, d), "yr", "gap", "entity").select("series", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("x"), F.size("y").cast("long").alias("n"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 30")
def latest_events(spark, d):
    return views.latest(_t(spark, d, "events"), "ts", ["event_id"]).select("event_id", "user_id")


@query("SELECT 'rows' AS measure, 'events' AS value, count(*) AS n FROM events UNION ALL SELECT 'rows', 'orders', count(*) FROM orders UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'eligible', NULL, count(*) FROM orders WHERE o_totalprice > 100000")
def live_monitor(spark, d):
    o = _t(spark, d, "orders").withColumn("ok", F.col("o_totalprice") > 100000)
    return views.monitor({"events": _t(spark, d, "events"), "orders": o}, ("orders", "o_orderstatus"), ("orders", "ok"))


# Verification reports and changes

@query("SELECT n_name AS report, CASE WHEN n_nationkey % 5 > 1 THEN 'a' END AS section, CASE n_nationkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' ELSE 'errors' END AS issue, CAST(CASE WHEN n_nationkey % 5 > 1 THEN n_nationkey % 5 - 1 ELSE 1 END AS BIGINT) AS n FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT n_name, '', 'errors', 1 FROM nation WHERE n_nationkey % 5 = 4")
def report_scan(spark, d):
    k = F.col("n_nationkey") % 5
    issue = '{"severity":"error"}'
    two = F.concat(F.lit('{"a":{"issues":['), F.array_join(F.array_repeat(F.lit(issue), (k - 1).cast("int")), ","), F.lit(',{"severity":"info"}]},"b":{"issues":[]},"n":3}'))
    n = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(k == 1, '{"a": ').when(k == 4, f'{{"issues":[{issue}]}}').when(k > 1, two).alias("content"), k.alias("k"))
    return verify.scan_reports(n.filter("k > 0").drop("k"), n.select("name"))


@query("""WITH a AS (SELECT event_type AS source, count(*) AS n FROM events WHERE event_id % 3 = 0 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1)
SELECT b.source, r AS reason FROM b LEFT JOIN a USING (source), (VALUES ('new_source_file'), ('fingerprint_changed'), ('row_count_changed')) v(r) WHERE CASE r WHEN 'new_source_file' THEN a.n IS NULL ELSE a.n IS NOT NULL AND a.n <> b.n END""")
def change_reasons(spark, d):
    e = _t(spark, d, "events")
    snap = lambda x: x.groupBy(F.col("event_type").alias("source")).agg(F.lit(True).alias("present"), F.bit_xor(F.xxhash64("event_id")).alias("digest"), F.count("*").alias("row_count"), F.max(F.year("ts")).alias("max_year"))
    return changes.reasons(snap(e.filter("event_id % 3 = 0 AND event_type <> 'view'")), snap(e))


@query("""WITH a AS (SELECT event_type AS code, max(day(ts)) AS y FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), b AS (SELECT event_type AS code, max(day(ts)) AS y FROM events GROUP BY 1) SELECT code, CAST(a.y AS INTEGER) AS "before", CAST(b.y AS INTEGER) AS "after" FROM a JOIN b USING (code) WHERE b.y > a.y""")
def later_years(spark, d):
    e = _t(spark, d, "events")
    last = lambda x: x.groupBy(F.col("event_type").alias("code")).agg(F.max(F.dayofmonth("ts")).alias("max_year"))
    return changes.later_years(last(e.filter("ts < '2024-01-10'")), last(e), "code")


# Survey

_EXPORT = """x AS (SELECT o_orderkey AS response_id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 5 + 1 AS DOUBLE) END AS a, CAST(o_custkey % 5 + 1 AS DOUBLE) AS b, CASE WHEN o_orderkey % 3 = 0 THEN 1.0e0 END AS e, o_orderkey % 2 = 0 AS eligible FROM orders)"""


def _export(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(k.alias("response_id"), F.when(k % 4 != 0, (k % 5 + 1).cast("string")).otherwise("n/a").alias("a"), (F.col("o_custkey") % 5 + 1).cast("string").alias("b"), F.when(k % 3 == 0, "1").alias("e"))
    status = _t(spark, d, "orders").select(k.alias("response_id"), F.when(k % 2 == 0, "complete").otherwise("partial").alias("completion_status"), (k % 2 == 0).alias("eligible"), F.lit("r").alias("reason"))
    return survey.primary_export(rows, status, scores=("a", "b"), domains=("e",)), status


@query(f"WITH {_EXPORT} SELECT response_id, a, b, e, round((coalesce(a, 0) + b) / (1 + CASE WHEN a IS NULL THEN 0 ELSE 1 END), 6) AS usability_mean, e AS domain_mean, CASE WHEN eligible THEN 'complete' ELSE 'partial' END AS completion_status, eligible, 'r' AS reason FROM x")
def primary_export(spark, d):
    return _round(_export(spark, d)[0])


@query(f"WITH {_EXPORT} SELECT count(*) AS n, round(100 * avg(CASE WHEN eligible THEN 1.0e0 ELSE 0 END), 2) AS completion_pct, count(*) FILTER (eligible) AS n_eligible, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM x")
def experience_report(spark, d):
    export, status = _export(spark, d)
    return _round(survey.experience_report(export, status, ("a", "b")))


@query(f"WITH {_ELIG} SELECT round(avg(CAST(dur AS DOUBLE)), 6) AS mean_duration, count(*) AS n, round(100 * avg(CASE WHEN reason = 'eligible_full_completion' THEN 1.0e0 ELSE 0 END), 2) AS completion_pct, count(*) FILTER (reason = 'eligible_full_completion') AS n_eligible, round((SELECT avg(n_days) FROM (SELECT o_orderkey % 5 + 1.0e0 AS n_days FROM orders)), 6) AS mean_usability FROM c JOIN (SELECT response_id, dur FROM r) USING (response_id)")
def experience_durations(spark, d):
    r = _responses(spark, d)
    scores = r.select((F.col("response_id") % 5 + 1.0).alias("usability"))
    return _round(survey.experience_report(scores, survey.with_eligibility(r, order="response_id", required=("consent", "country")), ("usability",)))


@query("""SELECT c_custkey, 'Hello ' || c_name || ', hi' AS message, 'https://wa.me/' || (c_custkey + 1000) || '?text=' || replace(url_encode('Hello ' || c_name || ', hi'), '%20', '+') AS link FROM customer WHERE c_custkey % 3 <> 0""")
def outreach_links(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("+"), (F.col("c_custkey") + 1000).cast("string")).alias("phone"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, "yes").otherwise("no").alias("opted_in"))
    return survey.outreach_queue(c, "Hello %s, hi").select("c_custkey", "message", "link")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'awaiting_reply' WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN 'awaiting_reply' ELSE 'awaiting_reply' END WHEN 2 THEN 'completed' ELSE 'completed' END AS status, CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN 2 ELSE 1 END WHEN 2 THEN 3 ELSE 3 END AS INTEGER) AS step FROM customer""")
def questionnaire_states(spark, d):
    """Ready ones are asked, answers advance, the last answer completes, blank answers don't count."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer")
    state = c.filter("c_custkey % 4 > 0").select(k.alias("id"), F.when(k % 4 == 3, "completed").otherwise("awaiting_reply").alias("status"), F.when(k % 4 == 1, 1).when(k % 4 == 2, 2).otherwise(3).alias("step"))
    replies = c.filter("c_custkey % 4 <> 3").select(k.alias("id"), F.when((k % 4 == 1) & (k % 8 != 1), "  ").otherwise("yes").alias("reply"))
    return survey.advance(state, replies, key="id", n_questions=3)


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Hi ' || c_name || '!' || chr(10) || chr(10) || 'Q1/2: How?' WHEN 1 THEN 'Q2/2: Why?' ELSE 'Bye ' || c_name END AS message FROM customer""")
def question_messages(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", survey.question_message(F.col("c_custkey") % 3, "c_name", intro="Hi {name}!", prompts=["How?", "Why?"], closing="Bye {name}").alias("message"))


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}e0, {y}e0)" for n, x, y in _PLACES)}) v(place, px, py)), e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), k AS (SELECT vec_id, place, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt((px - x) * (px - x) + (py - y) * (py - y)), place) AS i FROM e, c) SELECT vec_id, place, round(d, 6) + 0.0e0 AS distance FROM k WHERE i = 1""")
def spatial_nearest_by_grid(spark, d):
    """The same nearest places by way of the grid."""
    e = _t(spark, d, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    c = spark.createDataFrame(_PLACES, "place string, px double, py double")
    return _round(spatial.nearest_place(e, c, x="x", y="y", place="place", px="px", py="py", few=3).select("vec_id", "place", "distance"))


@query(f"""WITH {_NEWS}, a AS (SELECT doc_id % 700 AS k, doc_id, lang, primary_domain, CAST(doc_id % 2 AS INTEGER) AS b, CASE WHEN doc_id % 5 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 700 AS INTEGER)) END AS ts FROM m), l AS (SELECT *, row_number() OVER (PARTITION BY k, doc_id ORDER BY b DESC) AS i FROM a) SELECT lang, count(*) AS n, count(*) FILTER (primary_domain <> 'UNMAPPED') AS mapped, round(count(*) FILTER (primary_domain <> 'UNMAPPED') / 1.0e0 / count(*), 4) AS mapping_rate FROM l WHERE i = 1 AND (ts IS NULL OR ts >= TIMESTAMP '2024-01-25' - INTERVAL 14 DAYS) GROUP BY lang""")
def news_turn(spark, d):
    """Half of the documents are the intake of the turn before."""
    docs = _wide(spark, d, "documents").select("doc_id", "text", "lang", F.lit("").alias("title"), F.when(F.col("doc_id") % 5 > 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 700).cast("int"))).alias("ts")).withColumnRenamed("text", "summary")
    old = text.map_articles(docs.filter("doc_id % 2 = 0"), KEYWORDS)
    return tracks.news(old, docs.filter("doc_id % 2 = 1"), KEYWORDS, now="2024-01-25", key="doc_id", published="ts", by=["lang"])["groups"]


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS r FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, trim(r) <> '') AS i FROM e), s AS (SELECT user_id, CAST(least(count(*) FILTER (i > 1 AND trim(r) <> ''), 60) AS INTEGER) AS step FROM f GROUP BY user_id) SELECT user_id, CASE WHEN step = 60 THEN 'completed' ELSE 'awaiting_reply' END AS status, step FROM s""")
def questionnaire_replay(spark, d):
    """Events as replies, the errors blank."""
    e = _t(spark, d, "events").withColumn("reply", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")))
    return live.questionnaire(e, key="user_id", time="ts", n_questions=60)
