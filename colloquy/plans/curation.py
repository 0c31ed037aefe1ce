"""Queries for curation, checks, JSON, files, sets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import scalars as sc
from colloquy.operators import quality as ql
from colloquy.operators import scan
from colloquy.operators import timeseries as ts
from colloquy.plans.conversation import rounded
from colloquy.plans.registry import VIEWS, query
from colloquy.sources import adapters as ad
from colloquy.sources import feeds, files
from colloquy.sources.scratch import shared_path, written


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1")
def dedupe_latest(spark, d):
    t = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return ql.latest_state(t, "l_orderkey", [F.col("l_shipdate").desc_nulls_last(), F.desc("l_linenumber"), F.desc("l_partkey"), F.desc("l_suppkey")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def keep_first(spark, d):
    t = ad.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ql.keep_first(t, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""SELECT 'orders' AS ref, count(*) AS n_refs, count_if(o_orderkey IS NULL) AS n_orphans, round(count_if(o_orderkey IS NULL)::DOUBLE / count(*), 6) AS orphan_rate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'part', count(*), count_if(p_partkey IS NULL), round(count_if(p_partkey IS NULL)::DOUBLE / count(*), 6) FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def fk_orphans(spark, d):
    line = ad.table(spark, d, "lineitem")
    a = ql.orphan_rate(line, "l_orderkey", ad.table(spark, d, "orders"), "o_orderkey").withColumn("ref", F.lit("orders"))
    b = ql.orphan_rate(line, "l_partkey", ad.table(spark, d, "part"), "p_partkey").withColumn("ref", F.lit("part"))
    return rounded(a.unionByName(b))


@query(VIEWS + "SELECT count_if(parent_id IS NOT NULL) AS n_refs, count_if(parent_type = 'unknown') AS n_orphans, round(count_if(parent_type = 'unknown')::DOUBLE / count_if(parent_id IS NOT NULL), 6) AS orphan_rate FROM te")
def parent_completeness(spark, d):
    c = ad.comments(spark, d)
    return rounded(ql.orphan_rate(c, "parent_id", c, "comment_id"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS day, sum(n)::BIGINT AS n_rows, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS n_duplicate_rows, sum(n - 1)::BIGINT AS n_extra_rows FROM (SELECT date_trunc('month', l_shipdate) AS l_shipdate, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def uniqueness_by_day(spark, d):
    return ql.uniqueness_by_day(ad.table(spark, d, "lineitem"), "l_orderkey", F.date_format("l_shipdate", "yyyy-MM"))


RAW = "CASE WHEN event_id % 50 = 0 THEN 'bad-' || (event_id % 7)::VARCHAR WHEN event_id % 31 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"


def raw_times(spark, d) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 50 == 0, F.concat(F.lit("bad-"), (k % 7).cast("string"))).when(k % 31 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return ad.table(spark, d, "events").select("event_id", raw.alias("raw"))


@query(f"""WITH r AS (SELECT {RAW} AS raw FROM events), p AS (SELECT raw, try_cast(raw AS TIMESTAMP) AS t FROM r)
SELECT count(raw) AS n_raw, count(t) AS n_ok, count_if(raw IS NOT NULL AND t IS NULL) AS n_failed, round(count(t)::DOUBLE / count(raw), 6) AS rate,
array_to_string((SELECT list(raw ORDER BY raw) FROM (SELECT DISTINCT raw FROM p WHERE raw IS NOT NULL AND t IS NULL ORDER BY raw LIMIT 5)), ',') AS failing FROM p""")
def parse_stats(spark, d):
    t = ql.parse_stats(raw_times(spark, d), "raw", sc.utc_timestamp(F.col("raw")))
    return rounded(t.withColumn("failing", F.array_join("failing", ",")))


@query(f"""WITH p AS (SELECT {RAW} AS raw, try_cast({RAW} AS TIMESTAMP) AS t FROM events), c AS (SELECT CASE WHEN r >= 0.99 THEN 'PASS' WHEN r >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT count(t)::DOUBLE / count(raw) AS r FROM p)
UNION ALL SELECT CASE WHEN r > 0.01 THEN 'FAIL' WHEN r > 0 THEN 'WARN' ELSE 'PASS' END FROM (SELECT avg((o_orderkey IS NULL)::INT) AS r FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM events)
SELECT count_if(status = 'PASS') AS n_pass, count_if(status = 'WARN') AS n_warn, count_if(status = 'FAIL') AS n_fail, CASE WHEN count_if(status = 'FAIL') > 0 THEN 'FAIL' WHEN count_if(status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM c""")
def quality_rollup(spark, d):
    a = ql.parse_stats(raw_times(spark, d), "raw", sc.utc_timestamp(F.col("raw"))).select(ql.rate_status(F.col("rate")).alias("status"))
    b = ql.orphan_rate(ad.table(spark, d, "lineitem"), "l_orderkey", ad.table(spark, d, "orders"), "o_orderkey").select(ql.orphan_status(F.col("orphan_rate")).alias("status"))
    c = ad.table(spark, d, "events").agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("status"))
    return ql.roll_up(a.unionByName(b).unionByName(c))


@query("SELECT count(*) AS n, count_if(l_shipdate < o_orderdate - INTERVAL 300 SECOND) AS n_violations, count_if(o_orderkey IS NULL) AS n_unmatched FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def chronology(spark, d):
    return ql.chronology(ad.table(spark, d, "lineitem"), "l_orderkey", "l_shipdate", ad.table(spark, d, "orders"), "o_orderkey", "o_orderdate")


@query("SELECT count_if(last < first) AS n_backwards, count_if(last > TIMESTAMP '2024-01-20') AS n_future FROM (SELECT user_id, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1)")
def monotonicity(spark, d):
    t = ad.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return t.agg(F.count_if(F.col("last") < F.col("first")).alias("n_backwards"), F.count_if(F.col("last") > F.to_timestamp_ntz(F.lit("2024-01-20"))).alias("n_future"))


MADE_JSON = """CASE event_id % 5 WHEN 0 THEN '{"id":' || event_id::VARCHAR || ',"tags":["a",1],"by":{"name":"x"}}' WHEN 1 THEN '{"id":"' || event_id::VARCHAR || '","ok":true,"tags":[]}'
WHEN 2 THEN '{"id":null,"score":' || (event_id % 7)::VARCHAR || '.7,"ok":false}' WHEN 3 THEN '{"score":3,"by":"y"}' ELSE 'not json' END"""


def made_json(spark, d) -> DataFrame:
    """Objects of several shapes by event id, and texts that are no JSON."""
    k = F.col("event_id")
    text = k.cast("string")
    made = (
        F.when(k % 5 == 0, F.concat(F.lit('{"id":'), text, F.lit(',"tags":["a",1],"by":{"name":"x"}}'))).when(k % 5 == 1, F.concat(F.lit('{"id":"'), text, F.lit('","ok":true,"tags":[]}')))
        .when(k % 5 == 2, F.concat(F.lit('{"id":null,"score":'), (k % 7).cast("string"), F.lit('.7,"ok":false}'))).when(k % 5 == 3, '{"score":3,"by":"y"}').otherwise("not json")
    )
    return ad.table(spark, d, "events").select("event_id", "event_type", made.alias("json"))


@query(f"""WITH j AS (SELECT event_type, {MADE_JSON} AS json FROM events), o AS (SELECT event_type, json, count(*) OVER (PARTITION BY event_type) AS total FROM j WHERE json_valid(json)),
k AS (SELECT *, unnest(json_keys(json)) AS key FROM o), v AS (SELECT *, json_type(json, '$."' || key || '"') AS t FROM k),
y AS (SELECT event_type, key, total, CASE t WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' ELSE 'array' END AS type FROM v)
SELECT event_type, key, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) = max(total) AS in_all FROM y GROUP BY 1, 2""")
def json_key_discovery(spark, d):
    """Keys of objects of several shapes, with the JSON types that their values take."""
    t = ql.json_keys(made_json(spark, d), "json", ["event_type"])
    return t.select("event_type", "key", "n", F.array_join("types", ",").alias("types"), "in_all")


NESTED_JSON = """CASE event_id % 6 WHEN 0 THEN '{"id":' || event_id::VARCHAR || ',"by":{"name":"x","tags":["a",1,{"k":null}]},"posts":[{"id":1,"score":2.5},{"id":"s"}]}' WHEN 1 THEN '{"id":"' || event_id::VARCHAR || '","by":"y","posts":[]}'
WHEN 2 THEN '[{"id":1,"by":{"name":null}},{"id":2},"text",[true]]' WHEN 3 THEN 'not json' WHEN 4 THEN '{"posts":[{"id":3},{"id":4},{"id":5},{"id":6}],"by":{}}' ELSE '7' END"""


def nested_json(spark, d) -> DataFrame:
    """Documents of several shapes and depths by event id."""
    k, text = F.col("event_id"), F.col("event_id").cast("string")
    made = (
        F.when(k % 6 == 0, F.concat(F.lit('{"id":'), text, F.lit(',"by":{"name":"x","tags":["a",1,{"k":null}]},"posts":[{"id":1,"score":2.5},{"id":"s"}]}'))).when(k % 6 == 1, F.concat(F.lit('{"id":"'), text, F.lit('","by":"y","posts":[]}')))
        .when(k % 6 == 2, '[{"id":1,"by":{"name":null}},{"id":2},"text",[true]]').when(k % 6 == 3, "not json").when(k % 6 == 4, '{"posts":[{"id":3},{"id":4},{"id":5},{"id":6}],"by":{}}').otherwise("7")
    )
    return ad.table(spark, d, "events").select("event_type", made.alias("json"))


@query(f"""WITH j AS (SELECT event_type, {NESTED_JSON} AS json FROM events),
t AS (SELECT event_type, CASE WHEN json_valid(json) THEN json END AS json FROM j),
n AS (SELECT event_type, regexp_replace(regexp_replace(fullkey, '"', '', 'g'), '\\[[0-9]+\\]', '[]', 'g') AS path, regexp_replace(regexp_replace(x.path, '"', '', 'g'), '\\[[0-9]+\\]', '[]', 'g') AS up, x.key IS NOT NULL AND x.parent IS NOT NULL AND NOT regexp_matches(fullkey, '\\]$') AS member,
  CASE x.type WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' ELSE 'array' END AS type
  FROM t, json_tree(t.json) x WHERE t.json IS NOT NULL AND NOT regexp_matches(fullkey, '\\[([3-9]|[0-9][0-9]+)\\]')
  UNION ALL SELECT event_type, '$', NULL, false, 'invalid' FROM t WHERE t.json IS NULL),
c AS (SELECT event_type, path, CASE WHEN member THEN up END AS parent, type, count(*) AS n FROM n GROUP BY ALL),
o AS (SELECT event_type, path AS parent, sum(n)::BIGINT AS n_parents FROM c WHERE type = 'object' GROUP BY ALL)
SELECT event_type, path, sum(n)::BIGINT AS n, string_agg(type || ':' || n::VARCHAR, ',' ORDER BY type) AS types, any_value(n_parents) AS n_parents, sum(n) = any_value(n_parents) AS in_all FROM c LEFT JOIN o USING (event_type, parent) GROUP BY event_type, path, parent""")
def json_schema_discovery(spark, d):
    """Paths of nested documents with numbers of values by type; of arrays the first three elements count."""
    return ql.json_schema(nested_json(spark, d), "json", ["event_type"], 3)


@query(f"""WITH j AS (SELECT event_id, CASE WHEN json_valid(x) THEN x END AS json, x FROM (SELECT event_id, {MADE_JSON} AS x FROM events))
SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id END::BIGINT AS id, CASE event_id % 5 WHEN 2 THEN event_id % 7 WHEN 3 THEN 3 END::BIGINT AS score, CASE event_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 0 END::BIGINT AS ok,
coalesce(trunc(try_cast(value AS DOUBLE))::BIGINT, 0) AS whole, make_timestamp((event_id % 100000) * 1000000) AS at, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y') ELSE strftime(ts, '%Y-%m-%d') END AS day, value > 0 AS positive FROM j JOIN events USING (event_id)""")
def scalar_coercions(spark, d):
    """JSON members and texts as whole numbers, epoch seconds, partition days, positive durations."""
    t = made_json(spark, d).select("event_id", "json").join(ad.table(spark, d, "events").select("event_id", "ts", "value"), "event_id")
    k = F.col("event_id")
    day = F.when(k % 3 == 0, sc.partition_day(F.date_format("ts", "yyyy"), F.col("ts"))).otherwise(sc.partition_day(None, F.col("ts")))
    return t.select(
        "event_id", *(sc.json_int(F.col("json"), c).alias(c) for c in ("id", "score", "ok")), sc.int_or_zero(F.col("value").cast("string")).alias("whole"),
        sc.epoch_timestamp((k % 100_000).cast("string")).cast("timestamp_ntz").alias("at"), day.alias("day"), sc.positive_minutes(F.col("value")).isNotNull().alias("positive"),
    )


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN (event_id % 9)::VARCHAR END AS first_present FROM events")
def json_fields(spark, d):
    """A member as a whole number, and the first present of two keys, which may be null."""
    k = F.col("event_id")
    made = F.when(k % 2 == 0, F.concat(F.lit('{"id":'), (k % 9).cast("string"), F.lit(',"post_id":"p"}'))).otherwise(F.lit('{"id":null,"post_id":"p"}'))
    return ad.table(spark, d, "events").select("event_id", sc.int_or_null(F.get_json_object("props", "$.k")).alias("k"), sc.first_present(made, ["id", "post_id"]).alias("first_present"))


@query("SELECT event_type AS endpoint, count(*) AS n_calls, count_if(event_id % 40 <> 0) AS n_ok, round(1 - count_if(event_id % 40 <> 0)::DOUBLE / count(*), 6) AS failure_rate, sum(event_id % 1000)::BIGINT AS bytes, round(avg(value), 6) AS mean_latency_ms, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS elapsed_seconds FROM events GROUP BY 1")
def request_summary(spark, d):
    k = F.col("event_id")
    log = ad.table(spark, d, "events").select(F.col("event_type").alias("endpoint"), F.when(k % 40 == 0, 503).otherwise(200).alias("http_status"), (k % 1000).alias("bytes"), F.col("value").alias("latency_ms"), F.col("ts").alias("retrieved_at_utc"))
    return rounded(ql.request_summary(log))


@query("SELECT count(*) AS n_days, round(avg(b), 6) AS mean_bytes_per_day, round(avg(b) * 30, 6) AS projected_bytes FROM (SELECT ts::DATE AS day, sum(event_id % 1000) AS b FROM events GROUP BY 1)")
def campaign_projection(spark, d):
    daily = ad.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("event_id") % 1000).alias("bytes"))
    return rounded(ql.campaign_projection(daily))


@query("SELECT count(*) AS n, count_if(event_type NOT IN ('click', 'view')) AS n_bad_sort, count_if(r > 100) AS n_bad_rank, 0::BIGINT AS n_null_ids FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS r FROM events)")
def feed_invariants(spark, d):
    e = ad.table(spark, d, "events").select("event_type", "ts", "event_id", F.window("ts", "1 day")["start"].alias("day"))
    by, order = ["event_type", "day"], ["ts", "event_id"]
    feed = scan.with_rank(scan.ranged(e, order, by), order, by).select(F.col("event_type").alias("sort"), "rank", F.col("event_id").alias("post_id"))
    return ql.feed_invariants(feed, ["click", "view"], 100)


@query(VIEWS + "SELECT thread_id AS post_id, comment_count FROM posts ORDER BY comment_count DESC, thread_id DESC LIMIT 25")
def topk_posts(spark, d):
    return ql.top_posts(ad.posts(spark, d).select(F.col("thread_id").alias("post_id"), "comment_count"), 25)


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')))::VARCHAR AS tokens FROM part")
def name_tokens(spark, d):
    return ad.table(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(F.array_sort(sc.name_tokens(F.col("p_name"))), ", "), F.lit("]")).alias("tokens"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'comment' WHEN 1 THEN 'submission' ELSE 'unknown' END AS parent_type, CASE WHEN event_id % 4 = 0 THEN event_id::VARCHAR END AS parent_comment, CASE WHEN event_id % 4 = 1 THEN event_id::VARCHAR END AS parent_submission, CASE WHEN event_id % 6 >= 3 THEN 'u' || (event_id % 6)::VARCHAR END AS author FROM events")
def parent_references(spark, d):
    k = F.col("event_id")
    ref = F.when(k % 4 == 0, F.concat(F.lit("t1_"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("t3_"), k.cast("string"))).when(k % 4 == 2, k.cast("string"))
    author = F.when(k % 6 == 0, "[deleted]").when(k % 6 == 1, " ").when(k % 6 != 2, F.concat(F.lit(" u"), (k % 6).cast("string")))
    return ad.table(spark, d, "events").select(
        "event_id", sc.parent_type(ref).alias("parent_type"), sc.parent_key(ref, "t1_").alias("parent_comment"), sc.parent_key(ref, "t3_").alias("parent_submission"), sc.known_author(author, F.lit(False)).alias("author")
    )


@query("SELECT c_custkey, CASE WHEN floor(c_acctbal / 500) <= 0 THEN '0' WHEN floor(c_acctbal / 500) <= 9 THEN '1-9' ELSE '10+' END AS followers, CASE WHEN c_acctbal <= -0.1 THEN NULL WHEN c_acctbal <= 0 THEN '0' WHEN c_acctbal <= 2 THEN '1-2' WHEN c_acctbal <= 5 THEN '3-5' WHEN c_acctbal <= 10 THEN '6-10' ELSE '11+' END AS early FROM customer")
def numeric_bins(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey", sc.follower_bin(F.floor(F.col("c_acctbal") / 500)).alias("followers"), sc.early_bin(F.col("c_acctbal")).alias("early"))


@query("SELECT l_returnflag, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS share, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def exact_quantiles(spark, d):
    t = ad.table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.count_distinct("l_partkey").alias("n_parts")
    )
    t = scan.with_quantiles(t, ad.table(spark, d, "lineitem"), "l_quantity", {"p50": 0.5, "p90": 0.9}, ["l_returnflag"])
    total = t.agg(F.sum("n").alias("total"))
    return rounded(t.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total"))


@query("SELECT key FROM (SELECT DISTINCT c_nationkey::BIGINT AS key FROM customer INTERSECT SELECT n_nationkey::BIGINT FROM nation)")
def set_intersect(spark, d):
    return ad.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("key")).intersect(ad.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key")))


@query("SELECT o_custkey % 40 AS key FROM orders EXCEPT SELECT c_nationkey FROM customer")
def set_except(spark, d):
    return ad.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("key")).subtract(ad.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("key")))


@query("SELECT o_orderstatus AS level FROM orders UNION SELECT l_linestatus FROM lineitem")
def set_union_distinct(spark, d):
    return ad.table(spark, d, "orders").select(F.col("o_orderstatus").alias("level")).union(ad.table(spark, d, "lineitem").select("l_linestatus")).distinct()


@query("SELECT 'orders' AS part, o_orderstatus AS level, count(*) AS n, NULL::DOUBLE AS mean FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_linestatus, NULL, round(avg(l_quantity), 6) FROM lineitem GROUP BY 2")
def union_rows(spark, d):
    a = ad.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("level")).agg(F.count("*").alias("n")).withColumn("part", F.lit("orders"))
    b = ad.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("level")).agg(F.avg("l_quantity").alias("mean")).withColumn("part", F.lit("lines"))
    return rounded(ql.union_rows([a, b]))


@query("SELECT row_number() OVER (ORDER BY n DESC, total DESC, o_orderpriority) AS place, o_orderpriority, o_orderstatus, n, round(total, 2) AS total FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) ORDER BY n DESC, total DESC LIMIT 8")
def sorted_strata(spark, d):
    from pyspark.sql import Window

    t = ad.table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    order = (F.desc("n"), F.desc("total"), F.asc("o_orderpriority"))
    t = t.orderBy(*order).limit(8)
    return t.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).withColumn("total", F.round("total", 2))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join(spark, d):
    rich = ad.table(spark, d, "customer").where("c_acctbal > 5000")
    o = ad.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(rich, o["o_custkey"] == rich["c_custkey"], "left_semi")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT hour(ts)::INT AS k, count(*) AS na FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT event_id % 30 AS k, count(*) AS nb FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.k = b.k")
def full_outer_levels(spark, d):
    e = ad.table(spark, d, "events")
    a = e.where("event_type = 'click'").groupBy(F.hour("ts").cast("long").alias("k")).agg(F.count("*").alias("na"))
    b = e.where("event_type = 'view'").groupBy((F.col("event_id") % 30).alias("k")).agg(F.count("*").alias("nb"))
    return a.join(b, "k", "full").select("k", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10")
def first_row_lookup(spark, d):
    t = ad.table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.count("*").alias("n"))
    return t.where("n >= 10")


@query("SELECT l_linestatus, run, n FROM (SELECT l_linestatus, l_returnflag AS run, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)")
def partitioned_run_roundtrip(spark, d):
    """Written as run_id=/dt= partitions and one run read back through partition pruning."""
    root = shared_path(spark, "runs")
    t = ad.table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.date_format("l_shipdate", "yyyy").alias("dt"))
    for run in ("A", "N", "R"):
        files.write_run(t.where(F.col("l_returnflag") == run).drop("l_returnflag"), root, "lines", run)
    back = files.read_run(spark, root, "lines", "R")
    return back.groupBy("l_linestatus", F.col("run_id").alias("run")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_roundtrip(spark, d):
    path = shared_path(spark, "csv")
    t = ad.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    files.write_csv(t, path, 12)
    return files.read_csv(spark, path, "o_orderstatus string, n long, total double").withColumn("total", F.round("total", 2))


@query("SELECT event_type AS endpoint, count(*) AS n, count_if(event_id % 40 = 0) AS n_failed FROM events GROUP BY 1")
def jsonl_roundtrip(spark, d):
    """A request log appended as compressed JSON lines and read under its schema."""
    path = shared_path(spark, "log")
    k = F.col("event_id")
    log = ad.table(spark, d, "events").select(
        k.cast("string").alias("attempt_id"), F.col("event_type").alias("endpoint"), F.create_map(F.lit("limit"), F.lit("100")).alias("params"), F.when(k % 40 == 0, 503).otherwise(200).alias("http_status"), (k % 1000).alias("bytes")
    )
    files.append_jsonl(log, path, "gzip")
    return files.read_jsonl(spark, path).groupBy("endpoint").agg(F.count("*").alias("n"), F.count_if(F.col("http_status") != 200).alias("n_failed"))


@query("SELECT 'documents' AS table_name, count(*) AS n_rows, 5::BIGINT AS n_columns FROM documents")
def footer_schema(spark, d):
    t = files.schema_of(spark, f"{d}/documents.parquet")
    return t.groupBy(F.lit("documents").alias("table_name")).agg(F.max("n_rows").alias("n_rows"), F.count("*").alias("n_columns"))


@query("SELECT n_nationkey::BIGINT AS key, n_name || ' & ' || printf('%,d', n_nationkey::BIGINT * 1000) || ' & ' || printf('%.2f', n_nationkey / 4.0::DOUBLE) || ' \\\\' AS line FROM nation".replace("\\\\\\\\", "\\\\"))
def latex_lines(spark, d):
    t = ad.table(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey").cast("long") * 1000).alias("a"), (F.col("n_nationkey") / 4.0).alias("b"))
    line = files.latex_rows(t.select("n_nationkey", "n_name", "a", "b"))
    key = F.split("line", " & ")
    return line.select(F.regexp_replace(F.get(key, F.lit(0)), ",", "").cast("long").alias("key"), F.array_join(F.slice(key, 2, 9), " & ").alias("line"))


@query("""WITH f AS (SELECT ts::DATE AS round, event_type AS sort, event_id, user_id, (event_id % 50)::INT AS comment_count, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts, event_id) AS rank FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round, sort, rank, event_id) AS k FROM f) SELECT round, sort, rank, 'post_' || user_id::VARCHAR AS post_id, comment_count FROM k WHERE k = 1""", name="stub_feed_first_seen")
def feed_first_seen(spark, d):
    """Events as polls of a feed, a round a day and a sort a type; each post (user) once, as it was first seen."""
    e = ad.table(spark, d, "events").select(F.to_date("ts").alias("round"), F.col("event_type").alias("sort"), "ts", "event_id", F.concat(F.lit("post_"), F.col("user_id").cast("string")).alias("post_id"), (F.col("event_id") % 50).cast("int").alias("comment_count"))
    by, order = ["round", "sort"], ["ts", "event_id"]
    polls = scan.with_rank(scan.ranged(e, order, by), order, by)
    first = F.min(F.struct("round", "sort", "rank", "event_id", "comment_count")).alias("r")
    return polls.groupBy("post_id").agg(first).select("r.round", "r.sort", "r.rank", "post_id", "r.comment_count")


@query("""WITH n AS (SELECT event_id, user_id, ts::DATE AS day, event_id % 29 = 0 AS nameless, first_value(event_id) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY event_id))
SELECT 'p' || user_id::VARCHAR AS post, 'e' || event_id::VARCHAR AS id, CASE WHEN event_id <> top THEN 'e' || top::VARCHAR END AS parent_id, (event_id <> top)::INT AS depth, CASE WHEN NOT nameless THEN 'a' || (event_id % 13)::VARCHAR END AS author FROM n""")
def nested_comments(spark, d):
    """Nested comment documents of users' events, the first of a day enclosing the others of that day, flattened again."""
    name = lambda k: F.concat(F.lit("e"), k.cast("string"))
    author = F.when(F.col("event_id") % 29 != 0, F.concat(F.lit("a"), (F.col("event_id") % 13).cast("string")))
    e = ad.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user"), F.to_date("ts").alias("day"), F.struct(name(F.col("event_id")).alias("id"), F.struct(author.alias("name")).alias("author")).alias("c"))
    tops = e.groupBy("user", "day").agg(F.min("event_id").alias("top"), F.min_by("c", "event_id").alias("t"))
    inner = e.join(tops, ["user", "day"]).groupBy("user", "day").agg(F.any_value("t").alias("t"), F.collect_list(F.when(F.col("event_id") != F.col("top"), F.col("c"))).alias("children"))
    # a document a user and day: one of a whole user would grow without bound
    doc = F.to_json(F.struct(F.array(F.struct("t.id", "t.author", "children")).alias("comments")))
    return feeds.flatten_comments(inner.select(F.concat(F.lit("p"), "user").alias("post"), doc.alias("json")))


WINDOW = ("2024-01-03", "2024-01-20")


@query(f"""SELECT event_id, ts, (row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS page FROM events WHERE ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}'""")
def cursor_window_scan(spark, d):
    """Events of a window in pages of 64, in the order of a cursor over (ts, event_id)."""
    low, high = (F.to_timestamp_ntz(F.lit(t)) for t in WINDOW)
    e = ad.table(spark, d, "events").where((F.col("ts") >= low) & (F.col("ts") < high)).select("event_id", "ts")
    order = ["ts", "event_id"]
    t = scan.with_rank(scan.ranged(e, order), order)
    return t.select("event_id", "ts", F.floor((F.col("rank") - 1) / 64).alias("page"))


#: Names that curated tables should have, with the columns that may hold them, and names of which one is enough.
CANDIDATES = {
    "events": {"id": ["id", "event_id"], "created_at": ["created_at", "createdAt", "timestamp", "ts"], "author_id": ["author_id", "agent_id", "user_id"], "author_name": ["author_name", "author", "username"], "content": ["content", "body", "text", "value", "props"]},
    "documents": {"id": ["doc_id", "id"], "created_at": ["created_at", "ts"], "content": ["content", "TEXT"], "community": ["submolt", "source"]},
    "conversations": {"id": ["conv_id"], "author_id": ["author_id"], "author_name": ["role"], "content": ["text"]},
}
EITHER = {"events": [["author_id", "author_name"]], "conversations": [["author_id", "author_name"]]}


@query("""SELECT * FROM (VALUES ('events', 'id', 'event_id', 'event_id', 'mapped'), ('events', 'created_at', 'ts', 'ts', 'mapped'), ('events', 'author_id', 'user_id', 'user_id', 'mapped'), ('events', 'author_name', NULL, '', 'covered'),
('events', 'content', 'value', 'value,props', 'ambiguous'), ('documents', 'id', 'doc_id', 'doc_id', 'mapped'), ('documents', 'created_at', NULL, '', 'missing'), ('documents', 'content', 'text', 'text', 'mapped'),
('documents', 'community', 'source', 'source', 'mapped'), ('conversations', 'id', 'conv_id', 'conv_id', 'mapped'), ('conversations', 'author_id', NULL, '', 'covered'), ('conversations', 'author_name', 'role', 'role', 'mapped'),
('conversations', 'content', 'text', 'text', 'mapped')) v(table_name, name, "column", matches, status), (SELECT count(*) AS n_rows FROM events)""")
def column_mapping(spark, d):
    """Which columns of the tables hold the names that curation needs, beside the number of events."""
    tables = {t: ad.table(spark, d, t) for t in CANDIDATES}
    n = ad.table(spark, d, "events").agg(F.count("*").alias("n_rows"))
    return ql.column_mapping(tables, CANDIDATES, EITHER).crossJoin(F.broadcast(n))


@query("""SELECT event_id::BIGINT AS id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 6 IN (0, 1, 2) THEN NULL ELSE 'u' || (event_id % 6)::VARCHAR END AS author_name, event_id % 6 IN (0, 2) OR event_id % 10 = 0 AS deleted, NULL::VARCHAR AS title,
'events' AS source_table, CASE WHEN value > 0 THEN CASE WHEN value < 1 THEN 'minutes' ELSE 'hours' END END AS half_life_unit FROM events""")
def curated_comments(spark, d):
    """Raw events under canonical names, required ones checked, authors and deletions told, constant columns added."""
    k = F.col("event_id")
    author = F.when(k % 6 == 0, "[deleted]").when(k % 6 == 1, " ").when(k % 6 != 2, F.concat(F.lit(" u"), (k % 6).cast("string")))
    raw = ad.table(spark, d, "events").select(k.alias("ID"), F.col("ts").alias("createdAt"), author.alias("username"), F.when(k % 10 == 0, "[removed]").otherwise("text").alias("body"), "value")
    names = {"id": ["id"], "created_at": ["created_at", "createdAt"], "author_name": ["author_name", "username"], "content": ["content", "body"], "title": ["title"], "value": ["value"]}
    t = ql.mapped_columns(raw, names, ["id", "created_at", "author_name"], "comments")
    deleted = sc.is_deleted(F.col("content"), F.col("author_name"))
    unit = F.when(F.col("value") > 0, F.when(sc.half_life_text(F.col("value")).endswith("min"), "minutes").otherwise("hours"))
    t = t.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), sc.known_author(F.col("author_name"), F.lit(False)).alias("author_name"), deleted.alias("deleted"), "title", unit.alias("half_life_unit"))
    return sc.with_metadata(t, source_table="events")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def distinct_counts(spark, d):
    return ad.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT n_comments AS value, n FROM (SELECT n AS n_comments, count(*) AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1)")
def written_step(spark, d):
    """A step that is written and read again, as derived tables are between stages."""
    t = written(ad.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("value")))
    return t.groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT value, round(max(e), 6) AS ecdf FROM (SELECT round(value, 0) AS value, cume_dist() OVER (ORDER BY round(value, 0)) AS e FROM events) GROUP BY 1")
def ecdf_values(spark, d):
    return rounded(ts.ecdf(ad.table(spark, d, "events").select(F.round("value", 0).alias("value")), "value"))
