import pytest
from pyspark.sql import functions as F

from colloquy.functions import scalars as sc
from colloquy.operators import matching as mt
from colloquy.operators import quality as ql
from colloquy.operators import timeseries as ts


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_categories(spark):
    names = [("crypto-dev",), ("Storytelling",), ("",), (None,), ("Ponderings!",), ("dev tools",), ("xyz",)]
    assert values(spark, names, "n string", sc.keyword_category(F.col("n"))) == ["Spam/Low-Signal", "Creative", "Other", "Other", "Philosophy/Meta", "Builder/Technical", "Other"]
    assert values(spark, [("Storytelling",), ("ai club",)], "n string", sc.keyword_category(F.col("n"), "expanded", True)) == ["Other", "Builder/Technical"]


def test_bins_are_closed_on_the_right(spark):
    assert values(spark, [(0,), (9,), (10,), (None,)], "n int", sc.follower_bin(F.col("n"))) == ["0", "1-9", "10+", None]
    assert values(spark, [(0,), (2,), (3,), (10,), (11,), (None,)], "n int", sc.early_bin(F.col("n"))) == ["0", "1-2", "3-5", "6-10", "11+", None]


def test_references(spark):
    rows = [("t1_x",), ("t3_y",), ("y",), ("",), (None,)]
    assert values(spark, rows, "p string", sc.parent_type(F.col("p"))) == ["comment", "submission", "unknown", "unknown", "unknown"]
    assert values(spark, rows, "p string", sc.parent_key(F.col("p"), "t1_")) == ["x", None, None, None, None]


def test_json_members(spark):
    rows = [('{"author":{"name":"a"}}',), ('{"author":"b"}',), ("{}",)]
    assert values(spark, rows, "j string", sc.name_or_text(F.col("j"), "author")) == ["a", "b", None]
    rows = [('{"id":null,"post_id":"p"}',), ('{"post_id":"p"}',)]
    assert values(spark, rows, "j string", sc.first_present(F.col("j"), ["id", "post_id"])) == [None, "p"]
    assert values(spark, [("[1]",), ('{"data":[2]}',), ('{"x":1}',)], "j string", sc.list_member(F.col("j"), ["posts", "data"])) == ["[1]", "[2]", None]
    assert values(spark, [("3",), ("3.5",), ("true",), ("null",), ("[]",), ("{}",), ("x",)], "j string", sc.json_type(F.col("j"))) == ["int", "float", "bool", "null", "array", "object", "str"]


def test_times(spark):
    got = values(spark, [("2024-01-01T00:00:00Z",), ("nonsense",), (None,)], "t string", sc.utc_timestamp(F.col("t")).isNotNull())
    assert got == [True, False, False]
    assert values(spark, [("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",)], "t string", sc.strict_utc_timestamp(F.col("t")).isNotNull()) == [True, False]
    assert values(spark, [("3",), ("3.7",), ("x",)], "t string", sc.int_or_null(F.col("t"))) == [3, None, None]


def test_claims(spark):
    rows = [(1,), (0,), (None,), (2,)]
    got = {v: values(spark, rows, "c int", sc.claim_label(F.col("c"), v)) for v in ("primary", "two_part", "strict")}
    assert got == {
        "primary": ["Claimed", "Unclaimed", "Unclaimed", "Unclaimed"],
        "two_part": ["Claimed", "Unclaimed", "Unknown", "Unclaimed"],
        "strict": ["Claimed", "Unclaimed", "Unknown", "Unknown"],
    }


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 9.0, 10.0)], "x double")
    r = df.agg(F.percentile("x", 0.1), F.percentile("x", 0.5), F.percentile("x", 0.9)).first()
    assert list(r) == pytest.approx([1.4, 4.0, 9.6])


def test_weighted_quantiles_do_not(spark):
    df = spark.createDataFrame([(1, 0), (2, 2), (3, 0), (4, 1)], "x long, w long").withColumn("g", F.lit("a"))
    r = ql.weighted_quantiles(df, "x", "w", [0.5, 0.9], ["g"]).first()
    assert (r.p50, r.p90) == (2, 4)


def test_even_rolling_window(spark):
    df = spark.range(20).select(F.col("id").alias("bin"), F.col("id").alias("n"))
    t = {r.bin: r for r in ts.detrended(df, 6).collect()}
    import math

    y = [math.log1p(k) for k in range(20)]
    d = [y[k] - sum(y[max(0, k - 3) : k + 3]) / len(y[max(0, k - 3) : k + 3]) for k in range(20)]
    assert [t[k].y for k in range(20)] == pytest.approx([x - sum(d) / 20 for x in d])


def test_latest_state_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("a", None, 3), ("b", None, 4), ("b", None, 5)], "k string, d string, v long")
    got = {r.k: r.v for r in ql.latest_state(df, "k", [F.col("d").desc_nulls_last(), F.desc("v")]).collect()}
    assert got == {"a": 2, "b": 5}


def test_pairs_are_the_smaller_side(spark):
    schema = "thread_id long, topic string, hour int, early_bin string, early_comments long, post_created_at_utc timestamp_ntz, n_comments long, depth_max int, n_unique_agents long, thread_duration_hours double, reentry_rate double"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    row = lambda k, topic: (k, topic, 1, "0", 0, t + dt.timedelta(minutes=k), k, 1, 1, 1.0, 0.0)
    a = spark.createDataFrame([row(k, x) for k, x in enumerate("aaabcc")], schema)
    b = spark.createDataFrame([row(10 + k, x) for k, x in enumerate("aabbbb")], schema)
    pairs = mt.matched_pairs(*mt.overlap(a, b)).orderBy("pair_id").collect()
    assert [(p.pair_id, p.topic, p.thread_id_a, p.thread_id_b) for p in pairs] == [(1, "a", 0, 10), (2, "a", 1, 11), (3, "b", 3, 12)]
    assert [p.diff_n_comments for p in pairs] == [-10.0, -10.0, -9.0]
