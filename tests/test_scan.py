"""Scans and quantiles against plain Python, with hot groups, hot instants, nulls and ties."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import scan


def rows(n, seed=1):
    r = random.Random(seed)
    # a group with most rows, a null group, and one instant that a third of the rows share
    return [(None if k % 50 == 0 else "hot" if k % 7 else f"g{k % 5}", 500 if k % 3 == 0 else r.randrange(1000), k, r.randrange(-5, 9)) for k in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(3000), "g string, t long, id long, x long").repartition(5)


def by_group(data, grouped):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0] if grouped else None, []).append(r)
    return out


@pytest.mark.parametrize("by", [[], ["g"]])
def test_previous_running_and_rank(table, by):
    t = scan.ranged(table, ["t", "id"], by, 6)
    got = {r.id: r.previous for r in scan.with_previous(t, "t", ["t", "id"], by).collect()}
    sums = {r.id: (r.s, r.n) for r in scan.with_running(t, {"s": F.col("x"), "n": F.lit(1)}, ["t", "id"], by).collect()}
    earlier = {r.id: r.s for r in scan.with_running(t, {"s": F.col("x")}, ["t", "id"], by, before=True).collect()}
    ranks = {r.id: r.rank for r in scan.with_rank(t, ["t", "id"], by).collect()}
    for own in by_group(rows(3000), bool(by)).values():
        last, total = None, 0
        for k, (_, at, key, x) in enumerate(own):
            assert got[key] == last and earlier[key] == total
            last, total = at, total + x
            assert sums[key] == (total, k + 1) and ranks[key] == k + 1


def test_a_null_value_is_carried_as_null(spark):
    t = scan.ranged(spark.createDataFrame([(k, None if k % 4 == 3 else k) for k in range(40)], "k long, v long"), ["k"], parts=8)
    got = {r.k: r.previous for r in scan.with_previous(t, "v", ["k"]).collect()}
    assert got == {k: None if k == 0 or k % 4 == 0 else k - 1 for k in range(40)}


def test_no_task_holds_a_hot_day_or_instant(spark):
    """All rows on one day, half of them at one instant: ranges stay even."""
    df = spark.range(40_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 86_400).alias("t"))
    for by in ([], ["day"]):
        t = scan.ranged(df.withColumn("day", F.lit("2024-01-01")), ["t", "id"], by, 16)
        sizes = [r["count"] for r in t.groupBy(scan.RANGE).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16


def linear(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    k = int(at)
    return v[k] + (at - k) * (v[min(k + 1, len(v) - 1)] - v[k])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_against_sorting(table, by):
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {(r.g if by else None): r for r in scan.quantiles(table, "t", probs, by).collect()}
    groups = by_group(rows(3000), bool(by))
    assert set(got) == set(groups)
    for g, own in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(linear([r[1] for r in own], p))


def test_weighted_quantiles(spark):
    r = random.Random(4)
    data = [(f"g{k % 3}", r.choice([0.5, 1.5, 2.5, 9.0, -3.0]), r.randrange(0, 4)) for k in range(400)]
    df = spark.createDataFrame(data, "g string, v double, w long")
    got = {x.g: x for x in scan.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 1.0}, ["g"], "least", "w").collect()}
    for g in got:
        own = sorted((v, w) for h, v, w in data if h == g and w)
        total = sum(w for _, w in own)
        for name, p in (("a", 0.1), ("b", 0.5), ("c", 1.0)):
            run = 0
            for v, w in own:
                run += w
                if run >= p * total:
                    break
            assert got[g][name] == v


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    assert [(r.g, r.p) for r in scan.quantiles(df, "v", {"p": 0.5}, ["g"]).collect()] == [("b", 1.0)]
    report = df.groupBy("g").agg(F.count("*").alias("n"))
    assert {r.g: r.p for r in scan.with_quantiles(report, df, "v", {"p": 0.5}, ["g"]).collect()} == {"a": None, "b": 1.0}
    assert scan.quantiles(df.limit(0), "v", {"p": 0.5}, ["g"]).collect() == []


def test_only_ranges_that_hold_a_rank_are_ordered(spark):
    """The median of values in no order; no aggregate holds all distinct values of a group."""
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    q = scan.quantiles(df, "v", {"p50": 0.5})
    assert q.first().p50 == 24_999.5
    plan = q._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_quantiles_and_roundings_fall_as_in_sql_at_ties(spark):
    """Times of whole microseconds, whose quantiles end half a microsecond from the sixth digit."""
    import random

    import duckdb

    from colloquy.operators import resampling as rs
    from colloquy.plans.conversation import rounded

    r = random.Random(5)
    rows = [(k, rep, us / 3.6e9 * 3600) for k in range(120) for rep, us in enumerate([2 * r.randrange(4 * 10**9, 5 * 10**9) for _ in range(41)], 1)]
    df = spark.createDataFrame(rows, "k int, rep int, x double")
    c = duckdb.connect()
    c.execute("CREATE TABLE t AS SELECT * FROM (SELECT unnest(?) AS k, unnest(?) AS x)", [[a for a, _, _ in rows], [x for _, _, x in rows]])
    want = {a[0]: a[1:] for a in c.execute("SELECT k, quantile_cont(x, 0.025), quantile_cont(x, 0.975), round(quantile_cont(x, 0.025), 6), round(quantile_cont(x, 0.975), 6) FROM t GROUP BY 1").fetchall()}
    for got in (rs.percentile_interval(df, ["k"], "x"), scan.quantiles(df, "x", {"low": 0.025, "high": 0.975}, ["k"])):
        fine = {a.k: (a.low, a.high) for a in got.collect()}
        assert fine == {k: w[:2] for k, w in want.items()}
        assert {a.k: (a.low, a.high) for a in rounded(got).collect()} == {k: w[2:] for k, w in want.items()}
