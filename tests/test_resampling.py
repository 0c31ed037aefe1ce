"""Resampling against draws written out, whole numbers of draws, blocks, and quantiles of replicates by sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import resampling as rs


def test_every_replicate_draws_exactly_n():
    for n, block in ((1, 4096), (7, 4096), (1000, 64), (1001, 64), (129, 64)):
        for rep in (1, 2, 9):
            assert sum(rs.draws_in(n, 5, rep, b, block) for b in range(-(-n // block))) == n
        w = np.concatenate([rs.weights(n, 20, 5, b, block) for b in range(-(-n // block))], axis=1)
        assert w.shape == (21, n) and (w[0] == 1).all() and (w.sum(axis=1) == n).all()


def test_counts_are_binomial():
    """Each cluster's count has mean 1 and variance 1 - 1/n, and counts of two are correlated by -1/(n - 1)."""
    n = 640
    w = np.concatenate([rs.weights(n, 3000, 2, b, 64) for b in range(10)], axis=1)[1:]
    assert w.mean() == 1 and w.var() == pytest.approx(1 - 1 / n, abs=0.01)
    assert np.mean([np.corrcoef(w[:, a], w[:, a + 320])[0, 1] for a in range(320)]) == pytest.approx(-1 / (n - 1), abs=0.004)
    halves = w[:, :320].sum(axis=1)
    assert halves.var() == pytest.approx(n / 4, rel=0.1)


def test_sql_states_the_same_draws(duck):
    ids = [f"t{k:03}" for k in range(57)]
    duck.execute("CREATE OR REPLACE TEMP TABLE fr AS SELECT 't' || lpad(k::VARCHAR, 3, '0') AS cluster FROM range(57) t(k)")
    found = duck.execute("WITH RECURSIVE one AS (SELECT 1)" + rs.draw_sql("fr", 6, 3) + "SELECT rep, cluster, w FROM w").fetchall()
    mine = rs.weights(57, 6, 3, 0)
    assert {(r, c): w for r, c, w in found} == {(r, ids[k]): int(mine[r, k]) for r in range(7) for k in range(57) if mine[r, k]}


def units(n=900, seed=2):
    r = random.Random(seed)
    # a third of the rows belong to one cluster; one cluster is null; some values are missing
    return [("a" if k % 4 else "b", None if k % 90 == 1 else 0 if k % 3 == 0 else r.randrange(60), None if k % 11 == 0 else round(r.expovariate(1), 3), k % 2) for k in range(n)]


def frames(data):
    """By group: clusters in order, null first."""
    out = {}
    for g in sorted({u[0] for u in data}):
        out[g] = sorted({u[1] for u in data if u[0] == g}, key=lambda c: (c is not None, c))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(units(), "g string, c long, v double, e long").repartition(3)


def test_ratios_against_weights(table, monkeypatch):
    data, reps = units(), 50
    got = {r.g: r for r in rs.cluster_bootstrap(table, "c", {"e": F.col("e"), "n": F.lit(1)}, {"share": ("e", "n")}, reps, 4, ("g",)).collect()}
    for g, clusters in frames(data).items():
        w = rs.weights(len(clusters), reps, 4, 0)
        at = {c: k for k, c in enumerate(clusters)}
        own = [u for u in data if u[0] == g]
        shares = [sum(w[r, at[u[1]]] * u[3] for u in own) / sum(w[r, at[u[1]]] for u in own) for r in range(reps + 1)]
        assert got[g].estimate == pytest.approx(shares[0]) and got[g].n_reps == reps
        assert (got[g].low, got[g].high) == pytest.approx(tuple(np.quantile(shares[1:], [0.025, 0.975])))


@pytest.mark.parametrize("fan", [64, 4])
def test_quantiles_of_replicates_by_sorting(table, fan):
    data, reps, probs = units(), 40, {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = {(r.g, r.metric): r for r in rs.bootstrap_quantiles(table, "c", "v", probs, reps, 4, ("g",), fan=fan).collect()}
    for g, clusters in frames(data).items():
        w = rs.weights(len(clusters), reps, 4, 0)
        at = {c: k for k, c in enumerate(clusters)}
        own = sorted((u[2], at[u[1]]) for u in data if u[0] == g and u[2] is not None)
        for name, p in probs.items():
            found = []
            for r in range(1, reps + 1):
                cum = np.cumsum([w[r, c] for _, c in own])
                found.append(own[int(np.searchsorted(cum, p * cum[-1]))][0])
            row = got[g, name]
            assert row.estimate == pytest.approx(np.quantile([v for v, _ in own], p)) and row.n_reps == reps
            assert (row.low, row.high) == pytest.approx(tuple(np.quantile(found, [0.025, 0.975])))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, None)], "g string, c long, v double")
    assert rs.bootstrap_quantiles(df, "c", "v", {"p50": 0.5}, 5, by=("g",)).collect() == []


def test_fast_replies_keep_their_seconds(spark):
    """A median of 4.55 seconds: the interval is as narrow as the data's."""
    r = np.random.default_rng(6)
    s = np.exp(r.normal(np.log(4.55), 0.6, 20_000))
    df = spark.createDataFrame([(int(k % 900), float(v / 60)) for k, v in enumerate(s)], "c long, minutes double")
    row = rs.bootstrap_quantiles(df, "c", "minutes", {"p50": 0.5}, 100).first()
    assert row.estimate == pytest.approx(np.median(s) / 60, rel=1e-12)
    assert row.low < row.estimate < row.high and (row.high - row.low) * 60 < 0.15


def test_a_hot_cluster_is_dealt_to_many_tasks(spark):
    df = spark.range(30_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)).alias("c"), F.col("id").cast("double").alias("v"))
    rows = rs.framed(df, "c", []).repartitionByRange(8, "_g", "_rank", "v")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 30_000 / 8


def test_groups_beyond_a_block_draw_as_sql_states(spark, duck):
    """A group of more clusters than BLOCK, one of fewer, and a cluster of many rows: sums of all replicates by SQL's draws."""
    reps, sizes = 6, {"a": 2 * rs.BLOCK + 808, "b": 57}
    rows = [(g, c, (c * 37 + k) % 101) for g, n in sizes.items() for c in range(n) for k in range(3000 if c == 5000 else 1 + c % 2)]
    df = spark.createDataFrame(rows, "g string, c long, v long").repartition(5)
    duck.execute("CREATE OR REPLACE TEMP TABLE fr AS SELECT * FROM (SELECT 'a' AS g, range AS cluster FROM range(?) UNION ALL SELECT 'b', range FROM range(?))", [*sizes.values()])
    weight = {(g, rep, c): w for g, rep, c, w in duck.execute("WITH RECURSIVE one AS (SELECT 1)" + rs.draw_sql("fr", reps, 3, "g,") + "SELECT g, rep, cluster, w FROM w").fetchall()}
    want = {(f'{{"g":"{g}"}}', rep): [0.0, 0.0] for g in sizes for rep in range(reps + 1)}
    for g, c, v in rows:
        for rep in range(reps + 1):
            own, w = want[f'{{"g":"{g}"}}', rep], weight.get((g, rep, c), 0)
            own[0] += w
            own[1] += w * v
    got = rs.replicate_sums(rs.framed(df, "c", ["g"]), ["v"], lambda g, v: np.column_stack((np.ones(len(v[0])), v[0])), 2, reps, 3)
    assert {(r._g, r.rep): r.x for r in got.collect()} == want
    by_block = np.concatenate([rs.weights(sizes["a"], reps, 3, b) for b in range(3)], axis=1)
    assert all(by_block[rep, c] == weight.get(("a", rep, c), 0) for rep in range(reps + 1) for c in range(sizes["a"]))
