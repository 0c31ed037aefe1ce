"""What must hold on any data: checked on the events of the smallest scale, and on published figures."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import scalars as sc
from colloquy.operators import estimators as es
from colloquy.operators import matching as mt
from colloquy.operators import survival as sv
from colloquy.operators import threads as th
from colloquy.plans.conversation import sides
from colloquy.sources import adapters as ad

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return th.thread_events(ad.comments(spark, SMALL), ad.posts(spark, SMALL)).cache()


def test_a_reply_is_one_level_below(events):
    up = events.select(F.col("comment_id").alias("p"), F.col("depth").alias("pd"))
    odd = events.join(up, F.col("parent_id") == F.col("p")).where("not (depth <=> pd + 1)")
    assert odd.count() == 0
    assert events.where("parent_id is null and depth <> 1").count() == 0


def test_children_are_the_replies_with_a_parent(events):
    assert events.agg(F.sum("n_children")).first()[0] == events.where("parent_type = 'comment'").count()


def test_events_are_at_most_units(events):
    u = sv.survival_units(events)
    n, k = u.agg(F.count("*"), F.sum("event_observed")).first()
    assert 0 < k <= n <= events.count()
    report = sv.grouping_report(u, {"category": "submolt_category"})
    total = report.groupBy("group_family").agg(F.sum("n_units").alias("n"), F.sum("n_events").alias("k")).collect()
    assert {(r.n, r.k) for r in total} == {(n, k)}


def test_survival_never_rises(events):
    s = [r.survival for r in sv.kaplan_meier(sv.survival_units(events)).orderBy("t_seconds").collect()]
    assert all(a >= b for a, b in zip(s, s[1:])) and 0 <= s[-1] <= s[0] <= 1


def test_pairs_are_the_smaller_side_of_each_stratum(spark):
    a, b = mt.overlap(*sides(spark, SMALL, False))
    assert mt.matched_pairs(a, b).count() == (mt.strata_counts(a, b).agg(F.sum("n_pairs")).first()[0] or 0)


def test_published_half_lives(spark):
    """Fitted rates and the half-lives reported with them."""
    for alpha, beta, hours in ((5.08585, 52.2088, 0.0132764), (0.130153, 0.265916, 2.60664)):
        assert math.log(2) / beta == pytest.approx(hours, rel=1e-5)
        p = spark.range(1).select(sc.reply_probability(F.lit(alpha), F.lit(beta)), sc.conditional_quantile(F.lit(alpha), F.lit(beta), 0.5)).first()
        assert p[0] == pytest.approx(1 - math.exp(-alpha / beta))
        # half of the replies that come have come by then
        h = alpha / beta * (1 - math.exp(-beta * p[1]))
        assert 1 - math.exp(-h) == pytest.approx(p[0] / 2)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 50), st.booleans()), min_size=5, max_size=60), st.floats(0.1, 10))
def test_fits_scale_with_time(rows, c):
    s, d = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows])
    if d.sum() < 3 or np.ptp(s[d == 1]) < 0.1:
        return
    k1, l1, _ = es.weibull(s, d)
    k2, l2, _ = es.weibull(s * c, d)
    assert k2 == pytest.approx(k1, rel=1e-3) and l2 == pytest.approx(l1 * c, rel=1e-3)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=40))
def test_fisher_share_is_a_share(y):
    _, p = es.periodogram(np.array(y), 4)
    g = es.fisher_g(p)
    assert math.isnan(g) or 0 < g <= 1 + 1e-9


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40))
def test_sign_test_is_symmetric(a, b):
    p = es.sign_test_p(a, b)
    assert math.isnan(p) if a + b == 0 else p == es.sign_test_p(b, a) and 0 < p <= 1


def test_no_evidence_without_a_gap(spark):
    """Steps below the threshold make no gap, and then, as in SQL, no table has a row."""
    from colloquy.operators import segments as sg

    t = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, 0, k)) for k in range(9)], "k long, ts timestamp_ntz")
    tables = {"a": (t, "ts", "k"), "b": (t.where("k in (0, 8)"), "ts", "k")}
    assert sg.gap_evidence(tables, sg.primary_gap(t, "ts", "k", 0.25)).collect() == []
    got = sg.gap_evidence(tables, sg.primary_gap(t.where("k not in (3, 4, 5)"), "ts", "k", 0.05)).collect()
    assert {r.table_name: r.rows_in_gap for r in got} == {"a": 3, "b": 0}
