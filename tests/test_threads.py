"""Hand-written trees: each pins one rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.operators import segments as sg
from colloquy.operators import survival as sv
from colloquy.operators import threads as th

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "comment_id long, post_id long, parent_id long, comment_agent_id string, created_at_utc timestamp_ntz"


def comments(spark, rows):
    """(id, parent, author, minute)"""
    return spark.createDataFrame([(i, 1, p, a, T0 + dt.timedelta(minutes=m)) for i, p, a, m in rows], SCHEMA)


def depths(spark, rows, policy="null"):
    return {r.comment_id: r.depth for r in th.tree_depths(comments(spark, rows), policy).collect()}


def test_depths_of_a_plain_tree(spark):
    rows = [(1, None, "a", 1), (2, None, "b", 2), (3, 1, "c", 3), (4, 3, "a", 4), (5, 2, "b", 5)]
    assert depths(spark, rows) == {1: 1, 2: 1, 3: 2, 4: 3, 5: 2}
    assert depths(spark, rows, "ordered") == depths(spark, rows)


def test_orphans_and_their_replies(spark):
    rows = [(1, None, "a", 1), (2, 99, "b", 2), (3, 2, "c", 3), (4, 3, "d", 4)]
    assert depths(spark, rows) == {1: 1, 2: None, 3: None, 4: None}
    assert depths(spark, rows, "ordered") == {1: 1, 2: -1, 3: 0, 4: 1}


def test_late_parent_counts_only_without_order(spark):
    rows = [(1, 2, "a", 1), (2, None, "b", 5)]
    assert depths(spark, rows) == {1: 2, 2: 1}
    assert depths(spark, rows, "ordered") == {1: -1, 2: 1}


def test_cycles_end(spark):
    rows = [(1, 2, "a", 1), (2, 1, "b", 2), (3, 1, "c", 3), (4, None, "d", 4)]
    assert depths(spark, rows) == {1: None, 2: None, 3: None, 4: 1}


def test_long_chain(spark):
    rows = [(k, k - 1 if k > 1 else None, "a", k) for k in range(1, 60)]
    assert depths(spark, rows) == {k: k for k in range(1, 60)}


def events(spark, rows):
    c = comments(spark, rows)
    posts = spark.createDataFrame([(1, "op", "general", 0, len(rows), T0)], "thread_id long, post_agent_id string, submolt string, post_score long, comment_count long, post_created_at_utc timestamp_ntz")
    return th.thread_events(c, posts)


def test_reentry_null_and_zero(spark):
    some = th.thread_metrics(events(spark, [(1, None, None, 1), (2, None, "a", 2)])).first()
    none = th.thread_metrics(events(spark, [(1, None, None, 1)])).first()
    assert some.reentry_rate == 0 and some.n_unique_agents == 1
    assert none.reentry_rate is None and none.n_unique_agents == 0


def test_chain_of_three(spark):
    # b answers a, a answers b, b answers a; then c joins
    rows = [(1, None, "a", 1), (2, 1, "b", 2), (3, 2, "a", 3), (4, 3, "b", 4), (5, 4, "c", 5)]
    chains = th.reciprocal_chains(events(spark, rows)).collect()
    assert [c.length for c in chains] == [3]
    r = th.reciprocity(th.dyads(events(spark, rows)), []).first()
    assert (r.dyads, r.reciprocal_dyads) == (3, 1)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.05,), (0.15,), (0.35,), (1.0,)], "x double")
    h = {r.bin: r.n for r in th.unit_histogram(df, "x").collect()}
    assert sum(h.values()) == 4 and h[19] == 1 and len(h) == 20


def test_units_need_positive_durations(spark):
    u = sv.survival_units(events(spark, [(1, None, "a", 0), (2, 1, "b", 0), (3, None, "c", 300)])).collect()
    by = {r.comment_id: r for r in u}
    assert 1 not in by and 3 not in by  # replied at once; began at the end
    assert by[2].event_observed == 0 and by[2].duration_hours == 5.0 and not by[2].excluded_censor_boundary


def test_gap_threshold_is_strict(spark):
    at = [T0, T0 + dt.timedelta(hours=6), T0 + dt.timedelta(hours=12, microseconds=1), T0 + dt.timedelta(days=3)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(at)], "id long, t timestamp_ntz")
    assert sg.time_gaps(df, "t", "id", 6).count() == 2
    s = sg.segments(df, "t", "id", 6).orderBy("segment").collect()
    assert [x.n for x in s] == [2, 1, 1]
    assert sg.pick_segment(sg.segments(df, "t", "id", 6)).first().n == 2


def test_survival_curve_falls(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1), (4.0, 1)], "duration_hours double, event_observed int")
    k = [(r.t_seconds, r.at_risk, r.survival) for r in sv.kaplan_meier(df).orderBy("t_seconds").collect()]
    assert k == [(3600.0, 4, 0.75), (10800.0, 2, 0.375), (14400.0, 1, 0.0)]


def test_hazard_first_bin(spark):
    df = spark.range(100).select((F.col("id") / 600).alias("duration_hours"), F.lit(1).alias("event_observed")).where("duration_hours > 0")
    first = sv.binned_hazard(df).orderBy("bin").first()
    assert first.at_risk == 99 and first.hazard_per_hour == pytest.approx(first.n_events / (99 * 0.25 / 60))


def test_diagnostics_tell_cycles_from_missing_parents(spark):
    import datetime as dt

    at = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    rows = [(1, 1, None), (2, 1, 1), (3, 1, 99), (4, 1, 3), (5, 1, 6), (6, 1, 5), (7, 1, 6), (8, 2, 1)]
    df = spark.createDataFrame([(i, p, up, at(i)) for i, p, up in rows], "comment_id long, post_id long, parent_id long, created_at_utc timestamp_ntz")
    r = th.depth_diagnostics(df).first()
    assert (r.n_comments, r.n_roots, r.n_missing_parents, r.n_unresolved, r.n_below_missing, r.n_cycle) == (8, 1, 2, 6, 3, 3)


def test_survival_curve_against_products(spark):
    from colloquy.operators import survival as sv

    rows = [(0.001 * k * k + 1e-6, int(k % 3 != 0)) for k in range(1, 60)] + [(0.5, 1), (0.5, 0), (0.5, 1)]
    df = spark.createDataFrame(rows, "duration_hours double, event_observed int")
    got = [(r.t_seconds, r.at_risk, r.n_events, r.survival) for r in sv.kaplan_meier(df).orderBy("t_seconds").collect()]
    s, want = 1.0, []
    for t in sorted({t for t, e in rows if e}):
        n, d = sum(x >= t for x, _ in rows), sum(x == t and e for x, e in rows)
        s *= 1 - d / n
        want.append((round(t * 3600, 6), n, d, round(s, 6)))
    assert got == want


def test_differences_without_spread_are_infinite(spark):
    from pyspark.sql import functions as F

    from colloquy.operators import matching as mt

    r = spark.range(1).select(mt.smd(F.lit(2.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("a"), mt.smd(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert (r.a, r.b) == (float("inf"), 0.0)


def test_open_chains_contract(spark):
    """A long chain beside many short ones: what is written falls by round, and the depths are right."""
    chain = [(0, k, k - 1 if k else None, k) for k in range(100)]
    short = [(1 + k // 3, 1000 + k, 1000 + k - 1 if k % 3 else None, k) for k in range(3000)]
    df = spark.createDataFrame(chain + short, "post_id long, comment_id long, parent_id long, created_at_utc long")
    done, open_ = th.chains_contracted(df)
    sizes = [p.count() for p in done]
    assert open_.count() == 0 and sum(sizes) == 3100 and sizes[0] == 1001 and sizes[1] == 1001 and sizes[2] == 1000 + 2
    assert all(n <= 100 for n in sizes[3:]) and len(sizes) == 8
    got = {r.comment_id: r.depth for r in th.tree_depths(df).collect()}
    assert got == {**{k: k + 1 for k in range(100)}, **{1000 + k: k % 3 + 1 for k in range(3000)}}
