"""Every query: against its DuckDB statement, or run to the end where there is none."""

import pytest

from colloquy.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(same_rows, name):
    same_rows(QUERIES[name], ORACLES[name])


#: Rows that queries without a statement must give at least, and columns that must lie in a range.
WITHOUT = {
    "exp_mle": (5, {"reply_probability": (0, 1), "beta": (0, 1e6)}), "weibull_mle": (5, {"shape": (0.01, 100)}), "weibull_conditional": (5, {"shape": (0.01, 100)}), "reply_dynamics": (9, {"implied_eventual_reply_probability": (0, 1)}),
    "bootstrap_half_life": (1, {"n_reps": (400, 400)}), "bootstrap_weibull_shape": (1, {"n_reps": (400, 400), "median": (0.01, 100)}), "paired_tests": (4, {"wilcoxon_p": (0, 1), "sign_p": (0, 1)}),
    "cloglog_glm": (4, {"se_two_way": (0, 100), "predicted": (0, 1)}), "welch_psd": (1, {"p_value": (0, 1), "fisher_g": (0, 1)}), "spectrum_by_bin_width": (3, {"p_value": (0, 1)}), "power_curve": (8, {"power": (0, 1)}), "matched_half_life": (1, {"half_life_hours": (0, 1e9), "low": (0, 1e9), "n_reps": (400, 400)}),
}


def test_every_query_has_a_statement_or_a_test():
    assert set(QUERIES) - set(ORACLES) == set(WITHOUT)


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_values_without_a_statement(spark, name):
    least, ranges = WITHOUT[name]
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) >= least
    for c, (low, high) in ranges.items():
        known = [r[c] for r in rows if r[c] is not None]
        assert known and all(low <= x <= high for x in known), c


def durations(df, by):
    """By group: durations and events of units in hand."""
    import numpy as np

    out = {}
    for r in df.collect():
        out.setdefault(r[by], []).append((r.duration_hours, r.event_observed))
    return {g: (np.array([s for s, _ in v]), np.array([d for _, d in v], float)) for g, v in out.items()}


def test_fits_of_the_queries_against_durations_in_hand(spark):
    import math

    from colloquy.operators import estimators as es
    from colloquy.plans.conversation import family_units, units

    u = units(spark, SMALL)
    own = durations(u, "submolt_category")
    for r in QUERIES["exp_mle"](spark, SMALL).collect():
        a, b, ll = es.exponential_kernel(*own[r.submolt_category])
        assert (r.alpha, r.beta, r.half_life_hours) == pytest.approx((a, b, math.log(2) / b), abs=1e-6, rel=1e-6) and r.log_likelihood == pytest.approx(ll, abs=1e-5)
        assert r.reply_probability == pytest.approx(1 - math.exp(-a / b), abs=1e-6)
    for name, known in (("weibull_mle", own), ("weibull_conditional", durations(u.where("event_observed = 1"), "submolt_category"))):
        for r in QUERIES[name](spark, SMALL).collect():
            assert (r.shape, r.scale) == pytest.approx(es.weibull(*known[r.submolt_category])[:2], abs=1e-5, rel=1e-5)
    families = durations(family_units(spark, SMALL).selectExpr("concat_ws('|', group_family, group_label) g", "duration_hours", "event_observed"), "g")
    for r in QUERIES["reply_dynamics"](spark, SMALL).collect():
        a, b, _ = es.exponential_kernel(*families[f"{r.group_family}|{r.group_label}"])
        assert r.half_life_hours == pytest.approx(math.log(2) / b, rel=1e-5) and r.implied_eventual_reply_probability == pytest.approx(1 - math.exp(-a / b), abs=1e-5)


def test_bootstrap_fits_of_the_queries_against_weights(spark):
    import numpy as np

    from colloquy.operators import estimators as es
    from colloquy.operators import resampling as rs
    from colloquy.plans.conversation import units

    rows = units(spark, SMALL).where("not excluded_censor_boundary").select("thread_id", "duration_hours", "event_observed").collect()
    threads = sorted({r.thread_id for r in rows})
    at = np.searchsorted(threads, [r.thread_id for r in rows])
    s, d = np.array([r.duration_hours for r in rows]), np.array([r.event_observed for r in rows], float)
    w = rs.weights(len(threads), 400, 1, 0)[1:, at]
    fits = np.array([es.exponential_kernel(s[x > 0], d[x > 0], x[x > 0])[1] for x in w])
    r = QUERIES["bootstrap_half_life"](spark, SMALL).first()
    assert (r.low, r.median, r.high) == pytest.approx(tuple(np.quantile(np.log(2) / fits, [0.025, 0.5, 0.975])), rel=1e-5, abs=1e-6) and r.n_reps == 400
    fits = np.array([es.weibull(s[x > 0], d[x > 0], x[x > 0])[0] for x in w])
    r = QUERIES["bootstrap_weibull_shape"](spark, SMALL).first()
    assert (r.low, r.median, r.high) == pytest.approx(tuple(np.quantile(fits, [0.025, 0.5, 0.975])), abs=1e-5)


def test_regression_solves_its_equations(spark):
    """Sums of scores at the estimates are 0, and the means are those of the rows."""
    import math

    import numpy as np
    from pyspark.sql import functions as F

    from colloquy.functions import scalars as sc
    from colloquy.plans.conversation import labelled_units

    got = {r.term: r for r in QUERIES["cloglog_glm"](spark, SMALL).collect()}
    rows = labelled_units(spark, SMALL).where("comment_agent_id is not null").select("submolt_category", sc.claim_label(F.col("is_claimed"), "primary").alias("claim"), "event_observed").collect()
    names = [n for n in got if n != "mean_incidence"]
    x = np.array([[1.0 if n == "intercept" else float(f"submolt_category[{r.submolt_category}]" == n or f"claim[{r.claim}]" == n) for n in names] for r in rows])
    y, hz = np.array([r.event_observed for r in rows]), np.exp(x @ np.array([got[n].estimate for n in names]))
    p = 1 - np.exp(-hz)
    assert np.abs(x.T @ ((y - p) * hz * (1 - p) / (p * (1 - p)))).max() < 1e-2
    assert got["mean_incidence"].observed == pytest.approx(y.mean(), abs=1e-6) and got["mean_incidence"].predicted == pytest.approx(p.mean(), abs=1e-5)
    assert all(r.n_units == len(rows) and r.note.startswith("two_way") for r in got.values())
    z = got["intercept"].z
    assert got["intercept"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_spectra_against_segments_written_out(spark):
    import numpy as np

    from colloquy.operators import timeseries as ts
    from colloquy.sources import adapters as ad

    y = np.array([r.y for r in ts.detrended(ts.binned_counts(ad.comments(spark, SMALL), "created_at_utc", 15)).orderBy("bin").collect()])
    n, window = 128, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 128)
    power = np.zeros(65)
    starts = range(0, len(y) - n + 1, 64)
    for a in starts:
        part = (y[a : a + n] - y[a : a + n].mean()) * window
        power += np.array([abs(sum(part * np.exp(-2j * np.pi * k * np.arange(n) / n))) ** 2 for k in range(65)])
    power *= 2 / len(starts) / (4 * (window**2).sum())
    f = np.arange(65) * 4 / n
    r = QUERIES["welch_psd"](spark, SMALL).first()
    assert r.target_power == pytest.approx(power[np.argmin(abs(f[1:] - 0.25)) + 1], abs=1e-6)
    away = abs(f[1:] - 0.25) > 0.03
    power[64] /= 2
    assert r.background_power == pytest.approx(np.median(power[1:][away]), abs=1e-6)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
