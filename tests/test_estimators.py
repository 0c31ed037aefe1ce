import math

import numpy as np
import pandas as pd
import pytest

from colloquy.operators import estimators as es
from colloquy.operators import fits
from colloquy.operators import resampling as rs


def test_exponential_kernel_recovers_its_parameters():
    rng = np.random.default_rng(1)
    alpha, beta, n = 0.5, 2.0, 40_000
    e = rng.exponential(size=n)
    mu = alpha / beta
    t = np.where(e < mu, -np.log1p(-np.minimum(e, mu * (1 - 1e-12)) / mu) / beta, 50.0)
    d = (e < mu).astype(float)
    a, b, ll = es.exponential_kernel(np.minimum(t, 50), d)
    assert a == pytest.approx(alpha, rel=0.05) and b == pytest.approx(beta, rel=0.05)
    start = lambda a, b: (d * (math.log(a) - b * t)).sum() - a / b * -np.expm1(-b * t).sum()
    assert ll >= start(alpha, beta) - 1e-6


def test_weibull_recovers_shape_under_censoring():
    rng = np.random.default_rng(2)
    t = 3 * rng.weibull(0.7, 30_000)
    c = rng.exponential(6, 30_000)
    k, scale, _ = es.weibull(np.minimum(t, c), (t <= c).astype(float))
    assert k == pytest.approx(0.7, rel=0.05) and scale == pytest.approx(3, rel=0.05)


def test_no_events_no_fit():
    assert math.isnan(es.exponential_kernel(np.ones(3), np.zeros(3))[0])


def test_spectrum_finds_a_period():
    t = np.arange(4000) / 4
    f, p = es.welch(np.sin(2 * np.pi * t / 4), 4)
    assert f[np.argmax(p)] == pytest.approx(0.25, abs=0.02)
    phi, sigma = es.fit_ar1(es.ar1_paths(5000, 0.6, 1.0, 1, np.random.default_rng(3))[0])
    assert phi == pytest.approx(0.6, abs=0.05) and sigma == pytest.approx(1, abs=0.05)


def test_cloglog_on_two_cells(spark):
    cells = spark.createDataFrame([("a", 100, 20), ("b", 100, 50)], "g string, n long, k long")
    beta, cov, names = es.cloglog(cells, ["a"], ["g"])
    assert names == ["intercept", "g[b]"]
    link = lambda p: math.log(-math.log(1 - p))
    assert beta[0] == pytest.approx(link(0.2)) and beta[1] == pytest.approx(link(0.5) - link(0.2))
    assert (np.diag(cov) > 0).all()


def test_exact_tests():
    assert es.sign_test_p(5, 5) == 1.0
    assert es.sign_test_p(10, 0) == pytest.approx(2 / 1024)
    assert es.wilcoxon_p(0, 20, 0) < 0.001


def test_bootstrap_brackets_the_estimate(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).select((F.col("id") % 200).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("e"))
    r = rs.cluster_bootstrap(df, "c", {"e": F.col("e"), "n": F.lit(1)}, {"share": ("e", "n")}, 100).first()
    assert r.low < r.estimate < r.high and r.n_reps == 100 and r.estimate == pytest.approx(667 / 2000)


def test_power_grows(spark):
    p = [r.power for r in es.detectability(spark, 1000, [0.0, 0.1, 0.3], 4000).orderBy("kappa").collect()]
    assert p[0] == pytest.approx(0.05, abs=0.02) and p[0] < p[1] < p[2]


MODELS = {"kernel": (fits.KERNEL, es.exponential_kernel), "weibull": (fits.WEIBULL, es.weibull)}


@pytest.mark.parametrize("name", MODELS)
def test_distributed_fits_are_those_of_durations_in_hand(spark, name):
    """Groups of seconds, hours, few units and no events: parameters within 1e-6."""
    model, plain = MODELS[name]
    rng = np.random.default_rng(4)
    parts = [("fast", rng.exponential(2 / 3600, 3000), 0.5), ("slow", 5 * rng.weibull(0.6, 800), 0.3), ("few", rng.exponential(1, 25), 0.6), ("none", rng.exponential(1, 30), 0.0), ("scant", rng.exponential(1, 4), 1.0)]
    rows = [(g, float(s), int(d)) for g, x, share in parts for s, d in zip(x, rng.random(len(x)) < share)]
    df = spark.createDataFrame(rows + [("fast", 0.0, 1), ("slow", None, 1)], "g string, duration_hours double, event_observed int").repartition(5)
    got = {r.g: r for r in fits.fit_by_group(df, "g", model, ("a", "b")).collect()}
    for g in ("fast", "slow", "few"):
        s, d = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g], float)
        a, b, ll = plain(s, d)
        assert (got[g].a, got[g].b) == pytest.approx((a, b), rel=1e-6) and got[g].log_likelihood == pytest.approx(ll, rel=1e-9)
        assert (got[g].n_units, got[g].n_events) == (len(s), d.sum())
    assert got["none"].a is None and got["scant"].b is None and got["scant"].n_units == 4


@pytest.mark.parametrize("name", MODELS)
def test_fits_of_replicates_are_those_of_their_draws(spark, name):
    model, plain = MODELS[name]
    rng = np.random.default_rng(9)
    n, clusters, reps = 1500, 120, 400
    c = np.where(rng.random(n) < 0.3, 0, rng.integers(0, clusters, n))
    s, d = 0.2 * rng.weibull(0.8, n), (rng.random(n) < 0.4).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(e)) for a, b, e in zip(c, s, d)], "c long, duration_hours double, event_observed int")
    got = {r["rep"]: (r["first"], r["second"]) for r in fits.bootstrap_fits(df, "c", reps, model).collect()}
    seen = sorted(set(c))
    w = rs.weights(len(seen), reps, 1, 0)[:, np.searchsorted(seen, c)]
    assert len(got) == reps + 1
    for rep in (0, 1, 2, 57, 211, 400):
        own = w[rep] > 0
        assert got[rep] == pytest.approx(plain(s[own], d[own].astype(float), w[rep][own])[:2], rel=1e-6)


def test_replicates_and_simulations_are_those_of_the_reference(spark, monkeypatch):
    from colloquy.plans import catalog, modelling

    seen, own = [], es.spectrum
    monkeypatch.setattr(modelling.es, "spectrum", lambda series, minutes, sims, **k: seen.append(sims) or own(series, minutes, sims, **k))
    for name in ("welch_psd", "spectrum_by_bin_width"):
        for r in catalog.queries()[name](spark, "/root/testdata/sf0.001").collect():
            assert 0 <= r.p_value <= 1 and r.p_value * 2000 == pytest.approx(round(r.p_value * 2000), abs=0.01)
    assert seen == [2000] * 4
    assert catalog.queries()["bootstrap_half_life"](spark, "/root/testdata/sf0.001").first().n_reps == 400


def test_two_way_covariance_against_sums_written_out(spark):
    rng = np.random.default_rng(5)
    n, k = 300, 2
    a, b, x = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.normal(size=(n, k))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(i), int(j), *map(float, v)) for i, j, v in zip(a, b, x)], "a long, b long, x0 double, x1 double")
    inverse = np.array([[0.5, 0.1], [0.1, 0.3]])

    def of(groups):
        sums = {}
        for g, v in zip(groups, x):
            sums[g] = sums.get(g, 0) + v
        meat = sum(np.outer(v, v) for v in sums.values())
        return inverse @ meat @ inverse * len(sums) / (len(sums) - 1) * (n - 1) / (n - k)

    got = es.two_way_covariance(df, [F.col("x0"), F.col("x1")], inverse, "a", "b")
    want = of(a.tolist()) + of(b.tolist()) - of(list(zip(a.tolist(), b.tolist())))
    assert got["two_way"] == pytest.approx(want) and got["first"] == pytest.approx(of(a.tolist()))


def test_half_life_at_the_published_rates(spark):
    """Replies of seconds: fit and bootstrap median of the half-life within a hundredth of the truth."""
    rng = np.random.default_rng(7)
    alpha, beta, n = 5.08585, 52.2088, 400_000
    e = rng.exponential(size=n)
    mu = alpha / beta
    t = np.where(e < mu, -np.log1p(-np.minimum(e, mu * (1 - 1e-12)) / mu) / beta, 4.0)
    df = spark.createDataFrame(pd.DataFrame({"thread_id": np.arange(n) % 4000, "duration_hours": t, "event_observed": (e < mu).astype(int), "g": "all"}))
    b = fits.fit_by_group(df, "g").first().beta
    assert math.log(2) / b == pytest.approx(math.log(2) / beta, rel=0.02)
    reps = sorted(r["second"] for r in fits.bootstrap_fits(df, "thread_id", 20).collect())
    assert reps[10] == pytest.approx(b, rel=0.01)


def test_errors_fall_back_where_a_variance_is_negative():
    model, good, bad = np.array([1.0, 2.0]), np.diag([4.0, 9.0]), np.diag([4.0, -1e-9])
    assert [x.tolist() if hasattr(x, "tolist") else x for x in es.robust_errors(model, good, good)] == [[2, 3], [2, 3], "two_way_cluster_thread_author"]
    first, both, note = es.robust_errors(model, good, bad)
    assert both.tolist() == [2, 3] and note.endswith(";twoway_cov_diag_invalid_fallback_thread")
    first, both, note = es.robust_errors(model, bad, np.diag([np.nan, 1.0]))
    assert first.tolist() == both.tolist() == [1, 2] and "thread_cov_diag_invalid_fallback_model;twoway" in note
