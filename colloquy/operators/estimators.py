"""Spectra, regressions, tests, and the two survival fits for durations in hand (``fits`` has them for tables)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.scratch import ship

LN2 = math.log(2)
#: Combinations of levels that a regression's cell table may have.
MOST_CELLS = 100_000
#: Simulated paths of a part.
PATHS = 50


def exponential_kernel(s: np.ndarray, d: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """(alpha, beta, log-likelihood) of the hazard alpha * exp(-beta s) with events d and weights w.

    For each beta the best alpha is events / sum w (1 - exp(-beta s)) / beta, which leaves
    a function of log beta: a grid finds its peak, halving by the sign of its slope narrows it.
    """
    w = np.ones(len(s)) if w is None else w
    events = float((w * d).sum())
    if not events:
        return math.nan, math.nan, math.nan
    total = float((w * d * s).sum())

    def profile(log_beta: float) -> tuple[float, float]:
        beta = math.exp(log_beta)
        mass = float((w * -np.expm1(-beta * s)).sum()) / beta
        alpha = events / mass
        return events * math.log(alpha) - beta * total - events, alpha

    def slope(log_beta: float) -> float:
        beta = math.exp(log_beta)
        return events - beta * (total + events * float((w * s * np.exp(-beta * s)).sum()) / float((w * -np.expm1(-beta * s)).sum()))

    grid = np.linspace(-20, 20, 81)
    best = max(range(len(grid)), key=lambda k: profile(grid[k])[0])
    lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) >= 0 else (lo, mid)
    log_beta = (lo + hi) / 2
    ll, alpha = profile(log_beta)
    return alpha, math.exp(log_beta), ll


def weibull(s: np.ndarray, d: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float, float]:
    """(shape, scale, log-likelihood) with right censoring; Newton on the profiled shape, with bisection as guard."""
    w = np.ones(len(s)) if w is None else w
    events = float((w * d).sum())
    if not events:
        return math.nan, math.nan, math.nan
    x = np.log(s)
    top = float(x.max())
    mean = float((w * d * x).sum()) / events

    def slope(k: float) -> float:
        e = w * np.exp(k * (x - top))
        return 1 / k + mean - float((e * x).sum() / e.sum())

    lo, hi = 1e-4, 1.0
    while slope(hi) > 0 and hi < 1e4:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    k = (lo + hi) / 2
    log_mass = k * top + math.log(float((w * np.exp(k * (x - top))).sum()))
    scale = math.exp((log_mass - math.log(events)) / k)
    ll = events * (math.log(k) - k * math.log(scale)) + (k - 1) * mean * events - events
    return k, scale, ll


def cloglog(cells: DataFrame, levels: list[str], covariates: list[str], cluster_scores: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Binomial regression with complementary log-log link over a cell table (covariates, n, k) by Fisher scoring.

    The cell table has a row a combination of levels, so it is small whatever the units.
    Returns coefficients, the inverse information and names; the first level of each
    covariate in ``levels`` order is the reference.
    """
    rows = cells.limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of levels")
    names, columns = ["intercept"], [np.ones(len(rows))]
    for c in covariates:
        seen = sorted({r[c] for r in rows}, key=lambda v: (v not in levels, v))
        for v in seen[1:]:
            names.append(f"{c}[{v}]")
            columns.append(np.array([float(r[c] == v) for r in rows]))
    x = np.column_stack(columns)
    n, k = np.array([r["n"] for r in rows], float), np.array([r["k"] for r in rows], float)
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(-math.log(1 - min(max(k.sum() / n.sum(), 1e-6), 1 - 1e-6)))
    for _ in range(50):
        eta = np.clip(x @ beta, -30, 5)
        hz = np.exp(eta)
        p = np.clip(-np.expm1(-hz), 1e-12, 1 - 1e-12)
        slope = hz * (1 - p)
        weight = n * slope**2 / (p * (1 - p))
        information = x.T @ (x * weight[:, None])
        step = np.linalg.solve(information + 1e-9 * np.eye(len(beta)), x.T @ ((k - n * p) * slope / (p * (1 - p))))
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta, np.linalg.inv(information + 1e-9 * np.eye(len(beta))), names


def welch(y: np.ndarray, per_hour: float, segment: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density: periodic Hann segments, half overlapping, each less its mean; positive frequencies."""
    n = min(segment, len(y))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    parts = [y[a : a + n] for a in range(0, len(y) - n + 1, step)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0) / (per_hour * (window**2).sum())
    power[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / per_hour)[1:], power[1:]


def periodogram(y: np.ndarray, per_hour: float) -> tuple[np.ndarray, np.ndarray]:
    return welch(y, per_hour, len(y))


def fisher_g(power: np.ndarray) -> float:
    return float(power.max() / power.sum()) if power.sum() > 0 else math.nan


def fit_ar1(y: np.ndarray) -> tuple[float, float]:
    """(phi, sigma) without intercept; phi within 0.99, sigma at least 1e-6."""
    base = float((y[:-1] ** 2).sum())
    phi = float(np.clip((y[1:] * y[:-1]).sum() / base if base else 0.0, -0.99, 0.99))
    return phi, max(float(np.std(y[1:] - phi * y[:-1], ddof=1)), 1e-6)


def ar1_paths(n: int, phi: float, sigma: float, paths: int, rng: np.random.Generator) -> np.ndarray:
    """Simulated paths, one a row, from the stationary law."""
    out = np.empty((paths, n))
    out[:, 0] = rng.normal(0, sigma / math.sqrt(1 - phi * phi), paths)
    noise = rng.normal(0, sigma, (paths, n))
    for k in range(1, n):
        out[:, k] = phi * out[:, k - 1] + noise[:, k]
    return out


def spectrum(series: DataFrame, minutes: int, sims: int, target: float = 0.25, band: float = 0.03, seed: int = 1) -> DataFrame:
    """Density at the target frequency (per hour), median background, dominant frequency, Fisher g and its AR(1) p-value.

    The binned series is one group: a row a bin, whatever the number of events. The null's
    paths are simulated in parts of at most PATHS, dealt over tasks.
    """
    spark = series.sparkSession
    ship(spark)
    per_hour = 60 / minutes

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("bin").y.to_numpy()
        f, p = welch(y, per_hour)
        g = fisher_g(periodogram(y, per_hour)[1])
        at = int(np.argmin(np.abs(f - target)))
        phi, sigma = fit_ar1(y)
        return pd.DataFrame({"target_power": [p[at]], "background_power": [float(np.median(p[np.abs(f - target) > band]))], "dominant_frequency": [f[np.argmax(p)]], "fisher_g": [g], "phi": [phi], "sigma": [sigma], "length": [len(y)]})

    def null(batches):
        for pdf in batches:
            hits, n = [], []
            for r in pdf.itertuples():
                n.append(min(PATHS, sims - r.part * PATHS))
                paths = ar1_paths(int(r.length), r.phi, r.sigma, n[-1], np.random.default_rng([seed, r.part]))
                hits.append(sum(fisher_g(periodogram(z, per_hour)[1]) >= r.fisher_g for z in paths))
            yield pdf.drop(columns="part").assign(hits=hits, n=n)

    columns = [f"{c} double" for c in ("target_power", "background_power", "dominant_frequency", "fisher_g", "phi", "sigma")]
    own = series.groupBy(F.lit(1).alias("one")).applyInPandas(run, ", ".join([*columns, "length long"]))
    parts = spark.range(-(-sims // PATHS)).withColumnRenamed("id", "part").crossJoin(F.broadcast(own))
    t = parts.mapInPandas(null, ", ".join([*columns, "length long", "hits long", "n long"]))
    return t.groupBy("target_power", "background_power", "dominant_frequency", "fisher_g", "phi").agg((F.sum("hits") / F.sum("n")).alias("p_value"))


def bessel_ratio(kappa: float) -> float:
    """I1 / I0 by their series."""
    i0 = i1 = 0.0
    term0, term1 = 1.0, kappa / 2
    for k in range(1, 200):
        i0, i1 = i0 + term0, i1 + term1
        term0 *= (kappa / 2) ** 2 / k**2
        term1 *= (kappa / 2) ** 2 / (k * (k + 1))
    return i1 / i0


def detectability(spark, n_events: int, kappas: list[float], draws: int = 50_000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """Power of the Rayleigh test over concentrations; each is a group with its own draws, and the first with a power of 0.8. z_critical is -ln(alpha)."""
    ship(spark)
    critical = -math.log(alpha)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kappa = float(pdf.kappa.iloc[0])
        rng = np.random.default_rng([seed, round(kappa * 1e6)])
        centre = math.sqrt(2 * n_events) * bessel_ratio(kappa)
        z = 0.5 * ((rng.normal(size=draws) + centre) ** 2 + rng.normal(size=draws) ** 2)
        return pd.DataFrame({"kappa": [kappa], "rho": [bessel_ratio(kappa)], "power": [float((z >= critical).mean())]})

    t = spark.createDataFrame([(float(k),) for k in kappas], "kappa double")
    t = t.groupBy("kappa").applyInPandas(run, "kappa double, rho double, power double")
    crosses = F.min(F.when(F.col("power") >= 0.8, F.col("kappa"))).over(Window.partitionBy())
    return t.withColumn("kappa_power_crosses_0p8", crosses)


def wilcoxon_p(w: float, n: int, ties: float) -> float:
    """Two-sided normal approximation with tie correction."""
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else math.nan


def sign_test_p(positive: int, negative: int) -> float:
    """Exact two-sided binomial."""
    n, k = positive + negative, min(positive, negative)
    if not n:
        return math.nan
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * LN2 for i in range(k + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs)))


def random_unit_per_cluster(df: DataFrame, cluster: str, key: str, seed: int = 1) -> DataFrame:
    """One row a cluster, the first in the order of a seeded hash; found by a minimum, so a large cluster is pre-aggregated."""
    at = F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key))
    first = df.groupBy(cluster).agg(F.min(at).alias("_first")).select(F.col(f"_first.{key}").alias("_key"))
    return df.join(first, F.col(key) == F.col("_key"), "left_semi")


def two_way_covariance(units: DataFrame, score: list[Column], inverse: np.ndarray, first: str, second: str) -> dict[str, np.ndarray]:
    """Covariances robust to clusters of each of two columns and of both: sums of scores by cluster, their products summed.

    Both: that of the first plus that of the second less that of their crossing. Each has the
    usual small-sample factor G / (G - 1) * (N - 1) / (N - K).
    """
    k = len(score)
    t = units.select(first, second, *(c.alias(f"s{i}") for i, c in enumerate(score)))
    n = t.count()

    def of(keys: list[str]) -> np.ndarray:
        sums = t.groupBy(*keys).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))
        m = sums.agg(F.count("*").alias("g"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
        meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
        g = m["g"]
        return inverse @ meat @ inverse * (g / max(1, g - 1) * (n - 1) / max(1, n - k))

    a, b, both = of([first]), of([second]), of([first, second])
    return {"first": a, "second": b, "two_way": a + b - both}


def robust_errors(model: np.ndarray, by_cluster: np.ndarray, two_way: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """Errors from covariances by cluster and by two clusters, and a note.

    A two-way covariance is a difference and may have a negative diagonal; then its errors
    are all those by cluster, and where these can't be had either, those of the model.
    """
    note = "two_way_cluster_thread_author"
    first, both = np.diag(by_cluster), np.diag(two_way)
    valid = lambda v: bool(np.all(np.isfinite(v)) and np.all(v >= 0))
    if valid(first):
        first = np.sqrt(first)
    else:
        first, note = model, f"{note};thread_cov_diag_invalid_fallback_model"
    if valid(both):
        return first, np.sqrt(both), note
    return first, first, f"{note};twoway_cov_diag_invalid_fallback_thread"
