"""Maximum-likelihood fits whose durations never meet in one task.

Both models leave a function of one number after the other parameter is profiled out, and this
function needs only sums over units at given values of that number:

- hazard alpha * exp(-beta s), t = log beta: A(t) = sum 1 - exp(-beta s), B(t) = sum s exp(-beta s);
- Weibull, t = log shape: P(t) = sum exp(k (x - top)), Q(t) = sum x exp(k (x - top)), x = log s.

All units are summed at a coarse grid, then at a fine one around the peaks, for all groups
and all replicates of resampled clusters at once: tasks add up weights times such terms as
matrix products. The peak of each replicate is the root of the derivative, interpolated by a
cubic between points 0.02 apart (an error far below 1e-6 of the parameter).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import resampling as rs
from colloquy.sources.scratch import ship, written

STEP, MOST = 0.02, 512
COUNTS = 3  # units, events, and the sum of events' times (Weibull: of their logs)


@dataclass(frozen=True)
class Model:
    """A family of fits: its grid, the terms of a unit, and from sums a score whose root is the peak."""

    name: str
    low: float
    high: float
    points: int

    def terms(self, s: np.ndarray, d: np.ndarray, t: np.ndarray, top: float) -> np.ndarray:
        raise NotImplementedError

    def score(self, counts: np.ndarray, first: np.ndarray, second: np.ndarray, t: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def likelihood(self, counts: np.ndarray, first: np.ndarray, t: np.ndarray, top: float) -> np.ndarray:
        raise NotImplementedError

    def parameters(self, counts: np.ndarray, log_first: float, t: float, top: float) -> tuple[float, float]:
        raise NotImplementedError


class Kernel(Model):
    def terms(self, s, d, t, top):
        x = -np.exp(t)[None, :] * s[:, None]
        return np.column_stack((np.ones(len(s)), d, d * s, -np.expm1(x), s[:, None] * np.exp(x)))

    def score(self, counts, first, second, t):
        _, k, total = counts
        return k - np.exp(t) * (total + k * second / first)

    def likelihood(self, counts, first, t, top):
        _, k, total = counts
        return k * (math.log(k) - np.log(first) + t) - np.exp(t) * total - k

    def parameters(self, counts, log_first, t, top):
        return counts[1] * math.exp(t - log_first), math.exp(t)


class Weibull(Model):
    def terms(self, s, d, t, top):
        x = np.log(s)
        e = np.exp(np.exp(t)[None, :] * (x - top)[:, None])
        return np.column_stack((np.ones(len(s)), d, d * x, e, x[:, None] * e))

    def score(self, counts, first, second, t):
        return np.exp(-t) + counts[2] / counts[1] - second / first

    def likelihood(self, counts, first, t, top):
        _, k, logs = counts
        shape = np.exp(t)
        log_scale = (shape * top + np.log(first) - math.log(k)) / shape
        return k * (t - shape * log_scale) + (shape - 1) * logs - k

    def parameters(self, counts, log_first, t, top):
        shape = math.exp(t)
        return shape, math.exp((shape * top + log_first - math.log(counts[1])) / shape)


KERNEL = Kernel("kernel", -20.0, 20.0, 81)
WEIBULL = Weibull("weibull", math.log(1e-3), math.log(1e3), 81)


def _cubic(t: np.ndarray, y: np.ndarray, at: float) -> float:
    """The polynomial through a few points."""
    out = 0.0
    for i in range(len(t)):
        others = np.delete(t, i)
        out += y[i] * float(np.prod((at - others) / (t[i] - others)))
    return out


def peak(model: Model, x: np.ndarray, t: np.ndarray, top: float) -> tuple[float, float, int]:
    """(t, log of the first sum there, grid point left of it) of the greatest likelihood, from sums at the grid."""
    m = len(t)
    counts, first, second = x[:COUNTS], x[COUNTS : COUNTS + m], x[COUNTS + m :]
    with np.errstate(all="ignore"):
        ll = model.likelihood(counts, first, t, top)
        g = model.score(counts, first, second, t)
    ll = np.where(np.isfinite(ll) & np.isfinite(g), ll, -np.inf)
    best = int(np.argmax(ll))
    left = best if g[best] >= 0 else best - 1
    if left < 0 or left + 1 >= m or not np.isfinite(ll[left]) or not np.isfinite(ll[left + 1]) or not g[left] >= 0 > g[left + 1]:
        return float(t[best]), float(np.log(first[best])), min(max(best - 1, 0), m - 2)  # the peak is the end of the grid
    near = np.arange(max(0, left - 1), min(m, left + 3))
    near = near[np.isfinite(ll[near])]
    lo, hi = t[left], t[left + 1]
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cubic(t[near], g[near], mid) >= 0 else (lo, mid)
    return float((lo + hi) / 2), float(_cubic(t[near], np.log(first[near]), (lo + hi) / 2)), left


def _summed(rows: DataFrame, model: Model, grids: dict[str, np.ndarray], tops: dict[str, float], reps: int, seed: int) -> DataFrame:
    """(_g, rep, x) at each group's grid."""
    def terms(g: str, v: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([model.terms(s, d.astype(float), grids[g], tops[g]).reshape(len(s), -1) for s, d in ((v[0][a : a + 4096], v[1][a : a + 4096]) for a in range(0, len(v[0]), 4096))])

    return rs.replicate_sums(rows, ["s", "d"], terms, lambda g: COUNTS + 2 * len(grids[g]), reps, seed)


def _fit(rows: DataFrame, model: Model, reps: int, seed: int) -> DataFrame:
    """(_g, rep, n_units, n_events, first, second, log_likelihood); parameters are null without events. rows: _g, s, d, and of a frame."""
    ship(rows.sparkSession)
    heads = rows.groupBy("_g").agg(F.max(F.log("s")).alias("top")).collect()  # a row a group
    tops = {r._g: r.top for r in heads}
    coarse = np.linspace(model.low, model.high, model.points)
    grids = {g: coarse for g in tops}

    def bracket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                x = np.asarray(r.x)
                if x[1] > 0:
                    at = peak(model, x, coarse, tops[r[1]])[2]
                    found.append((r[1], coarse[at], coarse[at + 1]))
            yield pd.DataFrame(found, columns=["_g", "lo", "hi"])

    sums = written(_summed(rows, model, grids, tops, reps, seed), "sums")
    ranges = sums.mapInPandas(bracket, "_g string, lo double, hi double").groupBy("_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    fine = {r._g: np.linspace(r.lo - 2 * STEP, r.hi + 2 * STEP, min(MOST, math.ceil((r.hi - r.lo) / STEP) + 5)) for r in ranges}
    grids = {g: fine.get(g, coarse[:2]) for g in tops}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x, g = np.asarray(r.x), r[1]
                row = [g, r.rep, round(x[0]), round(x[1]), None, None, None]
                if x[1] > 0 and g in fine:
                    t, log_first, _ = peak(model, x, grids[g], tops[g])
                    ll = float(model.likelihood(x[:COUNTS], np.array([math.exp(log_first)]), np.array([t]), tops[g])[0])
                    row[4:] = [*model.parameters(x[:COUNTS], log_first, t, tops[g]), ll]
                out.append(row)
            yield pd.DataFrame(out, columns=["_g", "rep", "n_units", "n_events", "first", "second", "log_likelihood"])

    sums = written(_summed(rows, model, grids, tops, reps, seed), "sums")
    return sums.mapInPandas(solve, "_g string, rep int, n_units long, n_events long, first double, second double, log_likelihood double")


def _units(units: DataFrame, *more: str) -> DataFrame:
    """Valid durations as s and d; those of zero or that are not finite are left out."""
    from colloquy.operators.survival import valid

    return valid(units).select(*more, F.col("duration_hours").cast("double").alias("s"), F.col("event_observed").cast("int").alias("d"))


def fit_by_group(units: DataFrame, by: str, model: Model = KERNEL, names: tuple[str, str] = ("alpha", "beta"), least_units: int = 20, least_events: int = 5) -> DataFrame:
    """One fit a group; parameters are null below the least numbers of units and events."""
    rows = written(rs.keyed(_units(units, by), [by]).select("_g", "s", "d"), "units")
    t = rs.unkeyed(_fit(rows, model, 0, 1).drop("rep"), [by], units)
    enough = (F.col("n_units") >= least_units) & (F.col("n_events") >= least_events)
    named = (F.when(enough, F.col(c)).alias(n) for c, n in (("first", names[0]), ("second", names[1]), ("log_likelihood", "log_likelihood")))
    return t.select(by, "n_units", "n_events", *named)


def bootstrap_fits(units: DataFrame, cluster: str, reps: int, model: Model = KERNEL, seed: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., rep, first, second): one fit a replicate of resampled clusters; replicate 0 is the fit itself."""
    rows = rs.framed(_units(units, cluster, *by), cluster, list(by)).select("_g", "_rank", "_n", "s", "d")
    t = _fit(written(rows, "units"), model, reps, seed)
    return rs.unkeyed(t.select("_g", "rep", "first", "second"), list(by), units)
