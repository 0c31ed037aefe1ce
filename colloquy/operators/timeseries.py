"""Binned activity: calendars, detrending, circular statistics, lagged correlation."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import scan


def binned_counts(df: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Counts by bin over the complete calendar from first to last, empty bins with 0."""
    n = df.groupBy(F.window(ts, f"{minutes} minutes")["start"].alias("b")).agg(F.count("*").alias("c"))
    span = n.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    calendar = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL '{minutes}' MINUTE"))).alias("bin"))
    return calendar.join(n, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


def detrended(series: DataFrame, window_bins: int = 96) -> DataFrame:
    """log1p counts less their centred rolling mean (half before, one less after), then centred. A row a bin."""
    half = window_bins // 2
    w = Window.orderBy("bin").rowsBetween(-half, window_bins - half - 1)
    t = series.withColumn("y", F.log1p("n")).withColumn("y", F.col("y") - F.avg("y").over(w))
    return t.select("bin", "n", (F.col("y") - F.avg("y").over(Window.partitionBy())).alias("y"))


def rayleigh(df: DataFrame, ts: str, period_hours: float) -> DataFrame:
    """n, resultant length R, Z = n R^2 and mean phase of times modulo the period."""
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts)) / 1e6
    period = period_hours * 3600
    angle = 2 * pi * F.pmod(seconds, F.lit(period)) / period
    t = df.agg(F.count("*").alias("n"), F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s"))
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("n")
    return t.select("n", r.alias("r"), (F.col("n") * r * r).alias("z"), F.atan2("s", "c").alias("mean_phase"), F.exp(-F.col("n") * r * r).alias("p_value"))


def lag_correlation(df: DataFrame, ts: str, agent: str, minutes: int, lag: int, least: int) -> DataFrame:
    """Per agent with at least so many rows: Pearson correlation of bin counts with those ``lag`` bins later.

    Pairs of bins over the whole calendar follow from sums over the agent's own non-empty
    bins, so no agent-by-bin table is built: products need a join on agent and bin, and
    the sums without the last or first ``lag`` bins are conditional.
    """
    n = df.where(F.col(agent).isNotNull()).groupBy(F.col(agent).alias("agent"), F.window(ts, f"{minutes} minutes")["start"].alias("bin")).agg(F.count("*").alias("c"))
    span = df.agg(F.min(F.window(ts, f"{minutes} minutes")["start"]).alias("lo"), F.max(F.window(ts, f"{minutes} minutes")["start"]).alias("hi"))
    span = span.withColumn("m", (F.timestamp_diff("MINUTE", F.col("lo"), F.col("hi")) / minutes).cast("long") + 1 - lag)
    step = F.expr(f"INTERVAL '{minutes * lag}' MINUTE")
    nxt = n.select(F.col("agent").alias("agent2"), (F.col("bin") - step).alias("bin2"), F.col("c").alias("c2"))
    t = n.join(nxt, (F.col("agent") == F.col("agent2")) & (F.col("bin") == F.col("bin2")), "left").crossJoin(F.broadcast(span))
    early, late = F.col("bin") <= F.col("hi") - step, F.col("bin") >= F.col("lo") + step
    part = lambda cond, c: F.sum(F.when(cond, c).otherwise(0)).cast("double")
    t = t.groupBy("agent").agg(
        F.sum("c").alias("n"), F.max("m").alias("m"), part(early, F.col("c")).alias("sx"), part(early, F.col("c") * F.col("c")).alias("sxx"),
        part(late, F.col("c")).alias("sy"), part(late, F.col("c") * F.col("c")).alias("syy"), F.sum(F.col("c") * F.coalesce("c2", F.lit(0))).cast("double").alias("sxy"),
    ).where(F.col("n") >= least)
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / F.col("m"), F.col("syy") - F.col("sy") ** 2 / F.col("m")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("m")
    return t.where((vx > 1e-12) & (vy > 1e-12)).select("agent", "n", (cov / F.sqrt(vx * vy)).alias("correlation"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    n = scan.ranged(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")), ["value"])
    t = scan.with_running(n, {"upto": F.col("n")}, ["value"]).crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"))))
    return t.select("value", (F.col("upto") / F.col("total")).alias("ecdf"))
