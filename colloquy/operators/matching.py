"""Two platforms compared on exact strata: overlap, pairs, balance, paired effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import scan

STRATUM = ["topic", "hour", "early_bin"]
OUTCOMES = ["n_comments", "depth_max", "n_unique_agents", "thread_duration_hours", "reentry_rate"]


def eligible(threads: DataFrame) -> DataFrame:
    return threads.dropna(subset=STRATUM)


def overlap(a: DataFrame, b: DataFrame, keys: list[str] = STRATUM) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides in strata that both have; nulls never match."""
    return a.join(b.select(keys).distinct(), keys, "left_semi"), b.join(a.select(keys).distinct(), keys, "left_semi")


def matched_pairs(a: DataFrame, b: DataFrame, keys: list[str] = STRATUM) -> DataFrame:
    """Rank i of one side with rank i of the other within a stratum, in the order (early_comments, time, thread_id).

    Strata are numbered by their keys as text; a pair's number follows from the pairs of
    the strata before it, which are a row a stratum.
    """
    order = ["early_comments", "post_created_at_utc", "thread_id"]
    side = lambda t, s: scan.with_rank(scan.ranged(t, order, keys), order, keys).select(*keys, "rank", *(F.col(c).alias(f"{c}_{s}") for c in ("thread_id", "early_comments", *OUTCOMES)))
    pairs = side(a, "a").join(side(b, "b"), [*keys, "rank"])
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.orderBy(*(F.col(k).cast("string") if k != "hour" else F.col(k) for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    pairs = pairs.join(sizes, keys).withColumn("pair_id", F.col("before") + F.col("rank"))
    diffs = [F.bround((F.col(f"{c}_a") - F.col(f"{c}_b")).cast("double"), 12).alias(f"diff_{c}") for c in OUTCOMES]
    return pairs.select("pair_id", *keys, "thread_id_a", "thread_id_b", *(f"{c}_{s}" for c in OUTCOMES for s in "ab"), *diffs)


def strata_counts(a: DataFrame, b: DataFrame, keys: list[str] = STRATUM) -> DataFrame:
    n = lambda t, s: t.groupBy(*keys).agg(F.count("*").alias(f"n_{s}"))
    return n(a, "a").join(n(b, "b"), keys).withColumn("n_pairs", F.least("n_a", "n_b"))


def smd(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    """Standardised mean difference; a missing variance is 0; without spread equal means give 0, others infinity."""
    sd = F.sqrt((F.coalesce(var_a, F.lit(0.0)) + F.coalesce(var_b, F.lit(0.0))) / 2)
    return F.when(sd > 0, (mean_a - mean_b) / sd).when(F.abs(mean_a - mean_b) < 1e-12, 0.0).when(mean_a.isNotNull() & mean_b.isNotNull(), F.lit(float("inf")))


def numeric_balance(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """covariate, means and SMD."""
    def side(t, s):
        long = t.select(F.expr("stack({}, {}) as (covariate, x)".format(len(columns), ", ".join(f"'{c}', cast({c} as double)" for c in columns))))
        return long.groupBy("covariate").agg(F.avg("x").alias(f"mean_{s}"), F.var_samp("x").alias(f"var_{s}"))

    t = side(a, "a").join(side(b, "b"), "covariate", "full")
    return t.select("covariate", "mean_a", "mean_b", smd(F.col("mean_a"), F.col("var_a"), F.col("mean_b"), F.col("var_b")).alias("smd"))


def level_shares(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """covariate, level, share on both sides (0 where absent) by full outer join."""
    def side(t, s):
        long = t.select(F.expr("stack({}, {}) as (covariate, level)".format(len(columns), ", ".join(f"'{c}', cast({c} as string)" for c in columns)))).where("level is not null")
        n = long.groupBy("covariate", "level").agg(F.count("*").alias("n"))
        return n.select("covariate", "level", (F.col("n") / F.sum("n").over(Window.partitionBy("covariate"))).alias(f"share_{s}"))

    t = side(a, "a").join(side(b, "b"), ["covariate", "level"], "full")
    return t.select("covariate", "level", *(F.coalesce(f"share_{s}", F.lit(0.0)).alias(f"share_{s}") for s in "ab"))


def level_balance(shares: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """SMD of each level's indicator with its sample variance."""
    var = lambda p, n: p * (1 - p) * n / max(1, n - 1)
    pa, pb = F.col("share_a"), F.col("share_b")
    return shares.select("covariate", "level", "share_a", "share_b", smd(pa, var(pa, n_a), pb, var(pb, n_b)).alias("smd"))


def total_variation(shares: DataFrame) -> DataFrame:
    return shares.groupBy("covariate").agg((F.sum(F.abs(F.col("share_a") - F.col("share_b"))) / 2).alias("tvd"))


def paired_effects(pairs: DataFrame) -> DataFrame:
    """Per outcome: means, mean and median difference, paired Cohen d, signed-rank sums (zeros dropped, ties at mean rank), signs."""
    long = pairs.select(F.expr("stack({}, {}) as (outcome, a, b, d)".format(len(OUTCOMES), ", ".join(f"'{c}', cast({c}_a as double), cast({c}_b as double), diff_{c}" for c in OUTCOMES)))).where("d is not null")
    base = long.groupBy("outcome").agg(
        F.count("*").alias("n_pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"),
        F.count_if(F.col("d") > 0).alias("n_positive"), F.count_if(F.col("d") < 0).alias("n_negative"),
    )
    base = scan.with_quantiles(base, long, "d", {"median_diff": 0.5}, ["outcome"])
    # ranks over distinct absolute differences: a row a value, not a row a pair
    v = long.where("d <> 0").groupBy("outcome", F.abs("d").alias("x")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("np"))
    v = scan.with_running(scan.ranged(v, ["x"], ["outcome"]), {"before": F.col("n")}, ["x"], ["outcome"], before=True)
    rank = F.col("before") + (F.col("n") + 1) / 2
    ranks = v.withColumn("rank", rank).groupBy("outcome").agg(
        F.sum(F.col("rank") * F.col("np")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("np"))).alias("w_minus"), F.sum(F.col("n") ** 3 - F.col("n")).alias("ties")
    )
    t = base.join(ranks, "outcome", "left")
    return t.select(
        "outcome", "n_pairs", "mean_a", "mean_b", "mean_diff", "median_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).alias("cohen_d"), "n_positive", "n_negative",
        F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)).alias("wilcoxon"), F.coalesce("ties", F.lit(0.0)).alias("ties"),
    )


def sample_flow(stages: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(stage, platform, n, share of the platform's first stage) of named tables."""
    parts = [df.agg(F.lit(k).alias("step"), F.lit(stage).alias("stage"), F.lit(platform).alias("platform"), F.count("*").alias("n")) for k, (stage, platform, df) in enumerate(stages)]
    t = reduce(DataFrame.unionByName, parts)
    first = F.first("n").over(Window.partitionBy("platform").orderBy("step"))
    return t.select("stage", "platform", "n", (F.col("n") / F.nullif(first, F.lit(0))).alias("share"))
