"""Scans over one long order, or one a group: previous values, running sums, ranks, exact quantiles.

Rows are dealt to ranges of the whole order (group, order columns) by sampled bounds and
written. The order ends in a column that tells rows apart, so neither a large group nor a hot
instant meets in one task. What a range needs of those before it comes from a carry table,
which has a row for each range and each group in it; within a range local windows do the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.scratch import written

RANGE = "_range"


def ranged(df: DataFrame, order: list[str], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """The rows with the number of their range, written; numbers grow with (by, order)."""
    by = by or []
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(parts, *by, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _joined(t: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the carry of their range and group; without groups the carry has a row a range."""
    named = carry.select(F.col(RANGE).alias("_carry_range"), *(F.col(c).alias(f"_carry_{k}") for k, c in enumerate(by)), *[c for c in carry.columns if c not in (RANGE, *by)])
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_carry_{k}")) for k, c in enumerate(by)), F.col(RANGE) == F.col("_carry_range"))
    return t.join(named if by else F.broadcast(named), same).drop("_carry_range", *(f"_carry_{k}" for k in range(len(by))))


def with_previous(t: DataFrame, value: str, order: list[str], by: list[str] | None = None, name: str = "previous") -> DataFrame:
    """With column ``name``, the value of the row before in the order of its group; ``t`` comes from ``ranged``."""
    by = by or []
    ends = t.groupBy(RANGE, *by).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    carry = ends.select(RANGE, *by, F.lag("_end").over(Window.partitionBy(*by).orderBy(RANGE)).alias("_carry"))
    own = F.lag(F.struct(value)).over(Window.partitionBy(RANGE, *by).orderBy(*order))
    return _joined(t.withColumn("_own", own), carry, by).withColumn(name, F.coalesce("_own", "_carry")[value]).drop("_own", "_carry")


def with_running(t: DataFrame, sums: dict[str, Column], order: list[str], by: list[str] | None = None, before: bool = False) -> DataFrame:
    """With running sums, the row itself included unless ``before``; ``t`` comes from ``ranged``."""
    by, names = by or [], list(sums)
    t = t.withColumns({f"_x{k}": c for k, c in enumerate(sums.values())})
    parts = t.groupBy(RANGE, *by).agg(*(F.sum(f"_x{k}").alias(f"_x{k}") for k in range(len(names))))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(RANGE, *by, *(F.coalesce(F.sum(f"_x{k}").over(earlier), F.lit(0)).alias(f"_carry_x{k}") for k in range(len(names))))
    own = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    t = t.withColumns({f"_own{k}": F.coalesce(F.sum(f"_x{k}").over(own), F.lit(0)) for k in range(len(names))})
    t = _joined(t, carry, by).withColumns({n: F.col(f"_own{k}") + F.col(f"_carry_x{k}") for k, n in enumerate(names)})
    return t.drop(*(f"{p}{k}" for k in range(len(names)) for p in ("_x", "_own", "_carry_x")))


def with_rank(t: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """With the number of each row in the order of its group, from 1."""
    return with_running(t, {name: F.lit(1).cast("long")}, order, by)


def between(below: Column, above: Column, share: Column) -> Column:
    """below * (1 - share) + above * share, the first product not rounded, as quantile_cont computes it: ties of later roundings fall alike."""
    known = below.isNotNull() & above.isNotNull() & (share > 0)
    return F.when(known, F.reflect(F.lit("java.lang.Math"), F.lit("fma"), below, 1 - share, above * share).cast("double")).otherwise(below)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, rule: str = "linear", weight: str | None = None) -> DataFrame:
    """One row a group with exact quantiles in columns named by ``probs``; nulls don't count.

    ``linear`` interpolates between the two nearest ranks; ``least`` takes the smallest value
    whose running weight reaches p of the total. Distinct values are counted by group and
    ranged; counts by range tell which ranges hold the ranks, and only these are ordered.
    """
    by = by or []
    t = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight or F.lit(1)).alias("_w"))
    t = ranged(t.where("_w > 0"), ["_v"], by)
    parts = t.groupBy(RANGE, *by).agg(F.sum("_w").alias("_n"))
    upto = Window.partitionBy(*by).orderBy(RANGE)
    carry = parts.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(Window.partitionBy(*by))}).withColumn("_before", F.col("_upto") - F.col("_n"))
    asked = []
    for name, p in probs.items():
        if rule == "least":
            asked.append(F.struct(F.lit(name).alias("name"), (F.lit(p) * F.col("_total")).alias("at"), F.lit(-1.0).alias("share")))
        else:  # ranks count from 1; a rank is reached where the running count is at least it
            at = F.lit(p) * (F.col("_total") - 1)
            low, part = F.floor(at), at - F.floor(at)
            asked += [F.struct(F.lit(name).alias("name"), (low + 1).cast("double").alias("at"), F.lit(-1.0).alias("share")), F.struct(F.lit(name).alias("name"), (F.least(low + 1, F.col("_total") - 1) + 1).cast("double").alias("at"), part.alias("share"))]
    # a positive rank is asked, so a quantile of p = 0 is the first value
    carry = carry.withColumn("_asked", F.explode(F.array(*asked))).select(RANGE, *by, "_before", "_upto", F.col("_asked.name").alias("_name"), F.greatest("_asked.at", F.lit(1e-300)).alias("_at"), F.col("_asked.share").alias("_share"))
    carry = carry.where("_at > _before and _at <= _upto")
    holding = carry.select(RANGE, *by, "_before").distinct()
    inside = _joined(t, holding, by)
    inside = inside.withColumn("_upto_v", F.col("_before") + F.sum("_w").over(Window.partitionBy(RANGE, *by).orderBy("_v"))).drop("_before")
    found = _joined(inside, carry.select(RANGE, *by, "_name", "_at", "_share"), by).where("_at <= _upto_v and _at > _upto_v - _w")
    # the rank below has a share of -1, the one above its own
    each = [f(F.when((F.col("_name") == n) & at, c)).alias(f"_{k}_{j}") for k, n in enumerate(probs) for j, (f, at, c) in enumerate(
        ((F.max, F.col("_share") < 0, F.col("_v").cast("double")), (F.max, F.col("_share") >= 0, F.col("_v").cast("double")), (F.max, F.col("_share") >= 0, F.col("_share"))))]
    return found.groupBy(*by).agg(*each).select(*by, *(between(F.col(f"_{k}_0"), F.col(f"_{k}_1"), F.col(f"_{k}_2")).alias(n) for k, n in enumerate(probs)))


def with_quantiles(report: DataFrame, rows: DataFrame, value: str, probs: dict[str, float], by: list[str], rule: str = "linear") -> DataFrame:
    """A report of a row a group with quantiles of ``rows`` beside it; null where a group has no value."""
    q = quantiles(rows, value, probs, by, rule)
    if not by:
        return report.crossJoin(F.broadcast(q))
    q = q.select(*(F.col(c).alias(f"_q_{k}") for k, c in enumerate(by)), *probs)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_q_{k}")) for k, c in enumerate(by)))
    return report.join(q, same, "left").drop(*(f"_q_{k}" for k in range(len(by))))
