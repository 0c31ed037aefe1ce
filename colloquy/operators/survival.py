"""Time to first reply: units, two-part reports, risk sets, hazards, Kaplan-Meier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.scalars import hours_between
from colloquy.operators import scan
from colloquy.sources.scratch import written

BOUNDARY_HOURS = 4
HORIZONS = (30, 300, 3600)


def first_replies(comments: DataFrame) -> DataFrame:
    return comments.where("parent_id is not null").groupBy("parent_id").agg(F.min("created_at_utc").alias("first_reply_at"))


def survival_units(events: DataFrame, boundary_hours: float = BOUNDARY_HOURS) -> DataFrame:
    """One row a comment: hours to the first reply or the end of observation; only positive durations.

    The flag ``excluded_censor_boundary`` marks units that began within the boundary of the end.
    """
    end = events.agg(F.max("created_at_utc").alias("observation_end"))
    first = first_replies(events).withColumnRenamed("parent_id", "replied")
    u = events.join(first, events["comment_id"] == first["replied"], "left").crossJoin(F.broadcast(end))
    observed = F.col("first_reply_at").isNotNull()
    duration = hours_between(F.col("created_at_utc"), F.coalesce("first_reply_at", "observation_end"))
    boundary = F.col("created_at_utc") > F.col("observation_end") - F.expr(f"INTERVAL '{int(boundary_hours * 3600)}' SECOND")
    u = u.select("thread_id", "comment_id", "comment_agent_id", "created_at_utc", "submolt_category", "first_reply_at", observed.cast("int").alias("event_observed"), duration.alias("duration_hours"), boundary.alias("excluded_censor_boundary"))
    return u.where("duration_hours > 0")


def valid(units: DataFrame) -> DataFrame:
    return units.where((F.col("duration_hours") > 0) & ~F.isnan("duration_hours") & (F.col("duration_hours") < float("inf")))


def two_part_columns() -> list[Column]:
    """Incidence and shares of reply times in minutes, all but the quantiles."""
    e, m = F.col("event_observed") == 1, F.col("duration_hours") * 60
    replied = F.when(e, m)
    n, k = F.count("*"), F.count_if(e)
    within = lambda minutes: F.count_if(e & (m <= minutes))
    return [
        n.alias("n_units"), k.alias("n_events"), (k / n).alias("incidence"),
        (within(0.5) / n).alias("within_30s"), (within(5) / n).alias("within_5m"), (within(0.5) / F.nullif(k, F.lit(0))).alias("within_30s_conditional"), (within(5) / F.nullif(k, F.lit(0))).alias("within_5m_conditional"),
        (F.log(F.lit(2.0)) * F.avg(replied)).alias("half_life_minutes"),
    ]


def _with_times(units: DataFrame, by: list[str], columns: list[Column], scale: float, probs: dict[str, float]) -> DataFrame:
    """A report by group with quantiles of the times of replies beside it; units are written once for both."""
    t = written(units.select(*by, "event_observed", "duration_hours"), "units")
    replied = t.where("event_observed = 1").withColumn("scaled", F.col("duration_hours") * scale)
    return scan.with_quantiles(t.groupBy(*by).agg(*columns), replied, "scaled", probs, by)


def two_part(units: DataFrame, by: list[str]) -> DataFrame:
    """The two-part report by group: incidence, and times of replies in minutes."""
    return _with_times(units, by, two_part_columns(), 60.0, {"p50_minutes": 0.5, "p90_minutes": 0.9, "p95_minutes": 0.95})


def grouping_report(units: DataFrame, families: dict[str, str]) -> DataFrame:
    """The two-part report overall and by each family of labels, each unit once for every family.

    families: family name to label column; a label 'Unknown' is left out of its family.
    """
    own = F.array(F.struct(F.lit("overall").alias("f"), F.lit("all").alias("l")), *(F.struct(F.lit(name).alias("f"), F.coalesce(c, F.lit("nan")).alias("l")) for name, c in families.items()))
    t = units.select("event_observed", "duration_hours", F.explode(own).alias("g")).select("*", F.col("g.f").alias("group_family"), F.col("g.l").alias("group_label"))
    return two_part(t.where("group_label <> 'Unknown'"), ["group_family", "group_label"])


def horizon_incidence(units: DataFrame, by: list[str], horizons=HORIZONS) -> DataFrame:
    """Of units observed for the horizon, or replied to within it, the share replied to within it."""
    hours = units.withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    s = F.col("duration_hours") * 3600
    e = F.col("event_observed") == 1
    follow = hours_between(F.col("created_at_utc"), F.col("observation_end")) * 3600 if "observation_end" in units.columns else s
    eligible = (follow >= F.col("h")) | (e & (s <= F.col("h")))
    n, k = F.count_if(eligible), F.count_if(eligible & e & (s <= F.col("h")))
    return hours.groupBy(*by, F.col("h").alias("horizon_seconds")).agg(n.alias("risk_set"), k.alias("n_events"), (k / F.nullif(n, F.lit(0))).alias("incidence"))


def scenarios(units: DataFrame, gap_start: Column, gap_end: Column) -> DataFrame:
    """Units under each window: all, before the gap (censored at its start), after it, and without the 6 or 24 hours before it."""
    t = units.withColumn("s", F.explode(F.array(*map(F.lit, ("full", "pre_gap", "post_gap", "exclude_6h", "exclude_24h")))))
    c = F.col("created_at_utc")
    near = lambda h: (c > gap_start - F.expr(f"INTERVAL '{h}' HOUR")) & (c <= gap_start)
    keep = F.when(F.col("s") == "full", True).when(F.col("s") == "pre_gap", c < gap_start).when(F.col("s") == "post_gap", c >= gap_end).when(F.col("s") == "exclude_6h", ~near(6)).otherwise(~near(24))
    t = t.where(keep)
    late = (F.col("s") == "pre_gap") & (F.coalesce(F.col("first_reply_at") > gap_start, F.lit(True)))
    return t.withColumns({
        "event_observed": F.when(late, 0).otherwise(F.col("event_observed")),
        "duration_hours": F.when(late, hours_between(c, gap_start)).otherwise(F.col("duration_hours")),
    }).withColumnRenamed("s", "scenario").where("duration_hours > 0")


def binned_hazard(units: DataFrame, bin_minutes: float = 0.25, max_minutes: float = 10) -> DataFrame:
    """At risk, events and rates by bin; exposure is at-risk times width; ends before the first empty risk set.

    Units are counted once by the bin of their duration; at-risk numbers are running sums
    from the right over these few bins.
    """
    bins = int(max_minutes / bin_minutes)
    m = F.col("duration_hours") * 60
    t = units.select(F.least(F.floor(m / bin_minutes), F.lit(bins)).cast("int").alias("b"), "event_observed")
    n = t.groupBy("b").agg(F.count("*").alias("n"), F.sum("event_observed").alias("e"))
    calendar = units.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    t = calendar.join(n, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("e", F.lit(0)).alias("n_events"))
    t = t.withColumn("at_risk", F.sum("n").over(Window.orderBy(F.desc("bin")))).where((F.col("bin") < bins) & (F.col("at_risk") > 0))
    rate = F.col("n_events") / (F.col("at_risk") * bin_minutes)
    return t.select("bin", (F.col("bin") * bin_minutes).alias("bin_start_minutes"), "at_risk", "n_events", rate.alias("hazard_per_minute"), (rate * 60).alias("hazard_per_hour"))


def kaplan_meier(units: DataFrame, decimals: int = 6) -> DataFrame:
    """Survival at the distinct event times, exactly as they are.

    Running sums over distinct times are taken within ranges of them (64 in each power of
    two) and over the table of ranges, so no task orders all times.
    """
    times = units.groupBy("duration_hours").agg(F.count("*").alias("n"), F.sum("event_observed").alias("d"))
    times = written(times.withColumn("range", F.floor(F.log2(F.col("duration_hours") * 3.6e9) * 64)), "times")
    ranges = times.groupBy("range").agg(F.sum("n").alias("n_range"))
    ranges = ranges.select(F.col("range").alias("r"), F.coalesce(F.sum("n_range").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    own = Window.partitionBy("range")
    t = times.join(ranges, F.col("range") == F.col("r")).withColumn("at_risk", F.col("later") + F.sum("n").over(own.orderBy(F.desc("duration_hours"))))
    t = t.where("d > 0").withColumn("log", F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0))
    t = written(t.withColumn("ends", F.when(F.col("d") == F.col("at_risk"), 1).otherwise(0)).select("range", "duration_hours", "at_risk", "d", "log", "ends"), "times")
    logs = t.groupBy("range").agg(F.sum("log").alias("log_range"))
    logs = logs.select(F.col("range").alias("r"), F.coalesce(F.sum("log_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("earlier"))
    # all are gone at the last time only, if at all
    s = F.when(F.col("ends") == 1, 0.0).otherwise(F.exp(F.col("earlier") + F.sum("log").over(own.orderBy("duration_hours"))))
    t = t.join(logs, F.col("range") == F.col("r")).withColumn("s", s)
    return t.select(F.round(F.col("duration_hours") * 3600, 6).alias("t_seconds"), "at_risk", F.col("d").alias("n_events"), F.round("s", decimals).alias("survival"))


def two_part_seconds(units: DataFrame, by: list[str]) -> DataFrame:
    """The report in seconds and percents: incidence, conditional times, shares within 30 s, 5 min and 1 h of all and of those replied to."""
    e, sec = F.col("event_observed") == 1, F.col("duration_hours") * 3600
    n, k = F.count("*"), F.count_if(e)
    named = {"30s": 30, "5m": 300, "1h": 3600}
    columns = [
        n.alias("n_parents"), k.alias("n_replies"), (100 * k / n).alias("reply_incidence_pct"),
        *((100 * F.count_if(e & (sec <= v)) / n).alias(f"p_reply_le_{c}_uncond_pct") for c, v in named.items()),
        *((100 * F.count_if(e & (sec <= v)) / F.nullif(k, F.lit(0))).alias(f"p_reply_le_{c}_cond_pct") for c, v in named.items()),
    ]
    return _with_times(units, by, columns, 3600.0, {"conditional_t50_seconds": 0.5, "conditional_t90_seconds": 0.9})
