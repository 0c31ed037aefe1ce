"""Queries over the conversation views: trees, survival, segments, time series, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import scalars as sc
from colloquy.operators import matching as mt
from colloquy.operators import quality as ql
from colloquy.operators import scan
from colloquy.operators import segments as sg
from colloquy.operators import survival as sv
from colloquy.operators import threads as th
from colloquy.operators import timeseries as ts
from colloquy.plans.registry import TWO_PART, VIEWS, category_sql, hours_sql, query
from colloquy.sources import adapters as ad
from colloquy.sources.scratch import written

SEGMENT_GAP_HOURS = 0.25


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as the statements round them, half away from zero after scaling, so that ties fall alike."""
    scaled = lambda c: F.col(c) * 10.0**digits
    return df.withColumns({c: F.when(F.abs(scaled(c)) < float("inf"), F.round(scaled(c)) / 10.0**digits).otherwise(F.col(c)) for c, t in df.dtypes if t == "double"})


def events(spark, d) -> DataFrame:
    return th.thread_events(ad.comments(spark, d), ad.posts(spark, d))


def flat_events(spark, d) -> DataFrame:
    """Thread events for queries that need no depth: the tree is not walked."""
    c = ad.comments(spark, d)
    return th.thread_events(c, ad.posts(spark, d), c.select("comment_id", F.lit(None).cast("int").alias("depth")))


def units(spark, d) -> DataFrame:
    return sv.survival_units(flat_events(spark, d))


def labelled_units(spark, d) -> DataFrame:
    a = ad.agents(spark, d)
    return units(spark, d).join(a, F.col("comment_agent_id") == F.col("agent_id"), "left")


# trees

@query(VIEWS + "SELECT comment_id, depth FROM comments LEFT JOIN dep USING (comment_id)")
def depth_recursive(spark, d):
    return th.tree_depths(ad.comments(spark, d))


@query(VIEWS + "SELECT coalesce(depth, -1)::INT AS depth, count(*) AS n FROM te GROUP BY 1")
def depth_histogram(spark, d):
    t = th.tree_depths(ad.comments(spark, d))
    return t.groupBy(F.coalesce("depth", F.lit(-1)).alias("depth")).agg(F.count("*").alias("n"))


@query(VIEWS + """, o AS (SELECT c.*, p.comment_id AS p_id FROM comments c LEFT JOIN comments p ON c.parent_id = p.comment_id AND c.post_id = p.post_id AND (p.created_at_utc, p.comment_id) < (c.created_at_utc, c.comment_id)),
g AS (SELECT comment_id, CASE WHEN parent_id IS NULL THEN 1 ELSE -1 END AS depth FROM o WHERE p_id IS NULL UNION ALL SELECT o.comment_id, g.depth + 1 FROM o JOIN g ON o.p_id = g.comment_id)
SELECT comment_id, depth FROM g""")
def depth_single_pass(spark, d):
    return th.tree_depths(ad.comments(spark, d), "ordered")


@query(VIEWS + """, up AS (SELECT c.comment_id, c.post_id, c.parent_id, c.parent_id IS NOT NULL AND p.comment_id IS NULL AS lost FROM comments c LEFT JOIN comments p ON c.parent_id = p.comment_id AND c.post_id = p.post_id),
below AS (SELECT comment_id, post_id FROM up WHERE lost UNION ALL SELECT c.comment_id, c.post_id FROM comments c JOIN below b ON c.parent_id = b.comment_id AND c.post_id = b.post_id)
SELECT count(*) AS n_comments, count_if(parent_id IS NULL) AS n_roots, count_if(lost) AS n_missing_parents, count_if(depth IS NULL) AS n_unresolved,
(SELECT count(*) FROM below) AS n_below_missing, count_if(depth IS NULL) - (SELECT count(*) FROM below) AS n_cycle FROM up LEFT JOIN dep USING (comment_id)""")
def depth_diagnostics(spark, d):
    return th.depth_diagnostics(ad.comments(spark, d))


@query("""SELECT count(*) AS n, count_if(event_id % 4 = 0) AS n_comment_parents, count_if(event_id % 4 = 1) AS n_submission_parents, count_if(event_id % 4 = 1 AND event_id <> event_id // 10 * 10 + 1) AS n_submission_mismatches,
count_if(event_id % 4 NOT IN (0, 1)) AS n_unknown_prefixes FROM events""")
def reference_diagnostics(spark, d):
    """Forum references made of event ids; a submission's own id ends in 1."""
    k = F.col("event_id")
    ref = F.when(k % 4 == 0, F.concat(F.lit("t1_"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("t3_"), k.cast("string"))).when(k % 4 == 2, k.cast("string"))
    return th.reference_diagnostics(ad.table(spark, d, "events"), ref, (F.floor(k / 10) * 10 + 1).cast("string"))


@query(VIEWS + """SELECT comment_id, thread_id, parent_id, comment_agent_id, created_at_utc, submolt_category, parent_type, parent_agent_id, round(lag_since_parent_hours, 6) AS lag_since_parent_hours,
round(lag_since_post_hours, 6) AS lag_since_post_hours, depth, n_children FROM te""")
def thread_events(spark, d):
    keep = ["comment_id", "thread_id", "parent_id", "comment_agent_id", "created_at_utc", "submolt_category", "parent_type", "parent_agent_id", "lag_since_parent_hours", "lag_since_post_hours", "depth", "n_children"]
    return rounded(events(spark, d).select(keep))


@query(VIEWS + "SELECT comment_id, coalesce(n_children, 0) AS n_children FROM comments LEFT JOIN (SELECT parent_id AS p, n_children FROM kids) k ON k.p = comment_id")
def child_counts(spark, d):
    c = ad.comments(spark, d)
    k = th.child_counts(c).withColumnRenamed("parent_id", "p")
    return c.join(k, F.col("comment_id") == F.col("p"), "left").select("comment_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT o_orderkey, count(*) FROM orders GROUP BY 1 HAVING count(*) > 1")
def many_to_one_check(spark, d):
    """Keys that break a many-to-one join: many of lines, none of orders."""
    lines, orders = ad.table(spark, d, "lineitem"), ad.table(spark, d, "orders")
    return th.many_to_one(lines, "l_orderkey").unionByName(th.many_to_one(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey"))


@query(VIEWS + """SELECT thread_id, submolt, submolt_category, post_created_at_utc, n_comments, n_unique_agents, depth_max, round(depth_mean, 6) AS depth_mean, first_comment_at, last_comment_at,
round(thread_duration_hours, 6) AS thread_duration_hours, round(reentry_rate, 6) AS reentry_rate, early_comments FROM tm""")
def thread_metrics(spark, d):
    return rounded(th.thread_metrics(events(spark, d)))


@query(VIEWS + "SELECT depth, round(avg(n_children), 6) AS mean_children, median(n_children)::DOUBLE AS median_children, count(*) AS n_nodes FROM (SELECT 0 AS depth, count_if(parent_id IS NULL) AS n_children FROM te GROUP BY thread_id UNION ALL SELECT depth, n_children FROM te WHERE depth IS NOT NULL) GROUP BY depth")
def branching_by_depth(spark, d):
    return rounded(th.branching_by_depth(events(spark, d)))


@query(VIEWS + "SELECT depth_max, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM tm GROUP BY 1")
def depth_distribution(spark, d):
    return rounded(th.share_table(th.thread_metrics(events(spark, d)), "depth_max"))


@query(VIEWS + "SELECT thread_id, comment_id, row_number() OVER (PARTITION BY thread_id, comment_agent_id ORDER BY created_at_utc, comment_id) > 1 AS seen FROM te WHERE comment_agent_id IS NOT NULL")
def reentry_seen_before(spark, d):
    return th.seen_before(flat_events(spark, d))


@query(VIEWS + "SELECT thread_id, round(reentry_rate, 6) AS reentry_rate, n_unique_agents FROM tm")
def reentry(spark, d):
    return rounded(th.thread_metrics(flat_events(spark, d)).select("thread_id", "reentry_rate", "n_unique_agents"))


HIST = """, b AS (SELECT least(floor(reentry_rate * 20), 19)::INT AS bin, count(*) AS n FROM tm WHERE reentry_rate IS NOT NULL GROUP BY 1)
SELECT k::INT AS bin, round(k / 20.0::DOUBLE, 6) AS bin_left, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM b)::DOUBLE, 6) AS share FROM range(20) t(k) LEFT JOIN b ON bin = k"""


@query(VIEWS + HIST)
def reentry_hist20(spark, d):
    return rounded(th.unit_histogram(th.thread_metrics(flat_events(spark, d)), "reentry_rate"))


@query(VIEWS + "SELECT thread_id, count(*) AS dyads, count_if(reciprocal) AS reciprocal_dyads, round(count_if(reciprocal)::DOUBLE / count(*), 6) AS reciprocity_rate FROM dy GROUP BY 1")
def reciprocity_thread(spark, d):
    return rounded(th.reciprocity(th.dyads(flat_events(spark, d)), ["thread_id"]))


@query(VIEWS + "SELECT count(*) AS dyads, count_if(reciprocal) AS reciprocal_dyads, round(count_if(reciprocal)::DOUBLE / count(*), 6) AS reciprocity_rate FROM dy")
def reciprocity_overall(spark, d):
    return rounded(th.reciprocity(th.dyads(flat_events(spark, d)), []))


@query(VIEWS + """, l AS (SELECT *, lag(src) OVER w AS s0, lag(dst) OVER w AS d0 FROM edges WINDOW w AS (PARTITION BY thread_id ORDER BY created_at_utc, comment_id)),
i AS (SELECT *, sum(CASE WHEN src = d0 AND dst = s0 THEN 0 ELSE 1 END) OVER (PARTITION BY thread_id ORDER BY created_at_utc, comment_id) AS island FROM l)
SELECT thread_id, count(*) AS length, min(created_at_utc) AS start FROM i GROUP BY thread_id, island HAVING count(*) >= 2""")
def reciprocal_chains(spark, d):
    return th.reciprocal_chains(flat_events(spark, d))


METRICS = ["n_comments", "n_unique_agents", "depth_max", "thread_duration_hours", "reentry_rate"]


@query(VIEWS + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c}::DOUBLE AS v FROM tm" for c in METRICS) + ") SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1")
def descriptive_stats(spark, d):
    return rounded(th.descriptive(th.thread_metrics(events(spark, d)), METRICS))


@query(VIEWS + """, p AS (SELECT k, (SELECT avg((depth_max >= k)::INT) FROM tm WHERE depth_max IS NOT NULL) AS p FROM range(1, (SELECT max(depth_max) + 1 FROM tm)) t(k))
SELECT round(exp(sum(k * ln(p)) / sum(k * k)), 6) AS mu, round(-sum(k * ln(p)) / sum(k * k), 6) AS slope, count(*) AS n_levels FROM p""")
def depth_tail_mu(spark, d):
    return rounded(th.depth_tail_slope(th.thread_metrics(events(spark, d))))


@query(VIEWS + "SELECT n_comments AS value, round(max(e), 6) AS ecdf FROM (SELECT n_comments, cume_dist() OVER (ORDER BY n_comments) AS e FROM tm) GROUP BY 1")
def ecdf_comments(spark, d):
    return rounded(ts.ecdf(th.thread_metrics(flat_events(spark, d)), "n_comments"))


# survival

@query(VIEWS + "SELECT thread_id, comment_id, comment_agent_id, created_at_utc, submolt_category, first_reply_at, event_observed, round(duration_hours, 6) AS duration_hours, excluded_censor_boundary FROM su")
def survival_units(spark, d):
    return rounded(units(spark, d))


@query(VIEWS + "SELECT parent_id, first_reply_at FROM fr")
def first_replies(spark, d):
    return sv.first_replies(ad.comments(spark, d))


@query(VIEWS + "SELECT excluded_censor_boundary, count(*) AS n, sum(event_observed)::BIGINT AS n_events FROM su GROUP BY 1")
def boundary_split(spark, d):
    return units(spark, d).groupBy("excluded_censor_boundary").agg(F.count("*").alias("n"), F.sum("event_observed").alias("n_events"))


LABELS = """, lab AS (SELECT *, CASE WHEN is_claimed IS NULL THEN 'Unknown' WHEN is_claimed = 1 THEN 'Claimed' ELSE 'Unclaimed' END AS claim FROM sul)"""


@query(VIEWS + LABELS + "".join(f" {u} SELECT '{f}' AS group_family, {e} AS group_label, {TWO_PART} FROM lab {w} GROUP BY ALL" for u, f, e, w in (("", "overall", "'all'", ""), ("UNION ALL", "category", "submolt_category", ""), ("UNION ALL", "claim", "claim", "WHERE claim <> 'Unknown'"))))
def two_part_grouping_sets(spark, d):
    u = labelled_units(spark, d).withColumn("claim", sc.claim_label(F.col("is_claimed"), "two_part"))
    return rounded(sv.grouping_report(u, {"category": "submolt_category", "claim": "claim"}))


FAMILIES = {"overall": "'Overall'", "category": "submolt_category", "is_claimed": "CASE WHEN is_claimed = 1 THEN 'Claimed' ELSE 'Unclaimed' END", "follower_count_bin": "CASE WHEN follower_count <= 0 THEN '0' WHEN follower_count <= 9 THEN '1-9' WHEN follower_count > 9 THEN '10+' END"}


def family_units(spark, d) -> DataFrame:
    """Units outside the censoring boundary, once for each family of labels that they have one of."""
    u = labelled_units(spark, d).where(~F.col("excluded_censor_boundary"))
    labels = {"overall": F.lit("Overall"), "category": F.col("submolt_category"), "is_claimed": sc.claim_label(F.col("is_claimed"), "primary"), "follower_count_bin": sc.follower_bin(F.col("follower_count"))}
    own = F.explode(F.array(*(F.struct(F.lit(k).alias("group_family"), c.alias("group_label")) for k, c in labels.items())))
    return u.withColumn("own", own).select("*", "own.*").where("group_label is not null")


@query(VIEWS + ", f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS group_family, {c} AS group_label, * FROM sul WHERE NOT excluded_censor_boundary" for k, c in FAMILIES.items()) + """)
SELECT group_family, group_label, count(*) AS n_parent_comments, count_if(event_observed = 1) AS n_events, round(avg(event_observed), 6) AS observed_reply_probability,
round(median(CASE WHEN event_observed = 1 THEN duration_hours * 60 END), 6) AS conditional_median_reply_minutes, count(DISTINCT thread_id) AS n_threads FROM f WHERE group_label IS NOT NULL GROUP BY 1, 2""")
def reply_dynamics_counts(spark, d):
    """What is counted of reply dynamics, by family and label."""
    by = ["group_family", "group_label"]
    u = written(family_units(spark, d).select(*by, "event_observed", (F.col("duration_hours") * 60).alias("minutes"), "thread_id"), "units")
    t = u.groupBy(*by).agg(
        F.count("*").alias("n_parent_comments"), F.count_if(F.col("event_observed") == 1).alias("n_events"), F.avg("event_observed").alias("observed_reply_probability"), F.count_distinct("thread_id").alias("n_threads"),
    )
    return rounded(scan.with_quantiles(t, u.where("event_observed = 1"), "minutes", {"conditional_median_reply_minutes": 0.5}, by))


@query()
def reply_dynamics(spark, d):
    """Reply dynamics by family and label: counts, and the half-life and chance of a reply of the fitted hazard."""
    from colloquy.operators import fits as ft

    u = family_units(spark, d).withColumn("group", F.concat_ws("|", "group_family", "group_label"))
    fits = ft.fit_by_group(u, "group", least_units=1, least_events=1).select(F.col("group").alias("fitted"), "alpha", "beta")
    t = reply_dynamics_counts(spark, d).withColumn("group", F.concat_ws("|", "group_family", "group_label")).join(fits, F.col("group") == F.col("fitted"), "left").drop("group", "fitted")
    return rounded(t.withColumns({"half_life_hours": F.log(F.lit(2.0)) / F.col("beta"), "implied_eventual_reply_probability": sc.reply_probability(F.col("alpha"), F.col("beta"))}).drop("alpha", "beta"))


SECONDS = """count(*) AS n_parents, count_if(event_observed = 1) AS n_replies, round(100 * avg(event_observed), 6) AS reply_incidence_pct,
round(quantile_cont(CASE WHEN event_observed = 1 THEN duration_hours * 3600 END, 0.5), 6) AS conditional_t50_seconds, round(quantile_cont(CASE WHEN event_observed = 1 THEN duration_hours * 3600 END, 0.9), 6) AS conditional_t90_seconds, """ + ", ".join(
    f"round(100 * count_if(event_observed = 1 AND duration_hours * 3600 <= {v})::DOUBLE / count(*), 6) AS p_reply_le_{k}_uncond_pct, round(100 * count_if(event_observed = 1 AND duration_hours * 3600 <= {v})::DOUBLE / nullif(count_if(event_observed = 1), 0), 6) AS p_reply_le_{k}_cond_pct" for k, v in {"30s": 30, "5m": 300, "1h": 3600}.items()
)


@query(VIEWS + """SELECT CASE WHEN follower_count <= 0 THEN '0' WHEN follower_count <= 9 THEN '1-9' WHEN follower_count > 9 THEN '10+' END AS followers, count(*) AS n,
round(avg(event_observed), 6) AS incidence FROM sul GROUP BY 1""")
def follower_bins(spark, d):
    t = labelled_units(spark, d).groupBy(sc.follower_bin(F.col("follower_count")).alias("followers"))
    return rounded(t.agg(F.count("*").alias("n"), F.avg("event_observed").alias("incidence")))


@query(VIEWS + """SELECT variant, label, count(*) AS n FROM (SELECT unnest([('primary', CASE WHEN is_claimed = 1 THEN 'Claimed' ELSE 'Unclaimed' END), ('strict', CASE WHEN is_claimed = 1 THEN 'Claimed' WHEN is_claimed = 0 THEN 'Unclaimed' ELSE 'Unknown' END),
('two_part', CASE WHEN is_claimed IS NULL THEN 'Unknown' WHEN is_claimed = 1 THEN 'Claimed' ELSE 'Unclaimed' END)]) AS v FROM sul) t, LATERAL (SELECT v[1] AS variant, v[2] AS label) GROUP BY 1, 2""")
def claim_variants(spark, d):
    u = labelled_units(spark, d)
    v = F.array(*(F.struct(F.lit(k).alias("variant"), sc.claim_label(F.col("is_claimed"), k).alias("label")) for k in ("primary", "strict", "two_part")))
    return u.select(F.explode(v).alias("v")).groupBy("v.variant", "v.label").agg(F.count("*").alias("n"))


FOLLOW = hours_sql("created_at_utc", "observation_end") + " * 3600"


@query(VIEWS + f""", r AS (SELECT *, {FOLLOW} >= h OR (event_observed = 1 AND duration_hours * 3600 <= h) AS ok, event_observed = 1 AND duration_hours * 3600 <= h AS hit FROM sul, (SELECT unnest([30, 300, 3600]) AS h))
SELECT submolt_category, h AS horizon_seconds, count_if(ok) AS risk_set, count_if(ok AND hit) AS n_events, round(count_if(ok AND hit)::DOUBLE / nullif(count_if(ok), 0), 6) AS incidence FROM r GROUP BY 1, 2""")
def horizon_risk_set(spark, d):
    end = ad.comments(spark, d).agg(F.max("created_at_utc").alias("observation_end"))
    u = units(spark, d).crossJoin(F.broadcast(end))
    return rounded(sv.horizon_incidence(u, ["submolt_category"]))


GAPS = f""", lg AS (SELECT *, lag(created_at_utc) OVER (ORDER BY created_at_utc, comment_id) AS prev FROM comments),
gaps AS (SELECT prev AS gap_start, created_at_utc AS gap_end, {hours_sql("prev", "created_at_utc")} AS gap_hours FROM lg WHERE {hours_sql("prev", "created_at_utc")} > {SEGMENT_GAP_HOURS}),
pg AS (SELECT * FROM gaps ORDER BY gap_hours DESC, gap_start LIMIT 1)"""


@query(VIEWS + GAPS + "SELECT gap_start, gap_end, round(gap_hours, 6) AS gap_hours FROM gaps")
def time_gaps(spark, d):
    return rounded(sg.time_gaps(ad.comments(spark, d), "created_at_utc", "comment_id", SEGMENT_GAP_HOURS))


def the_gap(spark, d):
    return sg.primary_gap(ad.comments(spark, d), "created_at_utc", "comment_id", SEGMENT_GAP_HOURS)


@query(VIEWS + GAPS + f""", ev2 AS (SELECT 'comments' AS table_name, created_at_utc AS t, comment_id AS k FROM comments UNION ALL SELECT 'posts', post_created_at_utc, thread_id FROM posts),
l2 AS (SELECT *, lag(t) OVER (PARTITION BY table_name ORDER BY t, k) AS prev FROM ev2) SELECT table_name, round(max({hours_sql("prev", "t")}), 6) AS max_gap_hours, count_if(t > gap_start AND t < gap_end) AS rows_in_gap FROM l2, pg GROUP BY 1""")
def gap_evidence(spark, d):
    tables = {"comments": (ad.comments(spark, d), "created_at_utc", "comment_id"), "posts": (ad.posts(spark, d), "post_created_at_utc", "thread_id")}
    return rounded(sg.gap_evidence(tables, the_gap(spark, d)))


SCENARIOS = GAPS + """, sc AS (SELECT * FROM (SELECT su.*, gap_start, gap_end, unnest(['full', 'pre_gap', 'post_gap', 'exclude_6h', 'exclude_24h']) AS scenario FROM su, pg)
  WHERE CASE scenario WHEN 'full' THEN true WHEN 'pre_gap' THEN created_at_utc < gap_start WHEN 'post_gap' THEN created_at_utc >= gap_end
  WHEN 'exclude_6h' THEN NOT (created_at_utc > gap_start - INTERVAL 6 HOUR AND created_at_utc <= gap_start) ELSE NOT (created_at_utc > gap_start - INTERVAL 24 HOUR AND created_at_utc <= gap_start) END),
s2 AS (SELECT * REPLACE (CASE WHEN late THEN 0 ELSE event_observed END AS event_observed, CASE WHEN late THEN """ + hours_sql("created_at_utc", "gap_start") + """ ELSE duration_hours END AS duration_hours)
  FROM (SELECT *, scenario = 'pre_gap' AND coalesce(first_reply_at > gap_start, true) AS late FROM sc))"""


@query(VIEWS + SCENARIOS + "SELECT scenario, " + TWO_PART + " FROM s2 WHERE duration_hours > 0 GROUP BY 1")
def gap_windows(spark, d):
    u = units(spark, d).crossJoin(F.broadcast(the_gap(spark, d)))
    return rounded(sv.two_part(sv.scenarios(u, F.col("gap_start"), F.col("gap_end")), ["scenario"]))


@query(VIEWS + SCENARIOS + "SELECT scenario, " + SECONDS + " FROM s2 WHERE duration_hours > 0 GROUP BY 1")
def gap_windows_seconds(spark, d):
    """The same windows in seconds and percents."""
    u = units(spark, d).crossJoin(F.broadcast(the_gap(spark, d)))
    return rounded(sv.two_part_seconds(sv.scenarios(u, F.col("gap_start"), F.col("gap_end")), ["scenario"]))


@query(VIEWS + """, b AS (SELECT least(floor(duration_hours * 60 / 15), 40)::INT AS b, event_observed AS e FROM su WHERE NOT excluded_censor_boundary),
h AS (SELECT k::INT AS bin, (SELECT count(*) FROM b WHERE b >= k) AS at_risk, (SELECT count(*) FROM b WHERE b = k AND e = 1) AS n_events FROM range(40) t(k))
SELECT bin, bin * 15.0::DOUBLE AS bin_start_minutes, at_risk, n_events, round(n_events / (at_risk * 15.0::DOUBLE), 6) AS hazard_per_minute, round(n_events / (at_risk * 15.0::DOUBLE) * 60, 6) AS hazard_per_hour FROM h WHERE at_risk > 0""")
def hazard_binned(spark, d):
    return rounded(sv.binned_hazard(units(spark, d).where(~F.col("excluded_censor_boundary")), 15.0, 600.0))


@query(VIEWS + """, n AS (SELECT duration_hours AS h, count(*) AS n, sum(event_observed)::BIGINT AS d FROM su GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY h DESC) AS at_risk FROM n), k AS (SELECT *, sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk::DOUBLE) ELSE 0 END) OVER (ORDER BY h) AS l, max((d = at_risk)::INT) OVER (ORDER BY h) AS gone FROM r WHERE d > 0)
SELECT round(h * 3600, 6) AS t_seconds, at_risk::BIGINT AS at_risk, d AS n_events, round(CASE WHEN gone = 1 THEN 0 ELSE exp(l) END, 6) AS survival FROM k""")
def km_curve(spark, d):
    return sv.kaplan_meier(units(spark, d))


SEGMENTS = GAPS + f""", sg AS (SELECT *, sum(CASE WHEN {hours_sql("prev", "created_at_utc")} > {SEGMENT_GAP_HOURS} THEN 1 ELSE 0 END) OVER (ORDER BY created_at_utc, comment_id) AS segment FROM lg),
seg AS (SELECT segment, min(created_at_utc) AS start, max(created_at_utc) AS "end", count(*) AS n, {hours_sql("min(created_at_utc)", "max(created_at_utc)")} AS duration_hours FROM sg GROUP BY 1)"""


def all_segments(spark, d):
    return sg.segments(ad.comments(spark, d), "created_at_utc", "comment_id", SEGMENT_GAP_HOURS)


@query(VIEWS + SEGMENTS + 'SELECT segment::BIGINT AS segment, start, "end", n, round(duration_hours, 6) AS duration_hours FROM seg')
def segments(spark, d):
    return rounded(all_segments(spark, d))


@query(VIEWS + SEGMENTS + 'SELECT start, "end", n, round(duration_hours, 6) AS duration_hours FROM seg ORDER BY seg.duration_hours DESC, start LIMIT 1')
def segments_longest_duration(spark, d):
    return rounded(sg.pick_segment(all_segments(spark, d)).drop("segment"))


@query(VIEWS + SEGMENTS + 'SELECT start, "end", n, round(duration_hours, 6) AS duration_hours FROM seg ORDER BY n DESC, seg.duration_hours DESC, start DESC LIMIT 1')
def segments_most_events(spark, d):
    return rounded(sg.pick_segment(all_segments(spark, d), "count").drop("segment"))


# time series

BINS = """, n AS (SELECT time_bucket(INTERVAL 15 MINUTE, created_at_utc) AS b, count(*) AS c FROM comments GROUP BY 1),
cal AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 15 MINUTE)) AS bin FROM n), series AS (SELECT bin, coalesce(c, 0) AS n FROM cal LEFT JOIN n ON b = bin)"""


@query(VIEWS + BINS + "SELECT bin, n FROM series")
def bins_calendar(spark, d):
    return ts.binned_counts(ad.comments(spark, d), "created_at_utc", 15)


@query(VIEWS + BINS + """, y AS (SELECT bin, n, ln(1 + n) AS v, avg(ln(1 + n)) OVER (ORDER BY bin ROWS BETWEEN 48 PRECEDING AND 47 FOLLOWING) AS m FROM series)
SELECT bin, n, round(v - m - avg(v - m) OVER (), 6) AS y FROM y""")
def detrended_series(spark, d):
    return rounded(ts.detrended(ts.binned_counts(ad.comments(spark, d), "created_at_utc", 15)))


@query(VIEWS + """, a AS (SELECT 2 * pi() * ((epoch_us(created_at_utc) / 1e6) % 14400) / 14400 AS w FROM comments), s AS (SELECT count(*) AS n, sum(cos(w)) AS c, sum(sin(w)) AS s FROM a)
SELECT n, round(sqrt(c * c + s * s) / n, 6) AS r, round((c * c + s * s) / n, 6) AS z, round(atan2(s, c), 6) AS mean_phase, round(exp(-(c * c + s * s) / n), 6) AS p_value FROM s""")
def rayleigh(spark, d):
    return rounded(ts.rayleigh(ad.comments(spark, d), "created_at_utc", 4))


ACF = BINS + """, ag AS (SELECT comment_agent_id AS agent FROM comments WHERE comment_agent_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
g AS (SELECT agent, bin, count(c.comment_id) AS c FROM ag CROSS JOIN cal LEFT JOIN comments c ON c.comment_agent_id = agent AND time_bucket(INTERVAL 15 MINUTE, c.created_at_utc) = bin GROUP BY 1, 2),
l AS (SELECT *, lead(c, 16) OVER (PARTITION BY agent ORDER BY bin) AS nx FROM g)"""


@query(VIEWS + ACF + """
SELECT agent, sum(c)::BIGINT AS n, round(corr(c, nx), 6) AS correlation FROM l GROUP BY 1 HAVING var_pop(CASE WHEN nx IS NOT NULL THEN c END) > 0 AND var_pop(nx) > 0""")
def lag_acf(spark, d):
    return rounded(ts.lag_correlation(ad.comments(spark, d), "created_at_utc", "comment_agent_id", 15, 16, 10))


@query("SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return ad.table(spark, d, "events").groupBy("event_type", F.window("ts", "30 minutes")["start"].alias("start")).agg(F.count("*").alias("n"))


@query("SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_of_day(spark, d):
    return ad.table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


# matching: even threads against odd threads

SIDES = """, el AS (SELECT *, CASE submolt_category WHEN 'Builder/Technical' THEN 'tech' WHEN 'Philosophy/Meta' THEN 'meta' WHEN 'Spam/Low-Signal' THEN 'spam' ELSE 'general' END AS topic, hour(post_created_at_utc)::INT // 6 AS hour,
CASE WHEN early_comments <= 0 THEN '0' WHEN early_comments <= 2 THEN '1-2' WHEN early_comments <= 5 THEN '3-5' WHEN early_comments <= 10 THEN '6-10' ELSE '11+' END AS early_bin, thread_id % 2 AS side FROM tm),
ov AS (SELECT * FROM el WHERE (topic, hour, early_bin) IN (SELECT (topic, hour, early_bin) FROM el GROUP BY topic, hour, early_bin HAVING count(DISTINCT side) = 2)),
rk AS (SELECT *, row_number() OVER (PARTITION BY side, topic, hour, early_bin ORDER BY early_comments, post_created_at_utc, thread_id) AS rank FROM ov),
pr AS (SELECT row_number() OVER (ORDER BY a.topic, a.hour, a.early_bin, a.rank) AS pair_id, a.topic, a.hour, a.early_bin, a.thread_id AS thread_id_a, b.thread_id AS thread_id_b, """ + ", ".join(
    f"a.{c} AS {c}_a, b.{c} AS {c}_b, (a.{c} - b.{c})::DOUBLE AS diff_{c}" for c in mt.OUTCOMES
) + " FROM rk a JOIN rk b ON a.side = 0 AND b.side = 1 AND a.topic = b.topic AND a.hour = b.hour AND a.early_bin = b.early_bin AND a.rank = b.rank)"


def sides(spark, d, depth: bool = True):
    m = th.thread_metrics(events(spark, d) if depth else flat_events(spark, d))
    m = m.withColumns({
        "topic": sc.lookup(F.col("submolt_category"), sc.TOPIC_BY_CATEGORY), "hour": F.floor(F.hour("post_created_at_utc") / 6).cast("int"), "early_bin": sc.early_bin(F.col("early_comments")),
    })
    m = written(mt.eligible(m), "metrics")  # each side reads it, in overlaps and pairs
    return m.where("thread_id % 2 = 0"), m.where("thread_id % 2 = 1")


@query(VIEWS + SIDES + "SELECT topic, hour, early_bin, count_if(side = 0) AS n_a, count_if(side = 1) AS n_b, least(count_if(side = 0), count_if(side = 1)) AS n_pairs FROM ov GROUP BY 1, 2, 3")
def strata_overlap(spark, d):
    return mt.strata_counts(*mt.overlap(*sides(spark, d, False)))


@query(VIEWS + SIDES + "SELECT pair_id, topic, hour, early_bin, thread_id_a, thread_id_b, " + ", ".join(f"round({c}_a, 6) AS {c}_a, round({c}_b, 6) AS {c}_b, round(diff_{c}, 6) AS diff_{c}" if c in ("thread_duration_hours", "reentry_rate") else f"{c}_a, {c}_b, round(diff_{c}, 6) AS diff_{c}" for c in mt.OUTCOMES) + " FROM pr")
def matched_pairs(spark, d):
    return rounded(mt.matched_pairs(*mt.overlap(*sides(spark, d))))


COVARIATES = ["n_comments", "n_unique_agents", "early_comments", "thread_duration_hours"]


SMD_SIDES = ", ".join(f"{f}(CASE WHEN side = {k} THEN v END) AS {n}{k}" for f, n in (("avg", "m"), ("var_samp", "v")) for k in (0, 1))


@query(VIEWS + SIDES + ", lc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS covariate, side, {c}::DOUBLE AS v FROM el" for c in COVARIATES) + f"), ms AS (SELECT covariate, {SMD_SIDES} FROM lc GROUP BY 1), " + """sd AS (SELECT *, sqrt((v0 + v1) / 2) AS sd FROM ms)
SELECT covariate, round(m0, 6) AS mean_a, round(m1, 6) AS mean_b, round(CASE WHEN sd > 0 THEN (m0 - m1) / sd WHEN m0 = m1 THEN 0 END, 6) AS smd FROM sd""")
def smd_numeric(spark, d):
    return rounded(mt.numeric_balance(*sides(spark, d, False), COVARIATES))


SHARES = """, lv AS (SELECT side, covariate, level, count(*) AS n FROM (SELECT side, 'topic' AS covariate, topic AS level FROM el UNION ALL SELECT side, 'hour', hour::VARCHAR FROM el UNION ALL SELECT side, 'early_bin', early_bin FROM el) GROUP BY ALL),
sh AS (SELECT covariate, level, coalesce(sum(CASE WHEN side = 0 THEN n END), 0) / (SELECT count(*) FROM el WHERE side = 0)::DOUBLE AS share_a, coalesce(sum(CASE WHEN side = 1 THEN n END), 0) / (SELECT count(*) FROM el WHERE side = 1)::DOUBLE AS share_b FROM lv GROUP BY 1, 2)"""


def shares(spark, d):
    a, b = sides(spark, d, False)
    return mt.level_shares(a, b, mt.STRATUM), a, b


@query(VIEWS + SIDES + SHARES + """, nn AS (SELECT count_if(side = 0)::DOUBLE AS na, count_if(side = 1)::DOUBLE AS nb FROM el), v AS (SELECT *, sqrt((share_a * (1 - share_a) * na / (na - 1) + share_b * (1 - share_b) * nb / (nb - 1)) / 2) AS sd FROM sh, nn)
SELECT covariate, level, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b, round(CASE WHEN sd > 0 THEN (share_a - share_b) / sd WHEN share_a = share_b THEN 0 END, 6) AS smd FROM v""")
def smd_levels(spark, d):
    s, a, b = shares(spark, d)
    return rounded(mt.level_balance(s, a.count(), b.count()))


@query(VIEWS + SIDES + SHARES + "SELECT covariate, round(sum(abs(share_a - share_b)) / 2, 6) AS tvd FROM sh GROUP BY 1")
def tvd(spark, d):
    return rounded(mt.total_variation(shares(spark, d)[0]))


PAIRED = SIDES + ", lo AS (" + " UNION ALL ".join(f"SELECT '{c}' AS outcome, {c}_a::DOUBLE AS a, {c}_b::DOUBLE AS b, round_even(diff_{c}, 12) AS d FROM pr" for c in mt.OUTCOMES) + """),
rn AS (SELECT *, rank() OVER (PARTITION BY outcome ORDER BY abs(d)) + (count(*) OVER (PARTITION BY outcome, abs(d)) - 1) / 2.0::DOUBLE AS r FROM lo WHERE d <> 0),
ws AS (SELECT outcome, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS w_plus, coalesce(sum(CASE WHEN d < 0 THEN r END), 0) AS w_minus FROM rn GROUP BY 1)"""


@query(VIEWS + PAIRED + """SELECT outcome, count(*) AS n_pairs, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(d), 6) AS mean_diff, round(median(d), 6) AS median_diff, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) END, 6) AS cohen_d,
count_if(d > 0) AS n_positive, count_if(d < 0) AS n_negative FROM lo WHERE d IS NOT NULL GROUP BY 1""")
def paired_effects(spark, d):
    return rounded(mt.paired_effects(mt.matched_pairs(*mt.overlap(*sides(spark, d)))).drop("w_plus", "w_minus", "wilcoxon", "ties"))


@query(VIEWS + PAIRED + "SELECT outcome, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, coalesce(least(w_plus, w_minus), 0) AS wilcoxon FROM (SELECT DISTINCT outcome FROM lo WHERE d IS NOT NULL) LEFT JOIN ws USING (outcome)")
def wilcoxon_stat(spark, d):
    return mt.paired_effects(mt.matched_pairs(*mt.overlap(*sides(spark, d)))).select("outcome", "w_plus", "w_minus", "wilcoxon")


@query(VIEWS + SIDES + """, f AS (SELECT 'all' AS stage, side, count(*) AS n FROM tm, LATERAL (SELECT thread_id % 2 AS side) GROUP BY ALL UNION ALL SELECT 'eligible', side, count(*) FROM el GROUP BY side UNION ALL SELECT 'overlap', side, count(*) FROM ov GROUP BY side UNION ALL SELECT 'pairs', s, (SELECT count(*) FROM pr) FROM (VALUES (0), (1)) v(s))
SELECT stage, CASE side WHEN 0 THEN 'a' ELSE 'b' END AS platform, n, round(n / (SELECT n FROM f g WHERE g.stage = 'all' AND g.side = f.side)::DOUBLE, 6) AS share FROM f""")
def sample_flow(spark, d):
    m = th.thread_metrics(flat_events(spark, d)).select("thread_id")
    a, b = sides(spark, d, False)
    oa, ob = mt.overlap(a, b)
    p = mt.matched_pairs(oa, ob)
    return rounded(mt.sample_flow([("all", "a", m.where("thread_id % 2 = 0")), ("all", "b", m.where("thread_id % 2 = 1")), ("eligible", "a", a), ("eligible", "b", b), ("overlap", "a", oa), ("overlap", "b", ob), ("pairs", "a", p), ("pairs", "b", p)]))


# keyword categories and reports

@query(VIEWS + f"SELECT thread_id, submolt, {category_sql('submolt')} AS category, {category_sql('submolt', 'expanded')} AS expanded, {category_sql('submolt', token_only=True)} AS token_only FROM posts")
def keyword_category(spark, d):
    name = F.col("submolt")
    return ad.posts(spark, d).select("thread_id", "submolt", sc.keyword_category(name).alias("category"), sc.keyword_category(name, "expanded").alias("expanded"), sc.keyword_category(name, token_only=True).alias("token_only"))


VARIANTS = {"baseline": ("baseline", False), "expanded": ("expanded", False), "token_only": ("baseline", True)}
PIVOTED = ["Builder/Technical", "Spam/Low-Signal"]
#: Whether one category stands above the other in both measures, as in the baseline.
ORDERED = """round(avg(CASE WHEN category = 'Builder/Technical' THEN e END), 6) > round(avg(CASE WHEN category = 'Spam/Low-Signal' THEN e END), 6) AS ordering_incidence_preserved,
round(quantile_cont(CASE WHEN category = 'Builder/Technical' AND e = 1 THEN h * 60 END, 0.9), 6) < round(quantile_cont(CASE WHEN category = 'Spam/Low-Signal' AND e = 1 THEN h * 60 END, 0.9), 6) AS ordering_t90_preserved"""


@query(VIEWS + ", k AS (" + " UNION ALL ".join(f"SELECT '{k}' AS variant, {category_sql('p.submolt', *v)} AS category, su.event_observed AS e, su.excluded_censor_boundary AS x, su.duration_hours AS h FROM su JOIN posts p USING (thread_id)" for k, v in VARIANTS.items()) + """),
f AS (SELECT *, unnest(['all', 'no_boundary', 'large']) AS filter FROM k), n AS (SELECT *, count(*) OVER (PARTITION BY variant, filter, category) AS size FROM f WHERE filter <> 'no_boundary' OR NOT x)
SELECT variant, filter, """ + ", ".join(f"round(avg(CASE WHEN category = '{c}' THEN e END), 6) AS \"incidence__{c}\", round(quantile_cont(CASE WHEN category = '{c}' AND e = 1 THEN h * 60 END, 0.9), 6) AS \"t90__{c}\"" for c in PIVOTED) + ", " + ORDERED + " FROM n WHERE filter <> 'large' OR size >= 1000 GROUP BY 1, 2")
def keyword_sensitivity_pivot(spark, d):
    u = units(spark, d).join(ad.posts(spark, d).select("thread_id", "submolt"), "thread_id")
    v = F.array(*(F.struct(F.lit(k).alias("variant"), sc.keyword_category(F.col("submolt"), *a).alias("category")) for k, a in VARIANTS.items()))
    u = u.select("event_observed", "excluded_censor_boundary", "duration_hours", F.explode(v).alias("v")).select("*", "v.*")
    u = u.withColumn("filter", F.explode(F.array(*map(F.lit, ("all", "no_boundary", "large"))))).where("filter <> 'no_boundary' or not excluded_censor_boundary")
    by = ["variant", "filter", "category"]
    u = written(u.select(*by, "event_observed", (F.col("duration_hours") * 60).alias("minutes")), "units")
    u = scan.with_quantiles(u.groupBy(*by).agg(F.avg("event_observed").alias("incidence"), F.count("*").alias("size")), u.where("event_observed = 1"), "minutes", {"t90": 0.9}, by)
    u = u.withColumn("keep", (F.col("filter") != "large") | (F.col("size") >= 1000))
    u = u.withColumns({c: F.when(F.col("keep"), F.col(c)) for c in ("incidence", "t90")})
    kept = u.groupBy("variant", "filter").agg(F.max("keep").alias("any"))
    p = u.groupBy("variant", "filter").pivot("category", PIVOTED).agg(F.first("incidence").alias("incidence"), F.first("t90").alias("t90"))
    p = p.join(kept.where("any"), ["variant", "filter"]).select("variant", "filter", *(F.col(f"`{c}_{m}`").alias(f"{m}__{c}") for c in PIVOTED for m in ("incidence", "t90")))
    p, (a, b) = rounded(p), PIVOTED
    return p.withColumns({"ordering_incidence_preserved": F.col(f"incidence__{a}") > F.col(f"incidence__{b}"), "ordering_t90_preserved": F.col(f"t90__{a}") < F.col(f"t90__{b}")})


@query(VIEWS + """SELECT m.submolt_category, round(incidence, 6) AS incidence, round(mean_children, 6) AS mean_children, round(p2, 6) AS p_depth2, round(p3, 6) AS p_depth3, round(p5, 6) AS p_depth5, round(abs(p2 - least(mean_children, 1)), 6) AS error2, round(abs(p3 - least(mean_children * mean_children, 1)), 6) AS error3, round(abs(p5 - least(mean_children ** 4, 1)), 6) AS error5
FROM (SELECT submolt_category, avg(event_observed) AS incidence FROM su GROUP BY 1) s JOIN (SELECT submolt_category, avg(n_children) AS mean_children FROM te GROUP BY 1) e USING (submolt_category)
JOIN (SELECT submolt_category, avg((depth_max >= 2)::INT) AS p2, avg((depth_max >= 3)::INT) AS p3, avg((depth_max >= 5)::INT) AS p5 FROM tm GROUP BY 1) m USING (submolt_category)""")
def model_vs_observed_tails(spark, d):
    e = events(spark, d)
    s = sv.survival_units(e).groupBy("submolt_category").agg(F.avg("event_observed").alias("incidence"))
    c = e.groupBy("submolt_category").agg(F.avg("n_children").alias("mean_children"))
    tail = lambda k: F.avg((F.col("depth_max") >= k).cast("int")).alias(f"p_depth{k}")
    m = th.thread_metrics(e).groupBy("submolt_category").agg(tail(2), tail(3), tail(5))
    t = s.join(c, "submolt_category").join(m, "submolt_category")
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return rounded(t.withColumns({"error2": F.abs(F.col("p_depth2") - clip(F.col("mean_children"))), "error3": F.abs(F.col("p_depth3") - clip(F.pow("mean_children", F.lit(2)))), "error5": F.abs(F.col("p_depth5") - clip(F.pow("mean_children", F.lit(4))))}))


@query(VIEWS + "SELECT count(*) AS n_rows, count(DISTINCT thread_id) AS n_threads, count(DISTINCT comment_agent_id) AS n_agents, count_if(lag_since_parent_hours IS NULL) AS n_null_lags, count_if(lag_since_parent_hours < 0) AS n_negative_lags, min(created_at_utc) AS first_at, max(created_at_utc) AS last_at FROM te")
def qc_counters(spark, d):
    return ql.counters(flat_events(spark, d))


@query(VIEWS + """, m AS (SELECT c.*, row_number() OVER (PARTITION BY c.post_id ORDER BY c.comment_id % 1000, c.comment_id) AS k FROM comments c) SELECT post_id, comment_id FROM m WHERE k = 1""")
def one_unit_per_thread(spark, d):
    """One unit a thread in the order of a key that stands for a random draw."""
    w = Window.partitionBy("post_id").orderBy(F.col("comment_id") % 1000, "comment_id")
    return ad.comments(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("post_id", "comment_id")


@query(VIEWS + """, w AS (SELECT submolt_category AS category, duration_hours * 60 AS x, 1 + thread_id % 3 AS w FROM su WHERE event_observed = 1), c AS (SELECT category, x, sum(w) AS w FROM w GROUP BY 1, 2),
q AS (SELECT *, sum(w) OVER (PARTITION BY category ORDER BY x) AS cw, sum(w) OVER (PARTITION BY category) AS t FROM c) SELECT category, round(min(CASE WHEN cw >= 0.5 * t THEN x END), 6) AS p50, round(min(CASE WHEN cw >= 0.9 * t THEN x END), 6) AS p90 FROM q GROUP BY 1""")
def weighted_quantile(spark, d):
    u = units(spark, d).where("event_observed = 1").select(F.col("submolt_category").alias("category"), (F.col("duration_hours") * 60).alias("x"), (1 + F.col("thread_id") % 3).alias("w"))
    return rounded(ql.weighted_quantiles(u, "x", "w", [0.5, 0.9], ["category"]))
