"""Queries of estimators, resampling and streams. SQL states the counts, resamplings and streams; tests hold the fits against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from colloquy.functions import scalars as sc
from colloquy.operators import estimators as es
from colloquy.operators import fits
from colloquy.operators import matching as mt
from colloquy.operators import resampling as rs
from colloquy.operators import survival as sv
from colloquy.operators import threads as th
from colloquy.operators import timeseries as ts
from colloquy.plans.conversation import ACF, SIDES, flat_events, labelled_units, rounded, sides, units
from colloquy.plans.registry import TWO_PART, VIEWS, query
from colloquy.sources import adapters as ad
from colloquy.sources.scratch import shared_path, ship, written
from colloquy.streaming import operators as so

REPS, PAIR_REPS, SIMS = 400, 1000, 2000


@query()
def exp_mle(spark, d):
    """Hazard fits by category with half-life and chance of a reply."""
    t = fits.fit_by_group(units(spark, d), "submolt_category")
    a, b = F.col("alpha"), F.col("beta")
    return rounded(t.withColumns({"half_life_hours": math.log(2) / b, "reply_probability": sc.reply_probability(a, b), "t90_hours": sc.conditional_quantile(a, b, 0.9)}))


@query()
def weibull_mle(spark, d):
    t = fits.fit_by_group(units(spark, d), "submolt_category", fits.WEIBULL, ("shape", "scale"))
    return rounded(t.withColumn("half_life_hours", F.col("scale") * F.pow(F.lit(math.log(2)), 1 / F.col("shape"))))


@query()
def weibull_conditional(spark, d):
    """Times of replies alone, without censoring."""
    u = units(spark, d).where("event_observed = 1")
    return rounded(fits.fit_by_group(u, "submolt_category", fits.WEIBULL, ("shape", "scale"), 10, 10))


INTERVAL = "round(max(CASE WHEN rep = 0 THEN v END), 6) AS estimate, round(quantile_cont(CASE WHEN rep > 0 THEN v END, 0.025), 6) AS low, round(quantile_cont(CASE WHEN rep > 0 THEN v END, 0.975), 6) AS high, count(CASE WHEN rep > 0 THEN v END) AS n_reps"


def ratio_sql(per: str, cluster: str, ratios: dict[str, tuple[str, str]], by: str = "", reps: int = 0) -> str:
    """Of a table ``per`` of sums by cluster: the replicates' ratios and their intervals."""
    parts = " UNION ALL ".join(f"SELECT {by} rep, '{m}' AS metric, sum(w * {a})::DOUBLE / nullif(sum(w * {b}), 0) AS v FROM r GROUP BY ALL" for m, (a, b) in ratios.items())
    frames = f", frames AS (SELECT {by} {cluster} AS cluster FROM {per})"
    return frames + rs.draw_sql("frames", reps or REPS, by=by) + f", r AS (SELECT {per}.*, rep, w FROM {per} JOIN w ON w.cluster = {per}.{cluster}" + (f" AND w.{by[:-1]} = {per}.{by[:-1]}" if by else "") + f"), v AS ({parts}) SELECT {by} metric, {INTERVAL} FROM v GROUP BY ALL"


RATIOS = {"incidence": ("e", "n"), "reentry": ("again", "known"), "reciprocity": ("both_ways", "dyads")}
HEADLINE = """, h AS (SELECT thread_id, submolt_category, event_observed AS e, 1 AS n, 0 AS again, 0 AS known, 0 AS both_ways, 0 AS dyads FROM su
UNION ALL SELECT thread_id, submolt_category, 0, 0, (row_number() OVER (PARTITION BY thread_id, comment_agent_id ORDER BY created_at_utc, comment_id) > 1)::INT, 1, 0, 0 FROM te WHERE comment_agent_id IS NOT NULL
UNION ALL SELECT thread_id, submolt_category, 0, 0, 0, 0, reciprocal::INT, 1 FROM dy JOIN (SELECT DISTINCT thread_id, submolt_category FROM te) USING (thread_id)),
per AS (SELECT thread_id, category, sum(e) AS e, sum(n) AS n, sum(again) AS again, sum(known) AS known, sum(both_ways) AS both_ways, sum(dyads) AS dyads FROM (SELECT *, unnest(['Overall', submolt_category]) AS category FROM h) GROUP BY ALL)"""


@query(VIEWS + HEADLINE + ratio_sql("per", "thread_id", RATIOS, "category,"))
def cluster_bootstrap(spark, d):
    """Intervals of incidence, re-entry and reciprocity under resampled threads, overall and by category."""
    e = flat_events(spark, d)
    u = sv.survival_units(e).select("thread_id", "submolt_category", F.col("event_observed").alias("e"), F.lit(1).alias("n"))
    of = e.select("thread_id", "submolt_category").distinct()
    seen = th.seen_before(e).join(of, "thread_id").select("thread_id", "submolt_category", F.col("seen").cast("int").alias("again"), F.lit(1).alias("known"))
    pairs = th.dyads(e).join(of, "thread_id").select("thread_id", "submolt_category", F.col("reciprocal").cast("int").alias("both_ways"), F.lit(1).alias("dyads"))
    t = u.unionByName(seen, allowMissingColumns=True).unionByName(pairs, allowMissingColumns=True)
    t = t.withColumn("category", F.explode(F.array(F.lit("Overall"), F.col("submolt_category"))))
    names = ("e", "n", "again", "known", "both_ways", "dyads")
    return rounded(rs.cluster_bootstrap(t, "thread_id", {c: F.coalesce(F.col(c), F.lit(0)) for c in names}, RATIOS, REPS, by=("category",)))


PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
QUANTILES = """, u2 AS (SELECT thread_id, unnest(['Overall', submolt_category]) AS category, event_observed, duration_hours * 3600 AS x FROM su), frames AS (SELECT DISTINCT category, thread_id AS cluster FROM u2)""" + rs.draw_sql("frames", REPS, by="category,") + """,
c AS (SELECT category, thread_id AS cluster, x, count(*) AS n FROM u2 WHERE event_observed = 1 GROUP BY ALL), x AS (SELECT category, rep, x, sum(w * n) AS w FROM c JOIN w USING (category, cluster) WHERE rep > 0 GROUP BY ALL),
q AS (SELECT *, sum(w) OVER (PARTITION BY category, rep ORDER BY x) AS upto, sum(w) OVER (PARTITION BY category, rep) AS total FROM x),
v AS (""" + " UNION ALL ".join(f"SELECT category, rep, '{k}' AS metric, min(CASE WHEN upto >= {p} * total THEN x END) AS v FROM q GROUP BY ALL" for k, p in PROBS.items()) + """),
e AS (""" + " UNION ALL ".join(f"SELECT category, '{k}' AS metric, quantile_cont(x, {p}) AS estimate FROM u2 WHERE event_observed = 1 GROUP BY 1" for k, p in PROBS.items()) + """)
SELECT category, metric, round(any_value(estimate), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS n_reps FROM v JOIN e USING (category, metric) GROUP BY ALL"""


@query(VIEWS + QUANTILES)
def bootstrap_reply_quantiles(spark, d):
    """Intervals of the 10, 50 and 90 % reply times in exact seconds under resampled threads, overall and by category.

    All threads with a unit are drawn, those without a reply too.
    """
    u = units(spark, d).withColumn("seconds", F.when(F.col("event_observed") == 1, F.col("duration_hours") * 3600))
    u = u.withColumn("category", F.explode(F.array(F.lit("Overall"), F.col("submolt_category"))))
    return rounded(rs.bootstrap_quantiles(u, "thread_id", "seconds", PROBS, REPS, by=("category",)))


@query()
def bootstrap_weibull_shape(spark, d):
    """Percentile interval of the Weibull shape under resampled threads."""
    t = fits.bootstrap_fits(units(spark, d).where(~F.col("excluded_censor_boundary")), "thread_id", REPS, fits.WEIBULL).where("rep > 0")
    return rounded(t.agg(F.percentile("first", 0.025).alias("low"), F.percentile("first", 0.5).alias("median"), F.percentile("first", 0.975).alias("high"), F.count("*").alias("n_reps")))


@query()
def bootstrap_half_life(spark, d):
    """Percentile interval of the half-life under resampled threads."""
    u = units(spark, d).where(~F.col("excluded_censor_boundary"))
    t = fits.bootstrap_fits(u, "thread_id", REPS).where("rep > 0").withColumn("half_life", math.log(2) / F.col("second"))
    return rounded(t.agg(F.percentile("half_life", 0.025).alias("low"), F.percentile("half_life", 0.5).alias("median"), F.percentile("half_life", 0.975).alias("high"), F.count("*").alias("n_reps")))


DEPTHS = {"mean_depth": ("d", "one"), "p_depth3": ("deep3", "one"), "p_depth5": ("deep5", "one")}


@query(VIEWS + ", per AS (SELECT thread_id, depth_max AS d, 1 AS one, (depth_max >= 3)::INT AS deep3, (depth_max >= 5)::INT AS deep5 FROM tm)" + ratio_sql("per", "thread_id", DEPTHS))
def bootstrap_depth(spark, d):
    """Mean depth and tails of threads as independent units."""
    m = th.thread_metrics(th.thread_events(ad.comments(spark, d), ad.posts(spark, d)))
    sums = {"d": F.col("depth_max"), "one": F.lit(1), **{f"deep{k}": (F.col("depth_max") >= k).cast("int") for k in (3, 5)}}
    return rounded(rs.cluster_bootstrap(m, "thread_id", sums, DEPTHS, REPS))


@query(VIEWS + ACF + ", per AS (SELECT agent, corr(c, nx) AS c, 1 AS one FROM l GROUP BY 1 HAVING var_pop(CASE WHEN nx IS NOT NULL THEN c END) > 0 AND var_pop(nx) > 0)" + ratio_sql("per", "agent", {"mean_correlation": ("c", "one")}))
def bootstrap_acf(spark, d):
    """Interval of the mean 4-hour correlation of agents as independent units."""
    t = ts.lag_correlation(ad.comments(spark, d), "created_at_utc", "comment_agent_id", 15, 16, 10)
    return rounded(rs.cluster_bootstrap(t, "agent", {"c": F.col("correlation"), "one": F.lit(1)}, {"mean_correlation": ("c", "one")}, REPS))


@query(VIEWS + SIDES + ", per AS (SELECT pair_id, diff_n_comments AS d, 1 AS one FROM pr)" + ratio_sql("per", "pair_id", {"n_comments": ("d", "one")}, reps=PAIR_REPS))
def paired_bootstrap(spark, d):
    """Interval of the mean paired difference in comments."""
    pairs = mt.matched_pairs(*mt.overlap(*sides(spark, d, False)))
    return rounded(rs.cluster_bootstrap(pairs, "pair_id", {"d": F.col("diff_n_comments"), "one": F.lit(1)}, {"n_comments": ("d", "one")}, PAIR_REPS))


@query()
def paired_tests(spark, d):
    """P-values of the signed-rank and the sign test by outcome."""
    pairs = mt.matched_pairs(*mt.overlap(*sides(spark, d, False)))
    ship(spark)

    def tests(batches):
        for pdf in batches:
            wilcoxon = [es.wilcoxon_p(r.wilcoxon, int(r.n_positive + r.n_negative), r.ties) for r in pdf.itertuples()]
            sign = [es.sign_test_p(int(r.n_positive), int(r.n_negative)) for r in pdf.itertuples()]
            yield pd.DataFrame({"outcome": pdf.outcome, "wilcoxon_p": wilcoxon, "sign_p": sign})

    t = mt.paired_effects(pairs).select("outcome", "wilcoxon", "n_positive", "n_negative", "ties")
    return rounded(t.mapInPandas(tests, "outcome string, wilcoxon_p double, sign_p double"))


@query()
def cloglog_glm(spark, d):
    """Incidence by category and claim: coefficients with errors of the model, by thread, and two-way by thread and author, and the mean prediction.

    Rows without a known author are left out, as they belong to no author's cluster. Where a
    two-way variance is negative all its errors are those by thread, and where one of these is,
    those of the model; ``note`` says so.
    """
    u = labelled_units(spark, d).where("comment_agent_id is not null").withColumn("claim", sc.claim_label(F.col("is_claimed"), "primary"))
    u = written(u.select("submolt_category", "claim", "thread_id", "comment_agent_id", "event_observed"), "units")  # read once a sum
    cells = u.groupBy("submolt_category", "claim").agg(F.count("*").alias("n"), F.sum("event_observed").alias("k"))
    beta, inverse, names = es.cloglog(cells, ["Social/Casual", "Unclaimed"], ["submolt_category", "claim"])
    cols = [F.lit(1.0), *(((F.col(n.split("[")[0]) == n.split("[")[1][:-1]).cast("double")) for n in names[1:])]
    eta = sum((c * float(b) for c, b in zip(cols[1:], beta[1:], strict=True)), F.lit(float(beta[0])))
    hz = F.exp(eta)
    p = 1 - F.exp(-hz)
    residual = (F.col("event_observed") - p) * hz * (1 - p) / (p * (1 - p))
    cov = es.two_way_covariance(u, [c * residual for c in cols], inverse, "thread_id", "comment_agent_id")
    model = np.sqrt(np.diag(inverse))
    thread, two_way, note = es.robust_errors(model, cov["first"], cov["two_way"])
    mean = u.agg(F.avg("event_observed").alias("observed"), F.avg(p).alias("predicted"), F.count("*").alias("n"), F.sum("event_observed").alias("k"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("comment_agent_id").alias("authors")).first()
    sizes = (mean.n, mean.k, mean.threads, mean.authors, note)
    rows = []
    for i, name in enumerate(names):
        b, s = float(beta[i]), float(two_way[i])
        z = b / s if s else None
        rows.append((name, b, float(model[i]), float(thread[i]), s, z, math.erfc(abs(z) / math.sqrt(2)) if s else None, b - 1.96 * s, b + 1.96 * s, None, None, *sizes))
    rows.append(("mean_incidence", *(None,) * 8, float(mean.observed), float(mean.predicted), *sizes))
    kinds = "term string, estimate double, se_model double, se_thread double, se_two_way double, z double, p double, low double, high double, observed double, predicted double, n_units long, n_events long, n_threads long, n_authors long, note string"
    return rounded(spark.createDataFrame(rows, kinds))


@query()
def welch_psd(spark, d):
    """Spectrum at a 4-hour period with its AR(1) null."""
    series = ts.detrended(ts.binned_counts(ad.comments(spark, d), "created_at_utc", 15))
    return rounded(es.spectrum(series, 15, SIMS))


@query()
def spectrum_by_bin_width(spark, d):
    parts = []
    for minutes in (5, 15, 30):
        series = ts.detrended(ts.binned_counts(ad.comments(spark, d), "created_at_utc", minutes), 24 * 60 // minutes)
        parts.append(es.spectrum(series, minutes, SIMS).withColumn("bin_minutes", F.lit(minutes)))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query()
def power_curve(spark, d):
    n = ad.table(spark, d, "events").count()
    return rounded(es.detectability(spark, n, [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2]))


@query(VIEWS + ", one AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY md5(comment_id::VARCHAR || '|1'), comment_id) AS k FROM su), b AS (SELECT 'all' AS sample, * EXCLUDE (k) FROM one UNION ALL SELECT 'one_per_thread', * EXCLUDE (k) FROM one WHERE k = 1) SELECT sample, " + TWO_PART + " FROM b GROUP BY 1")
def dependence_robustness(spark, d):
    """The two-part report on all units and on one random unit a thread."""
    u = units(spark, d)
    one = es.random_unit_per_cluster(u, "thread_id", "comment_id")
    t = u.withColumn("sample", F.lit("all")).unionByName(one.withColumn("sample", F.lit("one_per_thread")))
    return rounded(sv.two_part(t, ["sample"]))


@query()
def matched_half_life(spark, d):
    """Fit on the threads that were matched, with the half-life's interval under resampled threads."""
    pairs = written(mt.matched_pairs(*mt.overlap(*sides(spark, d, False))).select("thread_id_a", "thread_id_b"), "pairs")
    ids = pairs.select(F.col("thread_id_a").alias("thread_id")).union(pairs.select("thread_id_b"))
    u = written(units(spark, d).where(~F.col("excluded_censor_boundary")).join(ids, "thread_id", "left_semi").withColumn("sample", F.lit("matched")), "units")
    reps = fits.bootstrap_fits(u, "thread_id", REPS).where("rep > 0").withColumn("h", math.log(2) / F.col("second"))
    reps = reps.agg(F.percentile("h", 0.025).alias("low"), F.percentile("h", 0.975).alias("high"), F.count("h").alias("n_reps"))
    return rounded(fits.fit_by_group(u, "sample").withColumn("half_life_hours", math.log(2) / F.col("beta")).crossJoin(F.broadcast(reps)))


def _stream(spark, d):
    return so.event_stream(spark, f"{d}/events.parque[t]")


LAST = "(SELECT max(ts) FROM events)"


@query(f"SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 30 MINUTE <= {LAST} - INTERVAL 300 SECOND")
def stream_tumbling(spark, d):
    """Windows that the watermark has passed at the stream's end."""
    t = so.tumbling(_stream(spark, d), "ts", "30 minutes", ["event_type"])
    return so.untimed(so.run_to_end(t, shared_path(spark, "stream")))


@query(f"""WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {LAST} - INTERVAL 300 SECOND""")
def stream_sessions(spark, d):
    """Sessions that have ended by the watermark."""
    t = so.sessions(_stream(spark, d), "ts", "6 hours", ["user_id"])
    return so.untimed(so.run_to_end(t, shared_path(spark, "stream")))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, d):
    t = so.first_seen(_stream(spark, d).select("ts", "user_id"), "ts", "user_id", "60 days")
    return so.run_to_end(t, shared_path(spark, "stream")).select("user_id")


def _comment_stream(spark, d):
    """Comments as a stream; their parents were written with them, as a collector writes them."""
    path = shared_path(spark, "comments")
    ad.comments(spark, d).withColumn("ts", F.col("created_at_utc")).write.parquet(path)
    return so.event_stream(spark, path, 1000)


@query(VIEWS + """, m AS (SELECT c.comment_id, epoch_us(c.created_at_utc) // 1000 AS born, epoch_us(f.first_reply_at) // 1000 AS reply FROM comments c LEFT JOIN fr f ON f.parent_id = c.comment_id)
SELECT comment_id, make_timestamp(born * 1000) AS created_at, CASE WHEN reply - born BETWEEN 0 AND 3600000 THEN (reply - born) / 1000.0::DOUBLE END AS reply_seconds FROM m WHERE born + 3600000 < (SELECT max(epoch_us(created_at_utc) // 1000) FROM comments) - 60000""")
def stream_first_reply(spark, d):
    """Comments whose hour of observation the watermark has passed."""
    with so.state_of_one_stream(spark):
        return so.untimed(so.run_to_end(so.first_replies(_comment_stream(spark, d), 3600), shared_path(spark, "stream")))


@query(VIEWS + "SELECT thread_id, count(comment_agent_id) AS n_known, count(comment_agent_id) - count(DISTINCT comment_agent_id) AS n_again FROM te GROUP BY 1 HAVING count(comment_agent_id) > 0")
def stream_reentry(spark, d):
    s = _comment_stream(spark, d).withColumnRenamed("post_id", "thread_id").select("thread_id", "comment_id", "comment_agent_id", "ts")
    path = shared_path(spark, "reentry")
    so.upserted(so.running_reentry(s), ["thread_id", "comment_agent_id"], "n", path, shared_path(spark, "stream"), "update")
    return so.read_latest(spark, path).groupBy("thread_id").agg(F.sum("n").alias("n_known"), F.sum(F.col("n") - 1).alias("n_again"))


@query(VIEWS + """, m AS (SELECT comment_id, created_at_utc AS born, (SELECT max(created_at_utc) FROM comments WHERE parent_id IS NOT NULL) AS last FROM comments), h AS (SELECT *, unnest([3600, 14400]) AS h FROM m),
r AS (SELECT h, h.comment_id, min(c.created_at_utc) AS reply FROM h JOIN comments c ON c.parent_id = h.comment_id AND c.created_at_utc BETWEEN born AND born + h * INTERVAL 1 SECOND GROUP BY ALL)
SELECT h AS horizon_seconds, comment_id, born AS created_at, round(date_diff('microsecond', born, reply) / 1e6::DOUBLE, 6) AS reply_seconds FROM h LEFT JOIN r USING (h, comment_id) WHERE born + h * INTERVAL 1 SECOND < last - INTERVAL 60 SECOND""")
def stream_reply_join(spark, d):
    """First replies within an hour and within the 4-hour boundary, by an outer interval join; comments whose horizon the watermark has passed."""
    s = _comment_stream(spark, d)
    end = ad.comments(spark, d).where("parent_id is not null").agg(F.max("created_at_utc").cast("timestamp").alias("last"))  # the slower of both watermarks
    parts = []
    for h in (3600, 14_400):
        t = so.run_to_end(so.replies_within(s, h), shared_path(spark, "stream"))
        t = t.groupBy("comment_id", "created_at").agg(F.min("reply_at").alias("reply_at")).crossJoin(F.broadcast(end))
        t = t.where(F.expr(f"created_at + INTERVAL {h} SECONDS < last - INTERVAL 60 SECONDS"))
        parts.append(t.select(F.lit(h).alias("horizon_seconds"), "comment_id", "created_at", sc.seconds_between(F.col("created_at"), F.col("reply_at")).alias("reply_seconds")))
    return rounded(so.untimed(parts[0].unionByName(parts[1])))


@query(VIEWS + """, seen AS (SELECT * FROM edges WHERE epoch_us(created_at_utc) // 1000 < (SELECT max(epoch_us(created_at_utc) // 1000) FROM edges) - 60000),
l AS (SELECT *, lag(src) OVER (PARTITION BY thread_id ORDER BY created_at_utc, comment_id) AS s0, lag(dst) OVER (PARTITION BY thread_id ORDER BY created_at_utc, comment_id) AS d0 FROM seen),
i AS (SELECT *, sum(CASE WHEN src = d0 AND dst = s0 THEN 0 ELSE 1 END) OVER (PARTITION BY thread_id ORDER BY created_at_utc, comment_id) AS island FROM l)
SELECT thread_id, min(created_at_utc) AS start, count(*) AS length FROM i GROUP BY thread_id, island HAVING count(*) >= 2""")
def stream_chains(spark, d):
    """Reciprocal chains of the edges that the watermark has passed; files arrive in an order that is not that of time."""
    path = shared_path(spark, "edges")
    e = th.interaction_edges(flat_events(spark, d)).withColumn("ts", F.col("created_at_utc"))
    e.repartition(6, "comment_id").write.parquet(path)
    s = so.event_stream(spark, path, 1000).select("thread_id", "ts", "comment_id", "src", "dst")
    out = shared_path(spark, "chains")
    with so.state_in_rocksdb(spark):
        so.upserted(so.running_chains(s), ["thread_id", "first_id"], "length", out, shared_path(spark, "stream"), "update")
    return so.untimed(so.read_latest(spark, out, so.CHAIN).select("thread_id", "start", "length"))


@query("SELECT event_id, 'post_' || user_id::VARCHAR AS post_id, (event_id % 40)::INT AS comment_count FROM events")
def stream_polling(spark, d):
    """Events as a polled feed: each round (micro-batch) is written, and in every second one the comments of its top posts."""
    path, out = shared_path(spark, "feed"), shared_path(spark, "polled")
    feed = ad.table(spark, d, "events").select("event_id", "ts", F.concat(F.lit("post_"), F.col("user_id").cast("string")).alias("post_id"), (F.col("event_id") % 40).cast("int").alias("comment_count"))
    feed.repartition(4, "event_id").write.parquet(path)
    s = so.event_stream(spark, path, 1).select("event_id", "post_id", "comment_count")
    q = so.polled_rounds(s, lambda top: top.select("post_id"), 2, 3, out)
    q.option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, post_id string, comment_count int").parquet(f"{out}/feed").drop("round")


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS k FROM events) WHERE k = 1")
def stream_latest_state(spark, d):
    """Latest event of each user, merged batch by batch."""
    path = shared_path(spark, "latest")
    so.upserted(_stream(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", path, shared_path(spark, "stream"))
    return so.untimed(so.read_latest(spark, path))
