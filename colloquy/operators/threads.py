"""Reply trees: thread events, depths, branching, re-entry, reciprocity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from colloquy.functions.scalars import hours_between, keyword_category, parent_key, parent_type
from colloquy.operators import scan
from colloquy.sources.scratch import written

ORDER = ("created_at_utc", "comment_id")


def many_to_one(posts: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: empty where a join on the key is many-to-one."""
    return posts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def child_counts(comments: DataFrame) -> DataFrame:
    return comments.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"))


def tree_depths(comments: DataFrame, orphan_policy: str = "null", states: bool = False) -> DataFrame:
    """(comment_id, depth), roots at 1, by pointer doubling: chains of n replies take log2(n) joins.

    Only comments whose chain is still open are joined and written in a round, and of the
    resolved ones those that they may ask for: what a comment points to after a round
    was pointed to by another one in that round.

    With ``states`` also why a depth is null: ``missing`` (the chain leaves the thread) or
    ``cycle`` (it closes on itself).

    ``null``: where the chain of parents leaves the thread or closes on itself the depth
    is null. ``ordered``: parents count only if they stand earlier in (time, id) order;
    a comment with no such parent has -1, and its replies count on from there.
    """
    done, open_ = chains_contracted(comments, orphan_policy)
    parts = [*done, open_]
    t = reduce(DataFrame.unionByName, (p.select("comment_id", "top", "steps") for p in parts))
    state = [F.when(F.col("top").isNull(), "cycle").when(F.col("top") == 0, "missing").alias("state")] if states else []
    return t.select("comment_id", F.when(F.col("top") != 0, F.col("top") + F.col("steps")).cast("int").alias("depth"), *state)


def chains_contracted(comments: DataFrame, orphan_policy: str = "null") -> tuple[list[DataFrame], DataFrame]:
    """Written tables (comment_id, top, jump, steps) of the comments resolved in each round, and of those that never end."""
    own = comments.select("post_id", "comment_id", "parent_id", "created_at_utc")
    up = own.select(F.col("comment_id").alias("up_id"), F.col("post_id").alias("up_post"), F.col("created_at_utc").alias("up_time"))
    same = (F.col("parent_id") == F.col("up_id")) & (F.col("post_id") == F.col("up_post"))
    t = own.join(up, same, "left")
    if orphan_policy == "ordered":
        seen = F.col("up_id").isNotNull() & (F.struct("up_time", "up_id") < F.struct("created_at_utc", "comment_id"))
        top = F.when(F.col("parent_id").isNull(), 1).when(~seen, -1)
    else:
        top = F.when(F.col("parent_id").isNull(), 1).when(F.col("up_id").isNull(), 0)
    t = t.select("comment_id", top.alias("top"), F.when(top.isNull(), F.col("parent_id")).alias("jump"), F.when(top.isNull(), 1).otherwise(0).alias("steps"))
    n, left = F.count("*").alias("n"), F.count_if(F.col("top").isNull()).alias("open")
    seen = Observation()  # counted as the table is written
    t = written(t.observe(seen, n, left), "depths")
    size, still = seen.get["n"], seen.get["open"]
    done, open_, rounds = [t.where("top is not null")], t.where("top is null"), 0
    live = done[0]  # resolved comments that an open one may point to
    # a chain has at most n steps, so what is open after log2(n) rounds is a cycle
    while still and (1 << rounds) <= max(1, size):
        known = live.unionByName(open_).select(F.col("comment_id").alias("up_id"), F.col("top").alias("up_top"), F.col("jump").alias("up_jump"), F.col("steps").alias("up_steps"))
        t = open_.join(known, F.col("jump") == F.col("up_id"), "left").select(
            "comment_id", F.col("up_top").alias("top"), F.when(F.col("up_top").isNull(), F.col("up_jump")).alias("jump"), (F.col("steps") + F.coalesce("up_steps", F.lit(0))).alias("steps"),
            F.when(F.col("up_top").isNotNull(), F.struct("up_id", "up_steps")).alias("asked"),
        )
        seen = Observation()
        t = written(t.observe(seen, left), "depths")
        still, rounds = seen.get["open"], rounds + 1
        now = t.where("top is not null")
        asked = now.select(F.col("asked.up_id").alias("comment_id"), "top", F.lit(None).cast(t.schema["jump"].dataType).alias("jump"), F.col("asked.up_steps").alias("steps")).distinct()
        live = asked.unionByName(now.drop("asked"))
        done, open_ = [*done, now.drop("asked")], t.where("top is null").drop("asked")
    return done, open_


def depth_diagnostics(comments: DataFrame) -> DataFrame:
    """One row: comments, roots, missing parents, unresolved depths, and of these the ones below a missing parent and on or below a cycle."""
    ids = comments.select(F.col("comment_id").alias("known"), F.col("post_id").alias("known_post"))
    t = comments.join(ids, (F.col("parent_id") == F.col("known")) & (F.col("post_id") == F.col("known_post")), "left").join(tree_depths(comments, states=True), "comment_id")
    missing = F.col("parent_id").isNotNull() & F.col("known").isNull()
    return t.agg(
        F.count("*").alias("n_comments"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"), F.count_if(missing).alias("n_missing_parents"), F.count_if(F.col("depth").isNull()).alias("n_unresolved"),
        F.count_if(F.col("state") == "missing").alias("n_below_missing"), F.count_if(F.col("state") == "cycle").alias("n_cycle"),
    )


def reference_diagnostics(comments: DataFrame, parent: Column, submission: Column) -> DataFrame:
    """Of forum references: how many name a comment, the own submission, another submission, or have no known prefix."""
    kind = parent_type(parent)
    other = (kind == "submission") & ~parent_key(parent, "t3_").eqNullSafe(submission)
    return comments.agg(
        F.count("*").alias("n"), F.count_if(kind == "comment").alias("n_comment_parents"), F.count_if(kind == "submission").alias("n_submission_parents"),
        F.count_if(other).alias("n_submission_mismatches"), F.count_if(kind == "unknown").alias("n_unknown_prefixes"),
    )


def thread_events(comments: DataFrame, posts: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Comments with their post's and parent's columns, lags in hours, child counts and depth."""
    p = posts.withColumn("submolt_category", keyword_category(F.col("submolt")))
    e = comments.join(p, comments["post_id"] == p["thread_id"])
    up = comments.select(F.col("comment_id").alias("up_id"), F.col("created_at_utc").alias("up_time"), F.col("comment_agent_id").alias("up_agent"))
    e = e.join(up, e["parent_id"] == up["up_id"], "left")
    kids = child_counts(comments).withColumnRenamed("parent_id", "kid_parent")
    e = e.join(kids, e["comment_id"] == kids["kid_parent"], "left")
    e = e.join(depths if depths is not None else tree_depths(comments), "comment_id", "left")
    root = F.col("parent_id").isNull()
    parent_time = F.when(root, F.col("post_created_at_utc")).otherwise(F.col("up_time"))
    return e.select(
        "comment_id", "thread_id", "parent_id", "comment_agent_id", "created_at_utc", "post_agent_id", "submolt", "submolt_category", "post_score", "comment_count", "post_created_at_utc",
        F.when(root, "post").when(F.col("up_id").isNotNull(), "comment").otherwise("unknown").alias("parent_type"), parent_time.alias("parent_created_at_utc"),
        F.when(root, F.col("post_agent_id")).otherwise(F.col("up_agent")).alias("parent_agent_id"), hours_between(parent_time, F.col("created_at_utc")).alias("lag_since_parent_hours"),
        hours_between(F.col("post_created_at_utc"), F.col("created_at_utc")).alias("lag_since_post_hours"), "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"),
    )


def thread_metrics(events: DataFrame) -> DataFrame:
    """One row a thread; re-entry is null where no author is known."""
    known = F.count("comment_agent_id")
    return events.groupBy("thread_id").agg(
        F.any_value("submolt").alias("submolt"), F.any_value("submolt_category").alias("submolt_category"), F.any_value("post_created_at_utc").alias("post_created_at_utc"),
        F.count("*").alias("n_comments"), F.count_distinct("comment_agent_id").alias("n_unique_agents"), F.max("depth").alias("depth_max"), F.avg("depth").alias("depth_mean"),
        F.min("created_at_utc").alias("first_comment_at"), F.max("created_at_utc").alias("last_comment_at"),
        hours_between(F.any_value("post_created_at_utc"), F.max("created_at_utc")).alias("thread_duration_hours"),
        ((known - F.count_distinct("comment_agent_id")) / F.nullif(known, F.lit(0))).alias("reentry_rate"), F.count_if(F.col("lag_since_post_hours") <= 0.5).alias("early_comments"),
    )


def seen_before(events: DataFrame) -> DataFrame:
    """(thread_id, comment_id, seen): whether the author wrote earlier in the thread: all but an author's first comment, found by a minimum."""
    known = events.where("comment_agent_id is not null").select("thread_id", "comment_agent_id", *ORDER)
    first = known.groupBy("thread_id", "comment_agent_id").agg(F.min(F.struct(*ORDER)).alias("first"))
    t = known.join(first, ["thread_id", "comment_agent_id"])
    return t.select("thread_id", "comment_id", (F.struct(*ORDER) != F.col("first")).alias("seen"))


def interaction_edges(events: DataFrame) -> DataFrame:
    """Directed edges author to parent author, without unknown ends and self-replies."""
    return events.where("comment_agent_id is not null and parent_agent_id is not null and comment_agent_id <> parent_agent_id").select(
        "thread_id", "created_at_utc", "comment_id", F.col("comment_agent_id").alias("src"), F.col("parent_agent_id").alias("dst")
    )


def dyads(events: DataFrame) -> DataFrame:
    """(thread_id, a, b, reciprocal): pairs of authors that met in a thread."""
    e = interaction_edges(events)
    return e.groupBy("thread_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((F.count_distinct(F.col("src") < F.col("dst")) == 2).alias("reciprocal"))


def reciprocity(pairs: DataFrame, by: list[str]) -> DataFrame:
    n, both = F.count("*"), F.count_if("reciprocal")
    return pairs.groupBy(*by).agg(n.alias("dyads"), both.alias("reciprocal_dyads"), (both / F.nullif(n, F.lit(0))).alias("reciprocity_rate"))


def reciprocal_chains(events: DataFrame) -> DataFrame:
    """(thread_id, start, length) of runs of edges that each reverse the one before, of two or more.

    Edges are scanned over ranges of (thread, time), so a thread of any size is no single task.
    """
    order, by = list(ORDER), ["thread_id"]
    e = scan.ranged(interaction_edges(events).withColumn("edge", F.struct("src", "dst")), order, by)
    e = scan.with_previous(e, "edge", order, by, "before")
    fresh = F.when((F.col("src") == F.col("before.dst")) & (F.col("dst") == F.col("before.src")), 0).otherwise(1).cast("long")
    e = scan.with_running(e, {"island": fresh}, order, by)
    return e.groupBy("thread_id", "island").agg(F.count("*").alias("length"), F.min("created_at_utc").alias("start")).where("length >= 2").drop("island")


def branching_by_depth(events: DataFrame) -> DataFrame:
    """Children by depth: posts are depth 0 with their root comments as children; unknown depths are left out."""
    roots = events.groupBy("thread_id").agg(F.count_if(F.col("parent_id").isNull()).alias("n_children")).select(F.lit(0).alias("depth"), "n_children")
    nodes = roots.unionByName(events.where("depth is not null").select("depth", "n_children"))
    return nodes.groupBy("depth").agg(F.avg("n_children").alias("mean_children"), F.median("n_children").alias("median_children"), F.count("*").alias("n_nodes"))


def share_table(df: DataFrame, key: str) -> DataFrame:
    """Rows and share of the total by key; the window spans one row a key."""
    t = df.groupBy(key).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def unit_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal bins on [0, 1], the last one closed, empty ones with 0."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    n = df.where(F.col(value).isNotNull()).groupBy(b.cast("int").alias("b")).agg(F.count("*").alias("c"))
    calendar = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    t = calendar.join(n, F.col("bin") == F.col("b"), "left").select("bin", (F.col("bin") / bins).alias("bin_left"), F.coalesce("c", F.lit(0)).alias("n"))
    return t.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)))


def descriptive(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, exact median, sample deviation, extremes and count of each column, nulls left out."""
    t = df.select(F.expr("stack({}, {}) as (metric, value)".format(len(columns), ", ".join(f"'{c}', cast({c} as double)" for c in columns))))
    t = written(t.where("value is not null"), "metrics")
    report = t.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    return scan.with_quantiles(report, t, "value", {"median": 0.5}, ["metric"])


def depth_tail_slope(metrics: DataFrame) -> DataFrame:
    """mu and slope of P(depth >= k) = exp(-slope k), least squares through the origin on logs."""
    d = metrics.where("depth_max is not null").select(F.col("depth_max").alias("d"))
    t = d.groupBy("d").agg(F.count("*").alias("n"))  # a row a depth from here on
    total, top = F.sum("n").over(Window.partitionBy()), F.max("d").over(Window.partitionBy())
    t = t.withColumns({"total": total, "top": top}).withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest("d", F.lit(1)))))
    tail = t.where("k <= d").groupBy("k").agg((F.sum("n") / F.max("total")).alias("p"))
    slope = F.sum(F.col("k") * F.log("p")) / F.sum(F.col("k") * F.col("k"))
    return tail.agg(F.exp(slope).alias("mu"), (-slope).alias("slope"), F.count("*").alias("n_levels"))
