"""Curation and checks: de-duplication, referential integrity, parse rates, status roll-up, schema discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.scalars import variant_type
from colloquy.operators import scan


def latest_state(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` lists descending columns and ends with a unique one."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in file and row order, which are columns here."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def require_columns(df: DataFrame, columns: list[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")


def resolve_columns(columns: list[str], candidates: dict[str, list[str]]) -> dict[str, str | None]:
    """For each name the first candidate present, whatever its case."""
    lower = {c.lower(): c for c in columns}
    return {name: next((lower[c.lower()] for c in options if c.lower() in lower), None) for name, options in candidates.items()}


def column_mapping(tables: dict[str, DataFrame], candidates: dict[str, dict[str, list[str]]], either: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """(table, name, column, matches, status) of the names that each table should have.

    ``column`` is the first candidate present, ``matches`` all of them. ``status``: ``mapped``;
    ``ambiguous`` where several candidates are present; ``covered`` where the name is missing but
    another of its OR group (``either``: lists of names of which one is enough) is there; else ``missing``.
    """
    rows = []
    for table, df in tables.items():
        wanted = candidates.get(table, {})
        chosen = resolve_columns(df.columns, wanted)
        lower = {c.lower(): c for c in df.columns}
        groups = (either or {}).get(table, [])
        for name, options in wanted.items():
            matches = [lower[c.lower()] for c in options if c.lower() in lower]
            covered = any(name in g and any(chosen.get(n) for n in g) for g in groups)
            status = "ambiguous" if len(matches) > 1 else "mapped" if matches else "covered" if covered else "missing"
            rows.append((table, name, chosen[name], ",".join(matches), status))
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, name string, column string, matches string, status string")


def mapped_columns(df: DataFrame, candidates: dict[str, list[str]], required: list[str], name: str) -> DataFrame:
    """The table under canonical names, in their order; absent ones are null, unless they are required."""
    chosen = resolve_columns(df.columns, candidates)
    require_columns(df.select(*(F.col(f"`{c}`").alias(n) for n, c in chosen.items() if c)), required, name)
    return df.select(*(F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in chosen.items()))


def orphan_rate(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """n_refs, n_orphans and rate of a reference; null references are not counted."""
    known = parent.select(F.col(parent_key).alias("_known")).distinct()
    t = child.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_known"), "left")
    n, k = F.count("*"), F.count_if(F.col("_known").isNull())
    return t.agg(n.alias("n_refs"), k.alias("n_orphans"), (k / F.nullif(n, F.lit(0))).alias("orphan_rate"))


def uniqueness_by_day(df: DataFrame, key: str, day: Column) -> DataFrame:
    """Per day, rows in groups of one key with more than one row: all members count."""
    n = df.groupBy(day.alias("day"), key).agg(F.count("*").alias("n"))
    return n.groupBy("day").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_duplicate_rows"), F.sum(F.col("n") - 1).alias("n_extra_rows"))


def parse_stats(df: DataFrame, raw: str, parsed: Column, examples: int = 5) -> DataFrame:
    """Non-null, parsed, failed and rate; failing examples are the first by value, which every run agrees on."""
    t = df.select(F.col(raw).alias("raw"), parsed.alias("parsed"))
    failed = F.col("raw").isNotNull() & F.col("parsed").isNull()
    n, ok = F.count("raw"), F.count("parsed")
    sample = t.where(failed).select("raw").distinct().orderBy("raw").limit(examples).agg(F.array_sort(F.collect_list("raw")).alias("failing"))
    return t.agg(n.alias("n_raw"), ok.alias("n_ok"), F.count_if(failed).alias("n_failed"), (ok / F.nullif(n, F.lit(0))).alias("rate")).crossJoin(F.broadcast(sample))


def rate_status(rate: Column, ok: float = 0.99, warn: float = 0.9) -> Column:
    return F.when(rate.isNull() | (rate >= ok), "PASS").when(rate >= warn, "WARN").otherwise("FAIL")


def orphan_status(rate: Column, tolerance: float = 0.01) -> Column:
    return F.when(rate > tolerance, "FAIL").when(rate > 0, "WARN").otherwise("PASS")


def roll_up(checks: DataFrame) -> DataFrame:
    """Checks by status and the worst of all."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    worst = F.when(F.max(rank) == 2, "FAIL").when(F.max(rank) == 1, "WARN").otherwise("PASS")
    return checks.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")), worst.alias("overall"))


def chronology(children: DataFrame, key: str, child_time: str, parents: DataFrame, parent_key: str, parent_time: str, tolerance_seconds: int = 300) -> DataFrame:
    """Rows earlier than their parent by more than the tolerance."""
    p = parents.select(F.col(parent_key).alias("_pk"), F.col(parent_time).alias("_pt"))
    t = children.join(p, F.col(key) == F.col("_pk"), "left")
    early = F.col(child_time) < F.col("_pt") - F.expr(f"INTERVAL '{tolerance_seconds}' SECOND")
    return t.agg(F.count("*").alias("n"), F.count_if(early).alias("n_violations"), F.count_if(F.col("_pk").isNull()).alias("n_unmatched"))


def counters(events: DataFrame) -> DataFrame:
    lag = F.col("lag_since_parent_hours")
    return events.agg(
        F.count("*").alias("n_rows"), F.count_distinct("thread_id").alias("n_threads"), F.count_distinct("comment_agent_id").alias("n_agents"), F.count_if(lag.isNull()).alias("n_null_lags"),
        F.count_if(lag < 0).alias("n_negative_lags"), F.min("created_at_utc").alias("first_at"), F.max("created_at_utc").alias("last_at"),
    )


def json_keys(df: DataFrame, json: str, by: list[str]) -> DataFrame:
    """By group: each key with its rows, whether all rows have it, and the JSON types of its values."""
    t = df.select(*by, F.col(json).alias("_j")).where(F.json_object_keys("_j").isNotNull())
    total = t.groupBy(*by).agg(F.count("*").alias("n_objects"))
    keys = t.select(*by, F.explode(F.from_json("_j", "map<string,variant>")).alias("key", "value"))
    found = keys.groupBy(*by, "key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(variant_type(F.col("value")))).alias("types"))
    return found.join(total, by).withColumn("in_all", F.col("n") == F.col("n_objects"))


def json_schema(df: DataFrame, json: str, by: list[str], max_array_elements: int = 1000) -> DataFrame:
    """By group and path of nested documents: values, types with their numbers, whether every object has the key.

    Each document is parsed once; a level's values are summed by (path, type) and its
    objects and arrays opened for the next level, until none is left. Paths: ``$`` the document
    itself, ``.key`` a member, ``[]`` the elements of an array, of which the first
    ``max_array_elements`` count. ``n_parents``: objects that could have the key, null for
    elements and documents. Texts that are no JSON count under ``$`` with type ``invalid``.
    """
    from colloquy.sources.scratch import written

    text = F.col(json)
    t = df.select(*by, F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(text).alias("v"), (text.isNotNull() & F.try_parse_json(text).isNull()).alias("bad"))
    t = t.withColumn("type", F.when(F.col("bad"), "invalid").otherwise(variant_type(F.col("v")))).drop("bad")
    levels = []
    while True:
        t = written(t, "level")
        levels.append(t.groupBy(*by, "path", "parent", "type").agg(F.count("*").alias("n")))
        inner = t.where(F.col("type").isin("object", "array"))
        if inner.isEmpty():
            break
        inner = inner.select(*by, F.col("path").alias("parent"), "type", "v").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("_pos", "_key", "_value"))
        member = F.col("type") == "object"
        inner = inner.where(member | (F.col("_pos") < max_array_elements))
        path = F.when(member, F.concat("parent", F.lit("."), F.col("_key"))).otherwise(F.concat("parent", F.lit("[]")))
        t = inner.select(*by, path.alias("path"), F.when(member, F.col("parent")).alias("parent"), F.col("_value").alias("v"), variant_type(F.col("_value")).alias("type"))
    counts = written(reduce(DataFrame.unionByName, levels), "counts")  # a row a group, path and type
    objects = counts.where("type = 'object'").groupBy(*by, F.col("path").alias("parent")).agg(F.sum("n").alias("n_parents"))
    pairs = F.array_sort(F.collect_list(F.struct("type", "n")))
    out = counts.groupBy(*by, "path", "parent").agg(F.sum("n").alias("n"), F.array_join(F.transform(pairs, lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), ",").alias("types"))
    out = out.join(objects, [*by, "parent"], "left")
    return out.select(*by, "path", "n", "types", "n_parents", (F.col("n") == F.col("n_parents")).alias("in_all"))


def request_summary(log: DataFrame) -> DataFrame:
    """Calls by endpoint and status, with the share that failed and the time spanned."""
    ok = F.count_if(F.col("http_status") == 200)
    return log.groupBy("endpoint").agg(
        F.count("*").alias("n_calls"), ok.alias("n_ok"), (1 - ok / F.count("*")).alias("failure_rate"), F.sum("bytes").alias("bytes"), F.avg("latency_ms").alias("mean_latency_ms"),
        F.timestamp_diff("SECOND", F.min("retrieved_at_utc"), F.max("retrieved_at_utc")).alias("elapsed_seconds"),
    )


def interval_coverage(log: DataFrame, expected_calls: int, least_seconds: int) -> DataFrame:
    """Whether a run made its calls and lasted as long as planned."""
    seconds = F.timestamp_diff("SECOND", F.min("retrieved_at_utc"), F.max("retrieved_at_utc"))
    return log.agg(F.count("*").alias("n_calls"), seconds.alias("elapsed_seconds"), (F.count("*") >= expected_calls).alias("calls_met"), F.coalesce(seconds >= least_seconds, F.lit(False)).alias("duration_met"))


def campaign_projection(daily: DataFrame, days: int = 30) -> DataFrame:
    """Mean bytes a day, carried to a campaign's length."""
    return daily.agg(F.count("*").alias("n_days"), F.avg("bytes").alias("mean_bytes_per_day"), (F.avg("bytes") * days).alias("projected_bytes"))


def feed_invariants(feed: DataFrame, allowed_sorts: list[str], limit: int) -> DataFrame:
    odd = ~F.coalesce(F.col("sort").isin(*allowed_sorts), F.lit(False))
    out = ~F.coalesce(F.col("rank").between(1, limit), F.lit(False))
    return feed.agg(F.count("*").alias("n"), F.count_if(odd).alias("n_bad_sort"), F.count_if(out).alias("n_bad_rank"), F.count_if(F.col("post_id").isNull()).alias("n_null_ids"))


def union_rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_posts(posts: DataFrame, k: int) -> DataFrame:
    """The first k by comment count (unknown is -1), then id, both descending."""
    return posts.withColumn("_n", F.coalesce("comment_count", F.lit(-1))).orderBy(F.desc("_n"), F.desc("post_id")).limit(k).drop("_n")


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: list[float], by: list[str]) -> DataFrame:
    """Smallest value whose running weight reaches p of the total."""
    return scan.quantiles(df, value, {f"p{round(p * 100)}": p for p in probs}, by, "least", weight)
