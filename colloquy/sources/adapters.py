"""The driver tables read as conversation tables.

``events`` gives comments: users are threads, an event may answer an earlier one of its
thread, some answer one that does not exist. ``posts`` and ``agents`` follow from them by
integer rules, and a second platform takes half of the threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ["crypto-dev", "Storytelling", "philosophy", "general", "airdrop news", "build-lab", "", "memes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back = F.when(F.col("event_id") % 3 == 0, F.lag("event_id", 1).over(w)).when(F.col("event_id") % 3 == 1, F.lag("event_id", 2).over(w)).otherwise(F.lag("event_id", 3).over(w))
    parent = F.when(F.col("event_id") % 97 == 0, -F.col("event_id")).when(F.col("event_id") % 5 < 2, back)
    agent = F.when(F.col("event_id") % 29 != 0, F.concat(F.lit("agent_"), ((F.col("event_id") * 31 + F.col("user_id")) % 13).cast("string")))
    return e.select(
        F.col("event_id").alias("comment_id"), F.col("user_id").alias("post_id"), parent.alias("parent_id"),
        agent.alias("comment_agent_id"), F.col("ts").alias("created_at_utc"), "event_type", "value",
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.count("*").alias("comment_count"))
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("user_id") % len(NAMES)).cast("int"))
    return e.select(
        F.col("user_id").alias("thread_id"), F.concat(F.lit("agent_"), (F.col("user_id") % 13).cast("string")).alias("post_agent_id"), name.alias("submolt"),
        (F.col("user_id") * 7 % 31).alias("post_score"), "comment_count", (F.col("first") - F.expr("INTERVAL '1' MINUTE")).alias("post_created_at_utc"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an agent: claimed 1, 0 or unknown, and followers, some unknown."""
    a = spark.range(13).withColumnRenamed("id", "k")
    return a.select(
        F.concat(F.lit("agent_"), F.col("k").cast("string")).alias("agent_id"),
        F.when(F.col("k") % 3 == 0, 1).when(F.col("k") % 3 == 1, 0).alias("is_claimed"),
        F.when(F.col("k") % 5 != 4, F.col("k") * 2 - 2).alias("follower_count"),
    )


#: The same views in DuckDB's SQL, to stand before a statement.
SQL = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value, row_number() OVER w AS rn, lag(event_id, 1) OVER w AS l1, lag(event_id, 2) OVER w AS l2, lag(event_id, 3) OVER w AS l3
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
comments AS (SELECT event_id AS comment_id, user_id AS post_id,
  CASE WHEN event_id % 97 = 0 THEN -event_id WHEN event_id % 5 < 2 THEN CASE event_id % 3 WHEN 0 THEN l1 WHEN 1 THEN l2 ELSE l3 END END AS parent_id,
  CASE WHEN event_id % 29 <> 0 THEN 'agent_' || ((event_id * 31 + user_id) % 13)::VARCHAR END AS comment_agent_id, ts AS created_at_utc, event_type, value FROM ev),
posts AS (SELECT user_id AS thread_id, 'agent_' || (user_id % 13)::VARCHAR AS post_agent_id, {[*NAMES]}[1 + user_id % {len(NAMES)}] AS submolt, user_id * 7 % 31 AS post_score,
  count(*) AS comment_count, min(ts) - INTERVAL 1 MINUTE AS post_created_at_utc FROM events GROUP BY user_id),
agents AS (SELECT 'agent_' || k::VARCHAR AS agent_id, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_claimed, CASE WHEN k % 5 <> 4 THEN k * 2 - 2 END AS follower_count FROM range(13) t(k))
"""
