"""From message logs to a report a conversation, partitioned by topic.

Reads messages (conv_id, turn, role, text), sets aside those without a conversation or
turn, keeps one of each (conversation, turn), and lets a turn answer the one before it. Each
conversation gets its size, words, roles, re-entry, orphans (turns whose predecessor is
missing), words of answers to words answered, and reciprocity of its pairs of roles; its topic
is that of the keywords in its opening message (turn 0). ``threads`` holds these rows by
topic, ``summary`` a line a topic as CSV, ``rejected`` the messages set aside.

Work is joins on (conversation, turn) and pre-aggregated sums: a conversation of any length
meets in no single task. Each run replaces what stands at ``out``, so a rerun gives the same.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.scalars import early_bin, keyword_category
from colloquy.operators.threads import dyads, reciprocity
from colloquy.sources.files import write_csv
from colloquy.sources.scratch import written
from jobs.common import command_line, table_at

log = logging.getLogger("jobs.conversation_report")

THREADS = (
    "conv_id long, n_turns long, n_roles long, n_known long, n_words long, mean_words double, reentry_rate double, n_orphans long, n_answers long, answer_ratio double, dyads long, "
    "reciprocal_dyads long, reciprocity_rate double, size_bin string, topic string"
)


@dataclass
class Settings:
    token_only: bool = True
    keyword_variant: str = "baseline"


def messages(raw: DataFrame, settings: Settings) -> DataFrame:
    """One row a conversation and turn: role, words, and of an opening message the topic; the smallest of those that share a turn.

    A blank role is unknown. What is needed of a text is taken where it is read: texts are not shuffled.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda x: x != "")
    topic = F.when(F.col("turn") == 0, keyword_category(F.col("text"), settings.keyword_variant, settings.token_only))
    t = raw.select("conv_id", "turn", F.nullif(F.btrim("role"), F.lit("")).alias("role"), F.size(words).cast("long").alias("n_words"), topic.alias("topic"))
    return t.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "n_words", "topic")).alias("r")).select("conv_id", "turn", "r.*")


def answers(m: DataFrame) -> DataFrame:
    """Each message with the role and words of the turn before; the columns that edges of replies need."""
    before = m.select(F.col("conv_id").alias("up_conv"), (F.col("turn") + 1).alias("up_next"), F.col("role").alias("parent_agent_id"), F.col("n_words").alias("parent_words"))
    t = m.join(before, (F.col("conv_id") == F.col("up_conv")) & (F.col("turn") == F.col("up_next")), "left")
    return t.select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("created_at_utc"), F.col("turn").alias("comment_id"), F.col("role").alias("comment_agent_id"), "n_words",
        "topic", "parent_agent_id", "parent_words", ((F.col("turn") > 0) & F.col("up_conv").isNull()).alias("orphan"),
    )


def thread_report(e: DataFrame) -> DataFrame:
    """A row a conversation from the messages of ``answers``."""
    known, roles = F.count("comment_agent_id"), F.count_distinct("comment_agent_id")
    answered = F.col("parent_words").isNotNull()
    t = e.groupBy("thread_id").agg(
        F.count("*").alias("n_turns"), roles.alias("n_roles"), known.alias("n_known"), F.sum("n_words").alias("n_words"), F.avg("n_words").alias("mean_words"),
        ((known - roles) / F.nullif(known, F.lit(0))).alias("reentry_rate"), F.count_if("orphan").alias("n_orphans"), F.count_if(answered).alias("n_answers"),
        (F.sum(F.when(answered, F.col("n_words"))) / F.nullif(F.sum("parent_words"), F.lit(0))).alias("answer_ratio"), F.max("topic").alias("topic"),
    )
    pairs = reciprocity(dyads(e), ["thread_id"]).withColumnRenamed("thread_id", "pair_thread")
    t = t.join(pairs, F.col("thread_id") == F.col("pair_thread"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return t.select(
        F.col("thread_id").alias("conv_id"), "n_turns", "n_roles", "n_known", "n_words", "mean_words", "reentry_rate", "n_orphans", "n_answers", "answer_ratio", zero("dyads"),
        zero("reciprocal_dyads"), "reciprocity_rate", early_bin(F.col("n_turns")).alias("size_bin"), F.coalesce("topic", F.lit("Other")).alias("topic"),
    )


def summary(threads: DataFrame) -> DataFrame:
    """A row a topic, in order."""
    return threads.groupBy("topic").agg(
        F.count("*").alias("n_conversations"), F.sum("n_turns").alias("n_turns"), F.avg("n_turns").alias("mean_turns"), F.avg("reentry_rate").alias("mean_reentry"),
        (F.sum("reciprocal_dyads") / F.nullif(F.sum("dyads"), F.lit(0))).alias("reciprocity_rate"), F.sum("n_orphans").alias("n_orphans"),
    ).orderBy("topic")


def run(spark: SparkSession, source: str, out: str, settings: Settings | None = None) -> dict:
    """Reports of all conversations at ``source`` into the tables below ``out``."""
    s = settings or Settings()
    raw = spark.read.parquet(source).select("conv_id", "turn", "role", "text")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    raw.where(~placed).write.mode("overwrite").parquet(f"{out}/rejected")
    e = written(answers(messages(raw.where(placed), s)), "answers")  # read for sums and for pairs
    thread_report(e).write.mode("overwrite").partitionBy("topic").parquet(f"{out}/threads")
    threads = read_threads(spark, out)
    write_csv(summary(threads), f"{out}/summary", 6)
    n = threads.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_turns"), F.lit(0)).alias("turns")).first()
    found = {"source": source, "out": out, "messages": n.turns, "rejected": spark.read.parquet(f"{out}/rejected").count(), "conversations": n.n}
    log.info("read %(messages)d messages (%(rejected)d more set aside) from %(source)s, wrote %(conversations)d conversations to %(out)s", found)
    return found


def read_threads(spark: SparkSession, out: str) -> DataFrame:
    return table_at(spark, f"{out}/threads", THREADS)


if __name__ == "__main__":
    command_line("conversation_report", __doc__, Settings, {"source": "Parquet table of messages", "out": "folder of the tables"}, run)
