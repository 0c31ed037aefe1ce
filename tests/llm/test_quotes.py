"""Quotation linking against its SQL on made-up mail, and on long and repetitive conversations."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm import oracles
from colloquy.llm.quote_links import reply_ordered

MESSAGE = "conv_id long, turn long, role string, text string"
SAID = ["Hello there.", "What is up?", "ok", "Yes, I agree!", "No way", "Let us meet at noon. Bring the papers.", "The cat sat.", "A\tb  C", "It was late when he wrote: stay", "> not at the start"]


def mail(seed, turns=110):
    """Nested quotes, announcements, re-wrapped quotes, other line ends, ties, missing turns and roles, repeated rows."""
    r = random.Random(seed)
    rows = []
    for conv in (1, 2, None):
        held = []
        for t in range(turns):
            own = [r.choice(SAID) + (f" {r.randrange(50)}" if r.random() < 0.5 else "") for _ in range(r.randrange(0, 4))]
            lines = []
            if held and r.random() < 0.8:
                quoted = r.choice(held[-20:]).split("\n")
                if r.random() < 0.3:
                    words = " ".join(quoted).split(" ")
                    quoted = [" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]
                lines = (["On Monday x wrote:"] if r.random() < 0.5 else []) + [r.choice(["> ", ">", " > "]) + x for x in quoted] + ([""] if r.random() < 0.2 else [])
            held.append("\n".join(lines + own))
            rows.append((conv, None if r.random() < 0.03 else t if r.random() < 0.9 else t // 2, r.choice(["user", None, "assistant"]), ("\r\n" if r.random() < 0.2 else "\n").join(lines + own)))
    return rows + rows[:20] + [(5, 0, "user", None), (5, 1, "user", "> "), (5, 2, "x", ">> deep only"), (5, 3, "x", "deep only"), (5, 4, "x", ">> deep only\n> ok"), (5, 5, None, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mail_against_sql(spark, same_rows, tmp_path, seed):
    rows = mail(seed)
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    same_rows(lambda s, d: reply_ordered(s.read.parquet(f"{d}/conversations.parquet")), oracles.quote_links(), str(tmp_path), c)


def frame(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def test_rewrapped_and_nested_quotes(spark):
    rows = [
        (1, 0, "user", "The first sentence goes on\nover two lines. The second is short."),
        (1, 1, "user", "Something else."),
        (1, 2, "user", "A wrote:\n> The first sentence\n> goes on over two lines.\n\nI agree."),
        (1, 3, "user", "B wrote:\n> A wrote:\n>> The first sentence goes on over two lines.\n>\n> I agree.\n\nMe too."),
    ]
    got = {r.turn: (r.position, r.parent_turn, r.depth, r.n_linked, r.formatted) for r in reply_ordered(frame(spark, rows)).collect()}
    assert got[2] == (2, 0, 1, 1, "<|user|>I agree.") and got[3][:3] == (3, 2, 2) and got[3][4] == "<|user|>Me too." and got[1][:3] == (4, None, 0)


def test_a_line_that_all_say_and_quote(spark):
    """Links grow with the messages and not with their square."""
    n = 2500
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("> ok\nok").alias("text"))
    t = reply_ordered(rows)
    assert t.where("parent_turn = turn - 1 and position = turn + 1 and depth = turn").count() == n - 1


def test_a_thread_of_many_messages(spark):
    n = 100_000
    line = lambda k: F.concat(F.lit("say "), k.cast("string"))
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("> "), line(F.col("id") - 1), F.lit("\n"), line(F.col("id"))).alias("text"))
    r = reply_ordered(rows).agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.count_if(F.col("position") == F.col("turn") + 1).alias("placed")).first()
    assert (r.n, r.deepest, r.placed) == (n, n - 1, n)


def test_many_messages_without_turn_or_conversation(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), F.when(F.col("id") % 2 == 0, F.lit(4)).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    t = reply_ordered(rows)
    assert t.select("position").distinct().count() == 3000 and t.where("turn is null").agg(F.max("position")).first()[0] == 1500
