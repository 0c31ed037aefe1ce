"""Operator 3, chat formatting by quotation linking.

Native: DataFrame functions only.

1. Levels. A message's lines are read as mail quotes: the number of leading ``>`` is a
   line's level, level 0 is the message's own text; lines that only announce a quote
   ("... wrote:") belong to no passage and are dropped with the quotes.
2. Passages. Neighbouring lines of one level are joined, so that re-wrapped quotes read
   the same; a blank line ends a paragraph, the end of a sentence a passage. Passages
   are normalised (markers off, lower case, blanks squeezed) and hashed.
3. Links. Each quoted passage is joined to the latest earlier message of its conversation
   that says it as its own. It is found by rank: asks and sayings of one passage are
   counted in the order of turns, and the n-th saying is joined to the asks after it, so
   a passage that thousands of messages say and quote makes one link an ask, not one a
   pair. A message replies to the message that most passages it quotes at level 1 lead
   to, the later one of equals; passages at deeper levels are counted as linked too, but
   belong to older messages. Messages whose quotes lead nowhere start a thread.
4. Reply order. A conversation is read thread by turn, and replies after the message that
   they reply to, by turn. Within a thread an Euler tour (each message is entered and
   left) is ranked by pointer doubling: an event points to the next, sums of events up to
   where it points double their reach in each round, so a thread of n messages takes
   log2(2 n) rounds. Each event is pointed to once, so no join has a hot key, and no
   paths are stored.

No task orders a whole conversation: ranks are sums over cells of turns (``with_before``).
Each row carries its formatted turn, ``<|role|>`` and text.

Defined results: null texts are empty; null roles format as ``unknown``; null conversations
are one conversation; null turns come first and neither quote nor are quoted; messages of
one turn are in the order of a hash; rows that repeat a message wholly are one message;
very long texts are parsed whole; empty tables give no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settled, table, with_before

MARKER = "^[ \\t]*(?:>[ \\t]?)+"
ANNOUNCE = "(?i)^.*\\bwrote:[ \\t]*$"
#: What ends a passage within a paragraph.
SENTENCE = "([.!?]) "
#: Turns a cell, when rows are ranked.
CELL = 1024
MAX_ROUNDS = 60
_PART = "\x01"


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKER, "")), "\\s+", " "))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKER, 0), "[^>]", ""))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with id, conversation key ``conv``, body, and arrays of quoted (level, hash) and own passages."""
    t = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("conv_id", "turn", "role", "text"))
    known = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in ("conv_id", "turn", "role")))
    t = t.withColumn("id", F.md5(F.concat_ws("|", known, *parts).cast("binary")))
    t = t.withColumn("conv", F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-")))
    line = lambda x: F.struct(x.alias("raw"), level(x).alias("level"), normalised(x).alias("norm"))
    t = settled(t, "lines", F.transform(F.split("text", "\\r?\\n"), line))
    next_quotes = lambda k: F.coalesce(F.get("lines", k + 1)["level"] > 0, F.lit(False))
    # an announcement is a blank line of its own
    kinds = F.transform("lines", lambda x, k: x.withField("norm", F.when((x["level"] == 0) & x["raw"].rlike(ANNOUNCE) & next_quotes(k), "").otherwise(x["norm"])))
    t = settled(t, "lines", F.transform(kinds, lambda x: x.withField("norm", F.translate(x["norm"], _PART, ""))))
    body = F.filter("lines", lambda x, k: (x["level"] == 0) & ~(x["raw"].rlike(ANNOUNCE) & next_quotes(k)))
    before = lambda k: F.get("lines", k - 1)
    goes_on = lambda x, k: (k > 0) & (before(k)["level"] == x["level"]) & (before(k)["norm"] != "")
    mark = lambda x: F.concat(F.lit(_PART), x["level"].cast("string"), F.lit(" "), x["norm"])
    flow = F.transform("lines", lambda x, k: F.when(x["norm"] == "", "").when(goes_on(x, k), F.concat(F.lit(" "), x["norm"])).otherwise(mark(x)))
    # each paragraph is "level text"; its sentences get the level too
    t = settled(t, "paragraphs", F.filter(F.split(F.array_join(flow, ""), _PART), lambda p: p != ""))
    own_level = lambda p: F.substring_index(p, " ", 1)
    cut = lambda p: F.transform(F.split(F.regexp_replace(p, SENTENCE, f"$1{_PART}"), _PART), lambda s, k: F.when(k == 0, F.substring(s, F.length(own_level(p)) + 2, F.length(s))).otherwise(s))
    passages = F.flatten(F.transform("paragraphs", lambda p: F.transform(cut(p), lambda s: F.struct(own_level(p).cast("int").alias("level"), F.xxhash64(s).alias("hash")))))
    t = settled(t, "passages", passages)
    body = F.btrim(F.regexp_replace(F.array_join(F.transform(body, lambda x: x["raw"]), "\n"), "\\n{3,}", "\n\n"), F.lit(" \t\n"))
    said = F.array_distinct(F.transform(F.filter("passages", lambda x: x["level"] == 0), lambda x: x["hash"]))
    return t.select("id", "conv", "conv_id", "turn", "role", body.alias("body"), F.filter("passages", lambda x: x["level"] > 0).alias("quoted"), said.alias("said"))


def cells(turn: Column) -> dict[str, Column]:
    return {"_cell": F.floor(turn / CELL)}


def links(m: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, parent, parent_turn, n_linked): the message replied to, if any, and how many quoted passages were found; none where no message quotes."""
    here = m.where("turn is not null")
    asks = here.where(F.size("quoted") > 0).select("id", "conv", "turn", F.explode("quoted").alias("q"))
    asks = scratch.keep(asks.groupBy("id", "conv", "turn", "q.level", "q.hash").agg(F.count("*").alias("n")))
    if asks.isEmpty():
        return None
    wanted = asks.select("conv", "turn", "hash").distinct()
    keys = scratch.keep(wanted.select("conv", "hash").distinct())
    says = here.select("conv", "turn", "id", F.explode("said").alias("hash")).join(keys, ["conv", "hash"])
    says = scratch.keep(says.groupBy("conv", "hash", "turn").agg(F.max("id").alias("said_id")))
    # in the order of turns, asks of a turn before its saying, as only earlier ones count
    events = wanted.select("conv", "hash", "turn", F.lit(0).alias("says")).unionByName(says.select("conv", "hash", "turn", F.lit(1).alias("says")))
    ranked = scratch.keep(with_before(events, ["conv", "hash"], cells(F.col("turn")), ["turn", "says"], "says", "k", scratch))
    nth = says.join(ranked.where("says = 1").select("conv", "hash", "turn", "k"), ["conv", "hash", "turn"]).select("conv", "hash", (F.col("k") + 1).alias("k"), "said_id", F.col("turn").alias("said_turn"))
    found = ranked.where("says = 0 and k > 0").select("conv", "hash", "turn", "k").join(nth, ["conv", "hash", "k"]).select("conv", "hash", "turn", "said_id", "said_turn")
    found = scratch.keep(asks.join(found, ["conv", "hash", "turn"]).select("id", "level", "n", "said_id", "said_turn"))
    linked = found.groupBy("id").agg(F.sum("n").alias("n_linked"))
    by = found.where("level = 1").groupBy("id", "said_id", "said_turn").agg(F.sum("n").alias("n"))
    best = by.groupBy("id").agg(F.max(F.struct("n", "said_turn", "said_id")).alias("b"))
    return linked.join(best, "id", "left").select("id", F.col("b.said_id").alias("parent"), F.col("b.said_turn").alias("parent_turn"), "n_linked")


def threads(m: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root, place, depth, size) of messages (id, turn, parent): place 1.. in the reply order of its thread."""
    kids = m.where("parent is not null").select("id", "turn", "parent", F.lit(1).alias("one"))
    kids = scratch.keep(with_before(kids, ["parent"], cells(F.col("turn")), ["turn", "id"], "one", "k", scratch).select("id", "parent", "k"))
    first = kids.where("k = 0").select(F.col("parent").alias("of"), F.col("id").alias("first"))
    after = kids.select(F.col("parent").alias("of"), (F.col("k") - 1).alias("of_k"), F.col("id").alias("after"))
    nodes = kids.select("id").union(kids.select("parent")).distinct()
    t = nodes.join(kids, "id", "left").join(first, F.col("id") == F.col("of"), "left").drop("of")
    t = scratch.keep(t.join(after, (F.col("parent") == F.col("of")) & (F.col("k") == F.col("of_k")), "left").select("id", "parent", "first", "after"))
    # events: the message's id when entered, with a dash when left
    left = lambda c: F.concat(F.col(c), F.lit("-"))
    enter = t.select(F.col("id").alias("event"), F.coalesce(F.col("first"), left("id")).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("sum"))
    leave = t.select(left("id"), F.when(F.col("parent").isNotNull(), F.coalesce(F.col("after"), left("parent"))), F.lit(0).cast("long"), F.lit(-1).cast("long"))
    t = enter.union(leave).withColumn("tip", F.col("event"))
    t = scratch.keep(t)
    for _ in range(MAX_ROUNDS):
        if t.where("next is not null").isEmpty():
            break
        on = t.select(F.col("event").alias("at"), F.col("next").alias("next2"), F.col("entered").alias("entered2"), F.col("sum").alias("sum2"), F.col("tip").alias("tip2"))
        j = t.join(on, F.col("next") == F.col("at"), "left")
        more = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        t2 = scratch.keep(j.select("event", F.col("next2").alias("next"), more("entered"), more("sum"), F.coalesce("tip2", "tip").alias("tip")))
        scratch.drop(t)
        t = t2
    # sums now reach to the end of the thread, where its first message is left
    t = t.where(~F.col("event").endswith("-")).select(F.col("event").alias("id"), F.expr("substr(tip, 1, length(tip) - 1)").alias("root"), "entered", F.col("sum").alias("depth"))
    sizes = t.where("id = root").select("root", F.col("entered").alias("size"))
    # the depth of a message is how many more are left than entered after it
    return t.join(sizes, "root").select("id", "root", (F.col("size") - F.col("entered") + 1).alias("place"), (-F.col("depth")).alias("depth"), "size")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, parent_turn, depth, n_quoted, n_linked, formatted."""
    scratch = Scratch(messages.sparkSession, "quotes")
    m = scratch.keep(parsed(messages))
    found = links(m, scratch)
    if found is None:  # each message is a thread of its own
        found = m.select("id", *(F.lit(None).cast(t).alias(c) for c, t in (("parent", "string"), ("parent_turn", m.schema["turn"].dataType), ("n_linked", "long")))).limit(0)
    m = m.join(found, "id", "left")
    m = scratch.keep(m.select("id", "conv", "conv_id", "turn", "role", "body", F.size("quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent", "parent_turn"))
    if m.where("parent is not null").isEmpty():
        placed = m.select("id", F.col("id").alias("root"), F.lit(1).cast("long").alias("place"), F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("size")).limit(0)
    else:
        placed = scratch.keep(threads(m, scratch))
    # threads by their first message, those of a turn in the order of ids
    roots = m.where("parent is null").select("id", "conv", "turn").join(placed.where("id = root").select("id", "size"), "id", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    null_turn = F.when(F.col("turn").isNull(), 0).otherwise(1)
    levels = {"_known": null_turn, **cells(F.coalesce("turn", F.lit(0))), "_turn": F.coalesce("turn", F.lit(0)), "_id": F.substring("id", 1, 2)}
    roots = scratch.keep(with_before(roots, ["conv"], levels, ["id"], "size", "before", scratch).select(F.col("id").alias("of"), "before"))
    t = m.join(placed.select("id", "root", "place", "depth"), "id", "left").withColumn("root", F.coalesce("root", "id")).join(roots, F.col("root") == F.col("of"))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>"), F.col("body"))
    position = F.col("before") + F.coalesce("place", F.lit(1))
    return t.select("conv_id", "turn", "role", position.alias("position"), "parent_turn", F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted", "n_linked", formatted.alias("formatted"))


def op3_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))
