"""Operator 8, mixing sources to target weights by systematic sampling.

Native: DataFrame functions only. Within a source every document has the same
expected number of copies, target / source size. Laying these end to end in the
order (size, hash of doc_id) and adding one random offset, a document is taken once for
each whole number that its stretch crosses. As the order is by size, the taken
words stay within about the largest document of the target.

The running position of a document is its rank times the expected copies. The rank
is a sum of three counts, none of which puts a source into one task: rows of smaller
size (from the table of sizes), rows of the same size in earlier slots (a slot is two
digits of the MD5 of doc_id and text), and the row number within source, size and slot,
in the order of that hash. Only tables of a row a source are ordered in one task.

Defined results: a null or blank text has size 0 and is never taken; null sources
are one source, weighted last; rows without a doc_id, or with one that repeats, are told
apart by their text; repeated rows are documents of their own, equal in all that counts;
texts of any length count whole; an empty table gives an empty result; other columns,
whatever their names, are ignored. The offset is a hash of the source's name, so reruns
agree.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_TIMES = 2


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows summed to source, source_size, n_docs, target, copies, offset.

    The excess over the bound is shared anew by weight until no target is above it.
    In the order of bound / weight the bounded sources are a prefix, and the level of
    the others follows from running sums. The table has a row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(k, F.lit(len(WEIGHTS))))
    per = per.withColumn("weight", weight).withColumn("most", F.lit(float(MAX_TIMES)) * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source in this order whose share fits fixes the level for itself and all after it.
    per = per.withColumn("own_level", level)
    fits = F.when(F.col("own_level") * F.col("weight") <= F.col("most"), F.col("own_level"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most")))
    per = per.withColumn("target", target)
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "target", copies.alias("copies"), offset.alias("offset"))


def copies_of(docs: DataFrame, scratch: Scratch, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies for every row of (doc_id, source, size, at), and the columns ``keep``.

    at: text that orders the rows of one size; its first two characters are the slot.
    """
    slim = scratch.keep(docs)
    slim = slim.withColumn("slot", F.substring("at", 1, 2))
    cells = slim.groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("in_size", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    sizes = slim.groupBy("source", "size").agg(F.count("*").alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select("source", (F.col("size") * F.col("n")).alias("size"), "n")
    sizes = sizes.withColumn("below", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n")
    to = source_targets(sums)
    sizes = sizes.join(to, _same(sizes, to, "source")).select(sizes["source"], "size", "below", "source_size", "target", "copies", "offset")
    cells = cells.join(sizes, _same(cells, sizes, "source", "size")).select(
        cells["source"], cells["size"], "slot", (F.col("below") + F.col("in_size")).alias("before"), "source_size", "target", "copies", "offset"
    )
    own = Window.partitionBy("source", "size", "slot").orderBy("at", *keep)
    slim = slim.withColumn("k", F.row_number().over(own))
    t = slim.join(cells, _same(slim, cells, "source", "size", "slot"))
    rank = F.col("before") + F.col("k")
    at = lambda r: F.floor(r * F.col("copies") + F.col("offset"))
    n = F.when(slim["size"] == 0, F.lit(0)).otherwise(F.least(at(rank) - at(rank - 1), F.lit(MAX_TIMES)))
    return t.select("doc_id", slim["source"].alias("source"), slim["size"].alias("size"), "source_size", "target", n.cast("long").alias("n_copies"), *keep)


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    return reduce(and_, (a[c].eqNullSafe(b[c]) for c in columns))


def mix_sources(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_copies, and the columns ``keep``."""
    scratch = Scratch(docs.sparkSession, "mix")
    at = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))
    t = copies_of(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), at.alias("at"), *keep), scratch, keep)
    return t.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies", *keep)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
