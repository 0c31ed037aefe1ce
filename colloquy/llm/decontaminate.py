"""Operator 9, benchmark decontamination by SimHash windows under a multi-index.

Native: DataFrame functions only. A benchmark item is the multiset of its 5-word
shingles (lower case). Windows of a document, as long as the item, are compared with
all items:

1. Windows. Shifting a window to its next shingle of the item (or a window cut by the
   document's start back to its last one) never lowers its similarity, so the best
   window of all offsets begins at such a shingle, or is a start of the document that
   ends at one. Of these all are formed that hold enough of the item's shingles, in
   any order, to reach 0.75.
2. Fingerprints. Each window and item gets a 64-bit SimHash of its shingles.
3. Multi-index. Fingerprints are cut into 8 blocks of 8 bits. Two that differ in at
   most RADIUS = 23 bits differ in at most 2 bits of some block, so the index lists,
   for each block of each item, all values within 2 bits: no fingerprint within the
   radius is missed. At the similarity 0.75 the expected distance is 11 bits with a
   deviation of 3.
4. Verification. sum(min) / sum(max) of the shingle counts, exactly, against 0.75.

The items' shingles, the index (without the shingles) and the places of windows are
broadcast only while their measured size stays within BROADCAST_BYTES; beyond it the
same joins shuffle. Of shingles only the positions of those that an item has are
shuffled, never a document's array with each.

Defined results: texts of fewer than 5 words, of documents or items, have their whole
sequence as one shingle; null or blank texts have none and match nothing; repeated
items and documents add no second row for a pair; a null doc_id or item_id is a value
like any other; very long texts are cut into windows whole; empty tables give no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, lower_ascii, row_key, settled, table, words

SHINGLE = 5
SIMILARITY = 0.75
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Measured sizes up to this are broadcast; ROW_BYTES stands for what a row costs beside its arrays.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def shingles(text: Column) -> dict[str, Column]:
    """Two steps: the words, then the hashes of all 5-word shingles in order."""
    w = F.col("w")
    five = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE)))
    return {
        "w": words(lower_ascii(text)),
        "s": F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), five))
        .when(F.size(w) > 0, F.array(F.xxhash64(F.lit("whole"), F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")),
    }


def with_shingles(df: DataFrame, *cols: str) -> DataFrame:
    df = df.select(*cols, "text")
    for name, c in shingles(F.col("text")).items():
        df = settled(df, name, c)
    return df.select(*cols, "s")


def simhash(s: str) -> Column:
    """The 64-bit SimHash of an array of hashes: each bit by majority."""
    return F.expr(
        f"aggregate(transform(sequence(0, 63), b -> if(2 * aggregate({s}, 0, (n, x) -> n + cast(shiftright(x, b) & 1 as int)) > size({s}),"
        " shiftleft(1L, b), 0L)), 0L, (a, v) -> a | v)"
    )


def bounded(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def block_of(fp: str, j: str) -> str:
    return f"cast(shiftright({fp}, {BLOCK_BITS} * {j}) & {2**BLOCK_BITS - 1} as int)"


def places(hits: str, item: str, doc: str) -> Column:
    """(lo, hi) of the windows that can reach 0.75, from the sorted positions that hold a shingle of the item.

    With c of them a window of m shingles has at most c / (m + item - c), which reaches
    0.75 where 7 c >= 3 (m + item).
    """
    begun = f"transform({hits}, (p, i) -> struct(p as lo, least(p + {item}, {doc}) as hi, i as i))"
    need = f"cast(ceil(3 * (x.hi - x.lo + {item}) / 7) as int)"
    begun = f"filter({begun}, x -> coalesce(get({hits}, x.i + {need} - 1) < x.hi, false))"
    cut = f"filter(transform({hits}, (p, i) -> struct(0 as lo, p + 1 as hi, i as i)), x -> x.hi < {item} and 7 * (x.i + 1) >= 3 * (x.hi + {item}))"
    return F.expr(f"transform(concat({begun}, {cut}), x -> struct(x.lo as lo, x.hi as hi))")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity): each document with each item that it holds."""
    scratch = Scratch(docs.sparkSession, "windows")
    items = with_shingles(benchmark, "item_id").where(F.size("s") > 0).distinct()
    items = items.select("item_id", F.xxhash64("item_id", "s").alias("item"), F.col("s").alias("item_s"), simhash("s").alias("item_fp"))
    items = scratch.keep(items)
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum(F.size("item_s")), F.lit(0))).first()

    # 1: windows with enough shingles of an item
    at = items.select("item", F.size("item_s").alias("len"), F.explode(F.array_distinct("item_s")).alias("item_h"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    hits = with_shingles(docs, "row").select("row", F.size("s").alias("size"), F.posexplode("s").alias("p", "h"))
    hits = hits.join(bounded(at, n_shingles * ROW_BYTES), F.col("h") == F.col("item_h"))
    hits = hits.groupBy("row", "size", "item", "len").agg(F.sort_array(F.collect_set("p")).alias("hits")).where(4 * F.size("hits") >= 3 * F.col("len"))
    found = settled(hits, "places", places("hits", "len", "size")).where(F.size("places") > 0)
    found = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    found = scratch.keep(found.withColumnRenamed("row", "found_row"))
    n_found, n_places = found.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    held = docs.join(bounded(found, n_found * ROW_BYTES + n_places * 16), F.col("row") == F.col("found_row"))
    windows = with_shingles(held, "doc_id", "places").select("doc_id", "s", F.explode("places").alias("at"))
    windows = settled(windows, "win", F.expr("slice(s, at.lo + 1, at.hi - at.lo)")).select("doc_id", "win")

    # 2, 3: fingerprints under the multi-index
    most = RADIUS // BLOCKS
    masks = [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(BLOCK_BITS), k)]
    index = items.withColumn("j", F.explode(F.array(*map(F.lit, range(BLOCKS)))))
    index = index.withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    index = index.select("item", "item_fp", F.col("j").alias("item_j"), F.expr(f"{block_of('item_fp', 'j')} ^ mask").alias("item_block"))
    windows = settled(windows, "fp", simhash("win"))
    probes = windows.withColumn("j", F.explode(F.array(*map(F.lit, range(BLOCKS)))))
    probes = settled(probes, "block", F.expr(block_of("fp", "j")))
    near = F.expr(f"bit_count(fp ^ item_fp) <= {RADIUS}")
    fits = [F.expr(f"bit_count({block_of('(fp ^ item_fp)', str(j))}) <= {most}") for j in range(BLOCKS)]
    first = F.lit(BLOCKS)
    for j in reversed(range(BLOCKS)):
        first = F.when(fits[j], F.lit(j)).otherwise(first)
    match = (F.col("j") == F.col("item_j")) & (F.col("block") == F.col("item_block")) & near & (F.col("j") == first)
    pairs = probes.join(bounded(index, n_items * BLOCKS * len(masks) * ROW_BYTES), match)

    # 4: exact similarity of the multisets
    pairs = pairs.select("doc_id", "win", "item").join(bounded(items.select("item", "item_id", "item_s"), n_items * ROW_BYTES + n_shingles * 8), "item")
    repeats = (F.size(F.array_distinct("win")) < F.size("win")) & (F.size(F.array_distinct("item_s")) < F.size("item_s"))
    counted = F.expr("aggregate(array_distinct(array_intersect(win, item_s)), 0, (n, x) -> n + least(size(filter(win, y -> y = x)), size(filter(item_s, y -> y = x))))")
    # where a shingle repeats on one side only, it is common once
    pairs = settled(pairs, "common", F.when(repeats, counted).otherwise(F.size(F.array_intersect("win", "item_s"))))
    similarity = F.col("common") / (F.size("win") + F.size("item_s") - F.col("common"))
    pairs = pairs.select("doc_id", "item_id", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    return pairs.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item; rows that share a doc_id, or have none, are judged each by its text."""
    key, hit = fresh(docs.columns, "row_key"), fresh(docs.columns, "leaked_key")
    keyed = docs.withColumn(key, row_key(["doc_id", "text"]))
    found = leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(hit)).distinct()
    return keyed.join(found, F.col(key) == F.col(hit), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
