"""Operator 1, near-duplicate documents by min-max hashing.

1. Sets. Each whole text becomes the set of its 5-word shingles (A-Z lower-cased).
   Under each of 100 permutations both the smallest and the largest value are kept:
   200 signature values from 100 evaluations, cut into 40 bands of 5 (20 of minima,
   20 of maxima, each over other permutations). A pair at the threshold shares a band
   with probability 1 - (1 - 0.75^5)^40 = 0.99998, a pair at 0.9 with 1 - 1e-15.
2. Copies. Documents with the same set (128-bit key) are one representative from here
   on, a node with a number of its own; grouping by key pre-aggregates, so large groups
   of copies are cheap. Sets that share a doc_id are linked.
3. Buckets. Representatives that share a band are candidates. Round by round each bucket
   gives the pairs of one centre (at first the member with most copies) with all members
   that are not yet in its component; near-copies of one text join in a round or two, so
   the pairs grow with the members and not their square. Before a pair leaves its bucket,
   set sizes must allow the threshold and one bit of each signature value must agree in
   3 of 4 places (a pair at the threshold agrees in 7 of 8, with a deviation of 0.023:
   one in ten million is missed).
   The first round tests the only pair of a bucket of two, which is done then. What is
   still in different components after ROUNDS rounds is compared in blocks of BLOCK members
   (fewer where their sets are large): first by bits, which leaves the members that have a
   likely partner, then by full sets, all pairs of two blocks as one matrix product. Only one link
   between two components leaves a block pair, so no link is lost and none is repeated.
4. Confirmation. Links are tested on full sets: 100 * |A n B| >= 75 * |A u B|.
5. Components by alternating stars; the smallest doc_id names each. Links found in a
   later round are between components that are known, so stars run over these alone,
   however many nodes and links there were before.

Every stage is written to the shared folder. Only counts come to the driver.

Defined results: null and blank texts have an empty set and stand alone; a null doc_id
is never linked and has a null component_id, but is kept; a doc_id that repeats with
other texts links all of them, whatever the order of the rows; texts of any length are
taken whole; empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesplit as bs
from .common import Scratch, table
from .components import stars

SHINGLE = 5
PERCENT = 75
PERMUTATIONS, ROWS = 100, 5
ROUNDS, BLOCK = 2, 512
#: Shingles that a block's sets hold on average at most, so that two blocks fit a task whatever the texts' lengths.
BLOCK_SHINGLES = 1 << 21
BITS = 2 * PERMUTATIONS

_SIGNATURE = "n_shingles long, k1 long, k2 long, bands array<long>, bits array<long>"


def _sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, texts in bs.pieces(texts):
        yield first, bs.shingle_sets(*bs.split(texts), SHINGLE)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set: band keys from the extremes of its values under each permutation, and their bits in four numbers."""
    mult = (bs.seeds(PERMUTATIONS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (bs.seeds(PERMUTATIONS, 22) >> np.uint64(32)).astype(np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for k in range(0, len(x), 2048):
        y = x[k : k + 2048, None] * mult[None, :]
        y += add
        np.minimum(low, y.min(axis=0), out=low)
        np.maximum(high, y.max(axis=0), out=high)
    values = bs.mix(np.concatenate((low, high)).astype(np.uint64))
    bits = np.zeros(256, np.uint8)
    bits[:BITS] = values & np.uint64(1)
    rows = values.reshape(-1, ROWS) * (bs.seeds(ROWS, 23) | np.uint64(1))
    return bs.mix(rows.sum(axis=1) + np.arange(len(rows), dtype=np.uint64)), np.packbits(bits).view(np.uint64)


def _keys(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """128 bits of each set, whatever the order of its shingles."""
    salts = np.uint64(0), np.uint64(0x5851F42D4C957F2D)
    return tuple(pa.array(np.array([bs.mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for salt in salts)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch.column(1)):
            ids = batch.column(0).slice(first, len(sets))
            k1, k2 = _keys(sets)
            both = [signature(s) if len(s) else (s, s) for s in sets]
            bands, bits = _lists([x for x, _ in both]), _lists([x for _, x in both])
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n, k1, k2, bands, bits], ["doc_id", "n_shingles", "k1", "k2", "bands", "bits"])
    bs.trim()


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _sets(batch.column(0)):
            yield pa.RecordBatch.from_arrays([*_keys(sets), _lists(sets)], ["k1", "k2", "s"])
    bs.trim()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components ca and cb of the pairs (a, b) whose full sets reach the threshold."""
    t = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    t = t.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return t.where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _likely(m: str, m2: str) -> Column:
    """Whether sizes and signature bits of two members leave the threshold possible."""
    low, high = F.least(f"{m}.n", f"{m2}.n"), F.greatest(f"{m}.n", f"{m2}.n")
    apart = sum((F.bit_count(F.get(f"{m}.bits", F.lit(k)).bitwiseXOR(F.get(f"{m2}.bits", F.lit(k)))) for k in range(1, 4)), F.bit_count(F.get(f"{m}.bits", F.lit(0)).bitwiseXOR(F.get(f"{m2}.bits", F.lit(0)))))
    return (100 * low >= PERCENT * high) & (4 * apart <= BITS)


def _untested(rounds: int) -> Column:
    """Whether a bucket has components apart and, after so many rounds, pairs without its centre: the first round tests the only pair of two members."""
    return (F.col("c1") < F.col("c2")) & (F.col("size") > (2 if rounds else 1))


def _meetings(t: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of (band, rep, ...) once for every pair of blocks (i, j) of their bucket that they meet in."""
    t = scratch.keep(t)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = scratch.keep(t.groupBy("band").agg(blocks.alias("blocks")))
    t = t.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(9)), "blocks").cast("int"))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return t.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _fit(n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which pairs are in different components and of sizes that allow the threshold."""
    return (100 * np.minimum.outer(n, n) >= PERCENT * np.maximum.outer(n, n)) & (c[:, None] != c[None, :])


def _hopeful(t: pa.Table) -> pa.Table:
    """The members with a likely partner in another component."""
    t = t.combine_chunks()
    m = len(t)
    bits = t["bits"].combine_chunks().values.to_numpy().view(np.uint64).reshape(m, 4)
    n, c = t["n"].to_numpy(), t["c"].to_numpy()
    hit = np.zeros(m, bool)
    for k in range(0, m, 256):
        apart = np.bitwise_count(bits[k : k + 256, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int32)
        sized = 100 * np.minimum.outer(n[k : k + 256], n) >= PERCENT * np.maximum.outer(n[k : k + 256], n)
        hit[k : k + 256] = ((4 * apart <= BITS) & sized & (c[k : k + 256, None] != c[None, :])).any(axis=1)
    return t.select(["band", "rep", "n", "c"]).filter(pa.array(hit))


def _linked(t: pa.Table) -> pa.Table:
    """The components (a, b) that a pair in this pair of blocks links, each once."""
    sets = t["s"].combine_chunks()
    m, n, c = len(t), t["n"].to_numpy(), t["c"].to_numpy()
    flat, owner = sets.values.to_numpy(), np.repeat(np.arange(m), np.diff(sets.offsets.to_numpy()))
    shingle, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    common = np.zeros((m, m), np.float32)
    for first in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        block = np.zeros((m, 4096), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        common += block @ block.T
    links = _fit(n, c) & (100 * common >= PERCENT * (n[:, None] + n[None, :] - common))
    x, y = np.nonzero(np.triu(links))
    a, b = np.unique(np.stack((np.minimum(c[x], c[y]), np.maximum(c[x], c[y]))), axis=1)
    return pa.table({"a": a, "b": b})


def _shared_ids(linked: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links between the sets of a doc_id that has several; None if there is none."""
    own = F.struct("k1", "k2")
    several = scratch.keep(linked.groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low != high").select("doc_id"))
    if several.isEmpty():
        return None
    at = linked.join(several, "doc_id").select("doc_id", "k1", "k2").distinct().join(reps.select("k1", "k2", "node"), ["k1", "k2"])
    low = at.groupBy("doc_id").agg(F.min("node").alias("b"))
    return at.join(low, "doc_id").where("node != b").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text), whatever the type of doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signatures = scratch.keep(docs.mapInArrow(_signatures, f"doc_id {id_type}, {_SIGNATURE}"))

    linked = signatures.where("n_shingles > 0 and doc_id is not null")
    reps = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")))
    reps = scratch.keep(reps.withColumn("node", F.monotonically_increasing_id()))
    # tables that are joined to rows of hot keys are written first, and joined by shuffles at
    # every size: skew handling can split such joins
    rows = reps.select("node", F.explode("bands").alias("band"))
    buckets = scratch.keep(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"))
    members = rows.join(buckets.hint("merge"), "band").join(reps.select("node", F.col("n_shingles").alias("n"), "bits", "copies", "k1"), "node")
    members = scratch.keep(members.select("band", F.struct(F.col("node").alias("rep"), "n", "bits", "copies", "k1").alias("m")))
    chosen = members.select(F.col("m.rep").alias("node")).distinct().join(reps.select("node", "least", "k1", "k2"), "node")
    chosen = scratch.keep(chosen.select(F.col("node").alias("id"), F.col("least").alias("doc_id"), "k1", "k2"))
    # a doc_id may have other texts too: a set is known by its key
    sets = docs.join(chosen.select("doc_id").distinct().hint("merge"), "doc_id").select("text").mapInArrow(_full_sets, "k1 long, k2 long, s array<long>")
    sets = scratch.keep(sets.dropDuplicates(["k1", "k2"]).join(chosen.select("id", "k1", "k2"), ["k1", "k2"]).select("id", "s"))

    #: (u, v): each node u that is not the smallest of its component, and that smallest v, which is the component
    labels = tested = None

    def linked_by(found: DataFrame) -> None:
        """Takes in links (a, b) between components."""
        nonlocal labels
        new = stars(found, scratch)
        if labels is not None:
            # a component that moves is in no row as u yet
            moved = new.select(F.col("u").alias("v"), F.col("v").alias("w"))
            new = scratch.keep(labels.join(moved, "v", "left").select("u", F.coalesce("w", "v").alias("v")).union(new))
        labels = new

    def in_components() -> DataFrame:
        if labels is None:
            return members.withColumn("c", F.col("m.rep"))
        return scratch.keep(members.join(labels, F.col("m.rep") == F.col("u"), "left").select("band", "m", F.coalesce("v", "m.rep").alias("c")))

    same_id = _shared_ids(linked, reps, scratch)
    if same_id is not None:
        linked_by(same_id)
    for k in range(ROUNDS):
        here = in_components()
        first = F.struct(-F.col("m.copies") if k == 0 else F.lit(0), F.xxhash64("m.k1", F.lit(k)))
        open_ = here.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min_by(F.struct("m", "c"), first).alias("x"), F.count("*").alias("size"))
        open_ = open_.where(_untested(k))
        centre = scratch.keep(open_.select("band", F.col("x.m").alias("m2"), F.col("x.c").alias("c2")))
        new = here.join(centre.hint("merge"), (here["band"] == centre["band"]) & (F.col("c") != F.col("c2")) & _likely("m", "m2"))
        ends = F.least("m.rep", "m2.rep").alias("a"), F.greatest("m.rep", "m2.rep").alias("b")
        new = new.select(*ends, F.least("c", "c2").alias("ca"), F.greatest("c", "c2").alias("cb")).distinct()
        new = scratch.keep(new if tested is None else new.join(tested, ["a", "b"], "left_anti"))
        tested = new.select("a", "b") if tested is None else tested.union(new.select("a", "b"))
        if not new.isEmpty():
            linked_by(_confirmed(new, sets))

    here = in_components().select("band", "m.rep", "m.n", "m.bits", "c")
    open_ = scratch.keep(here.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("size")).where(_untested(ROUNDS)).select("band"))
    rest = _meetings(here.join(open_, "band"), scratch).groupBy("band", "i", "j").applyInArrow(_hopeful, "band long, rep long, n long, c long")
    rest = scratch.keep(rest.distinct())
    if not rest.isEmpty():
        rest = _meetings(rest, scratch).join(sets.withColumnRenamed("id", "rep"), "rep")
        linked_by(rest.groupBy("band", "i", "j").applyInArrow(_linked, "a long, b long"))
    if labels is None:
        labels = reps.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)

    top = scratch.keep(reps.join(labels, F.col("node") == F.col("u"), "left").select("k1", "k2", "least", F.coalesce("v", "node").alias("c")))
    names = scratch.keep(top.groupBy("c").agg(F.min("least").alias("component_id")))
    top = scratch.keep(top.join(names.hint("merge"), "c").select("k1", "k2", "component_id"))
    out = signatures.select("doc_id", "n_shingles", "k1", "k2").join(top.hint("merge"), ["k1", "k2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
