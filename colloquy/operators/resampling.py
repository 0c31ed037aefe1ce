"""Cluster resampling: n draws of n clusters a replicate, applied where rows are read.

Clusters of a group are ranked; a replicate draws exactly as many clusters as there are, and
each draw is a hash of seed, replicate and its number, as SQL states it. The weights (replicates x
clusters) of a group of up to BLOCK clusters are made by each task that reads it. Those of
larger groups are drawn once, in parallel, by number of clusters, dealt to blocks of BLOCK ranks and
written; a range of rows meets the blocks that it needs. Weights times rows are added up as
matrix products, so what is shuffled on is a row a replicate and task, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import scan
from colloquy.sources.scratch import ship, written

BLOCK = 4096
#: Draws that a task makes at a time.
DRAWS = 1 << 20
#: Odd multipliers of the hash; SQL states the same numbers.
BY_SEED, BY_REP, BY_DRAW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
FIRST, SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_64 = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int, rep: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ranks that a replicate's draws number ``begin`` to ``end`` take, of n; by default all n draws."""
    base = mixed(np.array([(seed * BY_SEED + rep * BY_REP) & _64], np.uint64))
    u = mixed(base + np.arange(begin, n if end is None else end, dtype=np.uint64) * np.uint64(BY_DRAW))
    return (((u >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def draws_in(n: int, seed: int, rep: int, at: int, block: int = BLOCK) -> int:
    """How many of a replicate's n draws fall in a block."""
    return int((draws(n, seed, rep) // block == at).sum())


@lru_cache(4)
def weights(n: int, reps: int, seed: int, at: int, block: int = BLOCK) -> np.ndarray:
    """(replicates + 1, clusters of the block): how often each is drawn; replicate 0 takes each once."""
    size = min(block, n - at * block)
    out = np.ones((reps + 1, size))
    for rep in range(1, reps + 1):
        own = draws(n, seed, rep) - at * block
        out[rep] = np.bincount(own[(own >= 0) & (own < size)], minlength=size)
    return out


def drawn(rows: DataFrame, reps: int, seed: int = 1) -> DataFrame | None:
    """(_wn, _block, w): for each number of clusters beyond BLOCK the weights of each block of ranks, replicate by replicate; written. None without such a group."""
    ship(rows.sparkSession)
    sizes = rows.where(F.col("_n") > BLOCK).select(F.col("_n").alias("_wn")).distinct()
    if sizes.isEmpty():
        return None
    t = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_wn") - 1, F.lit(DRAWS).cast("long"))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rep, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.sort(draws(n, seed, rep, begin, min(n, begin + DRAWS)))
                block, first = np.unique(own // BLOCK, return_index=True)
                parts = np.split((own % BLOCK).astype(np.uint16), first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), n)), pa.array(block), pa.array(np.full(len(block), rep, np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["_wn", "_block", "rep", "ranks"])

    def gather(t: pa.Table) -> pa.Table:
        n, block = t["_wn"][0].as_py(), t["_block"][0].as_py()
        size = min(BLOCK, n - block * BLOCK)
        out = np.zeros((reps, size), np.uint32)
        for rep, ranks in zip(t["rep"].to_pylist(), t["ranks"].to_pylist(), strict=True):
            out[rep - 1] += np.bincount(np.frombuffer(ranks, np.uint16), minlength=size).astype(np.uint32)
        w = out.astype(np.min_scalar_type(int(out.max()))).tobytes()
        return pa.table([pa.array([n]), pa.array([block]), pa.array([w], pa.binary())], ["_wn", "_block", "w"])

    t = t.repartition("_wn", "rep", "begin").mapInArrow(deal, "_wn long, _block long, rep int, ranks binary")
    return written(t.groupBy("_wn", "_block").applyInArrow(gather, "_wn long, _block long, w binary"), "drawn")


def draw_sql(frames: str, reps: int, seed: int = 1, by: str = "") -> str:
    """DuckDB: CTEs ``ids`` (by, cluster, rank, n) and ``w`` (by, rep, cluster, w) for a table ``frames`` of (by, cluster)."""
    m = f"{_64 + 1}::UHUGEINT"
    step = lambda x, shift, by_: f"(xor({x}, {x} >> {shift}) * {by_}::UHUGEINT % {m})"

    def mix(x: str) -> str:
        z = step(step(x, 30, FIRST), 27, SECOND)
        return f"xor({z}, {z} >> 31)"

    base = f"(({seed}::UHUGEINT * {BY_SEED}::UHUGEINT + rep::UHUGEINT * {BY_REP}::UHUGEINT) % {m})"
    return f""", ids AS (SELECT {by} cluster, row_number() OVER (PARTITION BY {by or "1,"} 1 ORDER BY cluster) - 1 AS rank, count(*) OVER (PARTITION BY {by or "1,"} 1) AS n FROM {frames}),
sizes AS (SELECT DISTINCT {by} n FROM ids), bases AS (SELECT rep, {mix(base)} AS base FROM (SELECT unnest(range(1, {reps} + 1)) AS rep)),
us AS (SELECT rep, j, {mix(f"((base + j::UHUGEINT * {BY_DRAW}::UHUGEINT) % {m})")} AS u FROM bases, (SELECT unnest(range((SELECT max(n) FROM sizes))) AS j)),
drawn AS (SELECT {by} rep, (((u >> 32) * n::UHUGEINT) >> 32)::BIGINT AS rank, count(*) AS w FROM sizes, us WHERE j < n GROUP BY ALL),
w AS (SELECT {by} cluster, rep, w FROM drawn JOIN ids USING ({by} rank) UNION ALL SELECT {by} cluster, 0 AS rep, 1 AS w FROM ids)"""


def keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """With the group columns as one text, ``_g``."""
    return df.withColumn("_g", F.to_json(F.struct(*by)) if by else F.lit("{}"))


def unkeyed(df: DataFrame, by: list[str], like: DataFrame) -> DataFrame:
    if not by:
        return df.drop("_g")
    schema = ", ".join(f"`{c}` {like.schema[c].dataType.simpleString()}" for c in by)
    own = F.from_json("_g", schema)
    return df.select(*(own[c].alias(c) for c in by), *[c for c in df.columns if c != "_g"])


def framed(df: DataFrame, cluster: str, by: list[str]) -> DataFrame:
    """The rows with ``_g``, their cluster's rank (from 0) among those of the group, and the number of these."""
    t = keyed(df, by)
    t = written(t.withColumn("_c", F.col(cluster)), "frame")
    ranked = scan.with_rank(scan.ranged(t.select("_g", "_c").distinct(), ["_c"], ["_g"]), ["_c"], ["_g"], "_rank")
    sizes = ranked.groupBy("_g").agg(F.max("_rank").alias("_n"))
    ranked = ranked.join(sizes, "_g").select(F.col("_g").alias("_fg"), F.col("_c").alias("_fc"), (F.col("_rank") - 1).alias("_rank"), "_n")
    return t.join(ranked, (F.col("_g") == F.col("_fg")) & F.col("_c").eqNullSafe(F.col("_fc"))).drop("_fg", "_fc")


def replicate_sums(rows: DataFrame, columns: list[str], features: Callable[[str, list[np.ndarray]], np.ndarray], width: Callable[[str], int] | int, reps: int, seed: int = 1, own_draws: DataFrame | None = ...) -> DataFrame:
    """(_g, rep, x): by group and replicate the weighted sums of what ``features`` makes of the rows' columns.

    rows: from ``framed``, or with reps = 0 any with _g; features(group, arrays) gives a row
    of ``width`` numbers each. Replicate 0 is the sum of the rows as they are. own_draws:
    what ``drawn`` gives, for callers that have asked it.
    """
    ship(rows.sparkSession)
    large = None
    if reps:
        rows = rows.select("_g", "_rank", "_n", *columns)
        own_draws = drawn(rows, reps, seed) if own_draws is ... else own_draws
        if own_draws is not None:
            large = scan.ranged(rows.where(F.col("_n") > BLOCK), ["_rank", *columns], ["_g"])
            rows = rows.where(F.col("_n") <= BLOCK)
        rows = rows.repartitionByRange("_g", "_rank", *columns).sortWithinPartitions("_g", "_rank")
    else:
        rows = rows.select("_g", F.lit(0).cast("long").alias("_rank"), F.lit(1).cast("long").alias("_n"), *columns)
    width_of = width if callable(width) else lambda g: width

    def add(to: np.ndarray, name: str, rank: np.ndarray, values: list[np.ndarray], weights_at: Callable[[int], np.ndarray]) -> None:
        """Rows of a group in order of rank: those of a cluster are added up before they are weighted."""
        x = features(name, values)
        starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        x, at = np.add.reduceat(x, starts), rank[starts]
        for b in np.unique(at // BLOCK):
            inside = at // BLOCK == b
            to += weights_at(int(b))[:, at[inside] % BLOCK] @ x[inside]

    def rows_of(g: str, m: np.ndarray) -> list[pa.Array]:
        return [pa.array([g] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for g, m in held.items():
                yield pa.RecordBatch.from_arrays(rows_of(g, m), ["_g", "rep", "x"])
            held.clear()

        for batch in batches:
            g = batch.column(0).dictionary_encode()
            code, rank, n = np.asarray(g.indices), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]]
            for k, name in enumerate(g.dictionary.to_pylist()):
                own = np.flatnonzero(code == k)
                if name not in held:
                    if len(held) >= 64:
                        yield from flush()
                    held[name] = np.zeros((reps + 1, width_of(name)))
                if not reps:
                    held[name][0] += features(name, [v[own] for v in values]).sum(axis=0)
                    continue
                size = int(n[own[0]])
                add(held[name], name, rank[own], [v[own] for v in values], lambda b, size=size: weights(size, reps, seed, b))
        yield from flush()

    def run_large(own: pa.Table, blocks: pa.Table) -> pa.Table:
        name, rank = own["_g"][0].as_py(), np.asarray(own["_rank"])
        by = np.argsort(rank, kind="stable")
        packed = dict(zip(blocks["_block"].to_pylist(), blocks["w"].to_pylist(), strict=True))
        n, out = own["_n"][0].as_py(), np.zeros((reps + 1, width_of(name)))

        def weights_at(b: int) -> np.ndarray:
            cells = reps * min(BLOCK, n - b * BLOCK)
            w = np.frombuffer(packed[b], f"u{len(packed[b]) // cells}").reshape(reps, -1)
            return np.concatenate((np.ones((1, w.shape[1])), w))

        add(out, name, rank[by], [own[c].to_numpy()[by] for c in columns], weights_at)
        return pa.table(rows_of(name, out), ["_g", "rep", "x"])

    schema = "_g string, rep int, x array<double>"
    t = rows.mapInArrow(run, schema)
    if large is not None:
        asked = large.select(F.col(scan.RANGE).alias("_wr"), F.col("_g").alias("_wg"), F.col("_n").alias("_wn"), F.floor(F.col("_rank") / BLOCK).alias("_block")).distinct()
        asked = asked.join(own_draws, ["_wn", "_block"]).select("_wr", "_wg", "_block", "w")
        t = t.unionByName(large.groupBy(scan.RANGE, "_g").cogroup(asked.groupBy("_wr", "_wg")).applyInArrow(run_large, schema))
    t = t.select("_g", "rep", F.posexplode("x").alias("k", "v")).groupBy("_g", "rep", "k").agg(F.sum("v").alias("v"))
    return t.groupBy("_g", "rep").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p")).select("_g", "rep", F.col("p.v").alias("x"))


def between_ranks(values: Column, p: float) -> Column:
    """The quantile of an array in order, between its two nearest ranks."""
    at = F.lit(p) * (F.size(values) - 1)
    return scan.between(F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int")), at - F.floor(at))


def percentile_interval(t: DataFrame, by: list[str], value: str) -> DataFrame:
    """estimate (replicate 0), low, high, n_reps by group; a group has a row a replicate."""
    own = F.when(F.col("rep") > 0, F.col(value))
    t = t.groupBy(*by).agg(F.max(F.when(F.col("rep") == 0, F.col(value))).alias("estimate"), F.array_sort(F.collect_list(own)).alias("_all"))
    return t.select(*by, "estimate", between_ranks(F.col("_all"), 0.025).alias("low"), between_ranks(F.col("_all"), 0.975).alias("high"), F.size("_all").cast("long").alias("n_reps"))


def cluster_bootstrap(df: DataFrame, cluster: str, sums: dict, ratios: dict[str, tuple[str, str]], reps: int, seed: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentile intervals of ratios of sums under resampled clusters, by group: (group..., metric, estimate, low, high, n_reps)."""
    by, names = list(by), list(sums)
    per = df.groupBy(cluster, *by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(k) for k, c in sums.items()))
    t = replicate_sums(framed(per, cluster, by), names, lambda g, v: np.column_stack(v).astype(float), len(names), reps, seed)
    t = t.select("_g", "rep", *(F.col("x")[k].alias(c) for k, c in enumerate(names)))
    stack = ", ".join(f"'{m}', {a} / nullif({b}, 0)" for m, (a, b) in ratios.items())
    t = t.select("_g", "rep", F.expr(f"stack({len(ratios)}, {stack}) as (metric, value)"))
    return unkeyed(percentile_interval(t, ["_g", "metric"], "value"), by, df)


def bootstrap_quantiles(df: DataFrame, cluster: str, value: str, probs: dict[str, float], reps: int, seed: int = 1, by: tuple[str, ...] = (), fan: int = 64) -> DataFrame:
    """Intervals of quantiles under resampled clusters: in a replicate the smallest value whose running weight reaches p of the total; the estimate interpolates.

    Distinct values are numbered in order by group. A replicate's quantile is found by
    parts: weights by ``fan`` parts of all numbers tell which part holds it, then weights by parts of
    that part, until a part is one number; later passes read the rows of such parts only.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    t = framed(df.select(cluster, *by, F.col(value).alias("_v")), cluster, by)  # clusters without values are drawn too
    values = scan.with_rank(scan.ranged(t.where("_v is not null").select("_g", "_v").distinct(), ["_v"], ["_g"]), ["_v"], ["_g"], "_number")
    values = written(values.select(F.col("_g").alias("_vg"), F.col("_v").alias("_vv"), (F.col("_number") - 1).alias("_number")), "values")
    most = values.agg(F.max("_number")).first()[0]
    if most is None:
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
        return df.sparkSession.createDataFrame([], f"{kinds}{', ' if kinds else ''}metric string, estimate double, low double, high double, n_reps long")
    cells = t.join(values, (F.col("_g") == F.col("_vg")) & (F.col("_v") == F.col("_vv")))
    cells = written(cells.groupBy("_g", "_rank", "_n", "_number").agg(F.count("*").cast("double").alias("_w")), "cells")
    own_draws = drawn(cells, reps, seed)
    width = 1
    while width * fan <= most:
        width *= fan
    asked = None  # (_g, rep, name, part, before, at): the part that holds a quantile and the weight before it
    while True:
        here = cells.withColumn("_part", F.floor(F.col("_number") / width))
        if asked is not None:
            parents = asked.select(F.col("_g").alias("_pg"), F.col("part").alias("_pp")).distinct()
            here = here.join(parents, (F.col("_g") == F.col("_pg")) & (F.floor(F.col("_part") / fan) == F.col("_pp")), "left_semi")
        slots = here.select("_g", "_part").distinct().groupBy("_g").agg(F.array_sort(F.collect_set("_part")).alias("_slots"))
        slot = {r._g: np.array(r._slots) for r in slots.collect()}  # at most fan for each part asked
        pick = lambda g, v, s=slot: (v[0][:, None] == s[g][None, :]) * v[1][:, None]
        found = replicate_sums(here.groupBy("_g", "_rank", "_n", "_part").agg(F.sum("_w").alias("_w")), ["_part", "_w"], pick, lambda g, s=slot: len(s[g]), reps, seed, own_draws)
        found = found.join(slots, "_g").select("_g", "rep", F.explode(F.arrays_zip("_slots", "x")).alias("z")).select("_g", "rep", F.col("z._slots").alias("part"), F.col("z.x").alias("w"))
        if asked is None:
            whole = Window.partitionBy("_g", "rep")
            found = found.withColumns({"upto": F.sum("w").over(whole.orderBy("part")), "total": F.sum("w").over(whole)})
            own = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in probs.items())))
            found = found.withColumn("own", own).select("_g", "rep", "own.name", "part", "w", "upto", (F.col("own.p") * F.col("total")).alias("at"))
        else:
            up = asked.select(F.col("_g").alias("_pg"), F.col("rep").alias("_pr"), "name", F.col("part").alias("_pp"), "before", "at")
            found = found.join(up, (F.col("_g") == F.col("_pg")) & (F.col("rep") == F.col("_pr")) & (F.floor(F.col("part") / fan) == F.col("_pp")))
            found = found.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("_g", "rep", "name").orderBy("part")))
        found = found.where("w > 0 and upto >= at and upto - w < at").select("_g", "rep", "name", "part", (F.col("upto") - F.col("w")).alias("before"), "at")
        asked = written(found, "asked")
        if width == 1:
            break
        width //= fan
    t = asked.join(values, (F.col("_g") == F.col("_vg")) & (F.col("part") == F.col("_number"))).select("_g", "rep", F.col("name").alias("metric"), F.col("_vv").alias("value"))
    t = percentile_interval(t, ["_g", "metric"], "value").drop("estimate")
    exact = scan.quantiles(keyed(rows.select(*by, F.col(value).alias("_v")), by), "_v", probs, ["_g"])
    exact = exact.select(F.col("_g").alias("_eg"), F.expr("stack({}, {}) as (_em, estimate)".format(len(probs), ", ".join(f"'{k}', {k}" for k in probs))))
    t = t.join(exact, (F.col("_g") == F.col("_eg")) & (F.col("metric") == F.col("_em"))).select("_g", "metric", "estimate", "low", "high", "n_reps")
    return unkeyed(t, by, df)
