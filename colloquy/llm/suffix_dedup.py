"""Operator 4, removal of repeated 200-byte strings by bounded interval expansion on a BWT.

All texts are UTF-8 bytes; a byte goes if a 200-byte string that covers it also starts
anywhere else. Suffix-sorting a whole corpus needs many times its size on disk, so the
corpus is first cut to what can repeat, without losing a repeat:

1. Anchors. Every 200-byte window holds WINDOW = 161 strings of 40 bytes; the one with
   the smallest hash, leftmost of equals, is its anchor. Equal windows have equal
   anchors, so windows are compared only under a common anchor. Neighbouring windows
   share anchors: a row (anchor, context, row, first, n) stands for n windows, its
   context being all bytes that they cover. That is about 1.2 rows per 100 bytes.
2. Contexts. Anchors that occur once are dropped. Contexts that are equal as a whole
   repeat all their windows and are one from here on (pre-aggregated by key).
3. Expansion. Distinct contexts under one anchor meet in a block. The block's suffix
   array gives its Burrows-Wheeler transform; intervals of suffixes with a common
   prefix are then extended backwards breadth first, from the empty prefix on. An
   interval of length l that ends where no longer interval did fixes a common prefix of
   l there. At l = 200 the expansion stops: whatever is not fixed yet has a common
   prefix of 200 bytes or more with its neighbour, that is a repeated window.
4. Removal. Repeated windows go back to all their occurrences, and each document drops
   the union of its windows.

Anchors whose distinct contexts exceed BLOCK_BYTES fit no block: one task would hold
them. Each is split by the bytes beside it, and the same steps follow: windows in which
the anchor stands at WIDTHS[0] neighbouring places share 201 - WIDTHS[0] bytes, whose hash is
a new anchor for these windows; what is too large again is split by single places, where
all 200 bytes are the anchor. So the expansion decides every repeat, whatever the sizes.
Contexts that agree in the anchor's 64 bits and 128 bits of their own are taken as equal.

Defined results: null text is empty; documents of fewer than 200 bytes lose bytes to
none; very long texts are cut in steps of STEP windows, so the arrays stay small; rows
that repeat a doc_id are separate documents (a written row number tells them apart);
empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesplit as bs
from .common import Scratch, table
from .tokens import ragged

LENGTH = 200
GRAM = 40
WINDOW = LENGTH - GRAM + 1
#: Anchors with more bytes of distinct contexts than BLOCK_BYTES are split; smaller ones share blocks of BATCH_BYTES.
BLOCK_BYTES, BATCH_BYTES = 1 << 19, 1 << 18
#: Places of an anchor in a window that stay together when it is split, step by step.
WIDTHS = (8, 1)

#: Windows of a text that are worked on at once.
STEP = 1 << 20
#: Odd bases, and random numbers for bytes, of two independent hashes.
_BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTES = bs.seeds(256, 31), bs.seeds(256, 32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, filled = np.uint64(base), 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        filled += more
        step = step * step
    return out


class Rolling:
    """Hashes of any substring of a byte array: differences of prefix sums, shifted to place 0."""

    _held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, which: int = 0):
        up, down = Rolling._held.get(which, (None, None))
        if up is None or len(up) < len(buf) + 1:
            n = 1 << int(len(buf) + 1).bit_length()
            with np.errstate(over="ignore"):
                up, down = _powers(_BASES[which], n), _powers(pow(_BASES[which], -1, 1 << 64), n)
            Rolling._held[which] = up, down
        self.down = down
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[which][buf] * up[: len(buf)], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        h = self.sums[width:] - self.sums[:-width]
        h *= self.down[: len(h)]
        return bs.mix(h)

    def of(self, first: np.ndarray, width: np.ndarray) -> np.ndarray:
        return bs.mix((self.sums[first + width] - self.sums[first]) * self.down[first] + bs.mix(width.astype(np.uint64)))


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Of STEP windows of a text at a time: anchor hash, two context hashes, first window, windows; one entry a run of windows."""
    whole, low = np.frombuffer(text, np.uint8), np.uint64((1 << 24) - 1)
    for a in range(0, len(whole) - LENGTH + 1, STEP):
        n_windows = min(STEP, len(whole) - LENGTH + 1 - a)
        buf = whole[a : a + n_windows + LENGTH - 1]
        rolling = Rolling(buf)
        h = rolling.every(GRAM)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # positions in 24 bits
        width = 1
        while 2 * width <= WINDOW:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[:n_windows], key[WINDOW - width : WINDOW - width + n_windows])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(first, n_windows))
        at = (key[first] & low).astype(np.int64)
        # equal contexts have equal windows, and so their anchor at the same place
        contexts = [r.of(first, n + LENGTH - 1) for r in (rolling, Rolling(buf, 1))]
        yield h[at], *contexts, a + first, n


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "context", "context2", "row", "first", "n"]
    for batch in batches:
        rows = batch.column(0).to_pylist()
        for first, texts in bs.pieces(batch.column(1)):
            held = [(*x, rows[first + k]) for k, t in enumerate(texts) for x in anchors(t)]
            if held:
                x = [np.concatenate(c) for c in zip(*(h[:5] for h in held), strict=True)]
                row = np.repeat(np.array([h[5] for h in held], np.int64), [len(h[0]) for h in held])
                cols = [*(c.view(np.int64) for c in x[:3]), row, *(c.astype(np.int32) for c in x[3:])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
    bs.trim()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context bytes of (text, [(anchor, context, first, n, hot)])."""
    schema = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("context", pa.int64()), ("context2", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for k in range(len(batch)):
            text, wanted = texts[k].as_py(), batch.column(1)[k].values
            for a in range(0, len(wanted), 10_000):
                part = wanted.slice(a, 10_000).to_pylist()
                yield pa.RecordBatch.from_pylist([{**w, "bytes": text[w["first"] : w["first"] + w["n"] + LENGTH - 1]} for w in part], schema=schema)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by prefix doubling. Symbols have 9 bits.

    Suffixes that agree so far stay in any order: all intervals of prefixes up to that
    depth are the same as in the complete order, and longer ones are not asked for.
    """
    n, width = len(s), 7
    padded = np.concatenate((s.astype(np.int64), np.zeros(width, np.int64)))
    rank = padded[:n].copy()
    for k in range(1, width):
        rank = (rank << 9) | padded[k : k + n]
    order = np.argsort(rank)
    key = rank[order]
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    # a rank is the place of the first suffix of those that agree
    ids = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    rank[order] = ids
    places = np.flatnonzero(~(new & np.append(new[1:], True)))  # in the order, of suffixes that share a rank
    while len(places) and width < depth:
        open_ = order[places]
        later = np.zeros(len(open_), np.int64)
        inside = open_ + width < n
        later[inside] = rank[open_[inside] + width]
        key = (ids[places] << 32) | later
        by = np.argsort(key)
        key, order[places] = key[by], open_[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))] + 1
        ids[places] = group
        rank[order[places]] = group
        places = places[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def repeated_suffixes(s: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffix at each position shares its first ``length`` symbols with another one.

    s: symbols, 0 where a string ends. Only positions with ``length`` symbols before the
    next end are to be asked for; their matches then cross no end.
    Intervals are extended backwards; the longest common prefix before suffix j is fixed
    when the first interval that ends there is reached, in the order of its length.
    """
    n = len(s)
    order = suffix_array(s, length)
    last = s[order - 1]  # the transform; the symbol before the first suffix is the last end
    last_sorted = np.argsort(last, kind="stable")
    to = np.empty(n, np.int64)
    to[last_sorted] = np.arange(n)  # from a suffix to the one that is longer by the symbol before
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    low, high = np.array([0]), np.array([n])  # intervals [low, high), in order and disjoint
    for _ in range(length):
        count = high - low
        at = ragged(low, count)
        goes, symbol = to[at], last[at]
        # by symbol and place: what an interval has of one symbol lies together under ``to``
        by = np.argsort(goes)
        goes, symbol, owner = goes[by], symbol[by], np.repeat(np.arange(len(low)), count)[by]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))))
        ends = np.append(goes[first[1:] - 1], goes[-1]) + 1
        fresh = ~fixed[ends]
        fixed[ends[fresh]] = True
        low, high = goes[first][fresh], ends[fresh]
        if not len(low):
            break
    long = ~fixed
    out = np.zeros(n, bool)
    out[order] = long[:-1] | long[1:]
    return out


def repeated_windows(contexts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each context which of its first windows repeat among the contexts."""
    s = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(c) + 1 for c in contexts])
    s[ends - 1] = 0
    long = repeated_suffixes(s, LENGTH)
    return [long[e - len(c) - 1 : e - len(c) - 1 + n] for e, c, n in zip(ends.tolist(), contexts, counts, strict=True)]


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_RUNS = "runs array<struct<a:int,b:int>>"
_FOUND = f"anchor long, context long, context2 long, {_RUNS}"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("context2", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole anchors; the rows come sorted by anchor."""

    def done(rows):
        flags = repeated_windows([r["bytes"] for r in rows], [r["n"] for r in rows])
        found = [{"anchor": r["anchor"], "context": r["context"], "context2": r["context2"], "runs": _runs(f)} for r, f in zip(rows, flags, strict=True) if f.any()]
        return pa.RecordBatch.from_pylist(found, schema=_FOUND_ARROW)

    held, group, size = [], None, 0
    for batch in batches:
        for r in batch.to_pylist():
            if r["anchor"] != group:
                if size > BATCH_BYTES:
                    yield done(held)
                    held, size = [], 0
                group = r["anchor"]
            held.append(r)
            size += len(r["bytes"])
    if held:
        yield done(held)


def _split_rows(width: int):
    """As ``_anchor_rows``, of contexts of anchors that are too large: an anchor for every ``width`` places of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << 24) - 1)
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for first, texts in bs.pieces(batch.column(1)):
                lens = np.fromiter(map(len, texts), np.int64, len(texts))
                at, n = np.cumsum(lens) - lens, lens - LENGTH + 1
                buf = np.frombuffer(b"".join(texts), np.uint8)
                rolling, second = Rolling(buf), Rolling(buf, 1)
                h = rolling.every(GRAM) & ~low
                place = np.argmin(h[at[:, None] + np.arange(WINDOW)], axis=1)  # of the anchor in the context, as in ``anchors``
                # in window p it stands at place - p; these are cut into groups of width
                least, most = (place - n + 1) // width, place // width
                group, own = ragged(least, most - least + 1), np.repeat(np.arange(len(texts)), most - least + 1)
                a, b = np.maximum(group * width, (place - n + 1)[own]), np.minimum(group * width + width - 1, place[own])
                p, windows = place[own] - b, b - a + 1
                shared = rolling.of(at[own] + place[own] - group * width, np.full(len(own), LENGTH - width + 1))
                anchor = bs.mix(shared + group.astype(np.uint64) * np.uint64(_BASES[1]))
                contexts = [r.of(at[own] + p, windows + LENGTH - 1).view(np.int64) for r in (rolling, second)]
                cols = [anchor.view(np.int64), *contexts, rows[first : first + len(texts)][own], p.astype(np.int32), windows.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "context", "context2", "row", "first", "n"])
        bs.trim()

    return run


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    """Bytes and maximal runs removed, and the hash of what stays, of a text without its windows [start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64)) + LENGTH - 1
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1]))) if len(starts) else np.zeros(0, int)
    a, b = starts[new], ends[np.append(new[1:], len(starts)) - 1] if len(starts) else ends
    kept, at = hashlib.sha256(), 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        kept.update(memoryview(text)[at:x])
        at = y
    kept.update(memoryview(text)[at:])
    return int((b - a).sum()), len(a), kept.hexdigest()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int32)
    for batch in batches:
        spans = batch.column(2)
        for first, texts in bs.pieces(batch.column(1)):
            rows = []
            for k, t in enumerate(texts):
                own = spans[first + k].values
                rows.append((len(t), *(_kept(t, none, none) if own is None else _kept(t, own.field(0).to_numpy(), own.field(1).to_numpy()))))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    bs.trim()


def repeated_spans(docs: DataFrame, scratch: Scratch, anchored=_anchor_rows, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(row, spans) of documents (row, text): windows [a, b) of starts that repeat, by row.

    ``anchored`` gives the anchors; those that are too large are split at the next of ``widths``.

    What is joined to rows of common anchors or contexts is written before, so that skew
    handling can split the join.
    """
    keys = ["anchor", "context", "context2"]
    rows = scratch.keep(docs.select("row", "text").mapInArrow(anchored, "anchor long, context long, context2 long, row long, first int, n int"))
    often = scratch.keep(rows.groupBy("anchor").agg(F.count("*").alias("uses")).where("uses > 1").select("anchor"))
    shared = scratch.keep(rows.join(often, "anchor"))
    scratch.drop(rows)

    contexts = shared.groupBy(*keys).agg(F.count("*").alias("uses"), F.min(F.struct("row", "first", "n")).alias("at"))
    contexts = scratch.keep(contexts)
    size = F.col("at.n") + LENGTH
    varied = contexts.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(size).alias("size")).where("k > 1")
    varied = scratch.keep(varied.select("anchor", (F.col("size") > (BLOCK_BYTES if widths else 1 << 62)).alias("hot")))
    wanted = contexts.join(varied, "anchor").select("at.row", F.struct("anchor", "hot", "context", "context2", "at.first", "at.n").alias("w"))
    wanted = wanted.groupBy("row").agg(F.collect_list("w").alias("wanted"))
    cut = wanted.join(docs, "row").select("text", "wanted").mapInArrow(_cut, "anchor long, hot boolean, context long, context2 long, n int, bytes binary")
    cut = scratch.keep(cut)
    found = cut.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_expanded, _FOUND)
    hot = cut.where("hot")
    if widths and not hot.isEmpty():
        hot = scratch.keep(hot.select(*keys, F.monotonically_increasing_id().alias("row"), F.col("bytes").alias("text")))
        parts = repeated_spans(hot, scratch, _split_rows(widths[0]), widths[1:])
        found = found.unionByName(hot.drop("text").join(parts, "row").select(*keys, F.col("spans").alias("runs")))

    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("at.n").alias("b")))
    marks = contexts.join(scratch.keep(found), keys, "left")
    marks = marks.select(*keys, F.when(F.col("uses") > 1, whole).otherwise(F.col("runs")).alias("runs")).where("runs is not null")
    hits = shared.join(scratch.keep(marks), keys).select("row", "first", F.explode("runs").alias("r"))
    span = F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b"))
    return hits.groupBy("row").agg(F.collect_list(span).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = scratch.keep(docs.withColumn("row", F.monotonically_increasing_id()))
    spans = repeated_spans(docs, scratch)
    t = docs.join(spans, "row", "left").select("doc_id", "text", "spans")
    return t.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
