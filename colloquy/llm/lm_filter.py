"""Operator 12, language-model scores from a log-frequency Bloom filter.

A text's tokens are its words (A-Z lower-cased), then one end; the end also stands before
the first word, as the history of a text's beginning. Counts of single tokens and of pairs of
neighbours are quantised to levels 1 + floor(log_BASE(count / least)), least being 1 for
tokens and 2 for pairs (pairs seen once are left to the smoothing). A filter of
bits holds each n-gram once for every level up to its own, under HASHES hash functions a
level: it is asked for level after level until one is missing, and the last one found
stands for the mean count of its level. A text's score is the sum over its tokens of

    log10 P(w | h),  P(w | h) = (c(hw) + MU * P(w)) / (c(h) + MU),  P(w) = (c(w) + 1) / (N + V + 1)

with c from the filter, c(hw) at most c(h), N training tokens and V distinct ones.

The n-grams are dealt to blocks by their hash, as many as the corpus has need of
(CHARS_A_BLOCK of text each); tasks send counts summed over runs of 4 million n-grams,
packed by block, and a block's task sums them and sets its part of the filter. Every block
has room for all levels of all its n-grams, however large the corpus. A filter of up to
MAX_BYTES is broadcast. A larger one, or one of a corpus that may need a larger one, is never
sent: texts are packed in runs, the n-grams of a run, each once, go to their blocks with their
counts, and the task of a block, which counts them and sets the bits, asks these once for every n-gram
and answers each run with the levels of its n-grams, which then meet the run's texts. So one
shuffle of n-grams serves to learn and to ask. Both ways ask the same bits, so scores agree.

Exact counts for ``base_score`` and ``n_known`` do not pass through the filter: with a
broadcast filter the HOT most frequent words are broadcast too (a word beyond them holds at most
1 / HOT of all tokens, so none is hot) and all others joined by their hash; else they are part
of a block's answers.

Defined results: null and empty texts have the end as their only token; a null doc_id is
not held out and learns; repeated rows learn and are scored each; without training rows
N and V are 0; words are known by 64 bits of hash; very long texts are scored whole; empty
tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesplit as bs
from .common import Scratch, table

FOLDS, FOLD = 7, 2
BASE, HASHES, MU = 1.5, 8, 100.0
#: Least counts that the filter holds, for single tokens and for pairs.
LEAST = (1, 2)
LEVELS = 100
MAX_BYTES = 64 << 20
CHARS_A_BLOCK = 1 << 24
#: A corpus with more characters than this for each byte of a broadcast filter is not tried with one.
CHARS_A_BYTE = 2
#: Bytes of texts whose n-grams are asked together.
RUN_BYTES = 1 << 23
RUN = 1 << 22
HOT = 1 << 18
#: A block's bits are numbered by 32 bits of hash; one of CHARS_A_BLOCK of text needs a few hundredths.
ANY_BITS = (1 << 32) - 8
END = np.uint64(0x9D3F5A1C7B2E6481)
_PAIR = bs.seeds(2, 51) | np.uint64(1)
_PROBE = bs.seeds(LEVELS + 1, 52)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, ends included, and where each text's begin: one more entry than texts."""
    words, bounds = bs.split(texts)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def pairs(t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its history, and the hash of both."""
    history = np.concatenate(([END], t[:-1])) if len(t) else t
    history[starts[:-1]] = END
    return history, bs.mix(history * _PAIR[0] + bs.mix(t) * _PAIR[1])


def levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    """Levels of exact counts; 0 below the least."""
    out = np.floor(np.log(np.maximum(counts, least) / least) / math.log(BASE) + 1e-9).astype(np.int64) + 1
    return np.where(counts >= least, np.minimum(out, LEVELS), 0)


def _means(least: int) -> np.ndarray:
    """By level the mean of the whole numbers that it holds; 0 for level 0."""
    edges = np.ceil(least * BASE ** np.arange(LEVELS + 1.0) - 1e-9)
    return np.concatenate(([0.0], (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2))


_MEANS = {least: _means(least) for least in LEAST}


def count_of(levels: np.ndarray, least: int) -> np.ndarray:
    """The mean count of each level."""
    return _MEANS[least][levels]


def _summed(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their counts."""
    if n is None:
        u, c = np.unique(h, return_counts=True)
        return u, c.astype(np.int64)
    if not len(h):
        return h, n
    by = np.argsort(h, kind="stable")
    h = h[by]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n[by], first)


@dataclass
class Filter:
    """The bits of all blocks one after the other, where each begins, its number of bits and its lowest level."""

    data: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    floors: np.ndarray
    shift: int

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level found of each n-gram, asked from the lowest on; 0 where that is missing."""
        block = (h >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(h), np.int64)
        starts, bits, floors = self.starts[block], self.bits[block].astype(np.uint64), self.floors[block]
        out, left = np.zeros(len(h), np.int64), np.flatnonzero(bits > 0)
        for step in range(LEVELS):
            left = left[floors[left] + step <= LEVELS]
            first, stride = probes(h[left], floors[left] + step)
            for k in range(HASHES):
                at = places(first, stride, bits[left], k)
                hit = (self.data[starts[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
                left, first, stride = left[hit], first[hit], stride[hit]
            if not len(left):
                break
            out[left] = floors[left] + step
        return out


def probes(h: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a hash of an n-gram and level, from which all hash functions follow."""
    g = bs.mix(h ^ _PROBE[level])
    return g >> np.uint64(32), g & np.uint64(0xFFFFFFFF) | np.uint64(1)


def places(first: np.ndarray, stride: np.ndarray, bits: np.ndarray | np.uint64, k: int) -> np.ndarray:
    """The bit of a block under hash function k."""
    return (((first + np.uint64(k) * stride & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)).astype(np.int64)


def filter_block(parts: list[tuple[np.ndarray, np.ndarray]], most_bits: int = ANY_BITS) -> tuple[bytes, int, int]:
    """(bits, number of bits, lowest level) of n-grams given as (hashes, levels).

    The lowest level is 1 unless a caller asks for fewer bits than all levels need; ``learn`` never does.
    """
    h, top = (np.concatenate(x) for x in zip(*parts, strict=True))
    h, top = h[top > 0], top[top > 0]
    floor, need = 1, lambda f: math.ceil(HASHES * int(np.maximum(top - f + 1, 0).sum()) / math.log(2))
    while floor < LEVELS and need(floor) > most_bits:
        floor += 1
    bits = min(most_bits, max(64, need(floor) + 7 & ~7))
    data = np.zeros(bits, bool)
    for level in range(floor, int(top.max(initial=0)) + 1):
        first, stride = probes(h[top >= level], level)
        for k in range(HASHES):
            data[places(first, stride, np.uint64(bits), k)] = True
    return np.packbits(data, bitorder="little").tobytes(), bits, floor


def counted(docs: DataFrame, log_blocks: int) -> DataFrame:
    """(block, size, hashes, counts): n-grams of ``size`` tokens, packed by block, counted over runs of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for size, parts in held.items():
                if not parts:
                    continue
                h, c = _summed(np.concatenate(parts))
                parts.clear()
                block = (h >> np.uint64(64 - log_blocks)).astype(np.int64) if log_blocks else np.zeros(len(h), np.int64)
                ends = np.flatnonzero(np.concatenate((block[1:] != block[:-1], [True]))) + 1
                begins = np.concatenate(([0], ends[:-1]))
                raw = [pa.array([x[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]) for x in (h, c.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(block[begins]), pa.array(np.full(len(ends), size, np.int32)), *raw], ["block", "size", "hashes", "counts"])

        for batch in batches:
            for _, texts in bs.pieces(batch.column(0)):
                t, starts = tokens(texts)
                held[1].append(t)
                held[2].append(pairs(t, starts)[1])
                n += 2 * len(t)
                if n >= RUN:
                    yield from flush()
                    n = 0
        yield from flush()
        bs.trim()

    return docs.select("text").mapInArrow(run, "block long, size int, hashes binary, counts binary")


def probability(c: np.ndarray, before: np.ndarray, two: np.ndarray, train_tokens: int, distinct: int) -> np.ndarray:
    """Of tokens by their counts, those of their histories, and those of both."""
    p = (c + 1) / (train_tokens + distinct + 1)
    return (two + MU * p) / (before + MU)


@dataclass
class Model:
    """``filter`` is None where it is too large to be broadcast."""

    filter: Filter | None
    train_tokens: int
    distinct: int
    hot: np.ndarray
    hot_counts: np.ndarray

    def score(self, texts: list[bytes]) -> dict[str, list | np.ndarray]:
        """By text all that ``score`` sends on."""
        levels = self.filter.levels
        t, starts = tokens(texts)
        word, back = np.unique(t, return_inverse=True)
        one = count_of(levels(word), LEAST[0])
        history, pair = pairs(t, starts)
        c, before = one[back], one[np.searchsorted(word, history)]
        seen = np.flatnonzero((c > 0) & (before > 0))
        two = np.zeros(len(t))
        pair, which = np.unique(pair[seen], return_inverse=True)  # in the order of blocks, so that probes stay close
        two[seen] = np.minimum(count_of(levels(pair), LEAST[1])[which], before[seen])
        p = probability(c, before, two, self.train_tokens, self.distinct)
        at = np.minimum(np.searchsorted(self.hot, word), max(0, len(self.hot) - 1))
        hot = self.hot[at] == word if len(self.hot) else np.zeros(len(word), bool)
        exact = np.where(hot, self.hot_counts[at] if len(self.hot) else 0, 0)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        rest = np.flatnonzero(~hot[back])
        cell, n = np.unique(doc[rest] * len(word) + back[rest], return_counts=True)
        ends = np.searchsorted(cell, np.arange(len(texts) + 1) * len(word)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
        return {
            "n_tokens": np.diff(starts), "n_hot": np.add.reduceat((exact > 0)[back].astype(np.int64), starts[:-1]), "hot_sum": np.add.reduceat(np.log10(exact + 1.0)[back], starts[:-1]),
            "score": np.add.reduceat(np.log10(p), starts[:-1]), "words": lists(word[cell % len(word)].view(np.int64)), "times": lists(n.astype(np.int64)),
        }


def chars_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.length("text"))).first()[0] or 0


def blocks_for(chars: int) -> int:
    """The binary logarithm of the number of blocks of a corpus."""
    return max(4, math.ceil(math.log2(max(1, chars / CHARS_A_BLOCK))))


def learn(docs: DataFrame, scratch: Scratch, max_bytes: int = MAX_BYTES, hot: int = HOT) -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the exact counts (word, c) of all tokens by hash."""
    log_blocks = blocks_for(chars_of(docs))

    def build(t: pa.Table) -> pa.Table:
        size = np.asarray(t["size"])
        out, own = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for k, least in enumerate(LEAST):
            raw = [[x for x, s in zip(t[c].to_pylist(), size, strict=True) if s == k + 1] for c in ("hashes", "counts")]
            h, n = _summed(np.frombuffer(b"".join(raw[0]), np.uint64), np.frombuffer(b"".join(raw[1]), np.uint32).astype(np.int64))
            own = own if k else (h, n)
            out.append((h, levels_of(n, least)))
        data, bits, floor = filter_block(out)
        arrays = [pa.array([t["block"][0].as_py()], pa.int64()), pa.array([data]), pa.array([bits], pa.int64()), pa.array([floor], pa.int32())]
        lists = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in own]
        return pa.Table.from_arrays([*arrays, *lists], ["block", "data", "bits", "floor", "words", "counts"])

    t = counted(docs, log_blocks).groupBy("block").applyInArrow(build, "block long, data binary, bits long, floor int, words array<long>, counts array<long>")
    t = scratch.keep(t)
    words = t.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    totals = words.agg(F.sum("c"), F.count("*")).first()
    size = t.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = t.select("block", "data", "bits", "floor").collect() if size <= max_bytes else []
    n = 1 << log_blocks
    bits, floors, starts, parts, at = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64), [], 0
    for r in blocks:
        bits[r.block], floors[r.block], starts[r.block] = r.bits, r.floor, at
        parts.append(np.frombuffer(r.data, np.uint8))
        at += len(r.data)
    top = words.orderBy(F.desc("c"), "word").limit(hot).toArrow()
    at_hot = top["word"].to_numpy().view(np.uint64)
    by = np.argsort(at_hot)
    data = np.concatenate(parts) if parts else np.zeros(1, np.uint8)
    held = Filter(data, starts, bits, floors, 64 - log_blocks) if size <= max_bytes else None
    return Model(held, totals[0] or 0, totals[1], at_hot[by], top["c"].to_numpy()[by]), words


NAMES = ["n_tokens", "n_hot", "hot_sum", "score", "words", "times"]


def scored(model: Model, key: int, ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    """The rows of a piece of texts, with keys from ``key`` on."""
    found = model.score(texts)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(texts))), ids, *(found[c] if isinstance(found[c], pa.Array) else pa.array(found[c]) for c in NAMES)], ["key", "doc_id", *NAMES])


def narrow(x: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each stretch of whole numbers in as few bytes a number as its largest has need of, told by a first byte."""
    raw, out = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8), []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        width = max(1, int(x[a:b].max()).bit_length() + 7 >> 3) if b > a else 0
        out.append(bytes([width]) + raw[a:b, :width].tobytes() if width else b"")
    return out


def wide(stretch: bytes) -> np.ndarray:
    """The numbers of a stretch from ``narrow``."""
    if not stretch:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(stretch, np.uint8, offset=1).reshape(-1, stretch[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : stretch[0]] = raw
    return out.view("<u8").ravel()


def in_runs(docs: DataFrame) -> DataFrame:
    """(run, held, ids, sizes, data): texts packed in runs of about RUN_BYTES, those held out apart from the others."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        own: dict[bool, tuple[list[pa.Array], list[bytes]]] = {False: ([], []), True: ([], [])}
        size = {False: 0, True: 0}

        def flush(held: bool) -> pa.RecordBatch:
            ids, texts = own[held]
            ids, sizes = pa.concat_arrays(ids), pa.array(np.fromiter(map(len, texts), np.int32, len(texts)))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), x) for x in (ids, sizes)]
            data = pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())
            own[held], size[held] = ([], []), 0
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([held]), *lists, data], ["run", "held", "ids", "sizes", "data"])

        for batch in batches:
            flags = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for first, texts in bs.pieces(batch.column(2)):
                for held in (False, True):
                    at = np.flatnonzero(flags[first : first + len(texts)] == held)
                    if not len(at):
                        continue
                    own[held][0].append(batch.column(0).take(pa.array(at + first)))
                    own[held][1].extend(texts[k] for k in at)
                    size[held] += sum(len(texts[k]) + 1 for k in at)
                    if size[held] >= RUN_BYTES:
                        yield flush(held)
                        key += 1
        for held in (False, True):
            if own[held][1]:
                yield flush(held)
                key += 1
        bs.trim()

    return docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, f"run long, held boolean, ids array<{kind}>, sizes array<int>, data binary")


def run_tokens(sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``tokens`` gives, of a run, made piece by piece."""
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int32)))
    raw = pa.decompress(data, int(ends[-1]), "zstd") if ends[-1] else pa.py_buffer(b"")
    column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), raw])
    parts = [tokens(texts) for _, texts in bs.pieces(column)]
    before = np.cumsum([0, *(len(t) for t, _ in parts)])
    starts = [s[:-1] + n for (_, s), n in zip(parts, before[:-1], strict=True)]
    return np.concatenate([t for t, _ in parts]), np.concatenate([*starts, before[-1:]])


def asked(runs: DataFrame, log_blocks: int) -> DataFrame:
    """(block, run, words, word_counts, pairs, pair_counts): the n-grams of each run, each once, dealt to blocks; no counts of those held out."""
    edges = np.arange(1 << log_blocks, dtype=np.uint64) << np.uint64(64 - log_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t, starts = run_tokens(np.asarray(batch.column(2)[k].values), batch.column(3)[k].as_py())
                packed, some = [], np.zeros(len(edges), bool)
                for x in (t, pairs(t, starts)[1]):
                    h, c = np.unique(x, return_counts=True)
                    begins = np.searchsorted(h, edges)
                    ends = np.append(begins[1:], len(h))
                    full = ends > begins
                    steps = np.diff(h, prepend=np.uint64(0))
                    steps[begins[full]] = h[begins[full]] - edges[full]
                    some |= full
                    packed.append((steps, c, begins, ends))
                block = np.flatnonzero(some)
                held = batch.column(1)[k].as_py()
                raw = [pa.array(narrow(y, begins[block], ends[block]) if y is not None else [b""] * len(block), pa.binary()) for steps, c, begins, ends in packed for y in (steps, None if held else c)]
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.full(len(block), batch.column(0)[k].as_py())), *raw], ["block", "run", "words", "word_counts", "pairs", "pair_counts"])
        bs.trim()

    return runs.select("run", "held", "sizes", "data").mapInArrow(run, "block long, run long, words binary, word_counts binary, pairs binary, pair_counts binary")


def by_answers(docs: DataFrame, log_blocks: int, scratch: Scratch) -> DataFrame:
    """Scores where no filter is sent: each block's task counts its n-grams, sets its bits, asks them once for every n-gram and answers the runs.

    The answers, levels and the words' exact counts, meet the texts of their run.
    """
    kind, shift = docs.schema["doc_id"].dataType.simpleString(), np.uint64(64 - log_blocks)

    def answer(t: pa.Table) -> pa.Table:
        block, n_runs = t["block"][0].as_py(), t.num_rows
        grams = []
        for names, least in zip((("words", "word_counts"), ("pairs", "pair_counts")), LEAST, strict=True):
            steps, counts = ([wide(x) for x in t[c].to_pylist()] for c in names)
            h = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps]) + (np.uint64(block) << shift)
            c = np.concatenate([y if len(y) else np.zeros(len(x), np.uint64) for x, y in zip(steps, counts, strict=True)]).astype(np.int64)
            ends = np.cumsum([len(x) for x in steps])
            by = np.argsort(h, kind="stable")
            s = h[by]
            new = np.concatenate(([True], s[1:] != s[:-1]))[: len(s)]
            which = np.empty(len(s), np.int64)
            which[by] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            total = np.add.reduceat(c[by], first) if len(first) else np.zeros(0, np.int64)
            grams.append((s[first], total, which, np.concatenate(([0], ends[:-1])), ends, levels_of(total, least)))
        data, bits, floor = filter_block([(h, level) for h, *_, level in grams])
        own = Filter(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([bits]), np.array([floor]), 64)
        out = []
        for k, (h, total, which, begins, ends, _) in enumerate(grams):
            level = own.levels(h).astype(np.uint8)[which]
            out.append([level[a:b].tobytes() for a, b in zip(begins, ends, strict=True)])
            if not k:
                out.append(narrow(total[which], begins, ends))
        total = grams[0][1]
        n, v = np.zeros((2, n_runs), np.int64)  # the block's own, once
        n[0], v[0] = total.sum(), (total > 0).sum()
        return pa.table([t["run"], t["block"], *(pa.array(x, pa.binary()) for x in out), pa.array(n), pa.array(v)], ["run", "block", "levels", "counts", "pairs", "n", "v"])

    runs = scratch.keep(in_runs(docs))
    answers = scratch.keep(asked(runs, log_blocks).groupBy("block").applyInArrow(answer, "run long, block long, levels binary, counts binary, pairs binary, n long, v long"))
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("block")
        one, two = (np.frombuffer(b"".join(answers[c].to_pylist()), np.uint8) for c in ("levels", "pairs"))
        exact = np.concatenate([wide(x) for x in answers["counts"].to_pylist()]).astype(np.int64)
        t, starts = run_tokens(np.asarray(own["sizes"][0].values), own["data"][0].as_py())
        pair = np.unique(pairs(t, starts)[1], return_inverse=True)[1]
        two = count_of(two, LEAST[1])[pair]
        word, back = np.unique(t, return_inverse=True)
        one = count_of(one, LEAST[0])
        c = one[back]
        before = np.concatenate(([0.0], c[:-1]))
        before[starts[:-1]] = one[np.searchsorted(word, END)]
        two = np.where((c > 0) & (before > 0), np.minimum(two, before), 0.0)
        sums = lambda x: np.add.reduceat(x, starts[:-1])
        score = sums(np.log10(probability(c, before, two, n, v)))
        n_tokens = np.diff(starts)
        base = sums(np.log10(exact + 1.0)[back]) - n_tokens * math.log10(n + v + 1)
        columns = [own["ids"].combine_chunks().flatten(), pa.array(n_tokens), pa.array(sums((exact > 0)[back].astype(np.int64))), pa.array(base), pa.array(score)]
        return pa.table(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    t = runs.select("run", "ids", "sizes", "data").groupBy("run").cogroup(answers.select("run", "block", "levels", "counts", "pairs").groupBy("run"))
    t = scratch.keep(t.applyInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"))
    scratch.drop(runs, answers)
    return t.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: Model, words: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in bs.pieces(batch.column(1)):
                yield scored(sent.value, key, batch.column(0).slice(first, len(texts)), texts)
                key += len(texts)
        bs.trim()

    t = docs.select("doc_id", "text").mapInArrow(run, f"key long, doc_id {kind}, n_tokens long, n_hot long, hot_sum double, score double, words array<long>, times array<long>")
    t = scratch.keep(t)
    sent.unpersist()
    rest = t.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    rest = rest.join(words, "word").groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rest_sum"), F.sum("n").alias("n_rest"))
    t = t.drop("words", "times").join(rest, "key", "left")
    base = F.col("hot_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.train_tokens + model.distinct + 1)
    known = (F.col("n_hot") + F.coalesce("n_rest", F.lit(0))).cast("long")
    return t.select("doc_id", held_out().alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def lm_scores(docs: DataFrame, max_bytes: int = MAX_BYTES, hot: int = HOT) -> DataFrame:
    """Scores of all rows under the model of those outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "lm")
    train = docs.where(~held_out())
    chars = chars_of(train)
    if chars <= CHARS_A_BYTE * max_bytes:
        model, words = learn(train, scratch, max_bytes, hot)
        if model.filter is not None:
            return score(docs, model, words, scratch)
    return by_answers(docs, blocks_for(chars), scratch)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
