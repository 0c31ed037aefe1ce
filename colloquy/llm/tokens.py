"""Operator 10, token ids in Re-Pair compressed shards.

Documents are dealt to ranges of doc_id and sorted, each range is tokenized and cut
into shards of about SHARD_TOKENS ids, and each shard is compressed by its own Re-Pair
grammar: in every round the most frequent pairs of neighbouring symbols become
nonterminals, until no pair has LEAST_USES uses left, below which a rule takes more room
than it saves. A shard is one row of a Parquet table:

    part, shard       order of the shards; documents ascend through both
    doc_id            array of the documents' ids
    n_tokens          array of how many ids each document has, with its end id
    n_symbols         array of how many symbols of ``sequence`` each document has
    rules             little-endian unsigned 32-bit pairs (left, right); rule k is
                      symbol FIRST_RULE + k and refers to smaller symbols only
    lengths           unsigned 32-bit, ids that each rule expands to
    sequence          unsigned 32-bit symbols of all documents
    doc_shard, doc_part   of a text of more than LONG_TEXT bytes, which is cut at blanks into
                      shards of its own: the first of them, and the number of this one

Pairs never cross a document's end, so one document is decoded from its own symbols
(``decode_document``). Spark's commit protocol writes the table, so lost or repeated
tasks leave no half shards.

Tokenizers work on runs of characters between blanks independently, so the ids of a
run are computed once and remembered, under 64 bits of hash, up to MEMO runs a worker.

Defined results: null text is empty and has the end id alone; null doc_ids come first;
repeated rows are written repeatedly, rows with one doc_id in the order of their text's
hash; a long text is compressed in parts, each with a grammar of its own, so it costs no
more memory than others (a run of a long text without any blank is one part); an empty table gives no shards; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesplit as bs
from .common import Scratch, table

END_ID = 1
FIRST_RULE = 1 << 20
SHARD_TOKENS = 1 << 19
#: A rule of fewer uses takes more room than it saves.
LEAST_USES = 4
#: Rules of the first round, and hash buckets in which pairs are counted first.
RULES, BUCKET_BITS = 1024, 18
BUCKETS = 1 << BUCKET_BITS
MEMO = 2_400_000
#: Bytes of a text that is cut into several shards, each of about PART_BYTES.
LONG_TEXT, PART_BYTES = 1 << 22, 1 << 20

_SHARD = "part int, shard int, doc_id array<long>, n_tokens array<int>, n_symbols array<int>, rules binary, lengths binary, sequence binary, doc_shard int, doc_part int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... counts[k] long, for all k in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Memo:
    """Ids of runs between blanks, under the runs' 64-bit hashes in an open table.

    ``keys`` and ``place`` are the table; run number k has ``counts[k]`` ids in ``flat``
    from ``starts[k]``. Everything is arrays, so a batch is looked up at once, and only
    runs that are new are ever made strings.
    """

    #: At most 6 of 10 slots are used; a piece with more new runs gets a larger table.
    SLOTS = 1 << 22
    #: A character that is one token by itself parts new runs in a call of the tokenizer.
    MARKS = "~^`★●§"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core; threads of its own would only wait on each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        ids = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in self.MARKS}
        self.mark, self.mark_id = next((m, i[0]) for m, i in ids.items() if len(i) == 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.flat, self.n_flat, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of runs; -1 for new ones."""
        top = len(self.keys) - 1
        slot = (h & np.uint64(top)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.place[slot], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & top
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.place[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def put(self, h: np.ndarray) -> None:
        """Numbers distinct new runs from n on."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        size = len(self.keys)
        while 10 * (self.n + len(h)) > 6 * size:
            size *= 2
        if size > len(self.keys):
            held = self.keys != 0
            h, number = np.concatenate((self.keys[held], h)), np.concatenate((self.place[held], number))
            self.keys, self.place = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        slot = (h & np.uint64(size - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.place[slot[won]] = h[won], number[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, number, slot = h[rest], number[rest], (slot[rest] + 1) & (size - 1)

    def learn(self, h: np.ndarray, runs: list[str]) -> None:
        """Tokenizes new runs, many in one text with a mark before each; runs that hold the mark go alone."""
        odd = np.fromiter((self.mark in r for r in runs), bool, len(runs))
        h = np.concatenate((h[~odd], h[odd]))
        alone = [r for r, o in zip(runs, odd, strict=True) if o] if odd.any() else []
        runs = [r for r in runs if self.mark not in r] if alone else runs
        texts = [" ".join(f"{self.mark} {r}" for r in runs[k : k + 256]) for k in range(0, len(runs), 256)]
        made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(made) if made else np.zeros(0, np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        counts = np.diff(np.append(marks, len(ids))) - 1
        lone = [np.array(self.tokenizer.encode(r, add_special_tokens=False).ids, np.uint32) for r in alone]
        ids = np.concatenate((ids[ids != self.mark_id], *lone))
        counts = np.concatenate((counts, np.array([len(x) for x in lone], np.int64)))
        total, k = len(ids), len(counts)
        while self.n + k > len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
        while self.n_flat + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.n_flat : self.n_flat + total] = ids
        self.starts[self.n : self.n + k] = self.n_flat + np.cumsum(counts) - counts
        self.counts[self.n : self.n + k] = counts
        self.put(h)
        self.n, self.n_flat = self.n + k, self.n_flat + total

    def encode(self, texts: list[bytes], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text's ended by END_ID unless ``end`` is false, and their counts."""
        if self.n > MEMO:
            self.clear()
        h, bounds, buf, begins, ends = bs.split(texts, lower=False, spans=True)
        h[h == 0] = 1
        runs = self.find(h)
        new = np.flatnonzero(runs < 0)
        if len(new):
            own, first = np.unique(h[new], return_index=True)
            at = new[first]
            raw = buf.tobytes()
            self.learn(own, [raw[a:b].decode() for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)])
            runs[new] = self.find(h[new])
        counts = self.counts[runs]
        ids = self.flat[ragged(self.starts[runs], counts)]
        upto = np.concatenate(([0], np.cumsum(counts)))
        stops = upto[bounds]
        if not end:
            return ids, np.diff(stops)
        return np.insert(ids, stops[1:], END_ID), np.diff(stops) + 1


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_memos: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _memos:
        _memos[path] = Memo(path)
    return _memos[path]


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A bucket of BUCKETS for each pair of symbols (unsigned 32-bit, which multiply fastest)."""
    return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKET_BITS)


def _alone(at: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Of pairs at ascending places, those that keep apart from pairs of the same rule: every second one of a row."""
    same = (np.diff(at) == 1) & (rule[1:] == rule[:-1])
    place = np.arange(len(at))
    run = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), place, 0))
    return (place - run) % 2 == 0


def _apart(at: np.ndarray, rule: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which of the open pairs at ascending places to replace, no two that overlap.

    A pair goes before an overlapping one of a later rule, so the same passage is paired in
    the same way wherever it stands.
    """
    take = np.zeros(len(at), bool)
    left = np.arange(len(at))[open_]
    for _ in range(3):
        where, r = at[left], rule[left]
        touch = np.diff(where) == 1
        beats = r[:-1] < r[1:]
        lost = np.zeros(len(left), bool)
        lost[1:] |= touch & beats
        lost[:-1] |= touch & ~beats
        won = ~lost
        take[left[won]] = True
        by = np.zeros(len(left), bool)
        by[1:] |= touch & won[:-1]
        by[:-1] |= touch & won[1:]
        left = left[lost & ~by]
        if not len(left):
            break
    return take


def _replaced(seq: np.ndarray, open_: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """New rules, the places of their uses with their numbers, and whether pairs of fewer uses were looked at too.

    ``open_``: whether the pair that begins at a place may be frequent; closed here where it
    is not. At most ``most`` of the most frequent pairs become rules, those with LEAST_USES
    that do not overlap.
    """
    at = np.flatnonzero(open_)
    bucket = _bucket(seq[at], seq[at + 1])
    n = np.bincount(bucket, minlength=BUCKETS)
    floor = max(LEAST_USES, int(np.partition(n, -2 * most)[-2 * most])) if 2 * most < BUCKETS else LEAST_USES
    uses = n[bucket]
    open_[at[uses < LEAST_USES]] = False
    often = np.flatnonzero(uses >= floor)
    none = np.zeros(0, np.int64)
    often, bucket = at[often], bucket[often]
    pairs = (seq[often].astype(np.int64) << 32) | seq[often + 1]
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else none
    pair, uses = ordered[first], np.diff(np.append(first, len(ordered)))
    best = np.argsort(-uses, kind="stable")[:most]
    best = pair[best[uses[best] >= LEAST_USES]]
    if not len(best):
        return none, none, none, floor == LEAST_USES
    # one rule a bucket in a round; the most frequent of its pairs
    table = np.full(BUCKETS, -1, np.int32)
    table[_bucket((best >> 32).astype(np.uint32), (best & 0xFFFFFFFF).astype(np.uint32))[::-1]] = np.arange(len(best))[::-1]
    rule = table[bucket]
    hit = np.flatnonzero(rule >= 0)
    hit = hit[best[rule[hit]] == pairs[hit]]
    at, rule = often[hit], rule[hit]
    alone = _alone(at, rule)
    take = _apart(at, rule, alone)
    used = np.bincount(rule[take], minlength=len(best)) >= LEAST_USES
    if not used.any():
        # all overlap with others: the first that has uses enough alone
        enough = np.flatnonzero(np.bincount(rule[alone], minlength=len(best)) >= LEAST_USES)[:1]
        if not len(enough):
            return none, none, none, floor == LEAST_USES
        take = alone & (rule == enough[0])
        used = np.arange(len(best)) == enough[0]
    take &= used[rule]
    return best[used], at[take], (np.cumsum(used) - 1)[rule[take]], floor == LEAST_USES


def compress(ids: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds, until no pair has LEAST_USES: rules, their expansion lengths, the sequence, symbols by document.

    Rounds begin with RULES of the most frequent pairs and take twice as many each time, as
    the pairs that are left differ less and less in frequency.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(n_tokens) - 1] = True
    rules, lengths, most = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), RULES
    # a pair of too few uses can't gain any: only pairs with a new symbol are looked at again
    open_ = ~last
    open_[:-1] &= ~last[1:]
    while True:
        new, at, rule, all_seen = _replaced(seq, open_, most)
        most = min(2 * most, BUCKETS)
        if not len(new):
            if all_seen:
                break
            continue
        new = np.stack((new >> 32, new & 0xFFFFFFFF), axis=1)
        size = np.ones(new.shape, np.int64)
        size[new >= FIRST_RULE] = lengths[new[new >= FIRST_RULE] - FIRST_RULE]
        seq[at] = FIRST_RULE + len(rules) + rule
        rules, lengths = np.concatenate((rules, new)), np.concatenate((lengths, size.sum(axis=1)))
        open_[at] = ~last[at + 2]
        before = at[at > 0] - 1
        open_[before] = ~last[before]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last, open_ = seq[stay], last[stay], open_[stay]
    return rules, lengths, seq.astype(np.int64), np.diff(np.concatenate(([-1], np.flatnonzero(last))))


def expand(rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: rules are written out first, those of known parts together."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.zeros(starts[-1], np.uint32)
    known = np.zeros(len(rules), bool)
    rest = np.arange(len(rules))
    while len(rest):
        parts = rules[rest]
        is_rule = parts >= FIRST_RULE
        of = np.where(is_rule, parts - FIRST_RULE, 0)
        ready = (known[of] | ~is_rule).all(axis=1)
        own, parts, is_rule, of = rest[ready], parts[ready], is_rule[ready], of[ready]
        at = starts[own]
        for side in (0, 1):
            plain = ~is_rule[:, side]
            flat[at[plain]] = parts[plain, side]
            a, n, to = starts[of[~plain, side]], lengths[of[~plain, side]], at[~plain]
            flat[ragged(to, n)] = flat[ragged(a, n)]
            at = at + np.where(plain, 1, lengths[of[:, side]])
        known[own] = True
        rest = rest[~ready]
    if not len(lengths):
        return seq.astype(np.uint32)
    pool = np.concatenate((flat, seq[seq < FIRST_RULE].astype(np.uint32)))
    is_rule = seq >= FIRST_RULE
    k = np.where(is_rule, seq - FIRST_RULE, 0)
    own = len(flat) + np.cumsum(~is_rule) - 1
    return pool[ragged(np.where(is_rule, starts[k], own), np.where(is_rule, lengths[k], 1))]


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART_BYTES, cut after blanks."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PART_BYTES)
        end = blank.end() if blank else len(text)
        yield text[at:end]
        at = end


def _shards(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = memo(tokenizer), TaskContext.get().partitionId(), 0
        names = ["part", "shard", "doc_id", "n_tokens", "n_symbols", "rules", "lengths", "sequence", "doc_shard", "doc_part"]

        def made(held, doc_shard=None, doc_part=None):
            ids, counts = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            rules, lengths, seq, symbols = compress(ids, counts)
            row = [part, shard, [i for h in held for i in h[0]], counts.tolist(), symbols.tolist(), *(x.astype("<u4").tobytes() for x in (rules, lengths, seq)), doc_shard, doc_part]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        held, size = [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in bs.pieces(batch.column(1)):
                if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
                    if held:
                        yield made(held)
                        held, size, shard = [], 0, shard + 1
                    begin, done = shard, 0
                    for text in _parts(texts[0]):
                        done += len(text)
                        ids, counts = encoder.encode([text], done == len(texts[0]))
                        if len(ids):  # blanks alone have no ids
                            yield made([([doc_ids[first]], ids, counts)], begin, shard - begin)
                            shard += 1
                    continue
                ids, counts = encoder.encode(texts)
                held.append((doc_ids[first : first + len(texts)], ids, counts))
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield made(held)
                    held, size, shard = [], 0, shard + 1
        if held:
            yield made(held)
        bs.trim()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the shards of documents (doc_id, text) to a folder."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ("doc_id", F.xxhash64("text"))
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t.mapInArrow(_shards(tokenizer or default_tokenizer()), _SHARD).write.option("compression", "zstd").parquet(path)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rules, lengths, seq = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("rules", "lengths", "sequence"))
    return rules.reshape(-1, 2), lengths, seq


def decode_document(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, from its own symbols."""
    rules, lengths, seq = _opened(row)
    first = sum(row["n_symbols"][:k])
    return expand(rules, lengths, seq[first : first + row["n_symbols"][k]])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = expand(*_opened(row)).astype("<u4")
            n = np.array(row["n_tokens"], np.int64)
            ends = np.cumsum(n)
            view = memoryview(ids)
            crc = [zlib.crc32(view[b - c : b]) for b, c in zip(ends.tolist(), n.tolist(), strict=True)]
            ids_of = pa.array(row["doc_id"], pa.int64())
            at = [pa.array([row[c]] * len(n), pa.int32()) for c in ("part", "shard")]
            yield pa.RecordBatch.from_arrays([*at, ids_of, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"])


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, the highest bit being the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, n: int) -> int:
    """The crc32 of two stretches of bytes in a row from their own, the second being of n bytes."""
    factor, power = 1 << 31, 1 << 23  # 1, and x^8
    while n:
        if n & 1:
            factor = _times(factor, power)
        power, n = _times(power, power), n >> 1
    return _times(factor, first) ^ second


def _whole(t: pa.Table) -> pa.Table:
    """One row of the parts of a long text."""
    rows = sorted(t.to_pylist(), key=lambda r: r["shard"])
    crc, n = 0, 0
    for r in rows:
        crc, n = joined_crc(crc, r["ids_crc32"], 4 * r["n_tokens"]), n + r["n_tokens"]
    return pa.Table.from_pylist([{**rows[0], "n_tokens": n, "ids_crc32": crc}], schema=t.schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a folder of shards.

    Starts are running sums of ids: over the parts (one row a written partition), over
    the shards within a part, and within the shard.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    row = "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long"
    docs = shards.where("doc_part is null").drop("doc_shard", "doc_part").mapInArrow(_decoded, row)
    long = shards.where("doc_part is not null")
    firsts = long.select("part", "shard", "doc_shard")
    long = long.mapInArrow(_decoded, row).join(firsts, ["part", "shard"]).select("part", "doc_shard", "shard", "doc_id", "local", "n_tokens", "ids_crc32")
    long = long.groupBy("part", "doc_shard").applyInArrow(_whole, f"part int, doc_shard int, {row.removeprefix('part int, ')}").drop("doc_shard")
    docs = docs.unionByName(long)
    size = shards.select("part", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("size"))
    parts = size.groupBy("part").agg(F.sum("size").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("of_part"))
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = size.select("part", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("of_shard")).join(parts, "part")
    t = docs.join(offsets, ["part", "shard"])
    return t.select("doc_id", (F.col("of_part") + F.col("of_shard") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path()
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
