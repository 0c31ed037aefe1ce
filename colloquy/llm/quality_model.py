"""Operator 2, a factorisation machine that scores documents for quality.

Features of a whole text: its distinct words (A-Z lower-cased) hashed to BUCKETS, each
with value 1 / sqrt(number of distinct buckets), and statistics of structure (lengths, shares of character classes,
repetition) with the metadata n_chars, standardised. The machine adds to a linear model
all pairwise interactions through RANK factors a feature; by the identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]

a document is scored in time linear in its features.

Training takes the labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
TRAIN_ROWS of them, the first in the order of a hash (a documented bound: more rows do
not change the model much). Their features are made by the tasks that read the
documents; one task fits the model to these by Adagrad with balanced classes; only the
model (about 0.6 MB, whatever the corpus) passes through the driver.

Defined results: null text counts as empty and gets a score like any other; a null
n_chars counts as 0; a null doc_id is scored and not held out; without labels of both
classes every score is 0.5; repeated rows are scored each and train once, repeated labels
count once (the larger one); very long texts are scored whole; empty tables give no rows;
other columns, whatever their names, lang and source among them, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesplit as bs
from .common import ship, table

BUCKETS, RANK = 1 << 14, 8
TRAIN_ROWS, EPOCHS, BATCH, RATE, DECAY = 6000, 12, 64, 0.1, 1e-5
FOLDS = 5
THRESHOLD = 0.3

_CLASS = np.full(256, 5, np.uint8)  # 5: not ASCII
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!"]] = True
STATS = 14


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct hashed word, by document, and a row of statistics each."""
    words, bounds = bs.split(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    pairs = np.unique((doc << 14) | (words >> np.uint64(50)).astype(np.int64))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, n)
    at = np.concatenate(([0], np.cumsum(lens + 1)))
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[at])
    kind = _CLASS[buf]
    counts = np.stack([total(kind == k) for k in range(6)] + [total(_SYMBOL[buf]), total(buf == 10)], axis=1).astype(float)
    counts[:, [3, 7]] -= 1  # the line end between texts
    n_words = np.diff(bounds)
    same = np.concatenate((words[1:] == words[:-1], [False]))[: len(words)] if len(words) else np.zeros(0, bool)
    again = np.diff(np.concatenate(([0], np.cumsum(same)))[bounds])
    distinct = np.bincount(pairs >> 14, minlength=n)
    one = np.maximum(lens, 1)
    w = np.maximum(n_words, 1)
    stats = np.column_stack((np.sqrt(counts / one[:, None]), np.log1p(lens), np.log1p(n_words), lens / w / 10, distinct / w, again / w, np.log1p(n_chars)))
    return pairs >> 14, pairs & (BUCKETS - 1), stats


class Machine:
    """Weights, factors, and the mean and deviation of the statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.deviation = mean, deviation
        d = BUCKETS + STATS
        self.bias, self.w = 0.0, np.zeros(d)
        self.v = (bs.seeds(d * RANK, 41).reshape(d, RANK) / 2.0**64 - 0.5) * 0.1

    def rows(self, doc, bucket, stats, n):
        """The features of n documents as (document, feature, value), by document."""
        size = np.bincount(doc, minlength=n)
        x = 1 / np.sqrt(size[doc])
        z = np.clip((stats - self.mean) / self.deviation, -4, 4) / np.sqrt(STATS)
        docs = np.concatenate((doc, np.repeat(np.arange(n), STATS)))
        by = np.argsort(docs, kind="stable")
        features_ = np.concatenate((bucket, np.tile(np.arange(BUCKETS, BUCKETS + STATS), n)))[by]
        return docs[by], features_, np.concatenate((x, z.ravel()))[by]

    def margin(self, docs, features_, x):
        """Per document; each has features, so sums over its stretch are by reduceat."""
        starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        vx = self.v[features_] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        linear = np.add.reduceat(self.w[features_] * x, starts)
        return self.bias + linear + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1), sums, vx

    def fit(self, docs, features_, x, y):
        n = len(y)
        starts = np.append(np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))), len(docs))
        weight = np.where(y == 1, n / 2 / max(1, (y == 1).sum()), n / 2 / max(1, (y == 0).sum()))
        gw, gv, gb = np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8), 1e-8
        for epoch in range(EPOCHS):
            order = np.argsort(bs.seeds(n, 1000 + epoch))
            for k in range(0, n, BATCH):
                own = order[k : k + BATCH]
                at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
                doc = np.repeat(np.arange(len(own)), starts[own + 1] - starts[own])
                f, v = features_[at], x[at]
                m, sums, vx = self.margin(doc, f, v)
                g = (1 / (1 + np.exp(-m)) - y[own]) * weight[own] / len(own)
                gx = (g[doc] * v)[:, None]
                seen, back = np.unique(f, return_inverse=True)
                dw = np.bincount(back, gx[:, 0], len(seen)) + DECAY * self.w[seen]
                dv = np.stack([np.bincount(back, c, len(seen)) for c in (gx * (sums[doc] - vx)).T], axis=1) + DECAY * self.v[seen]
                gw[seen] += dw**2
                gv[seen] += dv**2
                gb += g.sum() ** 2
                self.w[seen] -= RATE * dw / np.sqrt(gw[seen])
                self.v[seen] -= RATE * dv / np.sqrt(gv[seen])
                self.bias -= RATE * g.sum() / np.sqrt(gb)

    def scores(self, texts: list[bytes], n_chars: np.ndarray) -> np.ndarray:
        doc, bucket, stats = features(texts, n_chars)
        return 1 / (1 + np.exp(-self.margin(*self.rows(doc, bucket, stats, len(texts)))[0]))


def _slim(docs: DataFrame, *more: str) -> DataFrame:
    """What the model reads; a table without n_chars has it null."""
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", n_chars.cast("double").alias("n_chars"), *more)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    n_chars = np.maximum(np.nan_to_num(np.array(batch.column(2).to_pylist(), float)), 0)
    for first, texts in bs.pieces(batch.column(1)):
        yield first, texts, n_chars[first : first + len(texts)]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents as features: bounded rows, whatever the texts' lengths."""
    for batch in batches:
        for first, texts, n_chars in _pieces(batch):
            doc, bucket, stats = features(texts, n_chars)
            ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(bucket)), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * STATS), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([*lists, *(batch.column(k).slice(first, len(texts)) for k in (3, 4))], ["buckets", "stats", "y", "key"])
    bs.trim()


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [r for batch in batches for r in batch.to_pylist()]
    held.sort(key=lambda r: r["key"])  # rows may arrive in any order
    y = np.array([r["y"] for r in held], float)
    if len(set(y)) < 2:
        return
    n = len(held)
    doc = np.repeat(np.arange(n), [len(r["buckets"]) for r in held])
    bucket = np.concatenate([np.array(r["buckets"], np.int64) for r in held])
    stats = np.array([r["stats"] for r in held])
    machine = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    machine.fit(*machine.rows(doc, bucket, stats, n), y)
    model = pickle.dumps((machine.mean, machine.deviation, machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))
    yield pa.RecordBatch.from_arrays([pa.array([model])], ["model"])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(buckets, stats, y, key) of at most ``rows`` labelled documents outside the held-out fold.

    Features are made where the documents are read; only they are gathered in one partition.
    Of rows that repeat a doc_id one counts, the first in the order of a hash of its text.
    """
    ship(docs.sparkSession)
    own = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y"))
    own = own.where(F.col("y").isin(0, 1) & (F.crc32(F.col("label_id").cast("string").cast("binary")) % FOLDS != 0))
    own = own.groupBy("label_id").agg(F.max("y").alias("y")).withColumn("key", F.xxhash64("label_id", F.lit(7)))
    own = own.orderBy("key", "label_id").limit(rows)
    t = _slim(docs).join(F.broadcast(own), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "n_chars", "y", "key")
    t = t.mapInArrow(_featured, "buckets array<long>, stats array<double>, y int, key long")
    one = F.min(F.struct(F.xxhash64("buckets", "stats").alias("at"), "buckets", "stats", "y")).alias("r")
    return t.groupBy("key").agg(one).select("r.buckets", "r.stats", "r.y", "key").repartition(1)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """The machine fitted to the training rows; null where they do not hold both classes."""
    found = training_rows(docs, labels, rows).mapInArrow(_fit, "model binary").collect()
    if not found:
        return None
    mean, deviation, bias, w, v = pickle.loads(found[0].model)
    machine = Machine(mean, deviation)
    machine.bias, machine.w, machine.v = bias, w.astype(np.float64), v.astype(np.float64)
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; one pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, n_chars in _pieces(batch):
                s = model.value.scores(texts, n_chars) if model.value else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(s)], ["doc_id", "score"])

    t = _slim(docs).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return t.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
