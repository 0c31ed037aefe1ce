"""Operator 11, embedding whitening over a tiled covariance.

Vectors become whole numbers x = floor(256 * c); the covariance is that of the distinct
ones (the fit list). Dimensions are cut into column blocks, pairs of blocks are tile keys.
Where the fit list is read, each run of rows is a row-block: its column blocks, centred by
the means, go to every tile key that needs them, a task multiplies the two blocks of a row-block and
tile, and the products are summed by tile and cell. The matrix of D x D numbers (whatever
the number of vectors) is put together on the driver, which takes its eigenvectors;
all rows are projected on them where they are read.

Sums of whole numbers are exact at any size; ``deviation`` is null where it exceeds 64
bits, and whole as ``deviation_exact``, a decimal of 38 digits.

Defined results: rows with a null vector, or null or non-finite entries, are left out;
vectors shorter than the longest count as followed by zeros, so an empty vector is all zeros;
256 * c beyond 2^62 counts as 2^62; repeated rows are whitened each and fitted once; a
component whose eigenvalue is at most 1e-13 of the largest has no whitened value (null)
and is not part of ``identity_error``, which is null where no component has one;
``explained`` is null where all vectors are equal; vectors of fewer than four dimensions
have as many components as dimensions; empty tables give no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE, COMPONENTS = 256, 4
#: Dimensions of a column block, at least, and the most column blocks.
TILE, BLOCKS = 32, 8
#: Vectors of a row-block.
ROWS = 4096
LARGEST = float(1 << 62)
FLAT = 1e-13


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, x) of the vectors that have finite entries only."""
    for batch in batches:
        lists = batch.column(1).cast(pa.list_(pa.float64()))
        known = np.asarray(lists.is_valid())
        sizes = np.where(known, np.asarray(lists.value_lengths().fill_null(0)), 0)
        values = lists.flatten()
        c = np.asarray(values.fill_null(np.nan), float)
        at = np.concatenate(([0], np.cumsum(sizes)))
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(c))))
        keep = known & (bad[at[1:]] == bad[at[:-1]])
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(np.clip(c * SCALE, -LARGEST, LARGEST))[np.repeat(keep, sizes)].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], ["vec_id", "x"])


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * width:
        return flat.reshape(-1, width)
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _wide(x: np.ndarray, room: int) -> np.ndarray:
    """The numbers as Python's where 64 bits have no room for ``room`` times the largest."""
    return x if not x.size or int(np.abs(x).max()) * room < 1 << 62 else x.astype(object)


def _small(x: np.ndarray) -> np.ndarray:
    """In the narrowest type that holds all."""
    top = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


@dataclass
class Whitening:
    """What a fit leaves: the number of fitted vectors, exact sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > FLAT * max(self.eigenvalues[0], 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column a component, nan where it has no spread."""
        mean = np.array([s / self.n for s in self.sums])
        roots = np.sqrt(np.where(self.usable, self.eigenvalues, np.nan))
        return (x - mean) @ self.components / roots

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each row the sum over dimensions of (n x - S)^2, in whole numbers."""
        most = max(map(abs, self.sums), default=0) + self.n * (int(np.abs(x).max()) if x.size else 0)
        kind = np.int64 if most < 1 << 62 and most * most * max(1, len(self.sums)) < 1 << 62 else object
        d = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [int(v) for v in (d * d).sum(axis=1)]


def scaled(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(vec_id, x) of all valid vectors, written, and their number of dimensions."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    t = scratch.keep(vectors.select("vec_id", "embedding").mapInArrow(_scaled, f"vec_id {kind}, x array<long>"))
    return t, t.agg(F.max(F.size("x"))).first()[0] or 0


def covariance(fit: DataFrame, width: int, tile: int | None = None, rows: int = ROWS) -> tuple[int, list[int], np.ndarray]:
    """Number, sums by dimension and covariance matrix of the distinct vectors ``fit``."""
    tile = tile or max(TILE, -(-width // BLOCKS))
    blocks = [(a, min(width, a + tile)) for a in range(0, width, tile)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(0), width)
            s = [int(v) for v in _wide(m, len(m)).sum(axis=0)]
            yield pa.RecordBatch.from_pydict({"k": np.arange(width + 1, dtype=np.int32), "s": pa.array([*s, len(m)], pa.decimal128(38, 0))})

    found = dict(fit.select("x").mapInArrow(sums, "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s")).collect())
    n, total = int(found.get(width, 0)), [int(found.get(k, 0)) for k in range(width)]
    if not n:
        return 0, total, np.zeros((width, width))
    mean = np.array([s / n for s in total])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        k = 0
        for batch in batches:
            m = _matrix(batch.column(0), width)
            for a in range(0, len(m), rows):
                x = _small(m[a : a + rows])
                columns = [np.ascontiguousarray(x[:, lo:hi]).tobytes() for lo, hi in blocks]
                out = [(f"{part}-{k}", p, side, x.dtype.name, columns[b]) for p, (i, j) in enumerate(pairs) for side, b in enumerate((i,) if i == j else (i, j))]
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["row_block", "tile", "side", "kind", "columns"])
                k += 1

    def multiply(t: pa.Table) -> pa.Table:
        p = t["tile"][0].as_py()
        centred = {}
        for side, kind, raw in zip(*(t[c].to_pylist() for c in ("side", "kind", "columns")), strict=True):
            lo, hi = blocks[pairs[p][side]]
            centred[side] = np.frombuffer(raw, kind).reshape(-1, hi - lo) - mean[lo:hi]
        product = (centred[0].T @ centred[max(centred)]).ravel()
        return pa.table({"tile": pa.array([p], pa.int32()), "products": pa.array([product], pa.list_(pa.float64()))})

    t = fit.select("x").mapInArrow(deal, "row_block string, tile int, side int, kind string, columns binary")
    t = t.groupBy("row_block", "tile").applyInArrow(multiply, "tile int, products array<double>")
    t = t.select("tile", F.posexplode("products").alias("cell", "v")).groupBy("tile", "cell").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for p, cell, v in t.toLocalIterator():
        (i0, _), (j0, j1) = blocks[pairs[p][0]], blocks[pairs[p][1]]
        r, c = i0 + cell // (j1 - j0), j0 + cell % (j1 - j0)
        out[r, c] = out[c, r] = v / n
    return n, total, out


def fit_whitening(x: DataFrame, width: int, scratch: Scratch, components: int = COMPONENTS, tile: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors among ``x``; none where there is no vector or no dimension."""
    if not width:
        return None
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = scratch.keep(x.select(padded.alias("x")).distinct())
    n, sums, cov = covariance(fit, width, tile)
    if not n:
        return None
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[:components]
    model = Whitening(n, sums, v[:, order], np.maximum(e[order], 0.0), float(np.trace(cov)))
    good = [int(k) for k in np.flatnonzero(model.usable)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in good], [f"w{k}" for k in good])

    if good:
        w = fit.select("x").mapInArrow(run, ", ".join(f"w{k} double" for k in good))
        pairs = [(a, b) for a in good for b in good if a <= b]
        found = w.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
        model.identity_error = max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    return model


def apply_whitening(x: DataFrame, width: int, model: Whitening) -> DataFrame:
    """A row for every vector and component; one pass, no shuffle."""
    sent = x.sparkSession.sparkContext.broadcast(model)
    kind = x.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = m.components.shape[1]
        explained = m.eigenvalues / m.trace if m.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            deviations = pa.array(m.deviations(rows), pa.decimal128(38, 0))
            own = pa.array(np.repeat(np.arange(len(rows)), k))
            w = m.whitened(rows).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), deviations.take(own), pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(explained, len(rows)), mask=np.isnan(np.tile(explained, len(rows)))),
                ],
                ["vec_id", "component", "deviation_exact", "whitened", "explained"],
            )

    t = x.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation_exact decimal(38,0), whitened double, explained double")
    return t.select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation_exact as long)").alias("deviation"), "whitened", "explained",
        F.lit(model.identity_error).cast("double").alias("identity_error"), "deviation_exact",
    )


NO_ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact for every valid vector and component."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    x, width = scaled(vectors, scratch)
    model = fit_whitening(x, width, scratch, components, tile)
    if model is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {NO_ROWS}")
    return apply_whitening(x, width, model)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
