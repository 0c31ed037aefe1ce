"""Whitening against numpy over all vectors at once."""

import math

import numpy as np
import pytest

from colloquy.llm import catalog, whitening
from colloquy.llm.common import Scratch
from tests.llm.conftest import VECTORS

OP = catalog.queries()["op11_embedding_whitening"]


def plain(rows, width, components=4):
    """(id, x) of valid rows, n, S, exact deviations, covariance and its eigenvalues of the distinct vectors."""
    x = []
    for key, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            x.append((key, [math.floor(256 * c) for c in v] + [0] * (width - len(v))))
    fit = sorted({tuple(v) for _, v in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    cov = centred.T @ centred / n
    deviations = [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for _, v in x]
    return x, n, s, deviations, cov, np.sort(np.linalg.eigvalsh(cov))[::-1]


def check(got, rows, width, atol=1e-6):
    x, n, s, deviations, cov, e = plain(rows, width)
    k = min(4, width)
    assert len(got) == k * len(x)
    assert {r.n for r in got} == {n}
    expected = sorted(((key, d) for (key, _), d in zip(x, deviations, strict=True)), key=repr)
    assert sorted(((r.vec_id, int(r.deviation_exact)) for r in got if r.component == 1), key=repr) == expected
    assert all(r.deviation == int(r.deviation_exact) for r in got if r.deviation_exact < 1 << 63)
    for c in range(1, k + 1):
        own = [r for r in got if r.component == c]
        assert own[0].explained == pytest.approx(e[c - 1] / np.trace(cov), rel=1e-9)
        # |whitened| is the projection on the one eigenvector: the sum over rows that share an id is compared
        by = {}
        for r in own:
            by.setdefault(r.vec_id, []).append(r.whitened)
        vector = np.linalg.eigh(cov)[1][:, ::-1][:, c - 1]
        theirs = {}
        for key, v in x:
            theirs.setdefault(key, []).append(float((np.array(v, float) - np.array([b / n for b in s])) @ vector / math.sqrt(e[c - 1])))
        sign = np.sign(sum(a * b for key in by for a, b in zip(sorted(by[key], key=abs), sorted(theirs[key], key=abs), strict=True)))
        for key in by:
            assert sorted(by[key]) == pytest.approx(sorted(sign * b for b in theirs[key]), abs=atol)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_against_numpy(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = OP(spark, d).collect()
    check(got, rows, 64)
    assert got[0].identity_error < 1e-9


def test_odd_vectors(spark, odd_dir):
    got = OP(spark, odd_dir).collect()
    check(got, [(r[0], r[1]) for r in VECTORS], 5, 1e-3)
    assert {r.vec_id for r in got} == {1, 2, 7, 8, None, 9, 10, 11}


@pytest.mark.parametrize("width,tile", [(7, 3), (40, 16), (33, 32)])
def test_tiles_give_the_whole_covariance(spark, width, tile):
    m = np.random.default_rng(width).integers(-300, 300, (500, width))
    df = spark.createDataFrame([(v.tolist(),) for v in m], "x array<long>").repartition(3)
    n, sums, cov = whitening.covariance(df, width, tile, rows=64)
    assert n == 500 and sums == m.sum(axis=0).tolist()
    c = m - m.mean(axis=0)
    assert np.allclose(cov, c.T @ c / 500, rtol=1e-12, atol=1e-9)


def test_one_vector_many_times_counts_once(spark):
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(300)] + [(1000 + k, [float(k % 3), float(k % 5), float(k), 0.5 * k]) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), rows, 4)


def test_flat_components_have_no_value(spark):
    rows = [(k, [float(k), 2.0 * k, 1.0, 1.0]) for k in range(8)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 32
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert all(r.identity_error < 1e-9 for r in got)
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<double>")).collect() == []


def test_deviations_beyond_64_bits_are_whole(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 2.0])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    assert int(got[1].deviation_exact) == (3 * 256 * 10**15) ** 2 + (0 * 3 - 768) ** 2
    assert got[1].deviation is None and got[3].deviation == (3 * 512 - 768) ** 2


def test_scratch_is_shared(spark):
    x, width = whitening.scaled(spark.createDataFrame([("a", [1.0]), ("b", [0.5, -0.001])], "vec_id string, embedding array<double>"), Scratch(spark, "t"))
    assert width == 2 and {r.vec_id: r.x for r in x.collect()} == {"a": [256], "b": [128, -1]}
