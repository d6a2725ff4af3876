"""Whitening of embeddings against exact arithmetic and numpy, with awkward rows."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from folioframe.llm import whitening

KIND = "vec_id long, embedding array<double>, component int, n string"


def folder(spark, at, rows):
    spark.createDataFrame([(i, v, 9, "x") for i, v in rows], KIND).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, base[7].tolist()) for k in range(400)]  # a hot vector counts once
    rows += [(None, base[8].tolist()), (5, base[9].tolist())]
    dropped = [(2000, None), (2001, []), (2002, [math.nan] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [math.inf] + [0.0] * 5), (2005, [1.0, 2.0])]
    got = whitening.op11_embedding_whitening(spark, folder(spark, tmp_path / "t", rows + dropped)).collect()
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(c * n - s, n)) for c, s in zip(r, sums)] for r in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    assert len(got) == 4 * len(rows)
    mine: dict = {}
    for r in got:
        mine.setdefault(r["component"], []).append(r)
    want = {(i, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for (i, _), v in zip(rows, x)}
    assert {(r["vec_id"], r["deviation"]) for r in got} == want and {r["n"] for r in got} == {n}
    for k in range(1, 5):
        value, axis = values[-k], axes[:, -k]
        key = lambda t: (t[0] is None, t[0] or 0, abs(t[1]))
        ours = sorted(((r["vec_id"], r["whitened"]) for r in mine[k]), key=key)
        true = sorted(((i, float((np.array([Fraction(c * n - s, n) for c, s in zip(v, sums)], dtype=float) @ axis) / math.sqrt(value))) for (i, _), v in zip(rows, x)), key=key)
        sign = 1 if abs(ours[0][1] - true[0][1]) < abs(ours[0][1] + true[0][1]) else -1
        assert np.allclose([a for _, a in ours], [sign * b for _, b in true], atol=1e-9)
        assert math.isclose(mine[k][0]["explained"], value / values.sum(), rel_tol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert whitening.op11_embedding_whitening(spark, folder(spark, tmp_path / "t", rows)).collect() == []


def test_fewer_components_than_asked(spark, tmp_path):
    """Rows on a line have one component, whatever their dimension."""
    rows = [(k, [float(k), 2.0 * k, -1.0 * k]) for k in range(50)]
    got = whitening.op11_embedding_whitening(spark, folder(spark, tmp_path / "t", rows)).collect()
    assert len(got) == 50 and {r["component"] for r in got} == {1}
    assert math.isclose(got[0]["explained"], 1, rel_tol=1e-12)


def test_integers_saturate_and_deviations_may_be_null():
    x = whitening.integers(np.array([[1e300, -1e300, -0.001, 0.0]]))
    assert x.tolist() == [[2**63 - 1, -(2**63), -1, 0]]
    rows = np.array([[3, 5], [2**40, 0], [-(2**63), 1]], dtype=np.int64)
    assert whitening.deviations(rows, 3, [4, 9]).to_pylist() == [61, None, None]
    # the product with n leaves 64 bits, the difference does not
    assert whitening.deviations(np.array([[2**62 + 1]]), 8, [8 * 2**62]).to_pylist() in ([64], [None])


def test_packing_keeps_rows():
    x = np.array([[0, -128], [127, 128], [-(2**31), 5], [2**63 - 1, -(2**63)], [0, 0]], dtype=np.int64)
    rows = whitening.packed(x)
    assert [r[:1] for r in rows] == [b"1", b"2", b"4", b"8", b"1"]
    assert whitening.unpacked(pa.array(rows, pa.binary()), 2).tolist() == x.tolist()
