import numpy as np
import pytest

from sparkstave.llm import whitening as op

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(parts)


def plain(rows, most=32):
    """The contract in numpy, with whole numbers of any size and numpy's own eigenvectors."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = x * n - s
    centred = np.array([[float(a) / n for a in r] for r in y])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return [i for i, _ in rows], n, (y * y).sum(axis=1), centred @ q / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(v)


def test_equals_numpy(spark):
    rng = np.random.default_rng(5)
    shape = rng.standard_normal((40, 40)) * np.geomspace(1, 0.05, 40)
    rows = [(i, [float(c) for c in rng.standard_normal(40) @ shape]) for i in range(700)]
    rows += [(None, rows[3][1]), rows[4], (900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0])]
    got = op.whitened(frame(spark, rows)).toPandas()
    ids, n, deviation, want, explained = plain([r for r in rows if r[0] not in (904, 905)])
    assert len(got) == len(ids) * 32 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    by_id = {}
    for r in got.itertuples():
        by_id.setdefault(None if r.vec_id != r.vec_id else int(r.vec_id), []).append(r)
    sign = None
    for i, off, w in zip(ids, deviation, want, strict=True):
        mine = sorted(by_id[i], key=lambda r: r.component)
        assert {int(r.deviation) for r in mine} == {int(off)}
        if len(mine) == 32:
            value = np.array([r.whitened for r in mine])
            sign = np.sign(value * w) if sign is None else sign
            assert np.allclose(value, sign * w, atol=1e-9)
            assert np.allclose([r.explained for r in mine], explained, rtol=1e-10)


@pytest.mark.parametrize("seed", range(30))
def test_eigenvalues_and_counts(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 30))
    e = np.sort(rng.choice([0.0, 1.0, 2.0, 2.0 + 1e-9, 5.0, *rng.random(6) * 10], d))[::-1]  # repeated, close and zero ones
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    for shift in (-1.0, 0.5, 1.5, 3.7, 20.0):
        assert op.count_above(v, shift) == (e > shift).sum()
    values, vectors = op.leading(v, 12)
    k = min(d, 12)
    assert values.shape == (k,) and np.allclose(values, e[:k], atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12


def test_indefinite_counts():
    rng = np.random.default_rng(3)
    for d in (2, 3, 9, 20):
        v = rng.integers(-3, 4, (d, d)).astype(float)
        v = v + v.T
        np.fill_diagonal(v, 0.0)  # needs pivots of two rows
        e = np.linalg.eigvalsh(v)
        for shift in (0.01, -2.3, 1.7):
            assert op.count_above(v, shift) == (e > shift).sum()


def test_degenerate_tables(spark):
    assert op.whitened(frame(spark, [(1, None), (2, [None])])).count() == 0
    assert op.whitened(frame(spark, [(1, [])])).count() == 0
    one = op.whitened(frame(spark, [(1, [0.5, -2.0]), (1, [0.5, -2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0), (2, 0, None, 0.0, 0.0)] * 2
    flat = op.whitened(frame(spark, [(1, [1.0, 0.0, 3.0]), (2, [2.0, 0.0, 3.0])])).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in flat] == [False, True, True] * 2 and abs(abs(flat[0]["whitened"]) - 1) < 1e-12


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2.0**30 * (i % 3)), float(-(2.0**28)) * i]) for i in range(10)]
    got = {r["vec_id"]: r["deviation"] for r in op.whitened(frame(spark, rows)).filter("component = 1").collect()}
    _, _, deviation, _, _ = plain(rows)
    assert [got[i] for i, _ in rows] == [int(x) if x < 2**63 else None for x in deviation]


def test_same_in_any_order(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.standard_normal(8)]) for i in range(300)]
    a, b = (sorted((r["vec_id"], r["component"], r["whitened"]) for r in op.whitened(frame(spark, rows, parts)).collect()) for parts in (1, 7))
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-13)  # signs too
