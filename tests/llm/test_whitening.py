from __future__ import annotations

import math

import numpy as np
import pytest

from tablelink.llm import whitening as w
from tablelink.llm.queries import QUERIES
from tablelink.llm.shared import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def brute(vectors, most=16):
    """n, sums, eigenvalues, components and trace from the different vectors, in numpy."""
    x = np.unique(np.array(vectors, dtype=np.int64), axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums // n - (sums % n) / n
    _, sizes, components = np.linalg.svd(centred, full_matrices=False)
    values = sizes**2 / n
    return n, sums, values[:most], components[:most], values.sum()


def whole(vector):
    return [math.floor(64 * float(c)) + 1_000_000 for c in vector]


def check(df, given, most=16):
    n, sums, values, components, trace = brute([whole(v) for v in given.values()], most)
    rows = df.collect()
    for row in rows:
        made = row["whitening"]
        x = whole(given[row["vec_id"]])
        assert made["n"] == n
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums.tolist()))
        assert made["deviation"] == (deviation if deviation < 2**63 else None)
        assert np.allclose(made["explained"], values / trace, rtol=1e-9)
        assert made["identity_error"] < 1e-9
        want = components @ (np.array(x) - sums // n - (sums % n) / n) / np.sqrt(values)
        # Either sign, the same for all rows.
        assert np.allclose(np.abs(made["whitened"]), np.abs(want), atol=1e-8)
    signs = [np.sign(row["whitening"]["whitened"]) for row in rows]
    wants = [
        np.sign(components @ (np.array(whole(given[row["vec_id"]])) - sums // n - (sums % n) / n)) for row in rows
    ]
    products = np.array(signs) * np.array(wants)
    assert (np.abs(products.sum(axis=0)) > len(rows) - 3).all()
    return rows


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 20)) * np.linspace(0.2, 9, 20)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[3][1]) for i in range(100)]  # a third are copies and count once
    got = check(w.whiten(frame(spark, rows).repartition(6)), dict(rows))
    assert len(got) == 300 and len(got[0]["whitening"]["whitened"]) == 16


def test_badly_conditioned(spark):
    """Widths from 10 to 10 million, so that squares differ by 12 digits."""
    rng = np.random.default_rng(2)
    mixed, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    base = (rng.normal(size=(400, 6)) * 10.0 ** np.arange(0, 6)) @ mixed
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    check(w.whiten(frame(spark, rows)), dict(rows))


def test_dependent_columns(spark):
    """Directions without variance have no component."""
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, size=(120, 3))
    rows = [(i, [float(a), float(b), float(a + b), float(c), 5.0]) for i, (a, b, c) in enumerate(base.tolist())]
    out = w.whiten(frame(spark, rows), scale=1, shift=0).collect()
    x = np.unique(np.array([v for _, v in rows]), axis=0)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3]
    made = out[0]["whitening"]
    assert len(made["whitened"]) == 3 and np.allclose(made["explained"], values / values.sum())
    assert made["identity_error"] < 1e-6


def test_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(None, one), (1, None), (2, [1.0, None, 3.0]), (3, [float("nan"), 0.0, 1.0]), (4, [1.0, float("inf"), 1.0])]
    rows += [(5, one), (5, one), (6, [1.0]), (7, []), (8, [0.0, -7.5, 2.0])]
    out = w.whiten(frame(spark, rows))
    assert set(SCHEMA.replace(",", "").split()[::2]) < set(out.columns)
    got = out.collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["5", "5", "6", "7", "8", "None"]
    full = {"None": one, "5": one, "6": [1.0, 0.0, 0.0], "7": [0.0] * 3, "8": [0.0, -7.5, 2.0]}
    n, sums, values, _, trace = brute([whole(v) for v in full.values()])
    for row in got:
        x = whole(full[str(row["vec_id"])])
        assert row["whitening"]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums.tolist()))
        assert np.allclose(row["whitening"]["explained"], values / trace)
    # All alike, one row, no dimension, no row.
    alike = w.whiten(frame(spark, [(1, one), (2, one)])).collect()
    assert [(r["whitening"]["n"], r["whitening"]["deviation"], r["whitening"]["whitened"]) for r in alike] == [(1, 0, [])] * 2
    assert alike[0]["whitening"]["identity_error"] is None
    assert w.whiten(frame(spark, [(1, [])])).collect()[0]["whitening"]["deviation"] == 0
    assert w.whiten(frame(spark, [])).collect() == []


def test_deviation_beyond_64_bits(spark):
    out = w.whiten(frame(spark, [(1, [3e10, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])]))
    got = {r["vec_id"]: r["whitening"]["deviation"] for r in out.collect()}
    assert got == {1: None, 2: None, 3: None}


def test_factor_of_singular_matrix():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 7))
    factor = w.triangular_factor(lambda s: (a @ s).T @ (a @ s), 7, 50)
    assert np.allclose(factor.T @ factor, a.T @ a, atol=1e-9)
    assert factor.shape == (4, 7)
    assert w.triangular_factor(lambda s: np.zeros((3, 3)), 3, 10).shape == (0, 3)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    given = {r["vec_id"]: r["embedding"] for r in table(spark, folder, "embeddings").collect()}
    given = {i: v for i, v in given.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    got = QUERIES["op13_whitening"](spark, folder).collect()
    n, sums, values, components, trace = brute([whole(v) for v in given.values()])
    assert len(got) == 16 * len(given)
    for row in got:
        k = row["component"] - 1
        x = whole(given[row["vec_id"]])
        assert row["n"] == n and row["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums.tolist()))
        want = components[k] @ (np.array(x) - sums / n) / math.sqrt(values[k])
        assert math.isclose(abs(row["whitened"]), abs(want), abs_tol=1e-6)
        assert math.isclose(row["explained"], values[k] / trace, rel_tol=1e-9) and row["identity_error"] < 1e-9
