"""Median slopes by counting against all pairs written out."""

import time

import numpy as np
import pytest

from cloakframe.operators import experiments as ex, slopes


def by_pairs(x, y):
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    one, other = np.triu_indices(len(x), 1)
    apart = x[other] != x[one]
    found = np.sort((y[other] - y[one])[apart] / (x[other] - x[one])[apart])
    return (found[(len(found) - 1) // 2] + found[len(found) // 2]) / 2 if len(found) else None


@pytest.mark.parametrize("listed", [1 << 21, 3])
@pytest.mark.parametrize("seed", range(60))
def test_same_slope_as_all_pairs(monkeypatch, seed, listed):
    """Few and many ties in x, y and slopes; with hardly any pairs listed the counts decide."""
    monkeypatch.setattr(slopes, "LISTED", listed)
    draw = np.random.default_rng(seed)
    n = draw.integers(1, 60)
    x = draw.integers(0, 12, n).astype(float) if seed % 2 else draw.normal(size=n)
    y = draw.integers(0, 9, n).astype(float) if seed % 3 else draw.normal(size=n)
    got, want = slopes.median_slope(x, y), by_pairs(x, y)
    assert got == want if listed > 3 or want is None else got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_long_curves_in_seconds():
    draw = np.random.default_rng(1)
    x = draw.integers(4, 5000, 100_000).astype(float)
    begin = time.perf_counter()
    assert slopes.median_slope(x, 1.0879 * x + draw.normal(size=len(x)) * 50) == pytest.approx(1.0879, abs=0.01)
    assert time.perf_counter() - begin < 60
    line = np.arange(20_000.0)
    bent = 2 * line + np.where(line % 3 == 0, 5, 0)
    assert [slopes.median_slope(line, y) for y in (2 * line + 1, 0 * line, -0.5 * line, bent)] == [2.0, 0.0, -0.5, 2.0]


def test_curves_by_group(spark):
    rows = [(k, f"p{i}", float(x), float(y)) for k in ("a", None) for i, (x, y) in enumerate([(4, 1), (5, 3), (7, 2), (7, 9), (9, 9)])]
    rows += [("b", "p", 5.0, 1.0), ("b", "q", 5.0, 2.0), ("c", "low", 1.0, 1.0), ("d", "p", 4.0, None), ("d", "q", 6.0, 2.0), ("d", "r", 8.0, 6.0)]
    found = {r["k"]: r for r in ex.theil_sen(spark.createDataFrame(rows, "k string, point string, x double, y double"), ["k"]).collect()}
    want = by_pairs(np.array([4.0, 5, 7, 7, 9]), np.array([1.0, 3, 2, 9, 9]))
    assert found["a"]["slope"] == found[None]["slope"] == want and found["d"]["slope"] == 2.0 and "c" not in found
