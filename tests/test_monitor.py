"""P-values against enumeration."""

import itertools
import math

import pytest

from gradeloom.operators import monitor as mo


def gap(order, n, m):
    a = b = 0
    most = 0
    for x in order:
        a, b = a + x, b + 1 - x
        most = max(most, abs(a * m - b * n))
    return most


@pytest.mark.parametrize("n,m", [(n, m) for n in range(1, 9) for m in range(n, 9) if n + m <= 13] + [(8, 8)])
def test_kolmogorov_equals_enumeration(n, m):
    found = [gap([i in chosen for i in range(n + m)], n, m) for chosen in map(set, itertools.combinations(range(n + m), n))]
    for step in sorted(set(found)):
        want = sum(g >= step for g in found) / len(found)
        assert mo.exact_kolmogorov_p_value(step / (n * m), n, m) == pytest.approx(want, abs=1e-12)
        assert mo.exact_kolmogorov_p_value(step / (n * m), m, n) == pytest.approx(want, abs=1e-12)
    assert mo.exact_kolmogorov_p_value(0.0, n, m) == 1.0


def test_exact_approaches_the_limit():
    for share in (0.03, 0.05, 0.08):
        assert abs(mo.exact_kolmogorov_p_value(share, 1000, 10_000) - mo.limit_kolmogorov_p_value(share, 1000, 10_000)) < 0.02
    assert mo.kolmogorov_p_value(0.05, 1000, 10_001) == mo.limit_kolmogorov_p_value(0.05, 1000, 10_001)
    assert math.isclose(mo.kolmogorov_p_value(1.0, 3, 3), 0.1)
