"""Fine sketches let every pair that reaches the threshold pass, at any size, and few others."""

import numpy as np
import pytest

from sessionlens.llm import resemblance


@pytest.mark.parametrize("size", [1, 5, 40, 200, 3000, 20_000, 60_000])
def test_links_pass_and_others_mostly_do_not(size):
    rng = np.random.default_rng(size)
    passed = {}
    for shared in (0.8, 0.85, 0.7, 0.6):
        both = max(1, round(size * 2 * shared / (1 + shared)))
        sets = []
        for _ in range(200 if size < 5000 else 12):
            common, a, b = (rng.integers(0, 2**63, n, np.uint64) for n in (both, size - both, size - both))
            x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
            sets.append((x, y, resemblance.resemblance(x, y)))
        fine = resemblance.FineSketches([resemblance.fine_sketch(v).tobytes() for x, y, _ in sets for v in (x, y)])
        got = [bool(fine.alike(2 * i, np.array([2 * i + 1]), 0.8)[0]) for i in range(len(sets))]
        assert all(g for g, (_, _, j) in zip(got, sets, strict=True) if j >= 0.8)
        passed[shared] = np.mean(got)
    if size >= 200:
        assert passed[0.7] < 0.1 and passed[0.6] == 0


def test_one_with_many_and_empty_sets():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 500, np.uint64))
    sets = [base, base[:450], base[:200], np.array([], np.uint64), np.unique(rng.integers(0, 2**63, 500, np.uint64)), base]
    fine = resemblance.FineSketches([resemblance.fine_sketch(x).tobytes() for x in sets])
    assert fine.alike(0, np.array([1, 2, 3, 4, 5]), 0.8).tolist() == [True, False, False, False, True]
    assert fine.alike(0, np.array([1, 2, 3, 4, 5]), 0.8).tolist() == [True, False, False, False, True]
    assert fine.alike(3, np.array([3]), 0.8).tolist() == [True]
