"""The linear program reaches the bound of whole sequences."""

import math

import numpy as np
import pytest

from codeloom.llm import packing


def best_fit(demand):
    from codeloom.llm.binary import best_fit_decreasing

    return len(best_fit_decreasing(np.repeat(np.arange(1, len(demand) + 1), demand).tolist(), len(demand)))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [64, 256])
def test_as_few_sequences_as_the_tokens_need(seed, size):
    rng = np.random.default_rng(seed)
    demand = rng.poisson(60 * np.exp(-np.arange(size) / (size / 3))).astype(np.int64)
    least = math.ceil((demand * np.arange(1, size + 1)).sum() / size)
    used = sum(n for _, n in packing.cutting_stock(demand))
    assert used <= least * 1.005 + 1 and used <= best_fit(demand) * 1.003 + 1


def test_bound_where_best_fit_fails():
    demand = np.zeros(100, np.int64)
    demand[[55, 27, 16]] = 200, 200, 200  # sizes 56, 28, 17: 56 + 28 and 17 * 5 waste least in other mixes
    total = sum(n for _, n in packing.cutting_stock(demand))
    solution = packing.fractional(demand, 1e-9, 24, 60)
    bound = sum(n for _, n in solution)
    assert bound - 1e-6 <= total <= bound + 3
    assert all((p * np.arange(1, 101)).sum() <= 100 for p, _ in solution)


def test_one_length():
    demand = np.zeros(64, np.int64)
    demand[21] = 1000
    assert sum(n for _, n in packing.cutting_stock(demand)) == 500
