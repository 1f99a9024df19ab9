"""What the sketches ask for is what a linked pair has but for odds below ODDS."""

import math

import numpy as np
import pytest

from larkspur.llm import near_dedup


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_fewest(percent):
    p, few = percent / 100, near_dedup.fewest(percent)
    below = sum(math.comb(near_dedup.SKETCH, k) * p**k * (1 - p) ** (near_dedup.SKETCH - k) for k in range(few))
    assert 0 < few < near_dedup.SKETCH and below < near_dedup.ODDS


@pytest.mark.parametrize("shared,kept", [(57, 0), (58, 1)])
def test_estimate_in_the_union(spark, shared, kept):
    """Pairs of full sets: the estimate looks at the union's smallest values only."""
    k = near_dedup.SKETCH
    both = np.arange(shared)
    a = np.concatenate((both, np.arange(shared, k), np.arange(10_000, 13_000))).astype(np.uint64)
    b = np.concatenate((both, np.arange(10_000, 13_000))).astype(np.uint64)
    assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) > 0.8
    sets = spark.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(b.tobytes()))], "doc long, grams binary")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert near_dedup.counted(pairs, sets, 80).count() == kept
