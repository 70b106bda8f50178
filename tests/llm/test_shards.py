"""Shard keys of wide radii."""

import pytest

from sessionlens.llm import simhash


@pytest.mark.parametrize("size", [5_000, 200_000, 15_000_000])
def test_tables_grow_with_the_key_bits(size):
    masks = simhash.shard_masks(10, size)
    assert (1 - simhash.meeting(10, masks[0].bit_count())) ** len(masks) <= 0.01
