"""Benchmark items much shorter and much longer than the windows of most benchmarks."""

import random

import pytest

from tests.llm.test_decontamination import WORDS, leaks


@pytest.mark.parametrize("length", [5, 6, 8, 40, 100, 130, 161, 300, 700])
def test_copies_of_any_length_are_found(spark, length):
    pick = random.Random(length)
    items = [" ".join(f"item{length}x{i}x{k}" for k in range(length)) for i in range(3)]
    items.append(" ".join(pick.choice(WORDS[:400]) for _ in range(30)))
    docs, planted = [], set()
    for i in range(24):
        words = [f"foreign{pick.randrange(5_000)}" for _ in range(2 * length + 400)]
        if i % 4:
            at = 100 + pick.randrange(100)
            copy = items[i % 3].split()
            if length > 8 and i % 2:  # some words changed, and some put in, not in the answer
                for k in range(0, length * 2 // 3, 8):
                    copy[k] = "other other"
            words[at:at] = copy
            planted.add((i, i % 3))
        docs.append((i, " ".join(words)))
    assert leaks(spark, items, docs) == planted
