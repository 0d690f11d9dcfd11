"""Leaks in texts that share a diagonal band with the text before them."""

import random

from tidewell.llm.decontaminate import Benchmark

WORDS = "granite lantern orchard velvet compass meadow thistle harbor copper willow saffron pebble falcon ribbon".split()


def made(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(100)) for _ in range(n))


def test_leaks_of_short_texts_in_a_row():
    short, long_ = made(1, 8), made(2, 300)
    found = Benchmark([(1, short), (2, long_)]).find([short] * 12 + [long_])
    assert {(d, i) for d, i, *_ in found} == {(d, 1) for d in range(12)} | {(12, 2)}


def test_leaks_after_a_stray_qgram():
    item, long_ = made(3, 8), made(4, 300)
    index = Benchmark([(1, item), (2, long_)])
    for lead in range(0, 600, 20):
        found = index.find(["x" * lead + " " + item[:20], item + " and more"])
        assert {(d, i) for d, i, *_ in found} == {(1, 1)}
        (_, _, start, end, edits), = found
        assert (start, end, edits) == (0, len(item), 0)


def test_texts_are_counted_apart():
    item, long_ = made(5, 8), made(6, 300)
    half = len(item) // 2
    found = Benchmark([(1, item), (2, long_)]).find([item[:half], item[half:], made(7, 20)])
    assert found == []
