"""Near-duplicates by plain Jaccard whose counts differ strongly."""

import random

from tidewell.llm import minhash


def made(seed, n):
    r = random.Random(seed)
    return [f"word{r.randrange(10**6)}" for _ in range(n)]


def pairs_of(k):
    """A text, and the same text after which one of its lines stands many times."""
    base = made(k, 300)
    return " ".join(base), " ".join(base + base[-12:] * 200)


def test_copies_with_a_repeated_line_are_linked(spark):
    rows = []
    for k in range(8):
        a, b = pairs_of(k)
        (_, s1, w1), (_, s2, w2) = minhash.shingles([a]), minhash.shingles([b])
        both = len(set(s1.tolist()) & set(s2.tolist()))
        assert both / (len(s1) + len(s2) - both) >= 0.9 and w2.max() >= 100
        rows += [(2 * k, a), (2 * k + 1, b)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(16)}


def test_estimate_sees_the_plain_jaccard():
    for k in range(8):
        _, packed = minhash.band_hashes(list(pairs_of(k)))
        assert minhash._estimate(packed[:1], packed[1:])[0] > 0.8
