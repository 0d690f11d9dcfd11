"""The bounds that keep near-duplicate candidates few never cut a link."""

import collections
import random

import numpy as np
from test_llm import SCHEMA, prose

from tidewell.llm import components, minhash


def packed(x):
    return np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])


def l1(a, b):
    x, y = sum(a.values()), sum(b.values())
    return sum(abs(a.get(k, 0) / x - b.get(k, 0) / y) for k in a.keys() | b.keys())


def test_bounds_hold():
    r, linked = random.Random(3), 0
    for _ in range(3000):
        base = {k: r.choice([1, 1, 1, 2, 5, 30]) for k in r.sample(range(60), 40)}
        group = []
        for i in range(3):
            x = {k: v for k, v in base.items() if r.random() > 0.04}
            x |= {1000 * (i + 1) + k: r.choice([1, 1, 3]) for k in range(r.randrange(5))}
            group.append(x)
        hub, x, y = group
        sim, both, apart = minhash._compare(*packed(x), *packed(y))
        assert abs(apart - l1(x, y)) < 1e-9 and both == len(x.keys() & y.keys())
        if sim < minhash.THRESHOLD:
            continue
        linked += 1
        own = [{k for k in a if k not in b and k not in hub} for a, b in ((x, y), (y, x))]
        u, o = [len(s) for s in own], [sum(a[k] for k in s) / sum(a.values()) for a, s in zip((x, y), own)]
        n, t = [len(x), len(y)], minhash.THRESHOLD
        e = [len(a.keys() ^ hub.keys()) for a in (x, y)]
        d = [l1(a, hub) for a in (x, y)]
        most = min(n[0] - u[0], n[1] - u[1])
        plain = most >= t * (sum(n) - most) and sum(e) - 2 * min(e[0] - u[0], e[1] - u[1]) <= (1 - t) / (1 + t) * sum(n) + 1e-9
        odds = sum(s / (1 - s) for s in o) <= 1 / t - 1 + 1e-9
        by_count = odds and sum(d) - 2 * min(d[0] - o[0], d[1] - o[1]) <= 2 * (1 - t) + 1e-9
        assert plain or by_count
    assert linked > 200


def test_copies_without_their_original(spark):
    r, rows = random.Random(7), []
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = f"edit{i}x{r.randrange(99)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(500, rows[0][1], "en", "s", 0), (500, rows[1][1], "en", "s", 0), (501, prose(r, 50), "en", "s", 0), (501, prose(r, 50), "en", "s", 0)]
    got = minhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = collections.defaultdict(lambda: 10**9)
    for k, row in enumerate(rows):
        least[find(k)] = min(least[find(k)], row[0])
    want = collections.Counter((rows[k][0], least[find(k)]) for k in range(len(rows)))
    assert collections.Counter((x.doc_id, x.class_id) for x in got) == want


def test_components_with_more_edges(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    old, new = (spark.createDataFrame(x, "a BIGINT, b BIGINT") for x in (edges[:20], edges[20:]))
    got = {x.node: x.label for x in components.extend(components.components(old), new).collect()}
    want = {x.node: x.label for x in components.components(old.union(new)).collect()}
    assert got == want
