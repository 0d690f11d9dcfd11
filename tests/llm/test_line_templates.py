"""Short lines, and lines of one template, in the edit join."""

import random

from test_llm import distance

from tidewell.llm import lines


def as_docs(spark, made):
    return spark.createDataFrame([(i, x) for i, x in enumerate(made)], "doc_id BIGINT, text STRING")


def found(spark, df):
    """Links of lines by their text."""
    names = {lines_id: line for lines_id, line in df.select(lines._node(df["text"]), "text").collect()}
    return {frozenset((names[r.a], names[r.b])): r.edits for r in lines.links(df).collect()}


def allowed(a, b):
    n = min(len(a), len(b))
    return 2 if n >= lines.MIN_CHARS else 1 if n >= lines.MIN_CHARS // 2 else 0


def wanted(made):
    out = {}
    for i, a in enumerate(made := sorted(set(made))):
        for b in made[:i]:
            if abs(len(a) - len(b)) <= 2 and 0 < (d := distance(a, b)) <= allowed(a, b):
                out[frozenset((a, b))] = d
    return out


def test_short_lines_match_brute_force(spark):
    r = random.Random(4)
    made = []
    for _ in range(60):
        base = "".join(r.choice("abcd é") for _ in range(r.randrange(2, 15)))
        for _ in range(6):
            s = list(base)
            for _ in range(r.randrange(4)):
                k = r.randrange(len(s) + 1)
                s[k : k + r.randrange(2)] = r.choice(["", "x", "yz"])
            made.append("".join(s))
    want = wanted(made)
    assert {len(min(p, key=len)) for p in want} >= set(range(5, 13))
    assert found(spark, as_docs(spark, made)) == want


def test_templates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", 4)
    r, made = random.Random(5), []
    for _ in range(60):
        digits = "".join(r.choice("0123456789") for _ in range(r.randrange(3, 14)))
        for _ in range(5):
            s = list(f"request {digits} was served")
            for _ in range(r.randrange(4)):
                k = r.randrange(len(s))
                s[k : k + r.randrange(2)] = r.choice(["", "7", "x", "12"])
            made.append("".join(s))
    want = wanted(made)
    assert len(want) > 100 and found(spark, as_docs(spark, made)) == want


def test_pairs_of_a_template_grow_with_its_lines(spark):
    r = random.Random(6)
    made = sorted({f"user {r.randrange(10**6):06} asked for page {r.randrange(10**6):06} of the archive" for _ in range(20_000)})
    pairs, _ = lines.candidates(as_docs(spark, made))
    assert pairs.count() < 20 * len(made)


def test_white_space_is_blank(spark):
    df = as_docs(spark, ["\t\r", "\t \r", None, " "])
    assert [x.first_doc for x in lines.classes(df.where("doc_id < 3")).collect()] == [None] * 3
