"""Each operator against brute force, an exact round trip or held-out labels, with odd rows."""

import collections
import hashlib
import html as html_
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, components, decontaminate, fingerprint, lines, lm, minhash, mixing, sst, toxicity, wrappers
from tidewell.llm._common import words_of

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix odd potions by night".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def odd_docs(spark, extra=()):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    r = random.Random(5)
    a, b = prose(r, 120), prose(r, 3000)
    rows = [(1, a), (2, a), (2, a), (3, None), (4, ""), (5, b), (None, a), (None, None), (6, "x"), (7, " \n\t "), (8, a + " changed9"), *extra]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for (i, t), s in zip(rows, ["s1", None, "s2", "s1"] * 50)], SCHEMA)
    for c in ("key", "size", "copies", "label", "rep", "part", "line", "h1", "_text"):
        df = df.withColumn(c, F.lit(1))
    return df, [t for _, t in rows]


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|user|>\\1\\0", "", None, "a|b[c]<d>", "é\n\n中" * 40]
    rows = [(c, t, ["system", "user", "assistant", None][(t + c) % 4] if t else "system", nasty[(c * 7 + t) % 6] if t % 3 else "word " * (t * 9 % 130)) for c in range(4) for t in range(70)]
    rows += [(None, 0, "user", "q"), (None, None, "assistant", "a"), (9, 1, "assistant", "twice"), (9, 1, "assistant", "twice"), (10, 0, "user", "big " * 2000)]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").withColumn("pos", F.lit(1))
    made = chat.windows(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = made.collect()
    small = [w for w in windows if w.conv_id in (0, 1, 2, 3)]
    assert max(w.n_tokens for w in small) <= chat.BUDGET and max(w.window for w in small) > 0
    assert all(w.formatted.startswith("<|chat|><|system|>") for w in small)
    assert chat.windows(df.limit(0)).isEmpty() and chat.digests(chat.windows(df.limit(0))).isEmpty()


# 2 token shards


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_library(tokenizer):
    e, r = sst.Encoder("byte_bpe_50k.json"), random.Random(1)
    parts = [*"  ab'sst  \n\n\té1.,!<|ñ中  \x1c\x85ж", "'ll", "'re", " the", "\r\n", "  ", "\U0001f600"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert list(np.frombuffer(e.encode(t), "<u4")) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_shards_round_trip(spark, tokenizer):
    df, texts = odd_docs(spark, [(-5, "negative id"), (1 << 40, "large id")])
    got = sst.encode_and_read_back(df).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()), key=lambda x: x[:2])
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in want]
    start, crcs = 0, collections.Counter()
    for r in got:
        assert r.start == start
        start += r.n_tokens
        crcs[r.doc_id, r.ids_crc32] += 1
    for known, i, t in want:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        crcs[i if known else None, zlib.crc32(np.array(ids, "<u4").tobytes())] -= 1
    assert not any(crcs.values())
    assert sst.encode_and_read_back(empty_docs(spark)).isEmpty()


def test_shard_lookup():
    w, rows = sst.ShardWriter(3), []
    for i in range(0, 4000, 2):
        rows += list(w.add(sst.key_of(i, 0), np.arange(i % 50, dtype=np.uint32) + (70_000 if i % 3 == 0 else 0)))
    data = b"".join(x + b"\n" for x in [*rows, *w.close()])
    s = sst.Shard(data)
    assert len(s.index) > 1 and s.entries == 2000
    assert [sst.id_of(k) for k, _ in s] == list(range(0, 4000, 2))
    for i in (0, 2, 1998, 3998):
        assert [list(x) for x in s.get(i)] == [[j + (70_000 if i % 3 == 0 else 0) for j in range(i % 50)]]
    assert s.get(5) == [] and s.get(9999) == [] and s.get(None) == []
    bad = bytearray(data)
    bad[20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sst.Shard(bytes(bad)))


# 3 near-duplicates


def shingle_set(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] == texts[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            if same:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark):
    r, texts = random.Random(2), []
    base = prose(r, 150).split()
    for _ in range(60):  # one spectrum of near copies
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(9999))
        texts.append(" ".join(w))
    texts += [prose(r, r.choice([1, 3, 5, 40, 200])) for _ in range(60)] + ["", "", "!?", "same", "same"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    got = {x.doc_id: x.class_id for x in minhash.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_odd_rows(spark):
    df, texts = odd_docs(spark)
    got = minhash.classes(df).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == by[2] == by[8] == 1 and by[3] == by[4] == 3 and by[None] is None and by[5] == 5
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 0), (True, 1), (True, 3), (True, 5), (True, 6), (True, 7)]
    assert minhash.classes(empty_docs(spark)).isEmpty() and minhash.keep_one(empty_docs(spark)).isEmpty()


def test_probability_jaccard():
    def exact(a, b):
        return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())

    r = random.Random(4)
    for _ in range(50):
        a, b = ({k: r.randrange(1, 5) for k in r.sample(range(12), 8)} for _ in range(2))
        pack = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
        assert minhash._similar(*pack[0], *pack[1]) == pytest.approx(max(plain, exact(a, b)))
    doc = np.repeat([0, 1], 300)
    s = minhash.mix64(np.concatenate((np.arange(300), np.arange(60, 360))).astype(np.uint64) + np.uint64(1))
    regs = minhash.registers(doc, s, np.ones(600), 2)
    assert abs((regs[0] == regs[1]).mean() - 240 / 360) < 0.15


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)]
    r.shuffle(edges)
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# 4 mixing


def water_fill(sizes, weights, share, cap):
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total, out, left = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left:
        level = (total - sum(out[n] for n in names if n not in left)) / sum(w[n] for n in left)
        full = {n for n in left if w[n] * level > cap * sizes[n]}
        for n in full or left:
            out[n] = cap * sizes[n] if full else w[n] * level
        if not full:
            break
        left -= full
    return out


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, prose(r, r.randrange(1, 60)), "en", r.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    of = {i: s for i, _, _, s, _ in rows}
    total, taken = collections.Counter(), collections.Counter()
    for i in size:
        total[of[i]] += size[i]
    goal = water_fill(total, mixing.WEIGHTS, 1.5, 2.0)
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == total[of[x.doc_id]] and 0 <= x.copies <= 2
        assert x.target == pytest.approx(goal[of[x.doc_id]])
        taken[of[x.doc_id]] += x.copies * x.size
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal) and len(got) == 900
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(df.repartition(7)).collect()), key=repr)
    mixed = collections.Counter(x.doc_id for x in mixing.mix(df).collect())
    assert mixed == collections.Counter({x.doc_id: x.copies for x in got if x.copies})


def test_mixing_odd_rows(spark):
    df, texts = odd_docs(spark)
    assert mixing.plan(df).count() == len(texts)
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() > 0
    assert mixing.plan(empty_docs(spark)).isEmpty() and mixing.mix(empty_docs(spark)).isEmpty()


# 5 decontamination


def test_leaks_are_found(spark):
    r = random.Random(6)
    items = [(k, prose(r, 30)) for k in range(12)] + [(50, "short exact item"), (51, None), (52, "?!"), (3, prose(r, 30))]
    docs, planted = [], set()
    for i in range(60):
        body = prose(r, 150)
        if i % 3 == 0:
            k, t = items[i % 12]
            s = list(t)
            for _ in range(r.randrange(int(decontaminate.RATE * len(t)) - 2)):
                s[r.randrange(len(s))] = "z"
            body, _ = prose(r, 60) + " " + "".join(s).upper() + ", " + body, planted.add((i, k))
        docs.append((i, body))
    docs += [(100, "a Short,  exact ITEM."), (101, None), (102, ""), (103, items[0][1])]
    planted |= {(100, 50), (103, 0)}
    df, bench = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = decontaminate.leaks(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == planted
    whole = next(x for x in got if x.doc_id == 103)
    assert (whole.start, whole.end, whole.edits) == (0, len(items[0][1]), 0)
    rich = df.withColumn("edits", F.lit(1))
    assert {x.doc_id for x in decontaminate.clean(rich, bench).collect()} == {i for i, _ in docs} - {d for d, _ in planted}
    assert decontaminate.leaks(df, bench.limit(0)).isEmpty() and decontaminate.leaks(df.limit(0), bench).isEmpty()
    assert decontaminate.clean(odd_docs(spark)[0], bench).count() == len(odd_docs(spark)[1])


# 6 fingerprints


def slow_ranks(data):
    import math

    out = []
    for i in range(len(data) - 63):
        s = sum(round(c * math.log2(c) * 65536) for c in collections.Counter(data[i : i + 64]).values())
        e = ((6 * 65536 * 64 - s) * 1000) // (6 * 65536 * 64)
        out.append(1000 if e < fingerprint.LEAST else 999 - abs(e - fingerprint.TYPICAL))
    return out


def test_features_match_brute_force(monkeypatch):
    r = random.Random(8)
    texts = [prose(r, n) for n in (20, 60, 200)] + ["", "short", "a" * 200, "x" * 64]
    monkeypatch.setattr(fingerprint, "_SEGMENT", 100)
    coded = [t.encode() for t in texts]
    at, text = fingerprint._selected(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([len(c) for c in coded]))
    want, base = [], 0
    for k, c in enumerate(coded):
        ranks, wins = slow_ranks(c), collections.Counter()
        for g in range(len(ranks) - 63):
            wins[min(range(g, g + 64), key=lambda i: (ranks[i], i))] += 1
        some = [i for i in sorted(wins) if wins[i] >= fingerprint.POPULAR]
        if not some and ranks:
            some = [min(range(len(ranks)), key=lambda i: (ranks[i], i))]
        want += [(base + i, k) for i in some]
        base += len(c)
    assert list(zip(at.tolist(), text.tolist())) == want


def test_fingerprints_with_next(spark):
    df, _ = odd_docs(spark)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in fingerprint.with_next(df, part_bytes=300).collect())
    for k, (known, i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        f, g = fingerprint.fingerprints([t, n])
        got[i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.to_string(f), fingerprint.likeness(f, g)] -= 1
    assert not any(got.values())
    one = fingerprint.with_next(df.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and fingerprint.with_next(empty_docs(spark)).isEmpty()
    a = prose(random.Random(1), 400)
    f, g, h = fingerprint.fingerprints([a, a[:1000] + " inserted words " + a[1000:], prose(random.Random(2), 400)])
    assert fingerprint.likeness(f, g) > 0.8 > 0.2 > fingerprint.likeness(f, h) and fingerprint.likeness(f, g) == fingerprint.likeness(g, f)


# 7 lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a):
        q = [i + 1]
        for j, e in enumerate(b):
            q.append(min(p[j] + (c != e), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_line_join_matches_brute_force(spark):
    r, made = random.Random(9), []
    for _ in range(25):
        base = "".join(r.choice("ab cdé") for _ in range(r.randrange(24, 60)))
        for _ in range(4):
            s = list(base)
            for _ in range(r.randrange(4)):
                k = r.randrange(len(s))
                s[k : k + r.randrange(2)] = r.choice(["", "x", "yz"])
            made.append("".join(s))
    made += ["", "  ", "short", "short", made[0], made[0]]
    df = spark.createDataFrame([(i // 5, x) for i, x in enumerate(made)], "doc_id BIGINT, line STRING").groupBy("doc_id").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    distinct = sorted(set(made))
    near = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if min(len(a), len(b)) >= lines.MIN_CHARS and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    degree = collections.Counter(x for p in near for x in p)
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[find(a)] = find(b)
    where = collections.defaultdict(list)
    rows = {x.doc_id: x.text.split("\n") for x in df.collect()}
    for i, ls in rows.items():
        for k, x in enumerate(ls):
            where[find(x)].append((i, k))
    got = lines.classes(df).collect()
    assert len(got) == sum(map(len, rows.values())) and near
    for x in got:
        line = rows[x.doc_id][x.line_no]
        assert x.n_links == degree[line]
        assert (x.first_doc, x.first_line) == (min(where[find(line)]) if line.strip() else (None, None))
    text = {x.doc_id: x.text for x in lines.dedup(df).collect()}
    assert sum(len([y for y in t.split("\n") if y.strip()]) for t in text.values()) == len({find(x) for x in distinct if x.strip()})


def test_edits_equals_levenshtein(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("abc") for _ in range(r.randrange(9))), "".join(r.choice("abc") for _ in range(r.randrange(9)))) for _ in range(500)]
    df = spark.createDataFrame(rows, "a STRING, b STRING").withColumn("e", lines.edits(F.col("a"), F.col("b")))
    assert all(x.e == (d if (d := distance(x.a, x.b)) <= 2 else None) for x in df.collect())


def test_lines_odd_rows(spark):
    df, texts = odd_docs(spark)
    assert lines.classes(df).count() == sum(len((t or "").split("\n")) for t in texts)
    assert lines.classes(empty_docs(spark)).isEmpty()


# 8 toxicity


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity.init_params().items()}
    words = [b"alpha", b"be", b"gamma", b"x"]
    idx, real = np.array([[0, 1], [2, 3], [1, 0], [3, 2]]), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = np.array([1.0, 0.0])
    g, _ = toxicity._gradients(p, words, idx, real, y)
    r = np.random.default_rng(0)
    for k in p:
        flat = np.flatnonzero(g[k].reshape(-1))
        for at in r.choice(flat, min(3, len(flat)), replace=False):
            losses = []
            for d in (1e-2, -1e-2):
                q = {n: v.copy() for n, v in p.items()}
                q[k].reshape(-1)[at] += d
                losses.append(toxicity._gradients(q, words, idx, real, y)[1])
            assert g[k].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.08, abs=2e-4), k


def test_windows_cover_every_word():
    counts = np.array([0, 1, 64, 65, 112, 113, 1000])
    text, first, n = toxicity.windows_of(counts)
    starts = np.cumsum(counts) - counts
    for d, c in enumerate(counts):
        seen = {k for t, f, m in zip(text, first, n) if t == d for k in range(f, f + m)}
        assert seen == set(range(starts[d], starts[d] + c)) and (text == d).any()


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(11)
    rows = [(i, prose(r, 300)) for i in range(160)]
    rows = [(i, t.replace(" ", " vilk" + r.choice(["en", "or", "um"]) + " ", 6) if i % 2 else t) for i, t in rows]
    rows += [(1000, None), (1001, ""), (None, "x y"), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(160)] + [(5, 1, None), (None, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")
    return docs, labels


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, labels = toxic
    got = toxicity.score(docs, labels).withColumn("held", toxicity.is_held_out()).collect()
    assert len(got) == 164 and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held and x.doc_id is not None and x.doc_id < 160]
    assert held and all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert np.mean([(x.score >= 0.5) == (x.doc_id % 2 == 1) for x in held]) > 0.9
    flat = toxicity.score(docs, labels.limit(0)).collect()
    assert all(x.score == 0 for x in flat) and toxicity.score(docs.limit(0), labels).isEmpty()
    assert toxicity.reject(docs, labels.limit(0)).columns == docs.columns


# 9 language models


def test_cross_entropy_difference(spark):
    df, texts = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    got = lm.score(df, labels).collect()
    good = {i for i in (1, 8) if zlib.crc32(str(i).encode()) % 5}
    uni, bi = ([collections.Counter(), collections.Counter()] for _ in range(2))
    context = [collections.Counter(), collections.Counter()]
    for r in df.collect():
        for m in range(2):
            if m == 0 or r.doc_id in good:
                for v, w in zip([b"", *words_of(r.text)], words_of(r.text)):
                    uni[m][w] += 1
                    context[m][v] += 1
                    bi[m][v, w] += 1
    total = sum(uni[1].values())
    scale = (total / sum(uni[0].values()), 1)
    texts_of = collections.defaultdict(list)
    for r in df.collect():
        texts_of[r.doc_id].append(r.text)
    for x in got:
        ws = words_of(texts_of[x.doc_id][0])
        if x.doc_id is None or not ws:
            continue
        loss = [0.0, 0.0]
        for v, w in zip([b"", *ws], ws):
            for m in range(2):
                p1 = (uni[m][w] * scale[m] + 0.5) / (total + lm.UNI / 2)
                loss[m] -= np.log((bi[m][v, w] * scale[m] + lm.MU * p1) / (context[m][v] * scale[m] + lm.MU))
        assert x.n_tokens == len(ws)
        assert x.score == pytest.approx((loss[1] - loss[0]) / len(ws), rel=1e-3, abs=1e-3)
    assert all(x.score == 0 for x in got if not x.n_tokens) and len(got) == len(texts)
    assert lm.score(empty_docs(spark), labels).isEmpty() and all(abs(x.score) < 1e-9 for x in lm.score(df, labels.limit(0)).collect())


# 10 main text


PAGE = (
    '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>no</header><nav><ul><li><a href="/">no</a></li><li>no</li></ul></nav>'
    '<div class="cookie-notice">no</div><div id="main-ad" class="ad">no</div><!-- <p>no</p> --><article><h1>T &amp; T</h1><p>One <b>two</b>&nbsp;\n three.<p>Four<br>five &lt;x&gt;</p>{more}<div class="share">no</div>'
    '<form><p>no</p></form><section class="comments"><article class="comment"><p>no</p></article></section></article><aside>no</aside><footer>no</footer></body></html>'
)
TEXT = "T & T\n\nOne two three.\n\nFour five <x>"


def test_main_text(spark):
    rows = [(k, f"https://a.example/{k}", PAGE.replace("{more}", f"<p>p{k}</p>" * (k % 4) + ("<ul><li>item</li></ul>" if k % 3 == 0 else ""))) for k in range(20)]
    rows += [(50, "http://b.example", None), (51, None, ""), (52, "nonsense", "plain <b>text"), (53, "http://b.example/x", "<p title='a>b'>x</p><div>y"), (53, "http://b.example/x", "<p>x"), (54, "http://c.example", "<article><p>cut &am")]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("host", F.lit(1)).withColumn("wrapper", F.lit(1))
    got = collections.defaultdict(list)
    for r in wrappers.extract(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    for k in range(20):
        assert got[k] == [TEXT + f"\n\np{k}" * (k % 4) + ("\n\nitem" if k % 3 == 0 else "")]
    assert got[50] == [""] and got[51] == [""] and got[52] == ["plain text"] and sorted(got[53]) == ["x", "x\n\ny"] and got[54] == ["cut &am"]
    made = {r.host: r for r in wrappers.wrappers(df).collect()}
    assert made["a.example"].n_pages == 20 and "+" in made["a.example"].wrapper
    assert wrappers.extract(df.limit(0)).isEmpty()


def test_wrappers_align():
    a, b = wrappers.fold("ul li # /li li # /li /ul p # /p".split()), wrappers.fold("ul li # /li /ul h2 # /h2 p # /p p # /p".split())
    w = wrappers.infer([a, b])
    assert "(li # /li)+" in wrappers.expression(a) and "(h2)?" in wrappers.expression(w)
    for page in ("ul li # /li li # /li li # /li /ul p # /p", "ul li # /li /ul h2 # /h2 p # /p p # /p p # /p"):
        nodes = wrappers.aligned(w, wrappers.fold(page.split())) if wrappers.fold(page.split()) in (a, b) else wrappers.fold(page.split())
        assert wrappers.main_slots(nodes, page.split()) == [t == "#" for t in page.split() if t in "#%"]


def test_real_pages_match_a_plain_reading(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    plain = {}
    for r in rows.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
        plain[r.page_id] = "\n\n".join(x for x in (" ".join(html_.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if x)
    assert {r.page_id: r.text for r in wrappers.extract(rows).collect()} == plain
