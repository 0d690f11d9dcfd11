"""Texts with very long words are scored whole, in bounded memory."""

import random
import tracemalloc

import numpy as np
from test_llm import prose

from tidewell.llm import toxicity
from tidewell.llm._common import words_of


def test_long_words_are_cut_into_units():
    r = random.Random(1)
    texts = ["ab " * 5, "", "x" * 200 + " end", prose(r, 30) + " " + "é" * 500, "x" * 64 + " " + "x" * 65]
    codes, counts, words = toxicity.units(texts)
    at = 0
    for t, n in zip(texts, counts):
        want = [w[i : i + toxicity.UNIT] for w in words_of(t) for i in range(0, len(w), toxicity.UNIT)]
        assert [words[c] for c in codes[at : at + n]] == want
        at += n
    assert at == len(codes) and max(map(len, words)) <= toxicity.UNIT


def test_memory_of_a_word_of_a_million_characters():
    p, r = toxicity.init_params(), random.Random(2)
    text = "".join(r.choice("abcdefgh") for _ in range(1_000_000)) + " " + prose(r, 500)
    tracemalloc.start()
    found = toxicity.score_texts(p, [text, "short", None])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and len(found) == 3 and np.isfinite(found).all()
    assert found[1] == toxicity.score_texts(p, ["short"])[0]


def test_scores_equal_a_plain_network():
    """The network's windows one by one and step by step, as written in its equations."""
    p, r = toxicity.init_params(3), random.Random(4)
    p = {k: v.astype(np.float64) for k, v in p.items()}

    def gru(xs, name, h):
        s = np.zeros(h)
        for x in xs:
            g, a = x @ p[name + "W"] + p[name + "B"], s @ p[name + "U"]
            reset, update = (1 / (1 + np.exp(-(g[k * h : (k + 1) * h] + a[k * h : (k + 1) * h]))) for k in (0, 1))
            n = np.tanh(g[2 * h :] + reset * a[2 * h :])
            s = (1 - update) * n + update * s
            yield s

    def vector(w):
        chars = [p["Ec"][b] for b in w]
        return np.concatenate((p["Ew"][toxicity._buckets([w])[0]], list(gru(chars, "cf", toxicity.CHAR_H))[-1], list(gru(chars[::-1], "cb", toxicity.CHAR_H))[-1]))

    def slow(text):
        ws, best = words_of(text), -np.inf
        starts = range(0, max(1, len(ws) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        for at in sorted({min(s, max(0, len(ws) - toxicity.WINDOW)) for s in starts}):
            xs = [vector(w) for w in ws[at : at + toxicity.WINDOW]]
            hs = np.concatenate((list(gru(xs, "wf", toxicity.H)), list(gru(xs[::-1], "wb", toxicity.H))[::-1]), 1)
            e = np.tanh(hs @ p["aW"] + p["aB"]) @ p["aV"]
            a = np.exp(e - e.max())
            best = max(best, float((a / a.sum()) @ hs @ p["oW"] + p["oB"][0]))
        return 1 / (1 + np.exp(-best))

    texts = [prose(r, n) for n in (1, 5, 64, 65, 150)]
    assert np.allclose(toxicity.score_texts(p, texts), [slow(t) for t in texts], atol=2e-4)
