"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 8).

Inputs of a word: a hashed word embedding and the two end states of a character-level bidirectional GRU over its
bytes. A second bidirectional GRU runs over windows of words; attention pools its states into one logit. A document's
score is the highest of its overlapping windows (`WINDOW` words every `STRIDE`; the last window ends with the text).

Training is numpy on the driver, on a bounded sample of labelled rows (`MAX_TOXIC` and `MAX_CLEAN` different texts,
chosen by a hash of the row), with all their windows. A label holds for a document, not a window, so after a first pass
over random windows the loss is taken at each document's highest window, chosen anew each epoch (multiple-instance
learning); it stops early once the mean loss of an epoch is under `ENOUGH`. Scoring covers every word of every text.

A word of more than `UNIT` bytes (base64, scripts without spaces) is read as words of `UNIT` bytes, so memory is
bounded by the piece of text at hand. Null or empty text has no words and is scored as a window of padding. Without
labels of both kinds the network stays untrained and every score is the share of toxic labels (0 where there are none).
Repeated rows have the same score and are one training row; of several labels of a doc_id the highest holds. An empty
table gives no scores. `score` ignores extra columns, `reject` keeps them, whatever their names.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_by_bytes, text_or_empty, word_codes

WINDOW, STRIDE = 64, 48
MAX_TOXIC, MAX_CLEAN, UNIT = 900, 1600, 64
BUCKETS, WORD_DIM, CHAR_DIM, CHAR_H, H = 4096, 8, 12, 16, 8
EPOCHS, BATCH, RATE, ENOUGH = 12, 32, 0.01, 0.005
_PAD_GATE = 30.0  # as update gate: keeps the state over padding


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init_params(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"Ew": r.normal(0, 0.3, (BUCKETS, WORD_DIM)), "Ec": r.normal(0, 0.5, (256, CHAR_DIM))}
    for name, d, h in (("cf", CHAR_DIM, CHAR_H), ("cb", CHAR_DIM, CHAR_H), ("wf", WORD_DIM + 2 * CHAR_H, H), ("wb", WORD_DIM + 2 * CHAR_H, H)):
        p |= {name + "W": r.normal(0, d**-0.5, (d, 3 * h)), name + "U": r.normal(0, h**-0.5, (h, 3 * h)), name + "B": np.zeros(3 * h)}
    p |= {"aW": r.normal(0, 0.3, (2 * H, 2 * H)), "aB": np.zeros(2 * H), "aV": r.normal(0, 0.3, 2 * H), "oW": r.normal(0, 0.3, 2 * H), "oB": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _gru(G: np.ndarray, U: np.ndarray, keep: bool = False):
    """States over G (time, batch, 3h: reset, update, candidate, with input and bias added); keep: for _gru_back."""
    T, B, h3 = G.shape
    h = h3 // 3
    hs, s, saved = np.empty((T, B, h), np.float32), np.zeros((B, h), np.float32), []
    for t in range(T):
        a = s @ U
        rz = _sigmoid(G[t, :, : 2 * h] + a[:, : 2 * h])
        n = np.tanh(G[t, :, 2 * h :] + rz[:, :h] * a[:, 2 * h :])
        if keep:
            saved.append((s, a[:, 2 * h :], rz, n))
        s = n + rz[:, h:] * (s - n)
        hs[t] = s
    return hs, saved


def _gru_back(dhs: np.ndarray, U: np.ndarray, saved) -> tuple[np.ndarray, np.ndarray]:
    T, B, h = dhs.shape
    dG, dU, ds = np.empty((T, B, 3 * h), np.float32), np.zeros_like(U), np.zeros((B, h), np.float32)
    for t in range(T - 1, -1, -1):
        s, an, rz, n = saved[t]
        r, z = rz[:, :h], rz[:, h:]
        ds = ds + dhs[t]
        dn = ds * (1 - z) * (1 - n * n)
        dz = ds * (s - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dG[t] = np.concatenate((dr, dz, dn), 1)
        da = np.concatenate((dr, dz, dn * r), 1)
        dU += s.T @ da
        ds = ds * z + da @ U.T
    return dG, dU


def _chars(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words as (length, words), and where they are padding."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), max(1, int(n.max(initial=1)))), np.uint8)
    real = np.arange(out.shape[1])[None, :] < n[:, None]
    out[real] = np.frombuffer(b"".join(words), np.uint8)
    return out.T, ~real.T


def _char_gates(p, name: str, chars, pad):
    G = (p["Ec"] @ p[name + "W"] + p[name + "B"]).astype(np.float32)[chars]
    G[pad, CHAR_H : 2 * CHAR_H] = _PAD_GATE
    return G


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))


def word_vectors(p, words: list[bytes]) -> np.ndarray:
    """Input vectors of distinct words; words of like length are run together."""
    out = np.empty((len(words), WORD_DIM + 2 * CHAR_H), np.float32)
    out[:, :WORD_DIM] = p["Ew"][_buckets(words)]
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for lo in range(0, len(order), 8192):
        at = order[lo : lo + 8192]
        chars, pad = _chars([words[i] for i in at])
        out[at, WORD_DIM : WORD_DIM + CHAR_H] = _gru(_char_gates(p, "cf", chars, pad), p["cfU"])[0][-1]
        out[at, WORD_DIM + CHAR_H :] = _gru(_char_gates(p, "cb", chars[::-1], pad[::-1]), p["cbU"])[0][-1]
    return out


def units(texts: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """As word_codes, with words of more than UNIT bytes cut into such of UNIT bytes."""
    codes, counts, words = word_codes(texts)
    size = np.fromiter((-(-len(w) // UNIT) for w in words), np.int64, len(words))
    if not (size > 1).any():
        return codes, counts, words
    seen: dict[bytes, int] = {}
    parts = [[seen.setdefault(w[i : i + UNIT], len(seen)) for i in range(0, len(w), UNIT)] for w in words]
    flat, first, per = np.fromiter(chain.from_iterable(parts), np.int64), np.cumsum(size) - size, size[codes]
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    total = np.bincount(np.repeat(np.arange(len(counts)), counts), per, len(counts)).astype(np.int64)
    return flat[np.repeat(first[codes], per) + place], total, list(seen)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: each window's text, first word (over all texts), and words it has."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    per = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return text, first[text] + start, np.minimum(counts[text], WINDOW)


def window_logits(p, codes: np.ndarray, words: list[bytes], first: np.ndarray, n: np.ndarray) -> np.ndarray:
    V = word_vectors(p, words) if words else np.zeros((0, WORD_DIM + 2 * CHAR_H), np.float32)
    pad = np.zeros((1, 3 * H), np.float32)
    pad[0, H : 2 * H] = _PAD_GATE
    gates = [np.concatenate((V @ p[d + "W"] + p[d + "B"], pad)) for d in ("wf", "wb")]
    codes = np.concatenate((codes, np.full(WINDOW, len(words), np.int64)))
    out = np.empty(len(first), np.float32)
    for lo in range(0, len(first), 2048):
        a, m = first[lo : lo + 2048], n[lo : lo + 2048]
        steps = np.arange(max(1, int(m.max())))
        real = steps[:, None] < m[None, :]
        idx = np.where(real, codes[np.minimum(a[None, :] + steps[:, None], len(codes) - 1)], len(words))
        f = _gru(gates[0][idx], p["wfU"])[0]
        b = _gru(gates[1][idx[::-1]], p["wbU"])[0][::-1]
        hs = np.concatenate((f, b), 2)
        e = np.tanh(hs @ p["aW"] + p["aB"]) @ p["aV"]
        e = np.where(real | (m == 0)[None, :], e, -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        out[lo : lo + 2048] = np.einsum("tb,tbh->bh", w, hs) @ p["oW"] + p["oB"]
    return out


def score_texts(p, texts: list) -> np.ndarray:
    """Score of each text, 0 to 1."""
    if "base" in p:
        return np.full(len(texts), float(p["base"]))
    out = np.empty(len(texts))
    for lo, hi in pieces_by_bytes(texts, 1_000_000):
        codes, counts, words = units(texts[lo:hi])
        text, first, n = windows_of(counts)
        best = np.full(hi - lo, -np.inf, np.float32)
        np.maximum.at(best, text, window_logits(p, codes, words, first, n))
        out[lo:hi] = _sigmoid(best.astype(np.float64))
    return out


def _gradients(p, words: list[bytes], idx: np.ndarray, real: np.ndarray, y: np.ndarray):
    """Loss and its gradients over windows idx (time, batch) of codes into words."""
    chars, pad = _chars(words)
    cf, sf = _gru(_char_gates(p, "cf", chars, pad), p["cfU"], True)
    cb, sb = _gru(_char_gates(p, "cb", chars[::-1], pad[::-1]), p["cbU"], True)
    bucket = _buckets(words)
    V = np.concatenate((p["Ew"][bucket], cf[-1], cb[-1]), 1)
    X = V[idx]
    saved, states = {}, []
    for d, step in (("wf", 1), ("wb", -1)):
        G = X[::step] @ p[d + "W"] + p[d + "B"]
        G[~real[::step], H : 2 * H] = _PAD_GATE
        hs, saved[d] = _gru(G, p[d + "U"], True)
        states.append(hs[::step])
    hs = np.concatenate(states, 2)
    u = np.tanh(hs @ p["aW"] + p["aB"])
    e = np.where(real, u @ p["aV"], -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbh->bh", w, hs)
    prob = _sigmoid(pooled @ p["oW"] + p["oB"])
    dl = ((prob - y) / len(y)).astype(np.float32)
    g = {"oW": pooled.T @ dl, "oB": dl.sum(keepdims=True)}
    dp = dl[:, None] * p["oW"]
    dw = np.einsum("tbh,bh->tb", hs, dp)
    de = w * (dw - (w * dw).sum(0))
    g["aV"] = np.einsum("tb,tbh->h", de, u)
    du = de[:, :, None] * p["aV"] * (1 - u * u)
    g["aW"], g["aB"] = np.einsum("tbi,tbj->ij", hs, du), du.sum((0, 1))
    dhs = w[:, :, None] * dp[None] + du @ p["aW"].T
    dX = np.zeros_like(X)
    for k, (d, step) in enumerate((("wf", 1), ("wb", -1))):
        dG, g[d + "U"] = _gru_back(dhs[::step, :, k * H : (k + 1) * H], p[d + "U"], saved[d])
        dG[~real[::step], H : 2 * H] = 0
        flat = dG.reshape(-1, 3 * H)
        g[d + "W"], g[d + "B"] = X[::step].reshape(-1, X.shape[2]).T @ flat, flat.sum(0)
        dX[::step] += (flat @ p[d + "W"].T).reshape(X.shape)
    dV = np.zeros_like(V)
    np.add.at(dV, idx[real], dX[real])
    g["Ew"] = np.zeros_like(p["Ew"])
    np.add.at(g["Ew"], bucket, dV[:, :WORD_DIM])
    g["Ec"] = np.zeros_like(p["Ec"])
    for d, step, s, at in (("cf", 1, sf, WORD_DIM), ("cb", -1, sb, WORD_DIM + CHAR_H)):
        dhs = np.zeros((*chars.shape, CHAR_H), np.float32)
        dhs[-1] = dV[:, at : at + CHAR_H]
        dG, g[d + "U"] = _gru_back(dhs, p[d + "U"], s)
        mask = ~pad[::step]
        dG[~mask] = 0
        flat, c = dG[mask], chars[::step][mask]
        g[d + "B"] = flat.sum(0)
        by = np.zeros((256, 3 * CHAR_H), np.float32)
        np.add.at(by, c, flat)
        g[d + "W"] = p["Ec"].T @ by
        g["Ec"] += by @ p[d + "W"].T
    return g, float(-np.log(np.where(y == 1, prob, 1 - prob) + 1e-9).mean())


def train(texts: list, labels: list[int], seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the network; {"base": share} where there are not two kinds of labels."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"base": np.float64(y.mean() if len(y) else 0)}
    r, p = np.random.default_rng(seed), init_params(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    codes, counts, words = units(texts)
    text, first, n = windows_of(counts)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rounds = max(EPOCHS, int(np.ceil(220 / (2 * max(len(pos), len(neg)) / BATCH))))
    half = BATCH // 2
    for epoch in range(rounds):
        # each document is held to its highest window so far; at first to any
        rank = window_logits(p, codes, words, first, n) if epoch else r.random(len(text))
        order = np.lexsort((rank, text))
        top = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
        size, loss = max(len(pos), len(neg)), []
        a, b = (np.resize(r.permutation(x), size) for x in (pos, neg))
        for lo in range(0, size, half):
            docs = np.concatenate((a[lo : lo + half], b[lo : lo + half]))
            chosen = top[docs]
            k = n[chosen]
            real = np.arange(WINDOW)[:, None] < k[None, :]
            idx = codes[np.minimum(first[chosen][None, :] + np.arange(WINDOW)[:, None], max(len(codes) - 1, 0))] if len(codes) else np.zeros(real.shape, np.int64)
            some = k > 0
            if not some.any():
                continue
            span, inv = np.unique(np.where(real, idx, idx[0]), return_inverse=True)
            g, now = _gradients(p, [words[i] for i in span], inv.reshape(idx.shape)[:, some], real[:, some], y[docs][some])
            loss.append(now)
            step += 1
            for key in p:
                grad = np.clip(g[key], -1, 1).astype(np.float32)
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.99 * v[key] + 0.01 * grad * grad
                p[key] -= RATE * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)
        if epoch > 1 and loss and np.mean(loss) < ENOUGH:
            break
    # the bias that makes the fewest errors on whole training texts, in the middle of where it does
    best = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(best, text, window_logits(p, codes, words, first, n))
    order = np.argsort(best)
    cuts = np.concatenate(([best[order[0]] - 1], (best[order][1:] + best[order][:-1]) / 2, [best[order[-1]] + 1]))
    errors = np.concatenate(([0], np.cumsum(y[order]))) + (len(neg) - np.concatenate(([0], np.cumsum(1 - y[order]))))
    p["oB"] -= np.median(cuts[errors == errors.min()])
    return p


def is_held_out():
    """Rows kept from training, by crc32 of the identifier's text."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Train on a bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    # texts are only hashed here; those of the chosen rows are read afterwards
    order = F.xxhash64("doc_id", text_or_empty())
    rows = docs.where(~is_held_out()).select("doc_id", order.alias("_order")).distinct().join(known, "doc_id")
    got = []
    for toxic, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        chosen = [r[0] for r in rows.where(F.col("_toxic") == toxic).select("_order").orderBy("_order").limit(most).collect()]
        if chosen:  # bounded by the parameters above, however often a row is repeated
            texts = docs.select("doc_id", text_or_empty().alias("t"), order.alias("_order")).where(F.col("_order").isin(chosen))
            got += texts.groupBy("_order").agg(F.first("doc_id").alias("doc_id"), F.first("t").alias("t")).select("doc_id", "t", F.lit(toxic)).collect()
    got.sort(key=lambda x: (zlib.crc32(str(x[0]).encode()), x[1]))
    return train([x[1] for x in got], [x[2] for x in got])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of docs."""
    params = fit(docs, labels)

    def run(batches):
        for b in batches:
            out = score_texts(params, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    params, at = fit(docs, labels), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score_texts(params, b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
