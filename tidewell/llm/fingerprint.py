"""Improbable-feature digests of documents (operator 6).

A feature is a window of 64 bytes. Its entropy, in thousandths of the 6 bits it can have, gives its rank: the further
from `TYPICAL` (the entropy of running prose), the rarer, the lower the rank; a window under `LEAST` (runs of one
byte) is never preferred. Among any 64 neighbouring features the leftmost of lowest rank wins; features that win
`POPULAR` times or more are selected. Distinct selected features go, in order, into a chain of Bloom filters of 2048
bits, 5 bits a feature, `PER_FILTER` features each. Likeness takes for each filter of the shorter chain its best match
in the longer one, as overlap beyond what chance gives over the most that it could be, and averages.

Digests depend on the text alone. A text under 64 bytes is one feature, padded; one whose windows win too seldom has
its best window; an empty or null text has an empty digest, which is like another empty one only. Memory is bounded
for any text length: the selection runs over segments.

`with_next` compares each document with the next in (doc_id, text) order, null doc_id first, the last with the first.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix64, pieces_by_bytes, text_or_empty

W, POPULAR, PER_FILTER, BITS, TYPICAL, LEAST = 64, 16, 160, 2048, 690, 100
_SEGMENT = 1 << 17
_G = np.array([round(c * math.log2(c) * 65536) if c else 0 for c in range(W + 2)], np.int64)
_OUT, _IN = _G[:-1] - np.concatenate(([0], _G[:-2])), _G[:-1] - np.concatenate(([0], _G[:-2]))


def ranks(x: np.ndarray) -> np.ndarray:
    """Rank of the window at each byte of x that has a whole one; lower is rarer."""
    n = len(x) - W + 1
    ahead, behind = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
    for d in range(1, W):
        same = (x[d:] == x[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    s = np.empty(n, np.int64)
    s[0] = _G[np.bincount(x[:W], minlength=256)].sum()
    s[1:] = _IN[behind[W:]] - _OUT[ahead[: n - 1]]
    np.cumsum(s, out=s)
    e = ((6 * 65536 * W - s) * 1000) // (6 * 65536 * W)
    return np.where(e < LEAST, 1000, 999 - np.abs(e - TYPICAL)).astype(np.int32)


def _selected(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the selected windows over joined texts that end at `ends`, and the text of each."""
    starts = np.concatenate(([0], ends[:-1]))
    wins = np.zeros(len(data), np.uint8)
    # groups of W features that lie in one text: they start before its end - 2 W + 1
    for a in range(0, len(data) - 2 * W + 2, _SEGMENT):
        b = min(a + _SEGMENT, len(data) - 2 * W + 2)
        r = ranks(data[a : b + 2 * W - 2])
        key = (r.astype(np.int64) << 32) | np.arange(len(r))
        for step in (1, 2, 4, 8, 16, 32):
            key = np.minimum(key[:-step], key[step:])
        text = np.searchsorted(ends, np.arange(a, b), "right")
        inside = np.arange(a, b) + 2 * W - 2 < ends[text]
        won = (key[: b - a] & 0xFFFFFFFF)[inside]
        wins[a : b + W] += np.bincount(won, minlength=b - a + W)[: len(wins) - a][: b - a + W].astype(np.uint8)
    at = np.flatnonzero(wins >= POPULAR)
    text = np.searchsorted(ends, at, "right")
    has = np.zeros(len(ends), bool)
    has[text] = True
    extra = []
    for k in np.flatnonzero(~has & (ends - starts >= W)):
        best, place = 1 << 30, 0
        for a in range(starts[k], ends[k] - W + 1, _SEGMENT):
            r = ranks(data[a : min(a + _SEGMENT + W - 1, ends[k])])
            if r.min() < best:
                best, place = r.min(), a + int(r.argmin())
        extra.append((place, k))
    if extra:
        at, text = np.append(at, [x for x, _ in extra]), np.append(text, [k for _, k in extra])
        order = np.argsort(at, kind="stable")
        at, text = at[order], text[order]
    return at, text


def _hash(features: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of W bytes."""
    words, h = np.ascontiguousarray(features).view(np.uint64), np.zeros(len(features), np.uint64)
    for k in range(words.shape[1]):
        h = mix64(h * np.uint64(0x100000001B3) ^ words[:, k] + np.uint64(k + 1))
    return h


def filters(texts: list[str]) -> list[np.ndarray]:
    """Chained Bloom filters of each text: (filters, 256) bytes."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(c) for c in coded])
    data = np.frombuffer(b"".join(coded), np.uint8)
    at, text = _selected(data, ends) if len(data) >= W else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parts = [_hash(data[at[i : i + 65536, None] + np.arange(W)]) for i in range(0, len(at), 65536)]
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    short = [i for i, c in enumerate(coded) if 0 < len(c) < W]
    if short:
        padded = np.frombuffer(b"".join(coded[i].ljust(W, b"\0") for i in short), np.uint8).reshape(-1, W)
        h, text = np.append(h, _hash(padded)), np.append(text, short)
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    # the first of each text's equal features
    order = np.lexsort((np.arange(len(h)), h, text))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    keep = np.sort(order[first])
    h, text = h[keep], text[keep]
    count = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    per = -(-count // PER_FILTER)
    base = np.cumsum(per) - per
    bits = np.zeros((int(per.sum()), BITS), np.uint8)
    row = base[text] + place // PER_FILTER
    for k in range(5):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + n] for b, n in zip(base, per)]


def to_string(f: np.ndarray) -> str:
    return base64.b64encode(f.tobytes()).decode()


def likeness(f: np.ndarray, g: np.ndarray) -> float:
    if not len(f) or not len(g):
        return float(len(f) == len(g))
    if f.shape == g.shape and (f == g).all():
        return 1.0
    # from the shorter chain's side, and both ways when they are as long, so that likeness is symmetric
    if len(f) == len(g):
        return 0.5 * (_one_way(f, g) + _one_way(g, f))
    return _one_way(f, g) if len(f) < len(g) else _one_way(g, f)


def _one_way(f: np.ndarray, g: np.ndarray) -> float:
    total, other = 0.0, np.unpackbits(g, axis=1).astype(np.float32)
    n2 = other.sum(1)
    for lo in range(0, len(f), 256):
        bits = np.unpackbits(f[lo : lo + 256], axis=1).astype(np.float32)
        n1 = bits.sum(1)[:, None]
        chance, most = n1 * n2 / BITS, np.minimum(n1, n2)
        cut = chance + 0.3 * np.maximum(most - chance, 0)
        score = np.clip((bits @ other.T - cut) / np.maximum(most - cut, 1e-6), 0, 1)
        total += float(score.max(1).sum())
    return total / len(f)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi in pieces_by_bytes(texts, 1_000_000):
        out += filters(texts[lo:hi])
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, part_bytes: int = 4_000_000) -> DataFrame:
    """Digest of every document and of its edited text, and how like they and the next document are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total, least, nulls = rows.agg(F.sum(F.octet_length("text") + 16), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(20_000, math.ceil((total or 0) / part_bytes)))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 100_000)).first()[0] or []
    cuts = np.array(sorted({c for c in cuts if nulls or c != least}), np.int64)  # each opens a part, with a row of its own
    opens = -1 if nulls else least

    def deal(batches):
        for b in batches:
            ids = b.column(0)
            real = np.array(ids.is_valid())
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(real, np.searchsorted(cuts, values, "right"), 0)
            # the row that opens a part also ends the part before it; the very first ends the last
            again = np.flatnonzero(real & np.isin(values, cuts))
            first = np.flatnonzero(~real if nulls else values == opens)
            take = np.concatenate((np.arange(len(part)), again, first))
            to = np.concatenate((part, part[again] - 1, np.full(len(first), len(cuts))))
            kind = np.concatenate((np.zeros(len(part), np.int32), np.ones(len(again) + len(first), np.int32)))
            t = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind), t.column(0), t.column(1)], ["part", "kind", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "part int, kind int, doc_id long, text string")
    dealt = dealt.repartition(max(1, math.ceil(parts / 4)), "part").sortWithinPartitions("part", "kind", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        part, ids, texts, ended = None, [], [], False

        def out(last: bool):
            """Rows of what is held but its last, which waits for the one after it."""
            nonlocal ids, texts
            if len(texts) < 2:
                return
            new = [edited(a, b) for a, b in zip(texts, texts[1:])]
            found = fingerprints([*texts, *new])
            own, theirs = found[: len(texts)], found[len(texts) :]
            cols = [
                ids[:-1],
                [len(t) for t in texts[:-1]],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
                [to_string(f) for f in own[:-1]],
                [to_string(f) for f in theirs],
                [likeness(f, g) for f, g in zip(own, theirs)],
                [likeness(f, g) for f, g in zip(own, own[1:])],
            ]
            ids, texts = ids[-1:], texts[-1:]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        size = 0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                for p, kind, doc_id, text in zip(*(s.column(k).to_pylist() for k in range(4))):
                    if p != part:
                        yield from out(True)
                        part, ids, texts, ended, size = p, [], [], False, 0
                    if ended:
                        continue
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                    ended = kind == 1
                    if size > 2_000_000:
                        yield from out(False)
                        size = 0
        yield from out(True)

    return dealt.mapInArrow(run, SCHEMA)
