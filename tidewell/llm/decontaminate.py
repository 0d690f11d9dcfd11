"""Benchmark decontamination by the q-gram lemma (operator 5).

Texts and benchmark items are compared as lower-case letters and digits with single spaces between words. A region
that is an item with at most k edits (k = `RATE` of its length) shares at least m - q + 1 - k q of the item's m - q + 1
q-grams with it, all within k of one diagonal. So a text's shared q-grams are counted in diagonal bands of width 2w
that overlap by half (w is over the item's k), bands under the bound are dropped, and the rest are verified by an
alignment that stays within the band, items of like length together.

The benchmark is a stated query set: it goes to the executors in blocks of at most `BLOCK_CHARS` characters, each
block against all rows. Items shorter than `MIN_CHARS` once normalised match only as exact whole words; items without
letters or digits match nothing. Null and empty texts contain nothing. Repeated items are reported under each item_id,
repeated rows each on their own. Very long texts are searched whole, each in a piece of its own; of two regions of a text
with as few edits the first found counts. Empty tables give no leaks. `leaks` ignores extra columns, `clean` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty

Q, RATE, MIN_CHARS, BLOCK_CHARS = 8, 0.08, 40, 2_000_000
_BITS = 22


def _fold() -> np.ndarray:
    """Code point (below 0x3000) to its lower case if a letter or digit, else a space."""
    out = np.arange(0x3000, dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        low = ch.lower()
        out[c] = ord(low[0]) if ch.isalnum() else 32
    return out


_FOLD = _fold()


def normalise(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of folded code points, each ended by a 0; their origin in the texts' joint code points; ends."""
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(lens) - 1
    c = np.where(raw < 0x3000, _FOLD[np.minimum(raw, 0x2FFF)], raw).astype(np.uint32)
    c[ends] = 0
    space = c == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & (c[:-1] != 0)
    if len(keep):
        keep[0] = not space[0]
    at = np.flatnonzero(keep)
    c = c[at]
    return c, at, np.flatnonzero(c == 0)


def _grams(c: np.ndarray) -> np.ndarray:
    n = max(0, len(c) - Q + 1)
    h = np.zeros(n, np.uint32)
    for k in range(Q):
        h = h * np.uint32(0x01000193) ^ c[k : k + n] * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


class Benchmark:
    """A block of items, indexed by q-gram."""

    def __init__(self, items: list[tuple[int, str]]):
        rows = []
        for item_id, text in items:
            c, _, _ = normalise([text or ""])
            c = c[:-1]
            c = c[: len(c) - 1] if len(c) and c[-1] == 32 else c
            if len(c):
                rows.append((item_id, c))
        self.short = [(i, c) for i, c in rows if len(c) < MIN_CHARS]
        rows = [(i, c) for i, c in rows if len(c) >= MIN_CHARS]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.codes = [c for _, c in rows]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.floor(RATE * self.size).astype(np.int64)
        self.bound = self.size - Q + 1 - self.edits * Q
        self.width = self.edits + 1
        g = [_grams(c) for c in self.codes]
        h = np.concatenate(g) if g else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        self.gram = h[order]
        self.item = np.repeat(np.arange(len(g)), [len(x) for x in g])[order] if g else np.zeros(0, np.int64)
        self.at = (np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64))[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.gram >> np.uint32(32 - _BITS)] = True

    def find(self, texts: list) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, start, end, edits): for each text and item its best region within the edit budget."""
        c, origin, ends = normalise(texts)
        found: dict[tuple[int, int], tuple] = {}
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        base = np.cumsum([0] + [len(t) + 1 for t in texts])

        def put(doc, item_id, a, b, edits):
            if (old := found.get((doc, item_id))) is None or edits < old[2]:
                found[doc, item_id] = (int(origin[a] - base[doc]), int(origin[b - 1] - base[doc]) + 1, int(edits))

        if self.short:
            joined = [" " + c[a:b].tobytes().decode("utf-32-le", "surrogatepass").strip() + " " for a, b in zip(starts, ends)]
            for item_id, code in self.short:
                needle = " " + code.tobytes().decode("utf-32-le", "surrogatepass") + " "
                for d, t in enumerate(joined):
                    if (k := t.find(needle)) >= 0:
                        lead = int(len(t) > 2 and c[starts[d]] == 32)
                        put(d, item_id, starts[d] + k + lead, starts[d] + k + lead + len(code), 0)
        h = _grams(c)
        hit = np.flatnonzero(self.maybe[h >> np.uint32(32 - _BITS)])
        lo = np.searchsorted(self.gram, h[hit])
        n = np.searchsorted(self.gram, h[hit], "right") - lo
        hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
        if len(hit):
            pos = np.repeat(hit, n)
            row = np.repeat(lo, n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
            item, diag = self.item[row], pos - self.at[row]
            # q-grams that hold the 0 after a text match nothing, so a match never spans two texts; a band may, so texts are counted apart
            text = np.searchsorted(ends, pos)
            todo = set()
            width = self.width[item]
            for half in (0, 1):
                band = (diag + half * width) // (2 * width)
                order = np.lexsort((band, text, item))
                i, d, b = item[order], text[order], band[order]
                new = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (b[1:] != b[:-1]))))
                # a place that matches an item twice in a band still counts twice: more is kept, never less
                count = np.diff(np.append(new, len(i)))
                for k in new[count >= np.maximum(self.bound[i[new]], 1)]:
                    todo.add((int(i[k]), int(b[k]) * 2 * int(self.width[i[k]]) - half * int(self.width[i[k]]), int(d[k])))
            self._verify(c, starts, ends, sorted(todo), put)
        return [(d, i, *v) for (d, i), v in sorted(found.items())]

    def _verify(self, c, starts, ends, todo, put):
        """Alignments of items along bands of 2 * width diagonals, many at a time: items within twice the length of the shortest."""
        todo, none = sorted(todo, key=lambda x: (self.size[x[0]], x)), 1 << 30
        cuts = [0]
        for k, (i, _, _) in enumerate(todo):
            if k - cuts[-1] >= 256 or self.size[i] > 2 * self.size[todo[cuts[-1]][0]]:
                cuts.append(k)
        for lo, hi in zip(cuts, [*cuts[1:], len(todo)]):
            part = todo[lo:hi]
            if not part:
                continue
            m = np.array([self.size[i] for i, _, _ in part])
            w = 2 * int(max(self.width[i] for i, _, _ in part))
            first = np.array([d for _, d, _ in part])
            a, b = starts[[d for *_, d in part]], ends[[d for *_, d in part]]
            pattern = np.zeros((len(part), int(m.max())), np.uint32)
            for k, (i, _, _) in enumerate(part):
                pattern[k, : m[k]] = self.codes[i]
            lane, bits = np.arange(w + 1), int(w + 1).bit_length()
            cost = np.where((first[:, None] + lane >= a[:, None]) & (first[:, None] + lane <= b[:, None]), 0, none)
            start = np.broadcast_to(lane, cost.shape).copy()
            left = 0
            for r in range(pattern.shape[1]):
                while left < len(part) and m[left] == r:
                    left += 1
                go = slice(left, None)
                x = first[go, None] + r + lane
                inside = (x >= a[go, None]) & (x < b[go, None])
                same = c[np.clip(x, 0, len(c) - 1)] == pattern[go, r, None]
                sub = np.where(inside, cost[go] + ~same, none)
                gone = np.full_like(sub, none)
                gone[:, :-1] = cost[go][:, 1:] + 1
                best, frm = np.minimum(sub, gone), start[go].copy()
                frm[:, :-1] = np.where(gone[:, :-1] < sub[:, :-1], start[go][:, 1:], frm[:, :-1])
                # the least cost by way of a lane before it, and with it where its alignment starts
                run = np.minimum.accumulate(((best - lane) << bits) + frm, 1)
                cost[go], start[go] = (run >> bits) + lane, run & ((1 << bits) - 1)
            at = cost.argmin(1)
            for k, (i, d, doc) in enumerate(part):
                edits = int(cost[k, at[k]])
                end = d + int(m[k]) + int(at[k])
                if edits <= self.edits[i]:
                    begin = max(int(a[k]), d + int(start[k, at[k]]))
                    put(doc, int(self.ids[i]), begin, max(begin + 1, min(end, int(b[k]))), edits)


def _blocks(items: DataFrame):
    """The benchmark in blocks of bounded size, ordered by item_id."""
    block, total = [], 0
    for row in items.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).orderBy("item_id", "text").toLocalIterator():
        if block and total + len(row[1]) > BLOCK_CHARS:
            yield Benchmark(block)
            block, total = [], 0
        block.append((row[0], row[1]))
        total += len(row[1])
    if block:
        yield Benchmark(block)


def _batches(rows: list, most: int = 1_000_000):
    from ._common import pieces_by_bytes

    yield from pieces_by_bytes(rows, most)


SCHEMA = "doc_id long, item_id long, start int, end int, edits int"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): code points [start, end) of a text are an item with so many edits."""
    out = None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    for index in _blocks(items):

        def run(batches, index=index):
            for batch in batches:
                ids, texts, got = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for lo, hi in _batches(texts):
                    got += [(ids[lo + d], *rest) for d, *rest in index.find(texts[lo:hi])]
                cols = zip(*got) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "start", "end", "edits"])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that contain no benchmark item."""
    at = docs.columns.index("text")
    for index in _blocks(items):

        def run(batches, index=index):
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                keep = np.ones(len(texts), bool)
                for lo, hi in _batches(texts):
                    for d, *_ in index.find(texts[lo:hi]):
                        keep[lo + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
