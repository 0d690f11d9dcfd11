"""Language-model scoring by cross-entropy difference (operator 9).

Two word bigram models are counted: the target model over the documents labelled of good quality (those whose
crc32(doc_id) mod 5 is not 0), the background model over all documents. They match: the same order, the same
smoothing (`UNI` words are assumed where none was seen), and background counts scaled to the target's total, so that
neither is smoothed more. A document's score is its mean loss per token under the target less that under the
background; the lower, the more it is like the target.

    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU),    p(w) = (c(w) + 1/2) / (N + UNI / 2)

Texts are read once, in blocks of about `BLOCK_CHARS` characters, and kept as word codes with the words' hashes. A block
asks for the corpus's counts of its distinct bigrams and words: it sends each with its own counts to the part of the
hashes' range that it falls in, the parts add up, and the sums go back to the blocks in the order they were asked in.
So what is gathered grows with the corpus, a word or bigram is sent once for each block however often it occurs (no key
is hot), and neither texts nor tables of counts meet in one task or on the driver. A hash has 48 bits beyond those of
its part, and parts are as many as blocks, so the chance that two of them are taken for one does not grow with the corpus.

A text starts after a boundary word; null, empty and wordless texts have 0 tokens and losses 0. A very long text is a
block of its own. Without target documents both models are the background. Repeated rows count as often as they
occur; where a doc_id has several labels the best holds; a null doc_id is never a target. An empty table gives no
scores. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import hash_words, materialize, mix64, text_or_empty, word_codes
from .toxicity import is_held_out

UNI, MU, BLOCK_CHARS = 1 << 18, 20.0, 4_000_000
_TURN, _LOW = np.uint64(23), 48
_WORD = np.uint64(0xA0761D6478BD642F)


def _pack(codes: np.ndarray) -> bytes:
    """32-bit numbers by their bytes' planes, compressed."""
    import zstandard

    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, counts, codes, words): blocks of texts as codes of words, the most frequent ones first."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        ids, texts = [], []

        def made():
            codes, counts, words = word_codes(texts)
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            h = mix64(hash_words(words) + np.uint64(3))[order] if words else np.zeros(0, np.uint64)
            cols = [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([_pack(rank[codes])]), pa.array([h.astype("<u8").tobytes()])]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "counts", "codes", "words"])

        held = 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                new = part.column(1).to_pylist()
                size = sum(map(len, new))
                if texts and held + size > BLOCK_CHARS:
                    yield made()
                    block, ids, texts, held = block + 1, [], [], 0
                ids += part.column(0).to_pylist()
                texts += new
                held += size
        if texts:
            yield made()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "block long, doc_ids array<long>, counts array<long>, codes binary, words binary")


class Asked:
    """What a block asks for: its distinct bigrams and words in the order of their hashes, and its own counts of them."""

    def __init__(self, counts: np.ndarray, codes: bytes, words: bytes):
        self.counts = counts
        self.code, h = _unpack(codes).astype(np.int32), np.frombuffer(words, "<u8")
        ends = np.cumsum(counts)
        some = counts > 0
        self.last, self.first = (ends - 1)[some], (ends - counts)[some]
        self.text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        v = np.zeros(len(self.code), np.uint64)
        v[1:] = h[self.code[:-1]]
        v[self.first] = 0
        pair = h[self.code] ^ (v << _TURN | v >> np.uint64(64) - _TURN)
        pairs, at, self.pair = np.unique(pair, return_index=True, return_inverse=True)
        # of each bigram its word, and the word before it (one more than the last at a start)
        self.word, before = self.code[at], np.full(len(self.code), len(h), np.int32)
        before[1:] = self.code[:-1]
        before[self.first] = len(h)
        self.before = before[at]
        self.n_pairs, self.n_words = len(pairs), len(h)
        keys = np.concatenate((pairs, mix64(h ^ _WORD)))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counted(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key how often texts `of` (booleans) have it, and how often it ends one of them."""
        token = np.repeat(of, self.counts)
        n = np.concatenate((np.bincount(self.pair[token], minlength=self.n_pairs), np.bincount(self.code[token], minlength=self.n_words)))
        last = self.last[of[self.counts > 0]]
        end = np.concatenate((np.zeros(self.n_pairs, np.int64), np.bincount(self.code[last], minlength=self.n_words)))
        return n[self.order], end[self.order]

    def told(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums in the keys' order as those of bigrams and those of words."""
        out = np.empty(len(sums))
        out[self.order] = sums
        return out[: self.n_pairs], out[self.n_pairs :]


def _lists(values: np.ndarray, cut: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values.astype(kind)))


#: Counts of keys: low and high byte apart; those over 16 bits, and those of texts' ends, by their place.
_COUNTS = ("n_low", "n_high", "t_low", "t_high", "at", "n", "t", "end_at", "n_end", "t_end")
_KINDS = "n_low array<byte>, n_high array<byte>, t_low array<byte>, t_high array<byte>, at array<int>, n array<long>, t array<long>, end_at array<int>, n_end array<long>, t_end array<long>"
_ASKED = "part long, block long, high array<int>, low array<short>, " + _KINDS
_TOLD = "block long, part long, " + _KINDS
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _pack_counts(n: np.ndarray, t: np.ndarray, n_end: np.ndarray, t_end: np.ndarray, cut: np.ndarray) -> list[pa.Array]:
    """Lists of counts, one for each stretch of keys between cuts."""

    def sparse(where, *counts):
        at = np.flatnonzero(where)
        by = np.searchsorted(at, cut)
        return [_lists(at - np.repeat(cut[:-1], np.diff(by)), by, np.int32), *(_lists(x[at], by, np.int64) for x in counts)]

    few = (_lists((x >> shift & 255).astype(np.uint8).view(np.int8), cut, np.int8) for x in (n, t) for shift in (0, 8))
    return [*few, *sparse(n >> 16 > 0, n, t), *sparse(n_end > 0, n_end, t_end)]


def _unpack_counts(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """n, t, n_end and t_end of the keys of all rows, and where the rows' keys are cut."""
    col = {c: rows.column(c).combine_chunks() for c in _COUNTS}
    size = {c: pc.list_value_length(col[c]).to_numpy() for c in ("n_low", "at", "end_at")}
    flat = {c: x.flatten().to_numpy() for c, x in col.items()}
    cut = np.append(0, np.cumsum(size["n_low"]))
    few = [flat[x + "_low"].view(np.uint8) | flat[x + "_high"].view(np.uint8).astype(np.int64) << 8 for x in "nt"]
    out = [*few, *(np.zeros(cut[-1], np.int64) for _ in range(2))]
    for at, pair in (("at", ("n", "t")), ("end_at", ("n_end", "t_end"))):
        where = np.repeat(cut[:-1], size[at]) + flat[at]
        for x, c in zip(out[2 * (at == "end_at") :], pair):
            x[where] = flat[c]
    return out, cut


def _asks(known: DataFrame, bits: int) -> DataFrame:
    """A row for each block and part of the hashes: keys, and the block's counts of them."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                block, counts, codes, words, target = (b.column(c)[k].as_py() for c in ("block", "counts", "codes", "words", "target"))
                asked, of = Asked(np.array(counts, np.int64), codes, words), np.zeros(len(counts), bool)
                of[target or []] = True
                sums = [x for pair in zip(asked.counted(np.ones(len(counts), bool)), asked.counted(of)) for x in pair]
                part = asked.keys >> np.uint64(64 - bits) if bits else np.zeros(len(asked.keys), np.uint64)
                parts, first = np.unique(part, return_index=True)
                cut = np.append(first, len(part))
                low = asked.keys << np.uint64(bits) >> np.uint64(64 - _LOW)
                cols = [(low >> np.uint64(16)).astype(np.uint32).view(np.int32), (low & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts.astype(np.int64)), pa.array(np.full(len(parts), block)), _lists(cols[0], cut, np.int32), _lists(cols[1], cut, np.int16), *_pack_counts(*sums, cut)],
                    ["part", "block", "high", "low", *_COUNTS],
                )

    return known.mapInArrow(run, _ASKED)


def _add_up(group: pa.Table) -> pa.Table:
    """The sums of one part, for each block that asked, in its keys' order."""
    counts, cut = _unpack_counts(group)
    high, low = (group.column(c).combine_chunks().flatten().to_numpy() for c in ("high", "low"))
    keys = (high.view(np.uint32).astype(np.uint64) << np.uint64(16)) | low.view(np.uint16)
    _, inv = np.unique(keys, return_inverse=True)
    sums = [np.bincount(inv, x)[inv].astype(np.int64) for x in counts]
    return pa.table([group.column("block"), group.column("part"), *_pack_counts(*sums, cut)], names=["block", "part", *_COUNTS])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of docs."""
    known = materialize(blocks(docs), "blocks")
    each = known.select("block", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("pos", "x")).select("block", "pos", F.col("x.doc_ids").alias("doc_id"), F.col("x.counts").alias("n"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    target = materialize(each.where(~is_held_out()).join(good, "doc_id", "left_semi").select("block", "pos", "n"), "target")
    sizes = [F.sum("n"), F.sum(F.when(F.col("n") > 0, 1))]
    (n_all, starts), (n_good, good_starts) = ([x or 0 for x in rows.agg(*sizes).first()] for rows in (each, target))
    if not n_good:
        n_good, good_starts = n_all, starts
        which = 0  # the background's counts serve as the target's
    else:
        which = 1
    scale = n_good / n_all if n_all else 1.0
    bits = max(0, known.count() - 1).bit_length()
    flags = target.groupBy("block").agg(F.collect_list("pos").alias("target"))  # no more than a block's texts
    # the same columns as below, so that both read one shuffle of the blocks
    asks = _asks(known.join(flags, "block", "left"), bits)
    told = asks.groupBy("part").applyInArrow(_add_up, _TOLD)

    def loss(asked: Asked, pair, word, end, begun: int, by: float) -> np.ndarray:
        p1 = (word * by + 0.5) / (n_good + UNI / 2)
        context = np.append(word - end, begun)
        return np.log(context[asked.before] * by + MU) - np.log(pair * by + MU * p1[asked.word])

    def finish(block: pa.Table, sums: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in ("doc_ids", "counts", "codes", "words")}
        counts = np.array(row["counts"].as_py(), np.int64)
        ids, per = pa.array(row["doc_ids"].as_py(), pa.int64()), np.maximum(counts, 1)
        mean = [np.zeros(len(counts))] * 2
        if counts.sum():
            asked = Asked(counts, row["codes"].as_py(), row["words"].as_py())
            got = [asked.told(x) for x in _unpack_counts(sums.sort_by("part"))[0]]
            at = [(got[which], got[2 + which], good_starts, 1.0), (got[0], got[2], starts, scale)]
            each = [loss(asked, *n, end[1], begun, by) for n, end, begun, by in at]
            mean = [np.bincount(asked.text, x[asked.pair], len(counts)) / per for x in each]
        return pa.table([ids, pa.array(counts), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return known.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, _SCORES)
