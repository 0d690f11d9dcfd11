"""Token IDs in sorted-string-table shards (operator 2).

Documents are range-partitioned by identifier, tokenised, and written as immutable shards:

    data block*  index block  Bloom filter  footer

* A block holds entries in key order. Each key drops the bytes it shares with the key before it (prefix
  compression, restarting at each block); the value is the token ids, 2 bytes each while they fit, else 4.
  Blocks are zstd-compressed and carry a CRC-32.
* The sparse index has, for each block, its first key, offset and length; a lookup bisects it, reads one block
  and scans that. A Bloom filter over the document identifiers answers most absent keys without a block.
* The footer has fixed width and the magic, so a reader finds index and filter from the end of the file.

A key is the document id (a presence byte, then 8 bytes big-endian with the sign flipped) and a 4-byte ordinal,
so repeated ids are kept, in the order of their token ids; a null id sorts first. Null text is an empty document:
it has the end id alone. An empty table gives no shard. Extra columns are ignored.

Shards are written by Spark's own file writer (committed per task, on any file system that Spark can reach), as
one row of raw bytes per block; the writer ends each row with a newline, which the format counts as a block's
last byte. They are read by Spark's binaryFile source.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, prefix_sums, slices_by_bytes, text_or_empty

MAGIC = b"TWSST001"
_FOOTER = struct.Struct("<QIQIQQQ8s")  # index offset, length, filter offset, length, entries, tokens, shard
BLOCK_BYTES = 64 * 1024
#: Entries of a worker's cache, about 150 bytes each.
CACHE_PIECES = 400_000
#: Bytes of text that are Python strings at a time.
TEXT_BYTES = 2_000_000


class _Pieces(dict):
    """Encoded pieces; those that had no room are in `rest` until the next batch."""

    rest: dict

    def __missing__(self, key):
        return self.rest[key]


class Encoder:
    """Whole-text encoding with the tokenizers library, with a cache of pieces.

    The byte-level pre-tokeniser never lets a token cross a single space that follows another character, so a text
    without double spaces is cut before each space and its pieces are encoded apart. Pieces that the cache lacks go through
    the library's model if they are Latin letters (perhaps with a mark after them); others are encoded together, in one
    call for many texts, where a token that starts with the space's sign starts a piece. Strings of special tokens in a
    text are ordinary text.
    """

    def __init__(self, name: str):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab(True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.marks = {c: self._text(c) for c in [*".,;:!?\n", ""]}
        self.ends = frozenset(".,;:!?")
        self.model = self.tokenizer.model
        self.pieces = _Pieces()

    def _text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, before: str, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(before + letters)]).tobytes()

    def _head(self, p: str) -> bytes:
        """A text's first piece, before which no space stands."""
        stem, mark = (p[:-1], p[-1]) if p[-1:] in self.ends else (p, "")
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
            return self._word("", stem) + self.marks[mark]
        return self._text(p)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Encodings of pieces, each after a space."""
        out, rest, known, word, marks, ends = {}, [], self.pieces.get, self._word, self.marks, self.ends
        for p in new:
            stem, mark = (p[:-1], p[-1]) if p[-1:] in ends else (p, "")
            # letters, a mark after letters, and a line's end between such are token runs of their own for the pre-tokeniser
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
                code = known(stem) or out.get(stem)
                if code is None:
                    code = out[stem] = word("\u0120", stem)
                if mark:
                    out[p] = code + marks[mark]
                continue
            head, line, tail = stem.partition("\n")
            end, letters = (head[-1], head[:-1]) if head[-1:] in ends else ("", head)
            if line and tail.isalpha() and letters.isalpha() and max(letters + tail) < "\u0250":
                code = known(letters) or out.get(letters)
                if code is None:
                    code = out[letters] = word("\u0120", letters)
                out[p] = code + marks[end] + marks[line] + word("", tail) + marks[mark]
            else:
                rest.append(p)
        if rest:
            ids = np.array(self.tokenizer.encode(" " + " ".join(rest), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.opens[ids])
            if len(cut) == len(rest):
                data, cut = ids.tobytes(), [*(cut * 4).tolist(), len(ids) * 4]
                out.update((p, data[i:j]) for p, i, j in zip(rest, cut, cut[1:]))
            else:
                out.update((p, self._text(" " + p)) for p in rest)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's token ids as little-endian 32-bit integers."""
        cut = [None if "  " in t else t.split(" ") for t in texts]
        heads = [c and c.pop(0) for c in cut]  # no space stands before these
        new = [p for p in dict.fromkeys(chain.from_iterable(filter(None, cut))) if p not in self.pieces]
        learnt = self._learn(new) if new else {}
        room = max(0, CACHE_PIECES - len(self.pieces))
        self.pieces.update(learnt if room >= len(learnt) else islice(learnt.items(), room))
        self.pieces.rest = learnt
        get = self.pieces.__getitem__
        return [self._text(t) if c is None else self._head(h) + b"".join(map(get, c)) for t, h, c in zip(texts, heads, cut)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder_of(name: str) -> Encoder:
    """A worker's encoder, which the tasks that run in it one after the other share with what it has cached."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(name)
    return _encoders[name]


def key_of(doc_id: int | None, ordinal: int) -> bytes:
    head = b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))
    return head + struct.pack(">I", ordinal)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class _Bloom:
    """Bits for document identifiers; 10 bits and 7 probes a key keep false positives near 1 %."""

    def __init__(self, keys: list[bytes] | None = None, data: bytes = b""):
        if keys is None:
            self.bits = np.frombuffer(data, np.uint8)
        else:
            self.bits = np.zeros(max(8, math.ceil(len(keys) * 10 / 8)), np.uint8)
            for k in keys:
                for i in self._at(k):
                    self.bits[i >> 3] |= 1 << (i & 7)

    def _at(self, key: bytes):
        a, b = zlib.crc32(key), zlib.adler32(key) * 2654435761 % (1 << 32) | 1
        return [((a + i * b) % (1 << 32)) % (len(self.bits) * 8) for i in range(7)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._at(key))


class ShardWriter:
    """Yields a shard's rows of bytes, each standing for itself and the newline that follows it."""

    def __init__(self, shard: int):
        import zstandard

        self.shard, self.at, self.index, self.heads = shard, 0, [], []
        self.block, self.first, self.last = bytearray(), None, b""
        self.entries = self.tokens = 0
        self.press = zstandard.ZstdCompressor(level=1).compress

    def _row(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data

    def _flush(self):
        raw = self.press(bytes(self.block))
        data = struct.pack("<I", zlib.crc32(raw)) + raw
        self.index.append((self.first.hex(), self.at, len(data)))
        self.block, self.first, self.last = bytearray(), None, b""
        return self._row(data)

    def add(self, key: bytes, ids: np.ndarray):
        if self.first is None:
            self.first = key
        apart = int.from_bytes(self.last, "big") ^ int.from_bytes(key, "big")
        same = len(key) - (apart.bit_length() + 7) // 8 if len(self.last) == len(key) else 0
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += bytes((same, len(key) - same)) + key[same:] + _varint(len(ids) << 1 | wide) + value
        self.last = key
        if not self.heads or self.heads[-1] != key[:9]:
            self.heads.append(key[:9])
        self.entries += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            yield self._flush()

    def close(self):
        if self.first is not None:
            yield self._flush()
        index, at = json.dumps(self.index).encode(), self.at
        yield self._row(index)
        bloom, at2 = _Bloom(self.heads).bits.tobytes(), self.at
        yield self._row(bloom)
        yield self._row(_FOOTER.pack(at, len(index), at2, len(bloom), self.entries, self.tokens, self.shard, MAGIC))


class Shard:
    """A shard in memory: iterate it, or look an identifier up."""

    def __init__(self, data: bytes):
        *where, self.entries, self.tokens, self.shard, magic = _FOOTER.unpack(data[-_FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.data = data
        self.index = json.loads(bytes(data[where[0] : where[0] + where[1]]))
        self.bloom = _Bloom(data=bytes(data[where[2] : where[2] + where[3]]))

    def _block(self, i: int):
        import zstandard

        _, at, n = self.index[i]
        raw = bytes(self.data[at + 4 : at + n])
        if zlib.crc32(raw) != struct.unpack("<I", self.data[at : at + 4])[0]:
            raise ValueError(f"block {i} of shard {self.shard} is damaged")
        block, at, last = zstandard.ZstdDecompressor().decompress(raw), 0, b""
        while at < len(block):
            same, rest = block[at], block[at + 1]
            last = last[:same] + block[at + 2 : at + 2 + rest]
            n, at = _read_varint(block, at + 2 + rest)
            width = 4 if n & 1 else 2
            yield last, np.frombuffer(block, f"<u{width}", n >> 1, at)
            at += (n >> 1) * width

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every entry of an identifier, by binary search of the sparse index."""
        head = key_of(doc_id, 0)[:9]
        if head not in self.bloom:
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if bytes.fromhex(self.index[mid][0])[:9] < head else (lo, mid)
        found = []
        for i in range(max(0, lo - 1), len(self.index)):
            for key, ids in self._block(i):
                if key[:9] == head:
                    found.append(ids)
                elif key[:9] > head:
                    return found
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, shard_bytes: int = 24_000_000) -> None:
    """Write docs (doc_id, text) as shards of about shard_bytes of text each, in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def encode(batches):
        from pyspark import TaskContext

        pa.default_memory_pool().release_unused()  # what earlier tasks of the worker freed
        writer, encoder = ShardWriter(TaskContext.get().partitionId()), encoder_of(tokenizer)
        now, held, tail = None, [], struct.pack("<I", end_id)

        def put(doc_id, many):
            for k, ids in enumerate(sorted(many) if len(many) > 1 else many):
                yield from writer.add(key_of(doc_id, k), np.frombuffer(ids, "<u4"))

        def out(some):
            return pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["value"])

        for batch in batches:
            for some in slices_by_bytes(batch, 1, TEXT_BYTES):
                ready = []
                for doc_id, code in zip(some.column(0).to_pylist(), encoder.encode_all(some.column(1).to_pylist())):
                    if held and doc_id != now:
                        ready.extend(put(now, held))
                        held = []
                    now = doc_id
                    held.append(code + tail)
                if ready:
                    yield out(ready)
        ready = list(put(now, held)) if held else []
        if writer.entries or ready:
            yield out(ready + list(writer.close()))

    raw = rows.mapInArrow(encode, "value binary")
    raw.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: shard, seq (its place in the shard), doc_id, n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                shard, rows = Shard(content.as_buffer().to_pybytes()), []
                for seq, (key, ids) in enumerate(shard):
                    rows.append((shard.shard, seq, id_of(key), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["shard", "seq", "doc_id", "n_tokens", "ids_crc32"])

    return files.mapInArrow(decode, "shard long, seq long, doc_id long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame) -> DataFrame:
    """The digest of operator 2: writes the shards, reads them back, and adds each document's start."""
    from ._common import materialize

    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write_shards(docs, path)
    from pyspark.sql import Window

    read = materialize(read_shards(spark, path), "tokens")
    totals = prefix_sums(read.groupBy("shard").agg(F.sum("n_tokens").alias("_n")), ["shard"], "_n", "_base").select("shard", "_base")
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        read.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(totals, "shard")
        .select("doc_id", (F.col("_base") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
    )
