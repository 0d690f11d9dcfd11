"""Near-duplicate documents by ProbMinHash (operator 3).

A document is the weighted set of its five-word shingles, weights being counts (lower-case words; punctuation
separates). Each shingle's Poisson process has its count as rate; arrivals fall on random registers, which keep the
earliest. A document's processes stop once their next arrival is later than every register's. Registers of two
documents agree with their probability Jaccard similarity. A document with a count above one has a second set of
registers with rates of one, which agree with the plain Jaccard similarity. `BANDS` bands of `ROWS` registers of either
set propose pairs, which are verified exactly: a link needs a probability Jaccard, or a plain Jaccard, of `THRESHOLD`
or more. Classes are the connected components of links.

Equal texts are one node. In a band's bucket each text is compared with a few centres (cost linear in the bucket).
Buckets that still hold several classes get a hub, the text with the least share of shingles that it alone has, and
every text left there is compared with it. Then two texts are only compared if they can still be similar:

* a shingle that one text alone has is in no intersection, which bounds a text's similarities from its own counts;
* the symmetric difference is a metric. With e the difference from the hub and u what one text alone has, texts x and y
  differ by at least e_x + e_y - 2 min(e_x - u_x, e_y - u_y), since they share no more of their differences than that.
  The same holds of the L1 distance of normalised counts, which is 2 (1 - t) at most where probability Jaccard is t;
* if shares o of two texts' counts fall on shingles that one alone has, probability Jaccard is at most
  1 / (1 + o_x / (1 - o_x) + o_y / (1 - o_y)).

All bounds are exact, so a large group of copies is never expanded into all its pairs and no link between classes is
lost. A pair is proposed in the least bucket that it shares, and verified once.

Texts of one to four words are one shingle; texts without words are near-duplicates only when equal. Null text is
an empty text. A null doc_id is a row of its own class. Repeated rows share their class. Very long texts are shingled
whole, each in a piece of its own. An empty table gives no classes. Columns other than doc_id and text are ignored by
`classes` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hash_words, materialize, mix64, pieces_by_bytes, text_or_empty, word_codes
from .components import components, extend

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
M = BANDS * ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_GAMMA = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, by text: text index, 64-bit hash, count."""
    codes, counts, words = word_codes(texts)
    h = mix64(hash_words(words) + np.uint64(1))[codes] if words else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(h)) - starts[doc]
    keep = place <= np.maximum(counts[doc] - SHINGLE, 0)
    at = np.flatnonzero(keep)
    s = np.zeros(len(at), np.uint64)
    padded = np.concatenate((h, np.zeros(SHINGLE, np.uint64)))
    for k in range(SHINGLE):
        inside = place[at] + k < counts[doc[at]]
        s = s * np.uint64(0x100000001B3) + np.where(inside, padded[at + k], np.uint64(k + 1))
    s, doc = mix64(s), doc[at]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], s[first], np.diff(np.append(first, len(s)))


def registers(doc: np.ndarray, s: np.ndarray, w: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, M) of packed registers: arrival time above, element below; all ones where there is no element."""
    regs = np.full((n_docs, M), _EMPTY, np.uint64)
    flat, latest = regs.reshape(-1), np.full(n_docs, np.inf, np.float32)
    time, state = np.zeros(len(s)), s.copy()
    low = (s & np.uint64(0xFFFFFFFF)).astype(np.uint64)
    while len(s):
        state = state + _GAMMA
        r = mix64(state)
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / w
        where = doc * M + (mix64(r ^ _GAMMA) % np.uint64(M)).astype(np.int64)
        packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
        np.minimum.at(flat, where, packed)
        full = regs.max(1)
        latest = np.where(full == _EMPTY, np.float32(np.inf), (full >> np.uint64(32)).astype(np.uint32).view(np.float32))
        go = time < latest[doc]
        doc, s, w, time, state, low = doc[go], s[go], w[go], time[go], state[go], low[go]
    return regs


def _bands(element: np.ndarray) -> np.ndarray:
    """(texts, BANDS) of 64-bit band hashes of the registers' elements."""
    element = element.reshape(len(element), BANDS, ROWS)
    h = np.full((len(element), BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x100000001B3) + element[:, :, k] + np.uint64(k))
    return h.view(np.int64)


def band_hashes(texts: list) -> tuple[list[list[int]], list[bytes]]:
    """Of each text the band hashes, and the packed elements of its registers by count, then by shingle.

    A text that has each shingle once has both alike and packs them once. Texts without words have no bands.
    """
    doc, s, w = shingles(texts)
    regs = registers(doc, s, w.astype(np.float64), len(texts))
    low, some = regs & np.uint64(0xFFFFFFFF), regs[:, 0] != _EMPTY
    bands = [x if ok else [] for x, ok in zip(_bands(low).tolist(), some)]
    packed = [x.astype("<u4").tobytes() for x in low]
    many = np.unique(doc[w > 1])
    at = np.flatnonzero(np.isin(doc, many))
    unit = registers(np.searchsorted(many, doc[at]), s[at], np.ones(len(at)), len(many)) & np.uint64(0xFFFFFFFF)
    for d, h, x in zip(many, _bands(unit).tolist(), unit):
        bands[d] += h
        packed[d] += x.astype("<u4").tobytes()
    return bands, packed


def _compare(s1, w1, s2, w2) -> tuple[float, int, float]:
    """Similarity of two texts, how many shingles they share, and the L1 distance of their normalised counts."""
    if not len(s1) or not len(s2):
        return float(len(s1) == len(s2)), 0, 2.0
    both, i, j = np.intersect1d(s1, s2, assume_unique=True, return_indices=True)
    plain = len(both) / (len(s1) + len(s2) - len(both))
    v1, v2 = w1[i] / w1.sum(), w2[j] / w2.sum()
    apart = float(np.abs(v1 - v2).sum() + 2 - v1.sum() - v2.sum())
    if plain >= THRESHOLD or (w1.max() == 1 and w2.max() == 1) or not len(both):
        return plain, len(both), apart
    # J_P: for each shared element, 1 / sum over all elements of the larger of the two weight ratios
    all_, inv = np.unique(np.concatenate((s1, s2)), return_inverse=True)
    v1, v2 = np.zeros(len(all_)), np.zeros(len(all_))
    v1[inv[: len(s1)]], v2[inv[len(s1) :]] = w1, w2
    ratio = np.divide(v2, v1, out=np.full(len(all_), np.inf), where=v1 > 0)
    order = np.argsort(ratio)
    c2 = np.concatenate((np.cumsum(v2[order][::-1])[::-1], [0]))
    c1 = np.concatenate(([0], np.cumsum(v1[order])))
    cut = np.searchsorted(ratio[order], w2[j] / w1[i])
    total = c2[cut] / w2[j] + c1[cut] / w1[i]
    return max(plain, float((1 / total).sum())), len(both), apart


def _similar(s1, w1, s2, w2) -> float:
    return _compare(s1, w1, s2, w2)[0]


def _rows(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def _signatures(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in pieces_by_bytes(texts, 1_000_000):
                bands, _ = band_hashes(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "bands"])

    return _rows(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def _estimate(a: list, b: list) -> np.ndarray:
    """An estimate of similarity without the texts: the greater agreement of the registers by count and by shingle of each pair."""
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b)):
        x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        out[k] = max(np.count_nonzero(x[:M] == y[:M]), np.count_nonzero(x[-M:] == y[-M:])) / M
    return out


def _shingled(texts: DataFrame) -> DataFrame:
    """(rep, s, w): a text's distinct shingles, sorted, as packed 64-bit hashes, and their packed 32-bit counts."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in pieces_by_bytes(texts, 1_000_000):
                doc, s, w = shingles(texts[lo:hi])
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                packed = [[x[i:j].astype(kind).tobytes() for i, j in zip(cut, cut[1:])] for x, kind in ((s, "<u8"), (w, "<u4"))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(x, pa.binary()) for x in packed)], ["rep", "s", "w"])

    return texts.mapInArrow(run, "rep long, s binary, w binary")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, apart, linked) of pairs (a, b): shared shingles, L1 distance, and whether they are similar enough."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("s").alias(f"s{side}"), F.col("w").alias(f"w{side}")), side)

    def run(batches):
        for p in batches:
            packed = zip(*([np.frombuffer(x.as_buffer(), kind) for x in p.column(k)] for k, kind in ((2, "<u8"), (3, "<u4"), (4, "<u8"), (5, "<u4"))))
            got = [(both, apart, likeness >= THRESHOLD) for likeness, both, apart in (_compare(*x) for x in packed)]
            both, apart, linked = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(both, pa.int64()), pa.array(apart, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "apart", "linked"])

    return pairs.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(run, "a long, b long, both long, apart double, linked boolean")


def _apart(column: str, salt: int) -> Column:
    return F.struct(F.xxhash64(F.col(column), F.lit(salt)).alias("_h"), F.col(column).alias("_id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, label, ...) of the buckets that hold more than one class."""
    found = rows.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("key")
    return rows.join(found, "key")


def _bounds(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, n, u, mass, own, many): shingles of a text, those that no other text in the buckets has, the same by count.

    A shingle that one text alone has is shared with none, so n - u and mass - own bound every intersection.
    """

    def spread(batches):
        for b in batches:
            for rep, s, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h, c = np.frombuffer(s.as_buffer(), "<i8"), np.frombuffer(w.as_buffer(), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), rep, np.int64)), pa.array(h), pa.array(c.astype(np.int64))], ["rep", "h", "c"])

    each = sets.join(rest.select("rep").distinct(), "rep", "left_semi").mapInArrow(spread, "rep long, h long, c long")
    one = each.groupBy("h").agg(F.count("*").alias("df"), F.min("rep").alias("rep"), F.min("c").alias("c")).where("df = 1").groupBy("rep").agg(F.count("*").alias("u"), F.sum("c").alias("own"))
    all_ = each.groupBy("rep").agg(F.count("*").alias("n"), F.sum("c").alias("mass"))
    return all_.join(one, "rep", "left").select("rep", "n", F.coalesce("u", F.lit(0)).alias("u"), "mass", F.coalesce("own", F.lit(0)).alias("own"), (F.col("mass") > F.col("n")).alias("many"))


def _may_link(n: str, u: str, mass: str, own: str) -> Column:
    return (F.col(n) - F.col(u) >= THRESHOLD * F.col(n)) | (F.col(mass) - F.col(own) >= THRESHOLD * F.col(mass))


def _relabel(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.drop("label").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _left_over(buckets: DataFrame, reps: DataFrame, sets: DataFrame, stars: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, with the links between texts that the stars left in different classes of a bucket."""
    rest = materialize(_mixed(_relabel(buckets.select("key", "rep"), labels)), "rest")
    bounds = materialize(_bounds(rest, sets), "bounds")
    rest = materialize(_mixed(rest.join(bounds.where(_may_link("n", "u", "mass", "own")), "rep")), "rest")
    # the hub of each bucket, and how every text there differs from it
    hub = rest.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("s"), F.col("rep").alias("hub"), F.col("n").alias("n_hub"))).alias("_h")).select("key", "_h.hub", "_h.n_hub")
    rest = materialize(rest.join(hub, "key"), "hubs")
    asked = rest.where("rep <> hub").select(*_pair("rep", "hub")).distinct()
    fresh = materialize(_measured(asked.join(stars, ["a", "b"], "left_anti"), sets), "spokes")
    spokes = stars.union(fresh)
    labels = extend(labels, fresh.where("linked").select("a", "b"))
    same = F.col("rep") == F.col("hub")
    rest = rest.select("*", *_pair("rep", "hub")).join(spokes.select("a", "b", "both", "apart"), ["a", "b"], "left").where(same | F.col("both").isNotNull())
    rest = rest.select("key", "rep", "label", "n", "u", "many", F.when(same, 0).otherwise(F.col("n") + F.col("n_hub") - 2 * F.col("both")).alias("e"), F.when(same, 0.0).otherwise(F.col("apart")).alias("d"), (F.col("own") / F.col("mass")).alias("o"))
    rest = materialize(_mixed(_relabel(rest, labels)).join(reps.select("rep", "bands"), "rep"), "rest")
    x, y = (rest.select("key", *(F.col(c).alias(f"{c}_{r}") for c in ("rep", "label", "n", "u", "many", "e", "d", "o", "bands"))) for r in "ab")
    f = F.col
    both = F.least(f("n_a") - f("u_a"), f("n_b") - f("u_b"))
    most = (1 - THRESHOLD) / (1 + THRESHOLD) * (f("n_a") + f("n_b")) + 1e-9
    plain = (both >= THRESHOLD * (f("n_a") + f("n_b") - both)) & (f("e_a") + f("e_b") - 2 * F.least(f("e_a") - f("u_a"), f("e_b") - f("u_b")) <= most)
    odds = sum((f(c) / F.greatest(1 - f(c), F.lit(1e-9)) for c in ("o_a", "o_b")), F.lit(0.0))
    by_count = (f("many_a") | f("many_b")) & (odds <= 1 / THRESHOLD - 1 + 1e-9) & (f("d_a") + f("d_b") - 2 * F.least(f("d_a") - f("o_a"), f("d_b") - f("o_b")) <= 2 * (1 - THRESHOLD) + 1e-9)
    first = F.array_min(F.array_intersect("bands_a", "bands_b")) == x["key"]
    found = x.join(y, (x["key"] == y["key"]) & (f("rep_a") < f("rep_b")) & (f("label_a") != f("label_b")) & (plain | by_count) & first)
    pairs = materialize(found.select(f("rep_a").alias("a"), f("rep_b").alias("b")).join(spokes.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = materialize(_measured(pairs, sets), "measured")
    return extend(labels, more.where("linked").select("a", "b"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, exact_id): class_id is the least doc_id of its class, exact_id of its equal texts."""
    sig = materialize(_signatures(docs), "signatures")
    known = sig.where(F.col("doc_id").isNotNull())
    reps = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("exact_id"), F.min_by("bands", "doc_id").alias("bands"))
    # a text is known by its least doc_id; texts that share this have ids of their own
    own = F.xxhash64("h1", "h2")
    twice = reps.groupBy("exact_id").agg(F.count("*").alias("_c"), F.min(own).alias("_m")).where("_c > 1").select("exact_id", "_m")
    reps = materialize(reps.join(twice, "exact_id", "left").select("h1", "h2", "exact_id", F.when(F.col("_m").isNull(), F.col("exact_id")).otherwise(own).alias("rep"), "bands"), "reps")
    # the texts of a repeated doc_id are linked
    several = known.groupBy("doc_id").agg(F.min("h1").alias("_lo"), F.max("h1").alias("_hi")).where("_lo <> _hi").select("doc_id")
    several = materialize(known.join(several, "doc_id").join(reps, ["h1", "h2"]).select("doc_id", "rep").distinct(), "several")
    again = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    keys = reps.select("rep", F.explode(F.array_distinct("bands")).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("_n"), F.min("rep").alias("c0"), *(F.min(_apart("rep", k)).alias(f"c{k}") for k in (1, 2))).where("_n > 1")
    buckets = materialize(keys.join(shared, "key").select("key", "rep", "c0", F.col("c1._id").alias("c1"), F.col("c2._id").alias("c2")), "buckets")
    pairs = buckets.select("rep", F.explode(F.array("c0", "c1", "c2")).alias("c")).where("rep <> c").select(*_pair("rep", "c")).distinct()
    # merged at any size: a text is dealt out once, and the ids are never assumed to be few
    part = reps.select("rep", "exact_id", "h1", "h2").join(buckets.select("rep").distinct(), "rep", "left_semi").withColumnRenamed("exact_id", "doc_id").hint("merge")
    texts = _rows(docs).join(part, ["doc_id", "h1", "h2"]).groupBy("doc_id", "h1", "h2", "rep").agg(F.first("text").alias("text")).select("rep", "text")
    sets = materialize(_shingled(texts), "texts")
    stars = materialize(_measured(pairs, sets), "stars")
    labels = extend(_left_over(buckets, reps, sets, stars, components(stars.where("linked"))), again)
    exact = _relabel(reps.select("h1", "h2", "exact_id", "rep"), labels)
    first = exact.groupBy("label").agg(F.min("exact_id").alias("class_id"))
    out = sig.select("doc_id", "h1", "h2").join(exact.join(first, "label").select("h1", "h2", "exact_id", "class_id"), ["h1", "h2"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("exact_id")).alias("exact_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each class one row with its least doc_id stays; rows without doc_id stay."""
    found = classes(docs)
    kept = materialize(found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("_n")), "kept")
    # merged at any size: a text is dealt out once, and the kept ids are never assumed to be few
    out = docs.join(kept.where("_n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    again = kept.where("_n > 1").select("doc_id")
    if not again.isEmpty():  # repeated ids: one of their rows
        out = out.union(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.union(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
