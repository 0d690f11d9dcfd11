"""Near-duplicate lines by a segment-partition edit join (operator 7). DataFrame operations only.

Distinct lines are joined at an edit distance that keeps them four fifths alike, and is `TAU` at most: by the shorter
line, TAU from `MIN_CHARS` characters on, one from half as many. A line is cut into TAU + 1 segments; a line
within TAU edits of it holds one of them unchanged, at a place that the segment's number and the lengths' difference
bound (multi-match-aware selection). So every line indexes its segments by (length, number, text) and probes, for each
length up to TAU shorter, the few substrings that could be a segment there. Lines that meet under a key are
paired if their letter counts differ by no more than TAU edits can, and if all but TAU of eight blocks recur near their
place; these are verified by a bit-parallel edit distance: TAU + 1 registers hold, for a band of 2 TAU + 1 diagonals, the cells within 0..TAU
edits, and one pass over the text updates them with shifts and masks. Classes are connected components of the links.

Lines of one template share most segments. Lines within TAU edits have digits within TAU edits, so where more than
`CROWD` rows meet under a key, those with `DIGITS` digits or more must share a segment of their digits as well.

Copies of a line are one node, aggregated before the join. Lines under half of `MIN_CHARS` are duplicates only when
equal; blank lines belong to no class. Null text has one blank line, and an empty table gives no rows. A line is held
whole by the task that reads it, however long. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, text_or_empty
from .components import components

TAU, MIN_CHARS = 2, 10
CROWD, DIGITS = 64, 6
#: Letters whose counts tell lines apart.
LETTERS = "etaoinshrdlucmp"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))


def _node(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _id(node: Column) -> Column:
    return F.shiftright(F.xxhash64(node), 1)


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (zero-based) and length of segment i of a line of that length: even, the longer ones last."""
    base, rest = F.floor(length / (tau + 1)), length % (tau + 1)
    over = i - (tau + 1 - rest)
    return i * base + F.greatest(over, F.lit(0)), base + F.when(over >= 0, 1).otherwise(0)


def keys(length: Column, line: Column, tau: int = TAU) -> Column:
    """array<struct(key, own)>: what a line indexes (own) and probes. A key that it indexes is also a probe."""
    out = []
    for delta in range(tau + 1):
        for i in range(tau + 1):
            start, size = _segment(length - delta, i, tau)
            for off in range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1):
                piece = F.substr(line, (start + off + 1).cast("int"), size.cast("int"))
                out.append(F.struct(F.xxhash64((length - delta).cast("int"), F.lit(i), piece).alias("key"), F.lit(delta == 0 and off == 0).alias("own")))
    return F.array(*out)


def line_keys(length: Column, line: Column, tau: int, min_chars: int) -> Column:
    """keys() of a line at tau edits and, apart, at one edit if it can meet lines that are too short for more."""
    none = F.expr("CAST(array() AS array<struct<key:bigint,own:boolean>>)")
    short = F.transform(keys(length, line, 1), lambda k: F.struct(F.xxhash64(F.lit("short"), k["key"]).alias("key"), k["own"].alias("own")))
    return F.concat(F.when(length >= min_chars, keys(length, line, tau)).otherwise(none), F.when(length <= min_chars, short).otherwise(none))


def digit_keys(digits: Column, tau: int) -> Column:
    """keys() of a line's digits. Lines with few digits meet under one key, as do those within tau digits of them."""
    n = F.length(digits)
    few = F.array(F.struct(F.lit(0).cast("bigint").alias("key"), F.lit(True).alias("own")))
    return F.when(n < DIGITS, few).when(n < DIGITS + tau, F.concat(few, keys(n, digits, tau))).otherwise(keys(n, digits, tau))


def edits(a: Column, b: Column, tau: int = TAU) -> Column:
    """Edit distance of two strings if it is at most tau, else null."""
    band = 2 * tau + 1
    m, n = F.length(a), F.length(b)
    pad = F.array_repeat(F.lit(""), 2 * tau)
    padded = F.concat(F.array_repeat(F.lit(""), tau), F.filter(F.split(a, ""), lambda c: c != ""), pad)
    near = [F.slice(padded, F.lit(d + 1), n).alias(f"p{d}") for d in range(band)]
    # bit d of a text character: it equals the character of the other string on diagonal d - tau
    columns = F.arrays_zip(F.filter(F.split(b, ""), lambda c: c != "").alias("c"), *near)
    match = F.transform(columns, lambda x: sum((F.when(x[f"p{d}"] == x["c"], 1 << d).otherwise(0) for d in range(1, band)), F.when(x["p0"] == x["c"], 1).otherwise(0)))
    start = F.struct(*(F.lit(sum(1 << (tau + k) for k in range(e + 1))).alias(f"r{e}") for e in range(tau + 1)))

    def step(acc: Column, match: Column) -> Column:
        new = []
        for e in range(tau + 1):
            r = acc[f"r{e}"].bitwiseAND(match)
            if e:
                # substituted, inserted (the column before, one diagonal up), deleted (this column, one down)
                r = r.bitwiseOR(acc[f"r{e - 1}"]).bitwiseOR(F.shiftright(acc[f"r{e - 1}"], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND((1 << band) - 1))
            new.append(r)
        return F.struct(*(r.alias(f"r{e}") for e, r in enumerate(new)))

    def finish(acc: Column) -> Column:
        bit, out = F.get(F.array(*(F.lit(1 << d) for d in range(band))), tau + m - n), F.lit(None).cast("int")
        for e in range(tau, -1, -1):
            out = F.when(acc[f"r{e}"].bitwiseAND(bit) != 0, e).otherwise(out)
        return out

    return F.when(F.abs(m - n) <= tau, F.aggregate(match, start, step, finish))


def plausible(a: Column, b: Column, tau: int = TAU, blocks: int = 8) -> Column:
    """A cheap condition that strings within tau edits meet: all but tau of a's blocks are in b within tau places."""
    q = F.floor(F.length(a) / blocks).cast("int")
    found = None
    for i in range(blocks):
        window = F.substr(b, F.greatest(F.lit(1), q * i + 1 - tau), q + 2 * tau)
        here = F.when(F.position(F.substr(a, q * i + 1, q), window) > 0, 1).otherwise(0)
        found = here if found is None else found + here
    return found >= blocks - tau


def letters(line: Column) -> list[Column]:
    """How often the line has each of LETTERS, and how many other characters."""
    n = [F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS]
    return [x.alias(f"c{k}") for k, x in enumerate([*n, F.length(line) - sum(n[1:], n[0])])]


def candidates(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, max_broadcast: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ids that share a segment and about as many of each letter, and (id, node, line) of these ids."""
    long = lines_of(docs).where(F.length("line") >= (min_chars + 1) // 2).select("line", _node(F.col("line")).alias("node"))
    # the length is a column of its own: inside the keys it would be counted anew for each of them
    distinct = long.groupBy("node").agg(F.first("line").alias("line")).select("node", "line", F.length("line").alias("n"))
    distinct = distinct.select(_id(F.col("node")).alias("id"), F.explode(line_keys(F.col("n"), F.col("line"), tau, min_chars)).alias("k"))
    # two numbers a row: the key, and the line's id with, in the last bit, whether it indexes the key
    each = distinct.select("k.key", F.shiftleft("id", 1).bitwiseOR(F.col("k.own").cast("bigint")).alias("v"))
    # keys that one line alone has are dropped in the pass that brings a key's rows together
    by, id_ = Window.partitionBy("key"), F.shiftright("v", 1)
    met = each.withColumn("_lo", F.min(id_).over(by)).withColumn("_hi", F.max(id_).over(by)).withColumn("_own", F.max(F.col("v").bitwiseAND(1)).over(by)).withColumn("_n", F.count("*").over(by))
    met = met.where("_lo <> _hi AND _own = 1").select("key", id_.alias("id"), (F.col("v").bitwiseAND(1) == 1).alias("own"), (F.col("_n") > CROWD).alias("crowded"))
    met = materialize(met, "met")
    ids = materialize(met.select("id").distinct(), "ids")
    few = ids.count() <= max_broadcast
    # lines whose ids collide are all verified, so ids decide nothing
    texts = long.withColumn("id", _id(F.col("node"))).join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id", "node").agg(F.first("line").alias("line"))
    texts = materialize(texts.select("id", "node", "line", *letters(F.col("line")), F.regexp_replace("line", "[^0-9]", "").alias("digits")), "texts")
    # an edit changes two counts by one at most, so lines that share a segment and little else are not paired
    counts = [f"c{k}" for k in range(len(LETTERS) + 1)]
    met = met.join(texts.select("id", "digits", *counts), "id")
    plain = F.array(F.struct(F.lit(0).cast("bigint").alias("key"), F.lit(True).alias("own")))
    met = met.withColumn("d", F.explode(F.when(F.col("crowded"), digit_keys(F.col("digits"), tau)).otherwise(plain)))
    met = met.withColumn("key", F.when(F.col("crowded"), F.xxhash64("key", "d.key")).otherwise(F.col("key"))).withColumn("down", F.col("d.own"))
    x = met.where("own").select("key", F.col("id").alias("x"), F.col("down").alias("dx"), *(F.col(c).alias(f"x{c}") for c in counts))
    y = met.select("key", F.col("id").alias("y"), F.col("down").alias("dy"), *(F.col(c).alias(f"y{c}") for c in counts))
    apart = sum((F.abs(F.col(f"x{c}") - F.col(f"y{c}")) for c in counts), F.lit(0))
    # the shorter string of digits need not be the shorter line's
    close = x.join(y, (x["key"] == y["key"]) & (F.col("x") != F.col("y")) & (F.col("dx") | F.col("dy")) & (apart <= 2 * tau))
    return materialize(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs"), texts


def links(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, max_broadcast: int = 200_000) -> DataFrame:
    """(a, b, edits): distinct lines (MD5 of each) within tau edits (one, if the shorter is under min_chars), a < b."""
    pairs, texts = candidates(docs, tau, min_chars, max_broadcast)
    ta, tb = (texts.select(F.col("id").alias(c), F.col("node").alias(f"n{c}"), F.col("line").alias(f"t{c}")) for c in "ab")
    near = pairs.join(ta, "a").join(tb, "b").where(plausible(F.col("ta"), F.col("tb"), tau))
    most = F.when(F.least(F.length("ta"), F.length("tb")) >= min_chars, tau).otherwise(1)
    measured = near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), edits(F.col("ta"), F.col("tb"), tau).alias("edits"), most.alias("_most"))
    return materialize(measured.where("edits <= _most").drop("_most"), "measured")


def classes(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, first_doc, first_line, n_links) of every line.

    first_doc and first_line are where its class occurs first (null for blank lines); n_links counts the different
    lines within tau edits of it.
    """
    found = links(docs, tau, min_chars)
    labels = components(found)
    degree = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    about = materialize(labels.join(degree, "node"), "about")
    rows = lines_of(docs).select("doc_id", "line_no", F.when(F.regexp_replace("line", r"^\s+", "") != "", _node(F.col("line"))).alias("node"))
    rows = rows.join(about, "node", "left").select("doc_id", "line_no", F.coalesce("label", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = materialize(rows, "rows")
    place = F.struct(F.col("doc_id"), F.col("line_no"))
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("_f")).select("class", F.col("_f.doc_id").alias("first_doc"), F.col("_f.line_no").alias("first_line"))
    return rows.join(first, "class", "left").select("doc_id", "line_no", "first_doc", "first_line", "n_links")


def dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text): texts without the lines whose class occurs earlier; needs distinct, non-null doc_id."""
    keep = classes(docs, tau, min_chars).where(F.col("first_doc").isNull() | ((F.col("first_doc") == F.col("doc_id")) & (F.col("first_line") == F.col("line_no"))))
    rows = lines_of(docs).join(keep.select("doc_id", "line_no"), ["doc_id", "line_no"])
    kept = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(kept, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
