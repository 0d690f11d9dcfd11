"""Mixing sources to target weights by pivotal dependent rounding (operator 4). DataFrame operations only.

A source's target divided by its size is the expected number of copies of each of its documents: a whole part that
every document gets, and a fractional part to be rounded. Rounding pairs two fractional documents and moves mass
(words) from one to the other at random, keeping each one's expectation and the pair's words, until one of the two is
0 or 1; the other goes on to the next pair. A group of about `FAN` documents is folded so in one array expression and
leaves one residual; residuals of a source are folded in groups again, level by level, until each source has one,
which is rounded by a last draw. So a source's words differ from its target by less than one document's, and no
group, however hot its source, is more than a few hundred rows. Draws are hashes of the rows, so reruns agree.

Sizes count runs of non-white-space (ASCII white space); null text has 0. Sources rank by code point, null last, with
weights repeating; a target stops at `CAP` times its source's size and the excess is shared among the others by
weight (water-filling, in closed form). A source of size 0 has target 0, and documents of size 0 take no words and get
the whole part only. Rows that are equal in all columns are separate documents (so they may be taken unequally often);
they are numbered by input partition first, so that one row repeated very often is no task's alone. A null doc_id is as
good as any. Very long texts and extra columns of any type and name only pass through. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ._common import materialize

WEIGHTS, SHARE, CAP, FAN = (3.0, 1.0, 2.0), 1.5, 2.0, 64
#: Copies of equal rows that one task writes.
_CHUNK = 1024
#: A fraction this close to a whole number is whole.
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source."""
    total = F.sum("source_size").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", (share * total).alias("_all"), weight.alias("_w"))
    # sources fill up in the order of cap / weight; a source is full if the level at its turn is above that ratio
    turn = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    rows = rows.withColumn("_cap", cap * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = F.coalesce(F.sum("_cap").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(turn.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_all") - before) / rest)
    level = F.min_by(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), F.when(F.col("_level") <= F.col("_ratio"), F.col("_ratio"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap"))).alias("target"))


def _draw(*cols) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * (2.0**-53)


def _fold(items: Column) -> Column:
    """struct(done array<struct(key, n, up)>, left struct(key, n, s, f) or null) of an array of struct(o, key, n, s, f)."""
    unit, done = "struct<key:bigint,n:bigint,s:double,f:double>", "array<struct<key:bigint,n:bigint,up:int>>"
    zero = F.struct(F.lit(None).cast(done).alias("none"), F.lit(None).cast(unit).alias("left"), F.expr(f"cast(array() as {done})").alias("done"))

    def whole(x: Column, f: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["n"].alias("n"), F.when(f > 0.5, 1).otherwise(0).cast("int").alias("up"))

    def part(x: Column, f: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["n"].alias("n"), x["s"].alias("s"), f.alias("f"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        # mass (words) that can move from a to x, and from x to a, until one of them is 0 or 1
        give = F.least(a["f"] * a["s"], (1 - x["f"]) * x["s"])
        take = F.least((1 - a["f"]) * a["s"], x["f"] * x["s"])
        move = F.when(_draw(a["key"], a["n"], x["key"], x["n"]) * (give + take) < take, -give).otherwise(take)
        fa, fx = a["f"] + move / a["s"], x["f"] - move / x["s"]
        a_whole, x_whole = (fa < _EPS) | (fa > 1 - _EPS), (fx < _EPS) | (fx > 1 - _EPS)
        settled = F.struct(
            acc["none"].alias("none"),
            F.when(~a_whole, part(a, fa)).when(~x_whole, part(x, fx)).alias("left"),
            F.concat(acc["done"], F.when(a_whole & x_whole, F.array(whole(a, fa), whole(x, fx))).when(a_whole, F.array(whole(a, fa))).otherwise(F.array(whole(x, fx)))).alias("done"),
        )
        begun = F.struct(acc["none"].alias("none"), part(x, x["f"]).alias("left"), acc["done"].alias("done"))
        return F.when(a.isNull(), begun).otherwise(settled)

    return F.aggregate(items, zero, step)


def rounded(units: DataFrame) -> DataFrame:
    """(key, n, up): each fractional unit (source, key, n, s, f) rounded up (1) or down (0)."""
    out, level = None, 0
    while True:
        many = units.groupBy("source").agg(F.count("*").alias("_k"))
        groups = F.greatest(F.lit(1), F.ceil(F.col("_k") / FAN))
        sized = many.select(F.col("source").alias("_src"), groups.alias("_g"))
        dealt = units.join(sized, F.col("source").eqNullSafe(F.col("_src")))
        dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("key", "n", F.lit(level)), F.col("_g")))
        item = F.struct(F.xxhash64("key", "n", F.lit(-1 - level)).alias("o"), "key", "n", "s", "f")
        folded = dealt.groupBy("source", "_b").agg(F.sort_array(F.collect_list(item)).alias("_items"), F.max("_g").alias("_g")).select("source", "_g", _fold(F.col("_items")).alias("_x"))
        folded = materialize(folded, f"level{level}")
        done = folded.select(F.explode("_x.done").alias("d")).select("d.*")
        out = done if out is None else out.union(done)
        left = folded.where("_x.left IS NOT NULL").select("source", "_g", "_x.left.*")
        if folded.where("_g > 1").isEmpty():
            last = left.select("key", "n", (_draw("key", "n", F.lit(7)) < F.col("f")).cast("int").alias("up"))
            return out.union(last)
        units, level = left.drop("_g"), level + 1


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def _row_key(docs: DataFrame) -> Column:
    """A hash of the whole row; maps, which have no hash, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if _has_map(f.dataType) else F.col(f.name) for f in docs.schema])


def _numbered(sized: DataFrame) -> DataFrame:
    """sized with n, 1 to the number of equal rows: counted by input partition, then in each."""
    counts = sized.groupBy("key", "part").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("part"))
    return sized.withColumn("_place", place).join(counts, ["key", "part"]).withColumn("n", (F.col("_before") + F.col("_place")).cast("long")).drop("part", "_place", "_before")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, n, doc_id, size, source_size, target, copies): one row per document, without its text."""
    sized = docs.select(_row_key(docs).alias("key"), F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = materialize(sized, "sizes")
    numbered = _numbered(sized)
    goal = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target")
    rows = numbered.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(x + _EPS)
    rows = rows.withColumn("_whole", whole).withColumn("_f", F.greatest(x - whole, F.lit(0.0)))
    rows = materialize(rows, "expected")
    units = rows.where((F.col("_f") > _EPS) & (F.col("size") > 0)).select("source", "key", "n", F.col("size").cast("double").alias("s"), F.col("_f").alias("f"))
    ups = rounded(units)
    return rows.join(ups, ["key", "n"], "left").select("key", "n", "doc_id", "size", "source_size", "target", (F.col("_whole") + F.coalesce("up", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns."""
    copies = plan(docs, weights, share, cap).groupBy("key").agg(F.sum("copies").alias("times")).where("times > 0")
    # equal rows are one row taken as often as all of them; they meet before the shuffle
    rows = docs.select(_row_key(docs).alias("key"), F.struct(*docs.columns).alias("row")).groupBy("key").agg(F.first("row").alias("row")).join(copies, "key")
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / _CHUNK)))
    often = rows.where(F.col("times") > _CHUNK).withColumn("chunk", chunks).repartition("key", "chunk")
    often = often.select("row", F.least(F.lit(_CHUNK), F.col("times") - F.col("chunk") * _CHUNK).alias("times"))
    each = rows.where(F.col("times") <= _CHUNK).select("row", "times").union(often)
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
