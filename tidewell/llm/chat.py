"""Chat formatting in budgeted windows (operator 1). DataFrame operations only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Each span becomes a window: the conversation's
first system turn (if it came earlier), then the latest earlier turns that fit the history budget, then the span's own
turns. Only the span's assistant texts are under the loss mask, so a repeated target is never trained on twice. A
window keeps to the token budget unless single turns leave no room for it; turns are never cut.

    <|chat|><|role|>text<|end|><|role|>text<|end|>...

Control strings all start with `<`. In roles and texts `\\ < [ |` become `\\0 \\1 \\2 \\3`, which is undone by replacing
them in the order 1, 2, 3, 0; so no text can imitate a control string.

Turns go by (turn, role, text), null turn first; null role and text are empty; a null conv_id is a conversation of its
own. Repeated rows are separate turns. A conversation may be of any length: prefix sums are two-level, by blocks of
turns. Extra columns are ignored. An empty table has no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

BUDGET, HISTORY, TURN_COST, BLOCK = 512, 96, 4, 64
START, END = "<|chat|>", "<|end|>"
_ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("|", "\\3"))


def escape(x: Column) -> Column:
    for raw, coded in _ESCAPES:
        x = F.replace(x, F.lit(raw), F.lit(coded))
    return x


def unescape(x: Column) -> Column:
    for raw, coded in _ESCAPES[1:] + _ESCAPES[:1]:
        x = F.replace(x, F.lit(coded), F.lit(raw))
    return x


def _tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"[^ \t\n\r]+")) + TURN_COST).cast("long")


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with pos, their place in the conversation, t, their tokens, and c, the tokens before them."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("t", _tokens(F.col("text"))).withColumn("blk", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "blk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pos", F.row_number().over(inside) - 1).withColumn("c", F.coalesce(F.sum("t").over(before), F.lit(0)))
    blocks = turns.select(F.col("conv_id").cast("long").alias("k"), F.floor(F.col("turn") / BLOCK).alias("b"), _tokens(F.coalesce("text", F.lit(""))).alias("_t")).groupBy("k", "b").agg(F.sum("_t").alias("_t"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("k").orderBy(F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("k", "b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    joined = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("k")) & F.col("blk").eqNullSafe(F.col("b")))
    return joined.select("conv_id", "role", "text", "t", (F.col("pos") + F.col("_n")).alias("pos"), (F.col("c") + F.col("_t")).alias("c"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_context, n_turns, n_tokens, formatted, loss_spans): one row per window.

    The first n_context turns of a window are repeated; loss_spans are (start, length) in code points of formatted.
    """
    placed = materialize(_placed(turns), "turns")
    system = F.when(F.col("role") == "system", F.struct("pos", "c", "t", "text"))
    about = placed.groupBy(F.col("conv_id").alias("k")).agg(F.max("t").alias("_most"), F.min(system).alias("sys"))
    room = F.greatest(F.lit(history), budget - history - F.coalesce("sys.t", F.lit(0)) - F.col("_most") + 1)
    about = about.select("k", "sys", room.alias("room"))
    rows = placed.join(about, F.col("conv_id").eqNullSafe(F.col("k"))).withColumn("span", F.floor(F.col("c") / F.col("room"))).drop("k")
    rows = materialize(rows, "spans")
    spans = rows.groupBy("conv_id", "span").agg(F.min("c").alias("_start"), F.first("sys").alias("sys"), F.first("room").alias("room"))
    order = Window.partitionBy("conv_id").orderBy("span")
    spans = spans.withColumn("_next", F.lead("span").over(order)).withColumn("_next_start", F.lead("_start").over(order))
    own = rows.select("conv_id", F.col("span").alias("window"), F.lit(2).alias("kind"), "pos", "t", "role", "text")
    link = spans.where("_next IS NOT NULL").select(F.col("conv_id").alias("k"), F.col("span").alias("s"), "_next", "_next_start")
    past = (
        rows.join(link, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("span") == F.col("s")))
        .where((F.col("c") >= F.col("_next_start") - history) & ~F.col("pos").eqNullSafe(F.col("sys.pos")))
        .select("conv_id", F.col("_next").alias("window"), F.lit(1).alias("kind"), "pos", "t", "role", "text")
    )
    kept = spans.where(F.col("span") > F.floor(F.col("sys.c") / F.col("room"))).select("conv_id", F.col("span").alias("window"), F.lit(0).alias("kind"), "sys.pos", "sys.t", F.lit("system").alias("role"), "sys.text")
    parts = kept.union(past).union(own)
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    parts = parts.withColumn("_body", escape(F.col("text"))).withColumn("_head", head).withColumn("piece", F.concat("_head", "_body", F.lit(END)))
    ahead = Window.partitionBy("conv_id", "window").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(ahead), F.lit(0)) + len(START) + F.length("_head")
    target = F.when((F.col("kind") == 2) & (F.col("role") == "assistant"), F.struct(at.cast("int").alias("start"), F.length("_body").alias("length")))
    parts = parts.select("conv_id", "window", "kind", "pos", "t", "piece", target.alias("target"))
    packed = parts.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "pos", "piece", "target"))).alias("p"),
        F.count_if(F.col("kind") < 2).alias("n_context"),
        F.count_if(F.col("kind") == 2).alias("n_turns"),
        F.sum("t").alias("n_tokens"),
    )
    return packed.select(
        "conv_id",
        "window",
        "n_context",
        "n_turns",
        "n_tokens",
        F.concat(F.lit(START), F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("formatted"),
        F.filter(F.transform("p", lambda x: x["target"]), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<struct(role, text)>, loss_text) from windows: fresh turns and masked texts, unescaped."""
    body = F.substr("formatted", F.lit(len(START) + 1))
    pieces = F.split(body, r"<\|end\|>")
    fresh = F.slice(pieces, (F.col("n_context") + 1).cast("int"), F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("n_context")).cast("int"))
    turns = F.transform(
        fresh,
        lambda x: F.struct(
            unescape(F.substr(F.substring_index(x, "|>", 1), F.lit(3))).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "|>", 1)) + 3)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: what was written and what is under the loss mask."""
    read = read_back(formatted.select("conv_id", "window", "n_context", "formatted", "loss_spans"))
    chars = formatted.select(F.col("conv_id").alias("k"), F.length("formatted").alias("_chars")).groupBy("k").agg(F.sum("_chars").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    per = read.select("conv_id", "window", F.size("turns").alias("n"), told.alias("told"), "loss_text").groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "told", "loss_text"))).alias("w")
    )
    joined = per.withColumn("_told", F.array_join(F.transform("w", lambda x: x["told"]), "")).withColumn("_loss", F.array_join(F.transform("w", lambda x: x["loss_text"]), ""))
    return joined.join(chars, F.col("conv_id").eqNullSafe(F.col("k"))).select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("_told"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
