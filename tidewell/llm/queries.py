"""The training-data operators' queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their budgeted windows."""
    from pyspark.sql import functions as F

    from .chat import digests, windows

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), role, F.lit("</s>[INST] ok [/INST]"))
    return digests(windows(turns.union(extra)))


def op2_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as sorted-string-table shards and read back."""
    from .sst import encode_and_read_back

    return encode_and_read_back(_docs(spark, sf_dir))


def op3_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from .minhash import classes

    return classes(_docs(spark, sf_dir))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from pyspark.sql import functions as F

    from .mixing import plan

    return plan(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of documents that are benchmark items, within the edit budget."""
    from .decontaminate import leaks

    return leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_improbable_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improbable-feature digests of all documents and of their edited texts."""
    from .fingerprint import with_next

    return with_next(_docs(spark, sf_dir))


def op7_edit_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every line of the documents."""
    from .lines import classes

    return classes(_docs(spark, sf_dir))


def op8_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from pyspark.sql import functions as F

    from .toxicity import is_held_out, score

    out = score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document."""
    from .lm import score

    return score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .wrappers import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_budgeted_chat,
        op2_sstable_tokens,
        op3_probminhash_dedup,
        op4_pivotal_mixing,
        op5_qgram_decontamination,
        op6_improbable_fingerprints,
        op7_edit_join_lines,
        op8_bigru_toxicity,
        op9_cross_entropy_difference,
        op10_wrapper_main_text,
    )
}
#: Escaped length: \ < [ | become two characters.
_ESCAPED = r"(length({0}) + length(regexp_replace({0}, '[^\\<\[|]', '', 'g')))"
_OP1 = (
    "WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
    " UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),"
    r" t1 AS (SELECT *, len(regexp_extract_all(text, '[^ \t\n\r]+')) + 4 AS t FROM t0),"
    " t2 AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(sum(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM t1"
    " WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),"
    " a AS (SELECT conv_id, max(t) AS most, min(CASE WHEN role = 'system' THEN pos END) AS spos FROM t2 GROUP BY 1),"
    " b AS (SELECT a.*, y.c AS sc, y.t AS st, y.role AS srole, y.text AS stext FROM a LEFT JOIN t2 y ON a.conv_id = y.conv_id AND y.pos = spos),"
    " s AS (SELECT t2.*, spos, sc, stext, greatest(96, 512 - 96 - coalesce(st, 0) - most + 1) AS room, c // greatest(96, 512 - 96 - coalesce(st, 0) - most + 1) AS span FROM t2 JOIN b USING (conv_id)),"
    " n AS (SELECT conv_id, span, any_value(sc) AS sc, any_value(room) AS room, any_value(stext) AS stext, lead(min(c)) OVER (PARTITION BY conv_id ORDER BY span) AS nstart FROM s GROUP BY conv_id, span),"
    " p AS (SELECT conv_id, 11 + {role} + {text} AS n FROM s"
    " UNION ALL SELECT s.conv_id, 11 + {role} + {text} FROM s JOIN n ON s.conv_id = n.conv_id AND s.span = n.span WHERE c >= nstart - 96 AND pos IS DISTINCT FROM spos"
    " UNION ALL SELECT conv_id, 17 + {stext} FROM n WHERE span > sc // room UNION ALL SELECT conv_id, 8 FROM n),"
    " f AS (SELECT conv_id, sum(n)::BIGINT AS formatted_chars FROM p GROUP BY 1),"
    " d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,"
    " coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss FROM t0 GROUP BY 1)"
    " SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN f USING (conv_id)"
)
for _name in ("role", "text", "stext"):
    _OP1 = _OP1.replace("{" + _name + "}", _ESCAPED.format({"role": "s.role", "text": "s.text", "stext": "stext"}[_name]))

#: The other queries can't be written in SQL; their tests compare them with brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op1_budgeted_chat": _OP1}
