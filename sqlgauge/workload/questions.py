"""Queries over the question corpus: numbering, limits, metadata, fills, difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import questions as Q
from ..sources.corpus import entry_from_json, typed_entries
from .inputs import CORPUS, CORPUS_BASE, QUESTIONS
from .registry import query, run

# Blocks far smaller than the default so that the checks cross many block borders.
BLOCK = 256


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return typed_entries(entry_from_json(run(spark, sf, CORPUS, busy="customer")))


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return Q.number_entries(entries(spark, sf), BLOCK)


def flatten(entries: DataFrame) -> DataFrame:
    return Q.flatten_questions(entries).withColumn("sent_pos", F.col("sent_pos").cast("long"))


def flat(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(entries(spark, sf))


KEYS = ("dataset", "entry_pos", "sent_pos")
_ORACLE_KEYS = "dataset, entry_pos, CAST(sent_pos AS BIGINT) AS sent_pos"


@query("q1_flatten", f"SELECT {_ORACLE_KEYS}, question_text FROM ({QUESTIONS}) q")
def q1(spark, sf):
    return flat(spark, sf).select(*KEYS, "question_text")


@query("q2_sequential_id", f"SELECT {_ORACLE_KEYS}, id FROM ({QUESTIONS}) q")
def q2(spark, sf):
    return flatten(numbered(spark, sf)).select(*KEYS, "id")


@query("q3_question_limit", f"SELECT {_ORACLE_KEYS}, id FROM ({QUESTIONS}) q WHERE id < 37")
def q3(spark, sf):
    return Q.limit_questions(flatten(numbered(spark, sf)), 37).select(*KEYS, "id")


@query(
    "q4_entry_limit",
    f"""SELECT dataset, c AS entry_pos FROM (SELECT b.*,
      coalesce(sum(CASE WHEN c % 13 = 0 THEN 0 ELSE 2 END) OVER (PARTITION BY dataset ORDER BY c
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM ({CORPUS_BASE}) b) x WHERE before < 33""",
)
def q4(spark, sf):
    return Q.limit_entries(numbered(spark, sf), 33).select("dataset", "entry_pos")


@query(
    "q5_entry_offset",
    f"SELECT {_ORACLE_KEYS}, question_text FROM ({QUESTIONS}) q WHERE entry_pos >= 100",
)
def q5(spark, sf):
    return flatten(Q.from_entry(entries(spark, sf), 100)).select(*KEYS, "question_text")


@query(
    "q6_metadata",
    f"""SELECT {_ORACLE_KEYS}, query_split, question_split,
      CASE WHEN has_vars THEN coalesce(v_seg, 'NULL') ELSE 'none' END AS segment_value,
      CASE WHEN has_vars THEN 2 ELSE 0 END AS n_variables FROM ({QUESTIONS}) q""",
)
def q6(spark, sf):
    v = F.col("variables")
    return flat(spark, sf).select(
        *KEYS, "query_split", "question_split",
        F.when(F.size(v) > 0, F.coalesce(v["segment0"], F.lit("NULL"))).otherwise("none").alias("segment_value"),
        F.size(v).alias("n_variables"),
    )


@query(
    "q7_sql_variants",
    f"""SELECT dataset, entry_pos, CASE c % 10 WHEN 0 THEN 1 WHEN 9 THEN 0 ELSE 2 END AS n_variants,
      CASE WHEN c % 10 = 9 THEN '' ELSE tmpl END AS gold_sql_first FROM ({CORPUS_BASE}) b""",
)
def q7(spark, sf):
    return Q.with_gold_first(entries(spark, sf)).select(
        "dataset", "entry_pos", F.size("sql_variants").alias("n_variants"), "gold_sql_first"
    )


def _fill(text: str, name: str, value: str) -> str:
    return f"regexp_replace({text}, '\\b{name}\\b', {value}, 'g')"


_SEG = "CASE WHEN has_vars THEN coalesce(v_seg, 'None') ELSE 'segment0' END"
_SEG_KEEP = "coalesce(v_seg, 'segment0')"
_NAT = "coalesce(v_nat, 'nation0')"


@query(
    "q8_fill_token",
    f"""SELECT {_ORACLE_KEYS}, {_fill(_fill('question_text', 'segment0', _SEG), 'nation0', _NAT)}
      AS question_text_filled FROM ({QUESTIONS}) q""",
)
def q8(spark, sf):
    return Q.fill_questions(flat(spark, sf)).select(*KEYS, "question_text_filled")


@query(
    "q9_fill_token_skip_null",
    f"""SELECT {_ORACLE_KEYS}, {_fill(_fill('question_text', 'segment0', _SEG_KEEP), 'nation0', _NAT)}
      AS question_text_filled FROM ({QUESTIONS}) q""",
)
def q9(spark, sf):
    return Q.fill_questions(flat(spark, sf), "token_skip_null").select(*KEYS, "question_text_filled")


@query(
    "q10_fill_substring",
    f"""SELECT {_ORACLE_KEYS}, replace(replace(question_text, 'segment0', {_SEG}), 'nation0', {_NAT})
      AS question_text_filled FROM ({QUESTIONS}) q""",
)
def q10(spark, sf):
    return Q.fill_questions(flat(spark, sf), "substring").select(*KEYS, "question_text_filled")


_NUMBER = "CASE WHEN c % 17 <> 0 THEN CAST(c % 100 AS VARCHAR) END"
_REGION = "CASE WHEN c % 17 <> 0 THEN 'ASIA' END"
_MERGED_SEG = "CASE WHEN has_vars THEN v_seg WHEN c % 17 <> 0 THEN 'EX' END"


@query(
    "q11_merge_variables",
    f"""SELECT {_ORACLE_KEYS}, {_MERGED_SEG} AS segment0, v_nat AS nation0, {_NUMBER} AS number0,
      {_REGION} AS region0, CASE WHEN has_vars THEN 2 ELSE CASE WHEN c % 17 <> 0 THEN 1 ELSE 0 END END
        + CASE WHEN c % 17 <> 0 THEN 2 ELSE 0 END AS n_variables
      FROM ({QUESTIONS}) q""",
)
def q11(spark, sf):
    merged = Q.merge_variables(F.col("variables"), F.col("entry_variables"))
    rows = flat(spark, sf).withColumn("m", merged)
    names = ("segment0", "nation0", "number0", "region0")
    return rows.select(*KEYS, *[F.col("m")[n].alias(n) for n in names], F.size("m").alias("n_variables"))


_GOLD = "gold_sql_first"
for _name, _value in (("segment0", _MERGED_SEG), ("nation0", "v_nat"), ("number0", _NUMBER), ("region0", _REGION)):
    _GOLD = _fill(_GOLD, _name, f"coalesce({_value}, '{_name}')")


@query("q12_fill_gold", f"SELECT {_ORACLE_KEYS}, {_GOLD} AS gold_sql_exec FROM ({QUESTIONS}) q")
def q12(spark, sf):
    return Q.fill_gold(Q.with_gold_first(flat(spark, sf))).select(*KEYS, "gold_sql_exec")
