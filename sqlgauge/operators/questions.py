"""From corpus entries to numbered, filled and classified questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fills import fill_substrings, fill_tokens, merge_variables
from ..functions.sqltext import sql_difficulty
from ..plans.ordering import BLOCK, sum_before


def number_entries(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``first_id``: how many questions the preceding entries of the dataset hold."""
    return sum_before(entries, ["dataset"], "entry_pos", F.size("sentence_list"), "first_id", block)


def flatten_questions(entries: DataFrame) -> DataFrame:
    """One row per sentence with its metadata; missing text fields are empty, other variables an empty map.

    Works on typed entries; when they were numbered, ``id`` counts from 0 in (entry, sentence) order.
    """
    rows = entries.select("*", F.posexplode("sentence_list").alias("sent_pos", "_s"))
    no_map = F.create_map().cast("map<string,string>")
    questions = rows.select(
        *[c for c in entries.columns if c != "sentence_list"],
        "sent_pos",
        F.coalesce("_s.text", F.lit("")).alias("question_text"),
        F.coalesce("_s.question-split", F.lit("")).alias("question_split"),
        F.coalesce(
            F.from_json(
                F.when(F.startswith("_s.variables", F.lit("{")), F.col("_s.variables")), "map<string,string>"
            ),
            no_map,
        ).alias("variables"),
        F.col("_s.difficulty").alias("sentence_difficulty"),
    )
    if "first_id" in questions.columns:
        questions = questions.withColumn("id", F.col("first_id") + F.col("sent_pos")).drop("first_id")
    return questions


def limit_questions(questions: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` questions of each dataset; ``n <= 0`` keeps all."""
    return questions.where(F.col("id") < n) if n > 0 else questions


def limit_entries(numbered: DataFrame, n: int = 0) -> DataFrame:
    """Whole entries until at least ``n`` questions are reached; ``n <= 0`` keeps all."""
    return numbered.where(F.col("first_id") < n) if n > 0 else numbered


def from_entry(entries: DataFrame, start: int) -> DataFrame:
    """Entries at position ``start`` and later."""
    return entries.where(F.col("entry_pos") >= start)


def with_gold_first(questions: DataFrame) -> DataFrame:
    """Add ``gold_sql_first``: the first variant, or empty text."""
    return questions.withColumn("gold_sql_first", F.coalesce(F.get("sql_variants", F.lit(0)), F.lit("")))


def fill_questions(questions: DataFrame, mode: str = "token") -> DataFrame:
    """Add ``question_text_filled``; mode is ``token``, ``token_skip_null`` or ``substring``."""
    text, variables = F.col("question_text"), F.col("variables")
    if mode == "substring":
        filled = fill_substrings(text, variables)
    elif mode in ("token", "token_skip_null"):
        filled = fill_tokens(text, variables, skip_null=mode == "token_skip_null")
    else:
        raise ValueError(f"unknown fill mode: {mode}")
    return questions.withColumn("question_text_filled", filled)


def fill_gold(questions: DataFrame) -> DataFrame:
    """Add ``gold_sql_exec``: the first variant with sentence values, else entry examples, filled in."""
    merged = merge_variables(F.col("variables"), F.col("entry_variables"))
    filled = fill_tokens(F.col("gold_sql_first"), merged, skip_null=True)
    return questions.withColumn("gold_sql_exec", filled)


def with_difficulty(questions: DataFrame) -> DataFrame:
    """Add ``difficulty``: sentence value, else entry value, else derived from the first variant, else 1."""
    derived = F.when(F.size("sql_variants") > 0, sql_difficulty(F.get("sql_variants", F.lit(0)))).otherwise(1)
    return questions.withColumn(
        "difficulty",
        F.coalesce(
            F.col("sentence_difficulty").try_cast("int"), F.col("entry_difficulty").try_cast("int"), derived
        ),
    )


def with_entry_difficulty(questions: DataFrame) -> DataFrame:
    """Add ``difficulty`` as the entry states it, or "unknown"."""
    return questions.withColumn("difficulty", F.coalesce("entry_difficulty", F.lit("unknown")))


def prepare_questions(entries: DataFrame, limit: int = 0, fill: str = "token") -> DataFrame:
    """Typed entries to complete questions: numbered, limited, filled, classified."""
    questions = limit_questions(flatten_questions(number_entries(entries)), limit)
    return with_difficulty(fill_gold(with_gold_first(fill_questions(questions, fill))))
