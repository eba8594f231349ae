"""Prompt text and its token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textops import LINE_BREAK, strip

# The prompt sections.
PREFIX = "### Database schema:\n"
MIDDLE = "\n\n### Question:\n"
ENDING_CONTINUE = "\n\n### SQL:\nSELECT "
ENDING_ANSWER = "\n\n### SQL:\n"
CONTEXT = 1024

Tokenizer = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    """Default tokenizer: words with the whitespace before them; trailing whitespace is one more token."""
    return F.regexp_extract_all(text, F.lit(r"\s*\S+|\s+"), F.lit(0))


def build_prompt(schema: Column, question: Column, ending: str = ENDING_CONTINUE) -> Column:
    """Schema, question and SQL heading."""
    return F.concat(F.lit(PREFIX), schema, F.lit(MIDDLE), question, F.lit(ending))


def pack_prompts(
    rows: DataFrame,
    schema: str = "schema_compact",
    question: str = "question_text_filled",
    max_new_tokens: int = 128,
    context: int = CONTEXT,
    tokens: Tokenizer = word_tokens,
    ending: str = ENDING_CONTINUE,
) -> DataFrame:
    """Add ``prompt_schema``, ``prompt_question`` and ``prompt_tokens`` within the context budget.

    Whole schema lines are kept in order up to the first that no longer fits. A question too long for the
    budget keeps its last tokens, 32 at least.
    """
    budget = context - max_new_tokens
    if budget <= 0:
        raise ValueError(f"max_new_tokens={max_new_tokens} leaves no room in a context of {context}")
    rows = rows.withColumn("_q", tokens(F.col(question)))
    frame = F.size(tokens(F.lit(PREFIX))) + F.size(tokens(F.lit(MIDDLE))) + F.size(tokens(F.lit(ending)))
    keep = F.greatest(F.lit(32), F.lit(budget) - frame)
    tail = F.slice(F.col("_q"), F.greatest(F.size("_q") - keep + 1, F.lit(1)), keep)
    rows = rows.withColumn(
        "_q", F.when(frame + F.size("_q") > budget, tail).otherwise(F.col("_q"))
    ).withColumn("_room", F.greatest(F.lit(0), F.lit(budget) - frame - F.size("_q")))
    rows = rows.withColumn(
        "_lines", F.filter(F.split(F.col(schema), LINE_BREAK, -1), lambda line: strip(line) != "")
    ).withColumn(
        "_sizes", F.transform("_lines", lambda line: F.size(tokens(F.concat(line, F.lit("\n")))))
    )
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def take(state: Column, size: Column) -> Column:
        fits = state["open"] & (state["used"] + size <= F.col("_room"))
        return F.struct(
            F.when(fits, state["used"] + size).otherwise(state["used"]).alias("used"),
            F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"),
            fits.alias("open"),
        )

    kept = F.aggregate("_sizes", start, take)["kept"]
    packed = rows.withColumn(
        "prompt_schema", F.coalesce(F.array_join(F.slice("_lines", F.lit(1), kept), "\n"), F.lit(""))
    ).withColumn("prompt_question", F.array_join("_q", ""))
    count = frame + F.size("_q") + F.size(tokens(F.col("prompt_schema")))
    return packed.withColumn("prompt_tokens", count).drop("_q", "_room", "_lines", "_sizes")
