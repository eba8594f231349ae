"""A whole evaluation run as a few DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import dataset_tables, fk_graph, schema_profiles
from ..operators.comparison import match_outcomes
from ..operators.execution import TIME_LIMIT_S, Datasets, run_pairs
from ..operators.linking import attach_profile, link_schema
from ..operators.metrics import in_report_order, summarize
from ..operators.naming import clean_prediction, table_case
from ..operators.prompts import Tokenizer, pack_prompts, word_tokens
from ..operators.questions import prepare_questions
from ..operators.records import assemble_records, attach_predictions
from ..operators.runlog import canonical_runlog, question_rows
from .scratch import materialize


def prepare_run(
    entries: DataFrame,
    catalog: DataFrame,
    foreign_keys: DataFrame | None = None,
    limit: int = 0,
    max_tables: int = 12,
    max_new_tokens: int = 128,
    tokens: Tokenizer = word_tokens,
) -> DataFrame:
    """Typed entries to questions with gold SQL, relevant schema and prompt: the input of the models."""
    graph = fk_graph(foreign_keys) if foreign_keys is not None else None
    questions = prepare_questions(entries, limit)
    profiles = materialize(schema_profiles(catalog, graph), "profiles")
    linked = link_schema(questions, profiles, max_tables)
    packed = pack_prompts(linked, max_new_tokens=max_new_tokens, tokens=tokens)
    named = attach_profile(packed, materialize(dataset_tables(catalog), "tables"))
    return named.withColumn(
        "gold_sql_exec",
        F.when(F.col("tables").isNull(), F.col("gold_sql_exec")).otherwise(
            table_case(F.col("gold_sql_exec"), F.col("tables"))
        ),
    )


def evaluate_run(
    prepared: DataFrame,
    predictions: DataFrame,
    llm: str,
    rdbms: str,
    parallel: int = 4,
    timeout_s: float | None = TIME_LIMIT_S,
    spelling: str = "dotted",
    datasets: Datasets | None = None,
) -> DataFrame:
    """Prepared questions and model output (by ``dataset, id``) to run-log records.

    With ``datasets`` both texts of a question run on the tables of its dataset; without, on what the session sees.
    """
    # Written once: the texts to run and the join of their outcomes both read it.
    cleaned = materialize(
        clean_prediction(attach_predictions(prepared, predictions, ["dataset", "id"])), "cleaned"
    )
    outcomes = match_outcomes(run_pairs(cleaned, parallel=parallel, timeout_s=timeout_s, datasets=datasets))
    return assemble_records(outcomes, llm, rdbms, spelling)


def report(records: DataFrame) -> DataFrame:
    """Run-log records of any spelling to the ordered summary; the log is read once."""
    return in_report_order(summarize(question_rows(canonical_runlog(records))))
