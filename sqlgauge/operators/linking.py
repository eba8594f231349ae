"""Which tables a question is about: scoring, top-k, foreign-key neighbours.

Each question carries its dataset's schema profile as one array, so scoring is a narrow step: no join
emits question-table pairs. The profile side is one row per dataset, best written once (``plans.scratch``):
its size is then known, so Spark broadcasts it when it is small and splits hot datasets on the question side
when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.idents import question_tokens
from ..functions.similarity import best_ratio_per_group
from ..session import ship_package


def attach_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left-join per-dataset columns onto rows."""
    return rows.join(profiles, "dataset", "left")


def rank_tables(
    questions: DataFrame,
    profiles: DataFrame,
    question: str = "question_text_filled",
    table_weight: float = 3.0,
    col_weight: float = 1.0,
    fuzzy_weight: float = 0.25,
) -> DataFrame:
    """Add ``ranked`` (table, score, place in ``schema``): all tables of the dataset by falling score, then name.

    Score: weighted count of question tokens among table-name and column tokens, plus the weighted best
    similarity of any question token to any table-name token.
    """
    rows = attach_profile(questions, profiles).withColumn("_tokens", question_tokens(F.col(question)))
    rows = rows.withColumn("_distinct", F.array_distinct("_tokens"))
    if fuzzy_weight:
        ship_package(questions.sparkSession)
        signature = F.array_join(
            F.transform("schema", lambda t: F.array_join(t["name_tokens"], " ")), "|"
        )
        near = best_ratio_per_group(
            F.array_join("_distinct", " "), F.coalesce(signature, F.lit(""))
        )
        rows = rows.withColumn("_near", near)

    # Two references to the token set, so the optimizer keeps it as a column of its own instead of
    # tokenizing the question again for every table.
    def scored(t: Column, i: Column) -> Column:
        score = (
            F.lit(float(table_weight)) * F.size(F.array_intersect(F.col("_distinct"), t["name_tokens"]))
            + F.lit(float(col_weight)) * F.size(F.array_intersect(F.col("_distinct"), t["column_tokens"]))
        )
        if fuzzy_weight:
            score = score + F.lit(float(fuzzy_weight)) * F.get(F.col("_near"), i)
        return F.struct((-score).alias("order"), t["name"].alias("table"), i.alias("at"))

    ranked = F.transform(
        F.array_sort(F.transform("schema", scored)),
        lambda r: F.struct(r["table"], (-r["order"]).alias("score"), r["at"]),
    )
    return rows.withColumn("ranked", ranked).drop("_tokens", "_distinct", "_near")


def _described(places: Column) -> Column:
    """Table, score, line and neighbours of ranked entries; only those that were selected are looked up."""

    def full(t: Column) -> Column:
        held = F.get(F.col("schema"), t["at"])
        return F.struct(t["table"], t["score"], held["line"].alias("line"), held["neighbours"].alias("neighbours"))

    return F.transform(places, full)


def select_top(rows: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """Add ``selected``: the first ``k`` ranked tables above ``min_score``; if none, the first ``k`` by name."""
    hits = F.filter("ranked", lambda t: t["score"] > min_score)
    by_name = F.array_sort(
        F.transform("ranked", lambda t: F.struct(t["table"], t["score"], t["at"]))
    )
    chosen = F.when(F.size(hits) > 0, F.slice(hits, 1, k)).otherwise(F.slice(by_name, 1, k))
    return rows.withColumn("selected", _described(chosen))


def expand_neighbours(rows: DataFrame, k: int) -> DataFrame:
    """Fill ``selected`` up to ``k`` with unseen foreign-key neighbours, in selected order then name order."""
    names = F.transform("selected", lambda t: t["table"])
    unseen = F.array_except(
        F.array_distinct(F.flatten(F.transform("selected", lambda t: t["neighbours"]))), names
    )
    room = F.greatest(F.lit(k) - F.size("selected"), F.lit(0))
    added = F.transform(
        F.slice(unseen, F.lit(1), room),
        lambda n: F.coalesce(
            F.get(_described(F.filter("ranked", lambda t: t["table"] == n)), F.lit(0)),
            F.struct(
                n.alias("table"), F.lit(None).cast("double").alias("score"),
                F.lit(None).cast("string").alias("line"),
                F.lit(None).cast("array<string>").alias("neighbours"),
            ),
        ),
    )
    return rows.withColumn("selected", F.concat("selected", added))


def link_schema(
    questions: DataFrame,
    profiles: DataFrame,
    max_tables: int = 12,
    add_neighbours: bool = True,
    min_score: float = 0.0,
    question: str = "question_text_filled",
) -> DataFrame:
    """Add ``schema_compact``: the lines of the tables relevant to each question."""
    rows = select_top(rank_tables(questions, profiles, question), max_tables, min_score)
    if add_neighbours:
        rows = expand_neighbours(rows, max_tables)
    lines = F.array_join(F.transform("selected", lambda t: t["line"]), "\n")
    return rows.withColumn("schema_compact", F.coalesce(lines, F.lit(""))).drop("ranked", "selected", "schema")
