"""Corpus cleaning as a chain of written stages.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns they were given, with
``n_chars`` following the text. ``run`` applies them to the documents of a folder.

1. toxicity: documents whose score is 0.5 or more go.
2. line dedup: lines above the boilerplate ratio of their source are cut; a document of nothing else goes. Copies do
   not make a text boilerplate (see ``line_dedup``), so a group of near duplicates is left whole to the third stage;
   they are looked for among the documents that hold a line above the ratio.
3. n-gram join: of each class of near duplicates the document with the smallest id stays.
4. decontamination: benchmark passages are cut out; a document without any word left goes.
5. BPE: what is left, as token ids and as the text read back from them.

Nulls and repeats are each operator's. In the second and third stage rows of one id are one document, and documents without
an id are told apart by their texts; of different texts under one id the third stage keeps the one whose hash is least. Further columns of the documents stay, but names that begin with an underscore are the
operators' own: such columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm import bpe, decontamination, line_dedup, near_copies, ngram_join, queries, toxicity
from sqlgauge.llm.common import table
from sqlgauge.plans.scratch import materialize
from sqlgauge.session import ship_package


def _plain(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.drop(*(c for c in docs.columns if c.startswith("_")))


def _counted(docs: DataFrame, changed: Column) -> list[Column]:
    """The columns of ``docs``, with n_chars counted anew where ``changed``."""
    size = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return [size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _plain(docs)
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where("_toxicity < 0.5").select(*docs.columns)


def _copies(docs: DataFrame) -> DataFrame:
    """Columns _member, _page: the rows that have near copies, and the document that stands for theirs."""
    return near_copies.near_copies(docs, ngram_join.row_id())


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _plain(docs)
    cut = line_dedup.drop_boilerplate(docs, row=ngram_join.row_id(), groups=_copies)
    cut = cut.where((F.col("_dropped") == 0) | (F.col("_dropped") < F.col("_lines")))
    return cut.select(*_counted(docs, F.col("_dropped") > 0))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _plain(docs)
    classes = ngram_join.near_duplicates(docs).where(F.col("_row") == F.col("_first"))
    first = materialize(classes.select("_first").distinct(), "first-documents")
    left = docs.withColumn("_row", ngram_join.row_id()).join(first, F.col("_row") == F.col("_first"), "left_semi")
    rows = F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.xxhash64("text"))  # rows of one id are one document
    return left.groupBy("_row").agg(rows.alias("_kept")).select(*(F.col("_kept")[c].alias(c) for c in docs.columns))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _plain(docs)
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontamination.find_contamination(docs, benchmark)
    held = found.withColumn("_hit", decontamination.hit_words()).where((F.col("_hit") == 0) | (F.col("_hit") < F.col("_words")))
    cut = decontamination.remove_spans(held, [*docs.columns, "_hit"])
    return cut.select(*_counted(docs, F.col("_hit") > 0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), decoded=True)
    return coded.select(
        "doc_id", "lang", "source", F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids").alias("token_ids"),
        F.col("_decoded").alias("text"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("bpe", tokens),
]

#: A learnt model and a hash family decide which rows stay, so SQL cannot give them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def load() -> tuple[dict, dict]:
    """Queries and SQL checks of the corpus operators and of the pipeline."""
    held, checks = queries.load()
    return {**held, "pipeline": run}, dict(checks)
