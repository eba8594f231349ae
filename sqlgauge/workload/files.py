"""Queries through the file sources and sinks: written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import summarize
from ..operators.questions import flatten_questions
from ..operators.runlog import canonical_runlog
from ..plans.scratch import scratch_path
from ..sinks.writers import runlog_name, write_csv, write_runlog
from ..sources.corpus import read_corpus, read_corpus_lines, typed_entries
from ..sources.runlog import read_metrics_csv, read_runlog
from .inputs import CORPUS, QUESTIONS
from .metrics import _FACTS, _FLAG_COLUMNS, FLAT, records, rows
from .registry import query, run

FILE_ENTRIES = 1000
_BLOCK = f"CAST(floor(entry_pos / {FILE_ENTRIES}) AS BIGINT)"


@query(
    "s1_corpus_files",
    f"""SELECT row_number() OVER (PARTITION BY {_BLOCK} ORDER BY entry_pos) - 1 AS entry_pos, entry_pos AS custkey,
      CASE entry_pos % 3 WHEN 0 THEN '' WHEN 1 THEN 'train' ELSE 'test' END AS query_split FROM ({CORPUS}) c""",
)
def s1(spark, sf):
    """Corpus files whose root is a list, a bounded number of entries each."""
    path = scratch_path(spark, "corpus")
    named = F.expr("concat('{\"comments\": \"', entry_pos, '\", ', substring(entry, 2))")
    blocks = (
        run(spark, sf, CORPUS)
        .groupBy(F.expr(_BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("entry_pos", named.alias("entry")))).alias("e"))
    )
    lists = blocks.select(
        "block",
        F.concat(F.lit("[\n"), F.array_join(F.transform("e", lambda x: x["entry"]), ",\n"), F.lit("\n]")).alias("value"),
    )
    lists.write.partitionBy("block").text(path)
    found = read_corpus(spark, f"{path}/block=*")
    custkey = F.col("comments").cast("long")
    return found.select(
        "entry_pos", custkey.alias("custkey"), F.coalesce("query-split", F.lit("")).alias("query_split")
    )


@query("s1_corpus_lines", f"SELECT dataset, entry_pos, CAST(sent_pos AS BIGINT) AS sent_pos, question_text FROM ({QUESTIONS}) q")
def s1_lines(spark, sf):
    path = scratch_path(spark, "corpus-lines")
    lines = run(spark, sf, CORPUS).select(
        F.expr("concat('{\"dataset\": \"', dataset, '\", \"entry_pos\": ', entry_pos, ', ', substring(entry, 2))")
    )
    lines.write.text(path)
    questions = flatten_questions(typed_entries(read_corpus_lines(spark, path)))
    return questions.select(
        "dataset", "entry_pos", F.col("sent_pos").cast("long").alias("sent_pos"), "question_text"
    )


def _written(spark, sf, partitioned: bool) -> tuple[DataFrame, str]:
    path = scratch_path(spark, "runlog")
    log = records(spark, sf).withColumn("rdbms", F.lit("mysql"))
    write_runlog(log, path, partitioned)
    return log, path


@query("s2_runlog_source", f"SELECT id, {', '.join(_FACTS)} FROM ({FLAT}) f")
def s2(spark, sf):
    return canonical_runlog(read_runlog(spark, _written(spark, sf, False)[1])).select("id", *_FACTS)


# What a record holds for a flag, as JSON, and what it means.
_MIXED = {0: ("'true'", "TRUE"), 1: ("CAST(CAST(floor(value) AS BIGINT) AS STRING)", "floor(value) <> 0"), 2: ("'\"2\"'", "NULL"), 3: ("'\" Yes\"'", "TRUE"),
          4: ("'0.0'", "FALSE"), 5: ("'null'", "NULL"), 6: ("'[1]'", "NULL"), 7: ("'\"0\"'", "FALSE"), 8: ("'2.5'", "TRUE")}


def _mixed(shift: int, part: int) -> str:
    return f"CASE (event_id + {shift}) % 9 " + " ".join(f"WHEN {k} THEN {v[part]}" for k, v in _MIXED.items()) + " END"


@query(
    "s2_mixed_flags",
    f"""SELECT event_id AS id, {_mixed(0, 1)} AS mysql_pred_success, {_mixed(1, 1)} AS mariadb_pred_success, {_mixed(2, 1)} AS mysql_ex,
      {_mixed(3, 1)} AS mysql_vs_mariadb_match FROM @events""",
)
def s2_mixed(spark, sf):
    """Numbers, texts and booleans in one field of one file stay apart."""
    path = scratch_path(spark, "mixed-flags")
    lines = run(spark, sf, f"""SELECT concat('{{"id": ', event_id, ', "mysql_pred_success": ', {_mixed(0, 0)}, ', "mariadb": {{"success": ',
      {_mixed(1, 0)}, ', "execution_time_s": 0.5}}, "mysql_pred_vs_gold_match": ', {_mixed(2, 0)}, ', "mysql_vs_mariadb_match": ', {_mixed(3, 0)}, '}}') AS line
      FROM @events""", busy="events")
    lines.write.text(path)
    return canonical_runlog(read_runlog(spark, path)).select("id", "mysql_pred_success", "mariadb_pred_success", "mysql_ex", "mysql_vs_mariadb_match")


@query(
    "k1_runlog_sink",
    """SELECT CAST(event_id AS BIGINT) AS id, 37 AS n_keys, TRUE AS has_null_keys FROM @events""",
)
def k1(spark, sf):
    _, path = _written(spark, sf, False)
    keys = F.json_object_keys("value")
    return spark.read.text(path).select(
        F.get_json_object("value", "$.id").cast("long").alias("id"),
        F.size(keys).alias("n_keys"),
        F.array_contains(keys, "mysql_pred_success").alias("has_null_keys"),
    )


@query(
    "k2_csv_sink",
    f"""SELECT dataset, CAST(count(*) AS VARCHAR) AS n_questions, '' AS bucket, TRUE AS header_sorted FROM ({FLAT}) f GROUP BY dataset
      UNION ALL SELECT dataset, CAST(count(*) AS VARCHAR), complexity_bucket, TRUE FROM ({FLAT}) f GROUP BY dataset, complexity_bucket""",
)
def k2(spark, sf):
    path = scratch_path(spark, "summary")
    write_csv([summarize(rows(spark, sf))], path)
    table = spark.read.option("header", True).csv(path)
    in_order = table.columns == sorted(table.columns)
    return table.select(
        "dataset", "n_questions", F.coalesce("bucket", F.lit("")).alias("bucket"), F.lit(in_order).alias("header_sorted")
    )


@query(
    "k3_output_layout",
    f"""SELECT llm || '_benchmark_' || dataset || '_mysql' AS name, count(*) AS n FROM ({FLAT}) f GROUP BY llm, dataset""",
)
def k3(spark, sf):
    _, path = _written(spark, sf, True)
    found = spark.read.schema("id long, llm string, dataset string, rdbms string").json(path)
    name = runlog_name(F.col("llm"), F.col("dataset"), F.col("rdbms"))
    return found.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "k3_rerun",
    f"""SELECT llm || '_benchmark_' || dataset || '_mysql' AS name, count(*) AS n, count(DISTINCT id) AS n_ids,
      count(*) FILTER (WHERE llm = 'alpha') AS n_new FROM ({FLAT}) f GROUP BY llm, dataset""",
)
def k3_rerun(spark, sf):
    """The runs of one model are written anew, twice; theirs are replaced and those of the other stay."""
    log, path = _written(spark, sf, True)
    again = log.where("llm = 'alpha'").withColumn("pred_sql", F.lit("SELECT again"))
    for _ in range(2):
        write_runlog(again, path, partitioned=True)
    found = spark.read.schema("id long, pred_sql string, llm string, dataset string, rdbms string").json(path)
    name = runlog_name(F.col("llm"), F.col("dataset"), F.col("rdbms"))
    return found.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("pred_sql") == "SELECT again").alias("n_new")
    )


@query("s3_metrics_csv", f"SELECT dataset, id, {', '.join(f'coalesce({c}, FALSE) AS {c}' for c in _FLAG_COLUMNS)} FROM ({FLAT}) f")
def s3_csv(spark, sf):
    path = scratch_path(spark, "metrics")
    wanted = ["dataset", "id", *_FLAG_COLUMNS]
    write_csv([rows(spark, sf).select(*wanted)], path)
    schema = ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in sorted(wanted))
    return read_metrics_csv(spark, path, schema).select(*wanted)
