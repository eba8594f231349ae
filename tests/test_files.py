"""File sources and sinks on hand-made files, and a whole run from corpus to report."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators import catalog as C
from sqlgauge.operators import questions as Q
from sqlgauge.operators.metrics import in_report_order, summarize
from sqlgauge.operators.plots import metrics_by_dataset, rate_by_complexity, schema_compactness
from sqlgauge.operators.runlog import canonical_runlog, question_rows
from sqlgauge.plans.benchmark import evaluate_run, prepare_run, report
from sqlgauge.sinks.writers import runlog_name, write_csv, write_runlog
from sqlgauge.sources import corpus as corpora
from sqlgauge.sources.corpus import read_corpus, read_manifest, typed_entries
from sqlgauge.sources.ddl import parse_columns, parse_foreign_keys, read_ddl
from sqlgauge.sources.introspect import databases, introspect
from sqlgauge.sources.runlog import read_metrics_csv, read_runlog

ENTRIES = [
    {"query-split": "train", "sql": ['SELECT id FROM ITEMS WHERE kind = "kind0" ;', "x"],
     "sentences": [{"text": "items of kind0", "question-split": "dev", "variables": {"kind0": "a"}}, "skip",
                   {"text": "which items are kind0", "variables": []}],
     "variables": [{"name": "kind0", "example": "b"}]},
    {"sql": "SELECT count(*) AS n FROM items", "sentences": [{"text": "how many items", "difficulty": 2}], "difficulty": 4},
    {"sql": [], "sentences": "none", "variables": "none"},
    {"sentences": [{}]},
]


def corpus(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1), encoding="utf-8")
    return typed_entries(read_corpus(spark, str(tmp_path)))


def test_corpus_files(spark, tmp_path):
    rows = corpus(spark, tmp_path, shop=ENTRIES, other=ENTRIES[:1]).orderBy("dataset", "entry_pos").collect()
    assert [(r.dataset, r.entry_pos) for r in rows] == [("other", 0)] + [("shop", i) for i in range(4)]
    assert rows[2].sql_variants == ["SELECT count(*) AS n FROM items"] and rows[3].sql_variants == [] == rows[4].sql_variants


def test_corpus_root_must_be_a_list(spark, tmp_path):
    (tmp_path / "bad.json").write_text('\n  {"sql": []}')
    with pytest.raises(ValueError, match="must be a list"):
        read_corpus(spark, str(tmp_path))


def _tricky(seed, n):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice('ab{}[]",:\\\n é中') for _ in range(rng.randint(0, 12)))

    return [
        {"query-split": text(), "sql": [text() for _ in range(rng.randint(0, 3))], "difficulty": rng.choice([None, 1, "x"]),
         "sentences": [{"text": text(), "variables": {text(): text()}} for _ in range(rng.randint(0, 3))]}
        for _ in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", ["1m", "300"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, indent, size):
    """Brackets and quotes inside strings, ranges that begin anywhere: as the reader of whole files gives them."""
    data = _tricky(indent or 0, 60)
    (tmp_path / "long.json").write_text(json.dumps(data, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    (tmp_path / "none.json").write_text(" [\n] ")
    (tmp_path / "blank.json").write_text(" \n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(kept, (size, "0")):
        spark.conf.set(k, v)
    try:
        tasks = corpora._pieces(spark, str(tmp_path)).rdd.getNumPartitions()
        got = typed_entries(read_corpus(spark, str(tmp_path))).orderBy("entry_pos").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    whole = spark.read.schema(corpora.RAW_ENTRY).option("multiLine", True).json(str(tmp_path / "long.json"))
    whole = typed_entries(whole.select(F.lit("long").alias("dataset"), F.monotonically_increasing_id().alias("entry_pos"), "*"))
    assert [tuple(r) for r in got] == [tuple(r) for r in whole.orderBy("entry_pos").collect()] and len(got) == 60
    assert tasks > 20 or size == "1m"


BROKEN = ['[{"sql": 1}', '[{"sql": 1}]]', '[{"sql": 1} {"sql": 2}]', '[{"sql": 1}, 5]', '[{"sql": 1}, [{}]]', '["a"]', '[{"sql": "1}]', '[{"sql": }]']


@pytest.mark.parametrize("text", BROKEN)
def test_broken_lists_are_errors(spark, tmp_path, text):
    (tmp_path / "good.json").write_text(json.dumps(ENTRIES))
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="bad.json"):
        read_corpus(spark, str(tmp_path))


def test_questions_of_a_corpus(spark, tmp_path):
    rows = Q.prepare_questions(corpus(spark, tmp_path, shop=ENTRIES)).orderBy("id").collect()
    assert [(r.id, r.question_text_filled, r.gold_sql_exec, r.difficulty, r.question_split) for r in rows] == [
        (0, "items of a", 'SELECT id FROM ITEMS WHERE kind = "a" ;', 1, "dev"),
        (1, "which items are kind0", 'SELECT id FROM ITEMS WHERE kind = "b" ;', 1, ""),
        (2, "how many items", "SELECT count(*) AS n FROM items", 2, ""),
        (3, "", "", 1, ""),
    ]


def test_limits(spark, tmp_path):
    entries = Q.number_entries(corpus(spark, tmp_path, shop=ENTRIES), block=2)
    flat = Q.flatten_questions(entries)
    assert flat.count() == 4 and Q.limit_questions(flat, 1).count() == 1 and Q.limit_questions(flat, 0).count() == 4
    kept = Q.flatten_questions(Q.limit_entries(entries, 1))
    assert [r.id for r in kept.orderBy("id").collect()] == [0, 1]
    assert Q.limit_entries(entries, 0).count() == 4


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"generated_at_epoch": 1, "datasets": [
        {"name": "a", "total": 2, "keys": ["sql"]}, {"name": "b", "total": 0, "keys": []}]}, indent=2))
    assert [(r.name, r.total, r["keys"]) for r in read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", 2, ["sql"]), ("b", 0, [])]


DDL = """/*!40101 SET NAMES utf8 */;
DROP TABLE IF EXISTS `parent`;
CREATE TABLE `parent` (
  `id` int(11) NOT NULL DEFAULT '0',
  `price` float(3,2) DEFAULT NULL,
  `note` text,
  `key_name` varchar(4) NOT NULL DEFAULT 'N',
  PRIMARY KEY (`key_name`,`id`),
  KEY `note` (`note`(100))
) ENGINE=InnoDB DEFAULT CHARSET=latin1;
CREATE TABLE `child` (
  `id` int DEFAULT NULL,
  KEY `id` (`id`),
  CONSTRAINT `c` FOREIGN KEY (`id`) REFERENCES `parent` (`id`)
) ENGINE=InnoDB;
"""


def test_ddl_with_fallback(spark, tmp_path):
    for dialect, dataset, text in (("mysql", "a", "CREATE TABLE `old` (\n  `x` int\n);"), ("mariadb", "a", DDL), ("mysql", "b", DDL)):
        (tmp_path / dialect).mkdir(exist_ok=True)
        (tmp_path / dialect / f"{dataset}.schema.sql").write_text(text)
    texts = read_ddl(spark, str(tmp_path), "mariadb")
    rows = parse_columns(texts).where("dataset = 'a'").orderBy("table", "col_pos").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("child", 0, "id", "int", True, None, None), ("parent", 0, "id", "int(11)", False, "'0'", 1),
        ("parent", 1, "price", "float(3,2)", True, None, None), ("parent", 2, "note", "text", True, None, None),
        ("parent", 3, "key_name", "varchar(4)", False, "'N'", 0),
    ]
    assert parse_columns(texts).where("dataset = 'b'").count() == 5
    assert [tuple(r)[1:] for r in parse_foreign_keys(texts).where("dataset = 'b'").collect()] == [("child", 0, ["id"], "parent", ["id"])]
    ddl = C.render_create(parse_columns(texts), parse_foreign_keys(texts)).where("dataset = 'a'").first().ddl
    assert ddl == (
        "CREATE TABLE child (\n    id int,\n    FOREIGN KEY (id) REFERENCES parent(id)\n);\n\n"
        "CREATE TABLE parent (\n    id int(11) NOT NULL DEFAULT '0',\n    price float(3,2),\n    note text,\n"
        "    key_name varchar(4) NOT NULL DEFAULT 'N',\n    PRIMARY KEY (key_name, id)\n);\n"
    )


def test_expected_tables_and_info(spark):
    spark.range(1).createOrReplaceTempView("info_view")
    catalog = introspect(spark, "a", ["info_view"])
    expected = spark.createDataFrame([("a", None), ("b", 2)], "dataset string, min_tables int")
    assert {tuple(r) for r in C.completeness(expected, catalog).collect()} == {("a", 1, 1, True), ("b", 0, 2, False)}
    info = {r.dataset: r for r in C.dataset_info(expected, catalog).collect()}
    assert info["a"].available and info["a"].tables == ["info_view"] and not info["b"].available
    known = spark.createDataFrame([("b",)], "database string")
    info = {r.dataset: r for r in C.dataset_info(expected, catalog, known).collect()}
    assert info["a"].available and info["b"].available and info["b"].tables == [] and info["b"].table_count == 0
    assert "default" in [r.database for r in databases(spark).collect()]


LOG = [
    {"id": 0, "dataset": "a", "gold_sql_exec": "SELECT 1", "mysql": {"success": True, "execution_time_s": 1.0}, "mariadb": {"success": "no"},
     "mysql_pred_vs_gold_match": 1, "gen_time_s": 2.0, "schema_compact": "t(a)\nu(b)"},
    {"id": 1, "dataset": "a", "mysql_pred.success": False, "mysql_pred.execution_time_s": 0.5, "mysql_pred_vs_gold_match": False, "gen_time_s": 4.0},
    {"id": 2, "dataset": "b", "mariadb_pred_success": "yes", "mariadb_pred_time_s": 3.0, "mariadb_pred_vs_gold_match": "true", "pred_sql": "x JOIN y"},
]


def test_run_log_spellings_and_blank_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in LOG) + "\n\n", encoding="utf-8")
    rows = question_rows(canonical_runlog(read_runlog(spark, str(path)))).orderBy("id").collect()
    assert [(r.mysql_pred_success, r.mariadb_pred_success, r.mysql_ex, r.mariadb_ex) for r in rows] == [
        (True, False, True, None), (False, None, False, None), (None, True, None, True)]
    assert [(r.mysql_pred_execution_time_s, r.mariadb_pred_execution_time_s) for r in rows] == [(1.0, None), (0.5, None), (None, 3.0)]
    assert [(r.complexity_bucket, r.tables_in_schema_compact, r.mysql_ex_given_success) for r in rows] == [
        ("simple", 2, True), ("unknown", 0, None), ("medium", 0, None)]
    assert rows[0].pred_mysql_only_success and not rows[1].pred_neither_success

    table = in_report_order(summarize(spark.createDataFrame(rows, question_rows(canonical_runlog(read_runlog(spark, str(path)))).schema))).collect()
    assert [(r.dataset, r.bucket, r.n_questions) for r in table] == [("a", None, 2), ("a", "simple", 1), ("a", "unknown", 1), ("b", None, 1), ("b", "medium", 1)]
    assert table[0].mysql_pred_success_rate == 0.5 and table[0].gen_time_median_s == 2.0 and table[0].gen_time_p90_s == 4.0
    assert table[0].mysql_ex_given_success == 1.0 and table[3].mysql_ex_given_success is None and table[3].gen_time_mean_s is None

    path.write_text(json.dumps(LOG[0]) + "\n{broken\n")
    with pytest.raises(Exception):
        read_runlog(spark, str(path)).collect()


def test_run_log_of_one_spelling(spark):
    df = spark.createDataFrame([(1, "a", True, 0.5)], "id long, dataset string, mysql_pred_success boolean, gen_time_s double")
    row = question_rows(canonical_runlog(df)).first()
    assert row.mysql_pred_success is True and row.mariadb_pred_success is None and row.pred_sql == ""


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([(1, "é", None, "m", "d", "mysql")], "id long, t string, n string, llm string, dataset string, rdbms string")
    write_runlog(records, str(tmp_path / "log"))
    text = spark.read.text(str(tmp_path / "log")).first()[0]
    assert json.loads(text) == {"id": 1, "t": "é", "n": None, "llm": "m", "dataset": "d", "rdbms": "mysql"} and "é" in text
    write_runlog(records, str(tmp_path / "parts"), partitioned=True)
    assert (tmp_path / "parts" / "llm=m" / "dataset=d" / "rdbms=mysql").is_dir()
    a, b = spark.createDataFrame([(1, 2)], "z int, b int"), spark.createDataFrame([(3, 4)], "a int, b int")
    write_csv([a, b], str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["a", "b", "z"] and {tuple(r) for r in back.collect()} == {(None, "2", "1"), ("3", "4", None)}
    with pytest.raises(ValueError, match="No rows"):
        write_csv([a.where("z > 1")], str(tmp_path / "none"))
    name = runlog_name(F.col("llm"), F.col("dataset"), F.lit("mysql"))
    runs = spark.createDataFrame([("m", "d"), ("n o", "e/f")], "llm string, dataset string")
    assert {r[0] for r in runs.select(name).collect()} == {"m_benchmark_d_mysql", "n o_benchmark_e/f_mysql"}
    assert runs.select(runlog_name(F.col("llm"), F.col("dataset"), F.lit("x"), "baseline")).first()[0] == "m_baseline_d_x"


def test_metrics_csv_and_chart_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("dataset,mysql_ex,gen_time_s,complexity_bucket\na,True,1\na,,x,simple\n,False,2,complex\n")
    rows = read_metrics_csv(spark, str(tmp_path / "m.csv"), "dataset string, mysql_ex string, gen_time_s string, complexity_bucket string")
    assert [r.mysql_ex for r in rows.orderBy("gen_time_s").collect()] == [True, False, False]
    table = {r.dataset: r for r in metrics_by_dataset(rows, "mysql").collect()}
    assert set(table) == {"a", None} and table["a"].ex == 0.5 and table["a"].gen_time_median_s == 1.0 and table["a"].pred_exec_rate == 0.0
    assert table[None].gen_time_p95_s == 2.0 and table[None].gold_exec_time_mean_s is None
    assert [(r.bucket, r.rate) for r in rate_by_complexity(rows, "mysql_ex").orderBy("bucket_order").collect()] == [("simple", 0.0), ("medium", 0.0), ("complex", 0.0)]
    with pytest.raises(ValueError):
        read_metrics_csv(spark, str(tmp_path / "m.csv"), "x string")
    with pytest.raises(ValueError):
        schema_compactness(rows)
    with pytest.raises(ValueError):
        metrics_by_dataset(rows, "oracle")


def test_whole_run(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, kind string").createOrReplaceTempView("items")
    catalog = introspect(spark, "shop", ["items"])
    prepared = prepare_run(corpus(spark, tmp_path, shop=ENTRIES), catalog)
    rows = {r.id: r for r in prepared.collect()}
    assert rows[0].schema_compact == "items(id, kind)" and rows[0].gold_sql_exec == 'SELECT id FROM items WHERE kind = "a" ;'
    made = spark.createDataFrame(
        [("shop", 0, "SELECT id FROM Item WHERE kind = 'a'"), ("shop", 1, "SELECT nothing FROM items"), ("shop", 2, "SELECT 3L AS n")],
        "dataset string, id long, pred_sql_raw string",
    ).selectExpr("*", "10 AS prompt_tokens", "5 AS completion_tokens", "0.25D AS gen_time_s")
    records = evaluate_run(prepared, made, "m", "mysql").cache()
    got = {r.id: r for r in records.collect()}
    assert [got[i]["mysql_pred_vs_gold_match"] for i in range(4)] == [True, False, True, False]
    assert got[0].pred_sql == "SELECT id FROM items WHERE kind = 'a'" and got[0].pred_repairs[0]["to"] == "items"
    assert got[1]["mysql_pred.success"] is False and got[3].pred_sql == "SELECT 1;" and got[3]["mysql_gold.success"] is False
    top = report(records).first()
    assert (top.dataset, top.n_questions, top.mysql_execution_accuracy_ex) == ("shop", 4, 0.5)


def test_flags_keep_their_json_type(spark, tmp_path):
    """A number counts, a text of the same number does not; null leaves the decision to the next spelling."""
    cases = [("2", True), ('"2"', None), ("0", False), ("0.0", False), ("-2.5", True), ("true", True), ('" No "', False), ('"0"', False),
             ("null", None), ("{}", None), ("[true]", None), ("123456789012345678901234567890", True), ('""', None)]
    lines = [f'{{"id": {k}, "mysql_pred_success": {v}, "mysql_gold": {{"success": {v}}}, "mariadb_pred.success": {v}, "mysql_vs_mariadb_match": {v}}}' for k, (v, _) in enumerate(cases)]
    lines += ['{"id": 90, "mysql": {"success": null}, "mysql_pred.success": 0, "mysql_pred_success": true}', '{"id": 91, "mysql": {"success": "maybe"}, "mysql_pred_success": true}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = {r.id: r for r in canonical_runlog(read_runlog(spark, str(tmp_path))).collect()}
    for k, (text, want) in enumerate(cases):
        r = rows[k]
        assert (r.mysql_pred_success, r.mysql_gold_success, r.mariadb_pred_success, r.mysql_vs_mariadb_match) == (want,) * 4, text
    assert rows[90].mysql_pred_success is False and rows[91].mysql_pred_success is None


def test_a_rerun_replaces_its_own_runs_only(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = "id int, llm string, dataset string, rdbms string"
    first = [(k, llm, "shop", "mysql") for llm in "ab" for k in range(5)]
    write_runlog(spark.createDataFrame(first, schema), path, partitioned=True)
    for _ in range(2):  # shorter than before, and one run that is new
        write_runlog(spark.createDataFrame([(7, "a", "shop", "mysql"), (8, "c", "shop", "mysql")], schema), path, partitioned=True)
    found = sorted((r.llm, r.id) for r in spark.read.schema(schema).json(path).collect())
    assert found == [("a", 7), *(("b", k) for k in range(5)), ("c", 8)]

    def failing(batches):
        yield from batches
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        broken = spark.createDataFrame([(9, "b", "shop", "mysql")], schema)
        write_runlog(broken.mapInPandas(failing, schema), path, partitioned=True)
    assert sorted((r.llm, r.id) for r in spark.read.schema(schema).json(path).collect()) == found


def test_run_logs_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    from sqlgauge.sinks import writers

    monkeypatch.setattr(writers, "FILE_RECORDS", 400)
    records = spark.range(1000).coalesce(1).selectExpr("id", "'m' AS llm", "'d' AS dataset", "'mysql' AS rdbms", "repeat('SELECT ', 50) AS pred_sql")
    for partitioned in (False, True):
        path = tmp_path / f"log-{partitioned}"
        write_runlog(records, str(path), partitioned)
        files = list(path.rglob("part-*"))
        assert len(files) == 3 and sum(f.stat().st_size for f in files) < 20_000  # 400,000 as plain text
        rows = spark.read.schema("id long, pred_sql string").json(str(path)).collect()
        assert sorted(r.id for r in rows) == list(range(1000)) and {r.pred_sql for r in rows} == {"SELECT " * 50}
