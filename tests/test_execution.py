"""Running SQL texts, result equality and records."""

import time
from decimal import Decimal

import pytest
from pyspark.errors import ParseException
from pyspark.sql import Row
from pyspark.sql import functions as F

from sqlgauge.operators.comparison import compare_engines, compare_results, fingerprint, match_outcomes
from sqlgauge.operators.execution import (
    TIMED_OUT, dataset_session, execute_on_dataset, execute_sql, execute_texts, query_text, run_pairs,
)
from sqlgauge.operators.records import assemble_records, attach_predictions, flatten_outcomes


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CASES = [
    ("reordered rows", [(1, "a"), (2, "b")], "x int, y string", [(2, "b"), (1, "a")], "x int, y string", True),
    ("reordered columns", [(1, "a")], "x int, y string", [("a", 1)], "y string, x int", True),
    ("int and bigint", [(1,)], "x int", [(1,)], "x bigint", True),
    ("int and double", [(1,)], "x int", [(1.0,)], "x double", False),
    ("copies", [(1,), (1,)], "x int", [(1,)], "x int", False),
    ("copies of others", [(1,), (1,), (2,)], "x int", [(1,), (2,), (2,)], "x int", False),
    ("nulls", [(None,), (1,)], "x int", [(1,), (None,)], "x int", True),
    ("null and text", [(None,)], "x string", [("__NULL__",)], "x string", False),
    ("nan is null", [(float("nan"),)], "x double", [(None,)], "x double", True),
    ("minus zero", [(0.0,)], "x double", [(-0.0,)], "x double", True),
    ("column case", [(1,)], "x int", [(1,)], "X int", False),
    ("more columns", [(1,)], "x int", [(1, 2)], "x int, y int", False),
    ("both empty", [], "x int", [], "x int", True),
    ("one empty", [], "x int", [(1,)], "x int", False),
    ("swapped values", [(1, 2), (3, 4)], "x int, y int", [(1, 4), (3, 2)], "x int, y int", False),
    ("scale over twelve", [(Decimal("0.00000000000001"),)], "x decimal(20,14)", [(Decimal("0.00000000000002"),)], "x decimal(20,14)", False),
    ("scales of one value", [(Decimal("1.5"),)], "x decimal(20,14)", [(Decimal("1.50"),)], "x decimal(9,2)", True),
    ("thirty digits", [(Decimal("123456789012345678901234567890"),)], "x decimal(38,0)", [(Decimal("123456789012345678901234567891"),)], "x decimal(38,0)", False),
    ("whole decimals", [(Decimal("100"),), (Decimal("0"),)], "x decimal(38,0)", [(Decimal("100.00"),), (Decimal("0.00"),)], "x decimal(9,2)", True),
    ("other order of a sum", [(0.1 + 0.2 + 0.3,)], "x double", [(0.3 + 0.2 + 0.1,)], "x double", True),
    ("far digits", [(1.0,)], "x double", [(1.0001,)], "x double", False),
    ("nested maps", [([{1: 2.0, 3: 4.0}],)], "x array<map<int,double>>", [([{3: 4.0, 1: 2.0}],)], "x array<map<int,double>>", True),
    ("map in a struct", [((({"a": 1}),),)], "x struct<m:map<string,int>>", [((({"a": 2}),),)], "x struct<m:map<string,int>>", False),
    ("arrays and maps", [([1], {"a": 1, "b": 2})], "x array<int>, y map<string,int>", [([1], {"b": 2, "a": 1})], "x array<int>, y map<string,int>", True),
]


@pytest.mark.parametrize("name, a, sa, b, sb, want", CASES, ids=[c[0] for c in CASES])
def test_result_equality(spark, name, a, sa, b, sb, want):
    left, right = df(spark, a, sa), df(spark, b, sb)
    assert compare_results(left, right).first().match is want
    assert (fingerprint(left).first().fingerprint == fingerprint(right).first().fingerprint) is want


_LOW, _HIGH = 1.0000000000049998, 1.0000000000050002  # the border of twelve digits lies between
CLOSE = [
    ("either side of a border", [(_LOW,)], [(_HIGH,)], "x double", True),
    ("of a power of ten", [(0.9999999999999999,)], [(1.0,)], "x double", True),
    ("copies on a border", [(_LOW,), (_LOW,), (2.0,)], [(_HIGH,), (2.0,), (_HIGH,)], "x double", True),
    ("fewer copies", [(_LOW,), (_LOW,)], [(_HIGH,), (2.0,)], "x double", False),
    ("other groups", [(1, _LOW), (2, 5.0)], [(2, _HIGH), (1, 5.0)], "k int, x double", False),
    ("equal groups", [(1, _LOW), (2, _HIGH), (None, _LOW)], [(None, _HIGH), (1, _HIGH), (2, _LOW)], "k int, x double", True),
    ("two columns", [(_LOW, -_LOW), (3.0, 4.0)], [(3.0, 4.0), (_HIGH, -_HIGH)], "x double, y double", True),
    ("one of two columns", [(_LOW, 1.0)], [(_HIGH, 1.1)], "x double, y double", False),
    ("null or border", [(_LOW, None)], [(_HIGH, 0.0)], "x double, y double", False),
    ("infinity", [(float("inf"),)], [(1.7e308,)], "x double", False),
    ("infinities", [(float("inf"), _LOW)], [(float("inf"), _HIGH)], "x double, y double", True),
    ("just too far", [(1.0,)], [(1.00000000002,)], "x double", False),
    ("zero and little", [(0.0,)], [(1e-300,)], "x double", False),
    ("signs", [(-_LOW,)], [(_LOW,)], "x double", False),
]


@pytest.mark.parametrize("name, a, b, schema, want", CLOSE, ids=[c[0] for c in CLOSE])
def test_close_doubles(spark, name, a, b, schema, want):
    for left, right in ((a, b), (b, a)):
        assert compare_results(df(spark, left, schema), df(spark, right, schema)).first().match is want
    if want:
        assert compare_results(df(spark, a, schema), df(spark, b, schema), digits=None).first().match is (sorted(map(str, a)) == sorted(map(str, b)))


def test_loose_types_and_duplicate_names(spark):
    a, b = df(spark, [(1,)], "x int"), df(spark, [(1.0,)], "x double")
    assert compare_results(a, b, strict_types=False).first().match is True
    twice = a.select("x", F.col("x"))
    assert compare_results(twice, twice).first().match is False


def test_outcomes_never_raise(spark):
    spark.range(10).createOrReplaceTempView("ten")
    ok = execute_sql(spark, "select id from TEN where id > 3 ;")
    assert ok["success"] and ok["rows"] == 6 and ok["error"] is None and ok["time_s"] > 0
    for text in ("SELECT nope FROM ten", "DROP VIEW ten", "INSERT INTO ten SELECT 1", "WITH a AS (SELECT 1) INSERT INTO ten SELECT * FROM a",
                 "CREATE TABLE z AS SELECT 1 x", "SELECT 1; SELECT 2", "SELECT 1) UNION (SELECT 2", "", ";", "SET a=1",
                 "SELECT CAST('x' AS INT) AS y", "SELECT /* ) */ 1) x, (SELECT 2"):
        bad = execute_sql(spark, text)
        assert not bad["success"] and bad["rows"] == 0 and bad["error"], text
    assert execute_sql(spark, 'WITH a AS (SELECT ")" AS p -- (\n) SELECT * FROM a')["rows"] == 1
    assert execute_sql(spark, "SELECT count(*) n FROM ten")["success"]
    for text in (r"SELECT 'it\'s :)' AS x", "SELECT array(map(1,2)) AS m", "SELECT CAST('123456789012345678901234567890' AS DECIMAL(38,0)) AS d",
                 "SELECT 'reflect(' AS x -- reflect(", 'SELECT "java_method(1)" AS x;;'):
        assert execute_sql(spark, text)["success"], text
    for text in ("SELECT reflect('java.lang.Math','abs',-1)", "SELECT `reflect` ('java.lang.Math','abs',-1)", r"SELECT 'a\'b', java_method('java.lang.Math','abs',-1)"):
        assert "reflection" in execute_sql(spark, text)["error"]


def test_same_result_same_fingerprint_across_texts(spark):
    spark.range(50).createOrReplaceTempView("fifty")
    a = execute_sql(spark, "SELECT id, id % 7 AS m FROM fifty ORDER BY m DESC")
    b = execute_sql(spark, "SELECT id % 7 AS m, id FROM fifty")
    assert a["fingerprint"] == b["fingerprint"]


def test_timeout_cancels(spark):
    started = time.perf_counter()
    slow = "SELECT count(*) AS n FROM range(0, 100000000000, 1, 2) WHERE sha2(CAST(id AS STRING), 256) LIKE 'zz%'"
    outcome = execute_sql(spark, slow, timeout_s=2)
    assert not outcome["success"] and outcome["error"].startswith(TIMED_OUT) and time.perf_counter() - started < 60
    texts = [slow, *(f"SELECT {k} AS x" for k in range(9))]
    rows = {r.sql: r.outcome for r in execute_texts(spark, texts, parallel=2, timeout_s=3).collect()}
    assert rows.pop(slow).error.startswith(TIMED_OUT) and all(o.success and o.time_s < 3 for o in rows.values())
    assert execute_sql(spark, "SELECT 1 AS x")["success"]


def test_texts_run_once_and_join_back(spark):
    spark.range(4).createOrReplaceTempView("four")
    texts = df(spark, [("SELECT id FROM four",), ("SELECT id FROM four",), ("SELECT x FROM four",)], "sql string")
    rows = {r.sql: r.outcome for r in execute_texts(spark, texts, batch=1).collect()}
    assert len(rows) == 2 and rows["SELECT id FROM four"].rows == 4 and not rows["SELECT x FROM four"].success


def _jobs_of(spark, texts, **more):
    """Outcomes by text, and how many runs of a plan (job groups) they took."""
    groups = []
    context, original = spark.sparkContext, type(spark.sparkContext).setJobGroup

    def seen(self, group, *rest, **named):
        groups.append(group)
        return original(self, group, *rest, **named)

    type(context).setJobGroup = seen
    try:
        rows = execute_texts(spark, texts, **more).collect()
    finally:
        type(context).setJobGroup = original
    return {r.sql: r for r in rows}, len(groups)


def test_a_thousand_spellings_of_ten_plans_make_ten_runs(spark):
    spark.range(40).createOrReplaceTempView("forty")
    texts = [f"{'select' if k % 2 else 'SELECT'} {' ' * (k // 10)}id FROM {'forty' if k % 3 else 'FORTY AS f'} WHERE id < {k % 10}" for k in range(1000)]
    rows, runs = _jobs_of(spark, texts)
    assert len(rows) == 1000 and runs == 10 == len({r.run for r in rows.values()})
    assert all(r.outcome.success and r.outcome.rows == k % 10 and r.outcome.time_s > 0 for k, r in ((texts.index(t), r) for t, r in rows.items()))
    alone = {t: execute_sql(spark, t) for t in texts[:10]}
    assert all(rows[t].outcome.fingerprint == alone[t]["fingerprint"] for t in alone)


def test_plans_that_differ_do_not_share(spark):
    spark.range(6).createOrReplaceTempView("six")
    texts = ["SELECT id AS a FROM six", "SELECT id AS b FROM six", "SELECT CAST(id AS INT) AS a FROM six", "SELECT id AS a FROM six WHERE id > 2",
             "SELECT id AS a FROM six WHERE rand() < 2", "SELECT  id AS a FROM six WHERE rand() < 2"]
    rows, runs = _jobs_of(spark, texts)
    assert runs == 6 and len({str(r.outcome.fingerprint) for r in rows.values()}) == 3  # int and bigint are one family
    bad = ["SELECT id / (id - id) AS x FROM six", "SELECT  id / (id - id) AS x FROM six", "SELECT nope FROM six", "SELECT  nope FROM six"]
    rows, runs = _jobs_of(spark, bad)
    assert runs == 1 and not any(r.outcome.success for r in rows.values()) and all(r.outcome.error for r in rows.values())
    rows, runs = _jobs_of(spark, texts[:2] + [" " + t for t in texts[:2]], plans=0)  # nothing kept: each text runs
    assert runs == 4 and len({str(r.outcome.fingerprint) for r in rows.values()}) == 2


def test_one_plan_on_two_datasets_runs_on_each(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5)):
        spark.range(n).write.parquet(str(tmp_path / name / "t.parquet"))
    known = {name: (str(tmp_path / name), ["t"]) for name in "ab"}
    texts = df(spark, [(d, s) for d in "ab" for s in ("SELECT * FROM t", "SELECT id FROM T", "select id from t")], "dataset string, sql string")
    rows = execute_texts(spark, texts, datasets=known).collect()
    assert {(r.dataset, r.outcome.rows, r.run) for r in rows} == {("a", 3, n) for n in {r.run for r in rows if r.dataset == "a"}} | {
        ("b", 5, n) for n in {r.run for r in rows if r.dataset == "b"}}
    assert len({r.run for r in rows}) == 2


def test_texts_that_share_a_slow_run_hold_no_slot(spark):
    slow = "SELECT count(*) AS n FROM range(0, 100000000000, 1, 2) WHERE sha2(CAST(id AS STRING), 256) LIKE 'zz%'"
    texts = [slow, *(slow.replace("SELECT", "SELECT" + " " * k) for k in range(1, 6)), *(f"SELECT {k} AS x" for k in range(9))]
    started = time.perf_counter()
    rows = {r.sql: r.outcome for r in execute_texts(spark, texts, parallel=2, timeout_s=4).collect()}
    assert time.perf_counter() - started < 30  # six waits one after the other would take 24 seconds of a slot
    assert sum((o.error or "").startswith(TIMED_OUT) for o in rows.values()) == 6 and sum(o.success for o in rows.values()) == 9


def test_pairs_match_only_when_both_ran(spark):
    spark.range(4).createOrReplaceTempView("four")
    good = "SELECT id FROM four"
    pairs = [(0, good, "SELECT id FROM four ORDER BY id DESC"), (1, good, "SELECT id + 1 AS id FROM four"), (2, "SELECT x", good),
             (3, good, "nonsense"), (4, None, good), (5, "SELECT x", "SELECT x"), (6, "SELECT id, id FROM four", "SELECT id, id FROM four"),
             (7, "SELECT a.id, b.id AS other FROM four a, four b WHERE a.id = b.id", "SELECT id AS other, id FROM four")]
    rows = match_outcomes(run_pairs(df(spark, pairs, "id int, pred_sql string, gold_sql_exec string"))).collect()
    assert {r.id: r.match for r in rows} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}
    assert {r.id: r.pred.success for r in rows if r.pred}[6] is True and {r.id: r.pred.rows for r in rows if r.pred}[6] == 4


def test_named_dataset(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    known = {"shop": (str(tmp_path), ["t"])}
    row = execute_on_dataset(spark, known, "shop", "SELECT * FROM t").first()
    assert row.dataset == "shop" and row.success and row.rows == 3
    row = execute_on_dataset(spark, known, "other", "SELECT * FROM t").first()
    assert not row.success and row.error == "Unknown dataset: other"
    assert not execute_on_dataset(spark, known, "shop", f"SELECT * FROM parquet.`{tmp_path}/t.parquet`").first().success


def test_one_text_on_two_datasets(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5)):
        spark.range(n).write.parquet(str(tmp_path / name / "t.parquet"))
    known = {name: (str(tmp_path / name), ["t"]) for name in "ab"}
    pairs = [("a", "SELECT * FROM t", "SELECT id FROM t"), ("b", "SELECT * FROM t", "SELECT id FROM t WHERE id < 3"), ("c", "SELECT 1", "SELECT 1")]
    ran = run_pairs(df(spark, pairs, "dataset string, pred_sql string, gold_sql_exec string"), datasets=known)
    rows = {r.dataset: r for r in match_outcomes(ran).collect()}
    assert [(rows[d].pred.rows, rows[d].match) for d in "ab"] == [(3, True), (5, False)]
    assert rows["c"].pred.error == "Unknown dataset: c"


def test_case_insensitive_tables(spark, tmp_path):
    df(spark, [(1, "Boston"), (2, "BOSTON"), (3, "x")], "id int, city string").write.parquet(str(tmp_path / "c.parquet"))
    known = {"a": (str(tmp_path), ["c"])}
    own = dataset_session(spark, known, "a", ignore_case=True)
    assert execute_sql(own, 'SELECT id FROM c WHERE city = "boston"')["rows"] == 2
    loose = own.table("c").select("city").where("id = 1")
    assert compare_results(loose, df(own, [("Boston",)], "city string")).first().match is True
    assert compare_results(loose, df(own, [("boston",)], "city string")).first().match is False
    assert fingerprint(loose).first() == fingerprint(df(spark, [("Boston",)], "city string")).first()
    assert execute_sql(dataset_session(spark, known, "a"), 'SELECT id FROM c WHERE city = "boston"')["rows"] == 0


def outcome(success, rows=1, time_s=1.0, a=1):
    return Row(success=success, rows=rows, time_s=time_s, error=None if success else "e",
               fingerprint=Row(columns="x", rows=rows, sum_a=Decimal(a), sum_b=Decimal(0)) if success else None)


def test_engine_comparison(spark):
    from sqlgauge.operators.execution import OUTCOME_STRUCT

    schema = f"id int, outcome {OUTCOME_STRUCT}"
    first = df(spark, [(0, outcome(True, 2, 1.5)), (1, outcome(True)), (2, outcome(False)), (3, outcome(True))], schema)
    second = df(spark, [(0, outcome(True, 2, 0.5)), (1, outcome(True, a=9)), (2, outcome(True)), (9, outcome(True))], schema)
    rows = {r.id: r for r in compare_engines(first, second, ["id"], "mysql", "mariadb").collect()}
    assert set(rows) == {0, 1, 2}
    assert rows[0].match and rows[0].time_difference == 1.0 and rows[0].reason is None and rows[0].mysql_rows == 2
    assert not rows[1].match and rows[1].reason is None
    assert not rows[2].match and rows[2].reason == "One or both queries failed" and rows[2].mysql_success is False and rows[2].mysql_time is None


def test_records_and_missing_predictions(spark):
    questions = df(spark, [("d", 0), ("d", 1)], "dataset string, id int")
    made = df(spark, [("d", 1, "SELECT 2", 7, 3, 0.12345678)],
              "dataset string, id int, pred_sql_raw string, prompt_tokens int, completion_tokens int, gen_time_s double")
    rows = {r.id: r for r in attach_predictions(questions, made, ["dataset", "id"]).collect()}
    assert tuple(rows[0])[2:] == ("SELECT 1;", 0, 0, None) and tuple(rows[1])[2:] == ("SELECT 2", 7, 3, 0.123457)

    base = attach_predictions(questions, made, ["dataset", "id"]).withColumn("schema_compact", F.lit("a(b)")).withColumn("match", F.lit(True))
    record = assemble_records(base, "m", "mysql").first().asDict()
    assert record["mysql_pred.success"] is False and record["mysql_gold.error"] == "NO_EXECUTION_ATTEMPT" and record["schema_num_tables"] == 1
    record = assemble_records(base, "m", "mysql", "underscored").first().asDict()
    assert record["mysql_pred_error_msg"] == "Not executed" and record["mysql_pred_time_s"] == 0.0 and record["mysql_pred_rows"] == 0
    with pytest.raises(ValueError):
        flatten_outcomes(base.withColumn("o", F.struct(F.lit(True).alias("success"))), {"p": "o"}, "other")


def test_query_text_refuses_escapes(spark):
    with pytest.raises(ParseException):
        query_text(spark, "SELECT 1) x, (SELECT 2")
    assert query_text(spark, "SELECT 1 ; ;\n") == "SELECT 1"


def test_every_order_takes_part_in_the_whole_run(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(k, k % 7, "FOP"[k % 3], "1-URGENT") for k in range(30)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    ran = {r["dataset"]: r["n_rows"] for r in queries()["x2_all_statuses"](spark, str(tmp_path)).collect()}
    assert ran == {"status_F": 10, "status_O": 10, "status_P": 10}
    ran = {r["dataset"]: r["n_questions"] for r in queries()["x0_all_statuses"](spark, str(tmp_path)).collect()}
    assert ran == {"status_F": 10, "status_O": 10, "status_P": 10}
