"""Table names in SQL: case, references, matching and repair by worked cases."""

import random

import pytest

from pyspark.sql import functions as F

from sqlgauge.operators import naming
from sqlgauge.workload import load

TABLES = ["Airport", "airport_service", "city", "flight", "flight_fare", "orders"]


def frame(spark, texts, tables=TABLES):
    return spark.createDataFrame([(i, t, tables) for i, t in enumerate(texts)], "i int, sql string, tables array<string>")


def test_case_fix_outside_and_inside_quotes(spark):
    texts = ["SELECT * FROM AIRPORT_SERVICE a, AIRPORT WHERE x = 'FROM City' AND \"CITY\" = city1 AND CITY.x", "", " Flight "]
    rows = frame(spark, texts).select(
        naming.table_case(F.col("sql"), F.col("tables")), naming.table_case_naive(F.col("sql"), F.col("tables"))
    ).collect()
    assert [r[0] for r in rows] == [
        "SELECT * FROM airport_service a, Airport WHERE x = 'FROM City' AND \"CITY\" = city1 AND city.x", "", " flight ",
    ]
    assert rows[0][1] == "SELECT * FROM airport_service a, Airport WHERE x = 'FROM city' AND \"city\" = city1 AND city.x"
    assert rows[2][1] == "flight"


def test_lookup_and_search_agree_on_plain_names(spark):
    rng = random.Random(3)
    words = ["AIRPORT", "airport", "Airport_Service", "CITY", "city2", "x.Flight", "'orders'", "ORDERS-1", "_city", "(city)"]
    texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(60)]
    plain = [r[0] for r in frame(spark, texts).select(naming.table_case(F.col("sql"), F.col("tables"))).collect()]
    # A name that is not plain sends the whole row through the searching form; it never occurs in the texts.
    odd = frame(spark, texts, TABLES + ["no-such name"])
    assert [r[0] for r in odd.select(naming.table_case(F.col("sql"), F.col("tables"))).collect()] == plain


def test_names_with_other_characters(spark):
    rows = frame(spark, ["FROM ORDER-ITEMS, Order"], ["order", "Order-Items"])
    assert rows.select(naming.table_case(F.col("sql"), F.col("tables"))).first()[0] == "FROM order-Items, order"


REPAIRS = [
    ("SELECT 1 FROM flights", "SELECT 1 FROM flight", [("flights", "flight", 0.99)]),
    ("x join FLGHT y", "x join flight y", [("FLGHT", "flight", 0.9091)]),
    ("FROM 'flights' ;", "FROM 'flights' ;", []),
    ("UPDATE `airports` SET x", "UPDATE `Airport` SET x", [("airports", "Airport", 0.99)]),
    ("insert into fligth_fare", "insert into flight_fare", [("fligth_fare", "flight_fare", 0.9091)]),
    ("delete  from ordres", "delete  from ordres", []),
    ("FROM zzz", "FROM zzz", []),
    ("from orderss, flights", "from orders, flights", [("orderss", "orders", 0.99)]),
    ("where Citys", "where Citys", []),
    ("JOIN Citys FROM \"flights\" FROM airport_services '", "JOIN city FROM \"flights\" FROM airport_service '",
     [("Citys", "city", 0.99), ("airport_services", "airport_service", 0.99)]),
    ("FROM FLIGHT", "FROM flight", []),
]


def test_repairs(spark):
    got = naming.repair_table_names(frame(spark, [t for t, _, _ in REPAIRS]), "sql").orderBy("i").collect()
    for row, (_, sql, log) in zip(got, REPAIRS):
        assert row.pred_sql == sql
        assert [(r["from"], r["to"], r["ratio"]) for r in row.pred_repairs] == log


def test_names_with_bars_and_two_spellings(spark):
    row = naming.repair_table_names(frame(spark, ["FROM flighst"], ["a|b", "flight", "orders"]), "sql").first()
    assert row.pred_sql == "FROM flight" and row.pred_repairs[0]["ratio"] == 0.9231
    twice = frame(spark, ["FROM ORDERS"], ["Orders", "orders"])
    both = twice.select(naming.table_case(F.col("sql"), F.col("tables")), naming.table_case_naive(F.col("sql"), F.col("tables"))).first()
    assert list(both) == ["FROM orders", "FROM orders"]


@pytest.mark.parametrize("name", ["t9_table_case_naive", "t10_table_case", "t11_table_references", "t12_best_match", "t13_repair", "t14_repair_log"])
def test_predictions_are_never_the_broadcast_side(spark, name):
    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BuildLeft" not in plan
    assert "[dataset" in plan and ("HashJoin" in plan or "SortMergeJoin" in plan)


def test_two_candidates_too_close_are_left_alone(spark):
    tables = ["flight_a", "flight_b"]
    row = naming.repair_table_names(frame(spark, ["SELECT 1 FROM flight_c"], tables), "sql").first()
    assert row.pred_sql == "SELECT 1 FROM flight_c" and row.pred_repairs == []


def test_repair_without_text_or_tables(spark):
    df = spark.createDataFrame([("", ["a"]), ("FROM x", []), ("FROM y", None), (None, ["a"])], "sql string, tables array<string>")
    rows = naming.repair_table_names(df, "sql").collect()
    assert [(r.pred_sql, r.pred_repairs) for r in rows] == [("", []), ("FROM x", []), ("FROM y", []), (None, [])]


def test_clean_prediction_end_to_end(spark):
    df = spark.createDataFrame(
        [("SELECT ids FROM flights WHERE id IN ( SELECT id FROM Flights )", TABLES)], "pred_sql_raw string, tables array<string>"
    )
    row = naming.clean_prediction(df).first()
    assert row.pred_sql == "SELECT ids FROM flight WHERE id IN ( SELECT id FROM flight )"
    assert [r["ratio"] for r in row.pred_repairs] == [0.99, 0.99]


def test_an_unchanged_text_is_cut_and_joined_once(spark):
    """The naive fix is an input of the second one, which reads it once; so is a schema text for both of its counts."""
    from sqlgauge.functions.sqltext import schema_counts
    from sqlgauge.operators.naming import clean_prediction

    rows = spark.createDataFrame([("SELECT 'orders x' FROM ORDERS o, `Orders`", ["orders"])], "pred_sql_raw string, tables array<string>")
    cleaned = clean_prediction(rows, repair=False)
    assert cleaned.first().pred_sql == "SELECT 'orders x' FROM orders o, `orders`"
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count(r"(?U)\w+") == 1
    counts = spark.range(1).select(schema_counts(F.lit("a(b, c)\nd: e")).alias("c")).first().c
    assert (counts.tables, counts.columns) == (2, 3)
