"""Fills, SQL-text features, extraction and token helpers on edge cases."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import fills, flags, idents, sqltext, textops


def one(spark, expression, schema="x string", *values):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(expression).collect()]


def test_fill_is_literal_longest_first_and_whole_token(spark):
    rows = [
        ("var1 var10 xvar1 var1.", {"var1": "A", "var10": "B"}),
        ("a0 costs", {"a0": r"$5 \1 \\ x"}),
        ("a0", {"a0": None}),
        ("a0 b", {"a0": "b", "b": "c"}),
        ("none", {}),
        ("t.x(y)", {"x(y)": "z", "t.": "Q"}),
    ]
    df = spark.createDataFrame(rows, "t string, v map<string,string>")
    assert [r[0] for r in df.select(fills.fill_tokens(F.col("t"), F.col("v"))).collect()] == [
        "A B xvar1 A.", r"$5 \1 \\ x costs", "None", "c c", "none", "t.z",
    ]
    assert [r[0] for r in df.select(fills.fill_tokens(F.col("t"), F.col("v"), True)).collect()][2] == "a0"
    assert [r[0] for r in df.select(fills.fill_substrings(F.col("t"), F.col("v"))).collect()][0] == "A A0 xA A."


def test_fill_null_variables_keeps_text(spark):
    df = spark.createDataFrame([("a", None)], "t string, v map<string,string>")
    assert df.select(fills.fill_tokens(F.col("t"), F.col("v")), fills.fill_substrings(F.col("t"), F.col("v"))).first() == ("a", "a")


def test_merge_prefers_sentence_and_first_entry_value(spark):
    df = spark.createDataFrame(
        [({"a": None}, [("a", "1"), ("b", "2"), ("b", "3"), (None, "4"), ("", "5")]), (None, None)],
        "s map<string,string>, e array<struct<name:string,example:string>>",
    )
    got = [r[0] for r in df.select(fills.merge_variables(F.col("s"), F.col("e"))).collect()]
    assert got == [{"a": None, "b": "2"}, {}]


@pytest.mark.parametrize(
    "sql, sources, difficulty",
    [
        ("SELECT 1", 0, 1),
        ("SELECT a FROM t", 1, 1),
        ("SELECT a FROM t, u WHERE x", 2, 2),
        ("SELECT a FROM t JOIN u ON a=b JOIN v ON c=d", 3, 3),
        ("SELECT a FROM t, u, v, w ;", 4, 4),
        ("select count(*) from t group by a", 1, 2),
        ("SELECT a FROM t HAVING 1", 1, 3),
        ("SELECT a FROM t WHERE b IN (SELECT c FROM u)", 1, 3),
        ("SELECT a FROM (SELECT a, b FROM t WHERE c) x", 2, 3),
        ("SELECT a FROM (SELECT b, c) x", 1, 3),
        ("SELECT reunion_id FROM t", 1, 4),
        ("SELECT a FROM  ;", 0, 1),
        ("SELECT a\nFROM t\n, u\nWHERE b", 2, 2),
    ],
)
def test_sources_and_difficulty(spark, sql, sources, difficulty):
    df = spark.createDataFrame([(sql,)], "s string")
    assert tuple(df.select(sqltext.from_source_count(F.col("s")), sqltext.sql_difficulty(F.col("s"))).first()) == (
        sources, difficulty,
    )


def test_complexity_bucket(spark):
    texts = ["", None, "SELECT a FROM b, c", "SELECT a FROM b JOIN c", "select (select 1)", "JOIN JOIN JOIN", "SELECT SELECT SELECT"]
    assert one(spark, sqltext.complexity_bucket(F.col("x")), "x string", *[(t,) for t in texts]) == [
        "unknown", "unknown", "simple", "medium", "medium", "complex", "complex",
    ]


def test_schema_counts_and_tables(spark):
    text = "a(x, y)\r\n\r\n b: p, ,q \na (z)\nnot a line\n9c(q)\nd() e(f)"
    df = spark.createDataFrame([(text,), ("",), (None,)], "s string")
    rows = df.select(sqltext.schema_counts(F.col("s")), sqltext.schema_tables(F.col("s"))).collect()
    assert tuple(rows[0][0]) == (4, 6) and rows[0][1] == ["a", "a", "9c", "d", "e"]
    assert [tuple(r[0]) for r in rows[1:]] == [(0, 0), (0, 0)] and rows[2][1] == []


def test_extraction(spark):
    cases = {
        "a FROM t; x": "SELECT a FROM t;", "a\n\nb\nc": "SELECT a", "a\nb": "SELECT a", "a\r\n\r\nb": "SELECT a",
        "": "SELECT", "  a  ": "SELECT   a",
    }
    assert one(spark, sqltext.extract_continuation(F.col("x")), "x string", *cases) == list(cases.values())
    cases = {
        "### SQL: a ### SQL: SELECT 1; x": "SELECT 1;", "```sql\nSELECT 2\n```": "SELECT 2", "```SELECT 3": "SELECT 3",
        "### SQL:\n```\nA;B\n```": "A;", "plain": "plain",
    }
    assert one(spark, sqltext.extract_answer(F.col("x")), "x string", *cases) == list(cases.values())
    assert one(spark, sqltext.extract_answer(F.col("x"), F.lit("PROMPT")), "x string", "PROMPT SELECT 1") == ["SELECT 1"]


def test_tokens(spark):
    names = ["airport_code0", "unitPrice", "qty2sold", "HTTPServer", "a-b c"]
    assert one(spark, idents.split_identifier(F.col("x")), "x string", *names) == [
        ["airport", "code", "0"], ["unit", "Price"], ["qty", "2", "sold"], ["HTTPServer"], ["a", "b", "c"],
    ]
    words = ["bring", "king", "listing", "used", "ed", "red", "cities", "es", "yes", "is", "s", "bus"]
    assert one(spark, idents.stem(F.col("x")), "x string", *words) == [
        "br", "king", "list", "us", "ed", "red", "citi", "es", "ye", "is", "s", "bu",
    ]
    question = "List all the flights that arrive at MKE from various cities and flights"
    assert one(spark, idents.question_tokens(F.col("x")), "x string", question) == [
        ["flight", "that", "arrive", "mke", "variou", "citi", "flight"]
    ]


def test_tolerant_boolean(spark):
    cases = {"true": True, " T ": True, "YES": True, "1": True, "false": False, "N": False, "0": False, "2.5": None,
             "0.0": None, "2": None, "nan": None, "maybe": None, "": None, None: None, "-1": None}
    assert one(spark, flags.tolerant_boolean(F.col("x")), "x string", *[(k,) for k in cases]) == list(cases.values())


def test_numbers(spark):
    assert one(spark, flags.tolerant_boolean(F.col("x"), True), "x double", (2.0,), (0.0,), (None,), (-0.5,)) == [True, False, None, True]
    cases = {"1": 1.0, " 2.5 ": 2.5, "-1e3": -1000.0, ".5": 0.5, "7.": 7.0, "12d": None, "1f": None, "0x1p3": None, "NaN": None,
             "": None, None: None, "1,5": None, "Infinity": float("inf"), "-inf": float("-inf"), "1 2": None}
    assert one(spark, flags.tolerant_number(F.col("x")), "x string", *[(k,) for k in cases]) == list(cases.values())


def test_quoted_segments(spark):
    long = "'" + "x" * 50000 + "'"
    cases = {
        "": ([""], [], ""),
        "no quotes": (["no quotes"], [], "NO QUOTES"),
        "a 'b' c": (["a ", " c"], ["'b'"], "A 'b' C"),
        "'it''s' \"a\"\"b\" x": (["", " ", " x"], ["'it''s'", '"a""b"'], "'it''s' \"a\"\"b\" X"),
        "an 'open one": (["an 'open one"], [], "AN 'OPEN ONE"),
        "a\"b'c\"d'e": (["a", "d'e"], ["\"b'c\""], "A\"b'c\"D'E"),
        "''''": (["", ""], ["''''"], "''''"),
        long + "y": (["", "y"], [long], long + "Y"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "s string")
    rows = df.select("s", textops.unquoted(F.col("s")), textops.quoted(F.col("s")),
                     textops.map_unquoted(F.col("s"), lambda p: F.upper(p))).collect()
    for text, outside, inside, mapped in rows:
        assert (outside, inside, mapped) == cases[text]
