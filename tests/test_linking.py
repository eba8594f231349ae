"""Ranking, selection, neighbours and prompts by worked cases."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators import catalog, linking, prompts
from sqlgauge.sources.introspect import CATALOG

SCHEMA = {
    "flight": ["flight_id", "from_airport", "to_airport"],
    "flight_fare": ["flight_id", "fare_id"],
    "airport": ["airport_code", "cityName"],
    "city": ["city_code", "state2code"],
    "dual_carrier": ["main_airline", "service_name"],
    "note": ["txt"],
}
KEYS = [("flight", "airport"), ("flight_fare", "flight"), ("airport", "city")]


def profiles(spark, with_keys=True):
    rows = [("a", t, i, c, "int", True, None, None) for t, cs in SCHEMA.items() for i, c in enumerate(cs)]
    keys = spark.createDataFrame(
        [("a", t, 0, ["x"], r, ["y"]) for t, r in KEYS],
        "dataset string, table string, fk_pos int, columns array<string>, ref_table string, ref_columns array<string>",
    )
    return catalog.schema_profiles(spark.createDataFrame(rows, CATALOG), catalog.fk_graph(keys) if with_keys else None)


QUESTIONS = [
    "list all the flights that arrive at MKE from various cities", "Which carrier's service names are used?",
    "the", "zzz", "fares of flights with state 2", "",
]


def asked(spark):
    return spark.createDataFrame([("a", i, q) for i, q in enumerate(QUESTIONS)], "dataset string, id int, question_text_filled string")


NO_HIT = [(t, 0.0) for t in ("airport", "city", "dual_carrier", "flight", "flight_fare", "note")]
RANKINGS = [
    [("flight", 4.25), ("flight_fare", 4.25), ("dual_carrier", 0.1923), ("city", 0.1875), ("airport", 0.1154), ("note", 0.0714)],
    [("dual_carrier", 4.25), ("flight_fare", 0.1364), ("airport", 0.1071), ("city", 0.0909), ("note", 0.0714), ("flight", 0.0385)],
    NO_HIT,
    NO_HIT,
    [("flight", 4.25), ("flight_fare", 4.25), ("city", 2.1), ("note", 0.1111), ("airport", 0.1), ("dual_carrier", 0.1)],
    NO_HIT,
]


def test_rankings(spark):
    rows = linking.rank_tables(asked(spark), profiles(spark)).orderBy("id").collect()
    assert [[(t.table, round(t.score, 4)) for t in row.ranked] for row in rows] == RANKINGS


def test_top_k_with_fallback_by_name(spark):
    rows = linking.select_top(linking.rank_tables(asked(spark), profiles(spark)), 2).orderBy("id").collect()
    assert [t.table for t in rows[2].selected] == ["airport", "city"]
    assert [t.table for t in rows[0].selected] == ["flight", "flight_fare"]
    assert rows[0].selected[1].line == "flight_fare(flight_id, fare_id)" and rows[0].selected[1].neighbours == ["flight"]


def test_neighbours_fill_up_in_order(spark):
    ranked = linking.rank_tables(asked(spark), profiles(spark), fuzzy_weight=0)
    rows = linking.expand_neighbours(linking.select_top(ranked, 5), 5).orderBy("id").collect()
    by_name = ["airport", "city", "dual_carrier", "flight", "flight_fare"]
    assert [[t.table for t in row.selected] for row in rows] == [
        ["flight", "flight_fare", "airport"], ["dual_carrier"], by_name, by_name, ["flight", "flight_fare", "city", "airport"], by_name,
    ]
    assert rows[0].selected[2].line == "airport(airport_code, cityName)"


def test_link_schema_and_unknown_dataset(spark):
    rows = asked(spark).withColumn("dataset", F.when(F.col("id") == 0, "a").otherwise("nowhere"))
    got = {r.id: r.schema_compact for r in linking.link_schema(rows, profiles(spark), 1).collect()}
    assert got[0] == "flight(flight_id, from_airport, to_airport)" and got[1] == ""


def test_packing(spark):
    words = [f"w{i}" for i in range(90)]
    long = " ".join(words)
    cases = [("a b\n\n  c d e\nf", "q one"), ("", ""), (long + "\nx\ny z", "hi"), ("x y\n" + long + "\nz", long), ("x", long)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, schema_compact string, question_text_filled string")
    tail = lambda n: " " + " ".join(words[-n:])
    short = [("a b\n  c d e\nf", "q one", 19), ("", "", 11), ("", "hi", 12)]
    expected = {
        (10, 60): [*short, ("", tail(39), 50), ("", tail(39), 50)],
        (10, 30): [("a b\n  c d e", "q one", 18), *short[1:], ("", tail(32), 43), ("", tail(32), 43)],
        (1, 200): [*short[:2], (long + "\nx\ny z", "hi", 105), ("x y\n" + long + "\nz", long, 194), ("x", long, 102)],
    }
    for (new, ctx), want in expected.items():
        rows = prompts.pack_prompts(df, max_new_tokens=new, context=ctx).orderBy("i").collect()
        assert [(r.prompt_schema, r.prompt_question, r.prompt_tokens) for r in rows] == want
    with pytest.raises(ValueError):
        prompts.pack_prompts(df, max_new_tokens=60, context=60)


def test_pluggable_tokenizer(spark):
    df = spark.createDataFrame([("ab\ncd", "xyz")], "schema_compact string, question_text_filled string")
    row = prompts.pack_prompts(df, max_new_tokens=0 + 1, context=75, tokens=lambda c: F.split(c, "")).first()
    frame = len(prompts.PREFIX) + len(prompts.MIDDLE) + len(prompts.ENDING_CONTINUE)
    assert row.prompt_schema == ("ab\ncd" if 74 - frame - 3 >= 6 else ("ab" if 74 - frame - 3 >= 3 else ""))
