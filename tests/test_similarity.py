"""Similarities by distinct pairs: equal to one call per row, and no call more than needed."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from sqlgauge.functions.similarity import ratio_bound
from sqlgauge.operators import similarity as S


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def some_words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeé𝄞_ ") for _ in range(rng.randrange(7))) for _ in range(n)]


def test_ratio_of_rows(spark):
    left, right = some_words(300, 1), some_words(300, 2)
    rows = [*zip(left, right), ("ab", None), (None, None), ("", ""), ("a", "")] * 2
    got = S.add_ratio(spark.createDataFrame(rows, "x string, y string"), "x", "y").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ratio == (None if r.x is None or r.y is None else ratio(r.x, r.y))


def test_bound_is_never_exceeded(spark):
    rows = spark.createDataFrame([*zip(some_words(500, 3), some_words(500, 4))], "x string, y string")
    for r in rows.withColumn("most", ratio_bound(F.col("x"), F.col("y"))).collect():
        assert ratio(r.x, r.y) <= r.most + 1e-12 or r.x == r.y


def test_one_call_per_distinct_open_pair(spark):
    rows = [("gear", "gears"), ("gear", "gears"), ("gear", "gear"), ("gear", "bolt"), ("gears", "gear"), ("a", None), (None, "a")] * 50
    pairs = spark.createDataFrame(rows, "_a string, _b string")
    asked = {(r._a, r._b): r._ratio for r in S.pair_ratios(pairs).collect()}
    assert asked == {("gear", "gears"): ratio("gear", "gears"), ("gears", "gear"): ratio("gears", "gear")}
    assert S.pair_ratios(pairs).count() == S.open_pairs(pairs).count() == 2
