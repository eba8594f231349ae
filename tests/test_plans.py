"""Scale helpers against brute force: running sums, order statistics, null-safe joins, scratch folders."""

import math
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sqlgauge.plans import quantiles
from sqlgauge.plans.joins import null_safe_join
from sqlgauge.plans.ordering import sum_before
from sqlgauge.plans.quantiles import cell, order_statistics, with_order_statistics
from sqlgauge.plans.scratch import materialize, release, scratch_path
from sqlgauge.plans.spread import SETTING, spread


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_sum_before(spark, block):
    rng = random.Random(block)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), p, rng.randint(0, 5)) for p in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, p long, w int")
    got = {(r.k, r.p): r.before for r in sum_before(df, ["k"], "p", F.col("w"), "before", block).collect()}
    for k, p, _ in rows:
        assert got[k, p] == sum(w for k2, p2, w in rows if k2 == k and p2 < p)


def nearest(xs, q):
    xs = sorted(xs)
    return xs[max(0, min(math.ceil(q * len(xs)) - 1, len(xs) - 1))] if xs else None


def test_order_statistics(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(3000):
        key = rng.choice(["hot", "hot", "hot", "b", None, "nulls"])
        kind = rng.randint(0, 4)
        value = [rng.uniform(-5, 5), 0.0, float(rng.randint(1, 3)), rng.lognormvariate(0, 6), -rng.lognormvariate(0, 6)][kind]
        rows.append((key, None if key == "nulls" or rng.random() < 0.1 else value, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "k string, v double, n int")
    wanted = {f"d{q}": ("v", "disc", q) for q in (0.0, 0.1, 0.5, 0.9, 1.0)}
    wanted |= {f"c{q}": ("v", "cont", q) for q in (0.5, 0.95)} | {"n9": ("n", "disc", 0.9)}
    summary = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    got = {r.k: r.asDict() for r in with_order_statistics(summary, df, ["k"], wanted).collect()}
    assert set(got) == {"hot", "b", None, "nulls"}
    for key, row in got.items():
        values = [v for k, v, _ in rows if k == key and v is not None]
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            assert row[f"d{q}"] == nearest(values, q)
        for q in (0.5, 0.95):
            want = pd.Series(values, dtype=float).quantile(q) if values else None
            assert row[f"c{q}"] == (pytest.approx(want) if values else None)
        assert row["n9"] == nearest([n for k, _, n in rows if k == key], 0.9)


@pytest.mark.parametrize("size", range(1, 13))
def test_nearest_rank_of_small_groups(spark, size):
    df = spark.createDataFrame([("k", float(i)) for i in range(size)], "k string, v double")
    row = order_statistics(df, ["k"], {"m": ("v", "disc", 0.5), "p": ("v", "disc", 0.9)}).first()
    assert (row.m, row.p) == (nearest(range(size), 0.5), nearest(range(size), 0.9))


def test_cells_are_monotone(spark):
    rng = random.Random(1)
    values = sorted([rng.lognormvariate(0, 30) for _ in range(500)] + [-rng.lognormvariate(0, 30) for _ in range(500)]
                    + [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")])
    cells = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(cell(F.col("v"))).collect()]
    assert cells == sorted(cells)


def test_null_safe_join(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 3), (None, 4)], "k string, b int")
    assert {(r.k, r.a, r.b) for r in null_safe_join(a, b, ["k"]).collect()} == {("x", 1, 3), (None, 2, 4)}


def test_materialize_reads_back_the_same_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "i int, s string")
    assert {tuple(r) for r in materialize(df, "t").collect()} == {(1, None), (2, "b")}
    assert scratch_path(spark, "t") != scratch_path(spark, "t")


def test_spread_only_where_the_session_asks(spark):
    asked = spark.conf.get(SETTING)
    wide = spark.range(100, numPartitions=int(asked) + 1)
    assert spread(wide).rdd.getNumPartitions() == int(asked)
    try:
        spark.conf.unset(SETTING)
        assert spread(wide) is wide
    finally:
        spark.conf.set(SETTING, asked)


def test_hot_cells_are_cut_until_bounded(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CELL_VALUES", 10)
    monkeypatch.setattr(quantiles, "PARTS", 7)
    seen = []
    real = quantiles._running
    rng = random.Random(4)
    rows = [("a", 1000 + rng.random() / 1000) for _ in range(700)] + [("b", 5.0)] * 300 + [("b", 5.0 + k / 1e9) for k in range(80)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    requests = {"low": ("v", "disc", 0.1), "mid": ("v", "disc", 0.5), "top": ("v", "disc", 0.95), "half": ("v", "cont", 0.5)}

    def watched(name, keys, order):
        seen.append((tuple(keys), order))
        return real(name, keys, order)

    monkeypatch.setattr(quantiles, "_running", watched)
    got = {r.g: r for r in quantiles.order_statistics(df, ["g"], requests).collect()}
    assert sum(order == "_part" for _, order in seen) >= 2
    for g in "ab":
        values = sorted(v for k, v in rows if k == g)
        n = len(values)
        for name, q in (("low", 0.1), ("mid", 0.5), ("top", 0.95)):
            assert got[g][name] == values[max(1, math.ceil(q * n)) - 1]
        assert got[g]["half"] == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2, rel=1e-15)


def test_scratch_tables_can_be_released(spark):
    materialize(spark.range(3), "gone")
    folder = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    assert list(folder.rglob("*.parquet"))
    release(spark)
    assert not folder.exists()
