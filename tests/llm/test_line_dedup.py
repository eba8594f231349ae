from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sqlgauge.llm import line_dedup as L

from .helpers import doc_rows


def expected(rows, ratio, least):
    pages, count = Counter(), defaultdict(Counter)
    for _, text, host in rows:
        pages[host] += 1
        count[host].update({x.strip(" ") for x in (text or "").split("\n")} - {""})
    out = []
    for i, text, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        bad = lambda x: x.strip(" ") and count[host][x.strip(" ")] >= max(least, 0) and count[host][x.strip(" ")] > ratio * pages[host]
        lines = text.split("\n")
        out.append((i, "\n".join(x for x in lines if not bad(x)), sum(bool(x.strip(" ")) for x in lines), sum(bool(bad(x)) for x in lines)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ratio,least", [(0.3, 2), (0.01, 5)])
def test_equals_brute_force(spark, ratio, least):
    rows = [(k, f"page {k}\n menu \n\nmenu\nfooter {k % 3}\nend", f"h{k % 2}") for k in range(40)]
    rows += [(100 + k, "menu\nalone" + "x\n" * 3000, "h9") for k in range(2)] + [(200, None, "h0"), (201, "", None), (202, "menu", None)]
    rows += [(0, rows[0][1], "h0"), (0, "other\nfooter 1", "h0"), (None, "menu\n é ", "h1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit(1))
    got = L.drop_boilerplate(docs, max_ratio=ratio, min_pages=least)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "_lines", "_dropped"]
    got = [(r["doc_id"], r["text"], r["_lines"], r["_dropped"]) for r in got.collect()]
    assert sorted(got, key=str) == expected(rows, ratio, least)


def test_empty_table_and_hosts(spark):
    assert L.drop_boilerplate(doc_rows(spark, [])).count() == 0
    urls = spark.createDataFrame([("http://A.example/x?y",), (None,), ("no url",)], "u string")
    assert [r[0] for r in urls.select(L.host_of(F.col("u"))).collect()] == ["a.example", None, None]


def test_plan_has_no_python(spark):
    plan = L.drop_boilerplate(doc_rows(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
