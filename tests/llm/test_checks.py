"""The corpus queries on the smallest given tables: names, SQL checks and row counts."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")
CORPUS, CHECKS = E.load_corpus()


def test_names():
    assert {int(m[1]) for n in CORPUS if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in CORPUS
    assert set(CORPUS) <= set(E.queries()) and set(CHECKS) <= set(E.oracle_sql()) and set(CHECKS) <= set(CORPUS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for view in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    df = E.queries()[name](spark, str(FOLDER))
    cursor = db.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in CORPUS if n.startswith("op") and n != "op13_lexical_search"))
def test_one_row_for_each_document(spark, name):
    got = E.queries()[name](spark, str(FOLDER))
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count() == got.count()
