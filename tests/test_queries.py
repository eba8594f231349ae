"""Every registered query on the smallest given tables against its SQL check."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "scripts"))

from check_queries import table  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from sqlgauge.workload import load  # noqa: E402
from sqlgauge.workload.registry import TABLES  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")
QUERIES, CHECKS = ({n: found[n] for n in part if n in found} for part, found in zip(load(), (queries(), oracle_sql())))


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS) == set(load()[0])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(FOLDER))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(CHECKS[name])
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
