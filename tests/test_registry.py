"""A few registered queries against their SQL on the smallest tables; all of them are compared by the driver."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from packloom.plans import registry, registry_sql

TABLES = "/root/testdata/sf0.001"
NAMES = ("pack_sequences", "token_offsets", "shuffled_rows", "ens_report", "logit_log_prob", "metrics_rollup")

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry_sql.ORACLES)
    assert set(registry.QUERIES) <= set(entry_point.queries())
    assert set(registry_sql.ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "events", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    cursor = db.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = entry_point.queries()[name](spark, TABLES)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(repr(r) for r in cursor.fetchall())


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 1000
