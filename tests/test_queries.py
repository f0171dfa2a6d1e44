"""Every registered query against its SQL on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

from lexmill.plans.registry import ALL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def ordered(rows):
    return sorted((tuple(map(plain, row)) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, database, name):
    query, sql = ALL[name]
    df = query(spark, SF_DIR)
    columns = sorted(df.columns)
    rows = ordered(df.select(*columns).collect())
    assert rows or name in ("missing_ids",)
    if sql:
        selected = ", ".join(f'"{column}"' for column in columns)
        assert rows == ordered(database.execute(f"SELECT {selected} FROM ({sql})").fetchall())


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
