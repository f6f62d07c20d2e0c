"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from logweft.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    def one(v):
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted(repr(tuple(one(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = db.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert plain(got.collect()) == plain(tuple(r[k] for k in at) for r in want.fetchall())


def test_messages_fit(spark):
    rows = catalogue.chat_messages(spark, FOLDER).orderBy("message").collect()
    assert [r.message for r in rows] == list(range(len(rows))) and rows[0].text.startswith("# Log Summary")
    assert all(len(r.text) <= 2000 for r in rows)
    assert sum(r.text.count("\n`") for r in rows[1:]) == spark.read.parquet(f"{FOLDER}/events.parquet").count()
