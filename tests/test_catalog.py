import os

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    for c in pdf:
        if pdf[c].dtype.kind in "iuf":
            pdf[c] = pdf[c].astype(float)
    return sorted(map(repr, pdf.astype(object).where(pdf.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).limit(5).collect()
