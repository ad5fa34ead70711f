"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from oracle import close, duck, rows

from panelweft.plans import queries as library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_matches_sql(spark, con, name):
    got = library.QUERIES[name](spark, SF).toPandas()
    want = con.execute(library.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    close(rows(got), rows(want))


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs(spark, name):
    assert library.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
