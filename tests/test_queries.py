"""Every registered query of the library beside its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from nlimorph.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        return "" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.columns, got.collect()) == normal(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_signature_ignores_order(spark):
    from nlimorph.operators.audit import data_signature
    from nlimorph.plans.fixtures import samples

    s = samples(spark, SF)
    assert data_signature(s).first() == data_signature(s.orderBy("row_key", ascending=False).repartition(5)).first()


def test_rows_of_few_row_groups_are_dealt(spark):
    """A file of one row group is read by one task; what is made of its rows must not be left to that task."""
    from nlimorph.plans.fixtures import prediction_lines, predictions

    plan = prediction_lines(predictions(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning(l_orderkey") > plan.rindex("Generate explode")
