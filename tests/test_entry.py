"""Driver contract: entry smoke, oracle agreement at sf0.001, plan hygiene."""

import os
import sys

import pytest

import __spark_entry__ as E
from tests.oracle_compare import TABLES, compare, duck

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_audit import WHOLE_ROW, audit_plan, final_only  # noqa: E402

SMOKE = "/root/testdata/sf0.001"
SQL_NAMES = sorted(E.oracle_sql())
# Queries that evaluate Arrow batches in Python by design (of the optional subpackage).
ARROW = {"op11_nearest_neighbours", "op13_collocations"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["source", "n", "mean_target", "encoded"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


@pytest.mark.parametrize("name", SQL_NAMES)
def test_oracle_agrees(spark, con, name):
    problems, _, _ = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SMOKE)
    assert not problems, problems


@pytest.mark.parametrize("name", SQL_NAMES)
def test_plan_hygiene(spark, name):
    """The executed (final AQE) plan: no Python evaluation, no nested-loop or
    cartesian join, every single-partition exchange fed by a partial
    aggregate or a top-k, and no scan wider than the query needs."""
    df = E.queries()[name](spark, SMOKE)
    df.collect()
    plan = final_only(df._jdf.queryExecution().executedPlan().toString())
    widths = {t: len(spark.read.parquet(f"{SMOKE}/{t}.parquet").columns) for t in TABLES}
    a = audit_plan(plan, widths)
    assert a["python"] == 0 or name in ARROW, plan
    assert a["nested_loop"] == 0, plan
    assert a["single_unbounded"] == [], plan
    if name not in WHOLE_ROW and not name.startswith(("csv_roundtrip", "validation_")):
        for table, ncols, width, _ in a["scans"]:
            assert not width or ncols < width, f"{name} reads every column of {table}"
