"""Every registered query against its DuckDB twin (the driver's gate), on
the smallest scale factor; queries without a twin must return rows with a
stable schema."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import canon, duck  # noqa: E402
from promptledger.plans import catalog  # noqa: E402

HEAVY = {"cross_validation", "calibrated_scores", "candidate_results", "classify_prompts"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert canon(df.columns, rows) == canon(dcols, res.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in catalog.QUERIES if k not in catalog.ORACLE and k not in HEAVY))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() >= 0 and len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    r = df.collect()
    assert len(r) == 1 and r[0].total_requests > 0
