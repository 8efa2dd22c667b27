from pathlib import Path

import pytest
from oracle import SMALL, same

from fieldscore.plans import catalog, training_core

QUERIES = {**catalog.QUERIES, **training_core.QUERIES}
ORACLES = {**catalog.ORACLES, **training_core.ORACLES}
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
