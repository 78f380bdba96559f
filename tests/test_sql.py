"""Every query with SQL against DuckDB on the small tables; the others must run."""

import pytest
from compare import differences

from factloom.plans import engine, program, records, scalars

PARTS = {**records.QUERIES, **engine.QUERIES, **program.QUERIES, **scalars.QUERIES}
SQL = {**records.SQL, **engine.SQL, **program.SQL, **scalars.SQL}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_query(spark, sf_dir, name):
    if name in SQL:
        assert differences(spark, sf_dir, name, PARTS[name], SQL[name]) == ""
    else:
        PARTS[name](spark, sf_dir).collect()


def test_entry_lists_all():
    import __spark_entry__ as entry

    assert set(PARTS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
