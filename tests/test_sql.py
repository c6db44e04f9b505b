"""Every core query against its SQL, and a run of those without."""

import pytest
from compare import assert_same

from millrace.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, data, name):
    assert_same(spark, data, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry_has_every_query():
    import __spark_entry__

    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_names_of_expression_queries(spark):
    from millrace.operators import documents

    assert tuple(documents.built()) == documents.NAMES
