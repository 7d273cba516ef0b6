"""Every query against its SQL, and what the two forms of a query have in common."""

import pytest
from helpers import duck, spark_rows

from kithgraph.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, DIR)) == duck(catalogue.ORACLE_SQL[name], DIR)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"to_fixed"}
